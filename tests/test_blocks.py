"""Vectors and products by blocks: features of pairs, cells of the approximate search, dense rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplens.functions import vectors as V
from shoplens.operators import neighbors as N
from shoplens.operators import vectors as VO

VEC = "array<double>"


@pytest.mark.parametrize("odd", [False, True])
def test_pair_cosines_equal_joins(spark, odd):
    vecs = [("a", [1.0, 2.0]), ("b", [0.0, 0.0]), ("b", [3.0, -1.0]), ("c", None), (None, [1.0, 1.0])]
    if odd:
        vecs += [("d", [1.0, None]), ("e", [1.0, 2.0, 3.0])]
    emb = spark.createDataFrame(vecs, f"item_id string, embedding {VEC}")
    ctx = spark.createDataFrame([("u", [0.3, 0.7], [1.0, 0.0]), ("v", None, [0.0, 0.0]), (None, [1.0, 1.0], [1.0, 1.0])],
                                f"user_id string, cart {VEC}, click {VEC}")
    pairs = spark.createDataFrame([(u, i, 0.5) for u in ("u", "v", "w", None) for i in ("a", "b", "c", "d", "e", "x", None, "a")],
                                  "user_id string, item_id string, s double")
    want = pairs.join(ctx, "user_id", "left").join(emb, "item_id", "left").select("user_id", "item_id", "s", *[
        F.when(F.col("embedding").isNotNull() & F.col(c).isNotNull(), V.cosine("embedding", c)).otherwise(F.lit(0.0)).alias(f"to_{c}")
        for c in ("cart", "click")])
    for block in (4, 1 << 18):
        got = VO.pair_cosines(pairs, ctx, emb, {"cart": "to_cart", "click": "to_click"}, block)
        assert got.columns == want.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert VO.pair_cosines(pairs.limit(0), ctx, emb, {"cart": "to_cart"}).count() == 0


def test_ann_with_all_cells_is_exact_and_sends_no_vector_with_a_candidate(spark):
    rng = np.random.default_rng(3)
    rows = [(f"i{i}", [float(x) for x in rng.normal(size=4)]) for i in range(120)]
    items = spark.createDataFrame(rows, f"item_id string, embedding {VEC}")
    queries = spark.createDataFrame(rows[:30], f"user_id string, vector {VEC}")
    got = VO.vector_topn_ann(queries, items, 5, n_cells=6, n_probe=6)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "zip_with" not in plan
    exact = VO.vector_topn(queries, items, 5)
    cols = ["user_id", "item_id", "score", "rank"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, exact.select(cols).collect()))


def test_dense_rows_are_multiplied_not_expanded(monkeypatch):
    rng = np.random.default_rng(1)
    dense = (rng.random((60, 100)) < 0.35) * rng.integers(1, 6, (60, 100))
    row, feature = np.nonzero(dense)
    value = dense[row, feature].astype(float)

    def expanded(*_):
        raise AssertionError("products expanded")

    monkeypatch.setattr(N.np, "repeat", expanded)
    got = N._products(row, feature, value, row, feature, value, 60, 60, 100)
    monkeypatch.undo()
    assert (got == dense @ dense.T).all()


def test_best_of_later_chunks_with_ties():
    rng = np.random.default_rng(2)
    scores, k = rng.integers(0, 6, (40, 30)) / 5.0, 4
    none, rank = np.zeros(40), rng.permutation(30)
    qi, ci, place = N._best(scores, none, np.zeros(40), rank, k)
    kth = np.array([sorted(s, reverse=True)[k - 1] for s in scores])
    assert [(q, c) for q, c in zip(qi, ci)] == [(q, c) for q, c in zip(*N._best(scores, none, kth, rank, k, True)[:2])]
    assert place.max() == k - 1 and math.isclose(scores[qi, ci].min(), kth[kth > 0].min())
