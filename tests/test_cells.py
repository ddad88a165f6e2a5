"""Cell search against brute force: many cells, hot cells, ties, limits, own depths."""

import math

import numpy as np
import pytest

from shoplens.operators import cells

SCHEMA_Q = "query_id string, vector array<double>, budget double"
SCHEMA_C = "item_id string, embedding array<double>, price double"


def data(seed=0, n=700, dim=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim)) * 3
    items = [(f"i{i:04d}", (centres[i % 12] + rng.normal(size=dim) * .2).round(3).tolist(), float(i % 50)) for i in range(n)]
    items += [(f"t{i:04d}", [1.0] * dim, 7.0) for i in range(n // 2)]        # a third of all rows are one vector
    items += [("null", None, 1.0), ("nan", [float("nan")] * dim, 1.0), ("noprice", [1.5] * dim, None), ("zero", [0.0] * dim, 0.0)]
    queries = [(f"q{i:03d}", (centres[i % 12] + rng.normal(size=dim)).round(3).tolist(), float(i) if i % 3 == 0 else None) for i in range(90)]
    queries += [("ties", [1.0] * dim, None), ("z", [0.0] * dim, 5.0), ("none", None, None), ("i0003", items[3][1], None)]
    return queries, items


def brute(queries, items, k, extra=(), limit=False, self_out=False, above=None):
    out = []
    for q, v, b in queries:
        if v is None:
            continue
        rows = []
        for i, x, p in items:
            if x is None or (self_out and i == q) or (limit and b is not None and not (p is not None and p <= b)):
                continue
            s = float((np.array(v) * np.array(x)).sum())
            if math.isfinite(s) and (above is None or s > above):
                rows.append((-s, i))
        for r, (s, i) in enumerate(sorted(rows)[:k + dict(extra).get(q, 0)]):
            out.append((q, i, -s + 0.0, r + 1))
    return sorted(out)


@pytest.mark.parametrize("cell,side", [(4096, 4096), (60, 4096), (25, 16)])
def test_search_equals_brute_force(spark, cell, side):
    queries, items = data()
    q, c = spark.createDataFrame(queries, SCHEMA_Q), spark.createDataFrame(items, SCHEMA_C)
    keys = dict(q_key="query_id", c_key="item_id", c_vec="embedding", cell=cell, side=side)

    def run(k, **more):
        return sorted((r["q_key"], r["c_key"], r["score"] + 0.0, r["rank"]) for r in cells.dense_topk(q, c, k, **keys, **more).collect())

    assert run(5) == brute(queries, items, 5)
    assert run(4, q_limit="budget", c_value="price") == brute(queries, items, 4, limit=True)
    more = [("q001", 30), ("ties", 400), ("q002", 1)]
    extra = spark.createDataFrame(more, "k string, n long")
    assert run(3, extra=extra, exclude_self=True) == brute(queries, items, 3, more, self_out=True)
    assert run(6, min_score=1.0) == brute(queries, items, 6, above=1.0)
    assert run(5000) == brute(queries, items, 5000)


def test_far_cells_are_not_visited(spark):
    queries, items = data(n=1200)
    q = spark.createDataFrame(queries, SCHEMA_Q).selectExpr("query_id q_key", "vector q_vec", "budget limit", "3L depth").where("q_vec is not null")
    c = spark.createDataFrame(items, SCHEMA_C).selectExpr("item_id c_key", "embedding c_vec", "price value").where("c_vec is not null")
    members, own = cells._deal(c, 30, 60)
    assert members.count() == c.count() and members.groupBy("cell", "block").count().where("count > 120").count() == 0
    near = cells._route(q, own, False)
    visited = near.count()
    found = cells._ranked(cells._search(near.selectExpr("*", "0 side"), members.selectExpr("*", "0 side"), False, None)).where("rank = 3")
    rest = q.join(found.selectExpr("q_key", "score least"), "q_key")
    visited += cells._route(rest, own, True).count()
    assert visited < 0.5 * q.count() * int(own.blocks.sum())


def test_empty_sides(spark):
    queries, items = data(n=60)
    q, c = spark.createDataFrame(queries, SCHEMA_Q), spark.createDataFrame(items, SCHEMA_C)
    for a, b in ((q.limit(0), c), (q, c.limit(0))):
        for cell in (4096, 10):
            assert cells.dense_topk(a, b, 3, q_key="query_id", c_key="item_id", c_vec="embedding", cell=cell).count() == 0


def test_vectors_are_sent_once_for_each_tile(spark):
    """60 cells travel as 6 tiles: a query that visits all cells is sent 6 times, not 60."""
    rng = np.random.default_rng(6)
    c = spark.createDataFrame([(f"i{i:04d}", rng.normal(size=8).tolist(), None) for i in range(1200)], "c_key string, c_vec array<double>, value double")
    q = spark.createDataFrame([(f"q{i}", rng.normal(size=8).tolist(), None, 3, float("-inf")) for i in range(40)],
                              "q_key string, q_vec array<double>, limit double, depth long, least double")
    _, own = cells._deal(c, 60, 250)
    tiles = cells._tiles(own, 250)
    held = np.zeros(int((tiles + own.blocks).max()))
    for t, b, n in zip(tiles, own.blocks, own.rows):
        held[t:t + b] += n / b
    assert len(held) <= 10 and held.max() <= 250 and held.sum() == 1200
    sent = cells._tile_route(q, spark.sparkContext.broadcast(own), tiles, True)
    assert sent.count() <= 40 * len(held) and sent.groupBy("q_key", "tile").count().where("count > 1").count() == 0


def test_ties_are_scored_in_parts(monkeypatch):
    """Exact scores of many pairs never need all their vectors at once."""
    sizes, plain = [], cells._pair_scores
    monkeypatch.setattr(cells, "PAIRS", 1000)
    monkeypatch.setattr(cells, "_pair_scores", lambda a, b: sizes.append(len(a)) or plain(a, b))
    ones = np.ones((100, 4))
    qi, ci, score = cells.best_pairs(ones, ones, np.full(100, 100), np.arange(100), None, None)
    assert len(qi) == 10_000 and (score == 4).all() and max(sizes) <= 1000
