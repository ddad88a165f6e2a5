"""Neighbours by packed blocks that are written once, and user lists summed where they are cut."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplens.operators import cf, neighbors
from tests.test_neighbors import brute, matrix


def _dense(users=150, items=30):
    rng = random.Random(8)
    return [(f"u{u:03d}", f"i{i:02d}", float(rng.choice((1, 2, 3, 5)))) for u in range(users) for i in range(items) if rng.random() < 0.5]


@pytest.mark.parametrize("entries", [_dense(), matrix(9)])
def test_blocks_are_written_once_and_no_list_is_sent(spark, monkeypatch, entries):
    written = []
    plain = neighbors.cut_lineage
    monkeypatch.setattr(neighbors, "cut_lineage", lambda df: written.append(plain(df)) or written[-1])
    monkeypatch.setattr(neighbors, "_search", None)
    monkeypatch.setattr(neighbors, "SPARSE", 60)
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    df = spark.createDataFrame(entries, "user_id string, item_id string, score double")
    got = sorted((r["user_id"], r["neighbor_id"], r["rank"]) for r in cf.nearest_users(df, 4, tile_entries=200).collect())
    assert got == [r[:3] for r in brute(entries, 4)]
    packed = [w for w in written if w.columns == ["block", "data"]]
    assert len(packed) == 1
    assert packed[0].count() == packed[0].select("block").distinct().count() > 3
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == size


@pytest.mark.parametrize("share", [0.9, 0.1])
def test_streamed_lists_equal_brute_force(monkeypatch, share):
    monkeypatch.setattr(neighbors, "BLOCK", 7)
    monkeypatch.setattr(neighbors, "CHUNK", 5)
    rng = np.random.default_rng(1)
    rows = (rng.random((60, 40)) < share) * rng.integers(1, 4, (60, 40)).astype(float)
    rows[rows.sum(1) == 0, 0] = 1.0
    u, f = np.nonzero(rows)
    blocks = [neighbors._Block.unpack(neighbors._Block.of(u[u % 4 == b], f[u % 4 == b], rows[u, f][u % 4 == b]).pack()) for b in range(4)]
    norm = np.sqrt((rows * rows).sum(1))
    sims = (rows @ rows.T) / (norm[:, None] * norm[None, :])
    for b, q in enumerate(blocks):
        lists = neighbors._Lists(q, 6)
        for c in blocks:
            lists.meet(c)
        for i, key in enumerate(q.keys):
            assert key % 4 == b
            want = sorted((-s, v) for v, s in enumerate(sims[key]) if s > 0)[:6]
            found = [(-s, v) for s, v in zip(lists.low[i], lists.key[i]) if s > 0]
            assert [-s for s, _ in found] == pytest.approx([-s for s, _ in want])
            assert {v for s, v in found if s < want[-1][0] - 1e-9} == {v for s, v in want if s < want[-1][0] - 1e-9}


def test_lists_are_shuffled_once_by_user(spark):
    entries = [("a", "x", 1.0), ("a", "y", 0.0), ("b", "x", 2.0), ("b", "y", 3.0), ("b", "z", 1.0), ("c", "x", 1.0), ("c", None, 5.0), ("c", "w", 2.0),
               (None, "x", 1.0)]
    df = spark.createDataFrame(entries, "user_id string, item_id string, score double")
    out = cf.user_cf(df, top_n=5, neighbors=2)
    assert sorted((r["user_id"], r["rank"], str(r["item_id"]), r["score"]) for r in out.collect()) == [
        ("a", 1, "None", 5.0), ("a", 2, "y", 3.0), ("a", 3, "w", 2.0), ("a", 4, "z", 1.0),
        ("b", 1, "None", 5.0), ("b", 2, "w", 2.0), ("c", 1, "y", 3.0), ("c", 2, "z", 1.0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [user_id" in plan and "LeftAnti" not in plan
