"""Cosine neighbours against brute force: a hot item, a power user, classes of equal users, pruned and not."""

import math
import random

import numpy as np
import pytest

from shoplens.operators import cells
from shoplens.operators.cf import nearest_users


def brute(entries, k):
    rows = {}
    for u, i, w in entries:
        if w:
            rows.setdefault(u, {})[i] = w
    norm = {u: math.sqrt(sum(w * w for w in r.values())) for u, r in rows.items()}
    out = []
    for u, r in rows.items():
        best = []
        for v, s in rows.items():
            dot = sum(w * s[i] for i, w in r.items() if i in s)
            if v != u and dot / (norm[u] * norm[v]) > 0:
                best.append((-dot / (norm[u] * norm[v]), v))
        out += [(u, v, n + 1, -s) for n, (s, v) in enumerate(sorted(best)[:k])]
    return sorted(out)


def matrix(seed):
    rng = random.Random(seed)
    entries = {}
    for u in range(150):
        for i in rng.sample(range(120), rng.choice((1, 3, 8, 15))):
            entries[f"u{u:03d}", f"i{i:03d}"] = float(rng.choice((1, 2, 3, 5)))
    for u in range(200):                                     # users of the hot item alone, in few classes
        entries[f"h{u:03d}", "hot"] = float(1 + u % 3)
    for u in range(0, 150, 2):
        entries[f"u{u:03d}", "hot"] = float(rng.choice((1, 4)))
    for i in range(120):                                     # a power user
        entries["power", f"i{i:03d}"] = float(1 + i % 4)
    entries["power", "hot"] = 2.0
    entries["zero", "i001"] = 0.0
    return [(u, i, w) for (u, i), w in entries.items()]


@pytest.mark.parametrize("options", [{}, {"prune": False, "block": 40, "slice_entries": 300},
                                     {"prune": True, "block": 40, "slice_entries": 500, "seed_entries": 60},
                                     {"prune": True, "block": 4096, "seed_entries": 8}])
def test_neighbours_equal_brute_force(spark, options):
    entries = matrix(3)
    df = spark.createDataFrame(entries, "user_id string, item_id string, score double")
    got = sorted((r["user_id"], r["neighbor_id"], r["rank"], r["similarity"]) for r in nearest_users(df, 4, **options).collect())
    want = brute(entries, 4)
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-12)


def test_negative_scores_and_empty_matrix(spark):
    entries = [("a", "x", 1.0), ("a", "y", -2.0), ("b", "x", 2.0), ("b", "y", 1.0), ("c", "y", -1.0), ("d", "z", 4.0)]
    df = spark.createDataFrame(entries, "user_id string, item_id string, score double")
    for prune in (None, True):
        got = sorted((r["user_id"], r["neighbor_id"], r["rank"]) for r in nearest_users(df, 3, prune=prune).collect())
        assert got == [r[:3] for r in brute(entries, 3)]
    assert nearest_users(df.limit(0), 3).count() == 0


@pytest.mark.parametrize("cell", [4096, 20])
def test_rank_of_target(spark, cell):
    rng = np.random.default_rng(2)
    items = [(f"i{i}", (rng.normal(size=4) + 4 * (i % 5 == 0)).tolist()) for i in range(200)] + [(f"t{i}", [1.0] * 4) for i in range(50)]
    queries = [(f"s{i}", rng.normal(size=4).tolist()) for i in range(30)] + [("ones", [1.0] * 4)]
    targets = [(q, f"i{n * 3}") for n, (q, _) in enumerate(queries[:-1])] + [("ones", "t7"), ("nobody", "i1")]
    got = {r["sample_id"]: r["target_rank"] for r in cells.rank_of_target(
        spark.createDataFrame(queries, "sample_id string, vector array<double>"),
        spark.createDataFrame(targets, "sample_id string, item_id string"),
        spark.createDataFrame(items, "item_id string, embedding array<double>"), cell=cell, side=16).collect()}
    vec, by = dict(items), dict(targets)
    for q, v in queries:
        score = (np.array(v) * np.array(vec[by[q]])).sum()
        assert got[q] == 1 + sum((np.array(v) * np.array(x)).sum() > score for x in vec.values())
    assert len(got) == len(queries)


def test_sparse_overlaps_are_searched_by_tiles_of_whole_rows(spark, monkeypatch):
    """No inverted list is sent to blocks where features are shared by few rows."""
    from shoplens.operators import neighbors
    monkeypatch.setattr(neighbors, "_search", None)
    entries = matrix(5)
    df = spark.createDataFrame(entries, "user_id string, item_id string, score double")
    got = sorted((r["user_id"], r["neighbor_id"], r["rank"]) for r in nearest_users(df, 4, tile_entries=300).collect())
    assert got == [r[:3] for r in brute(entries, 4)]


def test_tile_expands_whole_rows_in_parts():
    import pyarrow as pa

    from shoplens.operators import neighbors
    rng = np.random.default_rng(4)
    dense = (rng.random((30, 12)) < .4) * rng.integers(1, 5, (30, 12))
    lists = [np.flatnonzero(r).tolist() for r in dense]
    table = pa.table({"u": [f"u{i:02d}" for i in range(30)], "norm": np.sqrt((dense * dense).sum(1)) + 0.0,
                      "fs": pa.array(lists, pa.list_(pa.int64())), "ws": pa.array([r[i].tolist() for r, i in zip(dense.astype(float), lists)], pa.list_(pa.float64()))})
    whole = neighbors._tile(table, table, 3).sort_by([("q", "ascending"), ("low", "descending"), ("c", "ascending")])
    assert whole.num_rows == 90
    for expanded in (1, 50):
        assert neighbors._tile(table, table, 3, expanded).sort_by([("q", "ascending"), ("low", "descending"), ("c", "ascending")]).equals(whole)
