"""Streams: co-cart equals the batch result, sinks survive a replay, topic rows get ids."""

import json
import os

import pyarrow.parquet as pq
import pytest

from shoplens.operators import online as O
from shoplens.sources import fixtures as X
from shoplens.sources.tables import VersionedTable
from shoplens.streaming import live as L

from .conftest import SF_SMALL


def _same(a, b):
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _batch_weights(events, **ttl):
    return O.co_cart_weights(events, **ttl).select("item_a", "item_b", "weight", "last_updated")


def test_stream_pairs_equal_batch_pairs(spark):
    s = L.run_co_cart(X.events_from(L.read_event_files(spark, SF_SMALL, "events.parquet")), "test-cocart")
    assert _same(s, _batch_weights(X.events(spark, SF_SMALL))) and s.count() > 0


@pytest.mark.parametrize("ttl", [None, 86_400, 4 * 3600])
def test_stream_pairs_over_batches_of_unsorted_files_and_a_restart(spark, tmp_path, ttl):
    rows = pq.read_table(f"{SF_SMALL}/events.parquet").sort_by([("ts", "ascending"), ("event_id", "ascending")])
    step = -(-rows.num_rows // 4)

    def add(i):  # the batches come in order of time, rows inside a file don't
        part = rows.slice(i * step, step)
        path = tmp_path / "in" / f"{i}.parquet"
        path.parent.mkdir(exist_ok=True)
        pq.write_table(part.take(list(range(part.num_rows))[::-1]), path)
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))

    for files in ((0, 1), (2, 3)):  # the second run goes on where the first ended
        for i in files:
            add(i)
        stream = X.events_from(L.read_event_files(spark, str(tmp_path / "in"), max_files_per_trigger=1))
        got = L.run_co_cart(stream, "test", ttl_seconds=ttl, folder=str(tmp_path / "stream"))
    assert _same(got, _batch_weights(X.events(spark, SF_SMALL), ttl_seconds=ttl))


def test_versioned_table_replays_and_reads_one_version(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v string").schema
    t = VersionedTable(spark, str(tmp_path / "t"), schema, ["k"], buckets=4)
    assert t.read().count() == 0
    t.upsert(spark.range(40).selectExpr("id k", "'a' v"), 0)
    want = {k: "b" if 5 <= k < 9 else "a" for k in range(40)} | {99: "b"}
    new = spark.createDataFrame([(k, "b") for k in [5, 6, 7, 8, 99]], schema)
    for _ in range(2):  # the second time is a replay
        t.upsert(new, 3)
        assert {r.k: r.v for r in t.read().collect()} == want
    one = spark.createDataFrame([(5, "c")], schema)
    t.upsert(one, 4)
    assert {r.k: r.v for r in t.before(4).collect()} == want
    t.upsert(new, 3)  # a late replay leaves the newest version as it is
    assert {r.k: r.v for r in t.read().collect()} == want | {5: "c"}
    # a merge may drop rows; buckets without rows are gone
    t.upsert(one, 5, lambda old, rows: old.where("k <> 5"))
    assert 5 not in {r.k for r in t.read().collect()} and t.versions() == [0, 3, 4, 5]
    t.clean(keep=1)
    assert {r.k: r.v for r in t.read().collect()} == {k: v for k, v in want.items() if k != 5}


def test_a_touched_bucket_is_rewritten_and_no_other(spark, tmp_path):
    schema = spark.createDataFrame([], "k long, v string").schema
    t = VersionedTable(spark, str(tmp_path / "t"), schema, ["k"], buckets=16)
    t.upsert(spark.range(200).selectExpr("id k", "'a' v"), 0)
    t.upsert(spark.createDataFrame([(7, "b")], schema), 1)
    assert sorted(t._manifest().values()) == [0] * 15 + [1]


def test_replayed_batch_leaves_no_repeats(spark, tmp_path):
    for _ in range(2):
        L.write_batch(spark.range(5), str(tmp_path / "t"), 0)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


def test_topic_rows_have_event_ids(spark):
    msg = {"user_id": "u", "item_id": "i", "event_type": "view", "timestamp": "2024-01-01 00:00:00"}
    raw = spark.createDataFrame([(json.dumps(msg), 1, 7), (json.dumps(msg | {"event_id": 3}), 0, 8)],
                                "value string, partition int, offset long")
    assert sorted(r["event_id"] for r in L.event_messages(raw).collect()) == [3, (1 << 44) + 7]
