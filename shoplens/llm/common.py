"""Helpers shared by the training-data operators.

Texts reach numpy as Arrow batches; :func:`slices` cuts a batch so that only a
few MB of text are expanded at a time, whatever the batch holds. Everything
that is sent to all tasks (sketches, bitmaps, models) has a size fixed by a
parameter, not by the data.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.session import cut_lineage, ensure_checkpoint_dir

SLICE_BYTES = 2 << 20


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 3, is 1; an absent id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and its offsets (n + 1); null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0]:offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text",
           max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``max_bytes`` of text (one long text stays whole)."""
    for batch in batches:
        _, offs = utf8(batch.column(text))
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + max_bytes, "right")) - 1)
            yield batch.slice(lo, hi - lo)
            lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain splitmix64 constants)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_RADIX = np.uint64(0x9E3779B97F4A7C15 | 1)
_RADIX_INV = np.uint64(pow(int(_RADIX), -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOW = 12  # powers of n are products of two short tables: n >> 12 and n & 4095


def _tables(base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    def powers(start: int, n: int) -> np.ndarray:
        steps = np.full(n, np.uint64(start), np.uint64)
        steps[0] = 1
        return np.multiply.accumulate(steps)

    return powers(pow(int(base), 1 << _LOW, 1 << 64), 1 << _LOW), powers(int(base), 1 << _LOW)


_R, _INV = _tables(_RADIX), _tables(_RADIX_INV)


def _high(table: np.ndarray, n: int) -> np.ndarray:
    """The high table, longer where a text of over 16 MB needs it."""
    if n <= len(table):
        return table
    steps = np.full(n, table[1], np.uint64)
    steps[0] = 1
    return np.multiply.accumulate(steps)


def _first_powers(tables: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    rows = (n >> _LOW) + 1
    return np.multiply.outer(_high(tables[0], rows)[:rows], tables[1]).ravel()[:n]


def _powers_at(tables: tuple[np.ndarray, np.ndarray], at: np.ndarray) -> np.ndarray:
    high = _high(tables[0], (int(at.max()) >> _LOW) + 1 if len(at) else 0)
    return high[at >> _LOW] * tables[1][at & ((1 << _LOW) - 1)]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, the same wherever the span stands."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * _first_powers(_R, n), out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _powers_at(_INV, np.asarray(starts)))


def word_spans(sep: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and row of the runs without separators; runs end where a row ends."""
    n = len(sep)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    before, after = np.empty(n + 1, bool), np.empty(n + 1, bool)
    before[0], before[1:] = True, sep
    after[:-1], after[-1] = sep, True
    cut = offs[(offs > 0) & (offs < n)]
    first, last = before[:-1], after[1:]
    first[cut] = True
    last[cut - 1] = True
    starts = np.flatnonzero(~sep & first)
    ends = np.flatnonzero(~sep & last) + 1
    return starts, ends, np.searchsorted(offs, starts, "right") - 1


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: its size is then known.

    checkpoint() keeps the size estimate of the plan before it, a product over
    all joins; in a loop of joins these numbers get so long that planning them
    takes longer than the jobs.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the same label, one of its nodes, for all nodes that ``links`` connects.

    Rounds of contraction: every node points to the neighbour (or itself) that
    comes first by hash, links are rewritten to the targets, loops and repeats
    go. The order by hash keeps chains of pointers short, so a path, too,
    shrinks by a constant factor a round, and a star is gone after two. A hub
    with very many links only meets partial aggregates. Every round is
    written to the shared folder.
    """
    links = written(links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
                        .where("a <> b").distinct())

    def key(c: str) -> Column:
        return F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("v"))

    out = None
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = written(both.groupBy(F.col("a").alias("node")).agg(F.min(key("b")).alias("m"))
                         .select("node", F.least(key("node"), F.col("m"))["v"].alias("to")))
        links = written(
            links.join(to.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a")
            .join(to.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
            .select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b"))
            .where("a <> b").distinct())
        if out is None:
            out = to.select("node", F.col("to").alias("component"))
        else:
            step = to.select(F.col("node").alias("component"), "to")
            out = written(out.join(step, "component", "left")
                              .select("node", F.coalesce("to", "component").alias("component")))
    return links.select(F.col("a").alias("node"), F.col("a").alias("component")) if out is None else out
