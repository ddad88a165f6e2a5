"""Packing by cutting-stock column generation (operator 1).

A document's ids are cut into full pieces of the capacity and a rest. The
rests' lengths form a histogram of ``capacity / GRAIN`` classes: the demands of
a cutting-stock problem. A linear program over patterns (how many pieces of
each class a sequence holds) is solved by column generation; a knapsack
dynamic program over the capacity prices new patterns. Rounded-down patterns
and greedily filled ones for what remains give a schedule; the pieces of each
class, ranked, take its places. Only the histogram reaches the driver.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import cut_lineage, slices, utf8
from shoplens.llm.words import WordIds, byte_bpe, one_by_one

GRAIN = 8
SCAN_BYTES = 1 << 20  # text expanded at a time


# tokens ---------------------------------------------------------------------
def word_ids(tokenizer: str, ranks: str) -> WordIds:
    """The store of words; a word that holds the text of a special token goes to the tokenizer itself."""
    from tokenizers import Tokenizer
    full = Tokenizer.from_file(tokenizer)
    special = [t.content for t in full.get_added_tokens_decoder().values()]
    fast = byte_bpe(ranks)

    def encode(word: str) -> list[int]:
        for s in special:
            if s in word:
                return full.encode(word, add_special_tokens=False).ids
        return fast(word)

    return WordIds([one_by_one(encode)])


def pieces(docs: DataFrame, tokenizer: str, ranks: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece, with its class and its place among its partition's pieces of that class."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        words = None
        seen = np.zeros(capacity // GRAIN + 1, np.int64)
        pid = TaskContext.get().partitionId()
        for part in slices(batches, max_bytes=SCAN_BYTES):
            words = words or word_ids(tokenizer, ranks)
            ids, _, offs = words.encode(*utf8(part.column("text")))[0]
            out: list[tuple] = []
            for i, doc in enumerate(part.column("doc_id").to_pylist()):
                own = np.append(ids[offs[i]:offs[i + 1]], np.uint32(end_id)).astype("<u4")
                for start in range(0, len(own), capacity):
                    piece = own[start:start + capacity]
                    cls = -(-len(piece) // GRAIN)
                    out.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(own), pid, cls, int(seen[cls])))
                    seen[cls] += 1
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "pid", "cls", "place"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=names)

    return docs.select("doc_id", "text").mapInArrow(
        cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, pid long, cls long, place long")


# cutting stock --------------------------------------------------------------
def knapsack(values: np.ndarray, sizes: np.ndarray, room: int, most: np.ndarray | None = None) -> np.ndarray:
    """Counts of each size, of the largest total value that fits (``most``: bounds on the counts)."""
    if most is None:
        best, choice = np.zeros(room + 1), np.full(room + 1, -1)
        for c in range(1, room + 1):
            n = np.searchsorted(sizes, c, "right")
            best[c] = best[c - 1]
            if n:
                got = best[c - sizes[:n]] + values[:n]
                j = int(got.argmax())
                if got[j] > best[c] + 1e-12:
                    best[c], choice[c] = got[j], j
        out, c = np.zeros(len(sizes), np.int64), room
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                out[choice[c]] += 1
                c -= sizes[choice[c]]
        return out
    best = np.zeros(room + 1)
    took = np.zeros((len(sizes), room + 1), np.int64)
    for j in np.flatnonzero(most):
        s, v = int(sizes[j]), values[j]
        n, p = min(int(most[j]), room // s), 1
        cur = np.zeros(room + 1, np.int64)
        while n > 0:  # bundles of 1, 2, 4, ... make any count up to the bound
            p = min(p, n)
            if p * s <= room:
                got = best[:room + 1 - p * s] + p * v
                better = got > best[p * s:] + 1e-12
                moved = cur[:room + 1 - p * s] + p
                best[p * s:] = np.where(better, got, best[p * s:])
                cur[p * s:] = np.where(better, moved, cur[p * s:])
            n, p = n - p, p * 2
        took[j] = cur
    out, c = np.zeros(len(sizes), np.int64), room
    for j in range(len(sizes) - 1, -1, -1):
        out[j] = took[j, c]
        c -= out[j] * sizes[j]
    return out


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row exchanges, in plain numpy: no thread pool beside the driver's JVM."""
    m = len(a)
    work = np.hstack([a.astype(float), np.eye(m)])
    for c in range(m):
        p = c + int(np.abs(work[c:, c]).argmax())
        work[[c, p]] = work[[p, c]]
        work[c] /= work[c, c]
        factor = work[:, c].copy()
        factor[c] = 0
        rows = np.flatnonzero(factor)
        work[rows] -= factor[rows, None] * work[c]
    return work[:, m:]


def _first_basis(sizes: np.ndarray, demand: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns filled greedily around the largest size left, each used until a size runs out.

    The patterns, in the order in which sizes run out, form a triangular basis.
    """
    m = len(sizes)
    basis, x = np.diag((room // sizes).astype(float)), np.zeros(m)
    left = demand.astype(float)
    while (left > 1e-9).any():
        have = np.flatnonzero(left > 1e-9)
        big = have[-1]
        pattern = np.zeros(m)
        pattern[have] = knapsack(sizes[have] * (1 + 1e-7 * sizes[have]), sizes[have], room - int(sizes[big]))
        pattern[big] += 1
        inside = np.flatnonzero(pattern)
        times = (left[inside] / pattern[inside]).min()
        left[inside] -= times * pattern[inside]
        gone = inside[left[inside] <= 1e-9]
        left[gone] = 0
        basis[:, gone[0]], x[gone[0]] = pattern, times
    return basis, x


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-3,
                  rounds: int = 3000) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is used; together they hold ``demand`` exactly.

    Revised simplex with the basis' inverse. Prices are smoothed towards the
    best feasible dual found (first: size over room), which keeps the pricing
    from swinging; it stops when that dual's bound shows that no set of
    patterns is better by more than ``gap``.
    """
    m = len(sizes)
    if not m:
        return []
    basis, x = _first_basis(sizes, demand, room)
    inv = _inverse(basis)
    center = sizes / room
    bound = float((demand * center).sum())
    for step in range(rounds):
        if x.sum() <= bound * (1 + gap):
            break
        dual = inv.sum(0)
        for weight in (0.9, 0.5, 0.0):
            smooth = weight * center + (1 - weight) * dual
            new = knapsack(smooth, sizes, room).astype(float)
            worth = max(float((smooth * new).sum()), 1e-12)
            if (demand * smooth).sum() / worth > bound:
                bound, center = float((demand * smooth).sum() / worth), smooth / worth
            if (dual * new).sum() > 1 + 1e-9:
                break
        else:
            break
        d = (inv * new).sum(1)
        ok = d > 1e-9
        ratio = np.where(ok, x / np.where(ok, d, 1), np.inf)
        r = int(ratio.argmin())
        theta = ratio[r]
        x = np.maximum(x - theta * d, 0)
        x[r] = theta
        basis[:, r] = new
        inv[r] /= d[r]
        others = d.copy()
        others[r] = 0
        inv -= others[:, None] * inv[r]
        if step % 100 == 99:
            inv = _inverse(basis)
            x = np.maximum((inv * demand).sum(1), 0)
    use = np.floor(x + 1e-9).astype(np.int64)
    out = [(basis[:, j].astype(np.int64), int(use[j])) for j in np.flatnonzero(use)]
    left = demand - sum((p * n for p, n in out), np.zeros(m, np.int64))
    for j in np.flatnonzero(left < 0):  # rounding noise only: give back whole patterns
        for i, (p, n) in enumerate(out):
            while left[j] < 0 and p[j] and n:
                n -= 1
                left += p
            out[i] = (p, n)
    while left.any():
        big = int(np.flatnonzero(left)[-1])
        pattern = np.zeros(m, np.int64)
        pattern[big] = 1
        rest = left - pattern
        pattern += knapsack(sizes.astype(float), sizes, room - int(sizes[big]), rest)
        times = max(1, int((left[pattern > 0] // pattern[pattern > 0]).min()))
        out.append((pattern, times))
        left = left - times * pattern
    return [(p, n) for p, n in out if n]


def pack(docs: DataFrame, tokenizer: str | None = None, ranks: str | None = None, capacity: int = 2048,
         end_id: int = 1) -> DataFrame:
    """Pieces of all documents and where they stand in sequences of at most ``capacity`` ids.

    doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null and
    empty texts have the end id alone. Repeated rows and null doc_ids are
    packed as rows of their own; other columns are ignored; an empty table
    gives an empty result. ``tokenizer`` and ``ranks`` are paths of the same
    vocabulary for the two readers.
    """
    import public_tokenizers as P
    spark = docs.sparkSession
    rows = cut_lineage(pieces(docs, tokenizer or P.path("byte_bpe_50k.json"),
                              ranks or P.path("byte_bpe_50k.tiktoken"), capacity, end_id))
    counts = rows.groupBy("pid", "cls").agg(F.count("*").alias("n"))
    before = Window.partitionBy("cls").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    demand = {r["cls"]: r["n"] for r in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect()}
    sizes = np.array(sorted(demand), np.int64)
    plan = cutting_stock(sizes, np.array([demand[s] for s in sizes], np.int64), capacity // GRAIN)
    seq, filled, places = 0, dict.fromkeys(demand, 0), []
    for pattern, times in plan:
        for j in np.flatnonzero(pattern):
            cls, per = int(sizes[j]), int(pattern[j])
            places.append((cls, filled[cls], filled[cls] + per * times, per, seq))
            filled[cls] += per * times
        seq += times
    # one row per class and pattern: bounded by the classes, not by the documents
    schedule = spark.createDataFrame(places, "cls long, lo long, hi long, per long, first long")
    ranked = rows.join(bases, ["pid", "cls"]).withColumn("rank", F.col("base") + F.col("place"))
    placed = ranked.join(F.broadcast(schedule), "cls").where("rank >= lo and rank < hi") \
        .withColumn("sequence_id", F.expr("first + (rank - lo) div per"))
    inside = Window.partitionBy("sequence_id").orderBy(F.desc("cls"), "rank") \
        .rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                         F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"))
