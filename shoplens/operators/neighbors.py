"""Exact nearest rows by cosine between sparse rows, without comparing all with all.

Rows are in long form (key, feature, value). Keys with identical rows form a
class that is searched once; of a class only as many keys as a list can hold
are ever candidates. So a feature that very many one-feature rows share costs
as much as one row.

Class rows are dealt to blocks. A block receives the inverted lists of the
features that it needs, cut into slices by candidate so that no task holds a
list as a whole; numpy adds up the products of one block and slice. Where the
lists needed by all blocks are a small multiple of the data, every feature is
sent and the sums are the dot products.

Beyond that the search is pruned by remaining norms: the lists of a row's
rarest features, a bounded number of entries, give some near rows and with them
a similarity that a neighbour has to reach. A row's most frequent features whose
norm together stays below it can't make a neighbour on their own, so their lists
are not sent for that row. Blocks then hold rows whose most frequent needed
feature is the same or near in frequency, so that a frequent list goes to few
blocks. What a feature that was not sent may still add is bounded by the
remaining norm, and only pairs that can make the list are completed by a join.

Where features are shared by few rows on the average (many items, each bought
by some users), or rows hold a good part of all features, lists would be sent
to almost every block. Then every block of whole rows meets every other one:
blocks are written once, packed, and a task of a query block reads them one
after the other from the shared folder, keeping each row's best so far. So the
data is on disk once however many blocks there are, and no more than k rows a
key leave a task. Of two blocks only the products of shared features are formed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.operators.analytics import global_row_number
from shoplens.session import bound_batches, cut_lineage

BLOCK = 4096             # rows of a block
CHUNK = 2048             # candidates whose scores a task holds at a time
SLICE_ENTRIES = 2_000_000  # list entries of a block's slice, about
SEED_ENTRIES = 256       # list entries looked at for a row's first bound
PRUNE_FROM = 8           # lists to send, as a multiple of the data, from which pruning pays
DENSE = 64               # a product of a matrix costs about this part of one that is looked up
ROUNDING = 1e-9
SPARSE = 4096            # products of shared features, as a multiple of the data, up to which whole blocks meet
TILE_ENTRIES = 2_000_000  # entries of such a block, about
EXPANDED = 2_000_000     # products that a tile holds at a time


def _products(qrow, qf, qv, crow, cf, cv, nq: int, nc: int, features: int) -> np.ndarray:
    """Q·Cᵀ of sparse rows given as (row, feature, value) triples.

    The cheaper of two exact ways: expand the products of each shared feature,
    or multiply dense chunks of features where rows are dense.
    """
    out = np.zeros((nq, nc))
    by_q, by_c = np.argsort(qf, kind="stable"), np.argsort(cf, kind="stable")
    n_q, n_c = (np.bincount(f, minlength=features) for f in (qf, cf))
    pairs = n_q * n_c
    total = int(pairs.sum())
    if not total:
        return out
    shared = np.flatnonzero(pairs)
    if total > nq * nc * len(shared) // DENSE:
        place = np.full(features, -1)
        place[shared] = np.arange(len(shared))
        qf, cf = place[qf], place[cf]
        step = max(1, 16_000_000 // (nq + nc))
        for lo in range(0, len(shared), step):
            width = min(step, len(shared) - lo)
            q_in, c_in = (qf >= lo) & (qf < lo + width), (cf >= lo) & (cf < lo + width)
            q, c = np.zeros((nq, width)), np.zeros((nc, width))
            q[qrow[q_in], qf[q_in] - lo] = qv[q_in]
            c[crow[c_in], cf[c_in] - lo] = cv[c_in]
            out += q @ c.T
        return out
    q_at, c_at = np.cumsum(n_q) - n_q, np.cumsum(n_c) - n_c
    upto = np.cumsum(pairs[shared])
    flat = out.ravel()
    lo = 0
    while lo < len(shared):
        done = int(upto[lo - 1]) if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + 4_000_000, "right")))
        f = np.repeat(shared[lo:hi], pairs[shared[lo:hi]])
        at = np.arange(len(f)) - np.repeat(upto[lo:hi] - pairs[shared[lo:hi]] - done, pairs[shared[lo:hi]])
        q, c = by_q[q_at[f] + at // n_c[f]], by_c[c_at[f] + at % n_c[f]]
        flat += np.bincount(qrow[q] * nc + crow[c], weights=qv[q] * cv[c], minlength=nq * nc)
        lo = hi
    return out


def _best(scores: np.ndarray, slack: np.ndarray, least: np.ndarray, rank: np.ndarray, k: int, listed: bool = False
          ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, place in the row) of what may be among a row's k best: exact rows give k, others all within their slack.

    ``listed``: all rows are exact and ``least`` is the score of a k-th row already found.
    """
    n = scores.shape[1]
    if listed:
        qi, ci = np.nonzero(scores >= np.maximum(least, np.nextafter(0, 1))[:, None])
    else:
        kth = np.partition(scores, n - k, axis=1)[:, n - k] if k < n else np.full(len(scores), -np.inf)
        floor = np.maximum(least, kth) - slack - np.where(slack > 0, ROUNDING, 0)
        qi, ci = np.nonzero((scores >= floor[:, None]) & (scores + slack[:, None] > 0))
    order = np.lexsort((rank[ci], -scores[qi, ci], qi))
    qi, ci = qi[order], ci[order]
    if not len(qi):
        return qi, ci, qi
    first = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
    place = np.arange(len(qi)) - np.repeat(first, np.diff(np.r_[first, len(qi)]))
    keep = (place < k) | (slack[qi] > 0)
    return qi[keep], ci[keep], place[keep]


def _codes(column) -> tuple[np.ndarray, pa.Array]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    coded = column.dictionary_encode()
    return coded.indices.to_numpy(), coded.dictionary


def _search(queries: DataFrame, lists: DataFrame, k: int) -> DataFrame:
    """(q, c, dot, low, slack) of each (block, slice): dot over the sent features, low <= similarity <= low + slack."""
    kind = queries.schema["u"].dataType
    schema = T.StructType([T.StructField("q", kind), T.StructField("c", kind), T.StructField("dot", T.DoubleType()),
                           T.StructField("low", T.DoubleType()), T.StructField("slack", T.DoubleType())])

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            qrow, qkeys = _codes(left["u"])
            crow, ckeys = _codes(right["v"])
            feature, names = _codes(pa.chunked_array(left["f"].chunks + right["f"].chunks))
            qf, cf = feature[:len(qrow)], feature[len(qrow):]
            qv, cv = left["w"].to_numpy(), right["w"].to_numpy()
            norm_q, norm_c, least = np.zeros(len(qkeys)), np.zeros(len(ckeys)), np.zeros(len(qkeys))
            norm_q[qrow], norm_c[crow], least[qrow] = left["norm"].to_numpy(), right["norm"].to_numpy(), left["least"].to_numpy()
            sent = left["sent"].to_numpy(zero_copy_only=False)
            slack = np.sqrt(np.bincount(qrow, np.where(sent, 0.0, qv * qv), len(qkeys))) / norm_q
            rank = np.empty(len(ckeys), np.int64)
            rank[pc.array_sort_indices(ckeys).to_numpy()] = np.arange(len(ckeys))
            order = np.argsort(crow, kind="stable")
            upto = np.searchsorted(crow[order], np.arange(0, len(ckeys) + CHUNK, CHUNK))
            exact, listed, best = not slack.any(), False, np.full((len(qkeys), k), -np.inf)
            for j, (s, e) in enumerate(zip(upto[:-1], upto[1:])):
                own, at = order[s:e], slice(j * CHUNK, min((j + 1) * CHUNK, len(ckeys)))
                nc = at.stop - at.start
                if nc <= 0:
                    continue
                dot = _products(qrow[sent], qf[sent], qv[sent], crow[own] - at.start, cf[own], cv[own], len(qkeys), nc, len(names))
                low = norm_q[:, None] * norm_c[None, at]
                np.divide(dot, low, out=low)
                qi, ci, place = _best(low, slack, least, rank[at], k, listed)
                if exact:  # later chunks need only what reaches the k-th row so far
                    own_best = np.full((len(qkeys), k), -np.inf)
                    own_best[qi, place] = low[qi, ci]
                    best = -np.partition(-np.concatenate([best, own_best], axis=1), k - 1, axis=1)[:, :k]
                    least = np.maximum(least, best.min(axis=1))
                    listed = bool(np.isfinite(best).all())
                parts.append(pa.table({"q": qkeys.take(pa.array(qi)), "c": ckeys.take(pa.array(ci + at.start)),
                                       "dot": dot[qi, ci], "low": low[qi, ci], "slack": slack[qi]}))
        keys = left["u"].slice(0, 0).combine_chunks() if left.num_rows else right["v"].slice(0, 0).combine_chunks()
        empty = pa.table({"q": keys, "c": keys, "dot": pa.array([], pa.float64()), "low": pa.array([], pa.float64()),
                          "slack": pa.array([], pa.float64())})
        return pa.concat_tables(parts) if parts else empty

    return queries.groupBy("block", "slice").cogroup(lists.groupBy("block", "slice")).applyInArrow(kernel, schema)


class _Block:
    """Rows of a block, keys ascending, with their entries by feature and row: names and times of the features, row and value."""

    def __init__(self, keys: np.ndarray, names: np.ndarray, times: np.ndarray, row: np.ndarray, w: np.ndarray) -> None:
        self.keys, self.names, self.times, self.row, self.w = keys, names, times, row, w
        self.start = np.cumsum(times) - times
        self.norm = np.sqrt(np.bincount(row, w * w, len(keys)))

    @staticmethod
    def of(u: np.ndarray, f: np.ndarray, w: np.ndarray) -> "_Block":
        keys, row = np.unique(u, return_inverse=True)
        order = np.lexsort((row, f))
        names, times = np.unique(f, return_counts=True)
        return _Block(keys, names, times, row[order].astype(np.int64), w[order])

    def pack(self) -> bytes:
        parts = [np.array([len(self.keys), len(self.names), len(self.row)]), self.keys, self.names, self.times, self.row]
        raw = b"".join(np.ascontiguousarray(x, np.int64).tobytes() for x in parts) + np.ascontiguousarray(self.w, np.float64).tobytes()
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    @staticmethod
    def unpack(data: bytes) -> "_Block":
        raw = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd")
        counts = np.frombuffer(raw, np.int64, 3)
        at, arrays = 24, []
        for n, kind in zip((*counts[:2], counts[1], counts[2], counts[2]), (np.int64,) * 4 + (np.float64,)):
            arrays.append(np.frombuffer(raw, kind, int(n), at))
            at += int(n) * 8
        return _Block(*arrays)

    def by_row(self) -> None:
        """Row, code of the feature and value of the entries, features in order within a row."""
        order = np.argsort(self.row, kind="stable")
        code = np.repeat(np.arange(len(self.names)), self.times)
        self.r_row, self.r_code, self.r_w = self.row[order], code[order], self.w[order]
        self.r_upto = np.searchsorted(self.r_row, np.arange(len(self.keys) + 1))


def _tile_best(q: _Block, c: _Block, k: int, best: Callable[[], np.ndarray], expanded: int = EXPANDED
               ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, candidate row, similarity) by parts: of each query row its k best in c that reach ``best``() so far.

    The cheaper of two exact ways, as in :func:`_products`.
    """
    at = np.minimum(np.searchsorted(c.names, q.names), max(len(c.names) - 1, 0))
    met = c.names[at] == q.names if len(c.names) else np.zeros(len(q.names), bool)
    times = np.where(met, c.times[at], 0) if len(c.names) else np.zeros(len(q.names), np.int64)
    total, shared = int((q.times * times).sum()), int(met.sum())
    if not total:
        return
    nc = len(c.keys)
    if total > len(q.keys) * nc * shared // DENSE:
        place = np.full(len(c.names), -1)
        place[at[met]] = np.arange(shared)
        own = np.where(met, place[at], -1)
        c.by_row()
        for lo in range(0, len(q.keys), BLOCK):
            n = min(BLOCK, len(q.keys) - lo)
            part = slice(q.r_upto[lo], q.r_upto[lo + n])
            qf = own[q.r_code[part]]
            qrow, qv, qf = q.r_row[part][qf >= 0] - lo, q.r_w[part][qf >= 0], qf[qf >= 0]
            for first in range(0, nc, CHUNK):
                m = min(CHUNK, nc - first)
                entries = slice(c.r_upto[first], c.r_upto[first + m])
                cf = place[c.r_code[entries]]
                crow, cv, cf = c.r_row[entries][cf >= 0] - first, c.r_w[entries][cf >= 0], cf[cf >= 0]
                dot = _products(qrow, qf, qv, crow, cf, cv, n, m, shared)
                low = q.norm[lo:lo + n, None] * c.norm[None, first:first + m]
                np.divide(dot, low, out=low)
                least = best()[lo:lo + n]
                qi, ci, _ = _best(low, np.zeros(n), least, np.arange(m), k, bool(np.isfinite(least).all()))
                yield qi + lo, ci + first, low[qi, ci]
        return
    have = times[q.r_code]
    keep = np.flatnonzero(have)
    qrow, qv, n, start = q.r_row[keep], q.r_w[keep], have[keep], c.start[at[q.r_code[keep]]]
    upto = np.cumsum(n)
    ends = np.searchsorted(qrow, np.arange(len(q.keys)), "right")  # entries up to the end of each row
    lo = 0
    while lo < len(qrow):
        done = int(upto[lo - 1]) if lo else 0
        most = int(np.searchsorted(upto, done + expanded, "right"))
        row = max(int(np.searchsorted(ends, most, "right")) - 1, int(qrow[lo]))  # whole rows, one at least
        hi = int(ends[row])
        entry = np.repeat(np.arange(lo, hi), n[lo:hi])
        other = np.repeat(start[lo:hi] - (upto[lo:hi] - n[lo:hi] - done), n[lo:hi]) + np.arange(len(entry))
        pair = qrow[entry] * nc + c.row[other]
        by_pair = np.argsort(pair, kind="stable")
        pair = pair[by_pair]
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        dot = np.add.reduceat((qv[entry] * c.w[other])[by_pair], first)
        qi, ci = np.divmod(pair[first], nc)
        low = dot / (q.norm[qi] * c.norm[ci])
        reach = np.flatnonzero((low > 0) & (low >= best()[qi]))
        reach = reach[np.lexsort((ci[reach], -low[reach], qi[reach]))]
        qi, ci, low = qi[reach], ci[reach], low[reach]
        if len(qi):
            head = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
            listed = np.arange(len(qi)) - np.repeat(head, np.diff(np.r_[head, len(qi)])) < k
            yield qi[listed], ci[listed], low[listed]
        lo = hi


class _Lists:
    """Each query row's k best so far: score and key, ties by key."""

    def __init__(self, q: _Block, k: int) -> None:
        q.by_row()
        self.q, self.k = q, k
        self.low, self.key = np.full((len(q.keys), k), -np.inf), np.full((len(q.keys), k), np.iinfo(np.int64).max)

    def least(self) -> np.ndarray:
        return self.low[:, -1]

    def add(self, qi: np.ndarray, key: np.ndarray, low: np.ndarray) -> None:
        rows, at = np.unique(qi, return_inverse=True)
        at = np.r_[np.repeat(np.arange(len(rows)), self.k), at]
        low, key = np.r_[self.low[rows].ravel(), low], np.r_[self.key[rows].ravel(), key]
        order = np.lexsort((key, -low, at))
        counts = np.bincount(at, minlength=len(rows))
        first = np.cumsum(counts) - counts
        take = order[(first[:, None] + np.arange(self.k)[None, :])]
        self.low[rows], self.key[rows] = low[take], key[take]

    def meet(self, c: _Block) -> None:
        for qi, ci, low in _tile_best(self.q, c, self.k, self.least):
            self.add(qi, c.keys[ci], low)

    def rows(self) -> pa.RecordBatch:
        qi, place = np.nonzero(self.low > 0)
        return pa.RecordBatch.from_arrays([pa.array(self.q.keys[qi]), pa.array(self.key[qi, place]), pa.array(self.low[qi, place])],
                                          names=["q", "c", "sim"])


def _tile(left: pa.Table, right: pa.Table, k: int, expanded: int = EXPANDED) -> pa.Table:
    """(q, c, low): of each row of ``left`` the k best of ``right``. Rows (u, norm, fs, ws) have u ascending."""
    def block(table: pa.Table) -> _Block:
        lists = table["fs"].combine_chunks()
        row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        out = _Block.of(row, lists.flatten().to_numpy(zero_copy_only=False), table["ws"].combine_chunks().flatten().to_numpy(zero_copy_only=False))
        out.by_row()
        return out

    q, c = block(left), block(right)
    parts = [pa.table({"q": left["u"].take(pa.array(q.keys[qi])), "c": right["u"].take(pa.array(c.keys[ci])), "low": low})
             for qi, ci, low in _tile_best(q, c, k, lambda: np.full(len(q.keys), -np.inf), expanded)]
    return pa.concat_tables(parts) if parts else pa.table({"q": left["u"].slice(0, 0), "c": right["u"].slice(0, 0), "low": pa.array([], pa.float64())})


def _streamed(rows: DataFrame, features: DataFrame, k: int, entries: int, n_rows: int, tile_entries: int) -> DataFrame:
    """(q, c, sim): each row's k best, by blocks that are read one after the other. rows: u (a number), f, w; features: f, id."""
    spark = rows.sparkSession
    blocks = max(1, -(-entries // tile_entries), min(spark.sparkContext.defaultParallelism, n_rows // 64))
    coded = rows.join(features.select("f", "id"), "f").select(F.pmod("u", F.lit(blocks)).alias("block"), "u", "id", "w")

    def pack(table: pa.Table) -> pa.Table:
        u, f, w = (table[c].to_numpy() for c in ("u", "id", "w"))
        return pa.table({"block": table["block"].slice(0, 1), "data": pa.array([_Block.of(u, f, w).pack()], pa.binary())})

    packed = cut_lineage(coded.groupBy("block").applyInArrow(pack, "block long, data binary"))
    # the right side's rows are held by their task, the left side's are read past them: one partition, which every task reads
    own = packed.repartitionByRange(blocks, "block").select(F.col("block").alias("q_block"), F.col("data").alias("q_data"))
    met = packed.coalesce(1).select(F.col("data").alias("c_data")).hint("shuffle_replicate_nl").crossJoin(own.hint("shuffle_replicate_nl"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: dict[int, _Lists] = {}
        for batch in batches:
            names = batch.column("q_block").to_pylist()
            for i, name in enumerate(names):
                if name not in lists:
                    lists[name] = _Lists(_Block.unpack(batch.column("q_data")[i].as_py()), k)
                lists[name].meet(_Block.unpack(batch.column("c_data")[i].as_py()))
        for found in lists.values():
            yield found.rows()

    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(size, None)
    bound_batches(spark)  # a packed block is one row: none waits for another
    try:
        return cut_lineage(met.mapInArrow(search, "q long, c long, sim double"))
    finally:
        spark.conf.unset(size) if before is None else spark.conf.set(size, before)


def _pair_dots(pairs: DataFrame, q_rows: DataFrame, rows: DataFrame) -> DataFrame:
    """(q, c, more): sum of products over the features of ``q_rows`` (u, f, w) that c has, too."""
    own = pairs.select("q", "c").join(q_rows.select(F.col("u").alias("q"), "f", F.col("w").alias("qw")), "q")
    return own.join(rows.select(F.col("u").alias("c"), "f", F.col("w").alias("cw")), ["c", "f"]) \
        .groupBy("q", "c").agg(F.sum(F.col("qw") * F.col("cw")).alias("more"))


def _least_similarity(rows: DataFrame, k: int, seed_entries: int) -> DataFrame:
    """(u, least): the k-th best similarity among rows that share a row's rarest features, less a rounding margin."""
    w = Window.partitionBy("u").orderBy("df", "f").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rare = rows.withColumn("_sum", F.sum("df").over(w)).where(F.col("_sum") <= seed_entries)
    part = rare.select(F.col("u").alias("q"), "f", F.col("w").alias("qw"), F.col("norm").alias("qn")) \
        .join(rows.select(F.col("u").alias("c"), "f", F.col("w").alias("cw"), F.col("norm").alias("cn")), "f") \
        .groupBy("q", "c").agg(F.sum(F.col("qw") * F.col("cw") / (F.col("qn") * F.col("cn"))).alias("part"),
                               F.first("qn").alias("qn"), F.first("cn").alias("cn"))
    best = Window.partitionBy("q").orderBy(F.desc("part"), "c")
    seeds = part.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= 2 * k).drop("_r", "part")
    seeds = cut_lineage(seeds)
    full = seeds.join(_pair_dots(seeds, rows, rows), ["q", "c"]).withColumn("sim", F.col("more") / (F.col("qn") * F.col("cn")))
    kth = Window.partitionBy("q").orderBy(F.desc("sim"))
    return full.withColumn("_r", F.row_number().over(kth)).where(F.col("_r") == k) \
        .select(F.col("q").alias("u"), (F.col("sim") - ROUNDING).alias("least"))


def _class_search(rows: DataFrame, n_rows: int, k: int, prune: bool | None, block: int, slice_entries: int, seed_entries: int,
                  tile_entries: int = TILE_ENTRIES) -> DataFrame:
    """(q, c, sim): of each row the k most similar rows, itself included, ties by key. rows: u (a number), f, w, norm."""
    spark = rows.sparkSession
    features = cut_lineage(global_row_number(rows.groupBy("f").agg(F.count("*").alias("df")), [F.col("f")], "id"))
    entries, n_features, products = features.agg(F.coalesce(F.sum("df"), F.lit(0)), F.count("*"),
                                                 F.coalesce(F.sum(F.col("df").cast("double") * F.col("df")), F.lit(0.0))).first()
    by_low = Window.partitionBy("q").orderBy(F.desc("low"), "c")
    if prune is None and (products <= SPARSE * entries or n_rows * n_rows * n_features <= DENSE * products):
        return _streamed(rows.select("u", "f", "w"), features, k, entries, n_rows, tile_entries)
    lowest = rows.agg(F.min("w")).first()[0]
    rows = cut_lineage(rows.join(features.select("f", "df"), "f"))
    blocks = max(1, -(-n_rows // block), min(spark.sparkContext.defaultParallelism, n_rows // 64))
    blocked = rows.withColumn("block", F.pmod(F.xxhash64("u"), F.lit(blocks)))
    # list entries to send if nothing is pruned, in all and to the block that needs most
    to_send, largest = blocked.select("block", "f", "df").distinct().groupBy("block").agg(F.sum("df").alias("n")) \
        .agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    if prune is None:
        prune = to_send > PRUNE_FROM * entries
    if prune and entries and lowest > 0:
        least = cut_lineage(_least_similarity(rows, k, seed_entries))
        w = Window.partitionBy("u").orderBy(F.desc("df"), F.desc("f")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        mass = F.sum(F.col("w") * F.col("w") / (F.col("norm") * F.col("norm"))).over(w)
        marked = rows.join(least, "u", "left").withColumn("least", F.coalesce("least", F.lit(0.0))) \
            .withColumn("needed", mass >= F.col("least") * F.col("least"))
        # rows with the same most frequent needed feature stand together
        hottest = marked.where("needed").groupBy("u").agg(F.max(F.struct("df", "f")).alias("h"))
        placed = global_row_number(hottest, [F.desc("h.df"), F.col("h.f"), F.col("u")], "_n") \
            .select("u", F.floor((F.col("_n") - 1) / block).alias("block"))
        queries = cut_lineage(marked.join(placed, "u"))
        need = cut_lineage(queries.where("needed").select("block", "f").distinct())
        queries = queries.join(need.withColumn("_s", F.lit(True)), ["block", "f"], "left") \
            .withColumn("sent", F.coalesce("_s", F.lit(False))).drop("_s", "needed")
        queries = cut_lineage(queries)
        sizes = need.join(rows.select("f", "df").distinct(), "f").groupBy("block").agg(F.sum("df").alias("n"))
        largest = sizes.agg(F.max("n")).first()[0] or 0
    else:
        queries = blocked.withColumn("least", F.lit(0.0)).withColumn("sent", F.lit(True))
        need = blocked.select("block", "f").distinct()
    slices = max(1, -(-largest // slice_entries))
    lists = rows.select("f", F.col("u").alias("v"), "w", "norm", F.pmod(F.xxhash64("u"), F.lit(slices)).alias("slice")) \
        .join(need, "f").select(*[F.col(c).alias(c) for c in ("block", "slice", "f", "v", "w", "norm")])
    sliced = queries.select("block", "u", "f", "w", "norm", "least", "sent", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))
                                                                                       .cast("array<long>")).alias("slice"))
    found = _search(sliced, lists, k)
    if not prune or not entries or lowest <= 0:
        out = found.select("q", "c", F.col("low").alias("sim"), "low")
    else:
        found = cut_lineage(found)
        kth = found.withColumn("_r", F.row_number().over(by_low)).where(F.col("_r") == k).select("q", F.col("low").alias("kth"))
        open_ = found.where("slack > 0").join(kth, "q", "left") \
            .where(F.col("low") + F.col("slack") + ROUNDING >= F.coalesce("kth", F.lit(0.0)))
        norms = rows.select("u", "norm").distinct()
        done = open_.join(_pair_dots(open_, queries.where(~F.col("sent")), rows), ["q", "c"], "left") \
            .join(norms.select(F.col("u").alias("q"), F.col("norm").alias("qn")), "q") \
            .join(norms.select(F.col("u").alias("c"), F.col("norm").alias("cn")), "c") \
            .select("q", "c", ((F.col("dot") + F.coalesce("more", F.lit(0.0))) / (F.col("qn") * F.col("cn"))).alias("low"))
        out = found.where("slack = 0").select("q", "c", "low").unionByName(done).withColumn("sim", F.col("low"))
    return out.where("sim > 0").withColumn("_r", F.row_number().over(by_low)).where(F.col("_r") <= k).select("q", "c", "sim")


def cosine_neighbors(matrix: DataFrame, k: int, *, key: str = "user_id", feature: str = "item_id", value: str = "score",
                     prune: bool | None = None, block: int = BLOCK, slice_entries: int = SLICE_ENTRIES,
                     seed_entries: int = SEED_ENTRIES, tile_entries: int = TILE_ENTRIES,
                     written: bool = False) -> DataFrame:
    """(q_key, c_key, score, rank): of each key the k other keys of the highest positive cosine, ties by key.

    ``matrix`` has one row for each (key, feature); zeros and nulls are no
    entries. Cosine = dot / (|q| * |c|), evaluated in that order, so equal
    inputs give equal scores. ``prune`` forces (or forbids) the pruned search;
    rows with negative values are never pruned. Left open, sparse overlaps and
    dense rows are searched by blocks of whole rows, ``tile_entries`` at a time.
    ``written``: the matrix is materialised, so it needs no copy.
    """
    m = matrix.select(F.col(key).alias("u"), F.col(feature).alias("f"), F.col(value).cast("double").alias("w")) \
        .where("u is not null and f is not null and w <> 0")
    m = m if written else cut_lineage(m)
    per_key = m.groupBy("u").agg(F.sum(F.xxhash64("f", "w").cast("decimal(38,0)")).alias("h"),
                                 F.sum(F.hash("w", "f")).alias("h2"), F.count("*").alias("n"),
                                 F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    classes = Window.partitionBy("h", "h2", "n").orderBy("u")
    # a list, with the key itself in it, holds k + 1 keys: no class needs more members
    members = cut_lineage(per_key.withColumn("_r", F.row_number().over(classes)).where(F.col("_r") <= k + 1))
    # a class is known by a number, in the order of the first key
    heads = cut_lineage(global_row_number(members.where("_r = 1").select("u", "norm", "h", "h2", "n"), [F.col("u")], "id"))
    of_class = cut_lineage(per_key.drop("norm").join(heads.select("h", "h2", "n", "id"), ["h", "h2", "n"]).select("u", "id"))
    rows = cut_lineage(m.join(heads.select("u", "norm", "id"), "u").select(F.col("id").alias("u"), "f", "w", "norm"))
    near = _class_search(rows, heads.count(), k + 1, prune, block, slice_entries, seed_entries, tile_entries)
    listed = members.select("u", "h", "h2", "n").join(heads.select("h", "h2", "n", F.col("id").alias("c")), ["h", "h2", "n"]) \
        .select("c", F.col("u").alias("c_key"))
    by_sim = Window.partitionBy("q").orderBy(F.desc("sim"), "c_key")
    expanded = near.join(listed, "c").withColumn("_r", F.row_number().over(by_sim)).where(F.col("_r") <= k + 1)
    w = Window.partitionBy("q_key").orderBy(F.desc("score"), "c_key")
    return of_class.select(F.col("u").alias("q_key"), F.col("id").alias("q")).join(expanded, "q") \
        .where("q_key <> c_key").select("q_key", "c_key", F.col("sim").alias("score")) \
        .withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
