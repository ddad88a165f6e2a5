"""Exact top-n inner products by cells with distance bounds.

Candidates are dealt to cells round pivots (a bounded number of candidates,
first by hash); a cell's radius is the largest distance of a member to its
pivot, so that for every member x and query q

    q.x = q.p + q.(x - p) <= q.p + |q| * radius.

First pass: every query visits the cells with the largest q.p until they hold
twice the rows it needs; its n-th best score there is a lower bound. Second
pass: it visits only those other cells whose upper bound reaches that score.
Neighbouring cells travel together, as one tile of candidates: a query's vector
is sent once to each tile in which it has a cell to visit, a tile's members to
the sides of the query table that visit it, and a task forms scores only for
the queries and cells that meet, some rows at a time. So vectors are sent as
often as there are tiles, whose size is bounded by memory, not by cells. Cells
larger than a tile are dealt out by hash, so no group exceeds one tile of
candidates and one side of queries, however skewed the vectors are.

The caller's filters work inside the search, so a list is short only where
the rows run out: ``depth`` asks for more rows for single queries (for those
they will drop later, such as purchases), ``q_limit`` and ``c_value`` leave out
candidates whose value is above the query's limit (a budget).

Scores are formed twice: by matrix products to find the rows that matter, with
a margin for rounding, then pair by pair in one fixed order of summation, so
they are the same whatever the blocks are, and equal vectors tie exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.session import cut_lineage

CELL = 4096         # candidates of a block, and of a cell as long as MAX_PIVOTS cells suffice
MAX_PIVOTS = 2048   # pivots are sent to all tasks: at most this many vectors
SIDE = 4096         # queries of a side
TILE = 1 << 23      # vector elements of a tile's candidates, and of a side's queries, about
ROWS = 512          # queries whose scores a task forms at a time
PAIRS = 1 << 18     # pairs whose exact scores a task forms at a time
ROUNDING = 1e-12    # relative error allowed for sums in different orders


def matrix(column) -> np.ndarray:
    """(rows, dimensions) of a column of equally long arrays; null elements are NaN."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(lists)
    flat = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(n, -1)) if n and len(flat) else np.zeros((n, 0))


def _pair_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * b).sum(axis=1)


def _scores_at(q: np.ndarray, c: np.ndarray, qi: np.ndarray, ci: np.ndarray) -> np.ndarray:
    """:func:`_pair_scores` of rows ``qi`` of q and ``ci`` of c, without all their vectors at once."""
    out = np.zeros(len(qi))
    for lo in range(0, len(qi), PAIRS):
        out[lo:lo + PAIRS] = _pair_scores(q[qi[lo:lo + PAIRS]], c[ci[lo:lo + PAIRS]])
    return out


def _listed(qi: np.ndarray, ci: np.ndarray, score: np.ndarray, rank: np.ndarray, depth: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Each query's ``depth`` best of the given pairs in order, with their place from 0."""
    order = np.lexsort((rank, -score, qi))
    qi, ci, score = qi[order], ci[order], score[order]
    if not len(qi):
        return qi, ci, score, qi
    first = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
    place = np.arange(len(qi)) - np.repeat(first, np.diff(np.r_[first, len(qi)]))
    keep = place < depth[qi]
    return qi[keep], ci[keep], score[keep], place[keep]


def _key_rank(keys: pa.Array) -> np.ndarray:
    """Position of each key in ascending order."""
    rank = np.empty(len(keys), np.int64)
    rank[pc.array_sort_indices(keys).to_numpy()] = np.arange(len(keys))
    return rank


def best_pairs(q: np.ndarray, c: np.ndarray, depth: np.ndarray, rank: np.ndarray, barred: np.ndarray | None,
               above: float | None, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, candidate rows and scores of each query's ``depth`` best, ties by ``rank``.

    ``least``: the score that a query's rows have to reach, -inf if not known.
    """
    d = min(q.shape[1], c.shape[1])
    q, c = q[:, :d], c[:, :d]
    scores = q @ c.T
    if barred is not None:
        scores[barred] = -np.inf
    scores[~np.isfinite(scores)] = -np.inf
    size = np.sqrt((q * q).sum(1)) * math.sqrt(float((c * c).sum(1).max(initial=0.0)))
    margin = np.where(np.isfinite(size), size, 0) * ROUNDING * max(d, 1)
    floor = np.full(len(q), -np.inf if above is None else above) - margin
    n = scores.shape[1]
    known = np.zeros(len(q), bool) if least is None else np.isfinite(least)
    if least is not None:
        floor = np.maximum(floor, least - margin)
    n = scores.shape[1]
    # queries of like depth share one partition of their scores
    classes = np.minimum(2 ** np.ceil(np.log2(np.maximum(depth, 1))).astype(np.int64), n)
    for size_class in np.unique(classes[~known]):
        rows = np.flatnonzero((classes == size_class) & ~known)
        if size_class < n:
            kth = np.partition(scores[rows], n - size_class, axis=1)[:, n - size_class]
            floor[rows] = np.maximum(floor[rows], kth - 2 * margin[rows])
    qi, ci = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
    exact = _scores_at(q, c, qi, ci)
    if above is not None or least is not None:
        keep = np.ones(len(qi), bool) if above is None else exact > above
        if least is not None:
            keep &= exact >= least[qi]
        qi, ci, exact = qi[keep], ci[keep], exact[keep]
    return _listed(qi, ci, exact, rank[ci], depth)[:3]


# cells ------------------------------------------------------------------------
class Cells:
    """Pivots, radii, sizes and blocks of all cells; bounded by MAX_PIVOTS rows."""

    def __init__(self, pivots: np.ndarray, radius: np.ndarray, rows: np.ndarray, block: int) -> None:
        self.pivots, self.radius, self.rows = pivots, radius, rows
        self.blocks = np.maximum(1, -(-rows // block))

    @staticmethod
    def nearest(pivots: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot and the distance to it, which is never rounded down."""
        vectors = np.where(np.isfinite(vectors), vectors, 0.0)
        far = (pivots * pivots).sum(1)[None, :] - 2 * (vectors @ pivots.T)
        cell = far.argmin(1)
        gap = vectors - pivots[cell]
        return cell, np.sqrt((gap * gap).sum(1)) * (1 + 1e-9)

    def visits(self, q: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Upper bounds (queries, cells), and which cells the first pass visits."""
        q = np.where(np.isfinite(q), q, 0.0)
        centre = q @ self.pivots.T
        size = np.sqrt((q * q).sum(1))
        bound = centre + size[:, None] * self.radius[None, :]
        bound += np.abs(bound) * 1e-9 + size[:, None] * np.abs(self.pivots).max(initial=0.0) * 1e-9
        bound[:, self.rows == 0] = -np.inf
        order = np.argsort(-np.where(self.rows[None, :] > 0, centre, -np.inf), axis=1, kind="stable")
        held = np.cumsum(self.rows[order], axis=1)
        early = (held - self.rows[order]) < 2 * depth[:, None]
        first = np.zeros_like(early)
        np.put_along_axis(first, order, early, axis=1)
        return bound, first & (self.rows > 0)[None, :]


def _deal(candidates: DataFrame, n_pivots: int, block: int) -> tuple[DataFrame, Cells]:
    """The candidates with the cell of their nearest pivot and a block in it, and the cells."""
    spark = candidates.sparkSession
    first = candidates.orderBy(F.xxhash64("c_key"), "c_key").limit(n_pivots).select("c_vec")
    pivots = matrix(first.toArrow()["c_vec"])
    pivots = np.where(np.isfinite(pivots), pivots, 0.0)
    shared = spark.sparkContext.broadcast(pivots)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, far = Cells.nearest(shared.value, matrix(batch.column("c_vec"))[:, :shared.value.shape[1]])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(far)],
                                             names=["c_key", "c_vec", "value", "cell", "far"])

    schema = T.StructType([*candidates.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("far", T.DoubleType())])
    dealt = cut_lineage(candidates.mapInArrow(nearest, schema))
    radius, rows = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for r in dealt.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # a row per pivot
        radius[r["cell"]], rows[r["cell"]] = r["far"], r["n"]
    cells = Cells(pivots, radius, rows, block)
    table = F.broadcast(spark.createDataFrame([(i, int(b)) for i, b in enumerate(cells.blocks)], "cell int, blocks int"))
    return dealt.join(table, "cell").select(
        "c_key", "c_vec", "value", "cell", F.pmod(F.xxhash64("c_key"), F.col("blocks")).cast("int").alias("block")), cells


def _route(queries: DataFrame, cells: Cells, second: bool) -> DataFrame:
    """``queries`` once for each block of each cell that they visit, with cell and block."""
    shared = queries.sparkSession.sparkContext.broadcast(cells)
    names = queries.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                q = matrix(part.column("q_vec"))
                bound, first = own.visits(q[:, :own.pivots.shape[1]], part.column("depth").to_numpy())
                if second:
                    least = part.column("least").to_numpy(zero_copy_only=False)
                    first = ~first & (bound > -np.inf) & ~(bound < least[:, None])
                qi, cell = np.nonzero(first)
                times = own.blocks[cell]
                at = np.repeat(np.arange(len(qi)), times)
                block = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                yield pa.RecordBatch.from_arrays(
                    [c.take(pa.array(qi[at])) for c in part.columns]
                    + [pa.array(cell[at].astype(np.int32)), pa.array(block.astype(np.int32))], names=[*names, "cell", "block"])

    schema = T.StructType([*queries.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("block", T.IntegerType())])
    return queries.mapInArrow(rows, schema)


def _barred(limit: np.ndarray, value: np.ndarray, own: np.ndarray | None) -> np.ndarray | None:
    """Pairs that don't count: values above the limit, and the query itself at column ``own`` (-1: not there)."""
    barred = None
    if np.isfinite(limit).any():  # without a limit all are in; without a value none is
        barred = np.isfinite(limit)[:, None] & ~(value[None, :] <= limit[:, None])
    if own is not None:
        barred = np.zeros((len(limit), len(value)), bool) if barred is None else barred
        rows = np.flatnonzero(own >= 0)
        barred[rows, own[rows]] = True
    return barred


AT = ["cell", "block", "side"]


def _search(routed: DataFrame, sent: DataFrame, exclude_self: bool, min_score: float | None) -> DataFrame:
    """(q_key, c_key, score): the best of every (cell, block, side)."""
    schema = T.StructType([T.StructField("q_key", routed.schema["q_key"].dataType),
                           T.StructField("c_key", sent.schema["c_key"].dataType), T.StructField("score", T.DoubleType())])

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        qk, ck = left["q_key"].combine_chunks(), right["c_key"].combine_chunks()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(qk) and len(ck):
            q, c, depth, rank = matrix(left["q_vec"]), matrix(right["c_vec"]), left["depth"].to_numpy(), _key_rank(ck)
            limit, value = (t.to_numpy(zero_copy_only=False).astype(float) for t in (left["limit"], right["value"]))
            own = pc.index_in(qk, ck).fill_null(-1).to_numpy(zero_copy_only=False) if exclude_self else None
            for lo in range(0, len(qk), ROWS):
                at = slice(lo, lo + ROWS)
                qi, ci, score = best_pairs(q[at], c, depth[at], rank, _barred(limit[at], value, None if own is None else own[at]), min_score)
                found.append((qi + lo, ci, score))
        qi, ci, score = (np.concatenate(x) for x in zip(*found))
        return pa.table({"q_key": qk.take(pa.array(qi)), "c_key": ck.take(pa.array(ci)), "score": pa.array(score)})

    return routed.groupBy(*AT).cogroup(sent.groupBy(*AT)).applyInArrow(kernel, schema)


def _visitors(members: DataFrame, routed: DataFrame) -> DataFrame:
    """Each block's members once for every side that visits the block."""
    visits = routed.select(*[F.col(c).alias(c) for c in AT]).distinct()  # columns of its own: both sides meet again
    return members.join(visits, ["cell", "block"]).select("c_key", "c_vec", "value", *[F.col(c).alias(c) for c in AT])


def _ranked(found: DataFrame) -> DataFrame:
    w = Window.partitionBy("q_key").orderBy(F.desc("score"), F.asc("c_key"))
    return found.withColumn("rank", F.row_number().over(w))


def _first(found: DataFrame, queries: DataFrame, k: int | None) -> DataFrame:
    """The best rows of each query over all groups, with their rank: k, or its own depth."""
    if k is not None:
        return _ranked(found).where(F.col("rank") <= k)
    return _ranked(found).join(queries.select("q_key", "depth"), "q_key").where(F.col("rank") <= F.col("depth")).drop("depth")


# tiles ------------------------------------------------------------------------
def _tiles(cells: Cells, tile: int) -> np.ndarray:
    """First tile of each cell; cells of several blocks have so many tiles of their own, others share them with their neighbours."""
    pivots = cells.pivots - cells.pivots.mean(axis=0, keepdims=True)
    along = pivots @ np.linalg.svd(pivots, full_matrices=False)[2][0] if pivots.shape[1] else np.zeros(len(pivots))
    first, number, held = np.zeros(len(pivots), np.int64), 0, 0
    for cell in np.argsort(along, kind="stable"):
        rows, blocks = int(cells.rows[cell]), int(cells.blocks[cell])
        if held and (blocks > 1 or held + rows > tile):
            number, held = number + 1, 0
        first[cell] = number
        if blocks > 1:
            number += blocks
        else:
            held += rows
    return first


def _to_visit(cells: Cells, q: np.ndarray, depth: np.ndarray, least: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds, and the cells that a pass visits: the first, or with ``least`` the second."""
    bound, first = cells.visits(q[:, :cells.pivots.shape[1]], depth)
    return bound, first if least is None else ~first & (bound > -np.inf) & ~(bound < least[:, None])


def _tile_route(queries: DataFrame, shared, tiles: np.ndarray, second: bool) -> DataFrame:
    """``queries`` once for each tile with a cell that they visit."""
    names = queries.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        cell = np.repeat(np.arange(len(own.blocks)), own.blocks)
        tile = tiles[cell] + np.arange(len(cell)) - np.repeat(np.cumsum(own.blocks) - own.blocks, own.blocks)
        order = np.argsort(tile, kind="stable")
        number, first = np.unique(tile[order], return_index=True)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                least = part.column("least").to_numpy(zero_copy_only=False) if second else None
                _, visit = _to_visit(own, matrix(part.column("q_vec")), part.column("depth").to_numpy(), least)
                qi, at = np.nonzero(np.logical_or.reduceat(visit[:, cell[order]], first, axis=1))
                yield pa.RecordBatch.from_arrays([c.take(pa.array(qi)) for c in part.columns] + [pa.array(number[at].astype(np.int32))],
                                                 names=[*names, "tile"])

    return queries.mapInArrow(rows, T.StructType([*queries.schema.fields, T.StructField("tile", T.IntegerType())]))


def _tile_search(queries: DataFrame, members: DataFrame, shared, tiles: np.ndarray, sides: int, exclude_self: bool,
                 min_score: float | None, second: bool) -> DataFrame:
    """(q_key, c_key, score): of every tile and side what the pass finds among each query's best."""
    routed = _tile_route(queries, shared, tiles, second) \
        .select("*", F.pmod(F.xxhash64("q_key"), F.lit(sides)).cast("int").alias("side"))
    sent = members.select("*", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("side"))
    schema = T.StructType([T.StructField("q_key", queries.schema["q_key"].dataType),
                           T.StructField("c_key", members.schema["c_key"].dataType), T.StructField("score", T.DoubleType())])

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        own = shared.value
        qk, ck = left["q_key"].combine_chunks(), right["c_key"].combine_chunks()
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(qk) and len(ck):
            qs, cs, depths, rank = matrix(left["q_vec"]), matrix(right["c_vec"]), left["depth"].to_numpy(), _key_rank(ck)
            limit, value = (t.to_numpy(zero_copy_only=False).astype(float) for t in (left["limit"], right["value"]))
            reach = left["least"].to_numpy(zero_copy_only=False).astype(float) if second else None
            order = np.argsort(right["cell"].to_numpy(), kind="stable")
            cell, start = np.unique(right["cell"].to_numpy()[order], return_index=True)
            end = np.r_[start[1:], len(order)]
            itself = np.full(len(qk), -1)  # place of the query itself in that order
            if exclude_self:
                place, at = np.argsort(order), pc.index_in(qk, ck).fill_null(-1).to_numpy(zero_copy_only=False)
                itself[at >= 0] = place[at[at >= 0]]
            for lo in range(0, len(qk), ROWS):
                q, depth = qs[lo:lo + ROWS], depths[lo:lo + ROWS]
                bound, visit = _to_visit(own, q, depth, None if reach is None else reach[lo:lo + ROWS])
                least = np.full(len(q), -np.inf) if reach is None else reach[lo:lo + ROWS].copy()
                least[least <= (-np.inf if min_score is None else min_score)] = -np.inf  # not the score of a row
                held = found[0]
                for j in np.argsort(-bound[:, cell].max(axis=0), kind="stable"):
                    for s in range(start[j], end[j], CELL):
                        rows = np.flatnonzero(visit[:, cell[j]] & ~(bound[:, cell[j]] < least))
                        if not len(rows):
                            break
                        at = order[s:min(s + CELL, end[j])]
                        me = itself[lo + rows] - s
                        barred = _barred(limit[lo + rows], value[at], np.where((me >= 0) & (me < len(at)), me, -1) if exclude_self else None)
                        qi, ci, score = best_pairs(q[rows], cs[at], depth[rows], rank[at], barred, min_score, least[rows])
                        if len(qi):
                            qi, ci, score = (np.concatenate(x) for x in zip(held, (rows[qi], at[ci], score)))
                            qi, ci, score, place = _listed(qi, ci, score, rank[ci], depth)
                            held = qi, ci, score
                            last = place == depth[qi] - 1
                            least[qi[last]] = np.maximum(least[qi[last]], score[last])
                found.append((held[0] + lo, held[1], held[2]))
        qi, ci, score = (np.concatenate(x) for x in zip(*found))
        return pa.table({"q_key": qk.take(pa.array(qi)), "c_key": ck.take(pa.array(ci)), "score": pa.array(score)})

    return routed.groupBy("tile", "side").cogroup(sent.groupBy("tile", "side")).applyInArrow(kernel, schema)


def ranked_search(routed: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """(q_key, c_key, score, rank): each query's k best members of the blocks it was sent to."""
    routed = cut_lineage(routed)
    return _first(_search(routed, _visitors(members, routed), False, None), routed, k)


def dense_topk(queries: DataFrame, candidates: DataFrame, k: int, *, q_key: str, c_key: str, q_vec: str = "vector",
               c_vec: str = "vector", exclude_self: bool = False, min_score: float | None = None,
               extra: DataFrame | None = None, q_limit: str | None = None, c_value: str | None = None,
               cell: int = CELL, side: int = SIDE) -> DataFrame:
    """(q_key, c_key, score, rank): each query's k best candidates by inner product, ties by c_key.

    Keys are unique on both sides. Rows without a vector take no part, nor do
    pairs whose score isn't finite; with ``min_score`` scores must exceed it.
    ``extra`` (q_key, n) asks for n more rows of single queries. With
    ``q_limit`` and ``c_value`` only candidates whose value is at most the
    query's limit count (no limit: all). Normalise first for the cosine.
    """
    spark = queries.sparkSession
    q = queries.select(F.col(q_key).alias("q_key"), F.col(q_vec).alias("q_vec"),
                       (F.col(q_limit) if q_limit else F.lit(None)).cast("double").alias("limit")) \
        .where(F.col("q_vec").isNotNull())
    if extra is not None:
        more = extra.select(F.col(extra.columns[0]).alias("q_key"), F.col(extra.columns[1]).alias("n"))
        q = q.join(more, "q_key", "left").withColumn("depth", F.lit(k) + F.coalesce("n", F.lit(0)).cast("long")).drop("n")
    else:
        q = q.withColumn("depth", F.lit(k).cast("long"))
    c = candidates.select(F.col(c_key).alias("c_key"), F.col(c_vec).alias("c_vec"),
                          (F.col(c_value) if c_value else F.lit(None)).cast("double").alias("value")) \
        .where(F.col("c_vec").isNotNull())
    own = k if extra is None else None
    # sizing only needs row counts: count keys so vector expressions are not evaluated
    nq, nc = queries.select(q_key).count(), candidates.select(c_key).count()
    sides = max(1, -(-nq // side), min(spark.sparkContext.defaultParallelism, nq // 64) if nc <= cell else 1)
    number = F.pmod(F.xxhash64("q_key"), F.lit(sides)).cast("int").alias("side")
    if nc <= cell:  # one cell, which all queries visit
        only = [F.lit(0).alias("cell"), F.lit(0).alias("block")]
        sent = c.select("*", *only, F.explode(F.sequence(F.lit(0), F.lit(sides - 1))).alias("side"))
        return _first(_search(q.select("*", *only, number), sent, exclude_self, min_score), q, own)
    q, c = cut_lineage(q), cut_lineage(c)
    # vectors are sent once for each tile of the other table: as few tiles as memory and the cores ask for
    cores, some = spark.sparkContext.defaultParallelism, c.select(F.size("c_vec")).first()
    most = max(cell, TILE // max(1, some[0] if some else 1))
    sides = max(1, -(-nq // max(side, min(most, -(-nq // math.isqrt(2 * cores))))))
    tile = max(cell, min(most, -(-nc // -(-2 * cores // sides))))
    dealt, cells = _deal(c, min(MAX_PIVOTS, -(-nc // cell)), tile)
    if not len(cells.pivots):
        return _first(q.select("q_key").crossJoin(c.select("c_key")).withColumn("score", F.lit(0.0)), q, own)
    tiles, shared = _tiles(cells, tile), spark.sparkContext.broadcast(cells)
    table = F.broadcast(spark.createDataFrame([(i, int(t)) for i, t in enumerate(tiles)], "cell int, first int"))
    members = dealt.join(table, "cell").select("c_key", "c_vec", "value", "cell", (F.col("first") + F.col("block")).alias("tile"))
    near = cut_lineage(_tile_search(q, members, shared, tiles, sides, exclude_self, min_score, False))
    # the score that the second pass has to reach: the last one needed, where the first pass found so many
    least = _ranked(near).join(q.select("q_key", "depth"), "q_key") \
        .where(F.col("rank") == F.col("depth")).select("q_key", F.col("score").alias("least"))
    rest = q.join(least, "q_key", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf") if min_score is None else float(min_score))))
    far = _tile_search(rest, members, shared, tiles, sides, exclude_self, min_score, True)
    return _first(near.union(far), q, own)


# ranks ------------------------------------------------------------------------
def rank_of_target(queries: DataFrame, targets: DataFrame, items: DataFrame, *, key: str = "sample_id", q_vec: str = "vector",
                   item_vec: str = "embedding", cell: int = CELL, side: int = SIDE) -> DataFrame:
    """(key, target_rank): 1 + the number of items that score strictly higher than the key's target.

    ``queries``: (key, vector); ``targets``: (key, item_id); ``items``:
    (item_id, embedding). Cells whose upper bound stays below the target's
    score add nothing, cells whose lower bound is above it add all their
    members; only the others are visited. Keys without a vector, or whose
    target has none, get no row.
    """
    spark = queries.sparkSession
    vectors = items.select(F.col("item_id").alias("c_key"), F.col(item_vec).alias("c_vec"), F.lit(None).cast("double").alias("value")) \
        .where(F.col("c_vec").isNotNull())
    q = queries.select(F.col(key).alias("q_key"), F.col(q_vec).alias("q_vec")).where(F.col("q_vec").isNotNull()) \
        .join(targets.select(F.col(key).alias("q_key"), F.col("item_id").alias("target")), "q_key") \
        .join(vectors.select(F.col("c_key").alias("target"), F.col("c_vec").alias("t_vec")), "target") \
        .withColumn("depth", F.lit(1).cast("long"))
    q, vectors = cut_lineage(q), cut_lineage(vectors)
    nq, nc = q.count(), vectors.count()
    if not nq or not nc:
        return q.select(F.col("q_key").alias(key), F.lit(1).cast("long").alias("target_rank"))
    members, cells = _deal(vectors, min(MAX_PIVOTS, -(-nc // cell)), cell)
    shared = spark.sparkContext.broadcast(cells)
    sides = max(1, -(-nq // side))
    names = [*q.columns, "cell", "block", "surely"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                qs, ts = matrix(part.column("q_vec")), matrix(part.column("t_vec"))
                score = _pair_scores(qs, ts)
                upper, _ = own.visits(qs, part.column("depth").to_numpy())
                minus, _ = own.visits(-qs, part.column("depth").to_numpy())
                lower = np.where(own.rows[None, :] > 0, -minus, np.inf)
                sure = (lower > score[:, None]) & (own.rows > 0)[None, :]
                open_ = ~sure & (upper >= score[:, None])
                qi, at = np.nonzero(open_)
                times = own.blocks[at]
                take = np.repeat(np.arange(len(qi)), times)
                block = np.arange(len(take)) - np.repeat(np.cumsum(times) - times, times)
                surely = (sure * own.rows[None, :]).sum(1)
                # a row with block -1 carries what needs no visit
                rows_at = np.concatenate([np.arange(len(qs)), qi[take]])
                yield pa.RecordBatch.from_arrays(
                    [c.take(pa.array(rows_at)) for c in part.columns]
                    + [pa.array(np.concatenate([np.full(len(qs), -1), at[take]]).astype(np.int32)),
                       pa.array(np.concatenate([np.full(len(qs), -1), block]).astype(np.int32)),
                       pa.array(np.concatenate([surely, np.zeros(len(take), np.int64)]))], names=names)

    schema = T.StructType([*q.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("block", T.IntegerType()),
                           T.StructField("surely", T.LongType())])
    routed = q.mapInArrow(rows, schema).withColumn("side", F.pmod(F.xxhash64("q_key"), F.lit(sides)).cast("int"))
    visits = routed.where("block >= 0")
    counted = T.StructType([T.StructField("q_key", q.schema["q_key"].dataType), T.StructField("above", T.LongType())])

    def kernel(left: pa.Table, right: pa.Table) -> pa.Table:
        above = np.zeros(left.num_rows, np.int64)
        if left.num_rows and right.num_rows:
            qs, cs = matrix(left["q_vec"]), matrix(right["c_vec"])
            score = _pair_scores(qs, matrix(left["t_vec"]))
            all_scores = qs @ cs.T
            margin = np.sqrt((qs * qs).sum(1)) * math.sqrt(float((cs * cs).sum(1).max(initial=0.0))) * ROUNDING * qs.shape[1]
            higher = all_scores > score[:, None] + margin[:, None]
            qi, ci = np.nonzero(np.abs(all_scores - score[:, None]) <= margin[:, None])
            higher[qi, ci] = _pair_scores(qs[qi], cs[ci]) > score[qi]
            above = higher.sum(1)
        return pa.table({"q_key": left["q_key"], "above": pa.array(above.astype(np.int64))})

    seen = visits.groupBy(*AT).cogroup(_visitors(members, visits).groupBy(*AT)).applyInArrow(kernel, counted)
    sure = routed.where("block < 0").select("q_key", F.col("surely").alias("above"))
    return seen.union(sure).groupBy("q_key").agg((F.sum("above") + 1).alias("target_rank")).withColumnRenamed("q_key", key)
