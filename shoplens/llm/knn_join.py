"""Exact top-k by inner product as a Voronoi kNN join (operator 6).

Vectors go to the cell of their nearest pivot. For a query q and a cell with
pivot p and radius r, q.v <= q.p + |q| r for every vector v of the cell. The
cells' summaries (count, radius, radii of the nearest members) give each query
a score that k vectors are sure to reach; the query is then sent only to cells
whose upper bound is not below it. Large cells are split into blocks; each
block solves its queries locally and the best k of a query are merged. A block's vectors are shipped only to the query sides that visit it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.llm.common import cut_lineage

BLOCK = 4096
PIVOTS = (64, 2048)  # least and most; between them as many as there are blocks of rows


def integer_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): floor(64 x) of each component; vectors that are null or hold null, NaN or infinity go."""
    x = F.col("embedding")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.where(x.isNotNull() & F.coalesce(~bad, F.lit(True))).select(
        *[c for c in vectors.columns if c != "embedding"],
        F.transform(x, lambda c: F.floor(64 * c.cast("double")).cast("long")).alias("v"))


def _matrix(lists, width: int) -> np.ndarray:
    """Rows as int64; a shorter vector counts as zero where it ends."""
    out = np.zeros((len(lists), width), np.int64)
    for i, v in enumerate(lists):
        out[i, :len(v)] = v
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact int64 inner products; by floating point where every sum stays below 2 ** 53."""
    if not len(a) or not len(b):
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if most < 2 ** 53 else a @ b.T


def _distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    v, pivots = v.astype(float), pivots.astype(float)
    return np.sqrt(np.maximum((v ** 2).sum(1)[:, None] + (pivots ** 2).sum(1)[None] - 2 * v @ pivots.T, 0))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, n_pivots: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for each row whose vec_id is divisible by ``every``.

    Candidates are all rows but the query's own (a null vec_id is neither query
    nor candidate); ties go to the smaller vec_id. Repeated rows, and rows that
    share a vec_id, are candidates each, and queries with a list each. Vectors
    of different lengths meet on their common length. Fewer than k candidates
    give fewer rows; an empty table gives none.
    """
    spark = vectors.sparkSession
    numbered = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding").where("vec_id is not null")
    rows = cut_lineage(integer_vectors(numbered))  # written, so that the numbers stay
    width, n_rows = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(1)), F.count("*")).first()
    width = width or 1
    n_pivots = n_pivots or min(max(PIVOTS[0], -(-n_rows // BLOCK)), PIVOTS[1])
    chosen = rows.select("v").distinct().orderBy(F.xxhash64("v")).limit(n_pivots).collect()
    pivots = _matrix([r["v"] for r in chosen], width)  # at most n_pivots vectors
    shared = spark.sparkContext.broadcast(pivots)

    def place(batches):
        for pdf in batches:
            if len(pdf):
                d = _distances(_matrix(pdf["v"], width), shared.value)
                pdf["cell"], pdf["far"] = d.argmin(1).astype(np.int32), d.min(1) * (1 + 1e-9) + 1e-6
                yield pdf[["row", "vec_id", "v", "cell", "far"]]

    placed = cut_lineage(rows.mapInPandas(place, "row long, vec_id long, v array<long>, cell int, far double"))
    # per cell: members, radius, and the radii within which 1, 2, 4, ... members lie (one row per cell)
    near = Window.partitionBy("cell", "salt").orderBy("far")
    merge = Window.partitionBy("cell").orderBy("far")
    first = placed.select("cell", "far", F.pmod(F.xxhash64("row"), F.lit(64)).alias("salt")) \
        .withColumn("n", F.row_number().over(near)).where(F.col("n") <= k + 1) \
        .withColumn("n", F.row_number().over(merge)).where(F.col("n") <= k + 1)
    sure = {r["cell"]: sorted(r["x"]) for r in first.groupBy("cell").agg(F.collect_list("far").alias("x")).collect()}
    sums = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect()
    cells = {r["cell"]: (r["n"], r["r"], -(-r["n"] // BLOCK)) for r in sums}
    is_query = F.col("vec_id") % every == 0
    summary = spark.sparkContext.broadcast((sure, cells))

    def route(batches):
        """Each query and the blocks that it must visit, with the score that it is sure to reach."""
        sure, cells = summary.value
        names = sorted(cells)
        radius = np.array([cells[c][1] for c in names])
        blocks = np.array([cells[c][2] for c in names])
        for pdf in batches:
            for at in range(0, len(pdf), 1024):
                part = pdf.iloc[at:at + 1024]
                q = _matrix(part["v"], width).astype(float)
                norm = np.sqrt((q ** 2).sum(1)) * (1 + 1e-9)
                to = q @ shared.value[names].T.astype(float)
                upper = to + norm[:, None] * radius + 1e-3
                # k + 1 members (one may be the query itself) lie within the radius x: each scores q.p - |q| x or more
                lows = [np.repeat(to[:, [i]], len(sure[c]), 1) - norm[:, None] * np.array(sure[c]) - 1e-3
                        for i, c in enumerate(names)]
                low = np.sort(np.concatenate(lows, 1), 1)
                floor = low[:, -(k + 1)] if low.shape[1] > k else np.full(len(q), -np.inf)
                qi, ci = np.nonzero(upper >= floor[:, None])
                reps = blocks[ci]
                qi, ci = np.repeat(qi, reps), np.repeat(ci, reps)
                block = np.arange(len(qi)) - np.repeat(np.cumsum(reps) - reps, reps)
                yield pd.DataFrame({"query": part["row"].to_numpy()[qi], "query_id": part["vec_id"].to_numpy()[qi], "q": part["v"].to_numpy()[qi],
                                    "floor": floor[qi], "cell": np.array(names, np.int32)[ci],
                                    "block": block.astype(np.int32)})

    queries = placed.where(is_query).select("row", "vec_id", "v")
    n_queries = max(queries.count(), 1)
    sides = -(-n_queries // BLOCK)
    routed = queries.mapInPandas(
        route, "query long, query_id long, q array<long>, floor double, cell int, block int") \
        .withColumn("side", F.pmod(F.xxhash64("query"), F.lit(sides)).cast("int"))
    # one row a cell; a block goes to the sides of the queries that visit it, and to no other
    n_blocks = F.broadcast(spark.createDataFrame([(c, v[2]) for c, v in sorted(cells.items())], "cell int, blocks int"))
    visits = routed.select(*[F.col(c).alias(c) for c in ("cell", "block", "side")]).distinct()
    data = placed.join(n_blocks, "cell").select(
        "row", "vec_id", "v", "cell", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int").alias("block")) \
        .join(visits, ["cell", "block"]).select("row", "vec_id", "v", *[F.col(c).alias(c) for c in ("cell", "block", "side")])

    def solve(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            ids, rows = right["vec_id"].to_numpy(), right["row"].to_numpy()
            v = _matrix(right["v"], width)
            for at in range(0, len(left), 512):
                part = left.iloc[at:at + 512]
                scores = products(_matrix(part["q"], width), v)
                own, names = part["query"].to_numpy(), part["query_id"].to_numpy()
                for i in range(len(part)):
                    ok = np.flatnonzero((rows != own[i]) & (scores[i] >= part["floor"].iat[i]))
                    if len(ok) > k:
                        s = scores[i][ok]
                        ok = ok[s >= np.partition(s, len(s) - k)[len(s) - k]]
                    best = ok[np.lexsort((ids[ok], -scores[i][ok]))[:k]]
                    out.append(pd.DataFrame({"query": own[i], "query_id": names[i], "vec_id": ids[best], "row": rows[best],
                                             "score": scores[i][best]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "row": [], "score": []}, dtype="int64")

    keys = ["cell", "block", "side"]
    local = routed.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInPandas(
        solve, "query long, query_id long, vec_id long, row long, score long")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 20
"""
