"""Embedding operators: query/context vectors, combined vectors, nearest items.

Per-user vector sums use ``pyspark.ml.stat.Summarizer`` (a typed aggregate
with map-side partial aggregation), so a user with millions of events never
has their vectors collected into one list.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.functions import vectors as V
from shoplens.functions.weights import INTERACTION_DEFAULT, INTERACTION_WEIGHTS, weight_of
from shoplens.operators.cells import CELL, SIDE, dense_topk, matrix, ranked_search


# B14 ------------------------------------------------------------------------
def embedded_items(embeddings: DataFrame, products: DataFrame) -> DataFrame:
    """Vectors of catalog items only."""
    return embeddings.join(products.select("item_id"), "item_id", "left_semi")


# Weighted vector sums -------------------------------------------------------
def weighted_vector_sum(rows: DataFrame, key: str, vec: str = "embedding", weight: str = "w",
                        metric: str = "sum") -> DataFrame:
    """(key, vector = Σ weight·vec) or the weighted mean, with partial aggregation."""
    v = rows.select(key, array_to_vector(F.col(vec)).alias("_v"), F.col(weight).cast("double").alias("_w"))
    summ = Summarizer.metrics(metric)
    agg = v.groupBy(key).agg(summ.summary(F.col("_v"), F.col("_w")).alias("_s"))
    return agg.select(key, vector_to_array(F.col("_s")[metric]).alias("vector"))


# D15 ------------------------------------------------------------------------
def query_vectors(window_events: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Per user: normalise(Σ interaction weight · item vector), one term per event.

    Events of items without a vector are skipped; users with none get no row.
    """
    rows = (window_events.select("user_id", "item_id", "event_type")
            .join(embeddings.select("item_id", "embedding"), "item_id")
            .withColumn("w", weight_of(F.col("event_type"), INTERACTION_WEIGHTS, INTERACTION_DEFAULT)))
    s = weighted_vector_sum(rows, "user_id")
    return s.select("user_id", V.normalize("vector").alias("vector"))


# D16 ------------------------------------------------------------------------
def context_vectors(window_events: DataFrame, embeddings: DataFrame) -> DataFrame:
    """cart_vec (add_to_cart + purchase) and click_vec: L2-normalised means."""
    return context_vectors_of(window_events.groupBy("user_id", "item_id", "event_type").agg(F.count(F.lit(1)).alias("n")), embeddings)


def context_vectors_of(counts: DataFrame, embeddings: DataFrame, n: str = "n") -> DataFrame:
    """:func:`context_vectors` from counted (user_id, item_id, event_type, n) rows; rows with n = 0 stand outside."""
    counts = counts.where(F.col(n) > 0)
    rows = (counts.select("user_id", "item_id", "event_type", F.col(n).alias("w"))
            .join(embeddings.select("item_id", "embedding"), "item_id"))

    def mean_of(types, name):
        return weighted_vector_sum(rows.where(F.col("event_type").isin(types)), "user_id", metric="mean").select(
            "user_id", V.normalize("vector").alias(name))

    users = counts.select("user_id").distinct()
    return (users.join(mean_of(["add_to_cart", "purchase"], "cart_vec"), "user_id", "left")
            .join(mean_of(["click"], "click_vec"), "user_id", "left"))


# J4 -------------------------------------------------------------------------
PAIR_BLOCK = 1 << 18  # (user, item) pairs of a block, about


def _cosine_of(x: list | None, y: list | None) -> float | None:
    """:func:`V.cosine` of two lists with absent elements or of different sizes; 0 where one is absent."""
    if x is None or y is None:
        return 0.0
    n = max(len(x), len(y))
    x, y = x + [None] * (n - len(x)), y + [None] * (n - len(y))
    a, b = (None if None in v else sum(u * u for u in v) for v in (x, y))
    if a == 0 or b == 0:
        return 0.0
    return None if a is None or b is None else sum(u * v for u, v in zip(x, y)) / (math.sqrt(a) * math.sqrt(b))


def _columns(lists: pa.Array) -> np.ndarray:
    """(dimensions, rows) of a column of arrays; absent ones are zeros."""
    valid = lists.is_valid().to_numpy(zero_copy_only=False)
    rows = matrix(lists.drop_null())
    out = np.zeros((rows.shape[1], len(lists)))
    out[:, valid] = rows.T
    return out


def _cosines(items: pa.Array, item: np.ndarray, users: pa.Array, user: np.ndarray) -> pa.Array:
    """Cosine of ``items[item]`` and ``users[user]``, summed in the order of the elements; 0 where one is absent (or -1)."""
    there = (item >= 0) & (user >= 0)
    at = np.flatnonzero(there)
    there[at] = items.is_valid().to_numpy(zero_copy_only=False)[item[at]] & users.is_valid().to_numpy(zero_copy_only=False)[user[at]]
    at = np.flatnonzero(there)
    sizes = pa.concat_arrays([pc.list_value_length(x).drop_null().cast(pa.int64()) for x in (items, users)])
    if len(pc.unique(sizes)) > 1 or items.drop_null().flatten().null_count or users.drop_null().flatten().null_count:
        out = np.zeros(len(item), object)
        out[:] = 0.0
        out[at] = [_cosine_of(items[int(i)].as_py(), users[int(u)].as_py()) for i, u in zip(item[at], user[at])]
        return pa.array(out, pa.float64())
    out = np.zeros(len(item))
    if len(at):
        x, y = _columns(items), _columns(users)
        dot, a, b = np.zeros(len(at)), np.zeros(len(items)), np.zeros(len(users))
        for xk, yk in zip(x, y):
            dot += xk[item[at]] * yk[user[at]]
            a += xk * xk
            b += yk * yk
        a, b = a[item[at]], b[user[at]]
        with np.errstate(all="ignore"):
            out[at] = np.where((a == 0) | (b == 0), 0.0, dot / (np.sqrt(a) * np.sqrt(b)))
    return pa.array(out)


def pair_cosines(pairs: DataFrame, contexts: DataFrame, embeddings: DataFrame, names: dict[str, str],
                 block: int = PAIR_BLOCK) -> DataFrame:
    """``pairs`` (user_id, item_id, ...) with the cosine of the item's vector and each vector of the user's context.

    ``names``: column of ``contexts`` (one row a user) -> column of the result;
    0 where a vector is absent. No vector travels with a pair: users are dealt
    to blocks, a block gets its users' contexts once and each item's vector
    that its pairs name once. An item with several vectors gives several rows.
    """
    n = pairs.count()
    spark = pairs.sparkSession
    blocks = max(1, -(-n // block), min(spark.sparkContext.defaultParallelism, n // 4096))
    number = F.pmod(F.xxhash64("user_id"), F.lit(blocks)).cast("int").alias("_block")
    left = pairs.select("*", number)
    vec = F.col("embedding").cast("array<double>").alias("_vec")
    none = F.lit(None).cast("array<double>")
    asked = left.select("_block", "item_id").distinct().join(embeddings.select("item_id", vec), "item_id")
    user_kind, item_kind = pairs.schema["user_id"].dataType, pairs.schema["item_id"].dataType
    right = asked.select(F.col("_block").alias("_block"), F.lit(None).cast(user_kind).alias("user_id"), F.col("item_id").cast(item_kind).alias("item_id"), "_vec",
                         *[none.alias(c) for c in names]) \
        .unionByName(contexts.where(F.col("user_id").isNotNull()).select(
            number, F.col("user_id").cast(user_kind).alias("user_id"), F.lit(None).cast(item_kind).alias("item_id"), none.alias("_vec"),
            *[F.col(c).cast("array<double>").alias(c) for c in names]))

    def kernel(mine: pa.Table, vectors: pa.Table) -> pa.Table:
        mine, vectors = mine.drop_columns(["_block"]).combine_chunks(), vectors.combine_chunks()
        if not mine.num_rows:
            return pa.table({**{c: mine[c] for c in mine.column_names}, **{c: pa.array([], pa.float64()) for c in names.values()}})
        is_item = pc.is_valid(vectors["item_id"])
        items, users = vectors.filter(is_item).combine_chunks(), vectors.filter(pc.invert(is_item)).combine_chunks()

        def one(column: pa.ChunkedArray) -> pa.Array:
            return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)

        def places(keys: pa.ChunkedArray, among: pa.Array) -> np.ndarray:
            return pc.index_in(one(keys), among).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)

        # an item's rows stand together; a pair meets each of them
        coded = one(items["item_id"]).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(codes, kind="stable")
        times = np.bincount(codes, minlength=len(coded.dictionary)).astype(np.int64)
        code = places(mine["item_id"], coded.dictionary)
        have, start = np.zeros(len(code), np.int64), np.zeros(len(code), np.int64)
        known = code >= 0
        have[known], start[known] = times[code[known]], (np.cumsum(times) - times)[code[known]]
        rows = np.maximum(have, 1)
        take = np.repeat(np.arange(len(code)), rows)
        nth = np.arange(len(take)) - np.repeat(np.cumsum(rows) - rows, rows)
        item = np.full(len(take), -1)
        item[have[take] > 0] = order[(start[take] + nth)[have[take] > 0]]
        user = places(mine["user_id"], one(users["user_id"]))[take]
        out = {c: one(mine[c]).take(pa.array(take)) for c in mine.column_names}
        for c, name in names.items():
            out[name] = _cosines(one(items["_vec"]), item, one(users[c]), user)
        return pa.table(out)

    schema = T.StructType([*pairs.schema.fields, *[T.StructField(c, T.DoubleType()) for c in names.values()]])
    return left.groupBy("_block").cogroup(right.groupBy("_block")).applyInArrow(kernel, schema)


# H11 ------------------------------------------------------------------------
def combine_embeddings(image: DataFrame, text: DataFrame, image_weight: float = 0.5,
                       text_weight: float = 0.5, normalize_inputs: bool = False) -> DataFrame:
    """normalise(wi·image + wt·text) for items present in both."""
    i = image.select("item_id", F.col("embedding").alias("_i"))
    t = text.select("item_id", F.col("embedding").alias("_t"))
    j = i.join(t, "item_id")
    if normalize_inputs:
        j = j.withColumn("_i", V.normalize("_i")).withColumn("_t", V.normalize("_t"))
    return j.select("item_id", V.normalize(V.weighted_sum("_i", image_weight, "_t", text_weight))
                    .alias("embedding"))


# J2 -------------------------------------------------------------------------
def vector_topn(query_vecs: DataFrame, item_vecs: DataFrame, n: int, *, key: str = "user_id",
                query_col: str = "vector", item_col: str = "embedding",
                exclude_self: bool = False, extra: DataFrame | None = None) -> DataFrame:
    """Exact inner-product top-n of every query vector against every item vector.

    Output (key, item_id, score, rank); ties broken by item_id. ``extra``
    (key, n): so many rows more for single queries.
    """
    top = dense_topk(query_vecs, item_vecs, n, q_key=key, c_key="item_id",
                     q_vec=query_col, c_vec=item_col, exclude_self=exclude_self, extra=extra)
    return top.select(F.col("q_key").alias(key), F.col("c_key").alias("item_id"), "score", "rank")


# I7 -------------------------------------------------------------------------
def item_similarity_table(item_vecs: DataFrame, products: DataFrame, k: int = 5) -> DataFrame:
    """Top-k most similar other items per item (cosine on normalised vectors),
    in the (query_id, query_name, rank, similar_id, similar_name, similarity_score) shape."""
    nv = item_vecs.select("item_id", V.normalize("embedding").alias("embedding"))
    top = dense_topk(nv, nv, k, q_key="item_id", c_key="item_id", q_vec="embedding",
                     c_vec="embedding", exclude_self=True)
    names = products.select("item_id", "product_name")
    return (top.join(names.withColumnRenamed("item_id", "q_key")
                     .withColumnRenamed("product_name", "query_name"), "q_key", "left")
            .join(names.withColumnRenamed("item_id", "c_key")
                  .withColumnRenamed("product_name", "similar_name"), "c_key", "left")
            .select(F.col("q_key").alias("query_id"), "query_name", "rank",
                    F.col("c_key").alias("similar_id"), "similar_name",
                    F.col("score").alias("similarity_score")))


# J23 ------------------------------------------------------------------------
def fill_missing_embeddings(products: DataFrame, embeddings: DataFrame, dim: int, seed: int = 0) -> DataFrame:
    """Every catalog item gets a vector: its own, else a deterministic pseudo-random
    unit-scale one derived from hash(item_id, position, seed) (no driver RNG)."""
    missing = products.select("item_id").join(embeddings.select("item_id"), "item_id", "left_anti")
    synth = missing.select(
        "item_id",
        F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                    lambda i: (F.pmod(F.xxhash64(F.col("item_id"), i, F.lit(seed)), F.lit(2_000_001))
                               .cast("double") / F.lit(1_000_000.0) - F.lit(1.0))).alias("embedding"),
        F.lit(True).alias("synthetic"))
    own = embeddings.join(products.select("item_id"), "item_id", "left_semi").select(
        "item_id", "embedding", F.lit(False).alias("synthetic"))
    return own.unionByName(synth)


# J2 (approximate) -------------------------------------------------------------
def vector_topn_ann(query_vecs: DataFrame, item_vecs: DataFrame, n: int, *, n_cells: int | None = None,
                    n_probe: int = 8, key: str = "user_id", query_col: str = "vector",
                    item_col: str = "embedding", seed: int = 42) -> DataFrame:
    """Approximate inner-product top-n via KMeans cells (inverted-file search).

    Items are clustered (Spark ML KMeans, k ~ sqrt(#items) unless given); each
    query probes its ``n_probe`` best centroids (tiled kernel against the
    centroid table, whose size is bounded by k x d) and scores only the items
    of those cells through an equi-join on the cell id. Work per query is
    n_probe x cell size instead of the whole catalog. Recall is measured
    against ``vector_topn`` in the tests.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n_items = item_vecs.count()
    k = n_cells or max(1, int(round(n_items ** 0.5)))
    iv = item_vecs.select("item_id", F.col(item_col).alias("_v")).withColumn("_mv", array_to_vector("_v"))
    model = KMeans(k=k, seed=seed, featuresCol="_mv", predictionCol="_cell", maxIter=20).fit(iv)
    cells = model.transform(iv).select("item_id", "_v", "_cell")
    spark = item_vecs.sparkSession
    cent = spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
                                 "_cell long, _c array<double>")
    probes = dense_topk(query_vecs.select(F.col(key).alias("_q"), F.col(query_col).alias("_qv")), cent, n_probe,
                        q_key="_q", c_key="_cell", q_vec="_qv", c_vec="_c")
    # a cell's items are dealt out in blocks; a query's vector goes to its cells' blocks, never along with a candidate
    sizes = cells.groupBy("_cell").agg(F.ceil(F.count("*") / CELL).cast("int").alias("_blocks"))
    placed = cells.join(F.broadcast(sizes), "_cell").select(
        F.col("item_id").alias("c_key"), F.col("_v").alias("c_vec"), F.lit(None).cast("double").alias("value"),
        F.col("_cell").cast("int").alias("cell"), F.pmod(F.xxhash64("item_id"), F.col("_blocks")).cast("int").alias("block"))
    sides = max(1, -(-query_vecs.select(key).count() // (SIDE * 4)))
    routed = (probes.select(F.col("q_key"), F.col("c_key").alias("_cell"))
              .join(query_vecs.select(F.col(key).alias("q_key"), F.col(query_col).alias("q_vec")), "q_key")
              .join(F.broadcast(sizes), "_cell")
              .select("q_key", "q_vec", F.lit(None).cast("double").alias("limit"), F.lit(n).cast("long").alias("depth"),
                      F.col("_cell").cast("int").alias("cell"),
                      F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("block"),
                      F.pmod(F.xxhash64("q_key"), F.lit(sides)).cast("int").alias("side")))
    return ranked_search(routed, placed, n).select(F.col("q_key").alias(key), F.col("c_key").alias("item_id"), "score", "rank")
