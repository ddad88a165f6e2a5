"""User-based collaborative filtering over a sparse user x item score table.

Never pivots: the user-item "matrix" stays in long form (user, item, score).
User-user cosine neighbours come from routed inverted lists with norm bounds,
so a hot item shared by millions of users never turns into millions² pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.weights import CF_SCORES, weight_of
from shoplens.operators.neighbors import cosine_neighbors
from shoplens.session import cut_lineage


# B13 ------------------------------------------------------------------------
def score_events(events: DataFrame, mapping: dict | None = None, default=0) -> DataFrame:
    """Add ``score`` = weight of event_type (unmapped -> ``default``)."""
    return events.withColumn("score", weight_of(F.col("event_type"), mapping or CF_SCORES, default)
                             .cast("double"))


# D10 ------------------------------------------------------------------------
def user_item_matrix(scored: DataFrame) -> DataFrame:
    """Sparse (user_id, item_id, score = Σ score). Absent pairs are the zeros."""
    return scored.groupBy("user_id", "item_id").agg(F.sum("score").alias("score"))


# F4 / C14 -------------------------------------------------------------------
def nearest_users(matrix: DataFrame, k: int = 5, **search) -> DataFrame:
    """k most cosine-similar other users (similarity > 0), ties by user id.

    The reference takes positions 2..6 of a descending sort assuming the user
    itself is first; here self is excluded explicitly.
    """
    nn = cosine_neighbors(matrix, k, **search)
    return nn.select(F.col("q_key").alias("user_id"), F.col("c_key").alias("neighbor_id"),
                     F.col("score").alias("similarity"), "rank")


# J12 ------------------------------------------------------------------------
def user_cf(matrix: DataFrame, top_n: int = 5, neighbors: int = 5,
            neighbor_table: DataFrame | None = None, **search) -> DataFrame:
    """Recommend items for every user from the unweighted sum of neighbour rows.

    Items the user already has with a non-zero Σscore are dropped (items seen
    only through 0-weight events stay); score-0 candidates are dropped.
    Output: (user_id, rank, item_id, score).
    """
    # read several times (neighbour search, neighbour rows, seen items): materialise once
    matrix = cut_lineage(matrix)
    nn = neighbor_table if neighbor_table is not None else nearest_users(matrix, neighbors, **{"written": True, **search})
    nb_rows = matrix.select(F.col("user_id").alias("neighbor_id"), "item_id",
                            F.col("score").alias("nb_score"))
    cand = nn.select("user_id", "neighbor_id").join(nb_rows, "neighbor_id").select("user_id", "item_id", "nb_score", F.lit(False).alias("_seen"))
    seen = matrix.where("score <> 0 and user_id is not null and item_id is not null").select(
        "user_id", "item_id", F.lit(None).cast("double").alias("nb_score"), F.lit(True).alias("_seen"))
    # one shuffle, by user: neighbour rows meet the user's own there, and the list is cut where they are summed
    cand = (cand.unionByName(seen).repartition("user_id").groupBy("user_id", "item_id")
            .agg(F.sum("nb_score").alias("score"), F.max("_seen").alias("_seen")).where(~F.col("_seen") & (F.col("score") != 0)).drop("_seen"))
    w = Window.partitionBy("user_id").orderBy(F.desc("score"), F.asc("item_id"))
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
            .select("user_id", "rank", "item_id", "score"))


# A12 ------------------------------------------------------------------------
def serve_topk_table(recs: DataFrame, key: str = "user_id") -> DataFrame:
    """One row per user with its (score desc) list, the shape of a sorted-set store.

    A later write of the same (user, item) replaces the earlier score; without
    ``written_at``, or among writes of one time, the highest score stays.
    """
    latest = recs.groupBy(key, "item_id").agg(F.max("score").alias("score")) if "written_at" not in recs.columns else (
        recs.withColumn("_rn", F.row_number().over(
            Window.partitionBy(key, "item_id").orderBy(F.desc("written_at"), F.desc("score"))))
        .where("_rn = 1").drop("_rn"))
    return latest.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(F.col("score"), F.col("item_id"))), asc=False)
        .alias("members"))
