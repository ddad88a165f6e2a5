"""Sinks and tracked writes.

Writes go through DataFrameWriter; "upserts" are expressed as anti-join +
union + keep-latest so they run as ordinary distributed jobs against a
versioned output folder rather than row-by-row statements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.scalars import tracking_key
from shoplens.sources.tables import VersionedTable


# A7 / A9 / A11 ----------------------------------------------------------------
def append_events(events: DataFrame, path: str, fmt: str = "parquet") -> None:
    events.write.mode("append").format(fmt).save(path)


def write_embeddings(vectors: DataFrame, path: str) -> None:
    vectors.write.mode("overwrite").parquet(path)


def export_events_csv(events: DataFrame, path: str) -> None:
    events.write.mode("overwrite").option("header", True).csv(path)


# A10 ------------------------------------------------------------------------
def safe_user_token(user: Column, keep: str = r"[^A-Za-z0-9\-_@.+]") -> Column:
    """File-name token: disallowed characters -> '_', outer '_' stripped, else 'unknown_user'."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(user.cast("string"), F.lit("")), keep, "_"), r"^_+|_+$", "")
    return F.when(t == "", F.lit("unknown_user")).otherwise(t)


def export_recommendations(recs: DataFrame, path: str, user_col: str = "user_id", buckets: int | None = None) -> None:
    """CSV lists by user token, written without a driver loop: a folder for each
    token, or with ``buckets`` so many folders, in whose files the token is a
    column (for more users than a store should have folders)."""
    out = recs.withColumn("user_token", safe_user_token(F.col(user_col)))
    if buckets is None:
        out = out.repartition("user_token")
    else:
        out = out.withColumn("bucket", F.pmod(F.xxhash64("user_token"), F.lit(buckets))).repartition(buckets, "bucket") \
            .sortWithinPartitions("bucket", "user_token")
    out.write.mode("overwrite").partitionBy("user_token" if buckets is None else "bucket").option("header", True).csv(path)


# A15 ------------------------------------------------------------------------
IMPRESSION_KEY = ["user_id", "_session_key", "item_id", "source"]


def log_impressions(existing: DataFrame | None, shown: DataFrame) -> DataFrame:
    """New impressions to insert: integer item ids only, blank e-mail filled from
    user_id, duplicates on (user, coalesce(session, -1), item, source) ignored,
    rows already logged skipped."""
    s = shown.withColumn("item_id", F.col("item_id").cast("string").try_cast("long")).where(
        F.col("item_id").isNotNull())
    s = s.withColumn("user_email", F.coalesce(F.nullif(F.trim("user_email"), F.lit("")), F.col("user_id")))
    s = s.withColumn("_session_key", F.coalesce(F.col("session_id").cast("long"), F.lit(-1)))
    # of repeated impressions the one of the best rank stays, then the first by its content
    order = [F.asc_nulls_last("rank")] if "rank" in s.columns else []
    w = Window.partitionBy(*IMPRESSION_KEY).orderBy(*order, F.xxhash64(*s.columns))
    s = s.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    if existing is not None:
        ex = existing.withColumn("_session_key", F.coalesce(F.col("session_id").cast("long"), F.lit(-1))) \
            .select(*IMPRESSION_KEY)
        s = s.join(ex, IMPRESSION_KEY, "left_anti")
    return s.drop("_session_key")


# J21 ------------------------------------------------------------------------
TRACKER_COLUMNS = ["row_type", "user_email", "session_id", "source", "item_id", "product_name", "price",
                   "quantity", "shown_rank", "similarity_score", "ranking_score", "lgbm_ranking_score",
                   "xgboost_ranking_score", "added_to_cart", "added_to_cart_at"]


def checkout_tracker(existing: DataFrame | None, cart_rows: DataFrame, rec_rows: DataFrame) -> DataFrame:
    """New tracker state: cart rows (rank 0, scores 0, already added) and shown
    recommendations replace the (user, session, source, row_type) slices they
    cover; one row per tracking key: the latest write, of one write the cart row,
    then the one of the best rank, then the first by its content."""
    cart = cart_rows.select(
        F.lit("cart_item").alias("row_type"), "user_email", "session_id", "source", "item_id", "product_name",
        "price", "quantity", F.lit(0).alias("shown_rank"), F.lit(0.0).alias("similarity_score"),
        F.lit(0.0).alias("ranking_score"), F.lit(0.0).alias("lgbm_ranking_score"),
        F.lit(0.0).alias("xgboost_ranking_score"), F.lit(True).alias("added_to_cart"),
        F.col("added_at").alias("added_to_cart_at"))
    rank_score = F.coalesce(F.col("ranking_score"), F.col("fallback_score"), F.lit(0.0))
    recs = rec_rows.select(
        F.lit("recommendation").alias("row_type"), "user_email", "session_id", "source", "item_id",
        "product_name", "price", F.lit(1).alias("quantity"), F.col("rank").alias("shown_rank"),
        F.coalesce(F.col("similarity_score"), F.lit(0.0)).alias("similarity_score"),
        rank_score.alias("ranking_score"),
        F.coalesce(F.col("lgbm_ranking_score"), rank_score).alias("lgbm_ranking_score"),
        F.coalesce(F.col("xgboost_ranking_score"), rank_score).alias("xgboost_ranking_score"),
        F.lit(False).alias("added_to_cart"), F.lit(None).cast("timestamp").alias("added_to_cart_at"))
    new = cart.unionByName(recs).withColumn("_w", F.lit(1))
    slice_key = tracking_key("user_email", "session_id", "source", "row_type")
    if existing is not None:
        covered = new.select(slice_key.alias("_slice")).distinct()
        old = (existing.select(*TRACKER_COLUMNS).withColumn("_slice", slice_key)
               .join(covered, "_slice", "left_anti").drop("_slice").withColumn("_w", F.lit(0)))
        new = old.unionByName(new)
    key = tracking_key("user_email", "session_id", "source", "item_id")
    w = Window.partitionBy(key).orderBy(F.desc("_w"), "row_type", F.asc_nulls_last("shown_rank"), F.xxhash64(*TRACKER_COLUMNS))
    return new.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_w")


# J22 ------------------------------------------------------------------------
def mark_added(tracker: DataFrame, adds: DataFrame) -> DataFrame:
    """Flag tracked rows that were added to the cart; adds with no tracked row
    become new recommendation rows (with a row_type, unlike the reference).
    Of several adds of one key the first counts."""
    key = tracking_key("user_email", "session_id", "source", "item_id")
    a = adds.groupBy(key.alias("_key"), "user_email", "session_id", "source", "item_id").agg(F.min("added_at").alias("added_at"))
    t = tracker.withColumn("_key", key)
    upd = (t.join(a.select("_key", "added_at"), "_key", "left")
           .withColumn("added_to_cart", F.col("added_to_cart") | F.col("added_at").isNotNull())
           .withColumn("added_to_cart_at", F.coalesce(F.col("added_at"), F.col("added_to_cart_at")))
           .drop("added_at"))
    ins = a.join(t.select("_key"), "_key", "left_anti").select(
        F.lit("recommendation").alias("row_type"), "user_email", "session_id", "source", "item_id",
        F.lit(None).cast("string").alias("product_name"), F.lit(None).cast("double").alias("price"),
        F.lit(1).alias("quantity"), F.lit(None).cast("int").alias("shown_rank"),
        *[F.lit(None).cast("double").alias(c) for c in
          ("similarity_score", "ranking_score", "lgbm_ranking_score", "xgboost_ranking_score")],
        F.lit(True).alias("added_to_cart"), F.col("added_at").alias("added_to_cart_at"), "_key")
    return upd.unionByName(ins, allowMissingColumns=True).drop("_key")


# J21 / J22 as a table ---------------------------------------------------------
TRACKER_SCHEMA = ("row_type string, user_email string, session_id string, source string, item_id string, product_name string, "
                  "price double, quantity long, shown_rank int, similarity_score double, ranking_score double, "
                  "lgbm_ranking_score double, xgboost_ranking_score double, added_to_cart boolean, added_to_cart_at timestamp")


def tracker_table(spark, folder: str) -> VersionedTable:
    """The tracker as a versioned table; all rows of a user share a bucket, so a write rewrites its users' buckets."""
    return VersionedTable(spark, folder, spark.createDataFrame([], TRACKER_SCHEMA).schema, ["user_email"])


def _as_tracker(df: DataFrame) -> DataFrame:
    schema = df.sparkSession.createDataFrame([], TRACKER_SCHEMA).schema
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def save_tracker(table: VersionedTable, cart_rows: DataFrame, rec_rows: DataFrame, version: int) -> None:
    """Write a checkout's rows as ``version``; running it again changes nothing."""
    new = _as_tracker(checkout_tracker(None, cart_rows, rec_rows))
    table.upsert(new, version, lambda old, _: _as_tracker(checkout_tracker(old, cart_rows, rec_rows)))


def save_added(table: VersionedTable, adds: DataFrame, version: int) -> None:
    """Write the adds to the cart as ``version``."""
    rows = mark_added(table.before(version).limit(0), adds)
    table.upsert(_as_tracker(rows), version, lambda old, _: _as_tracker(mark_added(old, adds)))
