"""Registered source and sink queries that write a whole table in the shared folder and read it back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shoplens.operators import analytics as A
from shoplens.plans.base import register, ts_text, vec_text, vec_text_sql
from shoplens.session import ensure_checkpoint_dir
from shoplens.sources import catalog as SC
from shoplens.sources import fixtures as X
from shoplens.sources import sinks as SK
from shoplens.sources.fixtures import with_views


def _folder(spark, name):
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def _write_catalog(spark, d, folder):
    p = X.products(spark, d).select("item_id", "product_name", "category", "brand", "price")
    p.write.parquet(f"{folder}/products")
    e = X.events(spark, d).select("event_id", "user_id", "item_id", "event_type", F.col("ts").alias("timestamp"))
    # two appends: the log grows by files
    SK.append_events(e.where(F.col("event_type") == "view"), f"{folder}/events")
    SK.append_events(e.where(F.col("event_type") != "view"), f"{folder}/events")


@register("scan_catalog", with_views(["products"], """
SELECT item_id, product_name, category, brand, price, '' AS image_url, '' AS description, true AS in_stock FROM products"""))
def q_scan_catalog(spark, d):
    """A1: product and event tables read with their required columns checked and the optional ones defaulted."""
    folder = _folder(spark, "catalog")
    _write_catalog(spark, d, folder)
    products, _ = SC.scan_catalog(spark, f"{folder}/products", f"{folder}/events")
    return products


@register("scan_events", with_views(["ev"], """
SELECT event_id, user_id, item_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp FROM ev"""))
def q_scan_events(spark, d):
    """An event log appended to twice and scanned."""
    folder = _folder(spark, "log")
    _write_catalog(spark, d, folder)
    e = SC.scan_events(spark, f"{folder}/events")
    return e.select("event_id", "user_id", "item_id", "event_type", ts_text("timestamp").alias("timestamp"))


@register("scan_json_catalog", with_views(["products"], "SELECT item_id, product_name, category, price FROM products"))
def q_scan_json(spark, d):
    """A2: product lists, one JSON array a file, read with a schema."""
    p = X.products(spark, d).select("item_id", "product_name", "category", "price")
    files = -(-p.count() // 500)  # lists of about 500 products
    lists = p.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(files)).alias("file")).agg(
        F.to_json(F.collect_list(F.struct(*p.columns))).alias("value"))
    folder = _folder(spark, "json")
    lists.repartition(files, "file").write.partitionBy("file").text(folder)
    return SC.scan_json_catalog(spark, f"{folder}/file=*", p.schema)


@register("write_embeddings", with_views(["image_emb"], f"SELECT item_id, {vec_text_sql('embedding')} AS vector FROM image_emb"))
def q_write_embeddings(spark, d):
    """Vectors written and read back whole."""
    folder = _folder(spark, "vectors")
    SK.write_embeddings(X.image_emb(spark, d), folder)
    return spark.read.parquet(folder).select("item_id", vec_text("embedding").alias("vector"))


@register("export_events_csv", with_views(["ev"], """
SELECT CAST(event_id AS VARCHAR) AS event_id, user_id, item_id, event_type FROM ev"""))
def q_export_events(spark, d):
    """The log as CSV files with a header."""
    folder = _folder(spark, "csv")
    SK.export_events_csv(X.events(spark, d).select("event_id", "user_id", "item_id", "event_type"), folder)
    return spark.read.option("header", True).csv(folder)


@register("export_recommendations", with_views(["rev"], r"""
SELECT coalesce(nullif(regexp_replace(regexp_replace(user_id || ' #' || event_type, '[^A-Za-z0-9\-_@.+]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown_user')
         AS user_token, item_id, count(*)::VARCHAR AS n FROM rev GROUP BY ALL"""))
def q_export_recommendations(spark, d):
    """A10: lists by user token, in a bounded number of folders."""
    lists = X.rank_events(spark, d).groupBy(F.concat("user_id", F.lit(" #"), "event_type").alias("user_id"), "item_id").agg(
        F.count(F.lit(1)).alias("n"))
    folder = _folder(spark, "lists")
    SK.export_recommendations(lists, folder, buckets=16)
    return spark.read.option("header", True).csv(folder).select("user_token", F.col("item_id").cast("string").alias("item_id"),
                                                                F.col("n").cast("string").alias("n"))


@register("enrich_events", with_views(["ev"], """
SELECT event_id, user_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS event_date
FROM ev WHERE event_type <> 'time_spent'"""))
def q_enrich_events(spark, d):
    """Text times parsed, rows without one (here those of time_spent) dropped, the date added."""
    raw = X.events(spark, d).withColumn("event_time", F.when(
        F.col("event_type") == "time_spent", F.concat(F.lit("at "), F.col("item_id"))).otherwise(ts_text("ts")))
    e = A.enrich_events(raw.drop("ts"))
    return e.select("event_id", "user_id", ts_text("ts").alias("ts"), F.col("event_date").cast("string").alias("event_date"))
