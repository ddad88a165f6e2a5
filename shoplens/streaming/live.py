"""Structured Streaming operators (A8, K1/K2 stream, K6-K9).

Each builder takes a streaming DataFrame in the events-view shape and returns
a streaming DataFrame; ``run_available`` drives a query to completion with
``availableNow`` into a table in the shared folder. Every micro-batch writes
under its own id with ``foreachBatch``, so a batch that is run again after a
failure changes nothing; with a folder of its own a stream goes on after a
restart where it ended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.functions.weights import ONLINE_HISTORY
from shoplens.operators.online import islands, pair_increments
from shoplens.operators.skew import prior_rows
from shoplens.session import cut_lineage, ensure_checkpoint_dir
from shoplens.sources.tables import VersionedTable

RAW_EVENT_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType()),
])
EVENT_MESSAGE_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("item_id", T.StringType()),
    T.StructField("event_type", T.StringType()), T.StructField("time_spent_seconds", T.DoubleType()),
    T.StructField("timestamp", T.StringType()), T.StructField("event_id", T.LongType()),
])


# A8 -------------------------------------------------------------------------
def read_event_files(spark: SparkSession, directory: str, glob: str = "*.parquet",
                     schema: T.StructType = RAW_EVENT_SCHEMA, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(directory)


def read_event_topic(spark: SparkSession, servers: str, topic: str = "event_logs") -> DataFrame:
    """JSON event messages from a Kafka topic (needs the Kafka connector on the classpath)."""
    return event_messages(spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
                          .option("subscribe", topic).load())


def event_messages(raw: DataFrame) -> DataFrame:
    """Events from topic rows (value, partition, offset). A message without an
    event_id gets its place in the topic as one, so a re-read gives the same id."""
    msg = F.from_json(F.col("value").cast("string"), EVENT_MESSAGE_SCHEMA)
    place = F.shiftleft(F.col("partition").cast("long"), 44) + F.col("offset")
    return raw.select(msg.alias("m"), place.alias("place")).select(
        F.coalesce("m.event_id", "place").alias("event_id"), "m.user_id", "m.item_id", "m.event_type",
        "m.time_spent_seconds", F.to_timestamp("m.timestamp").alias("ts"))


# K6 -------------------------------------------------------------------------
def live_kpis(events: DataFrame, window: str = "1 day", slide: str | None = None,
              watermark: str = "1 hour") -> DataFrame:
    et = F.col("event_type")
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return (events.withWatermark("ts", watermark).groupBy(w.alias("w"))
            .agg(F.count_if(et == "view").alias("views"), F.count_if(et == "click").alias("clicks"),
                 F.count_if(et == "add_to_cart").alias("add_to_cart"))
            .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                    "views", "clicks", "add_to_cart"))


# K7 -------------------------------------------------------------------------
def live_sessions(events: DataFrame, gap: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Sessions of the users. Each task first merges its own rows into sessions, so
    that of a user with very many events only sessions reach one task."""
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return (events.withWatermark("ts", watermark).groupBy("user_id", F.session_window("ts", gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("n_events"))
            .select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                    "n_events"))


# K8 -------------------------------------------------------------------------
def dedup_late(events: DataFrame, watermark: str = "1 hour", key: str = "event_id") -> DataFrame:
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


# K9 -------------------------------------------------------------------------
def live_popularity(events: DataFrame) -> DataFrame:
    return (events.where(F.col("event_type").isin("click", "view")).groupBy("item_id")
            .agg(F.count(F.lit(1)).alias("interactions")))


# driving ----------------------------------------------------------------------
def _fresh_dir(spark: SparkSession, name: str) -> str:
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/stream-{name}-{uuid.uuid4().hex[:12]}"


def _start_table(spark: SparkSession, folder: str, schema: T.StructType) -> None:
    """An empty table of the schema: reading it needs no first batch."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/_batch=-1")


def write_batch(batch: DataFrame, folder: str, batch_id: int) -> None:
    batch.write.mode("overwrite").parquet(f"{folder}/_batch={batch_id}")


def run_available(stream: DataFrame, name: str, keys: list[str] | None = None,
                  output_mode: str = "append", folder: str | None = None, buckets: int = 16) -> DataFrame:
    """Run ``stream`` over all currently available input and return its result table.

    append: rows are written as produced, each micro-batch into a folder of its
    id. update/complete: the rows are upserts of a table with one row for each
    value of ``keys`` (see :class:`VersionedTable`), so a reader reads one
    version; a batch rewrites only the ``buckets`` it touches. A stream with a ``folder`` goes on there where its last run ended.
    """
    spark = stream.sparkSession
    base = folder or _fresh_dir(spark, name)
    if keys:
        table = VersionedTable(spark, f"{base}/table", stream.schema, keys, buckets)
        step = lambda batch, i: table.upsert(batch, i)
    else:
        _start_table(spark, f"{base}/out", stream.schema)
        step = lambda batch, i: write_batch(batch, f"{base}/out", i)
    q = (stream.writeStream.outputMode(output_mode).foreachBatch(step)
         .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start())
    q.awaitTermination()
    return table.read() if keys else spark.read.parquet(f"{base}/out").drop("_batch")


# K1 / K2 / K3 -----------------------------------------------------------------
def run_co_cart(events: DataFrame, name: str, history: int = ONLINE_HISTORY, ttl_seconds: int | None = None,
                as_of: Column | None = None, folder: str | None = None) -> DataFrame:
    """Pair weights (item_a <= item_b, weight, last_updated) after all available events.

    Rows of a micro-batch are ordered by (ts, event_id); before them stand the
    user's last ``history`` carted items of the earlier batches, which must come
    in the order of time. With a TTL a user's list, and a pair's weight, that was
    idle for longer starts anew, as in the batch form; pairs idle at ``as_of``
    are left out.

    The state is two tables of bounded rows, one list a user and one weight a
    pair. A batch rewrites only the buckets of the users and pairs it holds.
    Frames inside a batch are the chunked ones of ``operators.skew``, so a user
    with a large share of a batch is split. With a ``folder`` a later run goes on
    where this one ended, and a batch that is run again changes nothing.
    """
    spark = events.sparkSession
    base = folder or _fresh_dir(spark, name)
    kind = {f.name: f.dataType for f in events.schema.fields}
    items = T.ArrayType(kind["item_id"])
    lists = VersionedTable(spark, f"{base}/lists", T.StructType([
        T.StructField("user_id", kind["user_id"]), T.StructField("items", items), T.StructField("last_ts", kind["ts"])]), ["user_id"])
    pairs = VersionedTable(spark, f"{base}/pairs", T.StructType([
        T.StructField("item_a", kind["item_id"]), T.StructField("item_b", kind["item_id"]),
        T.StructField("weight", T.DoubleType()), T.StructField("last_updated", kind["ts"])]), ["item_a", "item_b"])
    none = F.array().cast(items)

    def last(x: Column) -> Column:
        return F.slice(x, F.greatest(F.size(x) - history + 1, F.lit(1)), history)

    def goes_on(since: str, first: str) -> Column:
        """Whether the state from before still counts at the batch's first row."""
        if ttl_seconds is None:
            return F.col(since).isNotNull()
        return F.coalesce(F.unix_micros(F.col(first)) - F.unix_micros(F.col(since)) <= F.lit(ttl_seconds * 1_000_000), F.lit(False))

    def step(batch: DataFrame, batch_id: int) -> None:
        spans = islands(batch.persist(), ["user_id"], "ts", ttl_seconds, "_isl")
        spans = spans.withColumn("_span", F.struct("user_id", "_isl").cast("string"))
        ends = spans.groupBy(F.col("user_id").alias("_user")).agg(F.min("ts").alias("_first"), F.max("_isl").alias("_last_isl"))
        known = lists.before(batch_id).select(F.col("user_id").alias("_known"), F.col("items").alias("_items"), F.col("last_ts").alias("_since"))
        state = cut_lineage(ends.join(known, F.col("_user").eqNullSafe(F.col("_known")), "left").select(
            "_user", "_last_isl", F.when(goes_on("_since", "_first"), F.col("_items")).otherwise(none).alias("_before")))
        rows = prior_rows(spans, "_span", "ts", "event_id", history, F.col("item_id"), "_prev")
        rows = rows.join(state, F.col("user_id").eqNullSafe(F.col("_user")))
        # what stood before the batch stands before its first run of rows only
        rows = cut_lineage(rows.withColumn("_prev", F.when(F.col("_isl") == 0, last(F.concat("_before", F.col("_prev"))))
                                           .otherwise(F.col("_prev"))))
        pairs.upsert(pair_batch(pair_increments(rows)), batch_id, add_pairs)
        w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
        newest = rows.withColumn("_r", F.row_number().over(w)).where("_r = 1")
        lists.upsert(newest.select("user_id", last(F.concat("_prev", F.array("item_id"))).alias("items"),
                                   F.col("ts").alias("last_ts")), batch_id)
        batch.unpersist()

    def pair_batch(found: DataFrame) -> DataFrame:
        """Of each pair the weight of its last run in the batch, when that began, and whether it was the first."""
        runs = islands(found, ["item_a", "item_b"], "ts", ttl_seconds, "_run")
        per_run = runs.groupBy("item_a", "item_b", "_run").agg(
            F.count("*").cast("double").alias("weight"), F.max("ts").alias("last_updated"), F.min("ts").alias("_first"))
        return per_run.groupBy("item_a", "item_b").agg(
            F.max_by(F.struct("weight", "last_updated", "_first", (F.col("_run") == 0).alias("_only")), "_run").alias("m")) \
            .select("item_a", "item_b", "m.*")

    def add_pairs(old: DataFrame, new: DataFrame) -> DataFrame:
        known = old.select(*[F.col(c).alias(f"_{c}") for c in ("item_a", "item_b", "weight", "last_updated")])
        same = (F.col("item_a") == F.col("_item_a")) & (F.col("item_b") == F.col("_item_b"))
        more = F.when(F.coalesce("_only", F.lit(False)) & goes_on("_last_updated", "_first"), F.col("_weight")).otherwise(F.lit(0.0))
        return known.join(new, same, "full").select(
            F.coalesce("item_a", "_item_a").alias("item_a"), F.coalesce("item_b", "_item_b").alias("item_b"),
            F.when(F.col("item_a").isNull(), F.col("_weight")).otherwise(F.col("weight") + more).alias("weight"),
            F.coalesce("last_updated", "_last_updated").alias("last_updated"))

    carts = events.where(F.col("event_type") == "add_to_cart").select("event_id", "user_id", "item_id", "ts", "event_type")
    q = (carts.writeStream.foreachBatch(step).option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    out = pairs.read()
    if ttl_seconds is not None and as_of is not None:
        out = out.where(F.unix_micros(as_of) - F.unix_micros("last_updated") <= ttl_seconds * 1_000_000)
    return out
