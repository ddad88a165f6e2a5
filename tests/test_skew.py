"""The chunked frame equals the plain window frame, also for a hot key."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from shoplens.operators.skew import prior_rows
from shoplens.sources import fixtures as X

from .conftest import SF_SMALL


def test_prior_rows_chunked_equals_window_with_hot_user(spark):
    ev = X.events(spark, SF_SMALL)
    # a third of all users collapse into one hot user
    hot = ev.withColumn("user_id", F.when(F.pmod(F.hash("user_id"), F.lit(3)) == 0, F.lit("HOT"))
                        .otherwise(F.col("user_id")))
    want = hot.withColumn("_prior", F.collect_list("item_id").over(
        Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-5, -1)))
    for chunks in (1, 7, 60):
        got = prior_rows(hot, "user_id", "ts", "event_id", 5, F.col("item_id"), "_prior",
                         chunks=chunks)
        a = got.select("event_id", "_prior")
        b = want.select("event_id", "_prior")
        assert a.count() == b.count()
        assert a.exceptAll(b).count() == 0


def test_keyed_cumsum_chunked_equals_window(spark):
    from shoplens.operators.skew import keyed_cumsum
    ev = X.events(spark, SF_SMALL).withColumn(
        "user_id", F.when(F.pmod(F.hash("user_id"), F.lit(3)) == 0, F.lit("HOT")).otherwise(F.col("user_id")))
    val = (F.col("event_type") == "click").cast("int")
    want = ev.withColumn("_cs", F.sum(val).over(
        Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)))
    got = keyed_cumsum(ev, "user_id", "ts", "event_id", val, "_cs", chunks=23)
    a, b = got.select("event_id", "_cs"), want.select("event_id", "_cs")
    assert a.count() == b.count() and a.exceptAll(b).count() == 0


def test_burst_of_equal_times_is_spread_over_chunks(spark):
    from shoplens.operators.skew import with_chunks
    burst = spark.range(100_000).selectExpr("'HOT' as user_id", "timestamp'2024-01-01 00:00:00' as ts", "id as event_id")
    rest = spark.range(1000).selectExpr("concat('u', id % 50) as user_id", "timestamp_seconds(1704067200 + id) as ts", "100000 + id as event_id")
    sizes = [r["count"] for r in with_chunks(burst.unionByName(rest), "user_id", "ts", "event_id", 40).groupBy("_chunk").count().collect()]
    assert len(sizes) >= 35 and max(sizes) < 3 * 101_000 / 40
    got = prior_rows(burst, "user_id", "ts", "event_id", 3, F.col("event_id"), "_p", chunks=16)
    bad = got.where(F.col("_p") != F.sequence(F.greatest(F.col("event_id") - 3, F.lit(0)), F.col("event_id") - 1)).where("event_id > 0")
    assert bad.count() == 0


def test_sessions_of_a_hot_user(spark):
    from shoplens.operators.sequences import activity_sessions, login_sessions
    ev = spark.range(30_000).selectExpr(
        "id as event_id", "if(id % 3 = 0, 'HOT', concat('u', id % 70)) as user_id",
        "timestamp_seconds(1704067200 + (id * 7919) % 5000000) as ts")
    plain = ev.groupBy("user_id", F.session_window("ts", "30 minutes").alias("s")).agg(F.count("*").alias("n_events")) \
        .select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n_events")
    got = activity_sessions(ev, 1800)
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0
    logins = ev.select(F.col("event_id").cast("string").alias("session_id"), "user_id", F.col("ts").alias("started_at"))
    w = Window.partitionBy("user_id").orderBy("started_at", "session_id")
    want = logins.withColumn("ended_at", F.lead("started_at").over(w)).withColumn("is_active", F.col("ended_at").isNull())
    got = login_sessions(logins)
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    ends = logins.where("user_id = 'HOT'").limit(50).select("session_id", F.expr("started_at + interval 1 second").alias("ended_at"))
    assert login_sessions(logins, ends).where("is_active").count() <= login_sessions(logins).where("is_active").count()
