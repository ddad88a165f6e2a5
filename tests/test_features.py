"""Features of a few users read only those users' rows, whole attributes whatever keys repeat or are null."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.operators import checkout as K
from shoplens.operators import features as FE
from shoplens.operators import profiles as P

NOW = dt.datetime(2024, 1, 9)


def _tables(spark):
    events = spark.createDataFrame(
        [("a", "1", "purchase", NOW), ("a", "2", "click", NOW), ("b", "1", "view", NOW - dt.timedelta(days=3)), ("c", "2", "click", NOW),
         (None, "1", "click", NOW)], "user_id string, item_id string, event_type string, ts timestamp")
    products = spark.createDataFrame(
        [("1", "x", "p", 10.0, 0.5, 0.1), ("2", "y", "q", 20.0, 1.0, 0.2), ("2", "y", "r", 30.0, 1.0, 0.2), ("3", None, None, None, 0.0, 0.0)],
        "item_id string, category string, brand string, price double, popularity_score double, ctr_score double")
    vectors = spark.createDataFrame([(str(i), [1.0, float(i)]) for i in (1, 2, 3)], "item_id string, embedding array<double>")
    return events, products, vectors


def test_repeated_unknown_and_null_keys(spark):
    cands = spark.createDataFrame([("a", "1", 0.5), ("a", "2", 0.4), ("z", "9", 0.3), (None, "3", 0.2), ("b", None, 0.1)],
                                  "user_id string, item_id string, similarity_score double")
    got = FE.build_features(cands, *_tables(spark), recency_days=7)
    rows = sorted((str(r["user_id"]), str(r["item_id"]), r["item_price"], r["user_avg_spend"], r["user_preferred_category_enc"], r["item_category_enc"],
                   r["user_days_since_last_interaction"], r["user_interacted_brand"], r["same_category_as_pref"]) for r in got.collect())
    # codes: unknown 0, x 1, y 2; the catalog's mean price is 20; item 2 stands twice in it and in its ranking
    assert rows == [("None", "3", 0.0, 20.0, 0, -1, 999, 0, 0), ("a", "1", 10.0, 10.0, 1, 1, 0, 1, 1), *[("a", "2", 20.0, 10.0, 1, 2, 0, 1, 0)] * 2,
                    *[("a", "2", 30.0, 10.0, 1, 2, 0, 1, 0)] * 2, ("b", "None", 0.0, 10.0, 1, 0, 3, 0, 0), ("z", "9", 0.0, 20.0, 0, 0, 999, 0, 1)]


def test_only_the_candidates_users_are_read(spark, monkeypatch):
    events, products, vectors = _tables(spark)
    kept = []
    plain = P.cut_lineage
    monkeypatch.setattr(P, "cut_lineage", lambda df: kept.append(df) or plain(df))
    cands = spark.createDataFrame([("b", "2", 0.5)], "user_id string, item_id string, similarity_score double")
    row = FE.build_features(cands.dropDuplicates(), events, products.dropDuplicates(["item_id"]), vectors, recency_days=7).first()
    assert row["user_days_since_last_interaction"] == 3  # the latest time is the whole log's
    pairs = next(df for df in kept if "n_recent" in df.columns)
    assert {r["user_id"] for r in pairs.select("user_id").distinct().collect()} == {"b"}


def test_chain_reads_its_carts_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    carts = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("c", "3", 1)], "cart_id string, item_id string, quantity int") \
        .withColumn("item_id", F.udf(count, T.StringType()).asNondeterministic()("item_id"))

    def serve(*names):
        return lambda c: c.where(F.col("cart_id").isin(*names)).select("cart_id", "item_id", F.lit(1).alias("rank"), F.lit(1.0).alias("similarity_score"))

    out = K.checkout_fallback_chain(carts, [("one", serve("a")), ("two", serve("a", "b")), ("three", serve("c"))])
    assert sorted((r["cart_id"], r["item_id"], r["strategy"]) for r in out.collect()) == [("a", "1", "one"), ("b", "2", "two"), ("c", "3", "three")]
    assert seen.value == 3
