"""User profiles, item popularity, encoders.

Every statistic is one grouped aggregate over the whole event log; global
scalars (max time, max count) are scalar subqueries, quantiles are found by
narrowing histograms, and global
orderings run on the (small) set of distinct values with a range-partitioned
running sum, never a one-partition window over events.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.scalars import brand_from_name
from shoplens.functions.weights import LABEL_WEIGHTS, weight_of
from shoplens.operators.analytics import global_cumsum, global_row_number
from shoplens.session import cut_lineage

PROFILE_WEIGHTS = {k: v + 1 for k, v in LABEL_WEIGHTS.items()}  # view=1 ... purchase=4


# D8 / D9 / B10 --------------------------------------------------------------
def item_event_stats(products: DataFrame, events: DataFrame) -> DataFrame:
    """popularity_score = count / max count over the catalog; ctr = clicks / (views+clicks)."""
    et = F.col("event_type")
    counts = events.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(et == "click").alias("_clicks"),
        F.count_if(et.isin("view", "click")).alias("_views"))
    j = products.select("item_id").join(counts, "item_id", "left").fillna(0, ["_n", "_clicks", "_views"])
    max_n = j.select(F.max("_n")).scalar()
    return j.select(
        "item_id",
        F.when(max_n > 0, F.col("_n") / max_n).otherwise(F.lit(0.0)).alias("popularity_score"),
        F.when(F.col("_views") > 0, F.col("_clicks") / F.col("_views")).otherwise(F.lit(0.0))
        .alias("ctr_score"))


def prepare_products(products: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Conform a catalog for the ranker and attach popularity / ctr scores."""
    p = products
    cols = set(p.columns)
    if "item_id" not in cols:
        if "id" not in cols:
            raise ValueError("products must include item_id or id")
        p = p.withColumn("item_id", F.col("id"))
    p = p.withColumn("item_id", F.col("item_id").cast("string"))
    if "product_name" not in cols:
        p = p.withColumn("product_name", F.col("name") if "name" in cols else F.col("item_id"))
    p = p.withColumn("category", F.coalesce(F.col("category").cast("string"), F.lit("unknown"))
                     if "category" in cols else F.lit("unknown"))
    brand = F.col("brand").cast("string") if "brand" in cols else brand_from_name("product_name")
    p = p.withColumn("brand", F.coalesce(brand, F.lit("unknown")))
    p = p.withColumn("price", F.coalesce(F.col("price").cast("string").try_cast("double"), F.lit(0.0))
                     if "price" in cols else F.lit(0.0))
    if "image_url" not in cols:
        p = p.withColumn("image_url", F.lit(""))
    if "in_stock" not in cols:
        p = p.withColumn("in_stock", F.lit(True))
    p = p.drop("popularity_score", "ctr_score")
    if events is None:
        return p.withColumn("popularity_score", F.lit(0.0)).withColumn("ctr_score", F.lit(0.0))
    return p.join(item_event_stats(p, events), "item_id", "left")


# D7 -------------------------------------------------------------------------
def weighted_mode(df: DataFrame, key: str, value: str, weight: str, name: str | None = None) -> DataFrame:
    """Per key, the non-null value with the largest Σweight (ties -> smallest value)."""
    name = name or f"mode_{value}"
    sums = (df.where(F.col(value).isNotNull()).groupBy(key, value)
            .agg(F.sum(weight).alias("_w")))
    return sums.groupBy(key).agg(
        F.min_by(F.col(value), F.struct(-F.col("_w"), F.col(value))).alias(name))


# D6 -------------------------------------------------------------------------
def half_even_cents_mean(total_cents: str, n: str) -> Column:
    """Mean of cent amounts rounded half-even to whole cents, in exact integer math.

    Averaging money as doubles makes .xx5 ties depend on summation order;
    integer cents make the result independent of partitioning.
    """
    s, c = F.col(total_cents), F.col(n)
    rem = F.pmod(s, c)
    base = ((s - rem) / c).cast("long")
    up = (rem * 2 > c) | ((rem * 2 == c) & (F.pmod(base, F.lit(2)) == 1))
    q = base + F.when(up, F.lit(1)).otherwise(F.lit(0))
    return F.when(c > 0, q / F.lit(100.0))


# D6 -------------------------------------------------------------------------
def interactions(events: DataFrame, recency_days: int = 90, users: DataFrame | None = None) -> DataFrame:
    """(user_id, item_id, event_type, n, n_recent, last_ts, now): one aggregate of the log, written once.

    Profiles, brand histories and context vectors are derived from it, so the
    log is scanned once for all of them; ``now`` is the log's latest time and
    n_recent counts events since ``now`` - recency_days. With ``users`` only their rows are kept.
    """
    now = events.select(F.max("ts")).scalar()
    cutoff = now - F.make_interval(days=F.lit(recency_days))
    pairs = events.groupBy("user_id", "item_id", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ts") >= cutoff).alias("n_recent"), F.max("ts").alias("last_ts"))
    if users is not None:
        pairs = pairs.join(users.select("user_id").distinct(), "user_id", "left_semi")
    return cut_lineage(pairs.withColumn("now", now))


def user_profiles(events: DataFrame, products: DataFrame, recency_days: int = 90) -> DataFrame:
    """preferred_category / preferred_brand (weighted mode over all history),
    avg_spend (mean purchase price, else mean price of all events; half-even to 2),
    recent_activity_count (events since global max - recency_days),
    days_since_last_interaction (whole days from the user's last to the global max)."""
    return profiles_of(interactions(events, recency_days), products)


def profiles_of(pairs: DataFrame, products: DataFrame) -> DataFrame:
    """:func:`user_profiles` from :func:`interactions`."""
    prod = products.select("item_id", "category", "brand", "price")
    m = pairs.join(prod, "item_id", "left").withColumn(
        "weight", weight_of(F.col("event_type"), PROFILE_WEIGHTS, 1) * F.col("n"))
    m = cut_lineage(m)  # read for the totals, the categories and the brands
    is_p = F.col("event_type") == "purchase"
    cents = F.round(F.col("price") * 100).cast("long")
    known = F.when(cents.isNotNull(), F.col("n"))
    base = m.groupBy("user_id").agg(
        F.sum(F.when(is_p, cents * F.col("n"))).alias("_ps"), F.coalesce(F.sum(F.when(is_p, known)), F.lit(0)).alias("_pn"),
        F.sum(cents * F.col("n")).alias("_as"), F.coalesce(F.sum(known), F.lit(0)).alias("_an"),
        F.sum("n_recent").alias("recent_activity_count"),
        F.max("last_ts").alias("_last"), F.first("now").alias("_now"))
    days = F.floor((F.unix_micros("_now") - F.unix_micros("_last")) / F.lit(86_400_000_000))
    base = base.select(
        "user_id",
        F.coalesce(half_even_cents_mean("_ps", "_pn"), half_even_cents_mean("_as", "_an"))
        .alias("avg_spend"),
        "recent_activity_count",
        F.coalesce(days, F.lit(999)).cast("long").alias("days_since_last_interaction"))
    cat = weighted_mode(m, "user_id", "category", "weight", "preferred_category")
    brand = weighted_mode(m, "user_id", "brand", "weight", "preferred_brand")
    return base.join(cat, "user_id", "left").join(brand, "user_id", "left")


# D12 / D13 ------------------------------------------------------------------
def last_event_per_user(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max("ts").alias("last_ts"))


BUCKETS = 4096


def order_statistic(df: DataFrame, rank: int, buckets: int = BUCKETS) -> tuple[float, int]:
    """The value at a 0-based rank of a one-column frame of finite doubles, and how many rows are at most it.

    Each round counts the rows between two bounds in equal buckets (a partial
    aggregate of at most ``buckets`` + 1 rows) and goes on with the bucket that
    holds the rank, until that bucket has one value. No task and no buffer
    holds the column, however many distinct values it has.
    """
    x = F.col(df.columns[0])
    part, bucket, below = df, F.lit(0), 0
    while True:
        for r in part.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")) \
                .orderBy("b").collect():
            if below + r["n"] > rank:
                break
            below += r["n"]
        else:
            raise IndexError(f"no row has rank {rank}")
        lo, hi = r["lo"], r["hi"]
        if lo == hi:
            return lo, below + r["n"]
        part = df.where((x >= lo) & (x <= hi))
        # halves, so that the width stays finite; equal values share a bucket and buckets keep the order
        bucket = F.floor((x / 2 - lo / 2) / (hi / 2 - lo / 2) * buckets)


def quantile(df: DataFrame, col: Column | str, q: float) -> Column:
    """Exact linear-interpolated quantile of the finite values as a literal; null without any."""
    c = (F.col(col) if isinstance(col, str) else col).cast("double")
    values = cut_lineage(df.select(c.alias("x")).where(F.abs("x") < float("inf")))
    n = values.count()
    if not n:
        return F.lit(None).cast("double")
    at = q * (n - 1)
    low, high = math.floor(at), math.ceil(at)
    a, upto = order_statistic(values, low)
    b = a if high < upto else values.where(F.col("x") > a).agg(F.min("x")).first()[0]
    return F.lit(a if a == b else (high - at) * a + (at - low) * b)


# D14 ------------------------------------------------------------------------
def labels(events: DataFrame) -> DataFrame:
    """(user_id, item_id, label = max event weight over all history)."""
    return (events.withColumn("_w", weight_of(F.col("event_type"), LABEL_WEIGHTS, 0))
            .groupBy("user_id", "item_id").agg(F.max("_w").cast("int").alias("label")))


def attach_labels(pairs: DataFrame, events: DataFrame) -> DataFrame:
    return pairs.join(labels(events), ["user_id", "item_id"], "left").fillna(0, ["label"])


# E1 -------------------------------------------------------------------------
def pct_rank(df: DataFrame, col: str, name: str) -> DataFrame:
    """pandas ``rank(pct=True)``: average rank of ties / non-null count; NULL -> 0.

    Ranks are computed on the distinct values (with multiplicities) and joined
    back, so the only global ordering is over distinct values.
    """
    vals = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_cnt"))
    total = vals.select(F.sum("_cnt")).scalar()
    below = global_cumsum(vals, [F.col(col)], F.col("_cnt"), "_below", inclusive=False)
    ranked = below.select(
        F.col(col).alias("_v"),
        ((F.col("_below") + (F.col("_cnt") + 1) / F.lit(2.0)) / total).alias(name))
    return (df.join(ranked, df[col].eqNullSafe(ranked["_v"]), "left").drop("_v")
            .withColumn(name, F.coalesce(F.col(name), F.lit(0.0))))


# E9 -------------------------------------------------------------------------
def label_encoder(values: DataFrame, col: str) -> DataFrame:
    """(value, code): 0-based position in sorted distinct(values with NULL->'unknown') ∪ {'unknown'}."""
    vocab = (values.select(F.coalesce(F.col(col).cast("string"), F.lit("unknown")).alias("value"))
             .unionByName(values.sparkSession.range(1).select(F.lit("unknown").alias("value")))
             .distinct())
    coded = global_row_number(vocab, [F.col("value")], "_rn")
    return coded.select("value", (F.col("_rn") - 1).cast("int").alias("code"))


def encode(df: DataFrame, col: str, encoder: DataFrame, name: str) -> DataFrame:
    """Code of ``col`` (unseen or NULL -> -1)."""
    enc = encoder.select(F.col("value").alias("_ev"), F.col("code").alias(name))
    return (df.join(enc, df[col] == enc["_ev"], "left").drop("_ev")
            .withColumn(name, F.coalesce(F.col(name), F.lit(-1))))


# E10 ------------------------------------------------------------------------
def index_maps(products: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """item idx 1..N (item_id order); category/brand idx: 'unknown'=1, others sorted from 2; 0 = pad."""
    items = global_row_number(products.select("item_id").distinct(), [F.col("item_id")], "item_idx")

    def vocab(col):
        v = (products.select(F.coalesce(F.col(col).cast("string"), F.lit("unknown")).alias(col))
             .where(F.col(col) != "unknown").distinct())
        coded = global_row_number(v, [F.col(col)], "_rn").select(col, (F.col("_rn") + 1).alias(f"{col}_idx"))
        unk = products.sparkSession.range(1).select(F.lit("unknown").alias(col), F.lit(1).cast("long")
                                                   .alias(f"{col}_idx"))
        return coded.unionByName(unk)

    return items, vocab("category"), vocab("brand")


# C10 ------------------------------------------------------------------------
def user_brand_history(events: DataFrame, products: DataFrame) -> DataFrame:
    """Distinct (user_id, brand) over any event; NULL brands dropped."""
    return (events.select("user_id", "item_id").distinct()
            .join(products.select("item_id", "brand"), "item_id")
            .where(F.col("brand").isNotNull()).select("user_id", "brand").distinct())
