"""Online co-cart boosts as batch jobs (K1-K5).

The reference updates an in-process store one event at a time. Here the same
state is derived for all users in one pass: each add_to_cart event pairs with
the user's previous <= 50 carted items (a bounded window frame, duplicates
kept), pairs are canonicalised (a <= b) and aggregated. ``ttl_seconds``
reproduces key expiry of the external-store mode: a user's list or a pair
idle longer than the TTL starts again from empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.scalars import hours_between
from shoplens.functions.weights import DECAY_PER_HOUR, ONLINE_ALPHA, ONLINE_HISTORY
from shoplens.operators.skew import keyed_cumsum, prior_rows
from shoplens.session import cut_lineage


def islands(df: DataFrame, key: list[str], ts: str, ttl_seconds: int | None, name: str) -> DataFrame:
    """Number the runs of ``key`` whose consecutive gaps are <= ttl_seconds.

    The previous row and the running count of breaks use the chunked frames of
    ``operators.skew``, so a key holding a large share of rows is split."""
    if ttl_seconds is None:
        return df.withColumn(name, F.lit(0))
    k = "_island_key"
    # the chunked frames read their input several times: cut lineage at each stage
    # so nested island steps do not multiply the plan
    d = cut_lineage(df.withColumn(k, F.concat_ws("\u0001", *[F.col(c).cast("string") for c in key])))
    d = cut_lineage(prior_rows(d, k, ts, "event_id", 1, F.col(ts), "_prev_ts"))
    gap = F.unix_micros(F.col(ts)) - F.unix_micros(F.try_element_at("_prev_ts", F.lit(1)))
    d = d.withColumn("_brk", F.when(gap > F.lit(ttl_seconds * 1_000_000), 1).otherwise(0)).drop("_prev_ts")
    d = keyed_cumsum(d, k, ts, "event_id", F.col("_brk"), name)
    return cut_lineage(d.drop(k, "_brk"))


def _last_island(df: DataFrame, key: list[str], isl: str) -> DataFrame:
    """Rows of each key's latest island (max as an aggregate, not a partition window)."""
    last = df.groupBy(*key).agg(F.max(isl).alias("_last_isl"))
    return df.join(last, key).where(F.col(isl) == F.col("_last_isl")).drop("_last_isl")


# K1 -------------------------------------------------------------------------
def user_recent_items(events: DataFrame, history: int = ONLINE_HISTORY,
                      ttl_seconds: int | None = None, as_of: Column | None = None) -> DataFrame:
    """Per user, the last ``history`` add_to_cart items (oldest first, repeats kept)."""
    carts = events.where(F.col("event_type") == "add_to_cart").select("event_id", "user_id", "item_id", "ts")
    carts = islands(carts, ["user_id"], "ts", ttl_seconds, "_isl")
    carts = _last_island(carts, ["user_id"], "_isl")
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    recent = carts.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= history)
    out = recent.groupBy("user_id").agg(
        F.max("ts").alias("last_ts"),
        F.transform(F.sort_array(F.collect_list(F.struct(-F.col("_rn"), F.col("item_id")))),
                    lambda s: s["item_id"]).alias("items"))
    if ttl_seconds is not None and as_of is not None:
        out = out.where((F.unix_micros(as_of) - F.unix_micros("last_ts")) <= ttl_seconds * 1_000_000)
    return out


# K2 / K3 --------------------------------------------------------------------
def co_cart_deltas(events: DataFrame, history: int = ONLINE_HISTORY,
                   ttl_seconds: int | None = None) -> DataFrame:
    """One row per pair increment: (item_a <= item_b, ts) for each add_to_cart
    event and each of the user's previous <= history carted items != the item."""
    carts = events.where(F.col("event_type") == "add_to_cart").select("event_id", "user_id", "item_id", "ts")
    if ttl_seconds is None:
        # skew-safe frame: a user holding a large share of carts is split in time chunks
        prior = prior_rows(carts, "user_id", "ts", "event_id", history, F.col("item_id"), "_prev")
    else:
        carts = islands(carts, ["user_id"], "ts", ttl_seconds, "_isl")
        carts = carts.withColumn("_ui", F.concat_ws("\u0001", "user_id", F.col("_isl").cast("string")))
        prior = prior_rows(carts, "_ui", "ts", "event_id", history, F.col("item_id"), "_prev").drop("_ui")
    return pair_increments(prior)


def pair_increments(prior: DataFrame) -> DataFrame:
    """(item_a <= item_b, ts, event_id) of each row's item and each other item in its list ``_prev``."""
    pairs = prior.select("event_id", "ts", "item_id", F.explode("_prev").alias("_p")).where(
        F.col("_p") != F.col("item_id"))
    return pairs.select(F.least("_p", "item_id").alias("item_a"), F.greatest("_p", "item_id").alias("item_b"),
                        "ts", "event_id")


def co_cart_weights(events: DataFrame, history: int = ONLINE_HISTORY, ttl_seconds: int | None = None,
                    as_of: Column | None = None) -> DataFrame:
    """(item_a, item_b, weight, last_updated) after replaying all events.

    With a TTL, a pair idle longer than the TTL restarts its weight, and pairs
    idle at ``as_of`` for longer than the TTL are gone.
    """
    d = co_cart_deltas(events, history, ttl_seconds)
    if ttl_seconds is not None:
        d = islands(d, ["item_a", "item_b"], "ts", ttl_seconds, "_pisl")
        d = _last_island(d, ["item_a", "item_b"], "_pisl")
    out = d.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).cast("double").alias("weight"),
                                            F.max("ts").alias("last_updated"))
    if ttl_seconds is not None and as_of is not None:
        out = out.where((F.unix_micros(as_of) - F.unix_micros("last_updated")) <= ttl_seconds * 1_000_000)
    return out


# K4 / K5 --------------------------------------------------------------------
def online_boost(carts: DataFrame, candidates: DataFrame, pairs: DataFrame, now: Column,
                 decay: float = DECAY_PER_HOUR) -> DataFrame:
    """Σ over cart items (a repeated item counts each time) of weight · decay^age_h.

    carts: (user_id, item_id[, quantity]); candidates: (user_id, item_id, ...).
    Output: candidates + online_boost (0 when no pair has weight > 0).
    """
    c = carts.select("user_id", F.col("item_id").alias("_cart_item"),
                     (F.col("quantity") if "quantity" in carts.columns else F.lit(1)).alias("_mult"))
    cand = candidates.select("user_id", F.col("item_id").alias("_cand"))
    p = pairs.where(F.col("weight") > 0).select("item_a", "item_b", "weight", "last_updated")
    j = (cand.join(c, "user_id")
         .withColumn("item_a", F.least("_cart_item", "_cand"))
         .withColumn("item_b", F.greatest("_cart_item", "_cand"))
         .where(F.col("_cart_item") != F.col("_cand"))
         .join(p, ["item_a", "item_b"]))
    age = F.abs(hours_between(F.col("last_updated"), now))
    contrib = F.col("_mult") * F.col("weight") * F.pow(F.lit(decay), age)
    boost = j.groupBy("user_id", "_cand").agg(F.sum(contrib).alias("online_boost"))
    return (candidates.join(boost.withColumnRenamed("_cand", "item_id"), ["user_id", "item_id"], "left")
            .withColumn("online_boost", F.coalesce(F.col("online_boost"), F.lit(0.0))))


def blend_scores(carts: DataFrame, candidates: DataFrame, pairs: DataFrame, now: Column,
                 alpha: float = ONLINE_ALPHA, decay: float = DECAY_PER_HOUR) -> DataFrame:
    """(user_id, item_id, model_score, online_boost, blended_score, rank by blended desc)."""
    b = online_boost(carts, candidates, pairs, now, decay)
    b = b.withColumn("blended_score", F.col("model_score") + F.lit(alpha) * F.col("online_boost"))
    w = Window.partitionBy("user_id").orderBy(F.desc("blended_score"), F.asc("item_id"))
    return b.withColumn("rank", F.row_number().over(w))
