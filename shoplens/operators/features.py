"""Ranking features, labels, training rows and negative sampling.

All per-(user, candidate) features come from joins of per-user and per-item
tables built once for the whole population; nothing loops over users.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.weights import RECENCY_DAYS
from shoplens.operators.profiles import (attach_labels, encode, interactions, label_encoder, pct_rank, profiles_of,
                                         user_brand_history)
from shoplens.operators.vectors import context_vectors_of, pair_cosines

# --- fixed values (must equal the reference): feature order ------------------
FEATURE_COLUMNS = [
    "user_preferred_category_enc",
    "user_preferred_brand_enc",
    "user_avg_spend",
    "user_recent_activity_count",
    "user_days_since_last_interaction",
    "item_category_enc",
    "item_brand_enc",
    "item_price",
    "item_popularity_score",
    "item_ctr_score",
    "item_popularity_rank",
    "sim_to_cart",
    "sim_to_click",
    "retrieval_similarity",
    "same_category_as_pref",
    "same_brand_as_pref",
    "price_diff_from_avg_spend",
    "price_ratio_to_avg",
    "user_interacted_brand",
]
# ------------------------------------------------------------------------------


def build_features(cands: DataFrame, events: DataFrame, products: DataFrame, embeddings: DataFrame,
                   recency_days: int = RECENCY_DAYS, extra=None) -> DataFrame:
    """(user_id, item_id, *FEATURE_COLUMNS) for every candidate row.

    ``cands``: user_id, item_id, similarity_score. ``products`` must carry
    popularity_score / ctr_score (see ``prepare_products``). Unknown users get
    the reference defaults ('unknown', mean catalog price, 0, 999); catalog
    misses get 'unknown' and zeros; a NULL text value is encoded as -1.
    ``extra``: optional ``DataFrame -> DataFrame`` hook adding columns (L1).
    """
    cat_enc = label_encoder(products, "category")
    brand_enc = label_encoder(products, "brand")
    pairs = interactions(events, recency_days, cands)  # the one scan of the log
    prof = profiles_of(pairs, products).withColumn("_has_prof", F.lit(True))
    mean_price = products.select(F.avg("price")).scalar()
    ranked = pct_rank(products.select("item_id", "popularity_score"), "popularity_score", "popularity_rank")
    items = (products.select("item_id", "category", "brand", "price", "popularity_score", "ctr_score")
             .join(ranked.select("item_id", "popularity_rank"), "item_id", "left")
             .withColumn("_in_cat", F.lit(True)))
    ctx = context_vectors_of(pairs, embeddings, "n_recent")
    brands = user_brand_history(pairs, products).select(
        F.col("user_id").alias("_ub_user"), F.col("brand").alias("_ub"), F.lit(1).alias("_ub_hit"))

    c = pair_cosines(cands.select("user_id", "item_id", "similarity_score"), ctx, embeddings,
                     {"cart_vec": "sim_to_cart", "click_vec": "sim_to_click"})
    j = c.join(prof, "user_id", "left").join(items, "item_id", "left")
    has_prof = F.coalesce(F.col("_has_prof"), F.lit(False))
    in_cat = F.coalesce(F.col("_in_cat"), F.lit(False))
    j = j.select(
        "user_id", "item_id", "similarity_score",
        F.when(has_prof, F.coalesce(F.col("preferred_category"), F.lit("None"))).otherwise(F.lit("unknown"))
        .alias("_pref_cat"),
        F.when(has_prof, F.coalesce(F.col("preferred_brand"), F.lit("None"))).otherwise(F.lit("unknown"))
        .alias("_pref_brand"),
        F.when(has_prof, F.col("avg_spend")).otherwise(F.lit(mean_price)).alias("user_avg_spend"),
        F.when(has_prof, F.col("recent_activity_count")).otherwise(F.lit(0)).cast("long")
        .alias("user_recent_activity_count"),
        F.when(has_prof, F.col("days_since_last_interaction")).otherwise(F.lit(999)).cast("long")
        .alias("user_days_since_last_interaction"),
        F.when(in_cat, F.coalesce(F.col("category"), F.lit("nan"))).otherwise(F.lit("unknown")).alias("_item_cat"),
        F.when(in_cat, F.coalesce(F.col("brand"), F.lit("nan"))).otherwise(F.lit("unknown")).alias("_item_brand"),
        F.when(in_cat, F.coalesce(F.col("price"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("item_price"),
        F.when(in_cat, F.coalesce(F.col("popularity_score"), F.lit(0.0))).otherwise(F.lit(0.0))
        .alias("item_popularity_score"),
        F.when(in_cat, F.coalesce(F.col("ctr_score"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("item_ctr_score"),
        F.when(in_cat, F.coalesce(F.col("popularity_rank"), F.lit(0.0))).otherwise(F.lit(0.0))
        .alias("item_popularity_rank"),
        "sim_to_cart", "sim_to_click",
    )
    j = encode(j, "_pref_cat", cat_enc, "user_preferred_category_enc")
    j = encode(j, "_pref_brand", brand_enc, "user_preferred_brand_enc")
    j = encode(j, "_item_cat", cat_enc, "item_category_enc")
    j = encode(j, "_item_brand", brand_enc, "item_brand_enc")
    j = j.join(brands, (F.col("user_id") == F.col("_ub_user")) & (F.col("_item_brand") == F.col("_ub")),
               "left").drop("_ub_user", "_ub")
    avg = F.col("user_avg_spend")
    out = j.select(
        "user_id", "item_id",
        "user_preferred_category_enc", "user_preferred_brand_enc", "user_avg_spend",
        "user_recent_activity_count", "user_days_since_last_interaction",
        "item_category_enc", "item_brand_enc", "item_price", "item_popularity_score", "item_ctr_score",
        "item_popularity_rank", "sim_to_cart", "sim_to_click",
        F.col("similarity_score").cast("double").alias("retrieval_similarity"),
        (F.col("_item_cat") == F.col("_pref_cat")).cast("int").alias("same_category_as_pref"),
        (F.col("_item_brand") == F.col("_pref_brand")).cast("int").alias("same_brand_as_pref"),
        F.abs(F.col("item_price") - avg).alias("price_diff_from_avg_spend"),
        F.when(avg > 0, F.col("item_price") / avg).otherwise(F.lit(1.0)).alias("price_ratio_to_avg"),
        F.coalesce(F.col("_ub_hit"), F.lit(0)).cast("int").alias("user_interacted_brand"),
    )
    return extra(out) if extra is not None else out


def training_set(cands: DataFrame, events: DataFrame, products: DataFrame, embeddings: DataFrame,
                 recency_days: int = RECENCY_DAYS) -> DataFrame:
    """Features + label (max event weight of the pair over all history, else 0)."""
    feats = build_features(cands, events, products, embeddings, recency_days)
    return attach_labels(feats, events)


# J8 / G3 --------------------------------------------------------------------
def _md5_int(*cols) -> "F.Column":
    """First 32 bits of md5(text) as a non-negative integer (same in DuckDB)."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *cols)), 1, 8), 16, 10).cast("long")


def negative_sampling(events: DataFrame, products: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Per user: ``n - |history|`` catalog items the user never touched.

    Sampling is a seeded permutation: catalog items are ordered once by
    md5(item:seed) into positions 0..M-1; each user starts at its own offset
    md5(user:seed) mod M and walks the ring. Because a user with
    ``need = n - h > 0`` has fewer than n history items, the first
    ``need + h`` ring positions always contain ``need`` usable items, so each
    user expands to < 2n rows: exact, deterministic and bounded, with no
    users x catalog product.
    Output: (user_id, item_id, sample_rank).
    """
    from shoplens.operators.analytics import global_row_number
    hist = events.select("user_id", "item_id").distinct()
    sizes = hist.groupBy("user_id").agg(F.count(F.lit(1)).alias("_h"))
    need = (sizes.withColumn("_need", F.lit(n) - F.col("_h")).where(F.col("_need") > 0))
    ring = global_row_number(
        products.select("item_id").distinct().withColumn("_o", _md5_int(F.col("item_id"), F.lit(str(seed)))),
        [F.col("_o"), F.col("item_id")], "_pos1")
    ring = ring.select("item_id", (F.col("_pos1") - 1).alias("_pos"))
    m = ring.select(F.count(F.lit(1))).scalar()
    walk = need.select(
        "user_id", "_need",
        F.pmod(_md5_int(F.col("user_id"), F.lit(str(seed))), m).alias("_start"),
        F.explode(F.sequence(F.lit(0), F.least(F.col("_need") + F.col("_h"), m) - 1)).alias("_step"))
    walk = walk.withColumn("_pos", F.pmod(F.col("_start") + F.col("_step"), m))
    picked = (walk.join(ring, "_pos").join(hist, ["user_id", "item_id"], "left_anti"))
    w = Window.partitionBy("user_id").orderBy("_step")
    return (picked.withColumn("sample_rank", F.row_number().over(w))
            .where(F.col("sample_rank") <= F.col("_need"))
            .select("user_id", "item_id", "sample_rank"))


def history_plus_negatives(events: DataFrame, products: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The user's interacted items ∪ sampled negatives, similarity 0.5."""
    hist = events.select("user_id", "item_id").distinct()
    neg = negative_sampling(events, products, n, seed)
    return (hist.unionByName(neg.select("user_id", "item_id"))
            .withColumn("similarity_score", F.lit(0.5)))
