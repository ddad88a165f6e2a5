"""Event sequences, sessions and learned embeddings.

Sequence windows are bounded window frames (<= 50 rows before each event),
so every sample is built in the partition of its user without collecting the
user's whole history.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.functions.scalars import hours_between
from shoplens.operators.candidates import exclude_pairs, purchased_pairs
from shoplens.operators.features import training_set
from shoplens.operators.ranking import (model_scorer, rank_topk, temporal_user_split, train_rankers, trending_boost,
                                        validate_rankers)
from shoplens.operators.skew import keyed_cumsum, prior_rows
from shoplens.operators.vectors import vector_topn
from shoplens.session import cut_lineage
from shoplens.functions.weights import (EVENT_TYPE_IDS, EVENT_TYPE_UNKNOWN, SEQ_LOOKBACK_DAYS, SEQ_MAX_LEN,
                                        SEQ_MIN_HISTORY, TARGET_DEFAULT, TARGET_WEIGHTS, weight_of)

TARGET_TYPES = ["click", "add_to_cart", "purchase"]


def _event_id_col() -> Column:
    return weight_of(F.col("event_type"), EVENT_TYPE_IDS, EVENT_TYPE_UNKNOWN)


def half_even_hundredths(micros: Column) -> Column:
    """micros / 1e6 rounded half-even to 0.01 using integer arithmetic."""
    unit = F.lit(10_000)
    rem = F.pmod(micros, unit)
    base = ((micros - rem) / unit).cast("long")
    up = (rem * 2 > unit) | ((rem * 2 == unit) & (F.pmod(base, F.lit(2)) == 1))
    return (base + F.when(up, 1).otherwise(0)) / F.lit(100.0)


# E4 / J14 -------------------------------------------------------------------
def sequence_samples(events: DataFrame, products: DataFrame, item_index: DataFrame, vectors_ok: DataFrame,
                     max_seq_len: int = SEQ_MAX_LEN, min_history: int = SEQ_MIN_HISTORY,
                     lookback_days: int = SEQ_LOOKBACK_DAYS, include_view_targets: bool = False) -> DataFrame:
    """(history -> next item) training samples, one per eligible target event.

    history = up to ``max_seq_len`` events before the target (order: ts,
    event_id) not older than ``lookback_days``; needs >= min_history events and
    >= min_history of them with both vectors and a catalog index.
    item_index: (item_id, item_idx); vectors_ok: (item_id) having both vectors.
    """
    idx = item_index.select("item_id", "item_idx")
    ok = vectors_ok.select("item_id").distinct().withColumn("_vec_ok", F.lit(True))
    price = products.select("item_id", F.col("price").alias("_price"))
    e = (events.select("event_id", "user_id", "item_id", "event_type", "ts")
         .join(idx, "item_id", "left").join(ok, "item_id", "left").join(price, "item_id", "left"))
    step = F.struct(
        F.col("ts").alias("ts"), F.col("item_idx").alias("item_idx"), _event_id_col().alias("event_type_id"),
        (F.col("event_type") == "purchase").alias("is_purchase"), F.coalesce(F.col("_price"), F.lit(0.0)).alias("price"),
        (F.coalesce(F.col("_vec_ok"), F.lit(False)) & F.col("item_idx").isNotNull()).alias("valid"))
    s = prior_rows(e, "user_id", "ts", "event_id", max_seq_len, step, "_prior")
    targets = TARGET_TYPES + (["view"] if include_view_targets else [])
    s = s.where(F.col("event_type").isin(targets) & F.col("item_idx").isNotNull())
    cutoff = F.col("ts") - F.make_interval(days=F.lit(lookback_days))
    s = s.withColumn("_hist", F.filter("_prior", lambda h: h["ts"] >= cutoff))
    s = s.where(F.size("_hist") >= min_history)
    s = s.withColumn("_valid", F.filter("_hist", lambda h: h["valid"]))
    s = s.where(F.size("_valid") >= min_history)
    purchases = F.filter("_hist", lambda h: h["is_purchase"])
    avg_spend = F.when(F.size(purchases) > 0,
                       F.aggregate(purchases, F.lit(0.0), lambda a, h: a + h["price"]) / F.size(purchases)
                       ).otherwise(F.lit(0.0))
    deltas = F.transform("_valid", lambda h: F.greatest(hours_between(h["ts"], F.col("ts")), F.lit(0.0)))
    return s.select(
        "user_id", F.col("event_id").alias("target_event_id"), F.col("item_idx").alias("target_item_idx"),
        F.col("event_type").alias("target_event_type"),
        weight_of(F.col("event_type"), TARGET_WEIGHTS, TARGET_DEFAULT).cast("double").alias("target_weight"),
        F.col("ts").alias("target_ts"),
        F.transform("_valid", lambda h: h["item_idx"]).alias("seq_item_idx"),
        F.transform("_valid", lambda h: h["event_type_id"]).alias("seq_event_ids"),
        deltas.alias("seq_time_deltas_hours"),
        avg_spend.alias("avg_spend"),
        F.size("_hist").cast("double").alias("recent_activity_count"),
        F.element_at(deltas, -1).alias("recency_hours"))


# E5 / J14b ------------------------------------------------------------------
def latest_history(events: DataFrame, max_seq_len: int = SEQ_MAX_LEN,
                   lookback_days: int | None = SEQ_LOOKBACK_DAYS) -> DataFrame:
    """Each user's last ``max_seq_len`` events within lookback of the user's own last event."""
    # per-user max as an aggregate (partial, skew-safe) instead of a whole-partition window
    now = events.groupBy("user_id").agg(F.max("ts").alias("_now"))
    e = events.join(now, "user_id")
    if lookback_days is not None:
        e = e.where(F.col("ts") >= F.col("_now") - F.make_interval(days=F.lit(lookback_days)))
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return e.withColumn("_pos", F.row_number().over(w)).where(F.col("_pos") <= max_seq_len)


def user_payload(events: DataFrame, products: DataFrame, vectors_ok: DataFrame,
                 max_seq_len: int = SEQ_MAX_LEN, lookback_days: int | None = SEQ_LOOKBACK_DAYS,
                 fixed_avg_spend: float | None = None) -> DataFrame:
    """Serving-time sequence per user; users without an embedding-backed event are dropped.

    dense = [avg purchase price in the window (missing price 0, none 0),
    number of valid events, hours back of the last valid event]."""
    h = latest_history(events, max_seq_len, lookback_days)
    ok = vectors_ok.select("item_id").distinct().withColumn("_ok", F.lit(True))
    h = h.join(ok, "item_id", "left").join(products.select("item_id", F.col("price").alias("_price")),
                                           "item_id", "left")
    valid = F.coalesce(F.col("_ok"), F.lit(False))
    delta = F.greatest(hours_between(F.col("ts"), F.col("_now")), F.lit(0.0))
    step = F.struct(-F.col("_pos"), F.col("item_id").alias("item_id"), _event_id_col().alias("event_type_id"),
                    delta.alias("delta_h"))
    agg = h.groupBy("user_id").agg(
        F.sort_array(F.collect_list(F.when(valid, step))).alias("_seq"),
        F.avg(F.when(F.col("event_type") == "purchase", F.coalesce(F.col("_price"), F.lit(0.0)))).alias("_spend"))
    agg = agg.where(F.size("_seq") > 0)
    spend = F.lit(fixed_avg_spend) if fixed_avg_spend is not None else F.coalesce(F.col("_spend"), F.lit(0.0))
    return agg.select(
        "user_id",
        F.transform("_seq", lambda s: s["item_id"]).alias("seq_item_ids"),
        F.transform("_seq", lambda s: s["event_type_id"]).alias("seq_event_ids"),
        F.transform("_seq", lambda s: s["delta_h"]).alias("seq_time_deltas_hours"),
        spend.cast("double").alias("avg_spend"),
        F.size("_seq").cast("double").alias("n_valid"),
        F.element_at("_seq", -1)["delta_h"].alias("recency_hours"))


# H15 ------------------------------------------------------------------------
def pad_sequences(samples: DataFrame, cols: list[str], pad=0) -> DataFrame:
    """Right-pad the array columns to the longest sequence and add a padding mask
    (true = padding). The target length is a scalar subquery over the batch."""
    lens = samples.select(F.max(F.size(cols[0]))).scalar()
    return _with_mask(samples, cols, lens, pad)


def _with_mask(samples: DataFrame, cols: list[str], lens: Column, pad) -> DataFrame:
    out = samples.withColumn("_n", F.size(cols[0]))
    for c in cols:
        et = samples.schema[c].dataType.elementType
        out = out.withColumn(c, F.concat(F.col(c), F.array_repeat(F.lit(pad).cast(et), lens - F.col("_n"))))
    mask = F.concat(F.array_repeat(F.lit(False), F.col("_n")), F.array_repeat(F.lit(True), lens - F.col("_n")))
    return out.withColumn("padding_mask", mask).drop("_n")


# J15 ------------------------------------------------------------------------
def item_features(item_index: DataFrame, products: DataFrame, image: DataFrame, text: DataFrame,
                  cat_index: DataFrame, brand_index: DataFrame, dim_image: int, dim_text: int) -> DataFrame:
    """Per item_idx: image/text vectors (zeros when missing), category/brand idx
    ('unknown' = 1); row 0 is the padding row."""
    p = products.select("item_id", F.coalesce(F.col("category"), F.lit("unknown")).alias("category"),
                        F.coalesce(F.col("brand"), F.lit("unknown")).alias("brand"))
    j = (item_index.join(p, "item_id", "left")
         .join(image.select("item_id", F.col("embedding").alias("_img")), "item_id", "left")
         .join(text.select("item_id", F.col("embedding").alias("_txt")), "item_id", "left")
         .join(cat_index, "category", "left").join(brand_index, "brand", "left"))
    rows = j.select(
        "item_idx", "item_id",
        F.coalesce("_img", F.array_repeat(F.lit(0.0), dim_image)).alias("image_vec"),
        F.coalesce("_txt", F.array_repeat(F.lit(0.0), dim_text)).alias("text_vec"),
        F.coalesce(F.col("category_idx"), F.lit(1)).cast("long").alias("category_idx"),
        F.coalesce(F.col("brand_idx"), F.lit(1)).cast("long").alias("brand_idx"))
    pad = item_index.sparkSession.range(1).select(
        F.lit(0).cast("long").alias("item_idx"), F.lit(None).cast("string").alias("item_id"),
        F.array_repeat(F.lit(0.0), dim_image).alias("image_vec"), F.array_repeat(F.lit(0.0), dim_text).alias("text_vec"),
        F.lit(0).cast("long").alias("category_idx"), F.lit(0).cast("long").alias("brand_idx"))
    return pad.unionByName(rows)


# E6 -------------------------------------------------------------------------
def dwell_time(events: DataFrame, start_types=("view", "click"), end_types=("view", "click", "add_to_cart")
               ) -> DataFrame:
    """Seconds from each activation to the user's next activation / cart action,
    >= 0, half-even to 0.01; the user's last activation stays open (NULL)."""
    e = events.where(F.col("event_type").isin(list(set(start_types) | set(end_types))))
    # next row = previous row on reversed time, through the skew-safe chunked frame
    e = (e.withColumn("_rts", F.timestamp_micros(-F.unix_micros("ts"))).withColumn("_reid", -F.col("event_id")))
    e = prior_rows(e, "user_id", "_rts", "_reid", 1, F.col("ts"), "_nx")
    e = (e.withColumn("_next", F.try_element_at("_nx", F.lit(1))).drop("_nx", "_rts", "_reid")
         .where(F.col("event_type").isin(list(start_types))))
    micros = F.greatest(F.unix_micros("_next") - F.unix_micros("ts"), F.lit(0))
    return e.select("event_id", "user_id", "item_id", F.when(F.col("_next").isNotNull(),
                                                             half_even_hundredths(micros)).alias("time_spent"))


# E7 -------------------------------------------------------------------------
def login_sessions(logins: DataFrame, explicit_ends: DataFrame | None = None) -> DataFrame:
    """A new login closes the user's open session (ended_at = next start); an
    explicit end (session_id, ended_at) closes earlier; only the latest may stay active."""
    # the next start = the row before it in reversed order, through the chunked frame
    back = logins.withColumn("_back", F.timestamp_micros(-F.unix_micros("started_at")))
    if isinstance(logins.schema["session_id"].dataType, T.StringType):
        turned = F.concat(F.translate(F.hex("session_id"), "0123456789ABCDEF", "fedcba9876543210"), F.lit("~"))
    else:
        turned = -F.col("session_id")
    back = back.withColumn("_turn", turned)
    s = prior_rows(back, "user_id", "_back", "_turn", 1, F.col("started_at"), "_n") \
        .withColumn("_next", F.try_element_at("_n", F.lit(1))).drop("_n", "_back", "_turn")
    if explicit_ends is not None:
        s = s.join(explicit_ends.select("session_id", F.col("ended_at").alias("_end")), "session_id", "left")
        ended = F.least(F.col("_next"), F.col("_end"))
    else:
        ended = F.col("_next")
    return s.select("session_id", "user_id", "started_at", ended.alias("ended_at"),
                    ended.isNull().alias("is_active"))


def daily_logins(events: DataFrame) -> DataFrame:
    """Fixture convention: a login = a user's first event of each day."""
    d = events.groupBy("user_id", F.to_date("ts").alias("_day")).agg(F.min("ts").alias("started_at"))
    return d.select(F.concat_ws(":", "user_id", F.col("_day").cast("string")).alias("session_id"),
                    "user_id", "started_at")


def activity_sessions(events: DataFrame, gap_seconds: int = 1800) -> DataFrame:
    """Gap-based activity sessions per user: an event ``gap_seconds`` or more after the one before starts a new one.

    Runs are numbered through the chunked frames, so a user's events may span
    many tasks; (user, run) is then a plain aggregate.
    """
    e = prior_rows(events.select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 1, F.col("ts"), "_before")
    gap = F.unix_micros("ts") - F.unix_micros(F.try_element_at("_before", F.lit(1)))
    breaks = F.when(gap >= F.lit(gap_seconds * 1_000_000), 1).otherwise(0)
    runs = keyed_cumsum(e, "user_id", "ts", "event_id", breaks, "_run")
    return runs.groupBy("user_id", "_run").agg(
        F.min("ts").alias("session_start"), F.max("ts").alias("_last"), F.count(F.lit(1)).alias("n_events")).select(
        "user_id", "session_start", (F.col("_last") + F.make_interval(secs=F.lit(gap_seconds))).alias("session_end"), "n_events")


# E11 ------------------------------------------------------------------------
def dedup_keep(df: DataFrame, keys: list[str], order: list[Column], keep: str = "first") -> DataFrame:
    """Keep the first (or last) row per key under ``order``."""
    o = order if keep == "first" else [c.desc() for c in order]
    w = Window.partitionBy(*keys).orderBy(*o)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


# J16 / J17 / D22 ------------------------------------------------------------
def learned_embeddings(events: DataFrame, rank: int = 16, max_iter: int = 10, reg: float = 0.05,
                       alpha: float = 1.0, seed: int = 42):
    """User/item vectors from implicit-feedback ALS; preference = Σ target weight.

    Returns (model, user_vecs(user_id, vector), item_vecs(item_id, embedding))."""
    from pyspark.ml.recommendation import ALS

    from shoplens.operators.analytics import global_row_number
    pref = (events.withColumn("_w", weight_of(F.col("event_type"), TARGET_WEIGHTS, TARGET_DEFAULT))
            .groupBy("user_id", "item_id").agg(F.sum("_w").alias("pref")))
    # dense integer ids from distributed row numbers (no driver-side label lists)
    uidx = global_row_number(pref.select("user_id").distinct(), [F.col("user_id")], "u")
    iidx = global_row_number(pref.select("item_id").distinct(), [F.col("item_id")], "i")
    data = (pref.join(uidx, "user_id").join(iidx, "item_id")
            .select(F.col("u").cast("int").alias("u"), F.col("i").cast("int").alias("i"), "pref"))
    als = ALS(userCol="u", itemCol="i", ratingCol="pref", implicitPrefs=True, rank=rank, maxIter=max_iter,
              regParam=reg, alpha=alpha, seed=seed, coldStartStrategy="drop", nonnegative=False)
    model = als.fit(data)
    to_d = lambda c: F.transform(c, lambda x: x.cast("double"))
    users = model.userFactors.join(uidx, F.col("id") == F.col("u")).select(
        "user_id", to_d(F.col("features")).alias("vector"))
    items = model.itemFactors.join(iidx, F.col("id") == F.col("i")).select(
        "item_id", to_d(F.col("features")).alias("embedding"))
    return model, users, items


def neural_candidates(users: DataFrame, items: DataFrame, events: DataFrame, n: int = 100) -> DataFrame:
    """(user_id, item_id, similarity_score): each user's n best items by learned vectors that it hasn't purchased."""
    bought = purchased_pairs(events)
    extra = bought.join(items.select("item_id"), "item_id", "left_semi").groupBy("user_id").count()
    top = exclude_pairs(vector_topn(users, items, n, extra=extra), bought)
    return rank_topk(top.drop("rank"), n, "score").select("user_id", "item_id", F.col("score").alias("similarity_score"))


def neural_then_rank(users: DataFrame, items: DataFrame, events: DataFrame, products: DataFrame, embeddings: DataFrame,
                     val_fraction: float = 0.2, n: int = 100, k: int = 10, recency_days: int = 90, max_iter: int = 10
                     ) -> tuple[DataFrame, DataFrame]:
    """Retrieval by learned vectors, then rankers trained on those candidates.

    Rankers are fitted on the users whose last event is early and validated on
    the others; returns (user_id, item_id, rank, ranking_score) of all users and
    the validation metrics.
    """
    cands = cut_lineage(neural_candidates(users, items, events, n))
    rows = cut_lineage(training_set(cands, events, products, embeddings, recency_days))
    train, val = temporal_user_split(rows, events, val_fraction)
    models = train_rankers(train, val, max_iter=max_iter, max_depth=4)
    scored = trending_boost(model_scorer(models)(rows), products, "raw_score", "ranking_score")
    ranked = rank_topk(scored, k, "ranking_score").select("user_id", "item_id", "rank", "ranking_score")
    return ranked, validate_rankers(models, val, k)
