"""Registered sequence / session queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.functions.weights import (EVENT_TYPE_IDS, EVENT_TYPE_UNKNOWN, TARGET_DEFAULT, TARGET_WEIGHTS,
                                        weight_sql)
from shoplens.operators import profiles as P
from shoplens.operators import sequences as Q
from shoplens.plans.base import r6, register, ts_text, vec_text, vec_text_sql
from shoplens.session import cut_lineage
from shoplens.sources import fixtures as X
from shoplens.sources.fixtures import with_views

SEQ_CTES = f"""
ix AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS item_idx FROM products),
okv AS (SELECT i.item_id FROM image_emb i JOIN text_emb t ON t.item_id = i.item_id),
e AS (SELECT r.event_id, r.user_id, r.item_id, r.event_type, r.ts, ix.item_idx,
             (okv.item_id IS NOT NULL AND ix.item_idx IS NOT NULL) AS valid, coalesce(p.price, 0.0) AS price
      FROM rev r LEFT JOIN ix ON ix.item_id = r.item_id LEFT JOIN okv ON okv.item_id = r.item_id
      LEFT JOIN products p ON p.item_id = r.item_id),
s AS (SELECT *, list({{'ts': ts, 'item_idx': item_idx, 'eid': {weight_sql('event_type', EVENT_TYPE_IDS, EVENT_TYPE_UNKNOWN)},
                      'is_purchase': event_type = 'purchase', 'price': price, 'valid': valid}})
               OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS prior
      FROM e),
t0 AS (SELECT *, list_filter(prior, lambda h: h.ts >= ts - INTERVAL 180 DAY) AS hist FROM s
       WHERE event_type IN ('click', 'add_to_cart', 'purchase') AND item_idx IS NOT NULL),
t1 AS (SELECT *, list_filter(hist, lambda h: h.valid) AS vhist FROM t0 WHERE len(hist) >= 2),
samples AS (SELECT user_id, event_id AS target_event_id, item_idx AS target_item_idx, event_type AS target_event_type,
       CAST({weight_sql('event_type', TARGET_WEIGHTS, TARGET_DEFAULT)} AS DOUBLE) AS target_weight,
       list_aggregate(list_transform(vhist, lambda h: CAST(h.item_idx AS VARCHAR)), 'string_agg', ',') AS items,
       list_aggregate(list_transform(vhist, lambda h: CAST(h.eid AS VARCHAR)), 'string_agg', ',') AS types,
       len(vhist) AS seq_len, vhist[1].item_idx AS first_item_idx, vhist[-1].item_idx AS last_item_idx,
       CAST(list_sum(list_transform(vhist, lambda h: h.eid)) AS BIGINT) AS event_id_sum,
       CASE WHEN len(list_filter(hist, lambda h: h.is_purchase)) > 0
            THEN list_sum(list_transform(list_filter(hist, lambda h: h.is_purchase), lambda h: h.price))
                 / len(list_filter(hist, lambda h: h.is_purchase)) ELSE 0.0 END AS avg_spend,
       CAST(len(hist) AS DOUBLE) AS recent_activity_count,
       greatest((epoch_us(ts) - epoch_us(vhist[-1].ts)) / 3600000000.0, 0.0) AS recency_hours
FROM t1 WHERE len(vhist) >= 2)"""


def _vectors_ok(spark, d):
    return X.image_emb(spark, d).join(X.text_emb(spark, d).select("item_id"), "item_id").select("item_id")


def _samples(spark, d):
    items, _, _ = P.index_maps(X.products(spark, d))
    return Q.sequence_samples(X.rank_events(spark, d), X.products(spark, d), items, _vectors_ok(spark, d))


@register("sequence_samples", with_views(["rev", "products", "image_emb", "text_emb"], """
SELECT user_id, target_event_id, target_item_idx, target_event_type, target_weight, seq_len, items, types,
       round(avg_spend, 6) AS avg_spend, recent_activity_count,
       round(recency_hours, 6) AS recency_hours FROM samples""", SEQ_CTES))
def q_sequence_samples(spark, d):
    s = _samples(spark, d)
    return s.select(
        "user_id", "target_event_id", "target_item_idx", "target_event_type", "target_weight",
        F.size("seq_item_idx").cast("bigint").alias("seq_len"),
        F.array_join(F.col("seq_item_idx").cast("array<string>"), ",").alias("items"),
        F.array_join(F.col("seq_event_ids").cast("array<string>"), ",").alias("types"),
        r6("avg_spend").alias("avg_spend"), "recent_activity_count", r6("recency_hours").alias("recency_hours"))


@register("pad_sequence", with_views(["rev", "products", "image_emb", "text_emb"], """
SELECT target_event_id, (SELECT max(seq_len) FROM samples) AS padded_len,
       (SELECT max(seq_len) FROM samples) - seq_len AS n_padding,
       items || repeat(',0', (SELECT max(seq_len) FROM samples) - seq_len) AS items FROM samples""", SEQ_CTES))
def q_pad_sequence(spark, d):
    s = Q.pad_sequences(_samples(spark, d), ["seq_item_idx", "seq_event_ids", "seq_time_deltas_hours"])
    return s.select("target_event_id", F.size("seq_item_idx").cast("bigint").alias("padded_len"),
                    F.size(F.filter("padding_mask", lambda m: m)).cast("bigint").alias("n_padding"),
                    F.array_join(F.col("seq_item_idx").cast("array<string>"), ",").alias("items"))


@register("user_payload", with_views(["rev", "products", "image_emb", "text_emb"], f"""
SELECT user_id, count(*) AS n_valid,
       round(coalesce((SELECT avg(coalesce(p.price, 0.0)) FROM h2 x LEFT JOIN products p ON p.item_id = x.item_id
                       WHERE x.user_id = v.user_id AND x.event_type = 'purchase'), 0.0), 6) AS avg_spend,
       round(min(greatest((epoch_us(now) - epoch_us(ts)) / 3600000000.0, 0.0)), 6) AS recency_hours
FROM h2 v WHERE item_id IN (SELECT item_id FROM okv) GROUP BY user_id""", """
okv AS (SELECT i.item_id FROM image_emb i JOIN text_emb t ON t.item_id = i.item_id),
h1 AS (SELECT *, max(ts) OVER (PARTITION BY user_id) AS now FROM rev),
h2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS pos
       FROM h1 WHERE ts >= now - INTERVAL 180 DAY) WHERE pos <= 50)"""))
def q_user_payload(spark, d):
    u = Q.user_payload(X.rank_events(spark, d), X.products(spark, d), _vectors_ok(spark, d))
    return u.select("user_id", F.col("n_valid").cast("bigint").alias("n_valid"), r6("avg_spend").alias("avg_spend"),
                    r6("recency_hours").alias("recency_hours"))


ZEROS = "'" + ",".join(["0"] * 64) + "'"


@register("item_features", with_views(["products", "image_emb", "text_emb"], """
SELECT 0 AS item_idx, NULL AS item_id, 0 AS category_idx, 0 AS brand_idx, {zeros} AS image_vector, {zeros} AS text_vector
UNION ALL
SELECT ix.item_idx, ix.item_id, coalesce(c.idx, 1), coalesce(b.idx, 1), {image}, {text}
FROM ix JOIN products p ON p.item_id = ix.item_id
LEFT JOIN image_emb i ON i.item_id = ix.item_id LEFT JOIN text_emb t ON t.item_id = ix.item_id
LEFT JOIN cidx c ON c.value = coalesce(p.category, 'unknown') LEFT JOIN bidx b ON b.value = coalesce(p.brand, 'unknown')""".format(
    zeros=ZEROS, image=f"coalesce({vec_text_sql('i.embedding')}, {ZEROS})", text=f"coalesce({vec_text_sql('t.embedding')}, {ZEROS})"),
                                       """
ix AS (SELECT item_id, row_number() OVER (ORDER BY item_id) AS item_idx FROM products),
cidx AS (SELECT value, row_number() OVER (ORDER BY value) + 1 AS idx FROM (SELECT DISTINCT category AS value
         FROM products WHERE category <> 'unknown') UNION ALL SELECT 'unknown', 1),
bidx AS (SELECT value, row_number() OVER (ORDER BY value) + 1 AS idx FROM (SELECT DISTINCT brand AS value
         FROM products WHERE brand <> 'unknown') UNION ALL SELECT 'unknown', 1)"""))
def q_item_features(spark, d):
    prods = X.products(spark, d)
    items, cats, brands = P.index_maps(prods)
    f = Q.item_features(items, prods, X.image_emb(spark, d), X.text_emb(spark, d), cats, brands, 64, 64)
    return f.select("item_idx", "item_id", "category_idx", "brand_idx", vec_text("image_vec").alias("image_vector"),
                    vec_text("text_vec").alias("text_vector"))


@register("dwell_time", with_views(["ev"], """
SELECT event_id, user_id, item_id,
       CASE WHEN nxt IS NULL THEN NULL ELSE
         (m // 10000 + CASE WHEN 2 * (m % 10000) > 10000 OR (2 * (m % 10000) = 10000 AND (m // 10000) % 2 = 1)
                            THEN 1 ELSE 0 END) / 100.0 END AS time_spent
FROM (SELECT *, greatest(epoch_us(nxt) - epoch_us(ts), 0) AS m FROM (
      SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM ev
      WHERE event_type IN ('view', 'click', 'add_to_cart')))
WHERE event_type IN ('view', 'click')"""))
def q_dwell_time(spark, d):
    return Q.dwell_time(X.events(spark, d))


@register("login_sessions", with_views(["ev"], """
SELECT session_id, user_id, strftime(started_at, '%Y-%m-%d %H:%M:%S') AS started_at,
       strftime(lead(started_at) OVER (PARTITION BY user_id ORDER BY started_at, session_id), '%Y-%m-%d %H:%M:%S')
         AS ended_at,
       lead(started_at) OVER (PARTITION BY user_id ORDER BY started_at, session_id) IS NULL AS is_active
FROM (SELECT user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, user_id, min(ts) AS started_at
      FROM ev GROUP BY user_id, CAST(ts AS DATE))"""))
def q_login_sessions(spark, d):
    s = Q.login_sessions(Q.daily_logins(X.events(spark, d)))
    return s.select("session_id", "user_id", ts_text("started_at").alias("started_at"),
                    ts_text("ended_at").alias("ended_at"), "is_active")


@register("activity_sessions", with_views(["ev"], """
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start,
       strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end, count(*) AS n_events
FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id
                               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM (
      SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                       OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE
                     THEN 1 ELSE 0 END AS brk FROM ev))
GROUP BY user_id, sid"""))
def q_activity_sessions(spark, d):
    s = Q.activity_sessions(X.events(spark, d), 1800)
    return s.select("user_id", ts_text("session_start").alias("session_start"),
                    ts_text("session_end").alias("session_end"), "n_events")


@register("dedup_keep", with_views(["ev"], """
SELECT user_id, item_id, event_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts, event_id) AS k FROM ev
  WHERE event_type = 'add_to_cart') WHERE k = 1"""))
def q_dedup_keep(spark, d):
    c = X.events(spark, d).where(F.col("event_type") == "add_to_cart")
    return Q.dedup_keep(c, ["user_id", "item_id"], [F.col("ts"), F.col("event_id")]).select(
        "user_id", "item_id", "event_id")


@register("learned_embeddings")
def q_learned_embeddings(spark, d):
    """Implicit ALS factors, shown by each user's five nearest items (rows-only: iterative solver)."""
    _, users, items = Q.learned_embeddings(X.rank_events(spark, d), rank=8, max_iter=5)
    return Q.vector_topn(users, items, 5).select("user_id", "item_id", "rank", r6("score").alias("score"))


@register("neural_then_rank")
def q_neural_then_rank(spark, d):
    """Candidates by learned vectors (purchased excluded), rankers trained on them, top 10 (rows-only: models)."""
    from shoplens.plans.q_vectors import ranker_products
    ev, prods = X.rank_events(spark, d), cut_lineage(ranker_products(spark, d))
    _, users, items = Q.learned_embeddings(ev, rank=8, max_iter=5)
    ranked, _ = Q.neural_then_rank(users, items, ev, prods, X.image_emb(spark, d), n=30, recency_days=7, max_iter=5)
    return ranked.select("user_id", "item_id", "rank", r6("ranking_score").alias("ranking_score"))


@register("retrieval_metrics")
def q_retrieval_metrics(spark, d):
    """Recall/NDCG@k of each user's last event item under learned vectors."""
    from pyspark.sql import Window
    from shoplens.operators.ranking import retrieval_metrics
    ev = X.rank_events(spark, d)
    _, users, items = Q.learned_embeddings(ev, rank=8, max_iter=5)
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    last = ev.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(
        F.col("user_id").alias("sample_id"), "item_id")
    q = users.select(F.col("user_id").alias("sample_id"), "vector")
    return retrieval_metrics(q, last, items, ks=(10, 50), key="sample_id")
