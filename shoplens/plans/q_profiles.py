"""Registered profile / popularity / encoder queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.functions.weights import LABEL_WEIGHTS, weight_sql
from shoplens.operators import profiles as P
from shoplens.plans.base import r6, register
from shoplens.sources import fixtures as X
from shoplens.sources.fixtures import with_views

STATS_SQL = """
cnt AS (SELECT item_id, count(*) AS n, count_if(event_type = 'click') AS clicks,
               count_if(event_type IN ('view', 'click')) AS views FROM rev GROUP BY item_id),
stats AS (SELECT p.item_id, coalesce(c.n, 0) AS n, coalesce(c.clicks, 0) AS clicks,
                 coalesce(c.views, 0) AS views FROM products p LEFT JOIN cnt c ON c.item_id = p.item_id),
pstats AS (SELECT item_id,
       CASE WHEN (SELECT max(n) FROM stats) > 0 THEN n / (SELECT max(n) FROM stats) ELSE 0.0 END
         AS popularity_score,
       CASE WHEN views > 0 THEN clicks / views ELSE 0.0 END AS ctr_score FROM stats)"""


@register("prepare_products", with_views(["rev", "products"], """
SELECT item_id, round(popularity_score, 6) AS popularity_score, round(ctr_score, 6) AS ctr_score
FROM pstats""", STATS_SQL))
def q_prepare_products(spark, d):
    p = P.prepare_products(X.products(spark, d), X.rank_events(spark, d))
    return p.select("item_id", r6("popularity_score").alias("popularity_score"),
                    r6("ctr_score").alias("ctr_score"))


PW = {k: v + 1 for k, v in LABEL_WEIGHTS.items()}
PROFILE_SQL = f"""
m AS (SELECT e.*, p.category, p.brand, p.price, {weight_sql('e.event_type', PW, 1)} AS weight
      FROM rev e LEFT JOIN products p ON p.item_id = e.item_id),
catw AS (SELECT user_id, category, sum(weight) AS w FROM m WHERE category IS NOT NULL GROUP BY 1, 2),
brw AS (SELECT user_id, brand, sum(weight) AS w FROM m WHERE brand IS NOT NULL GROUP BY 1, 2),
prof AS (SELECT b.user_id, coalesce(
         CASE WHEN pn > 0 THEN (ps // pn + CASE WHEN 2 * (ps % pn) > pn OR (2 * (ps % pn) = pn AND (ps // pn) % 2 = 1)
                                         THEN 1 ELSE 0 END) / 100.0 END,
         CASE WHEN an > 0 THEN (als // an + CASE WHEN 2 * (als % an) > an OR (2 * (als % an) = an AND (als // an) % 2 = 1)
                                         THEN 1 ELSE 0 END) / 100.0 END) AS avg_spend, b.recent_activity_count,
       CAST(floor((epoch_us((SELECT max(ts) FROM rev)) - epoch_us(b.last)) / 86400000000) AS BIGINT)
         AS days_since_last_interaction,
       (SELECT category FROM catw c WHERE c.user_id = b.user_id ORDER BY w DESC, category LIMIT 1)
         AS preferred_category,
       (SELECT brand FROM brw r WHERE r.user_id = b.user_id ORDER BY w DESC, brand LIMIT 1)
         AS preferred_brand
FROM (SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN CAST(round(price * 100) AS BIGINT) END) AS ps,
             count(CASE WHEN event_type = 'purchase' THEN price END) AS pn,
             sum(CAST(round(price * 100) AS BIGINT)) AS als, count(price) AS an,
             CAST(count_if(ts >= (SELECT max(ts) FROM rev) - INTERVAL 7 DAY) AS BIGINT) AS recent_activity_count,
             max(ts) AS last FROM m GROUP BY user_id) b)"""


@register("user_profiles", with_views(["rev", "products"], "SELECT * FROM prof", PROFILE_SQL))
def q_user_profiles(spark, d):
    return P.user_profiles(X.rank_events(spark, d), X.products(spark, d), recency_days=7).select(
        "user_id", "avg_spend", "recent_activity_count", "days_since_last_interaction",
        "preferred_category", "preferred_brand")


@register("labels", with_views(["rev"], f"""
SELECT user_id, item_id, CAST(max({weight_sql('event_type', LABEL_WEIGHTS, 0)}) AS INTEGER) AS label
FROM rev GROUP BY user_id, item_id"""))
def q_labels(spark, d):
    return P.labels(X.rank_events(spark, d))


@register("popularity_rank", with_views(["rev", "products"], """
SELECT item_id, round(coalesce(percent_rank_avg, 0.0), 6) AS popularity_rank FROM (
  SELECT item_id, (rank() OVER (ORDER BY popularity_score)
                   + (count(*) OVER (PARTITION BY popularity_score) - 1) / 2.0)
                  / count(popularity_score) OVER () AS percent_rank_avg FROM pstats)""", STATS_SQL))
def q_popularity_rank(spark, d):
    p = P.prepare_products(X.products(spark, d), X.rank_events(spark, d))
    r = P.pct_rank(p.select("item_id", "popularity_score"), "popularity_score", "popularity_rank")
    return r.select("item_id", r6("popularity_rank").alias("popularity_rank"))


@register("category_encoding", with_views(["products"], """
SELECT 'category' AS field, value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT coalesce(category, 'unknown') AS value FROM products UNION SELECT 'unknown')
UNION ALL
SELECT 'brand', value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER)
FROM (SELECT DISTINCT coalesce(brand, 'unknown') AS value FROM products UNION SELECT 'unknown')"""))
def q_category_encoding(spark, d):
    p = X.products(spark, d)
    c = P.label_encoder(p, "category").select(F.lit("category").alias("field"), "value", "code")
    b = P.label_encoder(p, "brand").select(F.lit("brand").alias("field"), "value", "code")
    return c.unionByName(b)


@register("index_maps", with_views(["products"], """
SELECT 'item' AS field, item_id AS value, row_number() OVER (ORDER BY item_id) AS idx FROM products
UNION ALL
SELECT 'category', value, CASE WHEN value = 'unknown' THEN 1 ELSE row_number() OVER (ORDER BY value) + 1 END
FROM (SELECT DISTINCT category AS value FROM products WHERE category <> 'unknown') UNION ALL SELECT 'category', 'unknown', 1
UNION ALL
SELECT 'brand', value, row_number() OVER (ORDER BY value) + 1
FROM (SELECT DISTINCT brand AS value FROM products WHERE brand <> 'unknown') UNION ALL SELECT 'brand', 'unknown', 1"""))
def q_index_maps(spark, d):
    items, cats, brands = P.index_maps(X.products(spark, d))
    return (items.select(F.lit("item").alias("field"), F.col("item_id").alias("value"),
                         F.col("item_idx").alias("idx"))
            .unionByName(cats.select(F.lit("category").alias("field"), F.col("category").alias("value"),
                                     F.col("category_idx").alias("idx")))
            .unionByName(brands.select(F.lit("brand").alias("field"), F.col("brand").alias("value"),
                                       F.col("brand_idx").alias("idx"))))


@register("user_brand_history", with_views(["rev", "products"], """
SELECT DISTINCT e.user_id, p.brand FROM rev e JOIN products p ON p.item_id = e.item_id
WHERE p.brand IS NOT NULL"""))
def q_user_brand_history(spark, d):
    return P.user_brand_history(X.rank_events(spark, d), X.products(spark, d))
