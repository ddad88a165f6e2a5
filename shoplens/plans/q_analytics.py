"""Registered analytics queries (B*, C1-C4, D1-D5, D11, D19, D24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.operators import analytics as A
from shoplens.plans.base import r6, register, ts_text
from shoplens.sources import fixtures as X
from shoplens.sources.fixtures import with_views

TS = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


@register("filter_events", with_views(["ev"], f"""
SELECT event_id, user_id, item_id, event_type, {TS} AS ts FROM ev
WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' + INTERVAL 1 DAY"""))
def q_filter_events(spark, d):
    ev = A.filter_events(X.events(spark, d), users=[], start="2024-01-05", end="2024-01-20")
    return ev.select("event_id", "user_id", "item_id", "event_type", ts_text("ts").alias("ts"))


@register("clamp_date", with_views(["ev"], """
SELECT user_id, CAST(min(ts) AS DATE) AS first_date,
       greatest(DATE '2024-01-03', least(DATE '2024-01-10', CAST(min(ts) AS DATE))) AS clamped
FROM ev GROUP BY user_id"""))
def q_clamp_date(spark, d):
    first = X.events(spark, d).groupBy("user_id").agg(F.to_date(F.min("ts")).alias("first_date"))
    return first.withColumn("clamped", A.clamp(F.col("first_date"), F.lit("2024-01-03").cast("date"),
                                               F.lit("2024-01-10").cast("date")))


@register("recent_events", with_views(["ev"], """
SELECT event_id, user_id, item_id, event_type FROM ev
WHERE ts >= (SELECT max(ts) FROM ev) - INTERVAL 7 DAY"""))
def q_recent_events(spark, d):
    return A.recent_events(X.events(spark, d), 7).select("event_id", "user_id", "item_id", "event_type")


@register("in_stock_filter", with_views(["ev", "products"], """
SELECT DISTINCT e.item_id FROM ev e LEFT JOIN products p ON p.item_id = e.item_id
WHERE coalesce(p.in_stock, true)"""))
def q_in_stock(spark, d):
    items = X.events(spark, d).select("item_id").distinct()
    return A.in_stock_filter(items, X.products(spark, d)).select("item_id")


@register("facet_filter", with_views(["products"], """
SELECT item_id, category FROM products WHERE category IN ('SMALL', 'LARGE')"""))
def q_facet_filter(spark, d):
    return A.facet_filter(X.products(spark, d), ["SMALL", "LARGE"]).select("item_id", "category")


@register("paginate", with_views(["products"], """
SELECT item_id, product_name, brand, price, row_no, CAST(3 AS BIGINT) AS page, total_pages FROM (
  SELECT item_id, product_name, brand, price, row_number() OVER (ORDER BY price, item_id) AS row_no,
         greatest(1, ceil(count(*) OVER () / 24)) :: BIGINT AS total_pages
  FROM products) WHERE (row_no - 1) // 24 + 1 = 3""", ))
def q_paginate(spark, d):
    out = A.paginate(X.products(spark, d), [F.col("price"), F.col("item_id")], 24, 3)
    return out.select("item_id", "product_name", "brand", "price", "row_no", "page", "total_pages")


@register("events_left_products", with_views(["ev", "products"], """
SELECT e.event_id, e.item_id, p.product_name, p.category, p.price
FROM ev e LEFT JOIN products p ON p.item_id = e.item_id"""))
def q_events_left_products(spark, d):
    j = A.events_left_products(X.events(spark, d), X.products(spark, d))
    return j.select("event_id", "item_id", "product_name", "category", "price")


@register("events_named", with_views(["ev", "products"], """
SELECT e.event_id, e.item_id, coalesce(p.product_name, 'Item ' || e.item_id) AS product_name
FROM ev e LEFT JOIN products p ON p.item_id = e.item_id"""))
def q_events_named(spark, d):
    return A.events_named(X.events(spark, d), X.products(spark, d)).select(
        "event_id", "item_id", "product_name")


@register("events_inner_products", with_views(["ev", "products"], """
SELECT e.event_id, e.item_id, p.brand FROM ev e JOIN products p ON p.item_id = e.item_id"""))
def q_events_inner(spark, d):
    return A.events_inner_products(X.events(spark, d), X.products(spark, d)).select(
        "event_id", "item_id", "brand")


@register("kpis", with_views(["ev"], """
SELECT CAST(count_if(event_type = 'view') AS BIGINT) AS views,
       CAST(count_if(event_type = 'click') AS BIGINT) AS clicks,
       CAST(count_if(event_type = 'add_to_cart') AS BIGINT) AS add_to_cart,
       round(coalesce(avg(CASE WHEN event_type = 'time_spent' AND time_spent_seconds IS NOT NULL
                               THEN time_spent_seconds END), 0.0), 6) AS avg_time,
       round(CASE WHEN count_if(event_type = 'view') > 0
             THEN count_if(event_type = 'add_to_cart') / count_if(event_type = 'view') * 100.0
             ELSE 0.0 END, 6) AS conversion_rate
FROM ev"""))
def q_kpis(spark, d):
    k = A.kpis(X.events(spark, d))
    return k.select("views", "clicks", "add_to_cart", r6("avg_time").alias("avg_time"),
                    r6("conversion_rate").alias("conversion_rate"))


@register("funnel", with_views(["ev"], """
SELECT 'view' AS stage, CAST(count_if(event_type = 'view') AS BIGINT) AS count FROM ev
UNION ALL SELECT 'click', CAST(count_if(event_type = 'click') AS BIGINT) FROM ev
UNION ALL SELECT 'add_to_cart', CAST(count_if(event_type = 'add_to_cart') AS BIGINT) FROM ev"""))
def q_funnel(spark, d):
    return A.funnel(X.events(spark, d))


NAMED = ("named AS (SELECT e.*, coalesce(p.product_name, 'Item ' || e.item_id) AS product_name "
         "FROM ev e LEFT JOIN products p ON p.item_id = e.item_id)")


@register("product_event_counts", with_views(["ev", "products"], """
SELECT product_name, count(*) AS count FROM named WHERE event_type = 'click'
GROUP BY product_name""", NAMED))
def q_product_event_counts(spark, d):
    return A.product_event_counts(A.events_named(X.events(spark, d), X.products(spark, d)), "click")


@register("time_spent_by_product", with_views(["ev", "products"], """
SELECT product_name, round(avg(time_spent_seconds), 6) AS avg_time_spent_seconds FROM named
WHERE event_type = 'time_spent' AND time_spent_seconds IS NOT NULL GROUP BY product_name""", NAMED))
def q_time_spent(spark, d):
    t = A.time_spent_by_product(A.events_named(X.events(spark, d), X.products(spark, d)))
    return t.select("product_name", r6("avg_time_spent_seconds").alias("avg_time_spent_seconds"))


CONV_SQL = """
SELECT product_name, views, add_to_cart,
       round(CASE WHEN views > 0 THEN add_to_cart / views * 100.0 ELSE 0.0 END, 6)
         AS conversion_rate_pct
FROM (SELECT coalesce(v.product_name, c.product_name) AS product_name,
             coalesce(v.n, 0) AS views, coalesce(c.n, 0) AS add_to_cart
      FROM (SELECT product_name, count(*) AS n FROM named WHERE event_type = 'view'
            GROUP BY product_name) v
      FULL OUTER JOIN (SELECT product_name, count(*) AS n FROM named
                       WHERE event_type = 'add_to_cart' GROUP BY product_name) c
      ON v.product_name = c.product_name)"""


@register("conversion_by_product", with_views(["ev", "products"], CONV_SQL, NAMED))
def q_conversion(spark, d):
    c = A.conversion_by_product(A.events_named(X.events(spark, d), X.products(spark, d)))
    return c.select("product_name", "views", "add_to_cart",
                    r6("conversion_rate_pct").alias("conversion_rate_pct"))


@register("views_outer_carts", with_views(["ev", "products"], CONV_SQL, NAMED))
def q_views_outer_carts(spark, d):
    """C4 written as the reference does it: two counts, FULL OUTER, NULL -> 0."""
    named = A.events_named(X.events(spark, d), X.products(spark, d))
    v = A.product_event_counts(named, "view").withColumnRenamed("count", "views")
    c = A.product_event_counts(named, "add_to_cart").withColumnRenamed("count", "add_to_cart")
    j = v.join(c, "product_name", "full_outer").fillna(0, ["views", "add_to_cart"])
    rate = F.when(F.col("views") > 0, F.col("add_to_cart") / F.col("views") * 100.0).otherwise(0.0)
    return j.select("product_name", "views", "add_to_cart", r6(rate).alias("conversion_rate_pct"))


@register("top_popular", with_views(["ev", "products"], """
SELECT c.item_id, p.product_name, p.category, p.price, c.interactions
FROM (SELECT item_id, count(*) AS interactions FROM ev WHERE event_type IN ('click', 'view')
      GROUP BY item_id) c JOIN products p ON p.item_id = c.item_id
ORDER BY interactions DESC, item_id LIMIT 10"""))
def q_top_popular(spark, d):
    return A.top_popular(X.events(spark, d), X.products(spark, d), limit=25)


@register("catalog_facets", with_views(["products"], """
SELECT 'category' AS facet, category AS value, count(*) AS n FROM products GROUP BY category
UNION ALL
SELECT 'brand', brand, count(*) FROM products GROUP BY brand"""))
def q_catalog_facets(spark, d):
    return A.catalog_facets(X.products(spark, d), ["category", "brand"])


@register("date_bounds", with_views(["ev"], """
SELECT CAST(min(ts) AS DATE) AS min_date, CAST(max(ts) AS DATE) AS max_date,
       count(DISTINCT user_id) AS n_users FROM ev"""))
def q_date_bounds(spark, d):
    return A.date_bounds(X.events(spark, d))


@register("valid_dwell", with_views(["ev"], """
SELECT event_id, event_type FROM ev
WHERE event_type <> 'time_spent' OR coalesce(time_spent_seconds, 0.0) > 0"""))
def q_valid_dwell(spark, d):
    return A.valid_dwell(X.events(spark, d)).select("event_id", "event_type")


@register("user_history", with_views(["ev"], """
SELECT e.event_id, e.user_id FROM ev e
WHERE e.user_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'BUILDING')"""))
def q_user_history(spark, d):
    users = (X.table(spark, d, "customer").where(F.col("c_mktsegment") == "BUILDING")
             .select(F.col("c_custkey").cast("string").alias("user_id")))
    return A.user_history(X.events(spark, d), users).select("event_id", "user_id")
