"""Registered online co-cart queries (K1-K5) over the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.operators import online as O
from shoplens.plans.base import r6, register
from shoplens.sources import fixtures as X
from shoplens.sources.fixtures import with_views

DELTA_SQL = """
ac AS (SELECT * FROM ev WHERE event_type = 'add_to_cart'),
prior AS (SELECT event_id, user_id, item_id, ts,
                 list(item_id) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                     ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS prev FROM ac),
deltas AS (SELECT least(p, item_id) AS item_a, greatest(p, item_id) AS item_b, ts
           FROM (SELECT item_id, ts, unnest(prev) AS p FROM prior) WHERE p <> item_id),
pairs AS (SELECT item_a, item_b, CAST(count(*) AS DOUBLE) AS weight, max(ts) AS last_updated
          FROM deltas GROUP BY 1, 2)"""


@register("user_recent_items", with_views(["ev"], """
SELECT user_id, count(*) AS n_items, max(CASE WHEN rn = 1 THEN item_id END) AS newest_item,
       max(CASE WHEN rn = least(50, cnt) THEN item_id END) AS oldest_item
FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn,
             count(*) OVER (PARTITION BY user_id) AS cnt FROM ev WHERE event_type = 'add_to_cart')
WHERE rn <= 50 GROUP BY user_id"""))
def q_user_recent_items(spark, d):
    r = O.user_recent_items(X.events(spark, d))
    return r.select("user_id", F.size("items").cast("bigint").alias("n_items"),
                    F.element_at("items", -1).alias("newest_item"), F.element_at("items", 1).alias("oldest_item"))


@register("co_cart_weights", with_views(["ev"], """
SELECT item_a, item_b, weight, strftime(last_updated, '%Y-%m-%d %H:%M:%S') AS last_updated FROM pairs""",
                                        DELTA_SQL))
def q_co_cart_weights(spark, d):
    p = O.co_cart_weights(X.events(spark, d))
    return p.select("item_a", "item_b", "weight",
                    F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss").alias("last_updated"))


@register("pair_ttl", with_views(["ev"], """
SELECT item_a, item_b, CAST(count(*) AS DOUBLE) AS weight FROM (
  SELECT *, max(isl) OVER (PARTITION BY item_a, item_b) AS last_isl FROM (
    SELECT *, sum(brk) OVER (PARTITION BY item_a, item_b ORDER BY ts, event_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM (
      SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY item_a, item_b ORDER BY ts, event_id))
                          > 86400000000 THEN 1 ELSE 0 END AS brk FROM udeltas)))
WHERE isl = last_isl GROUP BY item_a, item_b""", """
ac AS (SELECT * FROM ev WHERE event_type = 'add_to_cart'),
uisl AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts, event_id
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS isl FROM (
           SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))
                              > 86400000000 THEN 1 ELSE 0 END AS brk FROM ac)),
prior AS (SELECT event_id, user_id, item_id, ts,
                 list(item_id) OVER (PARTITION BY user_id, isl ORDER BY ts, event_id
                                     ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING) AS prev FROM uisl),
udeltas AS (SELECT least(p, item_id) AS item_a, greatest(p, item_id) AS item_b, ts, event_id
            FROM (SELECT item_id, ts, event_id, unnest(prev) AS p FROM prior) WHERE p <> item_id)"""))
def q_pair_ttl(spark, d):
    """K3 with a 1-day TTL (events span 30 days, so a 7-day TTL would rarely expire)."""
    p = O.co_cart_weights(X.events(spark, d), ttl_seconds=86400)
    return p.select("item_a", "item_b", "weight")


BOOST_CTES = DELTA_SQL + """,
cart AS (SELECT user_id, item_id, count(*) AS quantity FROM ev WHERE event_type = 'add_to_cart'
         GROUP BY user_id, item_id),
cand AS (SELECT user_id, item_id, count(*) / 10.0 AS model_score FROM ev WHERE event_type = 'click'
         GROUP BY user_id, item_id),
nowt AS (SELECT max(ts) AS now FROM ev),
boost AS (SELECT c.user_id, c.item_id,
                 sum(k.quantity * p.weight * pow(0.995, abs(epoch_us((SELECT now FROM nowt)) - epoch_us(p.last_updated))
                                                  / 3600000000.0)) AS b
          FROM cand c JOIN cart k ON k.user_id = c.user_id AND k.item_id <> c.item_id
          JOIN pairs p ON p.item_a = least(k.item_id, c.item_id) AND p.item_b = greatest(k.item_id, c.item_id)
          WHERE p.weight > 0 GROUP BY 1, 2),
blended AS (SELECT c.user_id, c.item_id, c.model_score, coalesce(b.b, 0.0) AS online_boost,
                   c.model_score + 0.15 * coalesce(b.b, 0.0) AS blended_score
            FROM cand c LEFT JOIN boost b ON b.user_id = c.user_id AND b.item_id = c.item_id)"""


def _boost_inputs(spark, d):
    ev = X.events(spark, d)
    carts = X.carts(spark, d)
    cand = (ev.where(F.col("event_type") == "click").groupBy("user_id", "item_id")
            .agg((F.count(F.lit(1)) / 10.0).alias("model_score")))
    now = ev.select(F.max("ts")).scalar()
    return ev, carts, cand, now


@register("online_boost", with_views(["ev"], """
SELECT user_id, item_id, round(online_boost, 6) AS online_boost FROM blended""", BOOST_CTES))
def q_online_boost(spark, d):
    ev, carts, cand, now = _boost_inputs(spark, d)
    b = O.online_boost(carts, cand, O.co_cart_weights(ev), now)
    return b.select("user_id", "item_id", r6("online_boost").alias("online_boost"))


@register("blend_scores", with_views(["ev"], """
SELECT user_id, item_id, round(model_score, 6) AS model_score, round(online_boost, 6) AS online_boost,
       round(blended_score, 6) AS blended_score,
       row_number() OVER (PARTITION BY user_id ORDER BY blended_score DESC, item_id) AS rank FROM blended""",
                                     BOOST_CTES))
def q_blend_scores(spark, d):
    ev, carts, cand, now = _boost_inputs(spark, d)
    b = O.blend_scores(carts, cand, O.co_cart_weights(ev), now)
    return b.select("user_id", "item_id", r6("model_score").alias("model_score"),
                    r6("online_boost").alias("online_boost"), r6("blended_score").alias("blended_score"),
                    F.col("rank").cast("bigint").alias("rank"))
