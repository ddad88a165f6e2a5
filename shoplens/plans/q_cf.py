"""Registered collaborative-filtering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.functions.weights import CF_SCORES, weight_sql
from shoplens.operators import cf
from shoplens.plans.base import r6, register
from shoplens.sources import fixtures as X
from shoplens.sources.fixtures import with_views

UI_SQL = (f"ui AS (SELECT user_id, item_id, sum({weight_sql('event_type', CF_SCORES, 0)})::DOUBLE "
          "AS score FROM ev GROUP BY user_id, item_id)")
BIG_UI_SQL = UI_SQL.replace("FROM ev", "FROM bev")

NN_CTES = """
nrm AS (SELECT user_id, sqrt(sum(score * score)) AS n FROM ui GROUP BY user_id),
dots AS (SELECT a.user_id AS u, b.user_id AS v, sum(a.score * b.score) AS dot
         FROM ui a JOIN ui b ON a.item_id = b.item_id AND a.user_id <> b.user_id GROUP BY 1, 2),
sims AS (SELECT u, v, dot / (na.n * nb.n) AS sim FROM dots
         JOIN nrm na ON na.user_id = u JOIN nrm nb ON nb.user_id = v
         WHERE na.n > 0 AND nb.n > 0 AND dot / (na.n * nb.n) > 0),
nb AS (SELECT u, v, sim, rn FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY sim DESC, v) AS rn
       FROM sims) WHERE rn <= 5)"""

CF_BODY = """
SELECT user_id, rank, item_id, score FROM (
  SELECT user_id, item_id, score,
         row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
  FROM (SELECT nb.u AS user_id, ui.item_id, sum(ui.score) AS score FROM nb
        JOIN ui ON ui.user_id = nb.v GROUP BY 1, 2) c
  WHERE score <> 0 AND NOT EXISTS (SELECT 1 FROM ui s WHERE s.user_id = c.user_id
                                   AND s.item_id = c.item_id AND s.score <> 0))
WHERE rank <= 5"""


def _matrix(spark, d, big=False):
    ev = X.big_events(spark, d) if big else X.events(spark, d)
    return cf.user_item_matrix(cf.score_events(ev))


@register("score_events", with_views(["ev"], f"""
SELECT event_id, {weight_sql('event_type', CF_SCORES, 0)}::DOUBLE AS score FROM ev"""))
def q_score_events(spark, d):
    return cf.score_events(X.events(spark, d)).select("event_id", "score")


@register("user_item_matrix", with_views(["ev"], "SELECT * FROM ui", UI_SQL))
def q_user_item_matrix(spark, d):
    return _matrix(spark, d)


@register("nearest_users", with_views(["ev"], """
SELECT u AS user_id, v AS neighbor_id, round(sim, 6) AS similarity, rn AS rank FROM nb""",
                                      UI_SQL + "," + NN_CTES))
def q_nearest_users(spark, d):
    nn = cf.nearest_users(_matrix(spark, d))
    return nn.select("user_id", "neighbor_id", r6("similarity").alias("similarity"),
                     F.col("rank").cast("bigint").alias("rank"))


@register("user_cf", with_views(["ev"], CF_BODY, UI_SQL + "," + NN_CTES))
def q_user_cf(spark, d):
    return cf.user_cf(_matrix(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


@register("user_cf_big", with_views(["bev"], CF_BODY, BIG_UI_SQL + "," + NN_CTES))
def q_user_cf_big(spark, d):
    """Same operator on lineitem x orders: ~10x the users and 20x the items."""
    return cf.user_cf(_matrix(spark, d, big=True)).withColumn("rank", F.col("rank").cast("bigint"))


@register("serve_topk_table", with_views(["ev"], f"""
SELECT user_id, string_agg(item_id || '=' || CAST(CAST(score AS BIGINT) AS VARCHAR), ',' ORDER BY score DESC, item_id DESC) AS members
FROM ({CF_BODY}) GROUP BY user_id""", UI_SQL + "," + NN_CTES))
def q_serve_topk(spark, d):
    t = cf.serve_topk_table(cf.user_cf(_matrix(spark, d)))
    return t.select("user_id", F.array_join(F.transform("members", lambda m: F.concat(
        m["item_id"], F.lit("="), m["score"].cast("long").cast("string"))), ",").alias("members"))
