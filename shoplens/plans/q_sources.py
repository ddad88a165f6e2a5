"""Registered source / sink shaped queries."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from shoplens.operators import analytics as A
from shoplens.operators import checkout as K
from shoplens.plans.base import register, ts_text, vec_text, vec_text_sql
from shoplens.session import cut_lineage, ensure_checkpoint_dir
from shoplens.sources import catalog as SC
from shoplens.sources import fixtures as X
from shoplens.sources import sinks as SK
from shoplens.sources.fixtures import with_views

ASSET_BASE = "https://assets.shop.test/"


@register("conform_columns", """
SELECT CAST(p_partkey AS VARCHAR) AS item_id,
       coalesce(nullif(nullif(trim(CASE WHEN p_size > 40 THEN '' ELSE p_name END), ''), 'Unknown'),
                nullif(nullif(trim(p_brand), ''), 'Unknown'), 'unnamed') AS display_name,
       coalesce(nullif(nullif(trim(p_type), ''), 'Unknown'), 'fashion') AS category
FROM part""")
def q_conform(spark, d):
    p = X.table(spark, d, "part").withColumn("item_id", F.col("p_partkey").cast("string")).withColumn(
        "name_raw", F.when(F.col("p_size") > 40, F.lit("")).otherwise(F.col("p_name")))
    return SC.conform_columns(p, {"item_id": (["item_id"], None),
                                  "display_name": (["name_raw", "missing_col", "p_brand"], "unnamed"),
                                  "category": (["p_type"], "fashion")})


@register("embeddings_positional", with_views(["image_emb"], f"""
SELECT p.item_id, {vec_text_sql('e.embedding')} AS vector FROM
  (SELECT CAST(p_partkey AS VARCHAR) AS item_id, row_number() OVER (ORDER BY p_partkey) - 1 AS pos FROM part) p
JOIN (SELECT vec_id AS pos, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings) e ON e.pos = p.pos"""))
def q_embeddings_positional(spark, d):
    cat = X.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("item_id"), "p_partkey")
    m = X.table(spark, d, "embeddings").select(F.col("vec_id").alias("pos"), "embedding")
    out = SC.embeddings_from_matrix(m, cat, [F.col("item_id").cast("long")])
    return out.select("item_id", vec_text("embedding").alias("vector"))


@register("embeddings_parallel", f"""
SELECT CAST(i AS VARCHAR) AS item_id, {vec_text_sql('v')} AS vector FROM (
  SELECT unnest(ids[1:least(len(ids), len(vecs))]) AS i, unnest(vecs[1:least(len(ids), len(vecs))]) AS v FROM (
    SELECT label, list(vec_id ORDER BY vec_id) AS ids,
           list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id)[2:] AS vecs FROM embeddings GROUP BY label))""")
def q_embeddings_parallel(spark, d):
    """Payload chunks of parallel id / vector arrays (one chunk per label, vectors one short)."""
    e = X.table(spark, d, "embeddings")
    chunks = e.groupBy("label").agg(
        F.sort_array(F.collect_list(F.struct("vec_id", "embedding"))).alias("_s")).select(
        F.transform("_s", lambda s: s["vec_id"]).alias("product_ids"),
        F.expr("slice(transform(_s, s -> s.embedding), 2, size(_s))").alias("vectors"))
    return SC.embeddings_from_parallel(chunks).select("item_id", vec_text("embedding").alias("vector"))


@register("upsert_products", """
WITH cur AS (SELECT p_partkey AS id, p_name AS name, p_type AS category, p_retailprice AS price FROM part),
inc AS (SELECT p_partkey AS id,
               coalesce(CASE WHEN p_size < 10 THEN NULL ELSE upper(p_name) END,
                        CASE WHEN p_size < 5 THEN NULL ELSE p_type END, 'Product ' || p_partkey) AS name,
               coalesce(CASE WHEN p_size > 45 THEN NULL ELSE p_brand END, 'fashion') AS category,
               1000.0 AS price FROM part WHERE p_type = 'PROMO')
SELECT * FROM inc UNION ALL SELECT * FROM cur WHERE id NOT IN (SELECT id FROM inc)""")
def q_upsert_products(spark, d):
    p = X.table(spark, d, "part")
    cur = p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"),
                   F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"))
    inc = p.where(F.col("p_type") == "PROMO").select(
        F.col("p_partkey").alias("id"),
        F.when(F.col("p_size") >= 10, F.upper("p_name")).alias("productDisplayName"),
        F.when(F.col("p_size") >= 5, F.col("p_type")).alias("articleType"),
        F.when(F.col("p_size") <= 45, F.col("p_brand")).alias("masterCategory"),
        F.lit(1).cast("long").alias("_seq"))
    return SC.upsert_products(cur, inc)


@register("export_user_token", r"""
SELECT c_custkey, coalesce(nullif(regexp_replace(regexp_replace(c_name || ' #' || c_mktsegment,
         '[^A-Za-z0-9\-_@.+]', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unknown_user') AS user_token
FROM customer""")
def q_export_token(spark, d):
    c = X.table(spark, d, "customer")
    return c.select("c_custkey", SK.safe_user_token(F.concat(F.col("c_name"), F.lit(" #"), F.col("c_mktsegment")))
                    .alias("user_token"))


LISTING_SQL = ("SELECT 'img/' || p_partkey || '.jpg' AS key FROM part UNION ALL "
               "SELECT 'docs/' || p_partkey || '.txt' FROM part WHERE p_size > 30 UNION ALL "
               "SELECT 'img/x-' || p_name || '-' || p_partkey || '.png' FROM part WHERE p_size < 3")


def _listing(spark, d):
    p = X.table(spark, d, "part")
    k = F.col("p_partkey").cast("string")
    return (p.select(F.concat(F.lit("img/"), k, F.lit(".jpg")).alias("key"))
            .unionByName(p.where(F.col("p_size") > 30).select(F.concat(F.lit("docs/"), k, F.lit(".txt")).alias("key")))
            .unionByName(p.where(F.col("p_size") < 3).select(
                F.concat(F.lit("img/x-"), F.col("p_name"), F.lit("-"), k, F.lit(".png")).alias("key"))))


@register("asset_catalog", with_views(["products"], f"""
SELECT coalesce(TRY_CAST(base AS BIGINT), ordinal) AS id,
       CASE WHEN TRY_CAST(base AS BIGINT) IS NOT NULL THEN coalesce(nullif(p.product_name, ''), base) ELSE base END AS name,
       '{ASSET_BASE}' || key AS image_url,
       p.price, p.category AS master_category, NULL::VARCHAR AS sub_category, p.category AS article_type, p.gender
FROM (SELECT key, row_number() OVER (ORDER BY key) AS ordinal,
             regexp_replace(split_part(key, '/', -1), '\\.[^.]*$', '') AS base FROM ({LISTING_SQL})) l
LEFT JOIN products p ON CAST(p.item_id AS BIGINT) = TRY_CAST(l.base AS BIGINT)
WHERE regexp_matches(key, '\\.(jpg|png|jpeg)$')"""))
def q_asset_catalog(spark, d):
    p = X.products(spark, d).withColumn("master_category", F.col("category")).withColumn("article_type", F.col("category"))
    return SC.asset_catalog(_listing(spark, d), p, ASSET_BASE)


@register("upsert_users", """
SELECT lower(trim(replace(c_name, '#', '.') || '@Shop.test')) AS email,
       (list(trim(c_name || ' ' || o_orderpriority) ORDER BY o_orderdate DESC, trim(c_name || ' ' || o_orderpriority) DESC))[1] AS name,
       strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS created_at,
       strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') AS last_login_at
FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def q_upsert_users(spark, d):
    o = X.table(spark, d, "orders").join(X.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    logins = o.select(F.concat(F.regexp_replace("c_name", "#", "."), F.lit("@Shop.test")).alias("email"),
                      F.concat(F.col("c_name"), F.lit(" "), F.col("o_orderpriority")).alias("name"),
                      F.col("o_orderdate").cast("timestamp").alias("ts"))
    u = SC.upsert_users(logins)
    return u.select("email", "name", ts_text("created_at").alias("created_at"),
                    ts_text("last_login_at").alias("last_login_at"))


@register("user_sessions", with_views(["ev"], """
SELECT session_id, user_id, rn AS position FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, session_id) AS rn FROM (
    SELECT user_id || ':' || CAST(CAST(ts AS DATE) AS VARCHAR) AS session_id, user_id, min(ts) AS started_at
    FROM ev GROUP BY user_id, CAST(ts AS DATE))) WHERE rn <= 5"""))
def q_user_sessions(spark, d):
    """Each user's 5 latest sessions."""
    from shoplens.operators.sequences import daily_logins
    s = daily_logins(X.events(spark, d))
    w = Window.partitionBy("user_id").orderBy(F.desc("started_at"), "session_id")
    return s.withColumn("position", F.row_number().over(w)).where("position <= 5").select(
        "session_id", "user_id", F.col("position").cast("bigint").alias("position"))


@register("fetch_cart", with_views(["carts"], """
SELECT c.user_id, c.item_id, c.quantity FROM carts c
WHERE c.user_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_mktsegment = 'MACHINERY')"""))
def q_fetch_cart(spark, d):
    """Cart rows of the requested (user, NULL session) pairs."""
    cart = X.carts(spark, d).withColumn("session_id", F.lit(None).cast("string"))
    req = (X.table(spark, d, "customer").where(F.col("c_mktsegment") == "MACHINERY")
           .select(F.col("c_custkey").cast("string").alias("user_id"), F.lit(None).cast("string").alias("session_id")))
    return A.fetch_cart(cart, req).select("user_id", "item_id", "quantity")


def _shown(spark, d):
    from shoplens.plans.q_checkout import _carts
    from shoplens.plans.q_vectors import ranker_products
    recs = K.cart_retrieval(_carts(spark, d), ranker_products(spark, d), X.image_emb(spark, d), 6)
    return recs.select(F.col("cart_id").alias("user_id"), F.lit("").alias("user_email"),
                       F.lit(None).cast("string").alias("session_id"), "item_id",
                       F.lit("checkout").alias("source"), "rank", "similarity_score")


def _retr_sql():
    from shoplens.plans.q_checkout import RETR_CTES
    return RETR_CTES


@register("log_impressions", with_views(["carts", "products", "image_emb"], """
SELECT DISTINCT cart_id AS user_id, cart_id AS user_email, CAST(item_id AS BIGINT) AS item_id, 'checkout' AS source,
       rank <= 3 AS shown_before FROM retr""", _retr_sql()))
def q_log_impressions(spark, d):
    """Shown checkout items become impression rows; then all are shown again, twice, and only new ones are added."""
    shown = cut_lineage(_shown(spark, d))
    logged = cut_lineage(SK.log_impressions(None, shown.where("rank <= 3")))
    new = SK.log_impressions(logged, shown.unionByName(shown))
    columns = ["user_id", "user_email", "item_id", "source"]
    return logged.select(*columns, F.lit(True).alias("shown_before")).unionByName(new.select(*columns, F.lit(False).alias("shown_before")))


# the log's latest buyers: their rows are written a second time
BUYERS = """
late AS (SELECT DISTINCT user_id FROM ev WHERE event_type = 'purchase' AND ts >= (SELECT max(ts) FROM ev) - INTERVAL 1 DAY),
write2 AS (SELECT 'cart_item' AS row_type, user_id, item_id, true AS added, 0 AS shown_rank FROM carts
           WHERE quantity >= 2 AND user_id IN (SELECT user_id FROM late)
           UNION ALL SELECT 'recommendation', cart_id, item_id, false, rank FROM retr WHERE rank > 3 AND cart_id IN (SELECT user_id FROM late)),
write1 AS (SELECT 'cart_item' AS row_type, user_id, item_id, true AS added, 0 AS shown_rank FROM carts
          UNION ALL SELECT 'recommendation', cart_id, item_id, false, rank FROM retr WHERE rank <= 3),
written AS (SELECT * FROM write2 UNION ALL SELECT * FROM write1 f
         WHERE NOT EXISTS (SELECT 1 FROM write2 s WHERE s.user_id = f.user_id AND s.row_type = f.row_type)),
kept AS (SELECT * FROM written QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY row_type) = 1)"""


@register("checkout_tracker", with_views(["ev", "carts", "products", "image_emb"], """
SELECT row_type, user_id AS user_email, item_id, added OR c.n IS NOT NULL AS added_to_cart, shown_rank
FROM kept k LEFT JOIN (SELECT user_id AS u, item_id AS i, 1 AS n FROM carts) c ON c.u = k.user_id AND c.i = k.item_id
UNION ALL
SELECT 'recommendation', user_id, item_id, true, NULL FROM carts c
WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.user_id = c.user_id AND k.item_id = c.item_id)""", _retr_sql() + "," + BUYERS))
def q_checkout_tracker(spark, d):
    """J21 + J22 on a stored tracker: rows of every cart, the latest buyers' rows again, then all adds, each given twice."""
    from shoplens.plans.q_checkout import _carts
    carts, prods, ev = cut_lineage(_carts(spark, d)), X.products(spark, d), X.events(spark, d)
    named = prods.select("item_id", "product_name", "price")
    cart_rows = carts.join(named, "item_id", "left").select(
        F.col("cart_id").alias("user_email"), F.lit(None).cast("string").alias("session_id"),
        F.lit("checkout").alias("source"), "item_id", "product_name", "price", "quantity", "added_at")
    shown = cut_lineage(_shown(spark, d)).join(named, "item_id", "left")
    rec_rows = shown.select(
        F.col("user_id").alias("user_email"), "session_id", "source", "item_id", "product_name", "price", "rank",
        "similarity_score", F.lit(None).cast("double").alias("ranking_score"),
        F.col("similarity_score").alias("fallback_score"),
        F.lit(None).cast("double").alias("lgbm_ranking_score"), F.lit(None).cast("double").alias("xgboost_ranking_score"))
    cutoff = ev.select(F.max("ts")).scalar() - F.make_interval(days=F.lit(1))
    late = ev.where((F.col("event_type") == "purchase") & (F.col("ts") >= cutoff)).select(F.col("user_id").alias("user_email")).distinct()
    table = SK.tracker_table(spark, f"{ensure_checkpoint_dir(spark)}/tracker-{uuid.uuid4().hex[:12]}")
    SK.save_tracker(table, cart_rows, rec_rows.where("rank <= 3"), 0)
    SK.save_tracker(table, cart_rows.where("quantity >= 2").join(late, "user_email", "left_semi"),
                    rec_rows.where("rank > 3").join(late, "user_email", "left_semi"), 1)
    adds = cart_rows.select("user_email", "session_id", "source", "item_id", "added_at")
    SK.save_added(table, adds.unionByName(adds), 2)
    return table.read().select("row_type", "user_email", "item_id", "added_to_cart", F.col("shown_rank").cast("bigint").alias("shown_rank"))
