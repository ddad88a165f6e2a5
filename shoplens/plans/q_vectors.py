"""Registered vector / retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shoplens.functions import vectors as V
from shoplens.functions.weights import INTERACTION_DEFAULT, INTERACTION_WEIGHTS, weight_sql
from shoplens.operators import candidates as C
from shoplens.operators import profiles as P
from shoplens.operators import vectors as VO
from shoplens.plans.base import r6, register, vec_text, vec_text_sql
from shoplens.sources import fixtures as X
from shoplens.sources.fixtures import with_views


def ranker_products(spark, d):
    return P.prepare_products(X.products(spark, d), X.rank_events(spark, d))


@register("vector_math", with_views(["image_emb", "text_emb"], """
SELECT i.item_id, round(list_dot_product(i.embedding, t.embedding), 6) AS dot,
       round(sqrt(list_dot_product(i.embedding, i.embedding)), 6) AS norm,
       round(list_dot_product(i.embedding, t.embedding)
             / (sqrt(list_dot_product(i.embedding, i.embedding)) * sqrt(list_dot_product(t.embedding, t.embedding))), 6)
         AS cosine
FROM image_emb i JOIN text_emb t ON t.item_id = i.item_id"""))
def q_vector_math(spark, d):
    i = X.image_emb(spark, d).withColumnRenamed("embedding", "a")
    t = X.text_emb(spark, d).withColumnRenamed("embedding", "b")
    j = i.join(t, "item_id")
    return j.select("item_id", r6(V.dot("a", "b")).alias("dot"), r6(V.l2_norm("a")).alias("norm"),
                    r6(V.cosine("a", "b")).alias("cosine"))


COMB_SQL = """
comb0 AS (SELECT i.item_id, list_transform(list_zip(i.embedding, t.embedding), lambda p: p[1] * 0.6 + p[2] * 0.4) AS v
          FROM image_emb i JOIN text_emb t ON t.item_id = i.item_id),
comb AS (SELECT item_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS embedding FROM comb0)"""


@register("combine_embeddings", with_views(["image_emb", "text_emb"], f"""
SELECT item_id, {vec_text_sql('embedding')} AS vector,
       round(sqrt(list_dot_product(embedding, embedding)), 6) AS norm FROM comb""", COMB_SQL))
def q_combine(spark, d):
    c = VO.combine_embeddings(X.image_emb(spark, d), X.text_emb(spark, d), 0.6, 0.4)
    return c.select("item_id", vec_text("embedding").alias("vector"), r6(V.l2_norm("embedding")).alias("norm"))


QV_SQL = f"""
win AS (SELECT * FROM rev WHERE ts >= (SELECT max(ts) FROM rev) - INTERVAL 7 DAY),
items AS (SELECT * FROM image_emb WHERE item_id IN (SELECT item_id FROM products)),
terms AS (SELECT w.user_id, {weight_sql('w.event_type', INTERACTION_WEIGHTS, INTERACTION_DEFAULT)} AS wt,
                 unnest(e.embedding) AS x, generate_subscripts(e.embedding, 1) AS pos
          FROM win w JOIN items e ON e.item_id = w.item_id),
qsum AS (SELECT user_id, pos, sum(wt * x) AS s FROM terms GROUP BY user_id, pos),
qv0 AS (SELECT user_id, list(s ORDER BY pos) AS v FROM qsum GROUP BY user_id),
qv AS (SELECT user_id, CASE WHEN sqrt(list_dot_product(v, v)) > 0
                            THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) ELSE v END AS v FROM qv0)"""


@register("query_vector", with_views(["rev", "products", "image_emb"], f"""
SELECT user_id, {vec_text_sql('v')} AS vector,
       round(sqrt(list_dot_product(v, v)), 6) AS norm FROM qv""", QV_SQL))
def q_query_vector(spark, d):
    from shoplens.operators.analytics import recent_events
    win = recent_events(X.rank_events(spark, d), 7)
    items = VO.embedded_items(X.image_emb(spark, d), X.products(spark, d))
    q = VO.query_vectors(win, items)
    return q.select("user_id", vec_text("vector").alias("vector"), r6(V.l2_norm("vector")).alias("norm"))


@register("context_vectors", with_views(["rev", "products", "image_emb"], f"""
SELECT u.user_id, {vec_text_sql('c.v')} AS cart_vector, {vec_text_sql('k.v')} AS click_vector
FROM (SELECT DISTINCT user_id FROM win) u
LEFT JOIN cv c ON c.user_id = u.user_id AND c.kind = 'cart'
LEFT JOIN cv k ON k.user_id = u.user_id AND k.kind = 'click'""", QV_SQL.split("terms AS")[0] + """
cterms AS (SELECT w.user_id, CASE WHEN w.event_type = 'click' THEN 'click' ELSE 'cart' END AS kind,
                  unnest(e.embedding) AS x, generate_subscripts(e.embedding, 1) AS pos
           FROM win w JOIN items e ON e.item_id = w.item_id
           WHERE w.event_type IN ('click', 'add_to_cart', 'purchase')),
cm AS (SELECT user_id, kind, list(m ORDER BY pos) AS v FROM
       (SELECT user_id, kind, pos, avg(x) AS m FROM cterms GROUP BY 1, 2, 3) GROUP BY 1, 2),
cv AS (SELECT user_id, kind, CASE WHEN sqrt(list_dot_product(v, v)) > 0
              THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) ELSE v END AS v FROM cm)"""))
def q_context_vectors(spark, d):
    from shoplens.operators.analytics import recent_events
    win = recent_events(X.rank_events(spark, d), 7)
    items = VO.embedded_items(X.image_emb(spark, d), X.products(spark, d))
    c = VO.context_vectors(win, items)
    return c.select("user_id", vec_text("cart_vec").alias("cart_vector"), vec_text("click_vec").alias("click_vector"))


CAND_SQL = QV_SQL + """,
pstats2 AS (SELECT p.item_id, p.in_stock, coalesce(c.n, 0) AS n FROM products p
            LEFT JOIN (SELECT item_id, count(*) AS n FROM rev GROUP BY item_id) c ON c.item_id = p.item_id),
pop AS (SELECT item_id, in_stock, CASE WHEN (SELECT max(n) FROM pstats2) > 0 THEN n / (SELECT max(n) FROM pstats2)
                                  ELSE 0.0 END AS popularity_score FROM pstats2),
purch AS (SELECT DISTINCT user_id, item_id FROM win WHERE event_type = 'purchase'),
scored AS (SELECT q.user_id, i.item_id, list_dot_product(q.v, i.embedding) AS s FROM qv q, items i),
warm AS (SELECT s.user_id, s.item_id, s.s FROM scored s LEFT JOIN products p ON p.item_id = s.item_id
         WHERE NOT EXISTS (SELECT 1 FROM purch x WHERE x.user_id = s.user_id AND x.item_id = s.item_id)
           AND coalesce(p.in_stock, true)),
warm_r AS (SELECT user_id, item_id, s AS similarity_score, false AS is_cold_start,
                  row_number() OVER (PARTITION BY user_id ORDER BY s DESC, item_id) AS rank FROM warm),
cold_u AS (SELECT DISTINCT user_id FROM rev WHERE user_id NOT IN (SELECT user_id FROM qv)),
cold AS (SELECT u.user_id, p.item_id, 0.0 AS similarity_score, true AS is_cold_start,
                row_number() OVER (PARTITION BY u.user_id ORDER BY p.popularity_score DESC, p.item_id) AS rank
         FROM cold_u u, pop p WHERE p.in_stock
           AND NOT EXISTS (SELECT 1 FROM purch x WHERE x.user_id = u.user_id AND x.item_id = p.item_id))"""


@register("candidates", with_views(["rev", "products", "image_emb"], """
SELECT user_id, item_id, round(similarity_score, 6) AS similarity_score, is_cold_start, rank
FROM (SELECT * FROM warm_r UNION ALL SELECT * FROM cold) WHERE rank <= 10""", CAND_SQL))
def q_candidates(spark, d):
    c = C.candidates(X.rank_events(spark, d), ranker_products(spark, d), X.image_emb(spark, d),
                     top_n=10, recency_days=7)
    return c.select("user_id", "item_id", r6("similarity_score").alias("similarity_score"),
                    "is_cold_start", F.col("rank").cast("bigint").alias("rank"))


@register("cold_start", with_views(["rev", "products", "image_emb"], """
SELECT user_id, item_id, rank FROM cold WHERE rank <= 10""", CAND_SQL.replace(
    "cold_u AS (SELECT DISTINCT user_id FROM rev WHERE",
    "cold_u AS (SELECT DISTINCT user_id FROM (SELECT user_id FROM rev UNION SELECT CAST(c_custkey AS VARCHAR) "
    "FROM customer) WHERE")))
def q_cold_start(spark, d):
    """Every customer is a user; those with no recent vector history are cold."""
    ev = X.rank_events(spark, d)
    users = ev.select("user_id").unionByName(
        X.table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("user_id"))).distinct()
    c = C.candidates(ev, ranker_products(spark, d), X.image_emb(spark, d), top_n=10, recency_days=7,
                     users=users)
    return c.where("is_cold_start").select("user_id", "item_id", F.col("rank").cast("bigint").alias("rank"))


@register("item_similarity_table", with_views(["products", "image_emb", "text_emb"], """
SELECT query_id, query_name, rank, similar_id, similar_name, round(sim, 6) AS similarity_score FROM (
  SELECT a.item_id AS query_id, pa.product_name AS query_name, b.item_id AS similar_id,
         pb.product_name AS similar_name, list_dot_product(a.embedding, b.embedding) AS sim,
         row_number() OVER (PARTITION BY a.item_id ORDER BY list_dot_product(a.embedding, b.embedding) DESC,
                            b.item_id) AS rank
  FROM comb a JOIN comb b ON a.item_id <> b.item_id
  LEFT JOIN products pa ON pa.item_id = a.item_id LEFT JOIN products pb ON pb.item_id = b.item_id)
WHERE rank <= 5""", COMB_SQL))
def q_item_similarity(spark, d):
    comb = VO.combine_embeddings(X.image_emb(spark, d), X.text_emb(spark, d), 0.6, 0.4)
    t = VO.item_similarity_table(comb, X.products(spark, d), 5)
    return t.select("query_id", "query_name", F.col("rank").cast("bigint").alias("rank"), "similar_id",
                    "similar_name", r6("similarity_score").alias("similarity_score"))


@register("fill_missing_embeddings", with_views(["products", "image_emb"], """
SELECT (SELECT count(*) FROM products) AS n_items,
       (SELECT count(*) FROM products WHERE item_id NOT IN (SELECT item_id FROM image_emb)) AS n_synthetic"""))
def q_fill_missing(spark, d):
    f = VO.fill_missing_embeddings(X.products(spark, d), X.image_emb(spark, d), 64)
    return f.agg(F.count(F.lit(1)).alias("n_items"), F.count_if("synthetic").alias("n_synthetic"))


@register("embedding_stats", with_views(["products", "image_emb", "text_emb"], """
SELECT (SELECT count(*) FROM products) AS n_products, (SELECT count(*) FROM image_emb) AS n_image,
       (SELECT count(*) FROM text_emb) AS n_text, (SELECT max(len(embedding)) FROM image_emb) AS dim"""))
def q_embedding_stats(spark, d):
    """Catalog size, vectors per modality, dimension (one pass per table)."""
    p = X.products(spark, d).agg(F.count(F.lit(1)).alias("n_products"))
    i = X.image_emb(spark, d).agg(F.count(F.lit(1)).alias("n_image"), F.max(F.size("embedding")).alias("dim"))
    t = X.text_emb(spark, d).agg(F.count(F.lit(1)).alias("n_text"))
    return _stats_row(p, i, t)


def _stats_row(p, i, t):
    # three 1-row aggregates combined as scalar subqueries (no join of unrelated tables)
    return p.select("n_products", i.select("n_image").scalar().alias("n_image"),
                    t.select("n_text").scalar().alias("n_text"),
                    i.select(F.col("dim").cast("bigint")).scalar().alias("dim"))


@register("unseen_items", with_views(["rev", "products", "image_emb"], """
SELECT c.user_id, c.item_id FROM (SELECT * FROM warm_r UNION ALL SELECT * FROM cold) c
WHERE c.rank <= 10 AND NOT EXISTS (SELECT 1 FROM rev e WHERE e.user_id = c.user_id AND e.item_id = c.item_id)""",
                                  CAND_SQL))
def q_unseen_items(spark, d):
    """Candidates minus everything the user has seen (anti join, any history size)."""
    ev = X.rank_events(spark, d)
    c = C.candidates(ev, ranker_products(spark, d), X.image_emb(spark, d), top_n=10, recency_days=7)
    return C.exclude_pairs(c, ev).select("user_id", "item_id")


@register("ann_recall")
def q_ann_recall(spark, d):
    """J2 approximate: recall@10 of KMeans-cell search against the exact tiled search,
    text vectors querying image vectors (rows-only: clustering is iterative)."""
    q = X.text_emb(spark, d).select(F.col("item_id").alias("user_id"), F.col("embedding").alias("vector"))
    items = X.image_emb(spark, d)
    exact = VO.vector_topn(q, items, 10)
    approx = VO.vector_topn_ann(q, items, 10, n_probe=8)
    hits = exact.join(approx.select("user_id", "item_id"), ["user_id", "item_id"]).groupBy("user_id").count()
    users = exact.select("user_id").distinct()
    return users.join(hits, "user_id", "left").agg(
        F.round(F.avg(F.coalesce(F.col("count"), F.lit(0)) / 10.0), 4).alias("recall_at_10"),
        F.count(F.lit(1)).alias("n_queries"))
