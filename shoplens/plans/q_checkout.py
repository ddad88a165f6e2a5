"""Registered checkout queries (J13, J19, J20, D17, D18, C11, G1, G2) over per-user carts."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from shoplens.functions import scalars as S
from shoplens.functions.weights import INTERACTION_DEFAULT, INTERACTION_WEIGHTS, weight_sql
from shoplens.operators import analytics as A
from shoplens.operators import cf
from shoplens.operators import checkout as K
from shoplens.operators import profiles as P
from shoplens.operators import vectors as VO
from shoplens.plans.base import r6, register
from shoplens.plans.q_cf import CF_BODY, NN_CTES, UI_SQL
from shoplens.plans.q_vectors import COMB_SQL, ranker_products
from shoplens.session import cut_lineage
from shoplens.sources import fixtures as X
from shoplens.sources.fixtures import with_views


def _carts(spark, d):
    return X.carts(spark, d).select(F.col("user_id").alias("cart_id"), "item_id", "quantity",
                                    F.col("created_at").alias("added_at"))


_USABLE = "(CASE WHEN lower(trim(category)) IN ('unknown','none','nan','') OR category IS NULL THEN NULL ELSE lower(trim(category)) END)"
_TYPE = f"coalesce({_USABLE}, {S.type_from_name_sql('product_name')})"
_GROUPS = " ".join(f"WHEN t IN ({', '.join(repr(x) for x in ts)}) THEN '{g}'" for g, ts in S.CATEGORY_GROUPS)

META_CTES = f"""
cartc AS (SELECT user_id AS cart_id, item_id, quantity FROM carts),
attrs0 AS (SELECT item_id, price, {_TYPE} AS t, {_USABLE} AS ucat,
                  nullif(lower(trim(gender)), '') AS _gender,
                  {S.BRAND_SQL.format(x="product_name")} AS _brand FROM products),
attrs AS (SELECT item_id, price, t AS _type,
                 coalesce(ucat, CASE {_GROUPS} WHEN t <> 'unknown' THEN 'apparel' ELSE 'unknown' END) AS _cat,
                 _gender, _brand FROM attrs0),
ci AS (SELECT c.cart_id, a.* FROM cartc c JOIN attrs a ON a.item_id = c.item_id),
sets AS (SELECT cart_id,
           coalesce(list(DISTINCT _type) FILTER (WHERE _type <> 'unknown'), []) AS known_types,
           coalesce(list(DISTINCT _type), []) AS types,
           coalesce(list(DISTINCT _cat) FILTER (WHERE _cat <> 'unknown'), []) AS cats,
           coalesce(list(DISTINCT _gender) FILTER (WHERE _gender IS NOT NULL), []) AS genders,
           coalesce(list(DISTINCT _brand) FILTER (WHERE _brand <> 'unknown'), []) AS brands
         FROM ci GROUP BY cart_id),
ranges AS (SELECT s.cart_id,
   (SELECT min(price) FROM attrs a WHERE a.price > 0
      AND a.item_id NOT IN (SELECT item_id FROM cartc x WHERE x.cart_id = s.cart_id)) AS lo,
   (SELECT max(price) FROM attrs a WHERE a.price > 0
      AND a.item_id NOT IN (SELECT item_id FROM cartc x WHERE x.cart_id = s.cart_id)) AS hi FROM sets s),
mscored AS (SELECT s.cart_id, a.item_id,
   (CASE WHEN len(known_types) > 0 AND list_contains(known_types, a._type) THEN 8.0
         WHEN len(known_types) > 0 AND a._type = 'unknown' THEN -3.0
         WHEN len(known_types) > 0 THEN -2.0
         WHEN a._type <> 'unknown' AND list_contains(types, a._type) THEN 4.0 ELSE 0.0 END)
   + (CASE WHEN a._cat <> 'unknown' AND list_contains(cats, a._cat) THEN 2.0 ELSE 0.0 END)
   + (CASE WHEN a._gender IS NOT NULL AND list_contains(genders, a._gender) THEN 0.8 ELSE 0.0 END)
   + (CASE WHEN a._brand <> 'unknown' AND list_contains(brands, a._brand) THEN 0.6 ELSE 0.0 END)
   + (CASE WHEN coalesce(a.price, 0.0) > 0 AND coalesce(r.hi, 0.0) > coalesce(r.lo, 0.0)
           THEN greatest(0.0, least(1.0, (coalesce(r.hi, 0.0) - coalesce(a.price, 0.0))
                                          / (coalesce(r.hi, 0.0) - coalesce(r.lo, 0.0)))) * 2.0
           WHEN coalesce(a.price, 0.0) > 0 AND coalesce(r.hi, 0.0) > 0 THEN 1.0 ELSE 0.0 END) AS similarity_score
   FROM sets s JOIN ranges r ON r.cart_id = s.cart_id, attrs a
   WHERE NOT EXISTS (SELECT 1 FROM cartc x WHERE x.cart_id = s.cart_id AND x.item_id = a.item_id)),
meta AS (SELECT * FROM (SELECT cart_id, item_id, similarity_score,
                row_number() OVER (PARTITION BY cart_id ORDER BY similarity_score DESC, item_id) AS rank
         FROM mscored) WHERE rank <= 10)"""


@register("metadata_candidates", with_views(["carts", "products"], """
SELECT cart_id, item_id, round(similarity_score, 6) AS similarity_score, rank FROM meta""", META_CTES))
def q_metadata_candidates(spark, d):
    m = K.metadata_candidates(X.products(spark, d), _carts(spark, d), top_n=10)
    return m.select("cart_id", "item_id", r6("similarity_score").alias("similarity_score"),
                    F.col("rank").cast("bigint").alias("rank"))


SIM_CTES = COMB_SQL + """,
simt AS (SELECT query_id, similar_id, sim AS similarity_score FROM (
  SELECT a.item_id AS query_id, b.item_id AS similar_id, list_dot_product(a.embedding, b.embedding) AS sim,
         row_number() OVER (PARTITION BY a.item_id ORDER BY list_dot_product(a.embedding, b.embedding) DESC,
                            b.item_id) AS rk
  FROM comb a JOIN comb b ON a.item_id <> b.item_id) WHERE rk <= 5),
cq AS (SELECT user_id AS cart_id, item_id, sum(greatest(1, coalesce(quantity, 1))) AS w FROM carts GROUP BY 1, 2),
csim AS (SELECT cart_id, similar_id AS item_id, max(similarity_score) AS similarity_score,
                CASE WHEN sum(w) <> 0 THEN sum(similarity_score * w) / sum(w) ELSE max(similarity_score) END
                  AS ranking_score
         FROM cq JOIN simt s ON s.query_id = cq.item_id
         WHERE NOT EXISTS (SELECT 1 FROM carts x WHERE x.user_id = cq.cart_id AND x.item_id = s.similar_id)
         GROUP BY cart_id, similar_id),
csim_r AS (SELECT *, row_number() OVER (PARTITION BY cart_id ORDER BY ranking_score DESC, item_id) AS rank
           FROM csim)"""


def _sim_table(spark, d):
    comb = VO.combine_embeddings(X.image_emb(spark, d), X.text_emb(spark, d), 0.6, 0.4)
    return VO.item_similarity_table(comb, X.products(spark, d), 5)


@register("cart_similarity_scores", with_views(["carts", "products", "image_emb", "text_emb"], """
SELECT cart_id, item_id, round(similarity_score, 6) AS similarity_score, round(ranking_score, 6) AS ranking_score,
       rank FROM csim_r WHERE rank <= 10""", SIM_CTES))
def q_cart_similarity(spark, d):
    s = K.cart_similarity_scores(_carts(spark, d), _sim_table(spark, d), top_n=10)
    return s.select("cart_id", "item_id", r6("similarity_score").alias("similarity_score"),
                    r6("ranking_score").alias("ranking_score"), F.col("rank").cast("bigint").alias("rank"))


RETR_CTES = """
items AS (SELECT * FROM image_emb WHERE item_id IN (SELECT item_id FROM products)),
lines AS (SELECT c.user_id AS cart_id, unnest(e.embedding) AS x, generate_subscripts(e.embedding, 1) AS pos
          FROM carts c JOIN items e ON e.item_id = c.item_id),
cq0 AS (SELECT cart_id, list(s ORDER BY pos) AS v FROM (SELECT cart_id, pos, sum(2.0 * x) AS s FROM lines
        GROUP BY 1, 2) GROUP BY cart_id),
cqv AS (SELECT cart_id, CASE WHEN sqrt(list_dot_product(v, v)) > 0
               THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) ELSE v END AS v FROM cq0),
rtop AS (SELECT q.cart_id, i.item_id, list_dot_product(q.v, i.embedding) AS similarity_score FROM cqv q, items i),
retr AS (SELECT * FROM (SELECT cart_id, item_id, similarity_score,
                row_number() OVER (PARTITION BY cart_id ORDER BY similarity_score DESC, item_id) AS rank
         FROM rtop t WHERE NOT EXISTS (SELECT 1 FROM carts x WHERE x.user_id = t.cart_id AND x.item_id = t.item_id))
         WHERE rank <= 6)"""


@register("cart_retrieval", with_views(["carts", "products", "image_emb"], """
SELECT cart_id, item_id, round(similarity_score, 6) AS similarity_score, rank FROM retr""", RETR_CTES))
def q_cart_retrieval(spark, d):
    r = K.cart_retrieval(_carts(spark, d), ranker_products(spark, d), X.image_emb(spark, d), top_k=6)
    return r.select("cart_id", "item_id", r6("similarity_score").alias("similarity_score"),
                    F.col("rank").cast("bigint").alias("rank"))


@register("cart_quantity", with_views(["ev"], """
SELECT user_id, item_id, count(*) AS quantity FROM ev WHERE event_type = 'add_to_cart' GROUP BY 1, 2"""))
def q_cart_quantity(spark, d):
    return K.cart_quantity(X.events(spark, d)).select("user_id", "item_id", "quantity")


@register("cart_details", with_views(["carts", "products"], """
SELECT c.user_id AS cart_id, c.item_id, c.quantity, CAST(trunc(p.price) AS BIGINT) * c.quantity AS subtotal,
       CAST(sum(CAST(trunc(p.price) AS BIGINT) * c.quantity) OVER (PARTITION BY c.user_id) AS BIGINT) AS total
FROM carts c JOIN products p ON p.item_id = c.item_id"""))
def q_cart_details(spark, d):
    return K.cart_details(_carts(spark, d), X.products(spark, d)).select(
        "cart_id", "item_id", "quantity", "subtotal", "total")


@register("cart_then_recs", with_views(["carts", "products", "image_emb"], """
SELECT 'cart_item' AS row_type, c.user_id AS cart_id, 0 AS rank, c.item_id,
       row_number() OVER (PARTITION BY c.user_id ORDER BY c.created_at, c.item_id) AS position
FROM carts c WHERE c.user_id IN (SELECT cart_id FROM retr)
UNION ALL
SELECT 'recommendation', cart_id, CAST(rank AS INTEGER), item_id,
       rank + (SELECT count(*) FROM carts c WHERE c.user_id = retr.cart_id) FROM retr""",
                                    RETR_CTES))
def q_cart_then_recs(spark, d):
    carts = _carts(spark, d)
    prods = ranker_products(spark, d)
    recs = K.cart_retrieval(carts, prods, X.image_emb(spark, d), 6)
    meta = prods.select("item_id", "product_name", "category", "brand", "price")
    recs = recs.join(meta, "item_id", "left").withColumn("ranking_score", F.col("similarity_score"))
    out = K.cart_then_recs(recs, carts, prods)
    return out.select("row_type", "cart_id", "rank", "item_id", F.col("position").cast("bigint").alias("position"))


@register("personal_plus_global", with_views(["ev", "products"], """
SELECT user_id, item_id, rank FROM (
  SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY src, o) AS rank
  FROM (SELECT * FROM (SELECT user_id, item_id, src, o,
                              row_number() OVER (PARTITION BY user_id, item_id ORDER BY src, o) AS k
                       FROM allr) WHERE k = 1))
WHERE rank <= 4""", UI_SQL + "," + NN_CTES + f""",
cfr AS ({CF_BODY}),
gtop AS (SELECT item_id, row_number() OVER (ORDER BY interactions DESC, item_id) AS rank FROM (
         SELECT c.item_id, c.interactions FROM (SELECT item_id, count(*) AS interactions FROM ev
         WHERE event_type IN ('click', 'view') GROUP BY item_id) c JOIN products p ON p.item_id = c.item_id
         ORDER BY interactions DESC, item_id LIMIT 10)),
allr AS (SELECT user_id, item_id, 0 AS src, rank AS o FROM cfr WHERE rank <= 2
                AND item_id IN (SELECT item_id FROM products)
         UNION ALL
         SELECT u.user_id, g.item_id, 1, g.rank FROM (SELECT DISTINCT user_id FROM cfr) u, gtop g WHERE g.rank <= 4)"""))
def q_personal_plus_global(spark, d):
    ev, prods = X.events(spark, d), X.products(spark, d)
    personal = cf.user_cf(cf.user_item_matrix(cf.score_events(ev)))
    # the global list is the 10-row top_popular result, so its one-partition rank is bounded
    glob = A.top_popular(ev, prods, 10).select(
        "item_id", F.row_number().over(Window.orderBy(F.desc("interactions"), "item_id")).alias("rank"))
    return K.personal_plus_global(personal, glob, prods).withColumn("rank", F.col("rank").cast("bigint"))


@register("prepare_events", with_views(["rev", "carts"], """
SELECT user_id, count(*) AS n_events, CAST(count_if(synthetic) AS BIGINT) AS n_synthetic,
       strftime(min(CASE WHEN synthetic THEN ts END), '%Y-%m-%d %H:%M:%S') AS first_synthetic
FROM (SELECT user_id, ts, false AS synthetic FROM rev
      UNION ALL
      SELECT user_id, (SELECT max(ts) FROM rev) - to_minutes(CAST(n - i AS BIGINT)), true FROM (
        SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, item_id) - 1 AS i,
               count(*) OVER (PARTITION BY user_id) AS n FROM carts))
GROUP BY user_id"""))
def q_prepare_events(spark, d):
    """The ranker's event log with each open cart appended as events."""
    e = K.prepare_events(X.rank_events(spark, d), _carts(spark, d))
    return e.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if("synthetic").alias("n_synthetic"),
        F.date_format(F.min(F.when(F.col("synthetic"), F.col("ts"))), "yyyy-MM-dd HH:mm:ss").alias("first_synthetic"))


@register("batch_lookup", with_views(["carts", "products"], """
SELECT p.item_id, p.product_name, p.price FROM products p WHERE p.item_id IN (SELECT DISTINCT item_id FROM carts)"""))
def q_batch_lookup(spark, d):
    """Details for a list of ids in one join (the id list is a DataFrame, never a driver list)."""
    ids = X.carts(spark, d).select("item_id").distinct()
    return X.products(spark, d).join(ids, "item_id", "left_semi").select("item_id", "product_name", "price")


def q_checkout_recs(spark, d):
    """J18 with the deterministic linear scorer."""
    r = K.checkout_recs(_carts(spark, d), cut_lineage(ranker_products(spark, d)), X.image_emb(spark, d),
                        X.rank_events(spark, d), top_k=6)
    return r.select("cart_id", "item_id", F.col("rank").cast("bigint").alias("rank"),
                    r6("similarity_score").alias("similarity_score"), r6("model_score").alias("model_score"),
                    r6("ranking_score").alias("ranking_score"))


def _j18_ctes() -> str:
    """Oracle CTEs of checkout_recs (``jtop``): features over the cart-augmented log, linear score,
    trending boost, 0.7/0.3 blend of per-cart min-max scores, diversity, top 6."""
    from shoplens.plans.q_profiles import PROFILE_SQL, STATS_SQL
    from shoplens.plans.q_ranking import FEATURE_CTES
    feat_part = FEATURE_CTES[FEATURE_CTES.index("cat_enc AS ("):FEATURE_CTES.index("lbl AS (")].rstrip().rstrip(",")
    feat_part = (feat_part.replace("FROM rev e JOIN products p", "FROM pev e JOIN products p")
                 .replace("LEFT JOIN cv cc", "LEFT JOIN cv2 cc").replace("LEFT JOIN cv ck", "LEFT JOIN cv2 ck"))
    profile = PROFILE_SQL.replace("FROM rev", "FROM pev").replace("INTERVAL 7 DAY", "INTERVAL 365 DAY")
    retr = RETR_CTES.replace("WHERE rank <= 6)", "WHERE rank <= 30)")
    cart_lines = retr[retr.index("lines AS ("):retr.index("cqv AS (")]
    retr = retr.replace(cart_lines, f"""lines AS (SELECT w.user_id AS cart_id,
                 {weight_sql('w.event_type', INTERACTION_WEIGHTS, INTERACTION_DEFAULT)} AS wt,
                 unnest(e.embedding) AS x, generate_subscripts(e.embedding, 1) AS pos
          FROM pev w JOIN items e ON e.item_id = w.item_id
          WHERE w.ts >= (SELECT max(ts) FROM pev) - INTERVAL 365 DAY AND w.user_id IN (SELECT user_id FROM carts)),
cq0 AS (SELECT cart_id, list(s ORDER BY pos) AS v FROM (SELECT cart_id, pos, sum(wt * x) AS s FROM lines
        GROUP BY 1, 2) GROUP BY cart_id),
""")
    meta = META_CTES.replace("FROM mscored) WHERE rank <= 10)", "FROM mscored) WHERE rank <= 30)")
    # carts without embedding candidates have features without embeddings
    feat_part = feat_part.replace("CASE WHEN iv.embedding IS NOT NULL AND",
                                  "CASE WHEN c.user_id IN (SELECT cart_id FROM retr) AND iv.embedding IS NOT NULL AND")
    return f"""
pev AS (SELECT user_id, item_id, event_type, ts FROM rev
        UNION ALL
        SELECT user_id, item_id, 'add_to_cart', (SELECT max(ts) FROM rev) - to_minutes(CAST(n - i AS BIGINT)) FROM (
          SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY created_at, item_id) - 1 AS i,
                 count(*) OVER (PARTITION BY user_id) AS n FROM carts)),
{STATS_SQL.strip()},
{profile.strip()},
{retr.strip()},
{meta.strip()},
cands AS (SELECT cart_id AS user_id, item_id, similarity_score FROM retr
          UNION ALL
          SELECT cart_id, item_id, similarity_score FROM meta WHERE cart_id NOT IN (SELECT cart_id FROM retr)),
cterms2 AS (SELECT w.user_id, CASE WHEN w.event_type = 'click' THEN 'click' ELSE 'cart' END AS kind,
                   unnest(e.embedding) AS x, generate_subscripts(e.embedding, 1) AS pos
            FROM pev w JOIN image_emb e ON e.item_id = w.item_id
            WHERE w.event_type IN ('click', 'add_to_cart', 'purchase')
              AND w.ts >= (SELECT max(ts) FROM pev) - INTERVAL 365 DAY),
cm2 AS (SELECT user_id, kind, list(m ORDER BY pos) AS v FROM
        (SELECT user_id, kind, pos, avg(x) AS m FROM cterms2 GROUP BY 1, 2, 3) GROUP BY 1, 2),
cv2 AS (SELECT user_id, kind, CASE WHEN sqrt(list_dot_product(v, v)) > 0
               THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) ELSE v END AS v FROM cm2),
{feat_part},
s0 AS (SELECT user_id, item_id,
              retrieval_similarity + 0.10 * item_popularity_score + 0.05 * item_ctr_score AS raw_score FROM feats),
thr AS (SELECT quantile_cont(popularity_score, 0.8) AS t FROM pstats),
s1 AS (SELECT s.user_id, s.item_id, c.similarity_score,
              CASE WHEN ps.popularity_score IS NOT NULL AND ps.popularity_score >= (SELECT t FROM thr)
                   THEN s.raw_score * 1.1 ELSE s.raw_score END AS model_score
       FROM s0 s LEFT JOIN pstats ps ON ps.item_id = s.item_id
       JOIN cands c ON c.user_id = s.user_id AND c.item_id = s.item_id),
s2 AS (SELECT *,
         CASE WHEN max(similarity_score) OVER w > min(similarity_score) OVER w
              THEN (similarity_score - min(similarity_score) OVER w)
                   / (max(similarity_score) OVER w - min(similarity_score) OVER w) ELSE 1.0 END AS sn,
         CASE WHEN max(model_score) OVER w > min(model_score) OVER w
              THEN (model_score - min(model_score) OVER w) / (max(model_score) OVER w - min(model_score) OVER w)
              ELSE 1.0 END AS mn
       FROM s1 WINDOW w AS (PARTITION BY user_id)),
s3 AS (SELECT s2.*, 0.7 * sn + 0.3 * mn AS ranking_score, coalesce(p.category, 'unknown') AS dcat
       FROM s2 LEFT JOIN products p ON p.item_id = s2.item_id),
jdiv AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, dcat
                        ORDER BY ranking_score DESC, item_id) AS crank FROM s3) WHERE crank <= 3),
jtop AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ranking_score DESC, item_id)
                        AS rank FROM jdiv) WHERE rank <= 6)"""


register("checkout_recs", with_views(["rev", "carts", "products", "image_emb"], """
SELECT user_id AS cart_id, item_id, rank, round(similarity_score, 6) AS similarity_score,
       round(model_score, 6) AS model_score, round(ranking_score, 6) AS ranking_score FROM jtop""", _j18_ctes()))(q_checkout_recs)


# Sessions (user and day) as carts, so that many are small. The ranker serves sessions with a purchase,
# vectors exist for men's items and similarity rows for women's items only: every strategy has carts to serve.
SESSION = "concat(CAST(user_id AS VARCHAR), '|', strftime(ts, '%Y-%m-%d')) AS user_id"


def _chain_sql() -> str:
    retr = RETR_CTES.replace("WHERE item_id IN (SELECT item_id FROM products)",
                             "WHERE item_id IN (SELECT item_id FROM products WHERE gender = 'men')")
    for name in ("items", "lines", "cq0", "cqv", "rtop", "retr"):
        retr = re.sub(rf"\b{name}\b", f"{name}_j19", retr)
    sims = SIM_CTES.replace("JOIN simt s ON s.query_id = cq.item_id",
                            "JOIN simt s ON s.query_id = cq.item_id JOIN products w ON w.item_id = s.query_id AND w.gender = 'women'")
    ctes = _j18_ctes() + "," + retr + "," + sims + """,
ranked AS (SELECT * FROM jtop WHERE user_id IN (SELECT user_id FROM rev WHERE event_type = 'purchase')),
near AS (SELECT * FROM retr_j19 WHERE cart_id NOT IN (SELECT user_id FROM ranked)),
alike AS (SELECT * FROM csim_r WHERE rank <= 6 AND cart_id NOT IN (SELECT user_id FROM ranked)
          AND cart_id NOT IN (SELECT cart_id FROM near)),
rules AS (SELECT * FROM meta WHERE rank <= 6 AND cart_id NOT IN (SELECT user_id FROM ranked)
          AND cart_id NOT IN (SELECT cart_id FROM near) AND cart_id NOT IN (SELECT cart_id FROM alike)),
chain AS (SELECT user_id AS cart_id, item_id, rank, similarity_score, ranking_score, model_score, 'ranker' AS strategy FROM ranked
          UNION ALL SELECT cart_id, item_id, rank, similarity_score, similarity_score, similarity_score, 'cart_retrieval' FROM near
          UNION ALL SELECT cart_id, item_id, rank, similarity_score, ranking_score, ranking_score, 'cart_similarity' FROM alike
          UNION ALL SELECT cart_id, item_id, rank, similarity_score, similarity_score, similarity_score, 'metadata' FROM rules)"""
    sql = with_views(["rev", "carts", "products", "image_emb", "text_emb"], """
SELECT cart_id, item_id, rank, strategy, round(similarity_score, 6) AS similarity_score,
       round(ranking_score, 6) AS ranking_score, round(model_score, 6) AS model_score FROM chain""", ctes)
    return sql.replace("CAST(user_id AS VARCHAR) AS user_id", SESSION)


@register("checkout_fallback_chain", _chain_sql())
def q_checkout_chain(spark, d):
    session = F.concat(F.col("user_id"), F.lit("|"), F.date_format("ts", "yyyy-MM-dd"))
    ev = X.events(spark, d).withColumn("user_id", session)
    rev = ev.where(F.col("event_type") != "time_spent")
    carts = ev.where(F.col("event_type") == "add_to_cart").groupBy(F.col("user_id").alias("cart_id"), "item_id").agg(
        F.count(F.lit(1)).alias("quantity"), F.min("ts").alias("added_at"))
    prods = X.products(spark, d)
    rprods = cut_lineage(P.prepare_products(prods, rev))
    buyers = rev.where(F.col("event_type") == "purchase").select(F.col("user_id").alias("cart_id")).distinct()
    mens = X.image_emb(spark, d).join(prods.where(F.col("gender") == "men").select("item_id"), "item_id", "left_semi")
    womens = _sim_table(spark, d).join(
        prods.where(F.col("gender") == "women").select(F.col("item_id").alias("query_id")), "query_id", "left_semi")
    chain = K.checkout_fallback_chain(carts, [
        ("ranker", lambda c: K.checkout_recs(c.join(buyers, "cart_id", "left_semi"), rprods, X.image_emb(spark, d), rev, top_k=6)),
        ("cart_retrieval", lambda c: K.cart_retrieval(c, rprods, mens, 6, popular=False)),
        ("cart_similarity", lambda c: K.cart_similarity_scores(c, womens, 6)),
        ("metadata", lambda c: K.metadata_candidates(prods, c, 6)),
    ])
    return chain.select("cart_id", "item_id", F.col("rank").cast("bigint").alias("rank"), "strategy",
                        *[r6(c).alias(c) for c in K.SCORES])
