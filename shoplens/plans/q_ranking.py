"""Registered ranking-pipeline queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from shoplens.functions.weights import LABEL_WEIGHTS, weight_sql
from shoplens.operators import candidates as C
from shoplens.operators import features as FE
from shoplens.operators import ranking as R
from shoplens.plans.base import r6, register
from shoplens.plans.q_profiles import PROFILE_SQL, STATS_SQL
from shoplens.plans.q_vectors import CAND_SQL, ranker_products
from shoplens.session import cut_lineage, ensure_checkpoint_dir
from shoplens.sources import fixtures as X
from shoplens.sources.fixtures import with_views

VIEWS = ["rev", "products", "image_emb"]


def _cos(a, b):
    return (f"(CASE WHEN list_dot_product({a}, {a}) = 0 OR list_dot_product({b}, {b}) = 0 THEN 0.0 "
            f"ELSE list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) END)")


def _enc(table, col):
    return f"coalesce((SELECT code FROM {table} WHERE value = {col}), -1)"


FEATURE_CTES = CAND_SQL + "," + STATS_SQL + "," + PROFILE_SQL + """,
cterms AS (SELECT w.user_id, CASE WHEN w.event_type = 'click' THEN 'click' ELSE 'cart' END AS kind,
                  unnest(e.embedding) AS x, generate_subscripts(e.embedding, 1) AS pos
           FROM win w JOIN image_emb e ON e.item_id = w.item_id
           WHERE w.event_type IN ('click', 'add_to_cart', 'purchase')),
cm AS (SELECT user_id, kind, list(m ORDER BY pos) AS v FROM
       (SELECT user_id, kind, pos, avg(x) AS m FROM cterms GROUP BY 1, 2, 3) GROUP BY 1, 2),
cv AS (SELECT user_id, kind, CASE WHEN sqrt(list_dot_product(v, v)) > 0
              THEN list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) ELSE v END AS v FROM cm),
cands AS (SELECT user_id, item_id, similarity_score
          FROM (SELECT * FROM warm_r UNION ALL SELECT * FROM cold) WHERE rank <= 100),
cat_enc AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code
            FROM (SELECT DISTINCT coalesce(category, 'unknown') AS value FROM products UNION SELECT 'unknown')),
brand_enc AS (SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS INTEGER) AS code
              FROM (SELECT DISTINCT coalesce(brand, 'unknown') AS value FROM products UNION SELECT 'unknown')),
prank AS (SELECT item_id, coalesce((rank() OVER (ORDER BY popularity_score)
          + (count(*) OVER (PARTITION BY popularity_score) - 1) / 2.0)
          / count(popularity_score) OVER (), 0.0) AS popularity_rank FROM pstats),
ub AS (SELECT DISTINCT e.user_id, p.brand FROM rev e JOIN products p ON p.item_id = e.item_id
       WHERE p.brand IS NOT NULL),
f0 AS (
  SELECT c.user_id, c.item_id, c.similarity_score,
    CASE WHEN pr.user_id IS NOT NULL THEN coalesce(pr.preferred_category, 'None') ELSE 'unknown' END AS pref_cat,
    CASE WHEN pr.user_id IS NOT NULL THEN coalesce(pr.preferred_brand, 'None') ELSE 'unknown' END AS pref_brand,
    CASE WHEN pr.user_id IS NOT NULL THEN pr.avg_spend ELSE (SELECT avg(price) FROM products) END AS user_avg_spend,
    CAST(CASE WHEN pr.user_id IS NOT NULL THEN pr.recent_activity_count ELSE 0 END AS BIGINT)
      AS user_recent_activity_count,
    CAST(CASE WHEN pr.user_id IS NOT NULL THEN pr.days_since_last_interaction ELSE 999 END AS BIGINT)
      AS user_days_since_last_interaction,
    CASE WHEN p.item_id IS NOT NULL THEN coalesce(p.category, 'nan') ELSE 'unknown' END AS item_cat,
    CASE WHEN p.item_id IS NOT NULL THEN coalesce(p.brand, 'nan') ELSE 'unknown' END AS item_brand,
    CASE WHEN p.item_id IS NOT NULL THEN coalesce(p.price, 0.0) ELSE 0.0 END AS item_price,
    coalesce(ps.popularity_score, 0.0) AS item_popularity_score, coalesce(ps.ctr_score, 0.0) AS item_ctr_score,
    coalesce(rk.popularity_rank, 0.0) AS item_popularity_rank,
    CASE WHEN iv.embedding IS NOT NULL AND cc.v IS NOT NULL THEN """ + _cos("iv.embedding", "cc.v") + """
         ELSE 0.0 END AS sim_to_cart,
    CASE WHEN iv.embedding IS NOT NULL AND ck.v IS NOT NULL THEN """ + _cos("iv.embedding", "ck.v") + """
         ELSE 0.0 END AS sim_to_click
  FROM cands c LEFT JOIN prof pr ON pr.user_id = c.user_id LEFT JOIN products p ON p.item_id = c.item_id
  LEFT JOIN pstats ps ON ps.item_id = c.item_id LEFT JOIN prank rk ON rk.item_id = c.item_id
  LEFT JOIN image_emb iv ON iv.item_id = c.item_id
  LEFT JOIN cv cc ON cc.user_id = c.user_id AND cc.kind = 'cart'
  LEFT JOIN cv ck ON ck.user_id = c.user_id AND ck.kind = 'click'),
feats AS (
  SELECT user_id, item_id,
    """ + _enc("cat_enc", "pref_cat") + """ AS user_preferred_category_enc,
    """ + _enc("brand_enc", "pref_brand") + """ AS user_preferred_brand_enc,
    user_avg_spend, user_recent_activity_count, user_days_since_last_interaction,
    """ + _enc("cat_enc", "item_cat") + """ AS item_category_enc,
    """ + _enc("brand_enc", "item_brand") + """ AS item_brand_enc,
    item_price, item_popularity_score, item_ctr_score, item_popularity_rank, sim_to_cart, sim_to_click,
    CAST(similarity_score AS DOUBLE) AS retrieval_similarity,
    CAST(item_cat = pref_cat AS INTEGER) AS same_category_as_pref,
    CAST(item_brand = pref_brand AS INTEGER) AS same_brand_as_pref,
    abs(item_price - user_avg_spend) AS price_diff_from_avg_spend,
    CASE WHEN user_avg_spend > 0 THEN item_price / user_avg_spend ELSE 1.0 END AS price_ratio_to_avg,
    CAST(EXISTS (SELECT 1 FROM ub WHERE ub.user_id = f0.user_id AND ub.brand = f0.item_brand) AS INTEGER)
      AS user_interacted_brand
  FROM f0),
lbl AS (SELECT user_id, item_id, CAST(max(""" + weight_sql("event_type", LABEL_WEIGHTS, 0) + """) AS INTEGER)
        AS label FROM rev GROUP BY user_id, item_id),
tset AS (SELECT f.*, coalesce(l.label, 0) AS label FROM feats f
         LEFT JOIN lbl l ON l.user_id = f.user_id AND l.item_id = f.item_id)"""

DOUBLE_FEATURES = ["user_avg_spend", "item_price", "item_popularity_score", "item_ctr_score",
                   "item_popularity_rank", "sim_to_cart", "sim_to_click", "retrieval_similarity",
                   "price_diff_from_avg_spend", "price_ratio_to_avg"]


def _feature_select_sql(extra=""):
    cols = []
    for c in FE.FEATURE_COLUMNS:
        cols.append(f"round({c}, 6) AS {c}" if c in DOUBLE_FEATURES else c)
    return "SELECT user_id, item_id, " + ", ".join(cols) + extra


def _round_features(df, extra=()):
    cols = [r6(c).alias(c) if c in DOUBLE_FEATURES else F.col(c) for c in FE.FEATURE_COLUMNS]
    return df.select("user_id", "item_id", *cols, *extra)


def _inputs(spark, d):
    """Events, prepared products and vectors; products are derived from the log once and written."""
    return X.rank_events(spark, d), cut_lineage(ranker_products(spark, d)), X.image_emb(spark, d)


def _cands(ev, prods, emb):
    return cut_lineage(C.candidates(ev, prods, emb, top_n=100, recency_days=7))


def _features(spark, d):
    ev, prods, emb = _inputs(spark, d)
    return FE.build_features(_cands(ev, prods, emb), ev, prods, emb, recency_days=7)


def _training(spark, d):
    ev, prods, emb = _inputs(spark, d)
    return FE.training_set(_cands(ev, prods, emb), ev, prods, emb, recency_days=7)


@register("features", with_views(VIEWS, _feature_select_sql(" FROM feats"), FEATURE_CTES))
def q_features(spark, d):
    return _round_features(_features(spark, d))


@register("training_set", with_views(VIEWS, _feature_select_sql(", label FROM tset"), FEATURE_CTES))
def q_training_set(spark, d):
    return _round_features(_training(spark, d), [F.col("label")])


SPLIT_CTE = """
lastev AS (SELECT user_id, max(ts) AS last_ts FROM rev GROUP BY user_id),
cut AS (SELECT quantile_cont(epoch_us(last_ts), 0.8) AS c FROM lastev)"""


@register("temporal_user_split", with_views(VIEWS, """
SELECT t.user_id, t.item_id, epoch_us(l.last_ts) >= (SELECT c FROM cut) AS is_val
FROM tset t JOIN lastev l ON l.user_id = t.user_id""", FEATURE_CTES + "," + SPLIT_CTE))
def q_temporal_user_split(spark, d):
    tr, va = R.temporal_user_split(_training(spark, d), X.rank_events(spark, d), 0.2)
    return (tr.select("user_id", "item_id", F.lit(False).alias("is_val"))
            .unionByName(va.select("user_id", "item_id", F.lit(True).alias("is_val"))))


@register("temporal_event_split", with_views(["rev"], """
SELECT event_id, epoch_us(ts) >= (SELECT quantile_cont(epoch_us(ts), 0.8) FROM rev) AS is_val FROM rev"""))
def q_temporal_event_split(spark, d):
    tr, va = R.temporal_event_split(X.rank_events(spark, d), 0.2)
    return (tr.select("event_id", F.lit(False).alias("is_val"))
            .unionByName(va.select("event_id", F.lit(True).alias("is_val"))))


RECO_CTES = FEATURE_CTES + """,
scored0 AS (SELECT f.user_id, f.item_id, f.retrieval_similarity + 0.10 * f.item_popularity_score
                   + 0.05 * f.item_ctr_score AS raw_score, c.similarity_score AS sim
            FROM feats f LEFT JOIN cands c ON c.user_id = f.user_id AND c.item_id = f.item_id),
thr AS (SELECT quantile_cont(popularity_score, 0.8) AS t FROM pstats),
boosted AS (SELECT s.*, CASE WHEN ps.popularity_score IS NOT NULL AND ps.popularity_score >= (SELECT t FROM thr)
                        THEN raw_score * 1.1 ELSE raw_score END AS ranking_score,
                   coalesce(p.category, 'unknown') AS dcat
            FROM scored0 s LEFT JOIN pstats ps ON ps.item_id = s.item_id
            LEFT JOIN products p ON p.item_id = s.item_id),
div AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, dcat
                       ORDER BY ranking_score DESC, item_id) AS crank FROM boosted) WHERE crank <= 3),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ranking_score DESC, item_id)
                       AS rank FROM div) WHERE rank <= 10)"""


@register("recommend", with_views(VIEWS, """
SELECT t.user_id, t.rank, t.item_id, coalesce(p.product_name, t.item_id) AS product_name,
       coalesce(p.category, 'N/A') AS category, coalesce(p.brand, 'N/A') AS brand,
       coalesce(p.price, 0.0) AS price, round(coalesce(t.sim, 0.0), 4) AS similarity_score,
       round(t.ranking_score, 4) AS ranking_score
FROM top t LEFT JOIN products p ON p.item_id = t.item_id""", RECO_CTES))
def q_recommend(spark, d):
    ev, prods, emb = _inputs(spark, d)
    cands = _cands(ev, prods, emb)
    out = R.recommend(FE.build_features(cands, ev, prods, emb, recency_days=7), cands, prods, top_k=10)
    return out.withColumn("rank", F.col("rank").cast("bigint"))


OWN_SCORE = "f.retrieval_similarity - 0.001 * f.item_price + 0.2 * f.user_interacted_brand"


@register("recommend_own_scorer", with_views(VIEWS, """
SELECT t.user_id, t.rank, t.item_id, round(t.ranking_score, 4) AS ranking_score FROM top t""",
                                             RECO_CTES.replace("""f.retrieval_similarity + 0.10 * f.item_popularity_score
                   + 0.05 * f.item_ctr_score AS raw_score""", OWN_SCORE + " AS raw_score")))
def q_recommend_own_scorer(spark, d):
    """L1 / L2: a feature added by a caller's builder and a caller's scorer that uses it."""
    ev, prods, emb = _inputs(spark, d)
    cands = _cands(ev, prods, emb)
    feats = FE.build_features(cands, ev, prods, emb, recency_days=7, extra=lambda df: df.withColumn(
        "brand_bonus", F.lit(0.2) * F.col("user_interacted_brand")))
    out = R.recommend(feats, cands, prods, top_k=10, scorer=lambda df: df.withColumn(
        "raw_score", F.col("retrieval_similarity") - F.lit(0.001) * F.col("item_price") + F.col("brand_bonus")))
    return out.select("user_id", F.col("rank").cast("bigint").alias("rank"), "item_id", "ranking_score")


@register("diversity_rerank", with_views(VIEWS, """
SELECT user_id, item_id, rank, dcat AS category FROM top""", RECO_CTES))
def q_diversity(spark, d):
    feats = _features(spark, d).withColumn("raw_score", R.linear_score())
    prods = ranker_products(spark, d)
    b = R.trending_boost(feats, prods)
    top = R.diversity_rerank(b, prods, 10, "ranking_score")
    cats = prods.select("item_id", "category")
    return (top.join(cats, "item_id", "left").select(
        "user_id", "item_id", F.col("rank").cast("bigint").alias("rank"),
        F.coalesce(F.col("category"), F.lit("unknown")).alias("category")))


@register("trending_boost", with_views(VIEWS, """
SELECT user_id, item_id, round(ranking_score, 6) AS ranking_score FROM boosted""", RECO_CTES))
def q_trending(spark, d):
    feats = _features(spark, d).withColumn("raw_score", R.linear_score())
    b = R.trending_boost(feats, ranker_products(spark, d))
    return b.select("user_id", "item_id", r6("ranking_score").alias("ranking_score"))


@register("minmax_norm", with_views(VIEWS, """
SELECT user_id, item_id, round(CASE WHEN max(raw_score) OVER w > min(raw_score) OVER w
       THEN (raw_score - min(raw_score) OVER w) / (max(raw_score) OVER w - min(raw_score) OVER w) ELSE 1.0 END, 6)
       AS score_norm
FROM scored0 WINDOW w AS (PARTITION BY user_id)""", RECO_CTES))
def q_minmax(spark, d):
    s = _features(spark, d).withColumn("raw_score", R.linear_score())
    return R.minmax_norm(s, "raw_score", "score_norm").select("user_id", "item_id",
                                                             r6("score_norm").alias("score_norm"))


@register("ranking_metrics", with_views(VIEWS, """
WITH_M AS (SELECT 1)
SELECT round(avg(p), 4) AS precision_at_10, round(avg(r), 4) AS recall_at_10, round(avg(ap), 4) AS map_at_10,
       round(avg(ndcg), 4) AS ndcg_at_10, round(avg(hit), 4) AS hit_rate_at_10
FROM (SELECT user_id, coalesce(sum(CASE WHEN rk <= 10 THEN rel END), 0) / 10 AS p,
             CASE WHEN sum(rel) > 0 THEN sum(CASE WHEN rk <= 10 THEN rel END) / sum(rel) ELSE 0.0 END AS r,
             CASE WHEN sum(rel) > 0 THEN coalesce(sum(CASE WHEN rk <= 10 AND rel = 1 THEN hits / rk END), 0.0)
                  / least(sum(rel), 10) ELSE 0.0 END AS ap,
             CASE WHEN sum(CASE WHEN irk <= 10 THEN (pow(2.0, label) - 1) / log2(irk + 1) END) > 0
                  THEN sum(CASE WHEN rk <= 10 THEN (pow(2.0, label) - 1) / log2(rk + 1) END)
                       / sum(CASE WHEN irk <= 10 THEN (pow(2.0, label) - 1) / log2(irk + 1) END) ELSE 0.0 END AS ndcg,
             CASE WHEN coalesce(sum(CASE WHEN rk <= 10 THEN rel END), 0) > 0 THEN 1.0 ELSE 0.0 END AS hit
      FROM (SELECT *, sum(rel) OVER (PARTITION BY user_id ORDER BY score DESC, item_id
                                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hits
            FROM (SELECT user_id, item_id, label, CAST(label > 0 AS INTEGER) AS rel,
                         retrieval_similarity + 0.10 * item_popularity_score + 0.05 * item_ctr_score AS score,
                         row_number() OVER (PARTITION BY user_id ORDER BY retrieval_similarity
                           + 0.10 * item_popularity_score + 0.05 * item_ctr_score DESC, item_id) AS rk,
                         row_number() OVER (PARTITION BY user_id ORDER BY label DESC, item_id) AS irk
                  FROM tset))
      GROUP BY user_id)""".replace("WITH_M AS (SELECT 1)\n", ""), FEATURE_CTES))
def q_ranking_metrics(spark, d):
    t = _training(spark, d).withColumn("score", R.linear_score())
    return R.ranking_metrics(t, k=10)


@register("group_sizes", with_views(VIEWS, """
SELECT user_id, count(*) AS group_size, row_number() OVER (ORDER BY user_id) AS qid FROM tset GROUP BY user_id""",
                                    FEATURE_CTES))
def q_group_sizes(spark, d):
    return R.group_sizes(_training(spark, d)).select("user_id", "group_size", "qid")


@register("negative_sampling", with_views(["rev", "products"], """
SELECT user_id, item_id, sample_rank FROM (
  SELECT w.user_id, r.item_id, w.step, w.need,
         row_number() OVER (PARTITION BY w.user_id ORDER BY w.step) AS sample_rank
  FROM (SELECT s.user_id, s.need, st.step,
               (('0x' || substr(md5(s.user_id || ':42'), 1, 8))::BIGINT + st.step) % (SELECT count(*) FROM ring)
                 AS pos
        FROM (SELECT user_id, 80 - count(*) AS need, count(*) AS h FROM hist GROUP BY user_id
              HAVING 80 - count(*) > 0) s,
             LATERAL (SELECT unnest(range(0, least(s.need + s.h, (SELECT count(*) FROM ring)))) AS step) st) w
  JOIN ring r ON r.pos = w.pos
  WHERE NOT EXISTS (SELECT 1 FROM hist x WHERE x.user_id = w.user_id AND x.item_id = r.item_id))
WHERE sample_rank <= need""", """
hist AS (SELECT DISTINCT user_id, item_id FROM rev),
ring AS (SELECT item_id, row_number() OVER (ORDER BY ('0x' || substr(md5(item_id || ':42'), 1, 8))::BIGINT,
                item_id) - 1 AS pos FROM (SELECT DISTINCT item_id FROM products))"""))
def q_negative_sampling(spark, d):
    return FE.negative_sampling(X.rank_events(spark, d), X.products(spark, d), 80, seed=42).withColumn(
        "sample_rank", F.col("sample_rank").cast("bigint"))


@register("train_ranker")
def q_train_ranker(spark, d):
    """Fit GBT (+RF) on the training rows, score the validation users
    and report feature importances (rows-only check: model output)."""
    tr, va = R.temporal_user_split(_training(spark, d), X.rank_events(spark, d), 0.2)
    models = R.train_rankers(tr, va, max_iter=10, max_depth=4)
    return R.feature_importance(models["gbt"])


@register("ranker_validation")
def q_ranker_validation(spark, d):
    """Rankers fitted on the early users, saved, loaded again, and measured on the late users
    beside the linear score (rows-only check: models)."""
    tr, va = R.temporal_user_split(_training(spark, d), X.rank_events(spark, d), 0.2)
    folder = f"{ensure_checkpoint_dir(spark)}/rankers-{uuid.uuid4().hex[:12]}"
    R.save_rankers(R.train_rankers(tr, va, max_iter=10, max_depth=4), folder)
    return R.validate_rankers(R.load_rankers(folder), va, k=10)


@register("history_plus_negatives", with_views(["rev", "products"], """
SELECT user_id, item_id FROM hist
UNION ALL
SELECT user_id, item_id FROM (
  SELECT w.user_id, r.item_id, w.need,
         row_number() OVER (PARTITION BY w.user_id ORDER BY w.step) AS sample_rank
  FROM (SELECT s.user_id, s.need, st.step,
               (('0x' || substr(md5(s.user_id || ':42'), 1, 8))::BIGINT + st.step) % (SELECT count(*) FROM ring)
                 AS pos
        FROM (SELECT user_id, 80 - count(*) AS need, count(*) AS h FROM hist GROUP BY user_id
              HAVING 80 - count(*) > 0) s,
             LATERAL (SELECT unnest(range(0, least(s.need + s.h, (SELECT count(*) FROM ring)))) AS step) st) w
  JOIN ring r ON r.pos = w.pos
  WHERE NOT EXISTS (SELECT 1 FROM hist x WHERE x.user_id = w.user_id AND x.item_id = r.item_id))
WHERE sample_rank <= need""", """
hist AS (SELECT DISTINCT user_id, item_id FROM rev),
ring AS (SELECT item_id, row_number() OVER (ORDER BY ('0x' || substr(md5(item_id || ':42'), 1, 8))::BIGINT,
                item_id) - 1 AS pos FROM (SELECT DISTINCT item_id FROM products))"""))
def q_history_plus_negatives(spark, d):
    """Interacted items plus seeded negatives up to 80 per user."""
    return FE.history_plus_negatives(X.rank_events(spark, d), X.products(spark, d), 80, 42).select(
        "user_id", "item_id")
