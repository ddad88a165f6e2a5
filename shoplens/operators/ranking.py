"""Ranking: splits, scorers, trending boost, diversity, batch recommend, metrics
(J6, J7, J9-J11b, E2, E3, E8, D21-D23)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shoplens.functions.weights import MAX_PER_CATEGORY, TRENDING_BOOST, TRENDING_QUANTILE
from shoplens.operators.features import FEATURE_COLUMNS
from shoplens.operators.profiles import last_event_per_user, quantile
from shoplens.session import cut_lineage


# J6 / J7 --------------------------------------------------------------------
def temporal_user_split(rows: DataFrame, events: DataFrame, val_fraction: float = 0.2
                        ) -> tuple[DataFrame, DataFrame]:
    """Whole users: last event >= quantile(last events, 1 - f) -> validation. Rows are written once, for both parts."""
    last = last_event_per_user(events).withColumn("_us", F.unix_micros("last_ts"))
    cutoff = quantile(last, "_us", 1.0 - val_fraction)
    flagged = last.select("user_id", (F.col("_us") >= cutoff).alias("_val"))
    j = cut_lineage(rows.join(flagged, "user_id"))
    return j.where(~F.col("_val")).drop("_val"), j.where(F.col("_val")).drop("_val")


def temporal_event_split(events: DataFrame, val_fraction: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Events before the (1 - f) time quantile -> train, the rest -> validation."""
    cutoff = quantile(events, F.unix_micros("ts"), 1.0 - val_fraction)
    us = F.unix_micros("ts")
    return events.where(us < cutoff), events.where(us >= cutoff)


# J10b -----------------------------------------------------------------------
def linear_score(sim_col: str = "retrieval_similarity") -> Column:
    """similarity + 0.10 * popularity + 0.05 * ctr (deterministic scorer)."""
    return (F.col(sim_col) + F.lit(0.10) * F.col("item_popularity_score")
            + F.lit(0.05) * F.col("item_ctr_score"))


# J11b -----------------------------------------------------------------------
def trending_boost(scored: DataFrame, products: DataFrame, score_col: str = "raw_score",
                   out_col: str = "ranking_score", q: float = TRENDING_QUANTILE,
                   boost: float = TRENDING_BOOST) -> DataFrame:
    """score x boost for items whose popularity >= the catalog's q-quantile
    (a negative score becomes lower, as in the reference)."""
    threshold = quantile(products, "popularity_score", q)
    pop = products.select("item_id", F.col("popularity_score").alias("_pop"))
    j = scored.join(pop, "item_id", "left")
    hot = F.col("_pop").isNotNull() & (F.col("_pop") >= threshold)
    return j.withColumn(out_col, F.when(hot, F.col(score_col) * boost).otherwise(F.col(score_col))).drop("_pop")


# E2 / E3 --------------------------------------------------------------------
def rank_topk(df: DataFrame, k: int, score: str, key: str = "user_id", name: str = "rank") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc(score), F.asc("item_id"))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def diversity_rerank(ranked: DataFrame, products: DataFrame, top_k: int, score: str,
                     max_per_category: int | None = MAX_PER_CATEGORY, key: str = "user_id") -> DataFrame:
    """Walk each list by score: keep <= max_per_category per category, stop at top_k.

    Equivalent to: rank inside (key, category) <= max, then rank inside key <= k.
    Items missing from the catalog count under category 'unknown'.
    """
    if max_per_category is None:
        return rank_topk(ranked, top_k, score, key)
    cats = products.select("item_id", F.col("category").alias("_div_cat"))
    j = ranked.join(cats, "item_id", "left").withColumn(
        "_div_cat", F.coalesce(F.col("_div_cat"), F.lit("unknown")))
    wc = Window.partitionBy(key, "_div_cat").orderBy(F.desc(score), F.asc("item_id"))
    j = j.withColumn("_cat_rank", F.row_number().over(wc)).where(F.col("_cat_rank") <= max_per_category)
    return rank_topk(j.drop("_cat_rank", "_div_cat"), top_k, score, key)


# E8 -------------------------------------------------------------------------
def minmax_norm(df: DataFrame, col: str, out: str, key: str = "user_id") -> DataFrame:
    """(x - min) / (max - min) inside each key; a constant group -> 1.0."""
    w = Window.partitionBy(key)
    lo, hi = F.min(col).over(w), F.max(col).over(w)
    return df.withColumn(out, F.when(hi > lo, (F.col(col) - lo) / (hi - lo)).otherwise(F.lit(1.0)))


# J11 ------------------------------------------------------------------------
def recommend(features: DataFrame, cands: DataFrame, products: DataFrame, top_k: int = 10,
              scorer: Callable[[DataFrame], DataFrame] | None = None,
              diversity_max_per_category: int | None = MAX_PER_CATEGORY,
              boost: float = TRENDING_BOOST) -> DataFrame:
    """Batch recommend for every user in ``features``.

    scorer: DataFrame -> DataFrame adding ``raw_score`` (default: linear_score).
    Output: user_id, rank, item_id, product_name, category, brand, price,
    similarity_score, ranking_score (both rounded to 4 like the reference).
    """
    scored = scorer(features) if scorer else features.withColumn("raw_score", linear_score())
    sims = cands.select("user_id", "item_id", F.col("similarity_score").alias("_sim"))
    scored = scored.join(sims, ["user_id", "item_id"], "left")
    boosted = trending_boost(scored, products, "raw_score", "ranking_score", boost=boost)
    top = diversity_rerank(boosted, products, top_k, "ranking_score", diversity_max_per_category)
    meta = products.select("item_id", "product_name", "category", "brand", "price").dropDuplicates(["item_id"])
    out = top.join(meta, "item_id", "left")
    return out.select(
        "user_id", "rank", "item_id",
        F.coalesce(F.col("product_name"), F.col("item_id")).alias("product_name"),
        F.coalesce(F.col("category"), F.lit("N/A")).alias("category"),
        F.coalesce(F.col("brand"), F.lit("N/A")).alias("brand"),
        F.coalesce(F.col("price"), F.lit(0.0)).alias("price"),
        F.round(F.coalesce(F.col("_sim"), F.lit(0.0)), 4).alias("similarity_score"),
        F.round(F.col("ranking_score"), 4).alias("ranking_score"))


# D21 ------------------------------------------------------------------------
def ranking_metrics(scored: DataFrame, k: int = 10, score: str = "score", label: str = "label",
                    key: str = "user_id") -> DataFrame:
    """precision/recall/MAP/NDCG/hit-rate @k averaged over users, rounded to 4.

    precision = hits/k; recall = hits/|relevant| (0 without relevant);
    AP = Σ hits_so_far/rank / min(|relevant|, k); NDCG gain 2^rel - 1 over
    log2(rank + 1), ideal from the same user's labels.
    """
    w = Window.partitionBy(key).orderBy(F.desc(score), F.asc("item_id"))
    rel = (F.col(label) > 0).cast("int")
    r = scored.select(key, "item_id", score, label).withColumn("_rank", F.row_number().over(w))
    r = r.withColumn("_hits", F.sum(rel).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    wi = Window.partitionBy(key).orderBy(F.desc(label), F.asc("item_id"))
    r = r.withColumn("_irank", F.row_number().over(wi))
    gain = F.pow(F.lit(2.0), F.col(label).cast("double")) - 1
    topk = F.col("_rank") <= k
    per_user = r.groupBy(key).agg(
        F.sum(F.when(topk, rel)).alias("_hk"),
        F.sum(rel).alias("_nrel"),
        F.sum(F.when(topk & (rel == 1), F.col("_hits") / F.col("_rank"))).alias("_ap"),
        F.sum(F.when(topk, gain / F.log2(F.col("_rank") + 1))).alias("_dcg"),
        F.sum(F.when(F.col("_irank") <= k, gain / F.log2(F.col("_irank") + 1))).alias("_idcg"))
    m = per_user.select(
        (F.coalesce(F.col("_hk"), F.lit(0)) / F.lit(k)).alias("p"),
        F.when(F.col("_nrel") > 0, F.col("_hk") / F.col("_nrel")).otherwise(0.0).alias("r"),
        F.when(F.col("_nrel") > 0, F.coalesce(F.col("_ap"), F.lit(0.0)) / F.least(F.col("_nrel"), F.lit(k)))
        .otherwise(0.0).alias("ap"),
        F.when(F.col("_idcg") > 0, F.col("_dcg") / F.col("_idcg")).otherwise(0.0).alias("ndcg"),
        (F.coalesce(F.col("_hk"), F.lit(0)) > 0).cast("double").alias("hit"))
    return m.agg(*[F.round(F.avg(c), 4).alias(f"{n}_at_{k}") for c, n in
                   [("p", "precision"), ("r", "recall"), ("ap", "map"), ("ndcg", "ndcg"), ("hit", "hit_rate")]])


# D22 ------------------------------------------------------------------------
def retrieval_metrics(query_vecs: DataFrame, targets: DataFrame, item_vecs: DataFrame,
                      ks=(10, 50, 100), key: str = "sample_id") -> DataFrame:
    """Recall@k / NDCG@k of one target per sample against all items.

    rank of target = 1 + #items scoring strictly higher (ties counted in the
    target's favour), a count over the cells that can matter, not a sort.
    """
    from shoplens.operators.cells import rank_of_target
    ranks = rank_of_target(query_vecs, targets, item_vecs, key=key)
    aggs = []
    for k in ks:
        hit = F.col("target_rank") <= k
        aggs.append(F.avg(hit.cast("double")).alias(f"recall_at_{k}"))
        aggs.append(F.avg(F.when(hit, 1.0 / F.log2(F.col("target_rank") + 1)).otherwise(0.0))
                    .alias(f"ndcg_at_{k}"))
    return ranks.agg(*aggs)


# D23 ------------------------------------------------------------------------
def group_sizes(rows: DataFrame, key: str = "user_id") -> DataFrame:
    """Rows per user (LTR groups) with a dense query id in user order."""
    g = rows.groupBy(key).agg(F.count(F.lit(1)).alias("group_size"))
    from shoplens.operators.analytics import global_row_number
    return global_row_number(g, [F.col(key)], "qid")


# J9 / J10 / J10c ------------------------------------------------------------
def assemble(df: DataFrame, cols=None, out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=list(cols or FEATURE_COLUMNS), outputCol=out,
                           handleInvalid="keep").transform(df)


def train_rankers(train: DataFrame, val: DataFrame | None = None, seed: int = 42,
                  max_iter: int = 50, max_depth: int = 5):
    """Pointwise boosted trees (+ a random forest) on the label, early-stopped on
    the validation rows. Returns {name: fitted model}."""
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    def instances(df: DataFrame, is_val: bool) -> DataFrame:
        return assemble(df).select("features", F.col("label").cast("double").alias("label"), F.lit(is_val).alias("_is_val"))

    # both fits pass over their rows many times before they keep them: rows are assembled and written once
    t = cut_lineage(instances(train, False) if val is None else instances(train, False).unionByName(instances(val, True)))
    if val is not None:
        gbt = GBTRegressor(featuresCol="features", labelCol="label", maxIter=max_iter, maxDepth=max_depth,
                           seed=seed, validationIndicatorCol="_is_val", validationTol=0.001)
    else:
        gbt = GBTRegressor(featuresCol="features", labelCol="label", maxIter=max_iter, maxDepth=max_depth,
                           seed=seed)
    train_only = t.where(~F.col("_is_val")) if val is not None else t
    rf = RandomForestRegressor(featuresCol="features", labelCol="label", numTrees=50, maxDepth=max_depth,
                               seed=seed)
    return {"gbt": gbt.fit(t), "rf": rf.fit(train_only)}


def model_scorer(models: dict, boost_products: DataFrame | None = None) -> Callable[[DataFrame], DataFrame]:
    """Scorer hook (L2): mean prediction of the given models as ``raw_score``."""
    def score(df: DataFrame) -> DataFrame:
        x = assemble(df)
        cols = []
        for name, m in models.items():
            x = m.setPredictionCol(f"_pred_{name}").transform(x)
            cols.append(F.col(f"_pred_{name}"))
        mean = sum(cols[1:], cols[0]) / len(cols)
        return x.withColumn("raw_score", mean).drop("features", *[f"_pred_{n}" for n in models])
    return score


def save_rankers(models: dict, folder: str) -> None:
    """Each model in a folder of its name, in a store that Spark writes to."""
    for name, model in models.items():
        model.write().overwrite().save(f"{folder.rstrip('/')}/{name}")


def load_rankers(folder: str, names: tuple[str, ...] = ("gbt", "rf")) -> dict:
    from pyspark.ml.regression import GBTRegressionModel, RandomForestRegressionModel
    kinds = {"gbt": GBTRegressionModel, "rf": RandomForestRegressionModel}
    return {name: kinds[name].load(f"{folder.rstrip('/')}/{name}") for name in names}


def validate_rankers(models: dict, rows: DataFrame, k: int = 10) -> DataFrame:
    """(ranker, precision, recall, map, ndcg, hit rate @k): each model, their mean and the linear score on labelled rows."""
    x = assemble(rows)
    for name, model in models.items():
        x = model.setPredictionCol(f"_pred_{name}").transform(x)
    scores = {name: F.col(f"_pred_{name}") for name in models}
    scores |= {"mean": sum(list(scores.values())[1:], next(iter(scores.values()))) / len(scores), "linear": linear_score()}
    # each model predicts once, and only what the metrics read is kept
    scored = cut_lineage(x.select("user_id", "item_id", "label", *[c.alias(f"score_{name}") for name, c in scores.items()]))
    out = None
    for name in sorted(scores):
        one = ranking_metrics(scored, k, score=f"score_{name}").select(F.lit(name).alias("ranker"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def feature_importance(model, cols=None) -> DataFrame:
    """(feature, importance) sorted desc, from a fitted tree model."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    imp = model.featureImportances.toArray().tolist()
    rows = sorted(zip(list(cols or FEATURE_COLUMNS), imp), key=lambda r: -r[1])
    return spark.createDataFrame(rows, "feature string, importance double")


def tree_rules(model) -> str:
    """Readable IF/THEN form of the trees."""
    return model.toDebugString
