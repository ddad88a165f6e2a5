"""Properties of the batch pipelines on the real test tables."""

from pyspark.sql import functions as F

from shoplens.operators import candidates as C
from shoplens.operators import ranking as R
from shoplens.plans.q_vectors import ranker_products
from shoplens.sources import fixtures as X

from .conftest import SF_SMALL


def test_candidates_exclude_purchases_and_ranks_are_contiguous(spark):
    ev = X.rank_events(spark, SF_SMALL)
    c = C.candidates(ev, ranker_products(spark, SF_SMALL), X.image_emb(spark, SF_SMALL), top_n=5, recency_days=7)
    from shoplens.operators.analytics import recent_events
    bought = C.purchased_pairs(recent_events(ev, 7))
    assert c.join(bought, ["user_id", "item_id"]).count() == 0
    bad = (c.groupBy("user_id").agg(F.max("rank").alias("mx"), F.count("*").alias("n"))
           .where(F.col("mx") != F.col("n")).count())
    assert bad == 0
    assert c.groupBy("user_id").count().where("count > 5").count() == 0


def test_temporal_split_is_disjoint_and_complete(spark):
    ev = X.rank_events(spark, SF_SMALL)
    rows = ev.select("user_id", "item_id").distinct()
    tr, va = R.temporal_user_split(rows, ev, 0.2)
    assert tr.select("user_id").intersect(va.select("user_id")).count() == 0
    assert tr.count() + va.count() == rows.count()


def test_query_vectors_are_unit_norm(spark):
    from shoplens.functions import vectors as V
    from shoplens.operators.vectors import query_vectors
    q = query_vectors(X.rank_events(spark, SF_SMALL), X.image_emb(spark, SF_SMALL))
    norms = [r.n for r in q.select(V.l2_norm("vector").alias("n")).collect()]
    assert norms and all(abs(n - 1.0) < 1e-9 for n in norms)


def test_negative_samples_never_touch_history(spark):
    from shoplens.operators.features import negative_sampling
    ev = X.rank_events(spark, SF_SMALL)
    neg = negative_sampling(ev, X.products(spark, SF_SMALL), 40)
    assert neg.join(ev.select("user_id", "item_id"), ["user_id", "item_id"]).count() == 0
    sizes = ev.select("user_id", "item_id").distinct().groupBy("user_id").count()
    per_user = neg.groupBy("user_id").agg(F.count("*").alias("k")).join(sizes, "user_id")
    assert per_user.where(F.col("k") + F.col("count") != 40).count() == 0


def test_ann_with_all_cells_probed_is_exact(spark):
    from shoplens.operators.vectors import vector_topn, vector_topn_ann
    q = X.text_emb(spark, SF_SMALL).select(F.col("item_id").alias("user_id"), F.col("embedding").alias("vector"))
    items = X.image_emb(spark, SF_SMALL)
    exact = vector_topn(q, items, 5).select("user_id", "item_id", "rank")
    approx = vector_topn_ann(q, items, 5, n_cells=6, n_probe=6).select("user_id", "item_id", "rank")
    assert exact.exceptAll(approx).count() == 0 and approx.exceptAll(exact).count() == 0
