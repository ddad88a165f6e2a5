"""Sources and sinks round-trip through real files (tests use a scratch folder)."""

import json

from pyspark.sql import functions as F

from shoplens.operators import analytics as A
from shoplens.sources import catalog as SC
from shoplens.sources import fixtures as X
from shoplens.sources import sinks as SK

from .conftest import SF_SMALL


def test_scan_catalog_checks_and_defaults(spark, tmp_path):
    p = X.products(spark, SF_SMALL).select("item_id", "product_name", "category", "brand", "price")
    e = X.events(spark, SF_SMALL).select("user_id", "item_id", "event_type", F.col("ts").alias("timestamp"))
    p.write.parquet(str(tmp_path / "p"))
    SK.append_events(e, str(tmp_path / "e"))
    SK.append_events(e, str(tmp_path / "e"))
    prods, evs = SC.scan_catalog(spark, str(tmp_path / "p"), str(tmp_path / "e"))
    assert {"image_url", "description", "in_stock"} <= set(prods.columns)
    assert evs.count() == 2 * e.count()
    try:
        SC.scan_catalog(spark, str(tmp_path / "e"), str(tmp_path / "e"))
        raise AssertionError("missing columns must fail")
    except ValueError as exc:
        assert "products" in str(exc)


def test_json_catalog_and_similarity_pick(spark, tmp_path):
    rows = [{"item_id": "1", "product_name": "red ring", "price": 5.0}, {"item_id": "2", "product_name": "x"}]
    (tmp_path / "c.json").write_text(json.dumps(rows))
    df = SC.scan_json_catalog(spark, str(tmp_path / "c.json"))
    assert df.count() == 2 and "price" in df.columns
    a = spark.createDataFrame([(1, 2)], "query_id int, other int")
    b = spark.createDataFrame([(1, 2, 0.5)], "query_id int, similar_id int, similarity_score double")
    assert SC.pick_similarity_table([a, b]) is b and SC.pick_similarity_table([a]) is None


def test_exports_and_embeddings(spark, tmp_path):
    recs = spark.createDataFrame([("a b@x.com", "1", 1), ("__", "2", 1)], "user_id string, item_id string, rank int")
    SK.export_recommendations(recs, str(tmp_path / "recs"))
    back = spark.read.option("header", True).csv(str(tmp_path / "recs"))
    assert sorted(r.user_token for r in back.select("user_token").collect()) == ["a_b@x.com", "unknown_user"]
    SK.export_events_csv(X.events(spark, SF_SMALL).limit(5), str(tmp_path / "ev"))
    assert spark.read.option("header", True).csv(str(tmp_path / "ev")).count() == 5
    SK.write_embeddings(X.image_emb(spark, SF_SMALL), str(tmp_path / "emb"))
    assert spark.read.parquet(str(tmp_path / "emb")).count() == X.image_emb(spark, SF_SMALL).count()


def test_enrich_events_drops_bad_times(spark):
    raw = spark.createDataFrame([("1", "2024-01-02 03:04:05"), ("2", "not a time"), ("3", None)],
                                "user_id string, event_time string")
    out = A.enrich_events(raw).collect()
    assert [(r.user_id, str(r.event_date)) for r in out] == [("1", "2024-01-02")]


def test_ranker_save_and_load(spark, tmp_path):
    from pyspark.ml.regression import GBTRegressionModel

    from shoplens.operators import ranking as R
    rows = [(f"u{i % 5}", f"i{i}", float(i % 3), *[float((i * j) % 7) for j in range(19)]) for i in range(60)]
    from shoplens.operators.features import FEATURE_COLUMNS
    df = spark.createDataFrame(rows, ["user_id", "item_id", "label", *FEATURE_COLUMNS])
    models = R.train_rankers(df, None, max_iter=3, max_depth=2)
    models["gbt"].write().overwrite().save(str(tmp_path / "gbt"))
    loaded = GBTRegressionModel.load(str(tmp_path / "gbt"))
    a = R.model_scorer({"gbt": models["gbt"]})(df).select("raw_score").collect()
    b = R.model_scorer({"gbt": loaded})(df).select("raw_score").collect()
    assert a == b
    assert R.feature_importance(loaded).count() == 19
    assert "If" in R.tree_rules(loaded)


def test_similarity_table_is_the_first_complete_file(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    a.mkdir()
    b.mkdir()
    assert SC.scan_similarity_table(spark, [str(tmp_path / "missing"), str(a)]) is None
    (a / "best.csv").write_text("query_id,similar_id,similarity_score\n")    # no rows
    (a / "notes.csv").write_text("query_id,other\n1,2\n")
    (a / "z.csv").write_text("query_id,similar_id,similarity_score\n7,8,0.25\n")
    (b / "best.csv").write_text("query_id,similar_id,similarity_score\n1,2,0.5\n")
    (b / "a.csv").write_text("query_id,similar_id,similarity_score\n3,4,0.5\n")
    got = SC.scan_similarity_table(spark, [str(tmp_path / "missing"), str(a), str(b)], ["best.csv"]).collect()
    assert [(r.query_id, r.similar_id, r.similarity_score) for r in got] == [("7", "8", 0.25)]
    assert SC.scan_similarity_table(spark, [str(b)], ["best.csv"]).first().query_id == "1"
    assert SC.scan_similarity_table(spark, [str(b)]).first().query_id == "3"
