"""Training rows are made once for both fits, and validation gives the metrics of each scorer."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.operators import ranking as R
from shoplens.operators.features import FEATURE_COLUMNS


def _rows(spark):
    rng = random.Random(5)
    rows = [(f"u{u:02d}", f"i{i}", rng.choice((0, 0, 1, 3)), *[rng.random() for _ in FEATURE_COLUMNS]) for u in range(20) for i in range(15)]
    return spark.createDataFrame(rows, "user_id string, item_id string, label int, " + ", ".join(f"{c} double" for c in FEATURE_COLUMNS))


@pytest.fixture(scope="module")
def fitted(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    rows = _rows(spark).withColumn("item_price", F.udf(count, T.DoubleType()).asNondeterministic()("item_price"))
    first = dt.datetime(2024, 1, 1)
    events = spark.createDataFrame([(f"u{u:02d}", first + dt.timedelta(days=u)) for u in range(20)], "user_id string, ts timestamp")
    train, val = R.temporal_user_split(rows, events, 0.2)
    models = R.train_rankers(train, val, max_iter=2, max_depth=2)
    return train, val, models, seen.value


def test_training_rows_are_made_once(fitted):
    train, val, _, seen = fitted
    assert train.count() + val.count() == 300
    assert {r["user_id"] for r in val.select("user_id").distinct().collect()} == {"u16", "u17", "u18", "u19"}
    assert seen == 300


def test_validation_is_the_metrics_of_each_scorer(spark, fitted):
    _, val, models, _ = fitted
    got = {r["ranker"]: r[1:] for r in R.validate_rankers(models, val, 5).collect()}
    scorers = {"gbt": R.model_scorer({"gbt": models["gbt"]}), "rf": R.model_scorer({"rf": models["rf"]}), "mean": R.model_scorer(models),
               "linear": lambda df: df.withColumn("raw_score", R.linear_score())}
    assert got == {n: tuple(R.ranking_metrics(s(val), 5, score="raw_score").first()) for n, s in scorers.items()}


def test_training_without_validation_rows(spark):
    models = R.train_rankers(_rows(spark), max_iter=1, max_depth=2)
    assert sorted(models) == ["gbt", "rf"]


def test_each_model_predicts_once(spark, fitted, monkeypatch):
    _, val, models, _ = fitted
    written = []
    plain = R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df: written.append(df.columns) or plain(df))
    out = R.validate_rankers(models, val, 5)
    assert written == [["user_id", "item_id", "label", "score_gbt", "score_rf", "score_mean", "score_linear"]]
    assert "UDF" not in out._jdf.queryExecution().optimizedPlan().toString()
