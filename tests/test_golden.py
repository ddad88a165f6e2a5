"""Hand-computed expectations for the semantics that are easy to get subtly wrong."""

import datetime as dt
import math

from pyspark.sql import functions as F

from shoplens.operators import checkout as K
from shoplens.operators import online as O
from shoplens.operators import profiles as P
from shoplens.operators import ranking as R

NOW = dt.datetime(2025, 1, 1, 12, 0, 0)


def _ev(spark, rows):
    return spark.createDataFrame(rows, "event_id long, user_id string, item_id string, event_type string, ts timestamp")


def test_online_demo_matches_reference_example(spark):
    # six add_to_cart events of three users (the reference's simulated demo)
    m = dt.timedelta(minutes=1)
    ev = _ev(spark, [
        (1, "U1", "ITEM_A", "add_to_cart", NOW - 3 * m), (2, "U1", "ITEM_B", "add_to_cart", NOW - 2 * m),
        (3, "U2", "ITEM_A", "add_to_cart", NOW - 2 * m), (4, "U2", "ITEM_B", "add_to_cart", NOW - 1 * m),
        (5, "U3", "ITEM_A", "add_to_cart", NOW - 1 * m), (6, "U3", "ITEM_C", "add_to_cart", NOW),
    ])
    pairs = {(r.item_a, r.item_b): (r.weight, r.last_updated) for r in O.co_cart_weights(ev).collect()}
    assert pairs[("ITEM_A", "ITEM_B")] == (2.0, NOW - m)
    assert pairs[("ITEM_A", "ITEM_C")] == (1.0, NOW)
    cart = spark.createDataFrame([("X", "ITEM_A", 1)], "user_id string, item_id string, quantity int")
    cands = spark.createDataFrame([("X", "ITEM_B", 0.62), ("X", "ITEM_C", 0.63), ("X", "ITEM_D", 0.65)],
                                  "user_id string, item_id string, model_score double")
    out = O.blend_scores(cart, cands, O.co_cart_weights(ev), F.lit(NOW).cast("timestamp"))
    rows = {r.item_id: r for r in out.collect()}
    assert math.isclose(rows["ITEM_B"].online_boost, 2 * 0.995 ** (1 / 60), rel_tol=1e-12)
    assert math.isclose(rows["ITEM_C"].online_boost, 1.0)
    assert rows["ITEM_D"].online_boost == 0.0
    assert math.isclose(rows["ITEM_C"].blended_score, 0.78)
    assert math.isclose(rows["ITEM_B"].blended_score, 0.62 + 0.15 * 2 * 0.995 ** (1 / 60))
    assert [r.item_id for r in sorted(rows.values(), key=lambda r: r.rank)] == ["ITEM_B", "ITEM_C", "ITEM_D"]


def test_repeated_cart_items_pair_twice_and_history_is_bounded(spark):
    m = dt.timedelta(minutes=1)
    rows = [(i, "U", "A", "add_to_cart", NOW + i * m) for i in range(3)] + [(9, "U", "B", "add_to_cart", NOW + 9 * m)]
    w = O.co_cart_weights(_ev(spark, rows)).collect()
    assert [(r.item_a, r.item_b, r.weight) for r in w] == [("A", "B", 3.0)]
    w2 = O.co_cart_weights(_ev(spark, rows), history=2).collect()
    assert [(r.item_a, r.item_b, r.weight) for r in w2] == [("A", "B", 2.0)]


def test_weighted_mode_ties_take_smallest_value(spark):
    df = spark.createDataFrame([("u", "b", 2.0), ("u", "a", 1.0), ("u", "a", 1.0), ("u", None, 9.0),
                                ("v", None, 1.0)], "user_id string, c string, w double")
    got = {r.user_id: r.mode_c for r in P.weighted_mode(df, "user_id", "c", "w").collect()}
    assert got == {"u": "a"}


def test_pct_rank_is_pandas_average_rank(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 2.0), ("d", 3.0), ("e", None)],
                               "item_id string, s double")
    got = {r.item_id: r.pr for r in P.pct_rank(df, "s", "pr").collect()}
    assert got == {"a": 0.25, "b": 0.625, "c": 0.625, "d": 1.0, "e": 0.0}


def test_diversity_keeps_three_per_category(spark):
    rows = [("u", f"i{i}", float(10 - i)) for i in range(8)]
    ranked = spark.createDataFrame(rows, "user_id string, item_id string, score double")
    prods = spark.createDataFrame([(f"i{i}", "x" if i < 5 else "y") for i in range(7)],
                                  "item_id string, category string")
    got = R.diversity_rerank(ranked, prods, 5, "score").orderBy("rank").collect()
    # i0..i2 (x), i5, i6 (y); i7 is unknown to the catalog and counts as 'unknown'
    assert [r.item_id for r in got] == ["i0", "i1", "i2", "i5", "i6"]


def test_ranking_metrics_match_hand_computation(spark):
    rows = [("u", "a", 3.0, 2), ("u", "b", 2.0, 0), ("u", "c", 1.0, 1), ("v", "x", 1.0, 0)]
    df = spark.createDataFrame(rows, "user_id string, item_id string, score double, label int")
    m = R.ranking_metrics(df, k=2).first()
    # u: hits@2 = 1 -> p = .5, r = .5, ap = 1/1 / min(2,2) = .5, ndcg = 3 / (3 + 1/log2(3)); v: zeros
    ndcg_u = 3.0 / (3.0 + 1.0 / math.log2(3))
    assert m.precision_at_2 == 0.25 and m.recall_at_2 == 0.25 and m.map_at_2 == 0.25
    assert m.ndcg_at_2 == round(ndcg_u / 2, 4) and m.hit_rate_at_2 == 0.5


def test_metadata_candidates_scoring(spark):
    prods = spark.createDataFrame([
        ("1", "Acme gold ring", "accessories", 100.0, "women"),
        ("2", "Acme silver ring", "accessories", 50.0, "women"),
        ("3", "Zed ring box", "home", 10.0, None),
        ("4", "Zed cotton shirt", "apparel", 200.0, "men"),
    ], "item_id string, product_name string, category string, price double, gender string")
    carts = spark.createDataFrame([("c", "1", 1)], "cart_id string, item_id string, quantity int")
    got = {r.item_id: r.similarity_score for r in K.metadata_candidates(prods, carts, 10).collect()}
    # cart type 'accessories' (category column is used first), non-cart prices 10..200
    assert math.isclose(got["2"], 8 + 2 + 0.8 + 0.6 + 2 * (200 - 50) / 190)
    assert math.isclose(got["3"], -2 + 2 * (200 - 10) / 190)
    assert math.isclose(got["4"], -2 + 0.0)
    assert "1" not in got
