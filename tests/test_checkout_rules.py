"""Attribute rules against scoring every item, checkout fallbacks, and the tracker on repeated writes."""

import random

import pytest
from pyspark.sql import functions as F

from shoplens.operators import checkout as K
from shoplens.sources import sinks as SK

PRODUCTS = "item_id string, product_name string, category string, brand string, price double, in_stock boolean, gender string"


def catalog(seed, n, flat=False):
    rng = random.Random(seed)
    names = ["gold ring", "steel watch", "red shirt", "blue thing", "running shoe", ""]
    return [(f"i{i:03d}", f"{rng.choice(['Acme', 'Bolt', 'Cora'])} {rng.choice(names)}", rng.choice([None, "unknown", "watch", "gadget"]),
             "b", 5.0 if flat else rng.choice([None, 0.0, -1.0, *map(float, range(1, 40))]), True, rng.choice([None, "men", "women", ""]))
            for i in range(n)]


def brute(attrs, carts, top_n):
    items = {r["item_id"]: r for r in attrs}
    out = []
    for cart, own in carts.items():
        mine = [items[i] for i in own if i in items]
        if not mine:
            continue
        types = {r["_type"] for r in mine}
        known = types - {"unknown"}
        cats, brands = ({r[c] for r in mine} - {"unknown"} for c in ("_cat", "_brand"))
        genders = {r["_gender"] for r in mine} - {None}
        prices = [r["price"] for i, r in items.items() if i not in own and r["price"] is not None and r["price"] > 0]
        lo, hi = (min(prices), max(prices)) if prices else (0.0, 0.0)
        rows = []
        for i, r in items.items():
            if i in own:
                continue
            t, p = r["_type"], r["price"] or 0.0
            s = (8.0 if t in known else -3.0 if t == "unknown" else -2.0) if known else (4.0 if t != "unknown" and t in types else 0.0)
            s += 2.0 * (r["_cat"] in cats) + 0.8 * (r["_gender"] is not None and r["_gender"] in genders) + 0.6 * (r["_brand"] in brands)
            s += 2.0 * max(0.0, min(1.0, (hi - p) / (hi - lo))) if p > 0 and hi > lo else 1.0 if p > 0 and hi > 0 else 0.0
            rows.append((-round(s, 9), i))
        out += [(cart, i, -s) for s, i in sorted(rows)[:top_n]]
    return sorted(out)


@pytest.mark.parametrize("flat,n", [(False, 150), (True, 60), (False, 12)])
def test_rules_equal_scoring_every_item(spark, flat, n):
    rows = catalog(5, n, flat)
    rng = random.Random(1)
    ids = [r[0] for r in rows]
    carts = {f"c{k}": set(rng.sample(ids, min(n, rng.choice((1, 2, 3, 40, 9))))) for k in range(25)}
    carts["all"], carts["gone"] = set(ids), {"nowhere"}
    carts["two left"] = set(sorted(ids, key=lambda i: next(r[4] or 0 for r in rows if r[0] == i))[2:])
    products = spark.createDataFrame(rows, PRODUCTS)
    df = spark.createDataFrame([(c, i, 1) for c, own in carts.items() for i in own], "cart_id string, item_id string, quantity int")
    got = sorted((r["cart_id"], r["item_id"], round(r["similarity_score"], 9)) for r in K.metadata_candidates(products, df, 7).collect())
    want = brute([r.asDict() for r in K.item_attributes(products).collect()], carts, 7)
    assert [(c, i) for c, i, _ in got] == [(c, i) for c, i, _ in want]
    assert [s for *_, s in got] == pytest.approx([s for *_, s in want], abs=1e-8)


def shop(spark):
    rows = [(f"i{i}", f"Acme ring {i}", "ring", "b", float(10 + i), True, "men") for i in range(30)]
    products = spark.createDataFrame(rows, PRODUCTS).withColumn("popularity_score", F.col("price") / 100).withColumn("ctr_score", F.lit(0.1))
    vectors = spark.createDataFrame([(f"i{i}", [1.0, i / 10, (i % 7) / 7]) for i in range(30)], "item_id string, embedding array<double>")
    carts = spark.createDataFrame([("u1", "i3", 1), ("u2", "i3", 1), ("u2", "i4", 2)], "cart_id string, item_id string, quantity int") \
        .withColumn("added_at", F.to_timestamp(F.lit("2024-01-05")))
    events = spark.createDataFrame([("u1", "i25", "purchase"), ("u1", "i26", "click"), ("u9", "i1", "view")],
                                   "user_id string, item_id string, event_type string").withColumn("ts", F.to_timestamp(F.lit("2024-01-04")))
    return products, vectors, carts, events


def test_checkout_query_holds_history_and_cart(spark):
    products, vectors, carts, events = shop(spark)
    got = {}
    for r in K.checkout_recs(carts, products, vectors, events, top_k=5).collect():
        got.setdefault(r["cart_id"], {})[r["item_id"]] = r["similarity_score"]
    assert set(got) == {"u1", "u2"} and "i3" not in got["u1"] and not {"i3", "i4"} & set(got["u2"])
    vec = {r["item_id"]: r["embedding"] for r in vectors.collect()}
    query = [3 * a + 1 * b + 2 * c for a, b, c in zip(vec["i25"], vec["i26"], vec["i3"])]  # purchase, click, cart line
    norm = sum(x * x for x in query) ** .5
    for item, score in got["u1"].items():
        assert score == pytest.approx(sum(x * y for x, y in zip(query, vec[item])) / norm)


def test_checkout_without_embeddings_falls_back_to_rules(spark):
    products, vectors, carts, events = shop(spark)
    no_ranking = products.limit(0)
    seen = []

    def scorer(feats):
        seen.append(feats)
        return feats.withColumn("raw_score", F.lit(1.0))

    out = K.checkout_recs(carts.where("cart_id = 'u1'"), products, vectors.limit(0), events, top_k=5, scorer=scorer).collect()
    assert len(out) > 0 and no_ranking.count() == 0
    assert {tuple(r) for r in seen[-1].select("sim_to_cart", "sim_to_click").distinct().collect()} == {(0.0, 0.0)}


def test_tracker_on_stored_table(spark, tmp_path):
    def rows(kind, users, items, **more):
        base = [(u, None, "checkout", i, f"n{i}", 1.0) for u in users for i in items]
        df = spark.createDataFrame(base, "user_email string, session_id string, source string, item_id string, product_name string, price double")
        if kind == "cart":
            return df.withColumn("quantity", F.lit(1)).withColumn("added_at", F.to_timestamp(F.lit("2024-01-01")))
        scores = {c: F.lit(None).cast("double") for c in ("ranking_score", "lgbm_ranking_score", "xgboost_ranking_score")}
        return df.withColumn("rank", F.lit(2)).withColumn("similarity_score", F.lit(.5)).withColumn("fallback_score", F.lit(.5)).withColumns(scores)

    def state(t):
        return sorted((r.row_type, r.user_email, r.item_id, r.added_to_cart) for r in t.read().collect())

    t = SK.tracker_table(spark, str(tmp_path / "t"))
    for _ in range(2):  # a replay changes nothing
        SK.save_tracker(t, rows("cart", ["a", "b"], ["1"]), rows("rec", ["a", "b"], ["2", "3"]), 0)
    # an item in both kinds of a write is a cart row; b is not touched
    SK.save_tracker(t, rows("cart", ["a"], ["2"]), rows("rec", ["a"], ["2", "4"]), 1)
    assert state(t) == [("cart_item", "a", "2", True), ("cart_item", "b", "1", True), ("recommendation", "a", "4", False),
                        ("recommendation", "b", "2", False), ("recommendation", "b", "3", False)]
    adds = rows("cart", ["a", "b"], ["3"]).unionByName(rows("cart", ["a", "b"], ["3"]))
    for _ in range(2):
        SK.save_added(t, adds.drop("product_name", "price", "quantity"), 2)
    assert state(t) == [("cart_item", "a", "2", True), ("cart_item", "b", "1", True), ("recommendation", "a", "3", True),
                        ("recommendation", "a", "4", False), ("recommendation", "b", "2", False), ("recommendation", "b", "3", True)]


def test_pairs_of_a_carts_types_do_not_grow_with_the_combinations(spark, monkeypatch):
    """60 brands of one type with 5 items each: a cart's 5 best need at most 15 rows and not the 300."""
    rows = [(f"i{b:02d}{k}", f"Brand{chr(97 + b % 26)}{chr(97 + b // 26)} ring {k}", "ring", "b", float(10 + 7 * b % 50 + k), True, "men")
            for b in range(60) for k in range(5)]
    products = spark.createDataFrame(rows, PRODUCTS)
    carts = spark.createDataFrame([(f"c{n}", f"i{n:02d}4", 1) for n in range(20)], "cart_id string, item_id string, quantity int")
    seen, plain = [], K.cut_lineage
    monkeypatch.setattr(K, "cut_lineage", lambda df: seen.append(plain(df)) or seen[-1])
    got = sorted((r["cart_id"], r["item_id"]) for r in K.metadata_candidates(products, carts, 5).collect())
    pairs = [df.count() for df in seen if df.columns == ["cart_id", "item_id"]]
    assert len(pairs) > 1 and max(pairs) <= 20 * (5 + 1) * (5 + 2) // 2
    want = brute([r.asDict() for r in K.item_attributes(products).collect()], {f"c{n}": {f"i{n:02d}4"} for n in range(20)}, 5)
    assert got == sorted((c, i) for c, i, _ in want)


def test_similar_products_searches_its_table_once(spark):
    from shoplens.operators import search as SE
    table = spark.createDataFrame([(f"i{n}", "red ring", 1, f"i{n + 1}", "blue ring", .5) for n in range(40)],
                                  "query_id string, query_name string, rank int, similar_id string, similar_name string, similarity_score double")
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    products = spark.createDataFrame([(f"i{n}", "green band", "ring", 1.0) for n in range(42)], "item_id string, product_name string, category string, price double")
    requests = spark.createDataFrame([("r", "ring"), ("g", "green")], "request_id string, text string")
    out = SE.similar_products(requests, table.mapInArrow(counted, table.schema), products).collect()
    assert [r["query_id"] for r in out if r["request_id"] == "r"] == sorted(f"i{n}" for n in range(40))[:5]
    assert read.value == 40
