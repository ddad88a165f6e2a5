"""Upper-bound BM25, order statistics and popularity lists against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoplens.operators import candidates as C
from shoplens.operators import profiles as P
from shoplens.operators import search as SE


def plain_bm25(queries, docs, k, limits=None, values=None):
    toks = {d: t.lower().split() for d, t in docs}
    n, avg = len(docs), sum(map(len, toks.values())) / len(docs)
    df = Counter(t for ws in toks.values() for t in set(ws))
    out = {}
    for q, text in queries:
        rows = []
        for d, ws in toks.items():
            if limits and limits.get(q) is not None and not (values[d] is not None and values[d] <= limits[q]):
                continue
            tf, s, hit = Counter(ws), 0.0, False
            for t, m in Counter(text.lower().split()).items():
                if tf[t]:
                    hit = True
                    s += m * math.log(1 + (n - df[t] + .5) / (df[t] + .5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (.25 + .75 * len(ws) / avg))
            if hit:
                rows.append((-round(s, 9), d))
        out[q] = [(d, -s) for s, d in sorted(rows)[:k]]
    return out


@pytest.mark.parametrize("k", [1, 4, 1000])
def test_bm25_equals_scoring_every_document(spark, monkeypatch, k):
    monkeypatch.setattr(SE, "SEED_POSTINGS", 2)
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]     # w0 stands in almost every text
    docs = [(i, " ".join(rng.choices(vocab, weights, k=rng.choice((5, 40, 120))))) for i in range(400)]
    docs += [(400 + i, docs[7][1]) for i in range(6)]
    queries = [(f"q{i}", " ".join(rng.choices(vocab, k=rng.choice((1, 3, 12))))) for i in range(25)]
    queries += [("hot", "w0"), ("hots", "w0 w1 w2"), ("none", "zzz"), ("twice", "w9 w9 w250"), ("copy", docs[7][1])]
    q, d = spark.createDataFrame(queries, "query_id string, query string"), spark.createDataFrame(docs, "doc_id long, text string")
    limits = {x: (float(i * 20) if i % 2 else None) for i, (x, _) in enumerate(queries)}
    values = {i: (float(i) if i % 5 else None) for i, _ in docs}
    frames = dict(limits=spark.createDataFrame(list(limits.items()), "query_id string, limit double"),
                  values=spark.createDataFrame(list(values.items()), "doc_id long, value double"))
    for want, more in ((plain_bm25(queries, docs, k), {}), (plain_bm25(queries, docs, k, limits, values), frames)):
        got = {}
        for r in SE.bm25_search(q, d, k=k, **more).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((r["doc_id"], r["bm25_score"]))
        for x, rows in want.items():
            mine = got.get(x, [])
            assert [d for d, _ in mine] == [d for d, _ in rows]
            assert [s for _, s in mine] == pytest.approx([s for _, s in rows], abs=1e-8)


@pytest.mark.parametrize("buckets", [4096, 3])
def test_order_statistics(spark, buckets):
    rng = np.random.default_rng(1)
    columns = [rng.normal(size=500).tolist(), (10.0 ** rng.uniform(-300, 300, 400)).tolist(), [5.0] * 90 + [1.0] * 5 + [9.0],
               [1.7e308, -1.7e308, 0.0, 1.0], [2.0], (1.7e15 + rng.integers(0, 10**12, 300)).astype(float).tolist()]
    for values in columns:
        df = spark.createDataFrame([(v,) for v in values], "x double")
        ordered = sorted(values)
        for rank in {0, len(values) // 3, len(values) - 1}:
            value, upto = P.order_statistic(df, rank, buckets)
            assert value == ordered[rank] and upto == sum(v <= value for v in values)


def test_quantile_is_percentile_of_the_finite_values(spark):
    rows = [(float(v),) for v in [3, 1, 4, 1, 5, 9, 2, 6]] + [(None,), (float("nan"),), (float("inf"),)]
    df = spark.createDataFrame(rows, "x double")
    for q in (0.0, 0.2, 0.5, 0.8, 1.0):
        assert spark.range(1).select(P.quantile(df, "x", q)).first()[0] == pytest.approx(np.quantile([3, 1, 4, 1, 5, 9, 2, 6], q))
    assert spark.range(1).select(P.quantile(df.limit(0), "x", .5)).first()[0] is None


@pytest.mark.parametrize("near", [1024, 0])
def test_lists_from_a_ranking(spark, monkeypatch, near):
    monkeypatch.setattr(C, "NEAR_RANKS", near)
    ranking = spark.createDataFrame([(f"i{r}", r) for r in range(1, 41)], "item_id string, pop_rank long")
    own = {"a": [1, 2, 3, 9], "b": [], "c": list(range(1, 39)), "d": [5, 6, 40], "e": list(range(1, 41)), "f": [99]}
    excluded = [(u, f"i{r}") for u, rs in own.items() for r in rs] * 2 + [("other", "i1")]
    keys = spark.createDataFrame([(u,) for u in own], "user_id string")
    out = {}
    for r in C.fill_from_ranking(keys, ranking, 5, spark.createDataFrame(excluded, "user_id string, item_id string"), "user_id") \
            .orderBy("user_id", "rank").collect():
        out.setdefault(r["user_id"], []).append(r["item_id"])
    for u, rs in own.items():
        assert out.get(u, []) == [f"i{r}" for r in range(1, 41) if r not in rs][:5]
    plain = C.fill_from_ranking(keys, ranking, 3, None, "user_id").groupBy("user_id").agg(F.collect_list("item_id").alias("l")).collect()
    assert all(sorted(r["l"]) == ["i1", "i2", "i3"] for r in plain) and len(plain) == len(own)


def test_candidates_are_full_whatever_was_bought(spark):
    """A user who bought the 40 nearest items still gets n; a cut to 3n before the filters would leave none."""
    dim, items = 4, [(f"i{i:03d}", [1.0, i / 100, 0.0, 0.0]) for i in range(100)]
    products = spark.createDataFrame([(i, float(n), n % 2 == 0 or n < 50) for n, (i, _) in enumerate(items)],
                                     "item_id string, popularity_score double, in_stock boolean")
    emb = spark.createDataFrame(items, "item_id string, embedding array<double>")
    ev = [("u", f"i{i:03d}", "purchase", "2024-01-01") for i in range(60, 100)] + [("v", "i001", "click", "2024-01-01")]
    ev = spark.createDataFrame(ev, "user_id string, item_id string, event_type string, t string") \
        .withColumn("ts", F.to_timestamp("t"))
    got = C.candidates(ev, products, emb, top_n=5, recency_days=30).groupBy("user_id").agg(F.collect_set("item_id").alias("s")).collect()
    assert dim and {r["user_id"]: len(r["s"]) for r in got} == {"u": 5, "v": 5}
    bought = {f"i{i:03d}" for i in range(60, 100)}
    assert not bought & set(next(r["s"] for r in got if r["user_id"] == "u"))
    cut = C.candidates(ev, products, emb, top_n=5, recency_days=30, overfetch=3).where("user_id = 'u'").count()
    assert cut < 5


def test_keyword_search_equals_scoring_every_product(spark):
    """Groups of products with equal texts, ties in price, missing prices and budgets."""
    rng = random.Random(9)
    fields = [f for f, _ in SE.KEYWORD_FIELDS]
    rows = []
    for i in range(400):
        texts = [rng.choice(("red ring", "blue ring", "steel watch", None, "ring watch")), rng.choice(("ring", "watch", None)),
                 rng.choice(("jewel", None)), rng.choice(("accessories", "ring box")), rng.choice(("men", "women", None))]
        rows.append((f"i{i:03d}", rng.choice((None, 10.0, 10.0, 20.0, float(i))), *texts))
    products = spark.createDataFrame(rows, "item_id string, price double, " + ", ".join(f"{f} string" for f in fields))
    queries = [("a", "red ring"), ("b", "watch under 20"), ("c", "ring watch below 15"), ("d", "nothing here"), ("e", "jewel men")]
    q = spark.createDataFrame(queries, "query_id string, query string")
    got = {}
    for r in SE.keyword_search(q, products, limit=6).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["item_id"], r["relevance_score"]))
    variants = SE.S.TERM_VARIANTS
    terms = {"a": ["red", "ring"], "b": ["watch"], "c": ["ring", "watch"], "d": ["nothing", "here"], "e": ["jewel", "men"]}
    budget = {"b": 20, "c": 15}
    for name, ts in terms.items():
        scored = []
        for item, price, *texts in rows:
            score = sum(w for (_, w), text in zip(SE.KEYWORD_FIELDS, texts) for t in ts for v in variants.get(t, [t]) if v in (text or ""))
            if score and (name not in budget or price is not None and price <= budget[name]):
                scored.append((-score, price is not None, price or 0, item))
        assert got.get(name, []) == [(i, -s) for s, _, _, i in sorted(scored)[:6]]
