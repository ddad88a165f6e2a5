"""Counts against plain Python, the binomial test against its sum, and the promise on labelled texts."""

import math
import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from shoplens.llm import quality_rules
from shoplens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n ", "a", "# * | <>", "a b c d e\na b c d e\na b c d e", "x " * 5000, "é É ß 中文 \x85 \xa0 \x1c",
       "l 1\n\nl 1\r\nl 1\nl 1 ", "a a a a a a", "one two three four five six\none two three four five"]


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    lines, seen, dup = [x for x in text.split("\n") if WORD.search(x)], set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_counts_equal_plain_python():
    texts = ODD + [r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    own, ratios = quality_rules.counts(pa.array(texts))
    assert [tuple(r) for r in own.tolist()] == [plain(t) for t in texts]
    assert (ratios >= 0).all() and ratios.shape == (len(texts), len(quality_rules.RATIOS))


def test_binomial_cdf_equals_its_sum():
    for n in (1, 7, 60, 400):
        for k in {0, 1, n // 20, n // 3, n - 1}:
            for p in (0.01, 0.05, 0.4):
                want = sum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
                assert quality_rules.binomial_cdf(k, n, p) == pytest.approx(want, rel=1e-9)
    assert 0.49 < quality_rules.binomial_cdf(50_000_000, 1_000_000_000, 0.05) < 0.51


def test_a_bad_cutoff_is_rarely_accepted():
    rng = random.Random(1)
    wrong = 0
    for _ in range(400):  # level 0 rejects 2 % of the good, level 1 just over the risk
        draws = [rng.random() for _ in range(800)]
        rejected = [sum(d < 0.02 for d in draws), sum(d < 0.051 for d in draws)]
        wrong += quality_rules.allowed_level(rejected, 800, 0.05, 0.05) == 2
    assert wrong <= 0.08 * 400


def corpus(spark, seed=3, n=1600):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice("the of river stone walks quickly under bright evening".split()) + str(rng.randrange(40)) * (rng.random() < .1)
                 for _ in range(rng.choice((30, 120)))]
        good = i % 4 > 0
        if not good:
            words = [w + rng.choice(("###", "$$$")) for w in words]
        rows.append((i, " ".join(words) + f" end{i}", "en" if i % 3 else None, 5))
        labels.append((i, int(good)))
    return (spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words long"),
            spark.createDataFrame(labels, "doc_id long, quality int"))


def test_cutoffs_drop_the_bad_and_keep_the_good(spark):
    docs, labels = corpus(spark)
    got = {r["doc_id"]: r for r in quality_rules.judge(docs, labels).collect()}
    open_ = [r for r in got.values() if not r["base_failed"]]
    good = [r["kept"] for r in open_ if r["doc_id"] % 4]
    bad = [r["kept"] for r in open_ if r["doc_id"] % 4 == 0]
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.05 * len(bad)
    assert {r["stratum"] for r in got.values()} == {"en/0", "en/1", "other/0", "other/1"}


def test_without_labels_only_the_base_rules_decide(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(ODD)] + [(None, "w " * 9 + "x y z q", None)] * 2,
                                 "doc_id long, text string, lang string")
    for labels in ([], [(3, None), (4, 0), (4, 1), (5, 1), (None, 1)]):
        out = quality_rules.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()
        assert len(out) == len(ODD) + 2
        for r in out:
            n, rep = r["n_words"], r["n_repeat_words"]
            assert r["base_failed"] == (n < 10 or 100 * rep > 20 * n) and r["kept"] == (not r["base_failed"])
    assert quality_rules.judge(docs.limit(0), labels=spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_query_on_labelled_documents(spark):
    got = QUERIES["op12_quality_rules"](spark, "/root/testdata/sf0.1").collect()
    quality = {r["doc_id"]: r["quality"] for r in pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pylist()}
    known = [(quality[r["doc_id"]], r) for r in got if r["doc_id"] in quality]
    assert len({r["doc_id"] for r in got}) == len(got) == pq.read_table("/root/testdata/sf0.1/documents.parquet").num_rows
    good = [r["kept"] for q, r in known if q == 1 and not r["base_failed"]]
    bad = [r["kept"] for q, r in known if q == 0]
    assert sum(good) >= 0.98 * len(good)
    assert sum(bad) <= 0.4 * len(bad)
