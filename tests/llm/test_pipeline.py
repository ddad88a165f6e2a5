"""Stages of the corpus pipeline against brute force, with null and repeated ids."""

import random
import re

import pytest

import corpus_pipeline as P
from shoplens.llm import secret_scan

from .test_jaccard_join import brute

SCHEMA = "doc_id long, text string, lang string"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def near_rows():
    """Texts in groups of near copies under ids that are null, repeated or their own."""
    rng = random.Random(11)
    rows = []
    for group in range(8):
        base = [f"g{group}w{i}" for i in range(60)]
        for _ in range(rng.choice([1, 2, 5])):
            text = list(base)
            text[rng.randrange(60)] = "other"
            rows.append((rng.choice([None, None, 7, rng.randrange(100)]), " ".join(text), "en"))
    rows += [rows[0], rows[0], (7, "alone under a repeated id a b c", "en"), (None, "alone without an id d e f", "en")]
    return rows + [(None, None, "en"), (None, None, "en"), (3, " \n", "en"), (3, " \n", "en")]


def test_near_duplicates_keep_one_row_of_each_group(spark):
    rows = near_rows()
    # brute() joins row numbers, which are unique
    part = {i: (n, c) for i, n, c in brute([(i, t) for i, (_, t, _) in enumerate(rows)], 5, 80)}
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(part[i][1] if part[i][0] else ("wordless", i), []).append(r)
    got = rows_of(P.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), ""))
    assert len(got) == len(groups)
    for members in groups.values():
        texts, least = {r[1] for r in members}, min((r[0] is None, r[0] or 0) for r in members)
        mine = [r for r in got if r[1] in texts]
        if words_of(members[0][1]):
            assert len(mine) == 1 and mine[0] in members and (mine[0][0] is None, mine[0][0] or 0) == least
        else:
            assert len(mine) == sum(r[1] == members[0][1] for r in rows)


def test_decontaminate_judges_rows_by_their_text(spark, tmp_path):
    passage = "one two three four five six seven eight nine ten"
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "so " + passage.upper(), "en"), (None, "clean without an id", "en"), (None, None, "en"), (4, passage, "en"),
            (4, "clean under the same id", "en"), (4, "clean under the same id", "en"), (5, "clean", "en")]
    want = [r for r in rows if " ".join(words_of(passage)) not in " ".join(words_of(r[1]))]
    got = rows_of(P.decontaminate(spark, spark.createDataFrame(rows, SCHEMA), str(tmp_path)))
    assert got == sorted(want, key=repr)


def test_language_and_secrets_keep_rows_by_their_text(spark):
    text = "the words of this line are plain English"
    rows = [(None, text, "en"), (None, None, "en"), (None, "12 34", "en"), (2, text, "en"), (2, "!", "en"), (2, text, "en")] * 3
    rows += [(i, text, "en") for i in range(10, 20)]  # some of these ids aren't held out
    docs = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(P.language(spark, docs, "")) == sorted([r for r in rows if r[1] == text], key=repr)
    rows = [(None, "password=abcdef123 x", "en"), (None, "clean", "en"), (2, "clean", "en"), (2, None, "en"), (2, "clean", "en")]
    got = rows_of(secret_scan.redact(spark.createDataFrame(rows, SCHEMA), secret_scan.Field(None, None)))
    assert got == sorted([(i, t and t.replace("password=abcdef123", "[SECRET]"), x) for i, t, x in rows], key=repr)


@pytest.mark.parametrize("copies", [1, 3])
def test_pack_places_every_row(spark, copies):
    rows = [(None, "a b c", "en"), (None, "d e", "en"), (2, "f", "en")] * copies
    got = P.pack(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert sum(r["start"] == 0 for r in got) == len(rows)


CLASHES = ["lang_pred", "lang_score", "_row", "_kept", "_bad_id", "_bad_text", "component_id", "h", "m", "row", "hits"]


@pytest.mark.parametrize("stage", [s for s, _ in P.STAGES[:-1]])
def test_stages_keep_columns_whose_names_clash(spark, stage):
    rows = [(i, f"the quick brown fox number {i} jumps over a lazy dog and runs into the forest near house {i} at night", "en") for i in range(30)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in CLASHES:
        docs = docs.selectExpr("*", f"concat('mine ', doc_id) as {c}")
    out = dict(P.STAGES)[stage](spark, docs, "/root/testdata/sf0.001")
    assert out.columns == docs.columns
    kept = out.collect()
    assert kept and all(r[c] == f"mine {r['doc_id']}" for r in kept for c in CLASHES)


@pytest.mark.parametrize("stage", [s for s, _ in P.STAGES])
def test_stages_of_an_empty_table(spark, stage):
    assert dict(P.STAGES)[stage](spark, spark.createDataFrame([], SCHEMA), "/root/testdata/sf0.001").count() == 0


def test_quality_and_url_filter_of_empty_tables(spark):
    from shoplens.llm import quality, url_filter
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert quality.score_all(spark.createDataFrame([], SCHEMA), labels).count() == 0
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages, spark.createDataFrame([], "key string")).count() == 0
