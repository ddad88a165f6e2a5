"""Benchmark decontamination by a prefix-filtered set join (operator 8).

A window is ``size`` consecutive words of an item, and all its words are
needed, so its necessary prefix is one word: the rarest, by counts over all
documents. Documents meet windows on that word only; the word's place gives
the one position where the window can stand (positional bound) and the
document must be long enough there (length bound); then the words are
compared exactly. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import cut_lineage

# fixed values: ASCII letters, and the ASCII characters that separate words
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = "".join(chr(c) for c in range(0x80) if not chr(c).isalnum())
MAX_BROADCAST_WINDOWS = 200_000


def words_of(c: Column) -> Column:
    """Words in order: runs of digits, ASCII letters (in lower case) and characters beyond ASCII."""
    plain = F.translate(c, UPPER + SEPARATORS, LOWER + " " * len(SEPARATORS))
    return F.array_remove(F.split(plain, " "), "")


def windows_of(benchmark: DataFrame, size: int) -> DataFrame:
    """(item_id, w): distinct windows of each item that has words."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - (size - 1), F.lit(1))
    return items.select("item_id", "words", F.explode(F.sequence(F.lit(1), last)).alias("s")) \
        .select("item_id", F.expr(f"slice(words, s, {size})").alias("w")).distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of ``docs``.

    A null text has no words. Items without words have no windows; an item
    shorter than ``size`` words is one window. Repeated rows get equal results;
    rows with the same or a null doc_id but other texts are judged by their own
    text. Null item_ids count as hits but as no item. Empty tables on either
    side give no hits. Other columns are ignored.
    """
    windows = cut_lineage(windows_of(benchmark, size))
    found = cut_lineage(_matches(docs, windows))
    covered = F.aggregate(
        F.array_sort(F.collect_set(F.struct("start", "stop"))),
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("upto")),
        lambda acc, w: F.struct(
            (acc["hit"] + F.greatest(w["stop"] - F.greatest(w["start"], acc["upto"]), F.lit(0))).alias("hit"),
            F.greatest(acc["upto"], w["stop"]).alias("upto")))["hit"]
    per_doc = found.groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(
        covered.alias("hit"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"),
                       F.coalesce(F.size(words_of(F.coalesce("text", F.lit("")))), F.lit(0)).cast("long").alias("n_words"))
    out = rows.join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("hit", F.lit(0)) > 0).alias("contaminated"))


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """(_bad_id, _bad_text): doc_id and xxhash64 of the text of each contaminated row, once."""
    found = _matches(docs, cut_lineage(windows_of(benchmark, size)))
    return found.select(F.col("doc_id").alias("_bad_id"), F.col("key").alias("_bad_text")).distinct()


def _matches(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """(doc_id, key, start, stop, item_id): every occurrence of every window."""
    n_windows = windows.count()
    small = n_windows <= MAX_BROADCAST_WINDOWS  # windows hold at most `size` words each
    hint = F.broadcast if small else (lambda df: df)
    texts = docs.where(F.col("text").isNotNull()).select(
        "doc_id", F.xxhash64("text").alias("key"), words_of(F.col("text")).alias("words"))
    vocabulary = windows.select(F.explode("w").alias("word")).distinct()
    counts = texts.select(F.explode("words").alias("word")).join(hint(vocabulary), "word", "left_semi") \
        .groupBy("word").agg(F.count("*").alias("n"))
    places = windows.select("item_id", "w", F.posexplode("w").alias("at", "word")) \
        .join(cut_lineage(counts), "word", "left")
    rarest = places.groupBy("item_id", "w").agg(F.min(F.struct(
        F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("r"))
    # a window with a word that no document has can't occur
    anchors = cut_lineage(rarest.where("r.n > 0").select(
        "item_id", "w", F.size("w").alias("k"), F.col("r.word").alias("anchor"), F.col("r.at").alias("at")))
    if small:
        spots = texts.select("doc_id", "key", "words", F.posexplode("words").alias("pos", "word"))
        here, first = "words", F.col("pos") - F.col("at")
    else:  # too many windows for every task: shuffle each word with its surroundings instead
        longest = anchors.agg(F.max("k")).first()[0] or 1
        spots = texts.select("doc_id", "key", "words", F.posexplode("words").alias("pos", "word")).select(
            "doc_id", "key", "pos", "word",
            F.expr(f"greatest(pos - {longest - 1}, 0)").alias("base"),
            F.expr(f"slice(words, greatest(pos - {longest - 1}, 0) + 1, {2 * longest - 1})").alias("words"))
        here, first = "words", F.col("pos") - F.col("at") - F.col("base")
    start = F.col("pos") - F.col("at")
    fits = (first >= 0) & (first + F.col("k") <= F.size(here)) \
        & (F.slice(here, F.greatest(first, F.lit(0)) + 1, F.col("k")) == F.col("w"))
    return spots.join(hint(anchors), (F.col("word") == F.col("anchor")) & fits).select(
        "doc_id", "key", start.cast("long").alias("start"), (start + F.col("k")).cast("long").alias("stop"), "item_id")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, ws[s:s + 9] AS w FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS s FROM b WHERE len(ws) > 0)),
ks AS (SELECT DISTINCT len(w) AS k FROM win),
sp AS (SELECT doc_id, ws, k, unnest(generate_series(1, len(ws) - k + 1)) AS s FROM d, ks WHERE len(ws) >= k),
hit AS (SELECT doc_id, s, k, item_id FROM (SELECT doc_id, s, k, ws[s:s + k - 1] AS w FROM sp) JOIN win USING (w)),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + k - 1)) AS p FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
