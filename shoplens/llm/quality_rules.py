"""Quality rules whose cutoffs carry a guarantee (operator 12).

A document fails a rule when one of its ratios lies beyond a cutoff. Cutoffs
are found per stratum (language and length class) on labelled documents, which
are split in two by the hash of their texts. One half proposes: levels of
growing strictness, each a quantile of the good documents for every rule, and
the rules that catch bad documents at all. The other half, the holdout,
decides: level after level, from lenient to strict, the good documents that
any rule of the stratum rejects are counted, and a level holds only while the
exact binomial test says that the share of rejected good documents is at most
``risk``. The error rate is shared out over the strata (Bonferroni); inside a
stratum the tests stand in a fixed order and the first failure ends them, so
they need no further share. All strata together keep their promise with
probability ``1 - error``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import mix, slices, span_hashes, utf8, word_spans, written

WINDOW = 5
LEVELS = (0.0005, 0.001, 0.002, 0.005, 0.01, 0.02)  # share of the proposing good documents beyond a cutoff
LENGTHS = (50, 200, 800)     # words at which the length classes part
MAX_LANGS = 50               # languages with strata of their own; all others share one
# ratios by rule, the direction in which they are bad, and the cutoff that is never undercut
RULES = (("symbols_per_word", 1, 0.1), ("no_letter_share", 1, 0.2), ("dup_line_share", 1, 0.3),
         ("repeat_share", 1, 0.15), ("caps_share", 1, 0.3), ("stops_per_word", 1, 0.5), ("word_size", 1, 8.0),
         ("word_size", -1, 3.5))
RATIOS = tuple(dict.fromkeys(r for r, _, _ in RULES))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SPACE, _SYMBOL, _LETTER, _UPPER, _STOP = (np.zeros(256, bool) for _ in range(5))
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_STOP[[ord(c) for c in ".!?"]] = True
_UPPER[0x41:0x5B] = True
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = _LETTER[0x80:] = True


# counts ---------------------------------------------------------------------
def _seen_twice(keys: np.ndarray) -> np.ndarray:
    """Which keys occur at least twice."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    out = np.zeros(len(keys), bool)
    out[order[1:]] = same
    out[order[:-1]] |= same
    return out


def _seen_before(keys: np.ndarray) -> np.ndarray:
    """Which keys occur earlier."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out


def counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whole texts' COUNTS (rows, 5) and RATIOS (rows, 7); a null text has zeros.

    Lines and windows are told apart by 64-bit hashes.
    """
    data, offs = utf8(column)
    n = len(offs) - 1
    own, ratios = np.zeros((n, len(COUNTS)), np.int64), np.zeros((n, len(RATIOS)))
    if not len(data):
        return own, ratios
    space = _SPACE[data]
    starts, ends, row = word_spans(space, offs)
    n_words = np.bincount(row, minlength=n)

    def running(flags: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])

    def per_row(flags: np.ndarray) -> np.ndarray:
        c = running(flags)
        return c[offs[1:]] - c[offs[:-1]]

    def per_word(table: np.ndarray) -> np.ndarray:
        c = running(table[data])
        return c[ends] > c[starts]

    salt = mix(np.arange(1, n + 1, dtype=np.uint64))  # rows' keys are apart
    # lines: between newlines and row ends, with a word
    newline = data == 0x0A
    line_starts, line_ends, line_row = word_spans(newline, offs)  # empty lines have no word
    wordy = running(~space)
    has = wordy[line_ends] > wordy[line_starts]
    line_starts, line_ends, line_row = line_starts[has], line_ends[has], line_row[has]
    dup = _seen_before(mix(span_hashes(data, line_starts, line_ends) ^ salt[line_row]))
    # windows of five words inside a row
    hashes = span_hashes(data, starts, ends)
    marked = np.zeros(len(starts) + 1, np.int64)
    if len(starts) >= WINDOW:
        key = salt[row[WINDOW - 1:]]
        for k in range(WINDOW):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + hashes[k:len(hashes) - WINDOW + 1 + k])
        inside = np.flatnonzero(row[WINDOW - 1:] == row[:len(row) - WINDOW + 1])
        again = inside[_seen_twice(key[inside])]
        marked[again] += 1
        np.add.at(marked, again + WINDOW, -1)
    repeated = np.cumsum(marked[:-1]) > 0
    own[:, 0] = n_words
    own[:, 1] = per_row(~space & ((data & 0xC0) != 0x80))
    own[:, 2] = per_row(_SYMBOL[data])
    own[:, 3] = np.bincount(line_row, weights=dup, minlength=n)
    own[:, 4] = np.bincount(row, weights=repeated, minlength=n)
    words = np.maximum(n_words, 1)
    by_name = {
        "symbols_per_word": own[:, 2] / words, "word_size": own[:, 1] / words, "repeat_share": own[:, 4] / words,
        "dup_line_share": own[:, 3] / np.maximum(np.bincount(line_row, minlength=n), 1),
        "no_letter_share": np.bincount(row, weights=~per_word(_LETTER), minlength=n) / words,
        "caps_share": np.bincount(row, weights=per_word(_UPPER) & ~per_word(_LETTER & ~_UPPER) & (ends - starts > 1), minlength=n) / words,
        "stops_per_word": per_row(_STOP[data]) / words}
    for k, name in enumerate(RATIOS):
        ratios[:, k] = by_name[name]
    return own, ratios


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, text_hash, the counts and the ratios of each row."""
    kept = ["doc_id", "lang"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own, ratios = counts(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in (*kept, "text_hash")], *[pa.array(np.ascontiguousarray(c)) for c in (*own.T, *ratios.T)]],
                names=[*kept, "text_hash", *COUNTS, *RATIOS])

    fields = [f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields]
    fields += ["text_hash long", *[f"{c} long" for c in COUNTS], *[f"{r} double" for r in RATIOS]]
    return docs.select(*kept, F.xxhash64("text").alias("text_hash"), "text").mapInArrow(rows, ", ".join(fields))


def base_failed() -> Column:
    """Fewer than ten words, or more than a fifth of them in repeated windows."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


# the exact binomial test ----------------------------------------------------
def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of n draws of probability p: the regularised incomplete beta function by its continued fraction."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    a, b, x = n - k, k + 1, 1 - p

    def fraction(a: float, b: float, x: float) -> float:
        tiny = 1e-300
        c, d = 1.0, 1 / max(1 - (a + b) * x / (a + 1), tiny)
        out = d
        for m in range(1, 100_000):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                        -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1 + num * d
                d = 1 / (d if abs(d) > tiny else tiny)
                c = 1 + num / c
                c = c if abs(c) > tiny else tiny
                out *= c * d
            if abs(c * d - 1) < 1e-14:
                break
        return out

    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * fraction(a, b, x) / a
    return 1 - front * fraction(b, a, 1 - x) / b


def allowed_level(rejected: list[int], good: int, risk: float, error: float) -> int:
    """How many levels hold: the tests go from lenient to strict and end with the first that fails."""
    for level, k in enumerate(rejected):
        if binomial_cdf(k, good, risk) > error:
            return level
    return len(rejected)


# strata and cutoffs ---------------------------------------------------------
def _stratum(langs: list[str]) -> Column:
    lang = F.when(F.col("lang").isin(langs), F.col("lang")).otherwise(F.lit("other")) if langs else F.lit("other")
    size = F.lit(len(LENGTHS))
    for i in range(len(LENGTHS) - 1, -1, -1):
        size = F.when(F.col("n_words") < LENGTHS[i], F.lit(i)).otherwise(size)
    return F.concat_ws("/", lang, size.cast("string"))


def _beyond(j: int, cut: Column) -> Column:
    name, sign, _ = RULES[j]
    return F.coalesce(F.col(name) > cut if sign > 0 else F.col(name) < cut, F.lit(False))


def learn(rows: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> tuple[list[str], list[tuple]]:
    """Languages with strata of their own, and (stratum, level, good in the holdout, rejected of them, cutoffs).

    Every labelled row that isn't rejected by the base rules takes part; copies
    of a text count once for each label, so that the holdout's draws are not
    repeats of each other. Only counts by stratum reach the driver: at most
    ``MAX_LANGS + 1`` languages with four length classes.
    """
    known = labels.where(F.col("quality").isNotNull()).select("doc_id", F.col("quality").alias("label"))
    rows = rows.where(~base_failed()).join(known, "doc_id") \
        .groupBy("text_hash", "label").agg(*[F.min(c).alias(c) for c in ("lang", "n_words", *RATIOS)])
    rows = written(rows)
    langs = [r["lang"] for r in rows.where("label = 1 and lang is not null").groupBy("lang").count()
             .orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()]
    rows = rows.withColumn("stratum", _stratum(langs)).withColumn("holdout", F.xxhash64("text_hash") % 2 == 0)
    propose, holdout = rows.where(~F.col("holdout")), rows.where("holdout and label = 1")
    # cutoffs: quantiles of the proposing good documents, never beyond the fixed ones
    shares = {1: [1 - t for t in LEVELS], -1: list(LEVELS)}
    cuts = {r["stratum"]: [[max(c, floor) if sign > 0 else min(c, floor) for c in r[f"c{j}"]]
                           for j, (_, sign, floor) in enumerate(RULES)]
            for r in propose.where("label = 1").groupBy("stratum").agg(*[
                F.percentile_approx(name, shares[sign], 100_000).alias(f"c{j}") for j, (name, sign, _) in enumerate(RULES)]).collect()}
    if not cuts:
        return langs, []
    spark = rows.sparkSession
    table = F.broadcast(spark.createDataFrame([(s, c) for s, c in sorted(cuts.items())], "stratum string, cuts array<array<double>>"))
    last = len(LEVELS) - 1
    # a rule counts if, at its strictest, it catches a larger share of the bad than of the good, twice over
    caught = propose.join(table, "stratum").groupBy("stratum").agg(
        F.sum((F.col("label") == 1).cast("long")).alias("good"), F.sum((F.col("label") != 1).cast("long")).alias("bad"),
        *[F.sum((_beyond(j, F.col("cuts")[j][last]) & (F.col("label") == 1)).cast("long")).alias(f"g{j}") for j in range(len(RULES))],
        *[F.sum((_beyond(j, F.col("cuts")[j][last]) & (F.col("label") != 1)).cast("long")).alias(f"b{j}") for j in range(len(RULES))])
    for r in caught.collect():
        for j, (_, sign, _) in enumerate(RULES):
            if not r["bad"] or r[f"b{j}"] * max(r["good"], 1) <= 2 * r[f"g{j}"] * r["bad"]:
                cuts[r["stratum"]][j] = [sign * math.inf] * len(LEVELS)
    cuts = {s: c for s, c in cuts.items() if any(math.isfinite(x[0]) for x in c)}
    if not cuts:
        return langs, []
    table = F.broadcast(spark.createDataFrame([(s, c) for s, c in sorted(cuts.items())], "stratum string, cuts array<array<double>>"))

    def any_rule(level: int) -> Column:
        out = F.lit(False)
        for j in range(len(RULES)):
            out = out | _beyond(j, F.col("cuts")[j][level])
        return out

    found = {r["stratum"]: r for r in holdout.join(table, "stratum").groupBy("stratum").agg(
        F.count("*").alias("good"), *[F.sum(any_rule(v).cast("long")).alias(f"r{v}") for v in range(len(LEVELS))]).collect()}
    out = []
    for s, c in sorted(cuts.items()):
        if s in found:
            rejected = [found[s][f"r{v}"] for v in range(len(LEVELS))]
            level = allowed_level(rejected, found[s]["good"], risk, error / len(cuts))
            if level:
                out.append((s, level, found[s]["good"], rejected[level - 1], [x[level - 1] for x in c]))
    return langs, out


def judge(docs: DataFrame, labels: DataFrame, risk: float = 0.05, error: float = 0.05) -> DataFrame:
    """doc_id, the counts, base_failed, kept, and stratum of each row of ``docs``.

    Null and empty texts have zeros and fail the base rules. A stratum without
    cutoffs that pass the test (too few labelled good documents, say) loses no
    document beyond the base rules. Null languages and those beyond the most
    labelled ones share strata. Repeated rows get equal results; a null doc_id
    matches no label; a label row repeated or in conflict counts once for each
    value; other columns are ignored; an empty table gives an empty result.
    """
    rows = written(measured(docs))
    langs, found = learn(rows, labels, risk, error)
    rows = rows.withColumn("stratum", _stratum(langs)).withColumn("base_failed", base_failed())
    table = F.broadcast(docs.sparkSession.createDataFrame(
        [(s, c) for s, _, _, _, c in found], "stratum string, cuts array<double>"))
    bad = F.lit(False)
    for j in range(len(RULES)):
        bad = bad | _beyond(j, F.col("cuts")[j])
    return rows.join(table, "stratum", "left").select(
        "doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~bad).alias("kept"), "stratum")
