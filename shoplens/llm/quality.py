"""Quality classifier as a sparse rule ensemble (operator 4).

Trees over text statistics are grown on labelled rows; every path from a root
becomes a rule, a conjunction of comparisons. A logistic regression with an
L1 penalty keeps few rules. The result is compiled into one Spark column
expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import cut_lineage, held_out, slices, span_hashes, utf8, word_spans

STATS = ("n_bytes", "n_words", "word_size", "upper_share", "digit_share", "punct_share", "symbol_share", "high_share",
         "line_size", "distinct_share", "top_share", "repeat_share", "caps_words_share", "symbol_words_share",
         "pair_share")
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_UPPER, _DIGIT, _PUNCT, _SYMBOL, _LOWER = (np.zeros(256, bool) for _ in range(5))
_UPPER[0x41:0x5B], _LOWER[0x61:0x7B], _DIGIT[0x30:0x3A], _LOWER[0x80:] = True, True, True, True
_PUNCT[[ord(c) for c in ".,;:!?'\"()-"]] = True
_SYMBOL[0x21:0x80] = ~(_UPPER | _LOWER | _DIGIT | _PUNCT)[0x21:0x80]


def statistics(column: pa.Array) -> np.ndarray:
    """(rows, len(STATS)); a null or empty text has zeros."""
    data, offs = utf8(column)
    n = len(offs) - 1
    out = np.zeros((n, len(STATS)))
    if not len(data):
        return out
    size = np.diff(offs)
    safe = np.maximum(size, 1)

    def total(flags: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return c[offs[1:]] - c[offs[:-1]]

    starts, ends, row = word_spans(_SPACE[data], offs)
    words = np.bincount(row, minlength=n)
    safe_words = np.maximum(words, 1)
    hashes = span_hashes(data, starts, ends)

    def has(table: np.ndarray) -> np.ndarray:
        c = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
        return c[ends] > c[starts]

    upper, lower, symbol = has(_UPPER), has(_LOWER), has(_SYMBOL)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    bounds = np.concatenate([[0], np.cumsum(words)])
    for i in range(n):
        h = hashes[bounds[i]:bounds[i + 1]]
        if len(h):
            s = np.sort(h)
            edge = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
            out[i, 9], out[i, 10] = (len(edge) - 1) / len(h), np.diff(edge).max() / len(h)
            pairs = np.sort(h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1])
            out[i, 14] = (1 + np.count_nonzero(pairs[1:] != pairs[:-1])) / len(pairs) if len(pairs) else 1.0
    out[:, 0], out[:, 1], out[:, 2] = size, words, total(~_SPACE[data]) / safe_words
    for j, table in ((3, _UPPER), (4, _DIGIT), (5, _PUNCT), (6, _SYMBOL)):
        out[:, j] = total(table[data]) / safe
    out[:, 7] = total(data >= 0x80) / safe
    out[:, 8] = size / (1 + total(data == 0x0A))
    for j, flags in ((11, same), (12, upper & ~lower), (13, symbol)):
        out[:, j] = np.bincount(row, weights=flags, minlength=n) / safe_words
    return out


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` and the statistics of ``text``."""
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields]
                       + [f"{s} double" for s in STATS])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            stats = statistics(part.column("text"))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], *[pa.array(x) for x in stats.T]],
                                             [*keep, *STATS])

    return docs.select(*keep, "text").mapInArrow(rows, fields)


Rule = tuple[tuple[int, str, float], ...]  # (statistic, "<=" or ">", threshold), all of which must hold


def tree_rules(node, path: Rule = ()) -> list[Rule]:
    """Every path of a fitted tree, from the root to each inner node and leaf."""
    out = [path] if path else []
    if node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        at, cut = split.featureIndex(), round(float(split.threshold()), 9)
        out += tree_rules(node.leftChild(), path + ((at, "<=", cut),))
        out += tree_rules(node.rightChild(), path + ((at, ">", cut),))
    return out


def simplify(rule: Rule) -> Rule:
    """At most one upper and one lower bound of each statistic, in a fixed order."""
    tight: dict[tuple[int, str], float] = {}
    for at, op, cut in rule:
        old = tight.get((at, op))
        tight[at, op] = cut if old is None else min(old, cut) if op == "<=" else max(old, cut)
    return tuple(sorted((at, op, cut) for (at, op), cut in tight.items()))


def rule_column(rule: Rule) -> Column:
    out = F.lit(True)
    for at, op, cut in rule:
        c = F.col(STATS[at])
        out = out & ((c <= cut) if op == "<=" else (c > cut))
    return out


@dataclass
class RuleModel:
    rules: list[tuple[Rule, float]]   # those that the penalty left
    intercept: float

    def score(self) -> Column:
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(rule_column(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(60.0)), F.lit(-60.0))))


def train(docs: DataFrame, labels: DataFrame, sample: int = 20_000, trees: int = 16, depth: int = 3,
          penalty: float = 0.002, seed: int = 7) -> RuleModel:
    """Fit on at most ``sample`` labelled rows (first by hash of the id) that aren't held out.

    Without labels of both kinds the score is the share of label 1 (0.5 without any).
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))) \
        .select("doc_id", F.col("quality").cast("double").alias("label")).distinct() \
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    rows = cut_lineage(with_statistics(rows, "doc_id", "label"))
    rows = rows.repartition(max(2, sample // 10_000)).sortWithinPartitions("doc_id", "label")
    ones, n = rows.agg(F.sum("label"), F.count("*")).first()
    if not n or not 0 < ones < n:
        share = min(max(ones / n if n else 0.5, 1e-6), 1 - 1e-6)
        return RuleModel([], float(np.log(share / (1 - share))))
    data = VectorAssembler(inputCols=list(STATS), outputCol="stats").transform(rows).cache()
    forest = RandomForestClassifier(featuresCol="stats", labelCol="label", numTrees=trees, maxDepth=depth,
                                    featureSubsetStrategy="0.5", seed=seed).fit(data)
    rules = sorted({simplify(r) for t in forest.trees for r in tree_rules(t._java_obj.rootNode())})
    binary = data.select("label", *[rule_column(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
    binary = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="rules") \
        .transform(binary).select("label", "rules").cache()
    lasso = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=penalty,
                               standardization=False, maxIter=60).fit(binary)
    data.unpersist()
    binary.unpersist()
    return RuleModel([(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if w], float(lasso.intercept))


def score_all(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs``.

    Null and empty texts are scored by their statistics, all zero. Repeated
    rows get equal scores; a null doc_id is scored, too, and is never held out;
    other columns are ignored; an empty table gives an empty result.
    """
    model = train(docs, labels)
    return with_statistics(docs, "doc_id").select("doc_id", model.score().alias("score")).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
