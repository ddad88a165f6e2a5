"""License scan: Dice coefficient over word bigrams against templates (operator 10).

Each line and each whole text is normalised (lower case, words of letters and
digits) and compared with the normalised templates. 2|A & B| / (|A| + |B|) >= t
needs t / (2 - t) <= |A| / |B| <= (2 - t) / t, so sizes prune templates; it also
needs that share of the template's bigrams, so one of its first few must occur.

Notices that are wrapped or stand inside a longer line, and full license texts,
are found in windows of the words of the whole text: for each template the best
windows, as long as its size bound allows, that no matching line overlaps.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import cut_lineage

# fixed values: license notices as they are commonly quoted
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
            "and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit-line", "Released under the MIT License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted "
            "provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
PERCENT = 80


def template_bigrams(text: str) -> list[str]:
    words = re.findall(r"[a-z0-9]+", text.lower())
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))


def necessary(bigrams: list[str], percent: int) -> list[str]:
    """So many bigrams that a match must hold one of them."""
    need = -(-percent * len(bigrams) // (200 - percent))
    return bigrams[:len(bigrams) - need + 1]


def full_texts() -> tuple[tuple[str, str], ...]:
    """(license, text) of the full texts beside this file."""
    return tuple((f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "licenses").glob("*.txt")))


_WORD = re.compile("[a-z0-9]+")


def possible(docs: DataFrame, needed: list[str], longs: list[list[str]], percent: int) -> DataFrame:
    """(row, doc_id, text) of the documents that can match; row is a number of the document's own.

    They hold the words of a needed bigram one after the other, or are long
    enough for one of ``longs`` (its size bound) and hold so many of its words
    that the bigrams left without theirs are few enough.
    """
    words = [(a, b, re.compile(f"{a}[^a-z0-9]+{b}")) for a, b in (x.split(" ") for x in needed)]
    plans = []
    for grams in longs:
        left, plan = set(grams), []
        for w in sorted({w for g in grams for w in g.split(" ")}, key=lambda w: (-len(w), w)):
            own = {g for g in left if w in g.split(" ")}
            left -= own
            if own:
                plan.append((w, len(own)))  # each bigram counts for its rarer (longer) word only
        need = -(-percent * len(grams) // (200 - percent))
        plans.append((plan, len(grams) - need, need))

    def can_match(t: str) -> bool:
        found = _WORD.findall(t)
        own = set(found)
        if any(a in own and b in own and p.search(t) for a, b, p in words):
            return True
        for plan, spare, need in plans:
            if len(found) <= need:  # n words have at most n - 1 bigrams
                continue
            for w, n in plan:
                if w not in own:
                    spare -= n
                    if spare < 0:
                        break
            else:
                return True
        return False

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            keep = pa.array([can_match((t or "").lower()) for t in batch.column("text").to_pylist()], pa.bool_())
            own = pa.array(range(number, number + batch.num_rows), pa.int64())
            number += batch.num_rows
            yield pa.RecordBatch.from_arrays([own, *batch.columns], names=["row", "doc_id", "text"]).filter(keep)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"row long, doc_id {kind}, text string")


def best_windows(grams: list[str], template: frozenset[str], percent: int, taken: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """(first, last, dice) of the best windows of ``grams``, best first, without overlaps or a part of ``taken``.

    A best window starts and ends with a bigram of the template, and its first
    one doesn't occur again in it: without it the window would be as good.
    """
    size, n = len(template), len(grams)
    hit = np.fromiter((g in template for g in grams), bool, n)
    if (200 - percent) * len(template.intersection(grams)) < percent * size:
        return []
    before, after, seen = np.full(n, -1), np.full(n, n), {}
    for k, g in enumerate(grams):
        if g in seen:
            before[k], after[seen[g]] = seen[g], k
        seen[g] = k
    most = size * (200 - percent) // percent
    found = []
    for i in np.flatnonzero(hit):
        stop, reach = int(after[i]), 2 * most
        while True:
            fresh = before[i:min(stop, i + reach)] < i
            total = np.cumsum(fresh)
            if total[-1] > most or i + reach >= stop:
                break
            reach *= 2
        shared = np.cumsum(fresh & hit[i:i + len(fresh)])
        dice = np.where(total <= most, 2 * shared / (total + size), 0)
        j = int(dice.argmax())
        if 200 * shared[j] >= percent * (total[j] + size) and total[j] <= most:
            found.append((-float(dice[j]), int(i), int(i) + j))
    out = []
    for dice, i, j in sorted(found):
        if all(j < a or b < i for a, b in taken):
            taken = [*taken, (i, j)]
            out.append((i, j, -dice))
    return out


def window_hits(text: str, short: list[tuple[str, frozenset[str]]], longs: list[tuple[str, frozenset[str]]], percent: int) -> list[tuple[int, str, float]]:
    """(unit, license, dice) of the windows of a text; the unit is minus the number of the line on which one starts."""
    words, line = [], []
    bounds = []
    for k, raw in enumerate(text.lower().split("\n"), 1):
        own = re.findall(r"[a-z0-9]+", raw)
        bounds.append((len(words), len(words) + len(own) - 2))
        words += own
        line += [k] * len(own)
    grams = [f"{a} {b}" for a, b in zip(words, words[1:])]

    def fits(lo: int, hi: int, template: frozenset[str]) -> bool:
        own = set(grams[lo:hi + 1])
        return 200 * len(own & template) >= percent * (len(own) + len(template))

    out = []
    for name, template in short:
        if template.isdisjoint(grams) or len(bounds) > 1 and fits(0, len(grams) - 1, template):
            continue
        # lines that match are units of their own
        taken = [(lo, hi) for lo, hi in bounds if hi >= lo and fits(lo, hi, template)]
        out += [(-line[i], name, d) for i, _, d in best_windows(grams, template, percent, taken)]
    for name, template in longs:
        out += [(-line[i], name, d) for i, _, d in best_windows(grams, template, percent, [])]
    return out


def license_hits(docs: DataFrame, templates=TEMPLATES, percent: int = PERCENT, full=None) -> DataFrame:
    """row, doc_id, unit, license, dice of every match; row tells documents with equal or no ids apart.

    A unit is a line (its number from 1), the whole text (0) or a window of the
    whole text's words (minus the number of the line on which it starts). Lines
    and whole texts are compared with ``templates``; windows with these, where
    no unit that matches lies, and with the texts of ``full`` (by default
    :func:`full_texts`).

    Null and empty texts match nothing. All templates that reach the threshold
    are given, ties included; repeated rows repeat their matches. Only lines
    that reach a template's size bound and hold a necessary bigram are scored.
    """
    grams = {name: template_bigrams(text) for name, text in templates}
    needed = list(dict.fromkeys(b for g in grams.values() for b in necessary(g, percent)))
    long_grams = [(name, template_bigrams(text)) for name, text in (full_texts() if full is None else full)]
    texts = cut_lineage(possible(docs, needed, [g for _, g in long_grams], percent)
                        .select("row", "doc_id", F.coalesce("text", F.lit("")).alias("text")))
    short, longs = ([(n, frozenset(g)) for n, g in x] for x in (grams.items(), long_grams))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("row", "doc_id", "text"))
            out = [(r, i, *hit) for r, i, t in zip(*columns) for hit in window_hits(t, short, longs, percent)]
            kinds = (pa.int64(), batch.schema.field("doc_id").type, pa.int32(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)],
                                             ["row", "doc_id", "unit", "license", "dice"])

    id_type = texts.schema["doc_id"].dataType.simpleString()
    inside = texts.mapInArrow(windows, f"row long, doc_id {id_type}, unit int, license string, dice double")
    units = texts.select("row", "doc_id", F.posexplode(F.split("text", "\n")).alias("unit", "raw")) \
        .select("row", "doc_id", (F.col("unit") + 1).alias("unit"), "raw") \
        .union(texts.where(F.contains("text", F.lit("\n"))).select("row", "doc_id", F.lit(0).alias("unit"), "text"))
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower("raw"), "[^a-z0-9]+", " ")), F.lit(" "))
    units = units.select("row", "doc_id", "unit", norm.alias("norm"))
    some: Column = F.lit(False)
    for b in needed:
        some = some | F.contains("norm", F.lit(f" {b} "))
    words = F.split(F.trim("norm"), " ")
    units = units.where(some).select("row", "doc_id", "unit", words.alias("w")).select(
        "row", "doc_id", "unit", F.array_distinct(F.zip_with(
            F.slice("w", 1, F.size("w") - 1), F.slice("w", 2, F.size("w")),
            lambda a, b: F.concat_ws(" ", a, b))).alias("grams"))
    table = F.array(*[F.struct(F.lit(n).alias("license"), F.array(*map(F.lit, g)).alias("t")) for n, g in grams.items()])
    pairs = units.select("row", "doc_id", "unit", "grams", F.explode(table).alias("t")) \
        .select("row", "doc_id", "unit", "grams", "t.license", "t.t")
    a, b = F.size("grams"), F.size("t")
    bounded = pairs.where((a * (200 - percent) >= b * percent) & (b * (200 - percent) >= a * percent))
    scored = bounded.withColumn("shared", F.size(F.array_intersect("grams", "t")))
    return scored.where(200 * F.col("shared") >= percent * (a + b)).select(
        "row", "doc_id", "unit", "license", (2 * F.col("shared") / (a + b)).alias("dice")).union(inside)


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_units (matching units), licenses (comma-joined), best_dice of each document with a match.

    One row for each row of ``docs`` that matches, repeated rows and null ids
    included; for units, nulls, empties and ties see :func:`license_hits`.
    Other columns are ignored; an empty table gives an empty result.
    """
    hits = license_hits(docs)
    return hits.groupBy("row", "doc_id").agg(
        F.countDistinct("unit").alias("n_units"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        F.round(F.max("dice"), 6).alias("best_dice")).drop("row")


def oracle(templates=TEMPLATES, percent: int = PERCENT) -> str:
    """SQL of the lines and whole texts; it has no windows, so it is equal where every notice stands alone on its line."""
    rows = ", ".join(f"('{n}', {template_bigrams(t)!r})" for n, t in templates)
    return f"""
WITH t AS (SELECT * FROM (VALUES {rows}) v(license, g)),
u AS (SELECT doc_id, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS unit, unnest(string_split(coalesce(text, ''), chr(10))) AS raw FROM documents
      UNION ALL SELECT doc_id, 0, text FROM documents WHERE contains(text, chr(10))),
w AS (SELECT doc_id, unit, regexp_extract_all(lower(raw), '[a-z0-9]+') AS w FROM u),
g AS (SELECT doc_id, unit, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN generate_series(1, len(w) - 1)]) AS g FROM w WHERE len(w) > 1),
s AS (SELECT doc_id, unit, license, len(list_intersect(g.g, t.g)) AS o, len(g.g) + len(t.g) AS n FROM g, t
      WHERE len(g.g) * {200 - percent} >= len(t.g) * {percent} AND len(t.g) * {200 - percent} >= len(g.g) * {percent})
SELECT doc_id, count(DISTINCT unit)::BIGINT AS n_units, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses,
       round(max(2.0 * o / n), 6) AS best_dice FROM s WHERE 200 * o >= {percent} * n GROUP BY doc_id
"""
