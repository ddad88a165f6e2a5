"""Licenses in windows of words: wrapped notices, notices in longer lines, full texts; against all windows."""

import random
import textwrap

from shoplens.llm import license_scan as L

from .test_operators import docs_of


def test_wrapped_embedded_and_full_texts(spark):
    full = dict(L.full_texts())
    mit_notice = dict(L.TEMPLATES)["mit"]
    filler = "def scan(a, b): return a + b  # nothing to see on this line at all, it is only code\n" * 4
    rows = [(1, filler + textwrap.fill(mit_notice, 60, initial_indent=" * ", subsequent_indent=" * ") + "\n" + filler),
            (2, "This file was written by A and B in the year 2001 and is licensed under CC BY 4.0. See the site for more about it."),
            (3, "MIT License\n\nCopyright (c) 2020 A B\n\n" + textwrap.fill(full["mit"], 72) + "\n"),
            (4, filler + textwrap.fill(full["bsd-3-clause"], 72) + "\n" + filler), (5, full["apache-2.0"] + filler), (6, filler),
            (7, "Released under the MIT License.\n" + filler + "and this too is released under\nthe MIT License. " + filler),
            (None, None), (8, "")]
    got = {r["doc_id"]: r for r in L.license_scan(docs_of(spark, rows)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 7}
    assert "mit" in got[1]["licenses"].split(",") and got[2]["licenses"] == "cc-by-4.0"
    assert "mit" in got[3]["licenses"].split(",") and got[3]["best_dice"] == 1
    assert {"bsd", "bsd-3-clause"} <= set(got[4]["licenses"].split(",")) and got[4]["best_dice"] == 1
    assert "apache-2.0" in got[5]["licenses"].split(",")
    assert got[7]["licenses"] == "mit-line" and got[7]["n_units"] == 2


def test_best_window_equals_all_windows():
    rng = random.Random(8)
    for _ in range(300):
        template = frozenset(rng.sample("abcdefghij", rng.choice([2, 4, 6])))
        grams = rng.choices("abcdefghijklm", k=rng.randrange(1, 30))
        best = 0
        for i in range(len(grams)):
            for j in range(i, len(grams)):
                own = set(grams[i:j + 1])
                if 200 * len(own & template) >= 60 * (len(own) + len(template)):
                    best = max(best, 2 * len(own & template) / (len(own) + len(template)))
        got = L.best_windows(grams, template, 60, [])
        assert (got[0][2] if got else 0) == best


def plain_hits(text, templates, longs, percent):
    """Every line, the whole text, and every window of words, without any pruning: what matches at all."""
    def score(words, t):
        own = {f"{a} {b}" for a, b in zip(words, words[1:])}
        return 2 * len(own & t) / (len(own) + len(t)) if own else 0

    def words_of(x):
        return L.re.findall("[a-z0-9]+", x.lower())

    found = set()
    for name, t in [*templates.items(), *longs.items()]:
        units = [words_of(x) for x in text.split("\n")] + [words_of(text)] if name in templates else []
        all_words = words_of(text)
        units += [all_words[i:j] for i in range(len(all_words)) for j in range(i + 2, len(all_words) + 1)]
        if any(score(u, t) * 100 >= percent for u in units):
            found.add(name)
    return found


def test_scan_equals_all_units_and_windows(spark):
    rng = random.Random(3)
    vocab = "red fox jumps over a lazy dog while the cat sleeps in warm sun today".split()
    templates = (("t1", "red fox jumps over a lazy dog"), ("t2", "the cat sleeps in warm sun"))
    longs = (("f1", "over a lazy dog while the cat sleeps today in red sun"),)
    rows = []
    for i in range(60):
        parts = [rng.choice([t for _, t in (*templates, *longs)]).split() if rng.random() < .3 else rng.choices(vocab, k=4) for _ in range(4)]
        words = [w for p in parts for w in p if rng.random() > .05]
        rows.append((i, " ".join(w + rng.choice(("", "", ",", "\n")) for w in words)))
    grams = {n: frozenset(L.template_bigrams(t)) for n, t in templates}
    long_grams = {n: frozenset(L.template_bigrams(t)) for n, t in longs}
    got = {}
    for r in L.license_hits(docs_of(spark, rows), templates, 80, longs).collect():
        got.setdefault(r["doc_id"], set()).add(r["license"])
    assert got == {i: found for i, t in rows if (found := plain_hits(t, grams, long_grams, 80))}


def test_repeated_and_null_ids_are_documents_of_their_own(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [(1, mit), (None, mit), (None, apache), (1, apache), (1, mit), (2, "x"), (3, None)]
    got = sorted(((r["doc_id"], r["licenses"], r["n_units"]) for r in L.license_scan(docs_of(spark, rows)).collect()), key=str)
    assert got == sorted([(1, "mit-line", 1), (1, "mit-line", 1), (1, "apache-2.0", 1), (None, "mit-line", 1), (None, "apache-2.0", 1)], key=str)
    extra = docs_of(spark, rows).selectExpr("doc_id", "text", "1 as row", "'x' as unit", "'y' as license")
    assert L.license_scan(extra).count() == 5
