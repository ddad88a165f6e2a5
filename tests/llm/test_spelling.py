"""Spelling variants against brute force over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from shoplens.llm import spelling


def edit_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows):
    count = Counter()
    for i, t in rows:
        for r in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            r = "".join(c.lower() if "A" <= c <= "Z" else c for c in r)
            h = zlib.crc32(f"{'' if i is None else i}:{r}".encode())
            if h % 31 == 0:
                r = r[:h % len(r)] + r[h % len(r) + 1:]
            if len(r) >= 7:
                count[r] += 1
    n = {w: c for w, c in count.items() if c >= 2}
    near = {w: [v for v in n if edit_one(w, v)] for w in n}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def corpus():
    rng = random.Random(11)
    base = ["".join(rng.choices("abcdehnorst", k=rng.randrange(7, 13))) for _ in range(60)]
    base += ["élégance", "ÀÉÎõüÿ÷×à", "aaaaaaaa", "aaaaaaaaa", "a" * 47, "a" * 48, "a" * 49, "b" + "a" * 48, "a" * 300, "a" * 301,
             "a" * 150 + "b" + "a" * 150]
    words = []
    for w in base:
        words += [w] * rng.choice((3, 30, 200))
        for _ in range(12):
            p, c = rng.randrange(len(w)), rng.choice("abchéz")
            words += [rng.choice((w[:p] + w[p + 1:], w[:p] + c + w[p:], w[:p] + c + w[p + 1:]))] * rng.choice((1, 2, 3, 20))
    words += ["chainword"] * 600 + ["chainwords"] * 40 + ["chainwordsz"] * 3
    words = [w.upper() if rng.random() < .1 and w.isascii() else w for w in words]
    rng.shuffle(words)
    rows = [(i, " ".join(words[k:k + 40])) for i, k in enumerate(range(0, len(words), 40))]
    return rows + [(None, "Straße straße running Running running1running"), (7, rows[7][1]), (7, rows[7][1]), (500, None), (501, ""),
                   (502, "x" * 20_000 + " ñ中文ñ " + "short " * 50)]


@pytest.mark.parametrize("subtree,levels", [(8000, None), (20, None), (30, 2), (8000, 8)])
def test_variants_equal_brute_force(spark, subtree, levels):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n long, word string")
    got = sorted(map(tuple, spelling.variants(docs, subtree, levels).collect()))
    assert got == plain(rows)
    assert any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) for r in got)  # chains of forms


def test_search_equals_all_pairs():
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abé", k=rng.randrange(7, 10))) for _ in range(900)} | {"a" * 48, "a" * 49, "a" * 50})
    side = spelling.Words(pa.array(words))
    for leaf in (1, 16, 5000):
        q, w = spelling.search(side, side, leaf)
        got = sorted(zip(q.tolist(), w.tolist()))
        assert got == [(i, j) for i, x in enumerate(words) for j, y in enumerate(words) if edit_one(x, y)]


def test_reach_is_symmetric_and_complete():
    for levels in (2, 5):
        moves = spelling.reach(levels)
        assert len(set(moves)) == len(moves)
        assert {tuple(-x for x in m) for m in moves} == set(moves)
        assert len(moves) == 3 + 4 * levels + levels * (levels - 1)


def test_crc_of_spans():
    rng = np.random.default_rng(0)
    data = rng.integers(97, 123, 5000).astype(np.uint8)
    starts = np.array([0, 5, 5, 100, 1000, 4999, 3])
    ends = np.array([5, 5, 300, 356, 4000, 5000, 260])
    first = np.array([zlib.crc32(str(i).encode()) for i in range(7)], np.uint32)
    want = [zlib.crc32(data[s:e].tobytes(), int(f)) for s, e, f in zip(starts, ends, first)]
    assert spelling.crc32_spans(data, starts, ends, first).tolist() == want


def test_empty_table(spark):
    out = spelling.variants(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
