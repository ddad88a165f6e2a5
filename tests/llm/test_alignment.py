"""Alignment of two tokenizers against a plain merge over whole texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from shoplens.llm import alignment

SF = "/root/testdata/sf0.001"
ODD = [(1, None), (2, ""), (3, " "), (3, "  \n\t "), (None, "a b c"), (4, "x " * 3000), (4, "x " * 3000), (5, "é ü ñ 中文 😀 　 ."),
       (6, "a▁b"), (7, "a<|endoftext|> b <s> <0x41> </s>"), (8, "z" * 5000), (9, " lead  and   trail  "), (10, "\x00 nul\x7f x"),
       (11, "ﬁ １２ ½ é"), (12, "tab\tnew\r\nline \x85 \xa0nbsp")]


def plain(texts):
    """Whole texts by the libraries themselves, and a pointer merge per text."""
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    a = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    level = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = {c: chr(c) for c in level} | {c: chr(256 + i) for i, c in enumerate(c for c in range(256) if c not in level)}
    back = {v: k for k, v in chars.items()}
    names = {i: t for t, i in a.get_vocab().items()}
    out, count = [], Counter()
    for t in texts:
        if not t:
            out.append(None)
            continue
        ai = a.encode(" " + t, add_special_tokens=False).ids
        bi = b.encode(t)
        ab = [bytes(back[c] for c in names[i]) for i in ai]
        bb = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in bi]
        if b"".join(ab) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            out.append(None)
            continue
        ae, be = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        links, groups, i, j, gi, gj = [], [], 0, 0, 0, 0
        while i < len(ai):
            links.append((ai[i], bi[j]))
            x, y = ae[i], be[j]
            i, j = i + (x <= y), j + (y <= x)
            if x == y:
                groups.append(",".join(map(str, ai[gi:i])) + "|" + ",".join(map(str, bi[gj:j])))
                gi, gj = i, j
        out.append((len(ai), len(bi), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        count.update(links)
    most = {}
    for (_, y), c in count.items():
        most[y] = max(c, most.get(y, 0))
    return [(0,) * 6 + ("",) if r is None else
            (r[0], r[1], r[2], len(r[3]), sum(count[x] == most[x[1]] for x in r[3]), sum(count[x] for x in r[3]), r[4]) for r in out]


@pytest.mark.parametrize("max_hot", [1 << 20, 500, 0])
def test_alignment_equals_plain_merge(spark, max_hot):
    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()[:120]] + ODD
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n_a long, row string")
    got = sorted((tuple(r) for r in alignment.align_all(docs, max_hot=max_hot).collect()), key=str)
    assert got == sorted(((i, *x) for (i, _), x in zip(rows, plain([t for _, t in rows]))), key=str)


def test_lockstep_and_groups_on_random_cuts():
    rng = random.Random(5)
    for _ in range(50):
        lanes = []
        for _ in range(rng.randrange(6)):
            n = rng.randrange(1, 30)
            lanes.append([sorted({n, *rng.choices(range(1, n + 1), k=rng.randrange(1, 9))}) for _ in "ab"])
        ends, starts, base = ([], []), ([0], [0]), 0
        want_links, want = [], []
        for lane in lanes:
            for side in (0, 1):
                ends[side].extend(base + e for e in lane[side])
                starts[side].append(len(ends[side]))
            for i, e in enumerate(lane[0]):
                for j, f in enumerate(lane[1]):
                    if (lane[0][i - 1] if i else 0) < f and (lane[1][j - 1] if j else 0) < e:
                        want_links.append((starts[0][-2] + i, starts[1][-2] + j))
            base += lane[0][-1]
        a, b = (np.array(x, np.int64) for x in ends)
        la, lb, cut = alignment.lockstep(a, b, np.array(starts[0]), np.array(starts[1]))
        assert sorted(zip(la.tolist(), lb.tolist())) == sorted(want_links)
        assert sorted(a[la[cut]].tolist()) == sorted(set(ends[0]) & set(ends[1]))


def test_empty_table(spark):
    assert alignment.align_all(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_words_that_end_in_spaces_join_with_no_other_word():
    """B has pieces of several spaces: a text's last spaces must not meet the next word of the same call."""
    import public_tokenizers as P
    import pyarrow as pa

    from shoplens.llm.words import WordIds
    a, b = alignment.byte_level(P.path("byte_bpe_50k.tiktoken")), alignment.pieces(P.path("piece_bpe_32k.model"))
    texts = ["end  ", "next word", "    ", "²²²", "a \n  ", "x\t    ", "last é    ", "中文", "  b   ", "end"]
    got = alignment.align(pa.array(texts), WordIds([a.word_ids, b.word_ids]), a, b)
    assert [(*n, d) for n, d in zip(got.numbers.tolist(), got.digests)] == [(*w[:4], w[6]) for w in plain(texts)]
