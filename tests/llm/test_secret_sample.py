"""The tagger's sample: secrets that are rare, or stand in long texts only."""

import random

import pyarrow as pa

from shoplens.llm import secret_scan

from .test_operators import docs_of

PLANTED = "one the passphrase is password 9f3c1b7a2d4e5f6071 of the one"  # no pattern has it


def words(rng, n):
    return [rng.choice(["the", "one", "dehe", "Arin", "is", "of"]) for _ in range(n)]


def secret(rng):
    return "password=" + "".join(rng.choice("0123456789abcdef") for _ in range(18))


def test_secrets_of_long_texts_are_learned(spark):
    rng = random.Random(2)
    rows = []
    for i in range(150):
        w = words(rng, 60 if i % 3 else 6000)
        if i % 3 == 0:
            w.insert(3000, secret(rng))
        rows.append((i, " ".join(w)))
    field = secret_scan.train(docs_of(spark, rows))
    assert field.weights is not None
    assert any(k == 3 for _, k, _ in secret_scan.find_spans(pa.array([PLANTED]), field)[0])
    assert secret_scan.find_spans(pa.array(["one the dehe of Arin is 12 of the one"]), field) == [[]]


def test_rare_secrets_are_in_the_sample(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(words(rng, 30))) for i in range(4000)] + [(None, " ".join(words(rng, 30)))] * 50
    rows += [(9000 + i, " ".join([*words(rng, 30), secret(rng), *words(rng, 30)])) for i in range(4)]
    field = secret_scan.train(docs_of(spark, rows), sample=40)
    assert field.weights is not None


def test_cut_keeps_the_spans():
    text = "x " * 20_000 + "token=abcdef12 " + "y " * 20_000 + "AKIA" + "B" * 20 + " z" * 20_000
    short = secret_scan.cut(text, 5000)
    assert len(short) <= 5000 and [s[1] for s in secret_scan.base_spans(short)] == [0, 1]
    assert secret_scan.cut("x " * 20_000, 5000) == ("x " * 20_000)[:5000] and secret_scan.cut("ab", 5000) == "ab"
