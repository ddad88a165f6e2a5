import itertools
import random

import pyarrow as pa
import pytest

from shoplens.llm import jaccard_join


def brute(rows, k, percent):
    sets, parent = [], list(range(len(rows)))
    for _, text in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\n", " ").split(" ")
        w = [x for x in w if x]
        sets.append({tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(sets[i]), least[root(i)]) for i, (doc, _) in enumerate(rows))


def cases():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    rows, doc = [], 0
    for group in range(6):
        base = rng.choices(words, k=rng.choice([3, 12, 60, 150]))
        for _ in range(rng.choice([1, 2, 12, 30])):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((doc, " ".join(text)))
            doc += 1
    rows += [(doc, None), (doc + 1, ""), (doc + 2, " \n "), (doc + 3, "A b"), (doc + 4, "a B"), (doc + 5, "a b c d")]
    return rows


@pytest.mark.parametrize("large", [64, 2])
def test_components_equal_brute_force(spark, monkeypatch, large):
    monkeypatch.setattr(jaccard_join, "LARGE", large)
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "MORE_HUBS", 1)
    rows = cases()
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, component_id string")
    got = jaccard_join.jaccard_components(docs, 4, 85).collect()
    assert sorted(map(tuple, got)) == brute(rows, 4, 85)


def test_empty_repeated_and_null(spark):
    schema = "doc_id long, text string"
    assert jaccard_join.jaccard_components(spark.createDataFrame([], schema)).count() == 0
    rows = [(7, "one two three four five"), (7, "one two three four five"), (None, "one two three four five"), (9, None)]
    got = {tuple(r) for r in jaccard_join.jaccard_components(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(7, 2, 7), (None, 2, 7), (9, 0, 9)}


def tree(df):
    """(depth, node) of each line of the plan."""
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        node = line.lstrip(" :+-*")
        if node:
            yield len(line) - len(node), node


def test_no_task_holds_two_python_processes(spark, monkeypatch):
    seen = []
    keep = jaccard_join.cut_lineage
    monkeypatch.setattr(jaccard_join, "cut_lineage", lambda df: seen.append(list(tree(df))) or keep(df))
    docs = spark.createDataFrame(cases(), "doc_id long, text string")
    jaccard_join.jaccard_components(docs, 4, 85).collect()
    assert sum("MapInArrow" in node for plan in seen for _, node in plan) >= 4
    for plan in seen:
        open_passes = []  # depths of the passes above, since the last shuffle
        for depth, node in plan:
            open_passes = [d for d in open_passes if d[0] < depth]
            if node.startswith(("MapInArrow", "Exchange")):
                assert not node.startswith("MapInArrow") or not open_passes or not open_passes[-1][1], plan
                open_passes.append((depth, node.startswith("MapInArrow")))


def test_long_texts_come_in_bounded_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 160, 1, 1).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), 20000) as text")

    def bytes_of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    try:
        spark.conf.set(key, str(64 << 20))
        assert jaccard_join.jaccard_components(docs, 4, 85).count() == 160
        assert max(r["n"] for r in docs.mapInArrow(bytes_of, "n long").collect()) < 6 << 20
    finally:
        spark.conf.set(key, before)
