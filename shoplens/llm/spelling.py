"""Spelling variants by a frequency-vector trie (operator 13).

A word's vector holds how often each letter group occurs in it. Words that are
one edit apart differ by a surplus of at most one in one group and a deficit
of at most one in one other. A trie over the vectors, one group's count a
level, is searched depth first with a budget of one surplus and one deficit;
the words of the leaves reached are verified.

The trie's top levels (length and the first few groups) are the shuffle key:
each subtree is built and searched in one task. A word is sent to the subtrees
that its budget reaches, of each two subtrees only one way, so that every pair
is found once. How many levels make up the key follows from the largest
subtree, and one that is still too large is dealt out in blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import slices, utf8, word_spans, written

LEAST = 7            # code points of a word
RATIO = 10           # how much more frequent a form is
SUBTREE = 8_000      # words of a subtree that one task searches
KEY_LEVELS = (2, 8)  # least and most groups in a subtree's key
LEAF = 128           # words of a trie node that are looked through without going deeper
WIDE = 48            # code points up to which words are verified as rows of a matrix
PAIRS_AT_ONCE = 1 << 21
# fixed values: letters by how often European texts use them, each a group; accented ones share six groups by code
LETTERS = "etaoinshrdlcumwfgypbvkjxqz"
GROUPS = len(LETTERS) + 6

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_ASCII = np.zeros(256, bool)
_ASCII[0x41:0x5B] = _ASCII[0x61:0x7B] = True
_GROUP = np.array([LETTERS.index(chr(c)) if chr(c) in LETTERS else len(LETTERS) + c % 6 for c in range(256)], np.int64)


def _crc_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


_CRC = _crc_table()


# words ----------------------------------------------------------------------
def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """crc32 of each span, each going on from the crc32 ``first`` of what stands before it."""
    size = ends - starts
    out = np.zeros(len(starts), np.uint32)
    for i in np.flatnonzero(size > 256):
        out[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes(), int(first[i]))
    order = np.argsort(-size, kind="stable")
    order = order[np.searchsorted(-size[order], -256, "left"):]
    if len(order):
        state, at, size = ~first[order], starts[order], size[order]
        left = np.searchsorted(-size, -np.arange(int(size[0])), "left")  # spans longer than t come first
        for t, n in enumerate(left):
            byte = data[at[:n] + t]
            state[:n] = _CRC[(state[:n] ^ byte) & np.uint32(255)] ^ (state[:n] >> np.uint32(8))
        out[order] = ~state
    return out


def count_words(part: pa.RecordBatch, least: int, every: int) -> pa.RecordBatch:
    """(word, n) of a batch of (doc_id, text): its words of at least ``least`` code points."""
    data, offs = utf8(part.column("text"))
    lead = data == 0xC3
    letter = _ASCII[data] | lead
    letter[1:] |= lead[:-1]
    starts, ends, row = word_spans(~letter, offs)
    extra = np.concatenate([[0], np.cumsum(lead)])
    size = ends - starts - (extra[ends] - extra[starts])
    keep = size >= least
    starts, ends, row, size = starts[keep], ends[keep], row[keep], size[keep]
    low = _LOWER[data]
    ids = [zlib.crc32((("" if i is None else str(i)) + ":").encode()) for i in part.column("doc_id").to_pylist()]
    h = crc32_spans(low, starts, ends, np.array(ids, np.uint32)[row])
    cut = h % np.uint32(every) == 0
    changed = []
    for s, e, at in zip(starts[cut].tolist(), ends[cut].tolist(), (h[cut] % size[cut]).tolist()):
        run = low[s:e].tobytes().decode()
        if len(run) > least:
            changed.append(run[:at] + run[at + 1:])
    starts, ends = starts[~cut], ends[~cut]
    upto = np.concatenate([[0], np.cumsum(ends - starts)])
    chars = low[np.repeat(starts - upto[:-1], np.diff(upto)) + np.arange(upto[-1])]
    whole = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(upto), pa.py_buffer(chars)])
    found = pa.chunked_array([whole, pa.array(changed, pa.large_string())]).value_counts()
    return pa.RecordBatch.from_arrays([found.field("values").cast(pa.string()), found.field("counts")], ["word", "n"])


def vocabulary(docs: DataFrame, least: int = LEAST, every: int = 31, twice: int = 2) -> DataFrame:
    """word, n: the words of all documents that occur at least ``twice``."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield count_words(part, least, every)

    return docs.select("doc_id", "text").mapInArrow(rows, "word string, n long") \
        .groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= twice)


# the trie -------------------------------------------------------------------
class Words:
    """Words with their code points (all below 256), group counts and a mask of the counts."""

    def __init__(self, words: pa.Array) -> None:
        data, offs = utf8(words)
        lead = data == 0xC3
        shift = np.concatenate([[0], np.cumsum(lead)])
        points = data.copy()
        points[1:][lead[:-1]] += 0x40
        self.points, self.offs = points[~lead], offs - shift[offs]
        self.size = np.diff(self.offs)
        row = np.repeat(np.arange(len(self.size)), self.size)
        self.counts = np.bincount(row * GROUPS + _GROUP[self.points], minlength=len(self.size) * GROUPS) \
            .reshape(-1, GROUPS).astype(np.int32)
        # a bit for each group that occurs, and one for each that occurs again: an edit changes two bits at most
        bits = np.uint64(1) << np.arange(GROUPS, dtype=np.uint64)
        self.mask = ((self.counts > 0) * bits).sum(1, dtype=np.uint64) \
            | ((self.counts > 1) * bits).sum(1, dtype=np.uint64) << np.uint64(GROUPS)
        self.chars = np.zeros((len(self.size), WIDE + 1), np.uint8)
        within = np.arange(len(row)) - self.offs[row]
        fits = within <= WIDE
        self.chars[row[fits], within[fits]] = self.points[fits]

    def word(self, i: int) -> bytes:
        return self.points[self.offs[i]:self.offs[i + 1]].tobytes()


def one_edit(a: Words, i: np.ndarray, b: Words, j: np.ndarray) -> np.ndarray:
    """Whether a's word i and b's word j differ by exactly one inserted, deleted or replaced code point."""
    out = np.zeros(len(i), bool)
    sizes = a.size[i], b.size[j]
    gap = sizes[0] - sizes[1]
    wide = np.maximum(*sizes) > WIDE
    same = np.flatnonzero((gap == 0) & ~wide)
    out[same] = (a.chars[i[same]] != b.chars[j[same]]).sum(1) == 1
    for at, long, short in ((np.flatnonzero((gap == 1) & ~wide), a.chars[i], b.chars[j]),
                            (np.flatnonzero((gap == -1) & ~wide), b.chars[j], a.chars[i])):
        if len(at):
            x, y = long[at], short[at]
            first = (x != y).argmax(1)                     # the longer one's extra code point, or before
            moved = x[:, 1:] != y[:, :-1]
            last = np.where(moved.any(1), WIDE - 1 - moved[:, ::-1].argmax(1), -1)
            out[at] = last < first
    for k in np.flatnonzero(wide & (np.abs(gap) <= 1)):
        x, y = a.word(i[k]), b.word(j[k])
        if len(x) < len(y):
            x, y = y, x
        p = next((t for t, (c, d) in enumerate(zip(x, y)) if c != d), len(y))
        out[k] = x != y and (x[p + 1:] == y[p:] if len(x) > len(y) else x[p + 1:] == y[p + 1:])
    return out


def search(data: Words, queries: Words, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """All (query, data word) that are one edit apart: depth first, with all queries that reach a node at once."""
    found_q, found_w = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    def look(words: np.ndarray, qs: np.ndarray) -> None:
        step = max(1, PAIRS_AT_ONCE // len(words))
        for k in range(0, len(qs), step):
            part = qs[k:k + step]
            x, y = np.nonzero(np.bitwise_count(queries.mask[part][:, None] ^ data.mask[words][None, :]) <= 2)
            near = np.abs(queries.counts[part[x]] - data.counts[words[y]]).sum(1) <= 2
            q, w = part[x[near]], words[y[near]]
            ok = one_edit(queries, q, data, w)
            found_q.append(q[ok])
            found_w.append(w[ok])

    def node(level: int, words: np.ndarray, qs: np.ndarray, surplus: np.ndarray, deficit: np.ndarray) -> None:
        while level < GROUPS and len(words) > leaf and len(qs):
            counts = data.counts[words, level]
            values = np.unique(counts)
            gap = queries.counts[qs, level]
            level += 1
            if len(values) > 1:
                for v in values:
                    d = gap - v
                    ok = (d == 0) | (d == 1) & ~surplus | (d == -1) & ~deficit
                    node(level, words[counts == v], qs[ok], surplus[ok] | (d[ok] == 1), deficit[ok] | (d[ok] == -1))
                return
            d = gap - values[0]
            ok = (d == 0) | (d == 1) & ~surplus | (d == -1) & ~deficit
            qs, surplus, deficit = qs[ok], surplus[ok] | (d[ok] == 1), deficit[ok] | (d[ok] == -1)
        if len(words) and len(qs):
            look(words, qs)

    n, m = len(data.size), len(queries.size)
    node(0, np.arange(n), np.arange(m), np.zeros(m, bool), np.zeros(m, bool))
    return np.concatenate(found_q), np.concatenate(found_w)


def near_in_subtree(table: pa.Table) -> pa.Table:
    """word, n_near, best_n, best: the near words found in one subtree, for both words of each pair."""
    out = {"word": [], "n_near": [], "best_n": [], "best": []}
    table = table.combine_chunks()
    is_data = table["data"].to_numpy()
    sides = [table.filter(pa.array(m)) for m in (is_data, ~is_data)]
    if sides[0].num_rows and sides[1].num_rows:
        words = [s["word"].combine_chunks() for s in sides]
        w, q = Words(words[0]), Words(words[1])
        qi, wi = search(w, q)
        everything = pa.concat_arrays(words)
        order = pc.array_sort_indices(everything).to_numpy()
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        n = np.concatenate([s["n"].to_numpy() for s in sides])
        qi = qi + len(words[0])
        # inside a subtree each word is a query too: a pair counts from its first word
        own = np.concatenate([s["own"].to_numpy() for s in sides])
        once = ~own[qi] | (rank[qi] < rank[wi])
        a, b = np.concatenate([qi[once], wi[once]]), np.concatenate([wi[once], qi[once]])
        if len(a):
            by = np.lexsort((rank[b], -n[b], a))
            a, b = a[by], b[by]
            first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            out = {"word": everything.take(pa.array(a[first])), "n_near": np.diff(np.append(first, len(a))),
                   "best_n": n[b[first]], "best": everything.take(pa.array(b[first]))}
    return pa.table({"word": pa.array(out["word"], pa.string()), "n_near": pa.array(out["n_near"], pa.int64()),
                     "best_n": pa.array(out["best_n"], pa.int64()), "best": pa.array(out["best"], pa.string())})


# subtrees -------------------------------------------------------------------
def _group_count(g: int) -> Column:
    return F.length("word") - F.length(F.replace("word", F.lit(LETTERS[g]), F.lit("")))


def key_levels(words: DataFrame, subtree: int) -> int:
    """The least number of groups in the key with which no subtree exceeds ``subtree`` words, or the most allowed."""
    least, most = KEY_LEVELS
    names = ["size", *[f"c{g}" for g in range(most)]]
    vectors = words.select(F.length("word").alias("size"), *[_group_count(g).alias(f"c{g}") for g in range(most)])
    cells = vectors.rollup(*names).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    for r in sorted(cells.groupBy("g").agg(F.max("n").alias("n")).collect(), key=lambda r: -r["g"]):
        level = most - int(r["g"]).bit_length()  # the last columns are the ones rolled up
        if least <= level and r["n"] <= subtree:
            return level
    return most


def _key(size: Column, counts: list[Column]) -> Column:
    return F.concat_ws(",", size.cast("string"), *[c.cast("string") for c in counts])


def reach(levels: int) -> list[tuple[int, ...]]:
    """(change of length, changes of the groups) within one surplus and one deficit."""
    out = []
    for up in range(-1, levels):
        for down in range(-1, levels):
            if up != down or up < 0:
                move = [0] * levels
                if up >= 0:
                    move[up] += 1
                if down >= 0:
                    move[down] -= 1
                # what the key's groups leave of the budget may be spent on other groups
                out += [(g, *move) for g in sorted({u - d for u in ((1,) if up >= 0 else (0, 1))
                                                    for d in ((1,) if down >= 0 else (0, 1))})]
    return out


def near_words(words: DataFrame, subtree: int = SUBTREE, levels: int | None = None) -> DataFrame:
    """word, n_near, best_n, best of each word of (word, n) that has a near word."""
    levels = key_levels(words, subtree) if levels is None else levels
    keyed = words.select("word", "n", F.length("word").alias("size"), F.array(*[_group_count(g) for g in range(levels)]).alias("c"))
    keyed = keyed.withColumn("key", _key(F.col("size"), [F.col("c")[g] for g in range(levels)]))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count("*") / subtree).cast("int").alias("blocks"))
    moves = F.array(*[F.struct(*[F.lit(d).alias(f"d{k}") for k, d in enumerate(m)]) for m in reach(levels)])
    moved = keyed.withColumn("m", F.explode(moves)).select(
        "word", "n", F.col("key").alias("home"),
        _key(F.col("size") + F.col("m.d0"), [F.col("c")[g] + F.col(f"m.d{g + 1}") for g in range(levels)]).alias("key"))
    queries = moved.where("key >= home").join(sizes, "key") \
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))) \
        .select("key", "block", "word", "n", F.lit(False).alias("data"), (F.col("key") == F.col("home")).alias("own"))
    data = keyed.join(sizes, "key").select(
        "key", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block"), "word", "n",
        F.lit(True).alias("data"), F.lit(False).alias("own"))
    found = data.union(queries).groupBy("key", "block").applyInArrow(
        near_in_subtree, "word string, n_near long, best_n long, best string")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"),
                                     F.min(F.struct((-F.col("best_n")).alias("m"), F.col("best").alias("w"))).alias("b")) \
        .select("word", "n_near", (-F.col("b.m")).alias("best_n"), F.col("b.w").alias("best"))


def roots(links: DataFrame) -> DataFrame:
    """word, root of each word of (word, form): the last of its chain of forms, by jumps of doubled length.

    A form is at least ten times as frequent, so chains are short and end.
    """
    out = written(links.select("word", F.col("form").alias("root")))
    while True:
        step = out.select(F.col("word").alias("root"), F.col("root").alias("next")) \
            .join(out.select("root").distinct(), "root", "left_semi")
        if step.isEmpty():
            return out
        out = written(out.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")))


def variants(docs: DataFrame, subtree: int = SUBTREE, levels: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word.

    Null and empty texts have no words; a null doc_id counts as an empty one in
    the hash that decides on deletions; repeated rows count each time; of near
    words with equal n the first by code points is the form; very long words
    are words like all others; other columns are ignored; an empty table gives
    an empty result. ``levels`` fixes the subtrees' key, for tests.
    """
    words = written(vocabulary(docs))
    near = written(near_words(words, subtree, levels))
    out = words.join(near, "word", "left")
    has = F.col("best_n") >= RATIO * F.col("n")
    out = out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                     F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"))
    chain = roots(out.where("form is not null").select("word", "form"))
    return out.join(chain, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = """
WITH RECURSIVE
crc AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
          lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256) r(i))),
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS r FROM documents),
low AS (SELECT doc_id, translate(r, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r, count(*) AS c
        FROM runs WHERE length(r) >= 7 GROUP BY ALL),
bytes AS (SELECT r, c, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || r, ''), lambda x:
            CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END)) AS b FROM low),
hashed AS (SELECT r, c, xor(list_reduce(list_prepend(4294967295::BIGINT, b),
             lambda s, x: xor(s // 256, t[xor(s, x) % 256 + 1])), 4294967295) AS h FROM bytes, crc),
results AS (SELECT CASE WHEN h % 31 = 0 THEN substr(r, 1, (h % length(r))::INT) || substr(r, (h % length(r))::INT + 2) ELSE r END AS word, c FROM hashed),
vocab AS (SELECT word, sum(c)::BIGINT AS n FROM results WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
cut AS (SELECT word, i, substr(word, 1, i::INT - 1) || substr(word, i::INT + 1) AS d FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM vocab)),
pairs AS (SELECT a.word, b.word AS near FROM cut a JOIN cut b ON a.d = b.d AND a.i = b.i AND a.word <> b.word
          UNION SELECT cut.word, v.word FROM cut JOIN vocab v ON cut.d = v.word
          UNION SELECT v.word, cut.word FROM cut JOIN vocab v ON cut.d = v.word),
best AS (SELECT p.word, count(*) AS n_near, first(p.near ORDER BY v.n DESC, p.near) AS near, max(v.n) AS near_n
         FROM pairs p JOIN vocab v ON v.word = p.near GROUP BY p.word),
forms AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form,
                 CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n FROM vocab v LEFT JOIN best b ON b.word = v.word),
chain AS (SELECT word, word AS at FROM forms UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL),
ends AS (SELECT c.word, c.at AS root FROM chain c JOIN forms f ON f.word = c.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
