"""Cross-tokenizer alignment by lockstep vectorised merging (operator 11).

The token ends of two tokenizers are merged like two sorted lists: whichever
token ends first moves on, each visited pair of tokens is a link, and where
both end is a cut. One numpy state vector holds the pointers of all documents
of a batch (a long document at several word starts, where both tokenizers cut)
and moves them together, a link each a step; finished ones are compacted away.

Links are counted over the corpus by id pair. The pairs that are counted most,
a bounded number, are looked up in every task; the links of all other pairs,
rare by choice, are joined with their counts.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.common import slices, utf8, written
from shoplens.llm.words import CALL_BYTES, Ids, WordIds, byte_bpe

SCAN_BYTES = 1 << 20   # text expanded at a time
LANE_BYTES = 512       # a pointer pair's share of a document, up to the next word start
MAX_HOT = 1 << 20      # id pairs that every task looks up: 20 bytes each


# tokens ---------------------------------------------------------------------
@dataclass
class Vocabulary:
    encode: Callable[[list[str]], list[list[int]]]  # ids of texts that start with a space
    token: list[bytes]                              # bytes of each id

    def __post_init__(self) -> None:
        self.size = np.array([len(t) for t in self.token], np.int64)
        self.chars = np.frombuffer(b"".join(self.token), np.uint8)
        self.at = np.concatenate([[0], np.cumsum(self.size)])[:-1]

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        upto = np.cumsum(size)
        return self.chars[np.repeat(self.at[ids] - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)]

    def word_ids(self, words: list[str], sizes: np.ndarray) -> Ids:
        """Ids of words, by calls with many words at a time: neither vocabulary joins across a word's start
        unless the word before it ends in a space (pieces of several spaces), so a call ends there.

        A word has none where their bytes aren't its own.
        """
        ends = np.cumsum(sizes, dtype=np.int64)
        first = np.searchsorted(ends, np.arange(0, ends[-1], CALL_BYTES), "right")
        spaced = np.flatnonzero(np.fromiter((w.endswith(" ") for w in words), bool, len(words))) + 1
        first = np.union1d(np.union1d(first, spaced), [len(words)])
        texts = ["".join(words[i:j]) for i, j in zip(first.tolist(), first[1:].tolist())]
        got_ids, got_ends, base = [], [], 0
        for text, ids, i, j in zip(texts, self.encode(texts), first.tolist(), first[1:].tolist()):
            ids = np.array(ids, np.uint32)
            raw = np.frombuffer(text.encode(), np.uint8)
            upto = np.cumsum(self.size[ids])
            own_ends = ends[i:j] - (ends[i - 1] if i else 0)
            at = np.searchsorted(upto, own_ends)
            if not (len(upto) and upto[-1] == len(raw) and (upto[at] == own_ends).all() and (self.bytes_of(ids) == raw).all()):
                own = self.encode(words[i:j])
                own = [x if b"".join([self.token[t] for t in x]) == w.encode() else [] for x, w in zip(own, words[i:j])]
                ids = np.fromiter((t for x in own for t in x), np.uint32)
                at = np.cumsum([len(x) for x in own]) - 1
            got_ids.append(ids)
            got_ends.append(at + 1 + base)
            base += len(ids)
        return np.concatenate(got_ids), np.concatenate(got_ends)


def byte_level(ranks: str) -> Vocabulary:
    """A: byte-level BPE; ``ranks`` lists every entry's bytes."""
    with open(ranks, "rb") as f:
        table = {int(b): base64.b64decode(a) for a, b in map(bytes.split, f)}
    encode = byte_bpe(ranks)
    return Vocabulary(lambda texts: [encode(t) for t in texts], [table.get(i, b"") for i in range(max(table) + 1)])


def pieces(model: str) -> Vocabulary:
    """B: a piece vocabulary with byte fallback, which adds the first space itself."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    names = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    if any("▁" in name.lstrip("▁") for name in names):
        raise ValueError("pieces that join words can't be read word by word")
    token = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()
             for i, p in enumerate(names)]
    return Vocabulary(lambda texts: sp.encode([t[1:] for t in texts], num_threads=1), token)


# merging --------------------------------------------------------------------
def lockstep(a_end: np.ndarray, b_end: np.ndarray, a_lane: np.ndarray, b_lane: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (A index, B index) and which of them end in a cut, of all lanes, step by step.

    ``a_end`` and ``b_end`` are the tokens' byte ends. Lane i holds the A tokens
    a_lane[i] to a_lane[i + 1] - 1 and the B tokens likewise, both over the
    same bytes.
    """
    a, b, stop = a_lane[:-1].copy(), b_lane[:-1].copy(), a_lane[1:]
    alive = a < stop
    a, b, stop = a[alive], b[alive], stop[alive]
    links_a, links_b, cuts = [a[:0]], [b[:0]], [np.zeros(0, bool)]
    while len(a):
        ea, eb = a_end[a], b_end[b]
        links_a.append(a)
        links_b.append(b)
        cuts.append(ea == eb)
        a, b = a + (ea <= eb), b + (eb <= ea)
        alive = a < stop
        if not alive.all():
            a, b, stop = a[alive], b[alive], stop[alive]
    return np.concatenate(links_a), np.concatenate(links_b), np.concatenate(cuts)


_WIDTH = 6
_ID_CHARS = np.zeros((10 ** (_WIDTH - 1), _WIDTH), np.uint8)  # decimal ids, set to the right, and a place for the separator
_ID_CHARS[:, :-1] = np.arange(len(_ID_CHARS))[:, None] // 10 ** np.arange(_WIDTH - 2, -1, -1) % 10 + 48
_ID_SIZE = np.searchsorted(10 ** np.arange(1, _WIDTH - 1), np.arange(len(_ID_CHARS)), "right") + 1
_ID_SHOWN = np.arange(_WIDTH)[None, :] >= _WIDTH - 1 - np.arange(_WIDTH)[:, None]  # by number of digits


def group_bytes(a_ids: np.ndarray, b_ids: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``a1,a2|b1;a3|b2;`` of all tokens, and the end in it of every group.

    ``a_cut`` and ``b_cut`` mark the last token of each group; ids have at most five digits.
    """
    n = len(a_ids) + len(b_ids)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    a_last, b_last = np.flatnonzero(a_cut), np.flatnonzero(b_cut)
    a_per, b_per = np.diff(a_last, prepend=-1), np.diff(b_last, prepend=-1)
    is_a = np.repeat(np.tile([True, False], len(a_per)), np.stack([a_per, b_per], 1).ravel())
    ids = np.empty(n, np.int64)
    ids[is_a], ids[~is_a] = a_ids, b_ids
    b_at = a_last + b_last + 1  # the last token of each group
    chars = _ID_CHARS[ids]
    chars[:, -1] = ord(",")
    chars[b_at, -1] = ord(";")
    chars[b_at - b_per, -1] = ord("|")
    size = _ID_SIZE[ids]
    return chars[_ID_SHOWN[size]], np.cumsum(size + 1)[b_at]


@dataclass
class Aligned:
    """Of each row: sizes, the digest, and its distinct id pairs with their numbers of links."""
    numbers: np.ndarray      # (rows, 4): n_a, n_b, n_groups, n_links
    digests: list[str]
    pairs: np.ndarray        # A id * size of B's vocabulary + B id, by row
    links: np.ndarray
    offs: np.ndarray         # rows + 1


_PAIR_SPACE = 1 << 40  # id pairs are below this


def align(column: pa.Array, words: WordIds, a: Vocabulary, b: Vocabulary) -> Aligned:
    """Align all texts of a column; ``words`` holds the words of ``a`` and ``b``."""
    column = column.cast(pa.large_string())
    full = pc.fill_null(pc.greater(pc.binary_length(column), 0), False)
    n, space, none = len(column), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    while True:
        data, offs = utf8(pc.if_else(full, pc.binary_join_element_wise(space, column, none), none))
        (a_ids, a_words, a_rows), (b_ids, b_words, b_rows) = words.encode(data, offs)
        a_upto, b_upto = (np.concatenate([[0], np.cumsum(v.size[ids])]) for v, ids in ((a, a_ids), (b, b_ids)))
        same = (np.diff(a_upto[a_rows]) == np.diff(offs)) & (np.diff(b_upto[b_rows]) == np.diff(offs))
        if same.all():
            break
        full = pc.and_(full, pa.array(same))  # rows whose bytes aren't the text's have no tokens
    if len(a_ids):  # lanes start at rows, and at the first word after so many bytes
        start = a_upto[a_words[:-1]]
        new = np.zeros(len(start), bool)
        new[np.searchsorted(a_words, a_rows[:-1][np.diff(a_rows) > 0])] = True
        new[1:] |= start[1:] // LANE_BYTES != start[:-1] // LANE_BYTES
        lanes = np.concatenate([np.flatnonzero(new), [len(start)]])
        la, lb, cut = lockstep(a_upto[1:], b_upto[1:], a_words[lanes], b_words[lanes])
    else:
        la, lb, cut = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    a_cut, b_cut = np.zeros(len(a_ids), bool), np.zeros(len(b_ids), bool)
    a_cut[la[cut]] = b_cut[lb[cut]] = True
    text, ends = group_bytes(a_ids, b_ids, a_cut, b_cut)
    groups = np.concatenate([[0], np.cumsum(a_cut)])[a_rows]
    at = np.concatenate([[0], ends])[groups]
    digests = [hashlib.sha256(text[s:e - 1]).hexdigest() if e > s else "" for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
    row = np.searchsorted(a_rows[1:], la, "right")
    key, links = np.unique(row * _PAIR_SPACE + a_ids[la].astype(np.int64) * len(b.token) + b_ids[lb], return_counts=True)
    rows = key // _PAIR_SPACE
    return Aligned(np.stack([np.diff(a_rows), np.diff(b_rows), np.diff(groups), np.bincount(row, minlength=n)], 1),
                   digests, key - rows * _PAIR_SPACE, links, np.searchsorted(rows, np.arange(n + 1)))


# corpus ---------------------------------------------------------------------
def aligned_rows(docs: DataFrame, ranks: str, model: str) -> DataFrame:
    """doc_id, row (a number of its own), the four sizes, groups_sha256, and the distinct id pairs with their links."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        number, a = TaskContext.get().partitionId() << 40, None
        for part in slices(batches, max_bytes=SCAN_BYTES):
            if a is None:
                a, b = byte_level(ranks), pieces(model)
                words = WordIds([a.word_ids, b.word_ids])
            got = align(part.column("text"), words, a, b)
            offs = pa.array(got.offs.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.arange(number, number + part.num_rows)),
                 *[pa.array(np.ascontiguousarray(c)) for c in got.numbers.T], pa.array(got.digests, pa.string()),
                 pa.ListArray.from_arrays(offs, pa.array(got.pairs)), pa.ListArray.from_arrays(offs, pa.array(got.links))],
                names=["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "links"])
            number += part.num_rows

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        rows, f"doc_id {kind}, row long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
              "pairs array<long>, links array<long>")


def pair_counts(rows: DataFrame, b_size: int) -> DataFrame:
    """pair, count (links of the whole corpus), best (no pair of its B id has more), bits (length of the count in binary)."""
    counts = written(rows.select(F.expr("inline(arrays_zip(pairs, links)) as (pair, n)"))
                         .groupBy("pair").agg(F.sum("n").alias("count")))
    most = counts.groupBy((F.col("pair") % b_size).alias("b")).agg(F.max("count").alias("most"))
    return counts.withColumn("b", F.col("pair") % b_size).join(most, "b") \
        .select("pair", "count", (F.col("count") == F.col("most")).alias("best"), F.length(F.bin("count")).alias("bits"))


def count_links(rows: DataFrame, b_size: int, max_hot: int = MAX_HOT) -> DataFrame:
    """``rows`` without pairs and links, with n_best and count_sum."""
    counts = written(pair_counts(rows, b_size))
    least, total = 65, 0
    sizes = counts.groupBy("bits").count().collect()  # at most 64 rows
    for r in sorted(sizes, key=lambda r: -r["bits"]):
        total += r["count"]
        if total > max_hot:
            break
        least = r["bits"]
    hot = counts.where(F.col("bits") >= least).select("pair", "count", "best").toArrow()  # at most max_hot rows
    order = np.argsort(hot["pair"].to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast(tuple(hot[c].to_numpy()[order] for c in ("pair", "count", "best")))
    rest = any(r["bits"] < least for r in sizes)
    kept = ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, count, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            mine, links = lists.flatten().to_numpy(), batch.column("links").flatten().to_numpy()
            offs = lists.offsets.to_numpy().astype(np.int64)
            offs = offs - offs[0]
            at = np.minimum(np.searchsorted(pair, mine), max(len(pair) - 1, 0))
            found = pair[at] == mine if len(pair) else np.zeros(len(mine), bool)
            at = at[found]
            out = [batch.column(c) for c in kept]
            for value in (best[at] * links[found], count[at] * links[found]):
                per = np.zeros(len(mine), np.int64)
                per[found] = value
                out.append(pa.array(np.diff(np.concatenate([[0], np.cumsum(per)])[offs])))
            left = pa.array(np.concatenate([[0], np.cumsum(~found)])[offs].astype(np.int32))
            out += [pa.ListArray.from_arrays(left, pa.array(x[~found])) for x in (mine, links)]
            yield pa.RecordBatch.from_arrays(out, names=[*kept, "n_best", "count_sum", "pairs", "links"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*kept).schema.fields)
    looked = rows.mapInArrow(look, fields + ", n_best long, count_sum long, pairs array<long>, links array<long>")
    if not rest:
        return looked.drop("pairs", "links")
    looked = written(looked)
    rare = looked.select("row", F.expr("inline(arrays_zip(pairs, links)) as (pair, n)")) \
        .join(counts.where(F.col("bits") < least), "pair").groupBy("row").agg(
            F.sum(F.col("n") * F.col("count")).alias("more"), F.sum(F.col("n") * F.col("best").cast("long")).alias("more_best"))
    return looked.join(rare, "row", "left").select(
        *kept, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more", F.lit(0))).alias("count_sum"))


def align_all(docs: DataFrame, ranks: str | None = None, model: str | None = None, max_hot: int = MAX_HOT) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row of ``docs``.

    Null and empty texts, and texts whose tokens' bytes aren't a space and the
    text (a literal U+2581, say), have zeros and an empty digest. Repeated rows
    and null ids are rows of their own, and each counts in the corpus-wide
    numbers; ties for a B id's highest count are all best; other columns are
    ignored; an empty table gives an empty result. ``ranks`` and ``model`` are
    paths of the vocabularies A (byte-level, as ranks) and B (pieces).
    """
    import public_tokenizers as P
    ranks, model = ranks or P.path("byte_bpe_50k.tiktoken"), model or P.path("piece_bpe_32k.model")
    rows = written(aligned_rows(docs, ranks, model))
    return count_links(rows, len(pieces(model).token), max_hot) \
        .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
