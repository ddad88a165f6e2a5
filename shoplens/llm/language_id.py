"""Language ID by cross-parsing entropy (operator 9).

For each language a suffix automaton of a bounded reference text (labelled
documents in hash order) gives longest matches. A text is cut greedily into
phrases, each the longest that occurs in the reference; the language that
needs the fewest phrases, normalised by log2 of its reference length and the
text's length, wins. Texts are folded to letters and single separators and
parsed in pieces of ``PIECE`` bytes, all pieces of a batch at the same time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.llm.common import held_out, slices, utf8

PIECE = 2048
_FOLD = np.zeros(256, np.uint8)
_FOLD[0x61:0x7B] = _FOLD[0x41:0x5B] = np.arange(1, 27)
_FOLD[0x80:] = np.arange(27, 155)


def fold(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols (0 separator, 1-26 letters, then high bytes) with runs of separators as one."""
    data = data.copy()
    upper = np.flatnonzero((data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[:-1] == 0xC3) & (data[1:] != 0x97)) + 1
    data[upper] += 0x20  # accented capitals of the two-byte Latin block
    sym = _FOLD[data]
    keep = sym != 0
    keep[1:] |= sym[:-1] != 0
    cut = offs[offs < len(sym)]
    keep[cut] = sym[cut] != 0
    return sym[keep], np.concatenate([[0], np.cumsum(keep)])[offs]


class Automaton:
    """Suffix automaton of one reference as a table: next state and whether a phrase ended."""

    def __init__(self, text: np.ndarray, symbols: int) -> None:
        nxt: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text.tolist():
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        table = np.full((len(nxt), symbols), -1, np.int32)
        for s, moves in enumerate(nxt):
            if moves:
                table[s, list(moves)] = list(moves.values())
        root = np.maximum(table[0], 0)
        ends = table < 0
        ends[0] &= False
        ends[0] |= table[0] < 0  # a symbol that the reference lacks is a phrase by itself
        self.table = (np.where(table < 0, root, table).astype(np.int64) * symbols * 2 + ends).astype(np.int32)


def phrases(automata: list[Automaton], sym: np.ndarray, offs: np.ndarray, symbols: int) -> np.ndarray:
    """(rows, languages): phrases of each row's pieces, vectorised over pieces and languages."""
    lens = np.diff(offs)
    per = -(-lens // PIECE)
    row = np.repeat(np.arange(len(lens)), per)
    start = offs[row] + (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * PIECE
    size = np.minimum(PIECE, offs[row + 1] - start)
    order = np.argsort(-size, kind="stable")
    row, start, size = row[order], start[order], size[order]
    counts = np.zeros((len(automata), len(row)), np.int64)
    base = np.cumsum([0] + [a.table.size for a in automata])
    flat = np.concatenate([a.table.ravel() for a in automata]) if len(automata) > 1 else automata[0].table.ravel()
    state = np.zeros(counts.shape, np.int64)
    shift = base[:-1, None]
    active = np.searchsorted(-size, -np.arange(PIECE), "left")  # pieces longer than t
    for t in range(int(size[0]) if len(size) else 0):
        n = active[t]
        got = flat[state[:, :n] + (shift + sym[start[:n] + t])]
        counts[:, :n] += got & 1
        state[:, :n] = got >> 1
    counts += state != 0  # the open phrase at a piece's end
    out = np.zeros((len(lens), len(automata)), np.int64)
    np.add.at(out, row, counts.T)
    return out


class Model:
    """Reference texts by language; the automata are built once in each Python worker."""

    _built: dict[int, tuple] = {}

    def __init__(self, texts: dict[str, str]) -> None:
        self.texts = dict(sorted(texts.items()))
        self.names = list(self.texts)

    def _automata(self):
        key = hash(tuple(self.texts.items()))
        if key not in Model._built:
            refs = [fold(*utf8(pa.array([x])))[0] for x in self.texts.values()]
            used = np.unique(np.concatenate(refs)) if refs else np.zeros(0, np.uint8)
            code = np.full(256, len(used), np.uint8)  # the last symbol stands for all that no reference has
            code[used] = np.arange(len(used))
            Model._built.clear()
            Model._built[key] = ([Automaton(code[r], len(used) + 1) for r in refs], code, len(used) + 1,
                                 np.array([np.log2(len(r) + 2) for r in refs]))
        return Model._built[key]

    def predict(self, column: pa.Array) -> tuple[list[str], np.ndarray]:
        data, offs = utf8(column)
        n = len(offs) - 1
        if not self.names or not n:
            return ["und"] * n, np.zeros(n)
        automata, code, symbols, logs = self._automata()
        sym, at = fold(data, offs)
        ascii_letter = np.zeros(len(sym) + 1, np.int64)
        np.cumsum((sym > 0) & (sym < 27), out=ascii_letter[1:])
        letters = ascii_letter[at[1:]] > ascii_letter[at[:-1]]
        for i in np.flatnonzero(~letters & (np.diff(at) > 0)):
            letters[i] = any(ch.isalpha() for ch in column[int(i)].as_py())
        cost = phrases(automata, code[sym], at, symbols) * logs / np.maximum(np.diff(at), 1)[:, None]
        best = cost.argmin(1)
        rank = np.sort(cost, 1)
        second = rank[:, 1] if len(self.names) > 1 else rank[:, 0] * 0 + np.inf
        with np.errstate(invalid="ignore"):
            score = np.where(np.isinf(second), 1.0, second / np.maximum(rank[:, 0] + second, 1e-12))
        return ([self.names[b] if ok else "und" for b, ok in zip(best, letters)],
                np.where(letters, np.clip(score, 0, 1), 0.0))


def train(docs: DataFrame, ref_docs: int = 60, ref_chars: int = 24_000, max_langs: int = 64) -> Model:
    """Reference texts from rows with text, lang and an id that isn't held out.

    The bounds: the ``max_langs`` languages with most such documents (ties by
    name); of each ``ref_docs`` documents, first by hash of the id, of which
    ``ref_chars`` characters in all are kept (24 KB a language by default).
    """
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    most = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_langs).select("lang")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = known.select("doc_id", "lang").join(F.broadcast(most), "lang").withColumn("rank", F.row_number().over(first)) \
        .where(F.col("rank") <= ref_docs).groupBy("doc_id", "lang").agg(F.min("rank").alias("rank"))
    rows = known.select("doc_id", "lang", F.substring("text", 1, ref_chars).alias("text")) \
        .join(F.broadcast(ids), ["doc_id", "lang"]) \
        .groupBy("doc_id", "lang", "rank").agg(F.min("text").alias("text")).collect()  # ref_docs rows a language
    texts: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"], r["text"])):
        have = texts.get(r["lang"], "")
        if r["text"].strip() and len(have) < ref_chars:
            texts[r["lang"]] = (have + "\n" + r["text"])[:ref_chars + 1]
    return Model(texts)


def classify(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """``docs`` with lang_pred and lang_score, or the given names (columns of these names are replaced).

    Only ``text`` is read. Null texts and texts without a letter are ``und``
    with score 0; without any learned language all are. Ties go to the first
    language by name. Score: second lowest cost over the sum of the lowest two
    (0.5 undecided, to 1), 1 where one language was learned. Rows, their order
    of columns and repeats are kept; an empty table stays empty.
    """
    docs = docs.drop(*names)
    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()),
                           T.StructField(names[1], T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found, score = shared.value.predict(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [*part.columns, pa.array(found, pa.string()), pa.array(score, pa.float64())], names=schema.names)
        Model._built.clear()  # the worker goes on to other stages

    return docs.mapInArrow(label, schema)


def predict_all(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from the rest of the same table."""
    model = train(docs.select("doc_id", "text", "lang"))
    out = classify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred",
                      F.col("lang_score").alias("score"))
