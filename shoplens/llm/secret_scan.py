"""Secret scan: fixed patterns plus a linear-chain conditional random field (operator 3).

Tokens are runs of key characters. A token's features are its length and
shape, what stands before it, its neighbouring words and its document's size
and share of digits; labels are begin, inside and outside of a secret. The
field is fitted on a bounded sample, half of it documents that hold one of the
fixed patterns' spans (its labels), found in a scan of all, and adds spans that the patterns miss. Decoding is Viterbi: tokens
whose outside score no transition can outweigh are outside, and the short
stretches between them are decoded by the full recursion.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shoplens.llm.common import cut_lineage, slices, span_hashes, utf8, word_spans

# fixed values: the patterns and the least lengths of what they find
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of 24 or more is found from its first character
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "crf")

SCAN_BYTES = 1 << 20  # text expanded at a time: features take some 60 times its size
O, B, I = 0, 1, 2
BAR = -1e3  # the move from outside to inside, which is not allowed
_KIND = np.zeros(256, np.uint8)
_KIND[0x61:0x7B], _KIND[0x41:0x5B], _KIND[0x30:0x3A], _KIND[0x80:] = 1, 2, 3, 5
_KIND[[0x2B, 0x2F, 0x5F, 0x2D]] = 4
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_HEX = np.zeros(256, bool)
_HEX[0x30:0x3A] = _HEX[0x61:0x67] = True
_SIZES = (8, 36, 5, 4, 6, 512, 512, 5, 5)   # values of each feature, in the order of features()
_BASES = np.cumsum((0, *_SIZES))


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, value start, value end) of the fixed patterns' matches."""
    out = [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text)
           if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text)
                if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _suspects(data: np.ndarray, offs: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Rows in which a fixed pattern can match: a keyword's part, AKIA, or two hex characters 12 apart."""
    step = _HEX[data[::12]]
    at = np.flatnonzero(step[:-1] & step[1:]) * 12
    for d in (3, 5, 7, 9, 10):
        at = at[_HEX[data[at + d]]]
    some = np.zeros(len(texts), bool)
    some[np.searchsorted(offs, at, "right") - 1] = True
    for i, t in enumerate(texts):
        if not some[i] and t:
            low = t.lower()
            some[i] = "passw" in low or "secret" in low or "token" in low or "api" in low or "AKIA" in t
    return np.flatnonzero(some)


def tokens(data: np.ndarray, offs: np.ndarray):
    """Starts, ends, rows and features (n, 9) of all tokens."""
    kind = _KIND[data]
    starts, ends, row = word_spans(kind == 0, offs)
    n = len(starts)
    feats = np.zeros((n, len(_SIZES)), np.int32)
    if not n:
        return starts, ends, row, feats

    def running(flags: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(flags, dtype=np.int32)])

    def inside(total: np.ndarray) -> np.ndarray:
        return total[ends] - total[starts]

    size = ends - starts
    digit = kind == 3
    digits_all = running(digit)
    digits, uppers, lowers = inside(digits_all), inside(running(kind == 2)), inside(running(kind == 1))
    hexes, high = inside(running(_HEX[data])), inside(running(kind == 5))
    change = np.zeros(len(data), bool)
    change[1:] = digit[1:] != digit[:-1]
    changes = running(change)
    turns = changes[ends] - changes[np.minimum(starts + 1, ends)]
    feats[:, 0] = np.searchsorted((4, 8, 12, 16, 20, 32, 48), size, "right")
    mask = (digits > 0) * 1 + (uppers > 0) * 2 + (lowers > 0) * 4
    feats[:, 1] = mask * 4 + (high > 0) * 2 + ((hexes == size) & (size > 7))
    feats[:, 2] = np.where(digits == 0, 0, np.where(digits == size, 4, 1 + np.minimum(3 * digits // size, 2)))
    feats[:, 3] = np.searchsorted((1, 3, 6), turns, "right")
    gap_from = np.concatenate([[0], ends[:-1]])
    first = np.concatenate([[True], row[1:] != row[:-1]])
    sign, quote, line = (running(np.isin(data, np.frombuffer(x, np.uint8))) for x in (b"=:", b"\"'", b"\n"))
    has = [(t[starts] - t[gap_from]) > 0 for t in (sign, quote, line)]
    feats[:, 4] = np.where(first, 5, np.where(has[0], 1 + has[1], np.where(has[1], 3, np.where(has[2], 4, 0))))
    word = (span_hashes(_LOWER[data], starts, ends) >> np.uint64(56 - 1)).astype(np.int32)
    feats[1:, 5] = word[:-1]
    feats[:-1, 6] = word[1:]
    feats[first, 5] = 0
    feats[np.concatenate([first[1:], [True]]), 6] = 0
    doc_size = np.diff(offs)
    share = (digits_all[offs[1:]] - digits_all[offs[:-1]]) / np.maximum(doc_size, 1)
    feats[:, 7] = np.searchsorted((200, 1000, 4000, 20000), doc_size, "right")[row]
    feats[:, 8] = np.searchsorted((1e-9, 0.005, 0.02, 0.1), share, "right")[row]
    feats += _BASES[:-1].astype(np.int32)
    return starts, ends, row, feats


@dataclass
class Field:
    """Weights of features (by label) and of transitions; None: nothing was learned."""
    weights: np.ndarray | None
    moves: np.ndarray | None

    def decode(self, feats: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The best label of each token; rows are chains of their own."""
        out = np.zeros(len(feats), np.int8)
        if self.weights is None or not len(feats):
            return out
        scores = self.weights[feats[:, 0]]
        for f in range(1, feats.shape[1]):
            scores = scores + self.weights[feats[:, f]]
        # made outside, a token changes two moves; an inside after it becomes a begin: its score and a third move
        free = self.moves[self.moves > BAR / 2]
        after = np.zeros(len(scores), scores.dtype)
        after[:-1] = np.maximum(scores[1:, I] - scores[1:, B], 0)
        sway = 3 * (free.max() - free.min()) + after
        open_ = np.flatnonzero(scores[:, O] - np.maximum(scores[:, B], scores[:, I]) <= sway)
        if not len(open_):
            return out
        cut = np.flatnonzero((np.diff(open_) > 1) | (np.diff(row[open_]) > 0)) + 1
        for part in np.split(open_, cut):
            out[part] = viterbi(scores[part].astype(float), self.moves)
        return out


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of one chain that stands between outside tokens (or the row's ends)."""
    n = len(scores)
    best = scores[0] + moves[O]
    back = np.zeros((n, 3), np.int8)
    for t in range(1, n):
        way = best[:, None] + moves
        back[t] = way.argmax(0)
        best = way.max(0) + scores[t]
    last = int((best + moves[:, O]).argmax())
    out = np.zeros(n, np.int8)
    for t in range(n - 1, -1, -1):
        out[t] = last
        last = back[t, last]
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


CONTEXT = (4, 5, 6)  # features of what stands round a token: the sign before it and the neighbouring words
PRECISION = 0.9      # of the field's spans, on windows it wasn't fitted on
BIASES = (0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 13.0, 16.0)


def hidden(feats: np.ndarray, at: np.ndarray, alphabet: bool = False) -> np.ndarray:
    """Windows whose tokens ``at`` (and those before and after them) show no context, nor, if asked, their alphabet."""
    out = feats.copy()
    if alphabet:
        out[..., 1][at] = _BASES[1]
    near = at.copy()
    near[:, 1:] |= at[:, :-1]
    near[:, :-1] |= at[:, 1:]
    for f in CONTEXT:
        out[..., f][near] = _BASES[f]
    return out


def fit(texts: list[str], window: int = 24, rounds: int = 80, rate: float = 0.4, decay: float = 1e-4,
        plain_per_secret: int = 6, thinner: float = 1.0) -> Field:
    """Maximum likelihood (Adagrad over all windows at once) with the patterns' spans as labels.

    The labels' own keywords would explain every label, and a field that knows
    only them adds nothing. So every window comes three times: as it is, with the
    context of its secret hidden, and with the secret's kinds of characters hidden
    too, so that size and change between letters and digits count; windows
    without a secret hide the same of a quarter of their tokens. A third of the
    windows is held out: on it the least bias towards outside is taken with which
    PRECISION of the spans found without context are secrets, false ones
    weighted by how much more plain text the corpus has than the sample.
    ``thinner``: how many times more text the corpus has for each span than ``texts``.
    """
    all_feats, all_labels, n_tokens = [], [], 0
    for at in range(0, len(texts), 200):
        part = texts[at:at + 200]
        data, offs = utf8(pa.array(part, pa.string()))
        starts, ends, row, feats = tokens(data, offs)
        labels = np.zeros(len(starts), np.int64)
        for i, text in enumerate(part):
            for _, _, _, a, b in base_spans(text or ""):
                lo = offs[i] + len(text[:a].encode())
                hi = offs[i] + len(text[:b].encode())
                inside = np.flatnonzero((starts >= lo) & (ends <= hi))
                labels[inside] = I
                labels[inside[:1]] = B
        n = len(starts) // window
        n_tokens += len(starts)
        all_feats.append(feats[:n * window].reshape(n, window, feats.shape[1]))
        all_labels.append(labels[:n * window].reshape(n, window).astype(np.int8))
    feats = np.concatenate(all_feats) if all_feats else np.zeros((0, window, len(_SIZES)), np.int32)
    labels = np.concatenate(all_labels) if all_labels else np.zeros((0, window), np.int8)
    if not labels.any():
        return Field(None, None)
    secret = labels.any(1)
    rank = np.cumsum(~secret) * 2654435761 % (1 << 32)
    plain = np.flatnonzero(~secret)[np.argsort(rank[~secret], kind="stable")][:plain_per_secret * int(secret.sum())]
    # a held-out third, by the order of the windows; each chosen window as it is and without context
    held = [x[2::3] for x in (np.flatnonzero(secret), plain)]
    kept = [np.concatenate([x[0::3], x[1::3]]) for x in (np.flatnonzero(secret), plain)]
    use = np.concatenate(kept)
    some = np.arange(labels.size).reshape(labels.shape) * 2654435761 % 97 < 24  # a quarter of the plain tokens
    at = np.where(labels.any(1)[:, None], labels > 0, some)
    blind = hidden(feats, at)
    test, truth = blind[np.concatenate(held)], labels[np.concatenate(held)]
    feats = np.concatenate([feats[use], blind[use], hidden(feats[use], at[use], alphabet=True)])
    labels = np.concatenate([labels[use]] * 3)
    n = len(feats)
    weights, moves = np.zeros((int(_BASES[-1]), 3)), np.zeros((3, 3))
    bar = np.zeros((3, 3))
    bar[O, I] = BAR
    w2, m2 = np.full_like(weights, 1e-8), np.full_like(moves, 1e-8)
    gold = np.eye(3)[labels]
    gold_moves = np.einsum("nti,ntj->ij", gold[:, :-1], gold[:, 1:])
    for _ in range(rounds):
        e = weights[feats].sum(2)
        step = moves + bar
        fwd, bwd = np.zeros((window, n, 3)), np.zeros((window, n, 3))
        fwd[0] = e[:, 0]
        for t in range(1, window):
            fwd[t] = _log_sum(fwd[t - 1][:, :, None] + step, 1) + e[:, t]
        for t in range(window - 2, -1, -1):
            bwd[t] = _log_sum(step[None] + (e[:, t + 1] + bwd[t + 1])[:, None, :], 2)
        total = _log_sum(fwd[-1], 1)
        marginal = np.exp(fwd + bwd - total[None, :, None]).transpose(1, 0, 2)
        pair = sum(np.exp(fwd[t][:, :, None] + step + (e[:, t + 1] + bwd[t + 1])[:, None, :]
                          - total[:, None, None]).sum(0) for t in range(window - 1))
        diff = (gold - marginal).reshape(-1, 3) / n
        flat = feats.reshape(-1, feats.shape[2])
        grad = np.stack([sum(np.bincount(flat[:, f], weights=diff[:, k], minlength=len(weights))
                             for f in range(flat.shape[1])) for k in range(3)], 1) - decay * weights
        grad_moves = (gold_moves - pair) / n - decay * moves
        w2 += grad ** 2
        m2 += grad_moves ** 2
        weights += rate * grad / np.sqrt(w2)
        moves += rate * grad_moves / np.sqrt(m2)
    moves = moves + bar
    # how many windows of the corpus without a secret each one of the sample's stands for
    stands_for = max(thinner * n_tokens / window / max(len(plain), 1), 1.0)
    for bias in BIASES:
        field = Field(weights.astype(np.float32), moves)
        field.weights[_BASES[7]:_BASES[8], O] += np.float32(bias)
        right, wrong = _span_counts(field, test, truth, stands_for)
        if right and right >= PRECISION * (right + wrong):
            return field
    return Field(None, None)


def _span_counts(field: Field, feats: np.ndarray, truth: np.ndarray, stands_for: float) -> tuple[float, float]:
    """Found spans that begin at a secret, and those that don't, of windows without a secret times ``stands_for``."""
    row = np.repeat(np.arange(len(feats)), feats.shape[1])
    found = (field.decode(feats.reshape(-1, feats.shape[2]), row) == B).reshape(truth.shape)
    right = float((found & (truth > 0)).sum())
    wrong = found & (truth == 0)
    return right, float((wrong.sum(1) * np.where(truth.any(1), 1.0, stands_for)).sum())


def cut(text: str, max_chars: int, margin: int = 1000) -> str:
    """At most ``max_chars`` characters of a text: what stands round its spans, else its beginning."""
    if len(text) <= max_chars:
        return text
    pieces, upto, room = [], 0, max_chars
    for start, _, end, _, _ in base_spans(text):
        lo, hi = max(upto, start - margin), end + margin
        if hi > lo and room > 0:
            pieces.append(text[lo:min(hi, lo + room)])
            room -= len(pieces[-1]) + 1
            upto = hi
    return "\n".join(pieces) or text[:max_chars]


def train(docs: DataFrame, sample: int = 2000, max_chars: int = 20_000) -> Field:
    """Fit on at most ``sample`` texts, half of them with a span of the patterns, first by hash, cut to ``max_chars`` each.

    All texts are scanned for spans first, so no secret is too rare for the sample.
    """
    texts = docs.where(F.length("text") > 0).select(F.xxhash64("doc_id", "text").alias("h"), "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_bytes=SCAN_BYTES):
            column = part.column("text")
            own, n = column.to_pylist(), np.zeros(part.num_rows, np.int64)
            for i in _suspects(*utf8(column), own):
                n[i] = len(base_spans(own[i]))
            yield pa.RecordBatch.from_arrays([part.column("h"), pa.array(n), pa.array([len(t) for t in own], pa.int64())],
                                             ["h", "spans", "chars"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), pa.array([cut(t, max_chars) for t in batch.column("text").to_pylist()], pa.string())], ["h", "text"])

    found = cut_lineage(texts.mapInArrow(count, "h long, spans long, chars long"))
    spans, chars = found.agg(F.coalesce(F.sum("spans"), F.lit(0)), F.coalesce(F.sum("chars"), F.lit(0))).first()
    if not spans:
        return Field(None, None)

    def first(some: DataFrame) -> DataFrame:
        return some.select("h").distinct().orderBy("h").limit(sample // 2)

    ids = cut_lineage(first(found.where("spans > 0")).union(first(found.where("spans = 0"))))
    rows = texts.join(F.broadcast(ids), "h").mapInArrow(pieces, "h long, text string") \
        .groupBy("h").agg(F.min("text").alias("text")).orderBy("h").collect()  # at most `sample` rows
    own = [r["text"] for r in rows]
    thinner = (chars / sum(map(len, own))) / (spans / max(sum(len(base_spans(t)) for t in own), 1))
    return fit(own, thinner=thinner)


def find_spans(column: pa.Array, field: Field) -> list[list[tuple[int, int, int]]]:
    """(start, kind, end) of all spans of each row, in code points, ordered by start, then kind."""
    texts = column.to_pylist()
    data, offs = utf8(column)
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for i in _suspects(data, offs, texts):
        out[i] = [(s, k, e) for s, k, e, _, _ in base_spans(texts[i] or "")]
    starts, ends, row, feats = tokens(data, offs)
    labels = field.decode(feats, row)
    for first in np.flatnonzero(labels == B):
        last = first
        while last + 1 < len(labels) and labels[last + 1] == I and row[last + 1] == row[first]:
            last += 1
        i = int(row[first])
        own = data[offs[i]:ends[last]].tobytes()
        a = len(own[:starts[first] - offs[i]].decode())
        b = a + len(own[starts[first] - offs[i]:].decode())
        if all(b <= s or e <= a for s, k, e in out[i] if k < 3):
            out[i].append((a, 3, b))
    return [sorted(x) for x in out]


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row.

    Null and empty texts have no spans (the digest of the empty string).
    Repeated rows are scanned each; a null doc_id stays null; other columns
    are ignored; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_bytes=SCAN_BYTES):
            found = find_spans(part.column("text"), shared.value)
            base = [[x for x in spans if x[1] < 3] for spans in found]
            counts = [[sum(x[1] == k for x in spans) for spans in base] for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), *[pa.array(c, pa.int64()) for c in counts],
                 pa.array([hashlib.sha256(_joined(x).encode()).hexdigest() for x in base]),
                 pa.array([_joined(x) for x in found])],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        rows, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(docs: DataFrame, field: Field, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; all columns, null texts and rows stay."""
    shared = docs.sparkSession.sparkContext.broadcast(field)
    names = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_bytes=SCAN_BYTES):
            found = find_spans(part.column("text"), shared.value)
            if any(found):
                texts = part.column("text").to_pylist()
                for i, spans in enumerate(found):
                    if spans:
                        pieces, upto = [], 0
                        for s, _, e in spans:
                            if s >= upto:
                                pieces += [texts[i][upto:s], mark]
                            upto = max(upto, e)
                        texts[i] = "".join([*pieces, texts[i][upto:]])
                at = names.index("text")
                columns = list(part.columns)
                columns[at] = pa.array(texts, pa.string())
                part = pa.RecordBatch.from_arrays(columns, names)
            yield part

    out = docs.mapInArrow(rows, T.StructType(docs.schema.fields))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in names else out


def scan_all(docs: DataFrame) -> DataFrame:
    docs = docs.select("doc_id", "text")
    return scan(docs, train(docs))
