"""Token ids of texts, word by word, for tokenizers that never join across a word's start.

A word starts at a space between visible characters (or letters of common
scripts): byte-level BPE splits there before it merges, and a piece vocabulary
without an inner space mark cannot merge across it. Every distinct word is
encoded once and kept, up to a bound in bytes; then the store starts anew.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: rough cost of a kept word beside its text and ids: the string, its number and their place in the dictionary
WORD_COST = 200


#: text that one call of an encoder gets
CALL_BYTES = 1 << 16

Ids = tuple[np.ndarray, np.ndarray]  # ids of several words, and the end of each word in them


def byte_bpe(ranks: str) -> Callable[[str], list[int]]:
    """The encoder of a byte-level BPE vocabulary; special tokens' strings are plain text."""
    import public_tokenizers as P
    import tiktoken
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary


def one_by_one(encode: Callable[[str], list[int]]) -> Callable[[list[str], np.ndarray], Ids]:
    """An encoder of lists of words from an encoder of a word."""
    def encode_all(words: list[str], sizes: np.ndarray) -> Ids:
        ids = [encode(w) for w in words]
        return (np.fromiter((i for own in ids for i in own), np.uint32),
                np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))))
    return encode_all


def word_bounds(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Starts of all words and the end; every row starts a word."""
    seen = (data > 0x20) & (data < 0x7F)
    # a neighbour in UTF-8 that can't be part of a white space character
    lead = (data >= 0xC3) & (data <= 0xDF) | (data > 0xE3)
    after = seen | lead
    before = seen.copy()
    before[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & (data[:-1] >= 0xC3) & (data[:-1] <= 0xDF)
    edge = np.zeros(len(data) + 1, bool)
    edge[np.flatnonzero((data[1:-1] == 0x20) & before[:-2] & after[2:]) + 1] = True
    edge[offs] = True
    return np.flatnonzero(edge)


class WordIds:
    """Ids of texts by words, for each of ``encoders`` (functions from words, with their spaces, and their sizes in bytes, to Ids)."""

    def __init__(self, encoders: list[Callable[[list[str], np.ndarray], Ids]], keep_bytes: int = 96 << 20) -> None:
        self.encoders = encoders
        self.keep_bytes = keep_bytes
        self.clear()

    def clear(self) -> None:
        self.code: dict[str, int] = {}
        self.held = 0
        self.ids = [np.zeros(1 << 16, np.uint32) for _ in self.encoders]
        self.ends = [np.zeros(1 << 14, np.int64) for _ in self.encoders]  # ends[i]: end of word i - 1

    def codes(self, distinct: pa.Array) -> np.ndarray:
        """Numbers of distinct words; new ones are encoded."""
        words, sizes = distinct.to_pylist(), pc.binary_length(distinct).to_numpy()
        if self.held > self.keep_bytes:
            self.clear()
        code = self.code
        out = np.fromiter(map(code.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(out < 0)
        if len(new):
            first, n = len(code), len(new)
            out[new] = np.arange(first, first + n)
            new_words = [words[i] for i in new.tolist()]
            code.update(zip(new_words, range(first, first + n)))
            self.held += WORD_COST * n + int(sizes[new].sum())
            for e, encode in enumerate(self.encoders):
                ids, ends = encode(new_words, sizes[new])
                used = int(self.ends[e][first])
                self.ids[e] = _room(self.ids[e], used + len(ids))
                self.ids[e][used:used + len(ids)] = ids
                self.ends[e] = _room(self.ends[e], first + n + 1)
                self.ends[e][first + 1:first + n + 1] = ends + used
                self.held += 4 * len(ids) + 8 * n
        return out

    def encode(self, data: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each encoder: all ids, offsets of the words in them, and offsets of the rows in them."""
        if not len(data):
            return [(np.zeros(0, np.uint32), np.zeros(1, np.int64), np.zeros(len(offs), np.int64)) for _ in self.encoders]
        bounds = word_bounds(data, offs)
        arr = pa.Array.from_buffers(pa.large_string(), len(bounds) - 1,
                                    [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
        coded = arr.dictionary_encode()
        code = self.codes(coded.dictionary)[coded.indices.to_numpy()]
        rows = np.searchsorted(bounds, offs)
        out = []
        for ids, ends in zip(self.ids, self.ends):
            first, lens = ends[code], ends[code + 1] - ends[code]
            upto = np.concatenate([[0], np.cumsum(lens)])
            at = np.repeat(first - upto[:-1], lens) + np.arange(upto[-1])
            out.append((ids[at], upto, upto[rows]))
        return out


def _room(a: np.ndarray, n: int) -> np.ndarray:
    while n > len(a):
        a = np.concatenate([a, np.zeros_like(a)])
    return a
