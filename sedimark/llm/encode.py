"""Encoding of texts with a public byte-level BPE vocabulary.

A text is split by the vocabulary's pattern; every distinct piece is merged once. The merging keeps
a segment tree over the piece's byte positions: leaf i holds the rank of the pair that starts at i,
every inner node the smallest below it, and rank and position share one integer, so the root is the
leftmost smallest rank. A merge changes three leaves (the pair itself, its left neighbour, and the
byte that it swallows) and so three paths of logarithmic length. The trees of many pieces of like
length are the rows of one matrix, and all of them advance one merge at a time.
"""

from __future__ import annotations

import base64
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split pattern published with the vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: Pieces whose ids a worker keeps; beyond that it starts anew.
KEPT_PIECES = 300_000
#: Texts whose pieces are merged together.
BATCH = 2048
#: Cells of one matrix of trees.
CELLS = 1 << 21
_SHIFT = 32
_NONE = np.int64(1) << 62


def default_vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


class BytePairEncoder:
    """``vocabulary``: a file of lines with a base64 token and its rank, which is also its id."""

    def __init__(self, vocabulary: str, pattern: str = PATTERN):
        with open(vocabulary, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.split = regex.compile(pattern).findall
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {(self.ranks[t[:i]] << _SHIFT) | self.ranks[t[i:]]: r for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks}
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.keys, self.values = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        self.known: dict[str, tuple[int, ...]] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, or _NONE; -1 for right means that there is no neighbour."""
        k = (left << _SHIFT) | np.maximum(right, 0)
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where((self.keys[at] == k) & (right >= 0), self.values[at], _NONE >> _SHIFT)

    def _merge(self, pieces: list[bytes], width: int) -> list[tuple[int, ...]]:
        """The ids of pieces of at most ``width`` bytes, a power of 2."""
        n = len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, n)
        there = np.arange(width) < lengths[:, None]
        token = np.full((n, width + 1), -1, np.int64)  # the last column stands for the end
        token[:, :width][there] = self.of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.where(np.arange(width) + 1 < lengths[:, None], np.arange(width) + 1, width)
        before = np.broadcast_to(np.arange(-1, width), (n, width + 1)).copy()
        tree = np.full((n, 2 * width), _NONE)
        place = np.arange(width, dtype=np.int64)
        tree[:, width:] = np.where(there, (self._rank(token[:, :width], token[np.arange(n)[:, None], after]) << _SHIFT) | place, _NONE)
        half = width
        while half > 1:
            half //= 2
            tree[:, half : 2 * half] = np.minimum(tree[:, 2 * half : 4 * half : 2], tree[:, 2 * half + 1 : 4 * half : 2])
        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            root = tree[rows, 1]
            at, rank = root & ((1 << _SHIFT) - 1), root >> _SHIFT
            gone = after[rows, at]
            then = after[rows, gone]
            first = before[rows, at]
            token[rows, at] = rank
            token[rows, gone] = -1
            after[rows, at] = then
            before[rows, then] = at
            tree[rows, width + gone] = _NONE
            tree[rows, width + at] = (self._rank(rank, token[rows, then]) << _SHIFT) | at
            has = first >= 0
            r, f = rows[has], first[has]
            tree[r, width + f] = (self._rank(token[r, f], rank[has]) << _SHIFT) | f
            who, node = np.concatenate([rows, rows, r]), (np.concatenate([gone, at, f]) + width) >> 1
            while node[0]:
                tree[who, node] = np.minimum(tree[who, 2 * node], tree[who, 2 * node + 1])
                node = node >> 1
            rows = rows[tree[rows, 1] < _NONE]
        kept = token[:, :width] >= 0
        flat, ends = token[:, :width][kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends)]

    def learn(self, pieces: set[str]) -> None:
        by_width: dict[int, list[str]] = {}
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(raw)) is not None:
                self.known[p] = (whole,)
            else:
                by_width.setdefault(max(2, 1 << (len(raw) - 1).bit_length()), []).append(p)
        for width, own in by_width.items():
            step = max(1, CELLS // width)
            for i in range(0, len(own), step):
                part = own[i : i + step]
                self.known.update(zip(part, self._merge([p.encode("utf-8", "surrogatepass") for p in part], width)))

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin and the last end."""
        words = [self.split(t) if t else [] for t in texts]
        pieces = set().union(*words)
        new = pieces.difference(self.known)
        if len(self.known) + len(new) > KEPT_PIECES:
            self.known.clear()
            new = pieces
        self.learn(new)
        get, flat, ends = self.known.__getitem__, array("i"), np.zeros(len(texts) + 1, np.int32)
        for i, w in enumerate(words):
            flat.extend(itertools.chain.from_iterable(map(get, w)))
            ends[i + 1] = len(flat)
        return np.array(flat, np.int32), ends

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()


_ENCODERS: dict[tuple[str, str], BytePairEncoder] = {}


def encoder(vocabulary: str, pattern: str = PATTERN) -> BytePairEncoder:
    """One encoder a worker, kept between tasks."""
    if (vocabulary, pattern) not in _ENCODERS:
        _ENCODERS[vocabulary, pattern] = BytePairEncoder(vocabulary, pattern)
    return _ENCODERS[vocabulary, pattern]


def encode_corpus(docs: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """(key, ids): every row's ids without special tokens.

    Null and empty texts give an empty list; a null key stays null; repeated rows stay repeated;
    other columns are left out, whatever their names. Whole texts of any length. No shuffle.
    """
    place = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(place, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                flat, ends = e.encode_batch(batch.column(1).slice(start, BATCH).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, BATCH), ids], names=["key", "ids"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)
