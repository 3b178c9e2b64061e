"""Evaluation texts leaking into training text.

Each shard of training documents gets a suffix array over its words; every suffix of the test texts
is looked up in it by binary search, word by word, which leaves the range of all training suffixes
that begin alike; what goes on alike beyond that gives the longest match and where it is. Documents
that hold a match can then be removed.

Words that no test text has can't lie in a match, so only runs of known words that are long enough
enter the array. That is exact: a match lies within one such run.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A word: a maximal run of Unicode letters and digits.
words_of = re.compile(r"[^\W_]+").findall
#: Least number of successive words that count as a leak.
LEAST_WORDS = 12
#: Words of test texts that are held together; a shard meets one block of them after the other.
BLOCK_WORDS = 2_000_000
#: Documents of one shard.
SHARD = 10_000
#: Matches that are laid out together.
PIECE = 1 << 20


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Positions of ``t`` in the order of their suffixes, by prefix doubling; a suffix that ends is lowest."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64) + 1
    order, k = np.argsort(rank, kind="stable"), 1
    while k < n:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:]
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.concatenate([[1], 1 + np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n:
            break
        k *= 2
    return order


def _bound(t: np.ndarray, sa: np.ndarray, lo: np.ndarray, hi: np.ndarray, offset: int, word: np.ndarray, right: bool) -> np.ndarray:
    """In each range [lo, hi) of ``sa``, the first place whose word at ``offset`` isn't below (``right``: is above) ``word``."""
    lo, hi = lo.copy(), hi.copy()
    while True:
        active = np.flatnonzero(lo < hi)
        if not len(active):
            return lo
        mid = (lo[active] + hi[active]) >> 1
        value = t[np.minimum(sa[mid] + offset, len(t) - 1)]
        low = value <= word[active] if right else value < word[active]
        lo[active[low]] = mid[low] + 1
        hi[active[~low]] = mid[~low]


class TestSuffixes:
    """The test texts as word numbers. ``items``: (id, text) with texts that may be null or short."""

    __test__ = False

    def __init__(self, items: list[tuple], least: int):
        self.least, self.vocabulary, seq, self.ids, starts = least, {}, [], [], []
        for key, text in items:
            words = words_of(text.lower()) if text else []
            if len(words) < least:
                continue
            starts += [(len(seq) + i, len(self.ids)) for i in range(len(words) - least + 1)]
            seq += [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words] + [-2]
            self.ids.append(key)
        self.seq = np.array(seq + [-2], np.int64)
        self.at = np.array([a for a, _ in starts], np.int64)
        self.item = np.array([b for _, b in starts], np.int64)

    def matches(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, item, words, place): for each pair with a match, its longest one and the number of the document's word where the first such begins."""
        none = (np.zeros(0, np.int64),) * 4
        get, least = self.vocabulary.get, self.least
        per = [[get(w, 0) for w in words_of(t.lower())] + [0] if t else [0] for t in texts]
        flat = np.fromiter((w for d in per for w in d), np.int64, sum(map(len, per)))
        doc = np.repeat(np.arange(len(per)), list(map(len, per)))
        stops = np.flatnonzero(flat == 0)
        first = np.concatenate([[0], stops[:-1] + 1]) if len(stops) else stops
        long = stops - first >= least
        if not long.any() or not len(self.at):
            return none
        # each kept run of known words with the 0 that ends it
        size = (stops - first + 1)[long]
        place = np.arange(size.sum()) + np.repeat(first[long] - np.concatenate([[0], np.cumsum(size)[:-1]]), size)
        t, owner = np.append(flat[place], -1), doc[place]
        sa = suffix_array(t)
        lo, hi = np.zeros(len(self.at), np.int64), np.full(len(self.at), len(sa), np.int64)
        live = np.arange(len(self.at))
        for j in range(least):
            word = self.seq[self.at[live] + j]
            a = _bound(t, sa, lo[live], hi[live], j, word, False)
            b = _bound(t, sa, a, hi[live], j, word, True)
            lo[live], hi[live] = a, b
            live = live[a < b]
            if not len(live):
                return none
        count = (hi - lo)[live]
        # the word's number in its document
        number = place - (np.cumsum(list(map(len, per))) - list(map(len, per)))[owner]
        best = none
        step = np.cumsum(count) // PIECE
        for own in np.split(np.arange(len(live)), np.flatnonzero(np.diff(step)) + 1):
            best = _longest(*(np.concatenate(x) for x in zip(best, self._laid_out(live[own], lo[live[own]], count[own], sa, t, owner, number))))
        return best

    def _laid_out(self, live: np.ndarray, lo: np.ndarray, count: np.ndarray, sa: np.ndarray, t: np.ndarray, owner: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The matches of some test suffixes with the ranges of training suffixes that begin alike."""
        test = np.repeat(live, count)
        train = sa[np.arange(count.sum()) + np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count)]
        length = np.full(len(test), self.least, np.int64)
        going = np.arange(len(test))
        while len(going):
            a, b = self.seq[np.minimum(self.at[test[going]] + length[going], len(self.seq) - 1)], t[np.minimum(train[going] + length[going], len(t) - 1)]
            going = going[(a == b) & (a > 0)]
            length[going] += 1
        return _longest(owner[train], self.item[test], length, number[train])


def _longest(d: np.ndarray, i: np.ndarray, length: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each pair the longest match, and of those the first."""
    order = np.lexsort((place, -length, i, d))
    d, i, length, place = d[order], i[order], length[order], place[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1])
    return d[new], i[new], length[new], place[new]


def _blocks(tests: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """The test rows in blocks of bounded size, however many there are."""
    block, size = [], 0
    for r in tests.select(F.col(key).alias("k"), F.col(text).alias("t")).where(F.col("t").isNotNull()).distinct().toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1]) // 2
        if size > BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def find_leaks(train: DataFrame, tests: DataFrame, doc_key: str = "doc_id", doc_text: str = "text", item_key: str = "item_id", item_text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """(doc_key, item_key, words, place): documents that hold at least ``least`` successive words of a test text, how many at most, and at which word of the document the first such passage begins.

    Null, empty and short texts on either side match nothing; equal pairs of repeated rows come out
    once for each row of ``train`` with another key, and once for each key of ``tests``. A passage may
    lie in any number of documents. No shuffle of the training texts, which are read once: each shard
    meets the blocks of test texts in turn, and a task holds one block. The result alone is made distinct.
    """
    spark = train.sparkSession
    kinds = dict(train.dtypes)[doc_key], dict(tests.dtypes)[item_key]
    docs = train.select(F.col(doc_key).alias("d"), F.col(doc_text).alias("t")).where(F.col("t").isNotNull())
    blocks = [spark.sparkContext.broadcast(TestSuffixes(block, least)) for block in _blocks(tests, item_key, item_text)]
    alone = len(blocks) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, SHARD):
                part = batch.slice(start, SHARD)
                texts = part.column(1).to_pylist()
                for shared in blocks:
                    block = shared.value
                    d, i, n, place = block.matches(texts)
                    if len(d):
                        yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(d)), pa.array([block.ids[x] for x in i]), pa.array(n), pa.array(place)], names=["d", "i", "words", "place"])
                    if not alone:
                        del block
                        shared.__dict__.pop("_value", None)  # read again from the task's disk

    found = docs.mapInArrow(run, f"d {kinds[0]}, i {kinds[1]}, words long, place long") if blocks else spark.createDataFrame([], f"d {kinds[0]}, i {kinds[1]}, words long, place long")
    best = F.min(F.struct((-F.col("words")).alias("w"), "place")).alias("m")
    return found.groupBy(F.col("d").alias(doc_key), F.col("i").alias(item_key)).agg(best).select(doc_key, item_key, (-F.col("m.w")).alias("words"), "m.place")


def without_leaks(train: DataFrame, found: DataFrame, doc_key: str = "doc_id") -> DataFrame:
    """The training rows whose document isn't among the found ones."""
    return train.join(found.select(doc_key).distinct(), doc_key, "left_anti")
