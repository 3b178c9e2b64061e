"""Near-duplicate records with small edits.

A record is a set of word shingles, seen as a vector of bits. Of two sets with a Jaccard similarity
of at least s, the smaller one has n bits and lacks at most t = n - ceil(2 s n / (1 + s)) of them in
the larger one. That is a threshold on a Hamming distance, and the generalised pigeonhole applies: if
the bits are cut into partitions, and thresholds of at least -1 are dealt out so that the sum of all
(threshold + 1) is t + 1, then in some partition the distance is within its threshold.

- Partitions: shingles whose rarest word is the same are one partition. They stand in the same places,
  occur together and are changed together, so they are correlated. Which word is rarest is read from
  a table that all records share, so every record cuts its bits in the same way.
- Thresholds: a threshold of k - 1 costs the probes of the partition's k rarest bits, estimated from
  the table as the sum of the other records that have them, but no more than have the partition's
  word, because its bits bring the same records. These costs aren't convex; a dynamic programme
  deals out the places, per record and unequally. Most partitions of frequent words get -1.
- Probe: the smaller record looks up the bits that got a place; the larger ones are found by any bit.
  With l - 1 places more, similar records share at least l of the bits, which keeps out those that
  meet by chance. Bits of no other record are neither looked up nor kept to be found.
- Verify: on the whole shingle sets, exactly.

Equal shingle sets are one class and are compared once. A bit of very many records is cut into blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.leak import words_of
from sedimark.storage_paths import written

#: Members of a class that one task pairs with as many others.
BLOCK = 1000
#: Texts that are cut into shingles together.
STEP = 4096
#: Bits that two records must share among those with a place; each takes one place more.
SHARED = 3
#: Slots of the table of counts for shingles and for words, and how many of them one task sums up.
SLOTS, WORD_SLOTS, RANGE = 1 << 24, 1 << 20, 1 << 18
#: Slots that a task holds before it hands their counts on.
HELD = 1 << 22
#: Records of a bit that meet in one task.
HOT = 50_000
#: Bits over which one dynamic programme runs; of longer records, several share the places by their marginal costs.
PROGRAMME = 256
#: A count of c is kept as 1 + floor(STEPS log2 c).
STEPS = 6
_VALUE = np.append(0.0, 2.0 ** (np.arange(255) / STEPS))


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class Shingles:
    """The distinct shingles of texts with at least ``least`` words, ascending by row and shingle; ``count`` has the words of every text."""

    def __init__(self, texts: list[str | None], size: int, least: int):
        per = [words_of(t.lower()) if t else [] for t in texts]
        self.size, self.count = size, np.fromiter(map(len, per), np.int64, len(per))
        number: dict[str, int] = {}
        self.word = np.fromiter((number.setdefault(w, len(number)) for d in per for w in d), np.int64, int(self.count.sum()))
        self.hashes = pd.util.hash_array(np.array(list(number), dtype=object), categorize=False) if number else np.zeros(0, np.uint64)
        self.owner = np.repeat(np.arange(len(per)), self.count)
        m = max(0, len(self.word) - size + 1)
        h, acc = self.hashes[self.word], np.zeros(m, np.uint64)
        for i in range(size if m else 0):
            acc = _mix(acc * np.uint64(0x9E3779B97F4A7C15) + h[i : i + m])
        first = np.flatnonzero((self.owner[:m] == self.owner[size - 1 :]) & (self.count[self.owner[:m]] >= max(least, size))) if m else np.zeros(0, np.int64)
        row, s = self.owner[first], acc[first].view(np.int64)
        order = np.lexsort((s, row))
        row, s, first = row[order], s[order], first[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (s[1:] != s[:-1])
        self.row, self.shingle, self.first = row[new], s[new], first[new]

    def slots(self) -> np.ndarray:
        """The slots of each row's shingles and distinct words."""
        kept = np.zeros(len(self.count), bool)
        kept[self.row] = True
        own = kept[self.owner]
        words = np.unique(self.owner[own] * max(1, len(self.hashes)) + self.word[own]) % max(1, len(self.hashes))
        return np.concatenate([_slot(self.shingle), _word_slot(self.hashes)[words]])

    def partitions(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(partition, records): each shingle's rarest word, ties by the word's hash, and how many records have it."""
        code = table[_word_slot(self.hashes)].astype(np.uint64)
        key = ((code << np.uint64(56)) | (self.hashes >> np.uint64(8)))[self.word]
        least = key[self.first] if len(self.first) else np.zeros(0, np.uint64)
        for i in range(1, self.size):
            least = np.minimum(least, key[self.first + i])
        return least, _VALUE[(least >> np.uint64(56)).astype(np.int64)]


def _slot(shingle: np.ndarray) -> np.ndarray:
    return shingle & (SLOTS - 1)


def _word_slot(hashes: np.ndarray) -> np.ndarray:
    return SLOTS + (hashes & np.uint64(WORD_SLOTS - 1)).astype(np.int64)


def shingle_sets(texts: list[str | None], size: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, words of the row): the distinct shingles of each text with at least ``least`` words, ascending by row and shingle."""
    s = Shingles(texts, size, least)
    return s.row, s.shingle, s.count


def places(n: np.ndarray, similarity: float, shared: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, need): how many bits a record of n bits looks up, and how many of them a partner that is no smaller has at least."""
    common = np.maximum(1, np.ceil(2 * similarity / (1 + similarity) * n - 1e-9).astype(np.int64))
    need = np.minimum(shared, common)
    return n - common + need, need


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def _running(x: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums from the start of each run on."""
    total = np.cumsum(x)
    return total - np.repeat(total[start] - x[start], size)


def allocate(row: np.ndarray, part: np.ndarray, cost: np.ndarray, most: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The positions of the bits that get a place: ``wanted[row]`` of each row, at the least estimated cost.

    A place count of k in a partition costs the sum of its k least ``cost`` values, at most ``most``
    of the partition. ``row`` is ascending, ``wanted`` is at most the number of a row's bits.
    """
    if not len(row):
        return np.zeros(0, np.int64)
    order = np.lexsort((cost, part, row))
    r, p = row[order], part[order]
    start = _starts(r, p)
    size = np.diff(np.append(start, len(r)))
    curve = np.minimum(_running(cost[order].astype(np.float64), start, size), np.repeat(most[order][start], size))
    # partitions by descending size; blocks of them are what one programme runs over
    owner = r[start]
    by_size = np.lexsort((-size, owner))
    start, size, owner = start[by_size], size[by_size], owner[by_size]
    first = _starts(owner)
    before = _running(size, first, np.diff(np.append(first, len(owner)))) - size
    block_start = _starts(owner, before // PROGRAMME)
    block_parts = np.diff(np.append(block_start, len(owner)))
    block_bits = np.add.reduceat(size, block_start)
    block_owner = owner[block_start]
    width = np.minimum(block_bits, wanted[block_owner])
    alone = np.bincount(block_owner, minlength=len(wanted))[block_owner] == 1
    taken = np.zeros(len(size), np.int64)
    by_width = np.lexsort((block_parts, width))[::-1]
    curves: dict[int, list[tuple[int, np.ndarray, object]]] = {}
    at = 0
    while at < len(by_width):
        n = max(1, (1 << 22) // max(1, int((width[by_width[at]] + 1) * block_parts[by_width[at : at + 4096]].max())))
        own = by_width[at : at + min(n, 4096)]
        at += len(own)
        run = _Programme(curve, start, size, block_start[own], block_parts[own], int(width[own].max()))
        single = np.flatnonzero(alone[own])
        run.take(taken, single, wanted[block_owner[own[single]]])
        for i in np.flatnonzero(~alone[own]):
            curves.setdefault(int(block_owner[own[i]]), []).append((int(i), run.cost[i, : width[own[i]] + 1], run))
    for o, blocks in curves.items():
        for (i, _, run), n in zip(blocks, _shared_out([c for _, c, _ in blocks], int(wanted[o]))):
            run.take(taken, np.array([i]), np.array([n]))
    rank = np.arange(len(r)) - np.repeat(np.cumsum(size) - size, size)
    return order[(np.repeat(start, size) + rank)[rank < np.repeat(taken, size)]]


class _Programme:
    """cost[b, u]: the least cost of u places in block b, over its partitions one after the other."""

    def __init__(self, curve: np.ndarray, start: np.ndarray, size: np.ndarray, block: np.ndarray, parts: np.ndarray, width: int):
        self.block, self.parts, self.choices = block, parts, []
        cost = np.full((len(block), width + 1), np.inf)
        cost[:, 0] = 0.0
        for p in range(int(parts.max())):
            on = np.flatnonzero(parts > p)
            s, n = start[block[on] + p], np.minimum(size[block[on] + p], width)
            old, new, choice = cost[on], cost[on].copy(), np.zeros((len(on), width + 1), np.int32)
            for k in range(1, int(n.max(initial=0)) + 1):
                ok = np.flatnonzero(n >= k) if p else np.arange(len(on))
                own = np.where(n[ok] >= k, curve[np.minimum(s[ok] + k - 1, len(curve) - 1)], np.inf)
                if p:
                    way = old[ok, : width + 1 - k] + own[:, None]
                    target = new[ok, k:]
                    better = way < target
                    new[ok, k:] = np.where(better, way, target)
                    choice[ok, k:] = np.where(better, k, choice[ok, k:])
                else:
                    new[:, k], choice[:, k] = own, k
            cost[on] = new
            self.choices.append((on, choice))
        self.cost = cost

    def take(self, taken: np.ndarray, blocks: np.ndarray, units: np.ndarray) -> None:
        """Writes to ``taken`` the places of each partition if the blocks get these numbers of them."""
        left = np.zeros(len(self.block), np.int64)
        left[blocks] = units
        chosen = np.zeros(len(self.block), bool)
        chosen[blocks] = True
        for p in range(len(self.choices) - 1, -1, -1):
            on, choice = self.choices[p]
            k = choice[np.arange(len(on)), left[on]]
            sel = chosen[on]
            taken[self.block[on[sel]] + p] = k[sel]
            left[on[sel]] -= k[sel]


def _shared_out(curves: list[np.ndarray], wanted: int) -> list[int]:
    """How many of ``wanted`` places each block gets: along the lower hulls of their costs, cheapest slope first."""
    pieces = []
    for b, c in enumerate(curves):
        hull = [0]
        for u in range(1, len(c)):
            while len(hull) > 1 and (c[hull[-1]] - c[hull[-2]]) * (u - hull[-1]) >= (c[u] - c[hull[-1]]) * (hull[-1] - hull[-2]):
                hull.pop()
            hull.append(u)
        pieces += [((c[v] - c[u]) / (v - u), b, u, v) for u, v in zip(hull, hull[1:])]
    got = [0] * len(curves)
    for _, b, u, v in sorted(pieces):
        n = min(v - u, wanted)
        got[b], wanted = got[b] + n, wanted - n
        if not wanted:
            break
    return got


def _keyed_sets(reps: DataFrame, size: int, least: int, run, schema: str) -> DataFrame:
    """``run(cls, shingles)`` over the shingle sets of each batch of (cls, t). Sets are made anew from the texts, which are smaller."""

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            for i in range(0, b.num_rows, STEP):
                part = b.slice(i, STEP)
                own = Shingles(part.column(1).to_pylist(), size, least)
                if len(own.row):
                    yield run(part.column(0), own)

    return reps.select("cls", "t").mapInArrow(batches, schema)


def _table(reps: DataFrame, size: int, least: int) -> np.ndarray:
    """How many records have a shingle or word of each slot, as codes of one byte; the same size for any input.

    Tasks hand on the slots they have seen with their counts; ranges of slots are summed up apart.
    """
    ranges = (SLOTS + WORD_SLOTS) // RANGE

    def packed(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        slot, n = np.unique(np.concatenate(held), return_counts=True)
        cut = np.searchsorted(slot, np.arange(ranges + 1) * RANGE)
        at = np.flatnonzero(np.diff(cut))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([(slot[cut[i] : cut[i + 1]] - i * RANGE).astype(np.uint32).tobytes() for i in at], pa.binary()), pa.array([n[cut[i] : cut[i + 1]].astype(np.int64).tobytes() for i in at], pa.binary())], names=["range", "slots", "n"])

    def own(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [np.zeros(0, np.int64)], 0
        for b in rows:
            for i in range(0, b.num_rows, STEP):
                held.append(Shingles(b.column(0).slice(i, STEP).to_pylist(), size, least).slots())
                n += len(held[-1])
                if n > HELD:
                    yield from packed(held)
                    held, n = [np.zeros(0, np.int64)], 0
        yield from packed(held)

    def added(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in rows:
            for r, slots, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if r not in total:
                    total[r] = np.zeros(RANGE, np.int64)
                total[r][np.frombuffer(slots.as_buffer(), np.uint32)] += np.frombuffer(n.as_buffer(), np.int64)
        for r, t in total.items():
            code = np.where(t > 0, np.minimum(255, 1 + np.floor(STEPS * np.log2(np.maximum(t, 1)) + 1e-9)), 0).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([code.tobytes()], pa.binary())], names=["range", "codes"])

    parts = reps.select("t").mapInArrow(own, "range int, slots binary, n binary").repartition(32, "range").mapInArrow(added, "range int, codes binary").collect()
    table = np.zeros(SLOTS + WORD_SLOTS, np.uint8)
    for r in parts:
        table[r[0] * RANGE : (r[0] + 1) * RANGE] = np.frombuffer(r[1], np.uint8)
    return table


def classes(rows: DataFrame, key: str, text: str, size: int, least: int) -> DataFrame:
    """(cls, id, t): rows with at least ``least`` words; cls, 64 bits of a hash, is the same for equal shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, STEP):
                part = b.slice(i, STEP)
                row, s, _ = shingle_sets(part.column(1).to_pylist(), size, least)
                if not len(row):
                    continue
                ends = np.append(np.flatnonzero(np.diff(row)) + 1, len(row))
                starts = np.concatenate([[0], ends[:-1]])
                cls = np.frombuffer(b"".join(blake2b(s[a:z].tobytes(), digest_size=8).digest() for a, z in zip(starts, ends)), np.int64)
                at = pa.array(row[starts])
                yield pa.RecordBatch.from_arrays([pa.array(cls), part.column(0).take(at), part.column(1).take(at)], names=["cls", "id", "t"])

    return rows.select(F.col(key).cast("string").alias("id"), F.col(text).alias("t")).where(F.col("id").isNotNull() & F.col("t").isNotNull()).mapInArrow(run, "cls long, id string, t string")


def lookups(cls: np.ndarray, own: Shingles, table: np.ndarray, similarity: float, hot: int) -> dict[str, np.ndarray]:
    """(bit, block, cls, n, need) of the records: what each can be found by, with need 0, and what it looks up, with need above 0."""
    code = table[_slot(own.shingle)]
    n = np.bincount(own.row, minlength=len(own.count))
    wanted, need = places(n, similarity, SHARED)
    part, records = own.partitions(table)
    at = allocate(own.row, part, np.maximum(_VALUE[code] - 1, 0), np.maximum(records - 1, 0), wanted)
    elsewhere = np.flatnonzero(code > 1)
    at = at[code[at] > 1]
    blocks = np.ceil(_VALUE[code] / hot).astype(np.int64)
    # a record lies in one block of a bit and looks in all of them
    times = blocks[at]
    block = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    mine = (_mix(cls.view(np.uint64)) >> np.uint64(1)).astype(np.int64)
    where = np.concatenate([elsewhere, np.repeat(at, times)])
    r = own.row[where]
    return {
        "bit": own.shingle[where],
        "block": np.concatenate([mine[own.row[elsewhere]] % blocks[elsewhere], block]).astype(np.int32),
        "cls": cls[r],
        "n": n[r].astype(np.int32),
        "need": np.concatenate([np.zeros(len(elsewhere), np.int8), need[own.row[np.repeat(at, times)]].astype(np.int8)]),
    }


def similar_classes(reps: DataFrame, size: int, similarity: float, least: int) -> DataFrame:
    """(cls_a, cls_b): pairs of different classes whose shingle sets have at least this Jaccard similarity. ``reps``: (cls, t), each class once."""
    spark = reps.sparkSession
    table, hot = spark.sparkContext.broadcast(_table(reps, size, least)), HOT

    def roles(cls: pa.Array, own: Shingles) -> pa.RecordBatch:
        columns = lookups(cls.to_numpy(), own, table.value, similarity, hot)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))

    def sets(cls: pa.Array, own: Shingles) -> pa.RecordBatch:
        start = _starts(own.row)
        lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(own.row)).astype(np.int32)), pa.array(own.shingle))
        return pa.RecordBatch.from_arrays([cls.take(pa.array(own.row[start])), lists], names=["cls", "shingles"])

    placed = written(_keyed_sets(reps, size, least, roles, "bit long, block int, cls long, n int, need byte"), "placed")
    a, b = placed.where(F.col("need") > 0).alias("a"), placed.where(F.col("need") == 0).drop("need").alias("b")
    larger = (F.col("b.n") > F.col("a.n")) | ((F.col("b.n") == F.col("a.n")) & (F.col("b.cls") > F.col("a.cls")))
    within = F.col("a.n") >= similarity * F.col("b.n") - 1e-9
    met = a.join(b, (F.col("a.bit") == F.col("b.bit")) & (F.col("a.block") == F.col("b.block")) & larger & within)
    met = met.groupBy(F.col("a.cls").alias("cls_a"), F.col("b.cls").alias("cls_b")).agg(F.count("*").alias("shared"), F.max("a.need").alias("need"))
    pairs = written(met.where(F.col("shared") >= F.col("need")).select("cls_a", "cls_b"), "probed")
    needed = reps.join(pairs.select(F.explode(F.array("cls_a", "cls_b")).alias("cls")).distinct(), "cls", "left_semi")
    known = written(_keyed_sets(needed, size, least, sets, "cls long, shingles array<long>"), "sets")
    left = known.select(F.col("cls").alias("cls_a"), F.col("shingles").alias("x"))
    right = known.select(F.col("cls").alias("cls_b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y"))
    return pairs.join(left, "cls_a").join(right, "cls_b").where(both >= similarity * (F.size("x") + F.size("y") - both) - 1e-9).select("cls_a", "cls_b")


def near_duplicates(rows: DataFrame, key: str = "chunk_id", text: str = "content", size: int = 5, similarity: float = 0.8, least: int = 0) -> tuple[DataFrame, DataFrame]:
    """Membership (cls, id) and pairs (cls_a, cls_b) of similar classes.

    Texts with fewer than ``least`` words, or fewer than ``size``, null ones and rows with null key
    have no class; repeated rows count once; a key with several texts is in several classes. Empty
    input gives empty tables; other columns are left out.
    """
    every = written(classes(rows, key, text, size, least), "classes")
    members = every.select("cls", "id").distinct()
    reps = written(every.groupBy("cls").agg(F.first("t").alias("t")), "representatives")
    return members, similar_classes(reps, size, similarity, least)


def duplicate_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b), smaller first: every pair of different keys in one class or in similar classes.

    This is as many rows as there are such pairs; ``near_duplicates`` itself is the short form. The
    members of a large class are cut into blocks, and every two blocks meet in a task of their own.
    """
    blocks = members.groupBy("cls").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where(F.col("blocks") > 1)
    placed = members.join(blocks, "cls", "left").select("cls", "id", F.coalesce("blocks", F.lit(1)).alias("blocks")).withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = placed.select("cls", "id", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    left, right = met.select("cls", F.col("id").alias("i"), F.col("mine").alias("x"), F.col("other").alias("y")), met.select("cls", F.col("id").alias("j"), F.col("other").alias("x"), F.col("mine").alias("y"))
    inside = left.join(right, ["cls", "x", "y"]).where(F.col("i") < F.col("j")).select("i", "j")
    a, b = members.select(F.col("cls").alias("cls_a"), F.col("id").alias("i")), members.select(F.col("cls").alias("cls_b"), F.col("id").alias("j"))
    across = pairs.join(a, "cls_a").join(b, "cls_b").where(F.col("i") != F.col("j")).select("i", "j")
    return inside.unionByName(across).select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()
