"""Subject areas of documents.

The document-term matrix is factored by alternating non-negative updates (for the generalised
Kullback-Leibler divergence, where they are multiplicative). Each subject is a component anchored by
seeds: terms that its hint names or that labelled documents of the subject have far more often than
those of others. Multiplicative updates keep a zero zero, so a component can't leave its anchors for
the words that all documents share; terms that too few labelled documents show may join any
component; and a free component holds what belongs to no subject. Rows of the document factor are
then subject mixtures, and a term's part in a document is divided among subjects accordingly. A
sentence treats the subject that most of its terms' parts go to.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.storage_paths import written

#: Labelled rows from which the anchors are made, at most; which, is decided by a hash.
LABELLED = 50_000
#: A term must be in this part of all documents, and in so many at least. At most (terms of a document) / TERM_SHARE terms pass.
TERM_SHARE, TERM_LEAST = 0.0003, 5
#: A term in this part of a language's documents, times what one subject would have of them, is common to all; languages with fewer documents than the second part of all aren't told apart.
COMMON_SHARE, LANGUAGE_SHARE = 2.0, 0.005
#: Weight of the free component beside the subjects'.
FREE = 0.3
#: Least part of a term's weight in one subject for the term to count in a sentence.
PURE = 0.3
#: Counts that a task holds before it hands them on.
HELD_TERMS = 1_000_000
#: How much more often than in other subjects' documents an anchor must be in a subject's; labelled documents that it takes to rule a term out.
LIFT, ENOUGH = 2.0, 4
ALTERNATIONS, INNER = 4, 8
#: Ranges of terms that are summed up apart.
RANGES = 8

_BREAKS = "[.!?](?=\\s)|[。！？\r\n\u0085\u2028\u2029]"
_ASCII, _ANY = "[a-z]{3,}", "[一-鿿々]+|[ァ-ヿ]+|[ぁ-ゟ]+|[^\\W\\d_ぁ-ヿ一-鿿々]{3,}"
_terms_ascii, _terms_any = re.compile(_ASCII).findall, re.compile(_ANY).findall
_parts_ascii, _parts_any = re.compile(f"{_ASCII}|{_BREAKS}").findall, re.compile(f"{_ANY}|{_BREAKS}").findall
#: What ends a sentence, as it comes out among the terms.
BREAKS = ".!?。！？\r\n\u0085\u2028\u2029"


def terms_of(text: str) -> list[str]:
    """Terms of a lower-case text: runs of one script, of three letters at least where words are written with letters.

    Japanese has no spaces, and its content words are mostly runs of one kind.
    """
    return (_terms_ascii if text.isascii() else _terms_any)(text)


def parts_of(text: str) -> list[str]:
    """Terms and, in their places, the ends of sentences."""
    return (_parts_ascii if text.isascii() else _parts_any)(text)


@dataclass
class SubjectModel:
    subjects: list[str]
    vocabulary: dict[str, int]
    weights: np.ndarray  # (subjects + 1, terms); the last component is free


def _divided(model: SubjectModel, row: np.ndarray, term: np.ndarray, rounds: int) -> np.ndarray:
    """The part of each occurrence that goes to each component, after ``rounds`` updates of the document factor."""
    if not len(term):
        return np.zeros((0, len(model.weights)), np.float32)
    h = np.ascontiguousarray(model.weights.T, np.float32)[term]
    starts = np.flatnonzero(np.diff(row, prepend=-1))  # rows are ascending
    at = np.cumsum(np.diff(row, prepend=row[0]) != 0)
    w = np.full((len(starts), h.shape[1]), 1.0 / h.shape[1], np.float32)
    for _ in range(rounds):
        part = h * w[at]
        part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
        w = np.add.reduceat(part, starts, axis=0) + 0.01
        w /= w.sum(1, keepdims=True)
    part = h * w[at]
    return part / np.maximum(part.sum(1, keepdims=True), 1e-30)


def _labels(labels: DataFrame, key: str) -> dict:
    """Subjects by document of at most LABELLED rows."""
    picked = labels.where(F.col(key).isNotNull() & F.col("subject").isNotNull()).select(F.col(key).alias("k"), F.lower(F.trim("subject")).alias("s")).distinct().orderBy(F.xxhash64("k", "s"), "k", "s").limit(LABELLED)
    out: dict = {}
    for k, s in picked.collect():
        out.setdefault(k, []).append(s)
    return out


def _term_counts(docs: DataFrame, labelled: dict, names: list[str]) -> tuple[list[int], list]:
    """Numbers of labelled documents by subject, and for each term that isn't too rare or common (term, df, counts by subject...)."""
    number = {s: i for i, s in enumerate(names)}
    shared = docs.sparkSession.sparkContext.broadcast({k: [number[s] for s in v if s in number] for k, v in labelled.items()})

    def counted(by: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for g, c in by.items():
            items = list(c.items())
            for i in range(0, len(items), 50_000):
                part = items[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in part], pa.string()), pa.array([g] * len(part), pa.string()), pa.array([n for _, n in part], pa.int64())], names=["term", "g", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, Counter] = {}
        get = shared.value.get
        for b in batches:
            for key, text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = set(terms_of(text.lower())) if text else set()
                words.add("")  # counts the documents
                for g in (f"l{(lang or '').strip().lower()}", *(f"s{s}" for s in get(key, ()))):
                    if g not in by:
                        by[g] = Counter()
                    by[g].update(words)
            if sum(map(len, by.values())) > HELD_TERMS:
                yield from counted(by)
                by = {}
        yield from counted(by)

    counts = written(docs.select("k", "t", "l").mapInArrow(run, "term string, g string, n long").groupBy("term", "g").agg(F.sum("n").alias("n")), "terms")
    sizes = counts.where(F.col("term") == "")
    total = sizes.where(F.col("g").startswith("l")).agg(F.sum("n")).first()[0]
    if not total:
        return [0] * len(names), []
    # one row a subject, and at most 1 / LANGUAGE_SHARE languages
    labelled_documents = {r.g: r.n for r in sizes.where(F.col("g").startswith("s")).collect()}
    large = [x for r in sizes.where(F.col("g").startswith("l") & (F.col("n") >= total * LANGUAGE_SHARE)).collect() for x in (F.lit(r.g), F.lit(r.n))]
    part = F.max(F.col("n") / F.create_map(*large)[F.col("g")]) if large else F.lit(0.0)
    is_language = F.col("g").startswith("l")
    sums = [F.sum(F.when(is_language, F.col("n"))).alias("df"), *[F.coalesce(F.sum(F.when(F.col("g") == f"s{i}", F.col("n"))), F.lit(0)).alias(f"n{i}") for i in range(len(names))]]
    terms = counts.where(F.col("term") != "").groupBy("term").agg(*sums, part.alias("part"))
    frequent = terms.where((F.col("df") >= max(TERM_LEAST, total * TERM_SHARE)) & (F.coalesce("part", F.lit(0.0)) < min(0.9, COMMON_SHARE / max(1, len(names))))).drop("part").orderBy("term").collect()
    return [labelled_documents.get(f"s{i}", 0) for i in range(len(names))], frequent


def anchors(names: list[str], hints: dict[str, str], documents: list[int], counts: list) -> tuple[dict[str, int], np.ndarray]:
    """Vocabulary and first weights; terms that can be in no subject are left out."""
    terms = [r[0] for r in counts]
    seen = np.array([list(r[2:]) for r in counts], float).reshape(len(counts), len(names)).T
    size = np.maximum(np.array(documents, float), 1e-9)[:, None]
    mine, total = seen / size, seen.sum(0)
    others = (total - seen) / np.maximum(size.sum() - size, 1e-9)
    expected = size * total / size.sum()
    h = np.where((seen >= 2) & (seen >= expected + 2 * np.sqrt(expected)), np.maximum(0.0, mine - LIFT * others), 0.0)
    strong = np.median(h[h > 0]) if (h > 0).any() else 1.0
    place = {t: i for i, t in enumerate(terms)}
    hinted: dict[str, set[int]] = {}
    for s, name in enumerate(names):
        for w in set(terms_of(hints.get(name, "").lower())) - {name}:
            hinted.setdefault(w, set()).add(s)
    for w, ss in hinted.items():
        if w in place and (total[place[w]] < ENOUGH or any(h[s, place[w]] > 0 for s in ss)):
            for s in ss:
                h[s, place[w]] = max(h[s, place[w]], strong)
    unknown = (total < ENOUGH) & (h.sum(0) == 0)
    h[:, unknown] = 0.02 * strong
    kept = h.sum(0) > 0
    if not kept.any():
        return {}, np.zeros((len(names) + 1, 0))
    rest = np.where(h > 0, others, np.inf).min(0)
    h = np.vstack([h, np.where(unknown, 0.02 * strong, np.where(np.isfinite(rest), rest, 0.0))])[:, kept]
    return {t: i for i, t in enumerate(t for t, k in zip(terms, kept) if k)}, _scaled(h)


def _scaled(h: np.ndarray) -> np.ndarray:
    """Components that sum up to 1, the free one to FREE."""
    return h / np.maximum(h.sum(1, keepdims=True), 1e-300) * np.append(np.ones(len(h) - 1), FREE)[:, None]


def _occurrences(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """(k, sentence, term): of each document the known terms in order and their sentences' numbers; whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast({**vocabulary, **dict.fromkeys(BREAKS, -1)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for b in batches:
            flat, ends = array("i"), np.zeros(b.num_rows + 1, np.int64)
            for i, text in enumerate(b.column(1).to_pylist()):
                flat.extend([v for v in map(get, parts_of(text.lower())) if v is not None])
                ends[i + 1] = len(flat)
            term = np.array(flat, np.int32)
            doc = np.repeat(np.arange(b.num_rows), np.diff(ends))
            ended = np.cumsum(term < 0)
            before = np.concatenate([[0], ended])[ends[:-1]]
            sentence = (ended - before[doc]).astype(np.int32)
            known = term >= 0
            count = np.bincount(doc[known], minlength=b.num_rows)
            kept = np.flatnonzero(count)
            offsets = pa.array(np.concatenate([[0], np.cumsum(count[kept])]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(kept)), pa.ListArray.from_arrays(offsets, pa.array(sentence[known])), pa.ListArray.from_arrays(offsets, pa.array(term[known]))], names=["k", "sentence", "term"])

    kind = dict(docs.dtypes)["k"]
    return docs.where(F.col("t").isNotNull()).select("k", "t").mapInArrow(run, f"k {kind}, sentence array<int>, term array<int>")


def _flat(b: pa.RecordBatch, column: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.diff(b.column(column).offsets.to_numpy())
    return np.repeat(np.arange(len(lengths)), lengths), b.column(column).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _alternate(occurrences: DataFrame, model: SubjectModel) -> np.ndarray:
    """The next weights. Tasks sum up their documents and hand on the terms that they have; ranges of terms are added up apart."""
    shared = occurrences.sparkSession.sparkContext.broadcast(model)
    shape = model.weights.shape

    width = max(1, -(-shape[1] // RANGES))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            row, term = _flat(b, 0)
            if len(term):
                part = _divided(shared.value, row, term, INNER)
                for c in range(shape[0]):
                    total[c] += np.bincount(term, part[:, c], minlength=shape[1])
        seen = np.flatnonzero(total.any(0))
        cut = np.searchsorted(seen, np.arange(RANGES + 1) * width)
        parts = [(r, seen[s:e]) for r, (s, e) in enumerate(zip(cut[:-1], cut[1:])) if e > s]
        yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in parts], pa.int32()), pa.array([t.astype(np.int32).tobytes() for _, t in parts], pa.binary()), pa.array([np.ascontiguousarray(total[:, t]).tobytes() for _, t in parts], pa.binary())], names=["range", "terms", "sums"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for b in batches:
            for r, terms, sums in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if r not in tables:
                    tables[r] = np.zeros((shape[0], width))
                tables[r][:, np.frombuffer(terms.as_buffer(), np.int32) - r * width] += np.frombuffer(sums.as_buffer()).reshape(shape[0], -1)
        for r, t in tables.items():
            yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([t.tobytes()], pa.binary())], names=["range", "table"])

    parts = occurrences.select("term").mapInArrow(own, "range int, terms binary, sums binary").repartition(RANGES, "range").mapInArrow(added, "range int, table binary").collect()
    total = np.zeros((shape[0], RANGES * width))
    for r in parts:
        total[:, r[0] * width : (r[0] + 1) * width] = np.frombuffer(r[1]).reshape(shape[0], width)
    return _scaled(total[:, : shape[1]])


def fit(docs: DataFrame, labels: DataFrame, subjects: DataFrame, key: str = "doc_id", text: str = "text", lang: str | None = "lang") -> tuple[SubjectModel, DataFrame]:
    """The model, and the documents' occurrences of its terms. ``subjects``: (subject, hint), a short list of fixed length."""
    listed = subjects.select(F.lower(F.trim("subject")).alias("s"), "hint").where(F.col("s").isNotNull()).distinct().orderBy("s").collect()
    hints = {r.s: r.hint or "" for r in listed}
    names = list(hints)
    base = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), (F.col(lang) if lang else F.lit(None)).cast("string").alias("l"))
    per_subject, counts = _term_counts(base, _labels(labels, key), names)
    vocabulary, weights = anchors(names, hints, per_subject, counts) if counts and names else ({}, np.zeros((len(names) + 1, 0)))
    model = SubjectModel(names, vocabulary, weights)
    occurrences = written(_occurrences(base, vocabulary), "occurrences")
    for _ in range(ALTERNATIONS if vocabulary else 0):
        model = SubjectModel(names, vocabulary, _alternate(occurrences, model))
    return model, occurrences


def sentence_subjects(model: SubjectModel, b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(row, subject) of each sentence of the batch that treats a subject."""
    row, term = _flat(b, 2)
    _, sentence = _flat(b, 1)
    if not len(term):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    pure = model.weights / np.maximum(model.weights.sum(0), 1e-300)
    part = _divided(model, row, term, 2 * INNER) * (pure[:-1].max(0) >= PURE)[term, None]
    name, at = np.unique(row * (sentence.max() + 1) + sentence, return_inverse=True)
    votes = np.stack([np.bincount(at, part[:, c], minlength=len(name)) for c in range(part.shape[1] - 1)], 1)
    best = votes.argmax(1)
    ok = votes[np.arange(len(name)), best] >= 0.5
    return name[ok] // (sentence.max() + 1), best[ok]


def assign(model: SubjectModel, occurrences: DataFrame, key: str = "doc_id", share: float = 0.25) -> DataFrame:
    """(key, subject, share): subjects of at least ``share`` of those sentences of the document that treat any.

    Documents whose text is null, blank, junk or treats no subject have no row. A key in several rows
    has the subjects of each.
    """
    shared = occurrences.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            row, subject = sentence_subjects(m, b)
            table = np.zeros((b.num_rows, len(m.subjects)))
            np.add.at(table, (row, subject), 1)
            part = table / np.maximum(table.sum(1, keepdims=True), 1)
            d, s = np.nonzero((part >= share - 1e-9) & (table > 0))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(d)), pa.array([m.subjects[i] for i in s], pa.string()), pa.array(part[d, s])], names=["k", "subject", "share"])

    kind = dict(occurrences.dtypes)["k"]
    return occurrences.mapInArrow(run, f"k {kind}, subject string, share double").withColumnRenamed("k", key)
