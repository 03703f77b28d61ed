"""Quality classifier: weak labels by expectation-maximisation, then a hashed linear scorer.

Heuristic labellers each vote good, bad or nothing on a document.  A vote pattern is a small
integer, and Spark counts the patterns over all documents; from those counts (at most
3 ** labellers rows) expectation-maximisation estimates how often each labeller votes what
for good and for bad documents, and so the probability that a pattern's documents are good.
Those probabilities train a logistic scorer over hashed words, word shapes and page shapes,
on at most ``TRAIN_ROWS`` documents.  The scorer then decides on every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamcheck.llm import textkit

#: Bound of the sample that trains the scorer (expected rows; every row where there are fewer).
TRAIN_ROWS = 6000
WORD_BITS, SHAPE_BITS, LEVELS = 15, 12, 8

_PUNCTUATION = np.zeros(256, dtype=bool)
_PUNCTUATION[[c for c in range(33, 127) if not chr(c).isalnum()]] = True
_ODD = _PUNCTUATION.copy()
_ODD[[ord(c) for c in ".,;:'\"!?()-"]] = False
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?"]] = True

#: name: (measure, bad when below, good from, good up to, bad when above); None: no such vote.
LABELLERS = {
    "odd_symbols": ("odd", None, None, 0.01, 0.05),
    "marked_words": ("marked", None, None, 0.02, 0.10),
    "capitals": ("upper", None, None, 0.20, 0.50),
    "variety": ("variety", 0.12, 0.30, None, None),
    "stutter": ("stutter", None, None, 0.02, 0.10),
    "sentences": ("stops", 0.005, 0.02, 0.40, None),
    "word_length": ("length", 2.0, 3.0, 14.0, 25.0),
    "lone_symbols": ("lone", None, None, 0.01, 0.15),
    "alternation": ("alternate", None, None, 0.06, 0.20),
    "top_word": ("top", None, None, 0.20, 0.30),
}
MEASURES = [x[0] for x in LABELLERS.values()]
#: A labeller calls at most this share of good documents bad.  Without the bound, labellers
#: that see the same defect can make that defect the second class and take others for good.
FALSE_ALARM = 0.02
BIG = 20  # labellers of proportions say nothing on documents of fewer words than this


def measure(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(measures by document, words by document, shape code by word)."""
    n = np.diff(first)
    docs = np.repeat(np.arange(len(n)), n)

    def per_doc(x: np.ndarray) -> np.ndarray:
        return np.bincount(docs, weights=x, minlength=len(n))

    lo, hi = (int(starts[0]), int(ends[-1])) if len(starts) else (0, 0)
    raw = data[lo:hi]

    def in_words(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags[raw])])
        return sums[ends - lo] - sums[starts - lo]

    length = (ends - starts).astype(np.float64)
    letters, upper, odd, marks, digits = (in_words(f) for f in (_LETTER, _UPPER, _ODD, _PUNCTUATION, _DIGIT))
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    second = np.where(length > 1, data[np.maximum(ends - 2, 0)] if len(ends) else 0, 0)
    marked = _PUNCTUATION[last] & (second == last)
    lone = (marks == length).astype(np.float64)
    again = np.zeros(len(hashes))
    if len(hashes) > 1:
        again[1:] = (hashes[1:] == hashes[:-1]) & (docs[1:] == docs[:-1])
    alternate = np.zeros(len(hashes))
    if len(hashes) > 2:
        alternate[2:] = (hashes[2:] == hashes[:-2]) & (docs[2:] == docs[:-2])
    order = np.lexsort((hashes, docs))
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (docs[order[1:]] != docs[order[:-1]])
    heads = np.flatnonzero(new)
    distinct, top = np.bincount(docs[order[heads]], minlength=len(n)), np.zeros(len(n))
    np.maximum.at(top, docs[order[heads]], np.diff(np.append(heads, len(hashes))))
    total, size = np.maximum(n, 1), np.maximum(per_doc(length), 1)
    found = {
        "odd": per_doc(odd) / size,
        "marked": per_doc(marked) / total,
        "upper": per_doc(upper) / np.maximum(per_doc(letters), 1),
        "variety": distinct / total,
        "stutter": per_doc(again) / total,
        "stops": per_doc(_STOP[last] & ~marked) / total,
        "length": size / total,
        "lone": per_doc(lone) / total,
        "alternate": per_doc(alternate) / total,
        "top": top / total,
    }
    caps = np.where(upper == 0, 0, np.where(upper == 1, 1, np.where(upper < letters, 2, 3)))
    tail = np.where(_PUNCTUATION[last], last, 0).astype(np.uint64)
    shape = textkit.mix(tail * np.uint64(64) + marked.astype(np.uint64) * np.uint64(32) + caps.astype(np.uint64) * np.uint64(8) + (digits > 0).astype(np.uint64) * np.uint64(4) + (lone > 0).astype(np.uint64) * np.uint64(2))
    return np.column_stack([found[m] for m in MEASURES]), n, shape


def vote(measures: np.ndarray, words: np.ndarray) -> np.ndarray:
    """(documents, labellers) of 0 bad, 1 nothing, 2 good."""
    votes = np.ones(measures.shape, dtype=np.int64)
    for j, (_, bad_below, good_from, good_to, bad_above) in enumerate(LABELLERS.values()):
        x = measures[:, j]
        good = np.ones(len(x), dtype=bool)
        if good_from is not None:
            good &= x >= good_from
        if good_to is not None:
            good &= x <= good_to
        bad = np.zeros(len(x), dtype=bool)
        if bad_below is not None:
            bad |= x < bad_below
        if bad_above is not None:
            bad |= x > bad_above
        votes[good, j], votes[bad, j] = 2, 0
    votes[words < BIG] = 1
    return votes


def pattern(votes: np.ndarray) -> np.ndarray:
    return votes @ (3 ** np.arange(votes.shape[1]))


def unpack(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(probability good by pattern, labeller tables [class, labeller, bad or good vote]) by expectation-maximisation.

    Starts at the majority of votes, so that class 1 is what most labellers call good.
    """
    votes = unpack(patterns)
    balance = (votes - 1).sum(axis=1)
    good = np.where(balance > 0, 0.9, np.where(balance < 0, 0.1, 0.5))
    tables = np.full((2, votes.shape[1], 2), 0.5)
    spoken = [(votes == 0).astype(np.float64), (votes == 2).astype(np.float64)]  # to say nothing tells nothing
    for _ in range(rounds):
        weight = np.stack([(1 - good) * counts, good * counts])
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        for v in range(2):
            tables[:, :, v] = weight @ spoken[v] + 0.5
        tables /= tables.sum(axis=2, keepdims=True)
        tables[1, :, 0] = np.minimum(tables[1, :, 0], FALSE_ALARM)
        tables[1, :, 1] = 1 - tables[1, :, 0]
        log = np.log(prior)[:, None] + np.stack([sum(spoken[v] @ np.log(tables[c, :, v]) for v in range(2)) for c in (0, 1)])
        good = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
    return good, tables


@dataclass
class Features:
    """Hashed features of a group of documents: one (document, column, weight) per entry."""

    doc: np.ndarray
    column: np.ndarray
    weight: np.ndarray

    WIDTH = (1 << WORD_BITS) + (1 << SHAPE_BITS) + LEVELS * len(LABELLERS)


def features(measures: np.ndarray, words: np.ndarray, shape: np.ndarray, hashes: np.ndarray) -> Features:
    docs = np.repeat(np.arange(len(words)), words)
    share = 1.0 / np.maximum(words, 1)[docs]
    word = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    form = (shape >> np.uint64(64 - SHAPE_BITS)).astype(np.int64) + (1 << WORD_BITS)
    scale = np.column_stack([measures[:, j] * (1.0 if m == "length" else 50.0) for j, m in enumerate(MEASURES)])
    level = np.minimum(np.log2(1 + scale), LEVELS - 1).astype(np.int64) + np.arange(len(LABELLERS)) * LEVELS + (1 << WORD_BITS) + (1 << SHAPE_BITS)
    each = np.repeat(np.arange(len(words)), len(LABELLERS))
    return Features(np.concatenate([docs, docs, each]), np.concatenate([word, form, level.ravel()]), np.concatenate([share * 4, share * 4, np.full(level.size, 0.25)]))


def train(doc: np.ndarray, column: np.ndarray, weight: np.ndarray, target: np.ndarray, epochs: int = 150, rate: float = 0.15, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer on soft targets; full-batch Adam."""
    w, b, n = np.zeros(Features.WIDTH + 1), 0.0, len(target)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, epochs + 1):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(doc, weight * w[column], n) + w[-1], -30, 30)))
        g = np.empty_like(w)
        g[:-1] = np.bincount(column, weight * (p - target)[doc], Features.WIDTH) / n + decay * w[:-1]
        g[-1] = (p - target).mean()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w[:-1], float(w[-1] + b)


@dataclass
class QualityModel:
    patterns: np.ndarray
    good: np.ndarray
    tables: np.ndarray
    weights: np.ndarray
    bias: float

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.patterns, patterns), max(len(self.patterns) - 1, 0))
        return np.where(self.patterns[at] == patterns, self.good[at], 0.5) if len(self.patterns) else np.full(len(patterns), 0.5)

    def score(self, found: Features, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.bincount(found.doc, found.weight * self.weights[found.column], n) + self.bias, -30, 30)))


def groups(column: pa.Array) -> Iterator[tuple]:
    for i, j, data, starts, ends, first, hashes in textkit.text_groups(column, lower=True):
        yield i, j, hashes, *measure(data, starts, ends, first, hashes)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Vote counts cover every document; the scorer sees a hash sample of about ``train_rows`` documents at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(3 ** len(LABELLERS), dtype=np.int64)
        for batch in batches:
            for _, _, _, measures, words, _ in groups(batch.column(0)):
                seen += np.bincount(pattern(vote(measures, words))[words > 0], minlength=len(seen))
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"pattern": pa.array(at), "n": pa.array(seen[at])})

    counted = docs.select(text_col).mapInArrow(count, "pattern bigint, n bigint").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toPandas()
    patterns, counts = counted["pattern"].to_numpy(np.int64), counted["n"].to_numpy(np.int64)
    if not len(patterns):
        return QualityModel(patterns, np.zeros(0), np.zeros((2, len(LABELLERS), 2)), np.zeros(Features.WIDTH), 0.0)
    good, tables = estimate(patterns, counts)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, j, hashes, measures, words, shape in groups(batch.column(0)):
                found = features(measures, words, shape, hashes)
                key = found.doc * Features.WIDTH + found.column
                cell, which = np.unique(key, return_inverse=True)
                weight, doc = np.bincount(which, found.weight).astype(np.float32), cell // Features.WIDTH
                column, bounds = (cell % Features.WIDTH).astype(np.int32), np.searchsorted(doc, np.arange(len(words) + 1))
                rows = [(int(p), column[a:b].tobytes(), weight[a:b].tobytes()) for p, n, a, b in zip(pattern(vote(measures, words)), words, bounds[:-1], bounds[1:], strict=True) if n]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["pattern", "columns", "weights"])

    share = min(1.0, train_rows / int(counts.sum()))
    # By row, so that copies of a row are neither all in nor all out.
    picked = F.shiftrightunsigned(F.xxhash64(F.col(id_col), F.col(text_col), F.monotonically_increasing_id()), 1) < min(int(share * 2.0**63), 2**63 - 1)
    rows = docs.where(picked).select(text_col).mapInArrow(sample, "pattern bigint, columns binary, weights binary").toArrow()
    columns = [np.frombuffer(x, np.int32) for x in rows.column("columns").to_pylist()]
    weight = [np.frombuffer(x, np.float32) for x in rows.column("weights").to_pylist()]
    model = QualityModel(patterns, good, tables, np.zeros(Features.WIDTH), float(np.log((good @ counts + 1) / ((1 - good) @ counts + 1))))
    if not columns and train_rows:
        raise ValueError("no document was sampled to train the scorer")
    if columns:
        doc = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
        model.weights, model.bias = train(doc, np.concatenate(columns), np.concatenate(weight), model.posterior(rows.column("pattern").to_numpy()))
    return model


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Score every document with a model fitted to the same documents.

    Returns one row per input row: ``id_col``, ``n_words``, ``weak_label`` (probability good by
    votes alone), ``score`` (of the scorer), ``kept`` (score at or above ``threshold``).  Null,
    empty or blank text has no words, score 0 and is not kept.  Repeated rows each count and
    get equal scores; a null id is scored too; other columns are not read.
    """
    model = fit(docs, id_col, text_col, train_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, hashes, measures, words, shape in groups(batch.column(1)):
                score = np.where(words > 0, model.score(features(measures, words, shape, hashes), j - i), 0.0)
                weak = np.where(words > 0, model.posterior(pattern(vote(measures, words))), 0.0)
                yield pa.RecordBatch.from_pydict({id_col: batch.column(0).slice(i, j - i), "n_words": pa.array(words), "weak_label": pa.array(weak), "score": pa.array(score), "kept": pa.array((score >= threshold) & (words > 0))})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_words bigint, weak_label double, score double, kept boolean")


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The input rows, with their columns, that ``classify`` keeps; one map over the scan."""
    model = fit(docs, id_col, text_col, train_rows)
    others = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, hashes, measures, words, shape in groups(batch.column(0)):
                score = model.score(features(measures, words, shape, hashes), j - i)
                yield batch.slice(i, j - i).filter(pa.array((score >= threshold) & (words > 0)))

    moved = docs.select(text_col, *others)
    return moved.mapInArrow(run, moved.schema).select(*docs.columns)
