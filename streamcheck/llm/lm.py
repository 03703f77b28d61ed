"""Hidden Markov language model over word classes, trained by Baum-Welch on all documents.

1. *Blocks.*  A pass over the texts codes each block of documents as local word numbers and
   one list of its distinct words with their training counts.
2. *Counts.*  Words meet by hash in one shuffle whose rows are distinct words of blocks, not
   tokens; each gets its count over all training documents and goes back to its block.  No
   vocabulary is ever broadcast or gathered.
3. *Classes.*  A word that makes up 1/16384 of all training tokens (at most 16384 words) has a
   class of its own up to hash collisions; rarer words share a class by their ending; words
   unseen in training are one more.  The number of classes is fixed.
4. *Baum-Welch.*  Every pass maps the coded documents to expected counts of states, transitions
   and (state, class) emissions, which Spark sums over all partitions; the sums, of fixed
   size, make the next parameters.  Passes go on until the likelihood stops improving.
5. *Scores.*  The scaled forward recursion gives each document's exact likelihood.

P(word | state) = P(class | state) * q(word) / q(class), with q the smoothed unigram model, so
state probabilities are over the same V + 1 events as the unigram's: V words and "unseen".
The unseen event has the mass of words seen once (Good-Turing), at least the unigram's.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamcheck.llm import textkit
from streamcheck.llm.bpe import ragged
from streamcheck.llm.shared import Scratch

STATES, GAIN = 6, 1e-4  # GAIN: the least log10 likelihood per training token that a pass must add
FREQUENT, ENDINGS = 28672, 4095
UNSEEN = FREQUENT + ENDINGS
CLASSES = UNSEEN + 1
SHARE = 16384
ALPHA = 0.1
BLOCK_BYTES, PIECE, BATCH_TOKENS = 12 << 20, 256, 1 << 18
END = np.uint64(0x454E44)  # the end of a text, as a word; no word hashes to it but by chance


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 10 == 0, F.lit(False))


def code_blocks(docs: DataFrame) -> DataFrame:
    """docs: (id, text, held).  One row per block: its documents, and its distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for i, j, data, starts, ends, first, hashes in textkit.text_groups(batch.column(1), lower=True, most=BLOCK_BYTES):
                held = batch.column(2).slice(i, j - i).to_numpy(zero_copy_only=False).astype(bool)
                tails = textkit.hash_words(data, np.maximum(starts, ends - 3), ends, lower=True)
                tokens, tails = np.insert(hashes, first[1:], END), np.insert(tails, first[1:], END)
                n = np.diff(first) + 1
                words, at, local = np.unique(tokens, return_index=True, return_inverse=True)
                counts = np.bincount(local, weights=np.repeat(~held, n), minlength=len(words)).astype(np.int64)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([base + k]),
                    "ids": pa.array([batch.column(0).slice(i, j - i).to_pylist()], pa.list_(pa.int64())),
                    "held": pa.array([held.tolist()], pa.list_(pa.bool_())),
                    "n": pa.array([n], pa.list_(pa.int64())),
                    "local": pa.array([local.astype("<u4").tobytes()]),
                    "words": pa.array([words.tobytes()]),
                    "counts": pa.array([counts.astype("<u4").tobytes()]),
                    "endings": pa.array([(tails[at] % np.uint64(ENDINGS)).astype("<u2").tobytes()]),
                })
                k += 1

    return docs.select("id", "text", "held").mapInArrow(run, "block bigint, ids array<bigint>, held array<boolean>, n array<bigint>, local binary, words binary, counts binary, endings binary")


def block_words(blocks: DataFrame) -> DataFrame:
    """(block, at, word, n, ending): a row for each distinct word of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, counts, endings in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                word, n, ending = np.frombuffer(words, np.int64), np.frombuffer(counts, "<u4"), np.frombuffer(endings, "<u2")
                for lo in range(0, len(word), 1 << 16):
                    part = slice(lo, lo + (1 << 16))
                    size = len(word[part])
                    yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(size, block)), "at": pa.array(np.arange(lo, lo + size, dtype=np.int32)), "word": pa.array(word[part]), "n": pa.array(n[part].astype(np.int64)), "ending": pa.array(ending[part].astype(np.int32))})

    return blocks.select("block", "words", "counts", "endings").mapInArrow(run, "block bigint, at int, word bigint, n bigint, ending int")


def class_of(count: Column, bucket: Column, ending: Column, tokens: int) -> Column:
    return F.when(count == 0, F.lit(UNSEEN)).when(count * SHARE >= tokens, bucket).otherwise(ending + FREQUENT)


@dataclass
class Corpus:
    tokens: int  # N
    words: int  # V
    once: int  # words seen once
    class_mass: np.ndarray  # q(class)

    @property
    def norm(self) -> float:
        return self.tokens + ALPHA * (self.words + 1)


def code_documents(blocks: DataFrame, words: DataFrame, corpus: Corpus) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, base_score, rest, classes): ``rest`` is the log10 of q(word) / q(class) over the text."""
    with np.errstate(divide="ignore"):
        log_mass = np.where(corpus.class_mass > 0, np.log10(corpus.class_mass), 0.0)
    norm = corpus.norm

    def run(block: pa.Table, word: pa.Table) -> pa.Table:
        local = np.frombuffer(block["local"][0].as_py(), "<u4")
        count, kind = np.zeros(word.num_rows), np.zeros(word.num_rows, dtype=np.uint16)
        at = word["at"].to_numpy()
        count[at], kind[at] = word["c"].to_numpy(), word["kind"].to_numpy()
        n = block["n"].combine_chunks().flatten().to_numpy()
        log_q = np.log10((count + ALPHA) / norm)
        first = np.cumsum(n) - n
        kinds, raw = kind[local].astype("<u2"), None
        base = np.add.reduceat(log_q[local], first)
        rest = np.add.reduceat((log_q - log_mass[kind])[local], first)
        known = np.add.reduceat((count > 0)[local].astype(np.int64), first)
        raw, cuts = kinds.tobytes(), (np.append(first, len(local)) * 2).tolist()
        return pa.table({
            "doc_id": block["ids"].combine_chunks().flatten(),
            "held_out": block["held"].combine_chunks().flatten(),
            "n_tokens": pa.array(n),
            "n_known": pa.array(known),
            "base_score": pa.array(base),
            "rest": pa.array(rest),
            "classes": pa.array([raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        })

    def cogrouped(left: pa.Table, right: pa.Table) -> pa.Table:
        return run(left, right)

    own = blocks.select("block", "ids", "held", "n", "local").groupBy("block")
    return own.cogroup(words.select("block", "at", "c", "kind").groupBy("block")).applyInArrow(cogrouped, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, rest double, classes binary")


# ---- the hidden Markov model


@dataclass
class Model:
    start: np.ndarray  # [state]
    move: np.ndarray  # [state, state]
    emit: np.ndarray  # [class, state]


@dataclass
class Expected:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log: float = 0.0

    @staticmethod
    def zero(states: int) -> Expected:
        return Expected(np.zeros(states), np.zeros((states, states)), np.zeros((CLASSES, states)))


def by_time(n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token index in time order, active sequences at each time); sequences must be sorted by falling length."""
    active = np.searchsorted(-n, -np.arange(n.max()), side="left")
    docs = ragged(np.zeros(len(active), np.int64), active)
    return first[docs] + np.repeat(np.arange(len(active)), active), active


def add_expected(model: Model, tokens: np.ndarray, n: np.ndarray, total: Expected, begins: np.ndarray | None = None) -> None:
    """Forward-backward over sequences of classes laid end to end; all have a token.  Those that ``begins`` marks count for the start."""
    order = np.argsort(-n, kind="stable")
    index, active = by_time(n[order], (np.cumsum(n) - n)[order])
    classes = tokens[index]
    b, at = model.emit[classes], np.concatenate([[0], np.cumsum(active)])
    alpha, scale = np.empty_like(b), np.empty(len(b))
    for t in range(len(active)):
        now = slice(at[t], at[t + 1])
        a = b[now] * (model.start if t == 0 else alpha[at[t - 1] : at[t - 1] + active[t]] @ model.move)
        scale[now] = s = a.sum(axis=1)
        alpha[now] = a / s[:, None]
    beta, pairs = np.ones_like(b), np.zeros_like(model.move)
    for t in range(len(active) - 2, -1, -1):
        nxt, m = slice(at[t + 1], at[t + 2]), active[t + 1]
        ahead = b[nxt] * beta[nxt] / scale[nxt, None]
        beta[at[t] : at[t] + m] = ahead @ model.move.T
        pairs += alpha[at[t] : at[t] + m].T @ ahead
    gamma = alpha * beta
    total.move += pairs * model.move
    total.start += (gamma[: active[0]] if begins is None else gamma[: active[0]][begins[order]]).sum(axis=0)
    for k in range(gamma.shape[1]):
        total.emit[:, k] += np.bincount(classes, gamma[:, k], CLASSES)
    total.log += float(np.log(scale).sum())


def pieces(lengths: np.ndarray, most: int = PIECE) -> np.ndarray:
    """Lengths of training sequences: documents, cut into pieces where longer than ``most``."""
    whole, left = lengths // most, lengths % most
    out = np.full(int((whole + (left > 0)).sum()), most, dtype=np.int64)
    out[(np.cumsum(whole + (left > 0)) - 1)[left > 0]] = left[left > 0]
    return out


def expect(model: Model, columns: list[bytes], total: Expected) -> None:
    tokens = np.frombuffer(b"".join(columns), "<u2").astype(np.int64)
    whole = np.array([len(c) // 2 for c in columns], dtype=np.int64)
    n = pieces(whole)
    ends = np.cumsum(n)
    begins = np.isin(ends - n, np.cumsum(whole) - whole)  # a later piece of a document tells nothing of how one starts
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] - n[i] + BATCH_TOKENS)))
        add_expected(model, tokens[ends[i] - n[i] : ends[j - 1]], n[i:j], total, begins[i:j])
        i = j


def maximise(found: Expected, corpus: Corpus) -> Model:
    """Next parameters; emissions are smoothed towards the unigram's classes."""
    unseen = min(0.5, max(ALPHA / corpus.norm, corpus.once / max(corpus.tokens, 1)))
    prior = corpus.class_mass.copy()
    prior[UNSEEN] = 0
    prior /= max(prior.sum(), 1e-300)
    strength = 1 + 1e-4 * found.emit.sum()
    emit = found.emit + strength * prior[:, None]
    emit[UNSEEN] = 0
    emit *= (1 - unseen) / np.maximum(emit.sum(axis=0), 1e-300)
    emit[UNSEEN] = unseen
    move = found.move + 0.1
    return Model((found.start + 0.1) / (found.start + 0.1).sum(), move / move.sum(axis=1, keepdims=True), emit)


def first_model(corpus: Corpus, states: int) -> Model:
    """Start values: slightly different emissions and lasting states."""
    noise = np.random.Generator(np.random.PCG64(7)).gamma(2.0, 0.5, (CLASSES, states))
    return maximise(Expected(np.ones(states), 50 * np.eye(states) + 1, corpus.class_mass[:, None] * noise * corpus.tokens), corpus)


def baum_welch_pass(coded: DataFrame, model: Model, corpus: Corpus) -> tuple[Model, float]:
    """One pass over all training documents: (next model, log10 likelihood under this one)."""
    states = len(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Expected.zero(states)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                expect(model, batch.column(0).slice(lo, 1000).to_pylist(), total)
        at = np.flatnonzero(total.emit.any(axis=1))
        rows = np.concatenate([total.emit[at], total.start[None], total.move, np.full((1, states), total.log)])
        kind = np.concatenate([at, -1 - np.arange(states + 2)])
        yield pa.RecordBatch.from_pydict({"kind": pa.array(kind.astype(np.int32))} | {f"g{k}": pa.array(rows[:, k]) for k in range(states)})

    summed = coded.where("not held_out").select("classes").mapInArrow(run, "kind int, " + ", ".join(f"g{k} double" for k in range(states)))
    table = summed.groupBy("kind").agg(*[F.sum(f"g{k}").alias(f"g{k}") for k in range(states)]).toArrow()  # at most CLASSES + states + 2 rows
    kind, values = table["kind"].to_numpy(), np.column_stack([table[f"g{k}"].to_numpy() for k in range(states)])
    found = Expected.zero(states)
    found.emit[kind[kind >= 0]] = values[kind >= 0]
    for k, row in zip(kind[kind < 0].tolist(), values[kind < 0], strict=True):
        if k == -1:
            found.start = row
        elif k == -states - 2:
            found.log = float(row[0])
        else:
            found.move[-2 - k] = row
    return maximise(found, corpus), found.log / np.log(10)


def train(coded: DataFrame, corpus: Corpus, states: int, gain: float) -> Model:
    """Passes over all training documents until one adds less than ``gain`` per token to the log10 likelihood."""
    model, last = first_model(corpus, states), -np.inf
    while corpus.tokens:
        following, log = baum_welch_pass(coded, model, corpus)
        if log - last < gain * corpus.tokens:
            break
        model, last = following, log
    return model


def log_likelihood(model: Model, columns: list[bytes]) -> np.ndarray:
    """log10 likelihood of each whole sequence, by the scaled forward recursion."""
    n = np.array([len(c) // 2 for c in columns], dtype=np.int64)
    order = np.argsort(-n, kind="stable")
    tokens = np.frombuffer(b"".join(columns), "<u2")
    first = (np.cumsum(n) - n)[order]
    active = np.searchsorted(-n[order], -np.arange(n.max(initial=0)), side="left")
    out = np.zeros(len(n))
    alpha = None
    for t, m in enumerate(active.tolist()):
        a = model.emit[tokens[first[:m] + t]] * (model.start if alpha is None else alpha[:m] @ model.move)
        s = a.sum(axis=1)
        out[:m] += np.log10(s)
        alpha = a / s[:, None]
    result = np.empty(len(n))
    result[order] = out
    return result


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held: Column | None = None, states: int = STATES, gain: float = GAIN) -> DataFrame:
    """Train on the documents that ``held`` (by default a tenth, by id) leaves, and score all.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case, then one end, which counts as a
    token.  Returns one row per input row: ``doc_id`` (``id_col`` as an integer), ``held_out``,
    ``n_tokens``, ``n_known`` (tokens seen in training), ``train_tokens``, ``base_score`` (log10
    probability under the add-0.1 unigram model) and ``score`` (under the hidden Markov model).
    Null text is empty and has its end alone; repeated rows count each; rows without an id
    train.  Other columns are not read; no rows, no result.
    """
    scratch = Scratch(docs.sparkSession, "lm")
    held = held_out(id_col) if held is None else held
    blocks = scratch.write(code_blocks(docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), held.alias("held"))), "blocks", compression="zstd")
    # One shuffle counts and sends back; a word's group has a row per block at most, and spills.
    same = Window.partitionBy("word")
    words = block_words(blocks).select(
        "block", "at", "ending", F.expr(f"int(pmod(shiftrightunsigned(word, 20), {FREQUENT}))").alias("bucket"),
        F.sum("n").over(same).alias("c"), (F.row_number().over(same.orderBy("block")) == 1).alias("lead"),
    )
    words = scratch.write(words, "words", compression="zstd")
    lead = words.where("lead and c > 0")
    sums = lead.agg(F.sum("c").alias("n"), F.count("*").alias("v"), F.count_if(F.col("c") == 1).alias("once")).first()
    corpus = Corpus(sums.n or 0, sums.v or 0, sums.once or 0, np.zeros(CLASSES))
    kind = class_of(F.col("c"), F.col("bucket"), F.col("ending"), corpus.tokens)
    mass = lead.groupBy(kind.alias("kind")).agg(F.sum((F.col("c") + ALPHA) / corpus.norm).alias("q")).toArrow()  # at most CLASSES rows
    corpus.class_mass[mass["kind"].to_numpy()] = mass["q"].to_numpy()
    corpus.class_mass[UNSEEN] = ALPHA / corpus.norm
    coded = scratch.write(code_documents(blocks, words.withColumn("kind", kind), corpus), "coded", compression="zstd")
    scratch.drop("blocks", "words")

    model = train(coded, corpus, states, gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            likely = log_likelihood(model, batch.column(6).to_pylist())
            score = likely + batch.column(5).to_numpy() if corpus.tokens else batch.column(4).to_numpy()
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(np.full(batch.num_rows, corpus.tokens)), batch.column(4), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return coded.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
