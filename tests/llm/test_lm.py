"""The hidden Markov language model against direct computations."""

import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from streamcheck.llm import lm, queries
from streamcheck.llm.lm import CLASSES, Expected, Model, add_expected, log_likelihood, pieces, score_documents

COLUMNS = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), None]


def brute(rows):
    held = [i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows]
    count = Counter(w for (_, t), h in zip(rows, held, strict=True) if not h for w in tokens(t))
    n, v = sum(count.values()), len(count)
    out = []
    for (i, t), h in zip(rows, held, strict=True):
        own = tokens(t)
        out.append((i, h, len(own), sum(w in count for w in own), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)))
    return out


def same(got, rows):
    want = sorted(brute(rows), key=str)
    got = sorted((tuple(r[c] for c in COLUMNS[:6]) for r in got), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)


def random_model(rng, states, classes):
    emit = np.zeros((CLASSES, states))
    emit[:classes] = rng.dirichlet(np.ones(classes), states).T
    return Model(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), emit)


@pytest.mark.parametrize("seed", range(4))
def test_forward_and_expected_counts(seed):
    rng = np.random.default_rng(seed)
    states, classes = 3, 5
    model = random_model(rng, states, classes)
    lengths = [1, 4, 6, 2, 4]
    seqs = [rng.integers(0, classes, n) for n in lengths]
    likely, want = [], Expected.zero(states)
    for s in seqs:
        paths = {p: model.start[p[0]] * math.prod(model.move[a, b] for a, b in itertools.pairwise(p)) * math.prod(model.emit[c, z] for c, z in zip(s, p, strict=True)) for p in itertools.product(range(states), repeat=len(s))}
        total = sum(paths.values())
        likely.append(math.log10(total))
        for p, w in paths.items():
            want.start[p[0]] += w / total
            for a, b in itertools.pairwise(p):
                want.move[a, b] += w / total
            for c, z in zip(s, p, strict=True):
                want.emit[c, z] += w / total
    assert np.allclose(log_likelihood(model, [s.astype("<u2").tobytes() for s in seqs]), likely)
    got = Expected.zero(states)
    add_expected(model, np.concatenate(seqs), np.array(lengths), got)
    for f in ("start", "move", "emit"):
        assert np.allclose(getattr(got, f), getattr(want, f))
    assert math.isclose(got.log / math.log(10), sum(likely))


def test_long_text_does_not_underflow():
    model = random_model(np.random.default_rng(1), 4, 50)
    long = np.random.default_rng(2).integers(0, 50, 200_000).astype("<u2").tobytes()
    assert -1e6 < log_likelihood(model, [long])[0] < -1e5


def test_pieces():
    assert pieces(np.array([1, 256, 257, 600])).tolist() == [1, 256, 256, 1, 256, 256, 88]


def test_training_raises_likelihood(spark):
    rng = np.random.default_rng(0)
    words = [[f"{x}{i}" for i in range(30)] for x in "ab"]
    rows = [(i, " ".join(rng.choice(words[i % 2], 40))) for i in range(400)]
    got = score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    same(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 5 * len(held)


def test_training_goes_on_until_likelihood_stops_improving(spark, monkeypatch):
    """Every round is a pass over all training documents, however many there are."""
    rng = np.random.default_rng(3)
    words = [[f"{x}{i}" for i in range(8)] for x in "abc"]
    rows = [(i, " ".join(words[(i + k // 4) % 3][rng.integers(8)] for k in range(12))) for i in range(4000)]
    passes, one = [], lm.baum_welch_pass

    def logged(coded, model, corpus):
        following, log = one(coded, model, corpus)
        passes.append((coded.where("not held_out").count(), log / corpus.tokens))
        return following, log

    monkeypatch.setattr(lm, "baum_welch_pass", logged)
    got = score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gains = np.diff([log for _, log in passes])
    assert {n for n, _ in passes} == {sum(not r.held_out for r in got)}
    assert len(gains) > 3 and (gains[:-1] >= lm.GAIN).all() and gains[-1] < lm.GAIN
    trained = [r for r in got if not r.held_out]
    assert sum(r.score for r in trained) > 0.9 * sum(r.base_score for r in trained)


def test_probabilities_sum_to_one(spark):
    """Over all words and the unseen event, whatever came before."""
    rows = [(i, f"w{i % 7} w{i % 3} rare{i}") for i in range(60)]
    vocab = sorted({w for (i, t) in rows if zlib.crc32(str(i).encode()) % 10 for w in t.split()})
    held = next(i for i in range(1000, 2000) if zlib.crc32(str(i).encode()) % 10 == 0)
    ids = [i for i in range(held, held + 20000) if zlib.crc32(str(i).encode()) % 10 == 0][: len(vocab) + 1]
    tests = [(i, w) for i, w in zip(ids, [*vocab, "never-seen"], strict=True)]
    got = {r.doc_id: r.score for r in score_documents(spark.createDataFrame(rows + tests, "doc_id long, text string")).collect()}
    end_alone = [i for i in range(10**6, 10**6 + 100) if zlib.crc32(str(i).encode()) % 10 == 0][0]
    alone = {r.doc_id: r.score for r in score_documents(spark.createDataFrame(rows + tests + [(end_alone, "")], "doc_id long, text string")).collect()}[end_alone]
    # Sum over the first word of P(word, end) is P(end at the second place) <= 1, and with P(end) at the first place all one-step mass is below one.
    assert sum(10 ** got[i] for i, _ in tests) + 10**alone <= 1 + 1e-9


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "A a É é"), (4, "A a É é"), (None, "a"), (5, "x " * 60000), *((i, "a b c. D e f") for i in range(10, 60))]
    df = spark.createDataFrame([(i, t, 1.0, "w") for i, t in rows], "doc_id long, text string, score double, word string").repartition(4)
    got = score_documents(df).collect()
    same(got, rows)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)
    assert score_documents(df.limit(0)).count() == 0


def test_query_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = queries.op1_hmm(spark, "/root/testdata/sf0.01").collect()
    same(got, rows)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > 0.95 * sum(r.base_score for r in held)
    assert lm.CLASSES < 2**16


def test_scores_equal_the_forward_sum_over_words(spark, monkeypatch):
    """score = log10 of the sum over state paths of start, moves and P(class given state) * q(word) / q(class), with the trained model."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(f"w{rng.integers(12)}" for _ in range(int(rng.integers(0, 5))))) for i in range(80)]
    kept, one = {}, lm.train

    def train(coded, corpus, states, gain):
        kept["model"], kept["corpus"] = one(coded, corpus, states, gain), corpus
        kept["classes"] = {r.doc_id: np.frombuffer(r.classes, "<u2") for r in coded.collect()}
        return kept["model"]

    monkeypatch.setattr(lm, "train", train)
    got = {r.doc_id: r for r in score_documents(spark.createDataFrame(rows, "doc_id long, text string"), states=3).collect()}
    model, corpus = kept["model"], kept["corpus"]
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1) and math.isclose(model.start.sum(), 1)
    count = Counter(w for i, t in rows if not got[i].held_out for w in tokens(t))
    for i, t in rows:
        own, classes = tokens(t), kept["classes"][i]
        q = [(count[w] + 0.1) / corpus.norm / corpus.class_mass[c] for w, c in zip(own, classes, strict=True)]
        total = sum(model.start[p[0]] * math.prod(model.move[a, b] for a, b in itertools.pairwise(p)) * math.prod(model.emit[c, z] * x for c, z, x in zip(classes, p, q, strict=True)) for p in itertools.product(range(3), repeat=len(own)))
        assert math.isclose(got[i].score, math.log10(total), rel_tol=1e-9)


def test_later_pieces_do_not_count_for_the_start():
    model = random_model(np.random.default_rng(3), 3, 5)
    text = np.random.default_rng(4).integers(0, 5, 600).astype("<u2").tobytes()
    total = Expected.zero(3)
    lm.expect(model, [text, text[:20]], total)
    assert math.isclose(total.start.sum(), 2.0)
