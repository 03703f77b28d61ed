"""The weak-label classifier against held-out labels and a direct computation."""

import collections
import re

import numpy as np
import pytest

from streamcheck.llm import queries
from streamcheck.llm.quality import BIG, FALSE_ALARM, LABELLERS, classify, estimate, fit, keep_good, pattern

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    got = queries.op6_quality(spark, DATA).collect()
    assert len(got) == 1000
    own = [r for r in got if r.doc_id in labels]
    assert np.mean([r.kept == bool(labels[r.doc_id]) for r in own]) > 0.98
    assert np.mean([r.kept for r in own if labels[r.doc_id]]) > 0.99


def test_estimate_recovers_accuracies():
    rng, m = np.random.default_rng(2), len(LABELLERS)
    good = rng.random(20000) < 0.8
    miss, alarm, silent = rng.uniform(0.2, 0.7, m), rng.uniform(0.001, 0.018, m), rng.uniform(0.0, 0.5, m)
    bad_vote = np.where(good[:, None], rng.random((20000, m)) < alarm, rng.random((20000, m)) >= miss)
    votes = np.where(rng.random((20000, m)) < silent, 1, np.where(bad_vote, 0, 2))
    patterns, which, counts = np.unique(pattern(votes), return_inverse=True, return_counts=True)
    p, tables = estimate(patterns, counts)
    assert ((p[which] >= 0.5) == good).mean() > 0.97
    assert np.abs(tables[0, :, 0] - (1 - miss)).max() < 0.06 and np.abs(tables[1, :, 0] - alarm).max() < 0.01


@pytest.mark.parametrize("rows", [[], [(None, None, None)], [(1, "", "k"), (2, " \n", "k"), (3, None, "k")]])
def test_nothing_to_score(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = classify(df).collect()
    assert len(got) == len(rows) and not any(r.kept for r in got) and all(r.score == 0 for r in got)
    assert keep_good(df).count() == 0


def test_rows_and_columns(spark):
    base = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [(i, t, "s") for i, t in base] + [(None, base[0][1], "s"), (base[0][0], base[0][1], "s"), (9999, "plain words go on. " * 40000, "s"), (5000, None, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").select("score", "text", "doc_id")
    scored, kept = classify(df).collect(), keep_good(df)
    assert len(scored) == len(rows) and kept.columns == ["score", "text", "doc_id"]
    assert sorted((r.doc_id for r in scored if r.kept), key=str) == sorted((r.doc_id for r in kept.collect()), key=str)
    assert len({r.score for r in scored if r.doc_id in (None, base[0][0])}) == 1


PUNCTUATION = {chr(c) for c in range(33, 127) if not chr(c).isalnum()}


def plain_votes(text):
    """Votes of all labellers on one text, word by word."""
    words = [w.lower() for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode())]
    shown = [w.decode("latin-1") for w in re.findall(rb"[^\x20\x09-\x0D]+", text.encode())]
    n, letters = len(words), "".join(shown)
    marked = [len(w) > 1 and w[-1] in PUNCTUATION and w[-2] == w[-1] for w in shown]
    found = {
        "odd": sum(c in PUNCTUATION - set(".,;:'\"!?()-") for c in letters) / len(letters),
        "marked": sum(marked) / n,
        "upper": sum("A" <= c <= "Z" for c in letters) / max(1, sum(c.isascii() and c.isalpha() for c in letters)),
        "variety": len(set(words)) / n,
        "stutter": sum(a == b for a, b in zip(words, words[1:])) / n,
        "stops": sum(w[-1] in ".!?" and not m for w, m in zip(shown, marked)) / n,
        "length": len(letters) / n,
        "lone": sum(all(c in PUNCTUATION for c in w) for w in shown) / n,
        "alternate": sum(a == b for a, b in zip(words, words[2:])) / n,
        "top": max(collections.Counter(words).values()) / n,
    }
    votes = []
    for measure, low, good_low, good_high, high in LABELLERS.values():
        m = found[measure]
        if n < BIG:
            votes.append(1)
        elif (low is not None and m < low) or (high is not None and m > high):
            votes.append(0)
        else:
            votes.append(2 if (good_low is None or m >= good_low) and (good_high is None or m <= good_high) else 1)
    return votes


def plain_posterior(counted, rounds):
    """Expectation-maximisation vote by vote: probability good of each tuple of votes."""
    balance = lambda v: v.count(2) - v.count(0)
    good = {v: 0.9 if balance(v) > 0 else 0.1 if balance(v) < 0 else 0.5 for v in counted}
    everyone = sum(counted.values())
    for _ in range(rounds):
        mass, share = [0.0, 0.0], [[[0.5, 0.5] for _ in LABELLERS] for _ in range(2)]
        for v, c in counted.items():
            for kind, p in ((0, 1 - good[v]), (1, good[v])):
                mass[kind] += c * p
                for j, said in enumerate(v):
                    if said != 1:
                        share[kind][j][said // 2] += c * p
        bad = [[a / (a + b) for a, b in share[kind]] for kind in range(2)]
        bad[1] = [min(a, FALSE_ALARM) for a in bad[1]]
        for v in counted:
            likely = [(mass[kind] + 1) / (everyone + 2) for kind in range(2)]
            for kind in range(2):
                for j, said in enumerate(v):
                    likely[kind] *= 1 if said == 1 else bad[kind][j] if said == 0 else 1 - bad[kind][j]
            good[v] = likely[1] / (likely[0] + likely[1])
    return good


def test_weak_labels_equal_a_plain_computation(spark):
    """Votes, counts over all documents and posteriors of the registered query's operator against plain Python."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = {r.doc_id: tuple(plain_votes(r.text)) for r in docs.collect() if r.text and r.text.split()}
    want = plain_posterior(collections.Counter(own.values()), 200)
    got = {r.doc_id: r for r in queries.op6_quality(spark, "/root/testdata/sf0.001").collect()}
    assert len(set(own.values())) > 3 and len(got) == docs.count()
    assert all(abs(got[i].weak_label - want[v]) < 1e-6 for i, v in own.items())
    assert all(r.kept == (r.score >= 0.5 and r.n_words > 0) for r in got.values())


def test_ties_at_the_threshold_are_kept(spark):
    """A score equal to the threshold keeps the document; without a training sample all scores are the bias's."""
    df = spark.createDataFrame([(i, f"one two three {i}") for i in range(6)], "doc_id long, text string")
    score = 1 / (1 + np.exp(-fit(df, train_rows=0).bias))
    for threshold, kept in ((score, True), (np.nextafter(score, 1), False)):
        assert [r.kept for r in classify(df, threshold=threshold, train_rows=0).collect()] == [kept] * 6
        assert keep_good(df, threshold=threshold, train_rows=0).count() == 6 * kept


def test_copies_of_one_row_are_sampled_by_row(spark):
    """A row that repeats is neither all in the sample nor all out of it."""
    text = "A plain sentence of some length about nothing in particular, with words that follow each other."
    df = spark.range(0, 30_000, 1, 4).selectExpr("1L AS doc_id", f"'{text}' AS text")
    got = classify(df, train_rows=500)
    assert got.count() == 30_000 and got.select("score").distinct().count() == 1
