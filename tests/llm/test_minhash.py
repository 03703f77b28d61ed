"""Circulant MinHash near-deduplication against all pairs."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

from streamcheck.llm import minhash, queries
from streamcheck.llm.components import components
from streamcheck.llm.minhash import near_dedup, pi, sigma, signatures
from streamcheck.llm.shared import Scratch


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def brute(rows, k, percent):
    """{id: (n, component)} for distinct ids, by all pairs of distinct sets."""
    sets = {i: shingles(t, k) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_set = {}
    for i, s in sorted(sets.items()):
        if s:
            first = by_set.setdefault(s, i)
            parent[i] = first
    for (a, i), (b, j) in combinations(by_set.items(), 2):
        if len(a) * 100 >= percent * len(b) and len(b) * 100 >= percent * len(a) and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(rng, base, n, changes):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(changes):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def corpus(seed):
    rng = random.Random(seed)
    texts = []
    for f in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 80, 300]))]
        texts += family(rng, base, 8, rng.choice([1, 2, 4])) + [" ".join(base)] * 3 + [" ".join(base).upper()]
    chain = [f"c{i}" for i in range(200)]
    for step in range(12):  # neighbours are linked, the ends are not
        texts.append(" ".join(chain[step * 6 : step * 6 + 100]))
    texts += ["", None, " \n\t", "one", "One", "one two", "a b c", "a b c", "é É", "long " * 20000, " ".join(f"v{i}" for i in range(15000))]
    texts += [" ".join(f"r{rng.randrange(10**6)}" for _ in range(60)) for _ in range(60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,k,cell", [(1, 4, 1000), (2, 5, 1000), (3, 5, 4)])
def test_equals_all_pairs(spark, seed, k, cell):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, keys string, id int").repartition(6)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(df, words=k, cell=cell).collect()}
    assert got == brute(rows, k, 80)


def test_links_that_hubs_miss(spark):
    """With hubs that link nothing, the cells alone still find every link."""
    rows = [r for r in corpus(5) if r[0] % 2]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    keep, minhash.may_match = minhash.may_match, lambda pairs, least: pairs.select("a", "b").where("a < b and b < 0")
    try:
        for cell in (1000, 5):
            got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup(df, words=4, cell=cell).collect()}
            assert got == brute(rows, 4, 80)
    finally:
        minhash.may_match = keep


def test_nulls_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, None), (2, None), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, near_dedup(df).collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (2, 0, 2, True), (2, 0, 2, True), (None, 0, None, True)], key=str)
    assert near_dedup(df.limit(0)).count() == 0


def test_query_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op10_minhash(spark, "/root/testdata/sf0.01").collect()}
    want = brute(rows, 4, 80)
    assert got == {i: (n, c, c == i) for i, (n, c) in want.items()}
    assert len({c for _, c in want.values()}) < len(rows) - 20


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    for f in (pi, sigma):
        x = rng.integers(0, 2**32, 10**6, dtype=np.uint64)
        y = f(x.astype(np.uint32)) if f is pi else f(x)
        assert len(np.unique(y)) == len(np.unique(x))
    errors = []
    for j in (0.5, 0.8, 0.9):
        for _ in range(60):
            v = rng.integers(0, 2**64, 600, dtype=np.uint64)
            same = int(2 * 300 * j / (1 + j))
            a, b = v[:300], np.concatenate([v[:same], v[300 : 600 - same]])
            s = signatures(np.concatenate([a, b]), np.array([0, 300, 600]), 100)
            errors.append((s[0] == s[1]).mean() - same / (600 - same))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, 500 + i) for i in range(300)] + [(rng.randrange(1000, 1400), rng.randrange(1000, 1400)) for _ in range(300)] + [(5, 5), (None, 3)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), "c").collect()}
    assert got == {v: find(v) for v in parent if find(v) != v}
