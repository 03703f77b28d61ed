"""Removal of repeated word sequences against all windows of all documents."""

import hashlib
import random

import numpy as np
import pytest

from streamcheck.llm import queries
from streamcheck.llm.substring import checked, compacted, digest, remove_repeats, sliding_min


def brute(rows, window):
    """[(id, n_words, n_removed, sha)] for each row."""
    first = {}
    split = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in split:
        if i is not None:
            for p in range(len(words) - window + 1):
                w = tuple(words[p : p + window])
                first[w] = min(i, first.get(w, i))
    out = []
    for i, words in split:
        gone = set()
        for p in range(len(words) - window + 1):
            if i is not None and first[tuple(words[p : p + window])] < i:
                gone.update(range(p, p + window))
        kept = [w for p, w in enumerate(words) if p not in gone]
        out.append((i, len(words), len(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, window):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(40 if seed % 2 else 5000)}"
    passages = [[word() for _ in range(rng.randrange(window - 3, 4 * window))] for _ in range(8)]
    rows = []
    for i in range(150):
        words = []
        for _ in range(rng.randrange(0, 5)):
            p = rng.choice(passages)
            lo = rng.randrange(0, len(p) // 2) if rng.random() < 0.5 else 0
            part = list(p[lo : len(p) - (rng.randrange(0, len(p) // 3) if rng.random() < 0.5 else 0)])
            if rng.random() < 0.3 and part:
                part[rng.randrange(len(part))] = "changed"
            words += part + [word() for _ in range(rng.randrange(0, window))]
        rows.append((rng.randrange(10**6), rng.choice([" ", "\n", " \t "]).join(words)))
    rows += [(10**7 + i, rows[i][1]) for i in range(20)]  # copies
    rows += [(3, None), (4, ""), (5, "é ü " * window), (6, "a " * 30000), (7, "a " * 200), (None, rows[0][1]), (rows[0][0], rows[0][1]), (rows[0][0], rows[1][1])]
    return rows


@pytest.mark.parametrize("seed,window,seed_words", [(1, 50, 10), (2, 50, 10), (3, 12, 3), (4, 8, 8)])
def test_equals_all_windows(spark, seed, window, seed_words):
    rows = corpus(seed, window)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, spans int").repartition(5)
    got = remove_repeats(df, window=window, seed=seed_words).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, window)


def test_text_and_other_columns(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage + " one", "a"), (2, "two  " + passage, "b"), (3, "no  change\n", None), (4, None, "d"), (5, passage, "e")]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, start string"), keep_text=True)
    assert got.columns[:3] == ["doc_id", "text", "start"]
    assert sorted((r.doc_id, r.text, r.start) for r in got.collect()) == [(1, passage + " one", "a"), (2, "two", "b"), (3, "no  change\n", None), (4, None, "d"), (5, "", "e")]
    assert remove_repeats(got.select("doc_id", "text").limit(0)).count() == 0


def test_query_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    got = queries.op4_substring(spark, "/root/testdata/sf0.01").collect()
    want = brute(rows, 50)
    assert sorted(map(tuple, got), key=str) == want
    assert sum(r[2] > 0 for r in want) > 10


def test_compaction_joins_successors(spark):
    """a > b > c have the same copies and become one path; e follows d in some copies only, and f follows e in some."""
    name = {c: ord(c) for c in "abcdef"}
    rows = [(name[v], 0, 10, (i, start, 0), name.get(b), name.get(a)) for v, i, start, b, a in [("a", 1, 5, None, "b"), ("b", 1, 15, "a", "c"), ("c", 1, 25, "b", None), ("d", 1, 35, None, "e"), ("e", 1, 45, None, None), ("f", 2, 10, "e", None)]]
    got = compacted(spark.createDataFrame(rows, "v1 long, v2 long, n int, source struct<id: long, start: int, fp: long>, before long, after long"))
    assert sorted((r.id, r.start, r.n, chr(r.v1)) for r in got.collect()) == [(1, 5, 30, "a"), (1, 35, 10, "d"), (1, 45, 10, "e"), (2, 10, 10, "f")]


def test_long_copies_are_verified():
    words = [b"x", b"y", b"z"]
    w1, w2 = np.frombuffer(digest(b"y z"), dtype=np.int64).tolist()
    checked(words, [(1, 3, w1, w2), (0, 2, None, None)])
    with pytest.raises(ValueError):
        checked(words, [(0, 2, w1, w2)])


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 200)
    for width in (1, 2, 3, 8, 41):
        assert sliding_min(x, width).tolist() == [x[i : i + width].min() for i in range(len(x) - width + 1)]
