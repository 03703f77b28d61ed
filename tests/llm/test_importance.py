"""Importance resampling against its SQL, a plain computation and sorted suffixes."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from streamcheck.llm import importance, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def features(text, max_n, buckets):
    w = WORD.findall((text or "").translate(LOWER))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]


def plain(docs, target, max_n=1, buckets=10_000, least=20, percent=10):
    found = [(i, *features(t, max_n, buckets)) for i, t in docs]
    s, t = collections.Counter(b for _, _, f in found for b in f), collections.Counter(b for x in target for b in features(x, max_n, buckets)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    rows = []
    for i, n, f in found:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    fit = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: len(fit) * percent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_sql_and_plain_computation(spark, sf):
    import oracle

    con = oracle.duck(f"/root/testdata/{sf}")
    got = sorted((tuple(r) for r in queries.op12_importance(spark, f"/root/testdata/{sf}").collect()), key=str)
    assert got == sorted(con.execute(queries.OP12_SQL).fetchall(), key=str)
    docs, target = con.execute("SELECT doc_id, text FROM documents").fetchall(), [x for x, in con.execute("SELECT text FROM benchmark").fetchall()]
    assert got == plain(docs, target)


def test_edges(spark):
    long = " ".join(f"w{k % 50}" for k in range(40_000))
    docs = [(k, " ".join(["Alpha beta"] * (5 + k))) for k in range(30)] + [(7, "Alpha beta " * 12)] * 3 + [(None, "é É x " * 10), (None, None), (50, ""), (51, long), (52, "...")]
    target = ["alpha gamma", None, ""]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank int, at int").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    for max_n, buckets in ((1, 10_000), (3, 97)):
        got = sorted((tuple(r) for r in importance.resample(df, aim, max_n=max_n, buckets=buckets, percent=50).collect()), key=str)
        assert got == plain(docs, target, max_n, buckets, percent=50)
    assert importance.resample(df.limit(0), aim).count() == 0
    nothing = sorted((tuple(r) for r in importance.resample(df, aim.limit(0)).collect()), key=str)
    assert nothing == plain(docs, [])


def test_suffix_arrays_and_runs():
    draw = random.Random(2)
    for _ in range(40):
        texts = [" ".join(draw.choice("a b c".split()) for _ in range(draw.randint(0, 12))) for _ in range(draw.randint(1, 12))]
        texts += texts[:3]
        sequence = np.array([x for k, t in enumerate(texts) for x in [*(ord(w) for w in t.split()), k]])
        order = importance.suffix_array(sequence)
        assert order.tolist() == sorted(range(len(sequence)), key=lambda i: sequence[i:].tolist())
        n_words, bucket, at = importance.block_buckets([t.encode() for t in texts], 3, 997)
        for k, t in enumerate(texts):
            n, want = features(t, 3, 997)
            assert n_words[k] == n and sorted(bucket[at[k] : at[k + 1]].tolist()) == sorted(want)
