"""Removal of repeated line runs against all windows of lines."""

import hashlib
import itertools
import random
from collections import defaultdict

import pyarrow as pa
import pytest

from streamcheck.llm import queries
from streamcheck.llm.lines import before_and_after, lower, passed_on, reach, remove_lines


def brute(rows, least):
    """Every pair of equal lines starts or goes on with a run; runs of enough bytes lose their later copy."""
    lines = {(i, t): t.split("\n") for i, t in rows if i is not None and t is not None}
    places, gone = defaultdict(list), defaultdict(set)
    for key, own in lines.items():
        for p, x in enumerate(own):
            places[x].append((key, p))
    for key, own in lines.items():
        for p, x in enumerate(own):
            for other, q in places[x]:
                if (other[0], q) < (key[0], p) and (p == 0 or q == 0 or own[p - 1] != lines[other][q - 1]):
                    n = 0
                    while p + n < len(own) and q + n < len(lines[other]) and own[p + n] == lines[other][q + n]:
                        n += 1
                    if sum(len(y.encode()) for y in own[p : p + n]) >= least:
                        gone[key].update(range(p, p + n))
    out = []
    for i, t in rows:
        own, g = (t.split("\n") if t is not None else []), gone[i, t] if i is not None else set()
        kept = "\n".join(x for p, x in enumerate(own) if p not in g)
        out.append((i, len(own), len(g), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    runs = [[f"line {rng.randrange(60)}" for _ in range(rng.randrange(1, 25))] for _ in range(10)]
    rows = []
    for i in range(120):
        own = []
        for _ in range(rng.randrange(0, 4)):
            own += rng.choice(runs)[rng.randrange(0, 3) :] + [f"own {rng.randrange(10**6)}" for _ in range(rng.randrange(0, 3))]
        rows.append((i * 7 % 1000 + 1000 * (i % 3), "\n".join(own)))
    rows += [(50001, "a\na\na\na"), (50002, "a\na"), (50003, None), (50004, ""), (50005, ""), (50006, "\n\n"), (None, "a\na"), (50002, "a\na"), (50007, "x" * 10**6 + "\nb"), (50008, "\n".join(f"l{k % 97}" for k in range(3000)))]
    return rows


@pytest.mark.parametrize("seed,least,parts", [(1, 1, 8), (2, 16, 3), (3, 60, 8), (4, 1, 40)])
def test_equals_all_pairs(spark, seed, least, parts):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, pos int, fp string").repartition(5)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert sorted(map(tuple, remove_lines(df, least_bytes=least).collect()), key=str) == brute(rows, least)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("seed", range(200))
def test_intervals_over_cut_arrays(seed):
    """Any cut of a suffix array into ranges gives each place its longest run that starts earlier."""
    rng = random.Random(seed)
    text = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(1, 40))]
    same = lambda a, b: next((k for k in range(len(text)) if max(a, b) + k >= len(text) or text[a + k] != text[b + k]), len(text))
    order = sorted(range(len(text)), key=lambda p: text[p:])
    lcp = [0, *(same(a, b) for a, b in itertools.pairwise(order))]
    want = {p: max((same(p, q) for q in range(p)), default=0) for p in range(len(text))}
    cuts = sorted({0, len(text), *(rng.randrange(len(text) + 1) for _ in range(rng.randrange(6)))})
    pieces = [(order[a:b], *before_and_after(order[a:b], lcp[a:b])) for a, b in itertools.pairwise(cuts)]
    got, steps, least = {}, [], [min(lcp[a:b]) for a, b in itertools.pairwise(cuts)]
    for (own, best, left, _, at_end, _), most in zip(pieces, least, strict=True):
        for p, b, c in zip(own, best, left, strict=True):
            got[p] = max(b, min(c, reach(steps, (p,))))
        steps = lower(steps, most, [(n, (own[i],)) for n, i in at_end])
    steps = []
    for (own, _, _, right, _, at_start), most in zip(reversed(pieces), reversed(least), strict=True):
        for p, c in zip(own, right, strict=True):
            got[p] = max(got[p], min(c, reach(steps, (p,))))
        steps = lower(steps, most, [(n, (own[i],)) for n, i in at_start])
    assert got == want


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_staircases_pass_from_range_to_range(size):
    """Whatever the batches, each range gets what the ranges before it have, and holds no other."""
    rng = random.Random(size)
    rows, want, steps = [], [], []
    for part in sorted(rng.sample(range(100), 30)):
        want.append((part, steps))
        least, own = rng.randrange(0, 9), [(n, (rng.randrange(50), 0, n)) for n in sorted(rng.sample(range(1, 12), rng.randrange(0, 5)), reverse=True)]
        steps = lower(steps, least, own)
        rows += [{"part": part, "kind": 3, "lines": least, "id": 0, "fp": 0, "pos": 0}] + [{"part": part, "kind": 1, "lines": n, "id": i, "fp": f, "pos": p} for n, (i, f, p) in own]
    batches = [pa.RecordBatch.from_pylist(rows[a : a + size]) for a in range(0, len(rows), size)]
    got = [r for b in passed_on(iter(batches)) for r in b.to_pylist()]
    assert [(r["part"], list(zip(r["lines"], zip(r["id"], r["fp"], r["pos"])))) for r in got] == want
    for _, found in want:
        for place in ((rng.randrange(50), 0, rng.randrange(12)) for _ in range(20)):
            assert reach(found, place) == max((n for n, p in found if p < place), default=0)


def test_long_repeats_and_no_rows(spark):
    df = spark.createDataFrame([(1, "\n".join(f"l{k}" for k in range(300))), (2, "new\n" + "\n".join(f"l{k}" for k in range(300)) + "\nend")], "doc_id long, text string")
    got = {r.doc_id: r for r in remove_lines(df, keep_text=True).collect()}
    assert got[1].n_removed == 0 and got[2].kept_text == "new\nend"
    assert remove_lines(df.limit(0)).count() == 0


def test_query_equals_sql(spark):
    import oracle

    sf = "/root/testdata/sf0.01"
    assert oracle.compare(spark, "op8_lines", queries.op8_lines, queries.OP8_SQL, sf, oracle.duck(sf)) == 1000
    assert sum(r.n_removed > 0 for r in queries.op8_lines(spark, sf).collect()) > 10
