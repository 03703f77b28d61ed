"""The corpus pipeline stage by stage, and as a whole, against plain Python."""

import hashlib
import random

import pytest
from test_minhash import brute as brute_components
from test_tokens import check_pieces

import corpus_pipeline
from streamcheck.llm.quality import keep_good

STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "kept", len(t or "")) for i, t in rows], COLUMNS).repartition(3)


def texts(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def corpus():
    rng = random.Random(4)
    word = lambda: f"word{rng.randrange(900)}"
    passage = " ".join(word() for _ in range(70))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(30, 200)))) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(10)]
    rows += [(200 + i, rows[i][1] + " tail") for i in range(20, 30)]
    rows += [(300 + i, " ".join(word() for _ in range(60)) + " " + passage) for i in range(5)]
    return rows + [(400, None), (401, ""), (402, ""), (5, rows[5][1]), (500, "long " * 20000), (None, "no id"), (None, "no id")]


def test_exact_stage(spark):
    rows = corpus()
    got = texts(STAGES["exact_dedup"](spark, frame(spark, rows), ""))
    best = {}
    for i, t in rows:
        best[t or ""] = max(best.get(t or "", (False, 0)), (i is not None, i or 0))
    kept = [(i, t) for i, t in got]
    assert len(kept) == len(best) and {t or "" for _, t in kept} == set(best)
    assert all((i is not None, i or 0) == best[t or ""] for i, t in kept)


def test_near_stage(spark):
    rows = [(i, t) for i, t in dict(corpus()).items()]
    got = texts(STAGES["near_dedup"](spark, frame(spark, rows), ""))
    want = brute_components([r for r in rows if r[0] is not None], 5, 80)
    assert got == sorted([(i, t) for i, t in rows if i is None or want[i][1] == i], key=str)


def test_substring_stage(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    df = frame(spark, [(1, passage), (2, "a  b " + passage + " c"), (3, None), (4, "x  y")])
    out = STAGES["substring_dedup"](spark, df, "")
    assert out.columns == df.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {1: (passage, len(passage)), 2: ("a b c", 5), 3: (None, 0), 4: ("x  y", 4)}


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_no_rows(spark, name):
    out = STAGES[name](spark, frame(spark, [(1, "a")]).limit(0), "")
    assert out.count() == 0


def test_whole(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id: r.text for r in keep_good(docs).collect()}
    best = {}
    for i, t in good.items():
        best[t] = max(i, best.get(t, i))
    unique = {i: t for i, t in good.items() if best[t] == i}
    comp = brute_components(list(unique.items()), 5, 80)
    left = {i: t for i, t in unique.items() if comp[i][1] == i}
    first = {}
    for i, t in left.items():
        w = t.encode().split()
        for p in range(len(w) - 49):
            key = hashlib.md5(b" ".join(w[p : p + 50])).digest()
            first[key] = min(i, first.get(key, i))
    final = {}
    for i, t in left.items():
        w, gone = t.encode().split(), set()
        for p in range(len(w) - 49):
            if first[hashlib.md5(b" ".join(w[p : p + 50])).digest()] < i:
                gone.update(range(p, p + 50))
        final[i] = b" ".join(x for p, x in enumerate(w) if p not in gone).decode() if gone else t
    pieces = corpus_pipeline.run(spark, sf).collect()
    assert 0 < len(final) < docs.count()
    check_pieces(pieces, final)


@pytest.mark.parametrize("name", ["exact_dedup", "near_dedup", "substring_dedup"])
def test_repeated_ids_and_clashing_names(spark, name):
    """Rows of one id and other texts are documents of their own, and no column name of the input is in the way."""
    rng = random.Random(8)
    a, b = (" ".join(f"w{rng.randrange(500)}" for _ in range(80)) for _ in range(2))
    rows = [(3, a + " tail"), (7, a), (7, b)] if name == "near_dedup" else [(3, b), (7, a), (7, b)] if name == "substring_dedup" else [(9, a), (7, a), (7, b)]
    names = ("__id", "__KEY", "__fp", "__sha", "__lo", "__fingerprint")
    df = frame(spark, rows).selectExpr("*", *(f"'x' AS `{n}`" for n in names))
    out = STAGES[name](spark, df, "")
    assert out.columns == df.columns
    want = {"near_dedup": [(3, a + " tail"), (7, b)], "exact_dedup": [(7, b), (9, a)], "substring_dedup": [(3, b), (7, ""), (7, a)]}[name]
    assert texts(out) == sorted(want, key=str)
