"""Token counts of every prefix against the tokenizers library."""

import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from streamcheck.llm import prefix, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "b", "the", " ", "  ", "\n", "\t", "'", "'re", "'ll", "'s", "1", "23", "é", "中", "😀", "<|endoftext|>", "<|endof", "|>", "!", "...", "　", "\xa0", "ing", " The", "don't", "=====", "x" * 90, "é", "\x1c", "ß"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    return prefix.Counter(prefix.Vocabulary(PATH))


def counts_of(counter, texts):
    flat, at = counter.texts(texts)
    return [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]


def test_every_prefix_is_counted_as_a_text_of_its_own(library, counter):
    draw = random.Random(5)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 12))) for _ in range(400)]
    for text, counts in zip(texts, counts_of(counter, texts), strict=True):
        want = [len(e.ids) for e in library.encode_batch([text[:i] for i in range(1, len(text) + 1)], add_special_tokens=False)]
        assert counts == want, text


def test_pieces_are_those_of_the_library_for_every_character(library, counter):
    points = [c for c in range(1, 0x110000, 7) if not 0xD800 <= c < 0xE000]
    texts = [f"a{chr(c)}b 1{chr(c)}{chr(c)}2 {chr(c)}'re" for c in points]
    sizes = np.array([len(t) for t in texts])
    begin, joined = np.cumsum(sizes) - sizes, "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    starts = prefix.piece_starts(codes, counter.v.classes[codes], begin)
    cuts = np.searchsorted(starts, np.append(begin, len(joined)))
    for k, text in enumerate(texts):
        want = [span[0] for _, span in library.pre_tokenizer.pre_tokenize_str(text)]
        assert (starts[cuts[k] : cuts[k + 1]] - begin[k]).tolist() == want, points[k]


def test_long_pieces_and_forgotten_ones(library, monkeypatch):
    monkeypatch.setattr(prefix, "MOST_KNOWN", 50)
    c = prefix.Counter(prefix.Vocabulary(PATH))
    texts = ["x" * 5000 + " y", "-" * 300, " " * 400 + "end", "ab" * 700, ""]
    for _ in range(2):
        got = counts_of(c, texts)
        assert [x[-1] if x else 0 for x in got] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_query_on_documents(spark, library):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in queries.op13_token_counts(spark, "/root/testdata/sf0.01").collect()}
    n = [len(e.ids) for e in library.encode_batch([r.text or "" for r in rows], add_special_tokens=False)]
    assert got == {r.doc_id: (len((r.text or "").encode()), k, k > 1024) for r, k in zip(rows, n, strict=True)}


def test_questions_are_answered_from_the_counts(spark, library):
    text = "It doesn't matter  what\n\nthey're saying; 12345 <|endoftext|> naïve café"
    df = spark.createDataFrame([(1, text, 5), (2, None, 6), (2, "", 7), (None, "a b", 8)], "doc_id int, text string, counts int")
    counted = prefix.prefix_counts(df, PATH)
    n = {k: len(library.encode(text[:k], add_special_tokens=False).ids) for k in range(len(text) + 1)}
    for budget in (0, 1, 5, 9, 1000):
        (r,) = counted.where("doc_id = 1").select(prefix.longest_within(F.col("counts"), budget).alias("cut")).collect()
        assert r.cut == max(k for k, c in n.items() if c <= budget)
    (r,) = counted.where("doc_id = 1").select(*(prefix.count_at(F.col("counts"), F.lit(k)).alias(f"k{k}") for k in (0, 4, 22, 500))).collect()
    assert list(r) == [0, n[4], n[22], n[len(text)]]
    rest = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit, r.cut_chars) for r in prefix.count_tokens(df, PATH).where("doc_id is null or doc_id = 2").collect()), key=str)
    assert rest == [(2, 0, 0, False, 0), (2, 0, 0, False, 0), (None, 3, 2, False, 3)]
    assert prefix.count_tokens(df.limit(0), PATH).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        prefix.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))
