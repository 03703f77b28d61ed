"""Encoding, decoding and packing against the tokenizers library."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from streamcheck.llm import bpe
from streamcheck.llm.pack import cut_windows, pack

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
OURS = bpe.Encoder(PATH)
ODD = ["", "  ", None, "Hello, don't 'sample!'s WE'LL 've x² ½ 123 中文 é é ΑΣ Σ İ \xa0x\x1cy　z", "<|endoftext|>a<|startoftext|>b <|ENDoftext|>", "x" * 1000 + "!" * 300 + "ab" * 200, "a\x85b 👩‍👩‍👧", "\n\n\t a\r\nb", "' '' 's's't", "word " * 30000]


def library(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    return ids, LIBRARY.decode(ids, skip_special_tokens=False)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.one_of(st.characters(codec="utf-8", exclude_categories=["Cn", "Cs"]), st.sampled_from(" \n'abest.!ΣÉ")), max_size=30), min_size=1, max_size=5))
def test_encoder_equals_library(texts):
    got = [(ids[a:b].tolist(), d.decode()) for _, ids, at, words in OURS.encode_column(pa.array(texts)) for a, b, d in zip(at[:-1], at[1:], words.decoded(OURS), strict=True)]
    assert got == [library(t) for t in texts]


def test_long_pieces_equal_library():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdeinth"), n)) for n in (60, 63, 64, 65, 66, 500, 3000)]
    got = [ids[a:b].tolist() for _, ids, at, _ in OURS.encode_column(pa.array(texts)) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert got == [library(t)[0] for t in texts]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, start string, length string")


def test_encode_decode(spark):
    rows = [(i, t, "x", "y") for i, t in enumerate(ODD)] + [(1, "a b", None, None), (1, "a b", None, None), (None, "c", None, None)]
    got = bpe.encode_decode(frame(spark, rows), PATH, keep_ids=True).collect()
    assert len(got) == len(rows)
    want = defaultdict(list)
    for i, t, *_ in rows:
        ids, plain = library(t)
        want[i].append((len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(plain.encode()).hexdigest(), ids, plain))
    have = defaultdict(list)
    for r in got:
        have[r.doc_id].append((r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids), r.decoded))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert bpe.encode_decode(frame(spark, []), PATH).count() == 0


def check_pieces(pieces, texts, width=2048):
    """Every id in one piece, sequences gapless and in order; returns (tokens, padding)."""
    docs, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        sequences[p.sequence_id].append(p)
    assert set(docs) == set(texts)
    for d, own in docs.items():
        ids, at = [*library(texts[d])[0], 1], 0
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= width
        padding += 0 if at & (at - 1) == 0 else width - at
    return sum(p.length for p in pieces), padding


def test_pack(spark):
    texts = dict(enumerate(ODD)) | {100 + i: "One two three. " * i for i in range(0, 900, 17)}
    rows = [(i, t, "x", "y") for i, t in texts.items()]
    tokens, padding = check_pieces(pack(frame(spark, rows).coalesce(1), PATH).collect(), texts)
    assert padding < 0.02 * tokens
    check_pieces(pack(frame(spark, rows).repartition(7), PATH).collect(), texts)
    check_pieces(pack(frame(spark, rows), PATH, width=64, grid=8).collect(), texts, 64)
    assert pack(frame(spark, []), PATH).count() == 0
    assert {r.doc_id for r in pack(frame(spark, [(None, "a", "", ""), (3, None, "", "")]), PATH).collect()} == {None, 3}


def test_pack_repeated_rows(spark):
    """Each of the equal rows, and of the rows that share an id, has its own pieces."""
    text = "One two three. " * 300
    got = pack(frame(spark, [(1, text, "", "")] * 3 + [(1, "other", "", ""), (2, None, "", ""), (2, None, "", "")]).coalesce(1), PATH).collect()
    size = {t: len(library(t)[0]) + 1 for t in (text, "other")}
    assert ids_by_document(got) == {(1, size[text]): 3 * size[text], (1, size["other"]): size["other"], (2, 1): 2}
    assert len({(p.sequence_id, p.offset) for p in got}) == len(got)


def ids_by_document(pieces):
    """Ids in all pieces by document and its number of ids."""
    total = defaultdict(int)
    for p in pieces:
        total[p.doc_id, p.doc_tokens] += p.length
    return total


def test_pack_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tokens, padding = check_pieces(pack(docs, PATH).collect(), {r.doc_id: r.text for r in docs.collect()})
    assert padding < 0.02 * tokens


@pytest.mark.parametrize("seed", range(20))
def test_cut_windows_is_optimal(seed):
    rng = np.random.default_rng(seed)
    places = np.cumsum(rng.integers(1, 8, 60))
    penalties = rng.integers(0, 6, 60)
    width = int(rng.integers(8, 30))
    at, best = [0, *places.tolist()], [0] + [10**9] * 60
    for j in range(1, 61):
        best[j] = min(best[i] + width - at[j] + at[i] for i in range(j) if at[j] - at[i] <= width) + int(penalties[j - 1])
    ends, cost, pen = cut_windows(places, penalties, width), 0, dict(zip(at[1:], penalties.tolist(), strict=True))
    for a, b in zip([0, *ends[:-1]], ends, strict=True):
        assert 0 < b - a <= width
        cost += width - (b - a) + pen[b]
    assert ends[-1] == at[-1] and cost == best[-1]
