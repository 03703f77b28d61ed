"""Exact deduplication and WARC archives against plain Python."""

import base64
import hashlib
from collections import defaultdict

import pyarrow as pa
import pytest

from streamcheck.llm import queries, warc
from streamcheck.llm.exact import MisraGries, exact_dedup
from streamcheck.llm.warc import gzip_member, page_records, read_warc, record, salvage, write_warc


def brute_groups(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return groups


@pytest.mark.parametrize("heavy", [1, 4, 1024])
def test_exact_dedup(spark, heavy):
    rows = [(i, ["same", None, "", f"t{i % 50}", f"u{i}", "a\nb "][i % 6]) for i in range(3000)] + [(None, "same"), (None, "only null"), (7, "t7"), (7, "t7"), (9000, "long " * 50000)]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, digest int, size int, row int").repartition(5)
    got = exact_dedup(df, heavy=heavy).collect()
    assert len(got) == len(rows)
    groups = brute_groups(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    kept = defaultdict(int)
    for r in got:
        ids = by_sha[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    assert exact_dedup(df.limit(0)).count() == 0


def test_misra_gries_bound():
    values = ["a"] * 500 + ["b"] * 300 + [f"x{i}" for i in range(3000)]
    mg = MisraGries(20)
    for lo in range(0, len(values), 333):
        mg.add(pa.array(values[lo : lo + 333]))
    for v, n in (("a", 500), ("b", 300)):
        assert n - len(values) / 21 <= mg.counts.get(v, 0) <= n
    assert len(mg.counts) <= 20


PAGES = [(1, "http://a/1", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "http://a b/3\n", None), (4, "u", ""), (5, "u", "é" * 70000), (6, "u", "<p>x</p>"), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (None, "u", "<p>x</p>"), (None, "u", "no id")]


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, 1, "m") for r in PAGES], "page_id long, url string, html string, size int, member string").repartition(3)
    write_warc(df, str(tmp_path / "w"))
    records = read_warc(spark, str(tmp_path / "w"), payloads=True)
    assert records.where("gap is not null").count() == 0
    got = page_records(records).collect()
    first = {}
    for i, _, h in PAGES:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        refers = first.get(h or "")
        revisit = refers is not None and refers != i
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", refers if revisit else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    payloads = {r.record_id: r.payload.decode() for r in records.where("record_type = 'response'").collect()}
    assert payloads["<urn:page:5>"] == "é" * 70000
    write_warc(df.limit(0), str(tmp_path / "none"))
    assert read_warc(spark, str(tmp_path / "none")).count() == 0
    write_warc(df, str(tmp_path / "big"), revisit_bytes=9)
    assert page_records(read_warc(spark, str(tmp_path / "big"))).where("record_type = 'revisit'").count() == 0


def test_query_equals_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    first = {}
    for p in pages:
        first[p.html or ""] = min(p.page_id, first.get(p.html or "", p.page_id))
    want = set()
    for p in pages:
        raw, f = (p.html or "").encode(), first[p.html or ""]
        want.add((p.page_id, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if f == p.page_id else "revisit", None if f == p.page_id else f))
    got = queries.op7_warc(spark, "/root/testdata/sf0.001").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert len(got) == len(pages) and set(map(tuple, got)) == want


def archive(gz, n=6):
    parts = [record("response", i, f"http://x/{i}", b"HTTP/1.1 200 OK\r\n\r\n" + bytes([65 + i]) * (50 + 40 * i), {}, "2020-01-01T00:00:00Z") for i in range(n)]
    return [gzip_member(p) if gz else p for p in parts]


@pytest.mark.parametrize("gz", [True, False])
def test_salvage(gz):
    parts = archive(gz)

    def read(raw):
        found = list(salvage(raw))
        return [x.fields["warc-record-id"][10:-1] for x in found if not isinstance(x, tuple)], [x[:2] for x in found if isinstance(x, tuple)]

    whole = b"".join(parts)
    at = [sum(map(len, parts[:i])) for i in range(7)]
    assert read(whole) == (list("012345"), [])
    for k in range(6):  # one byte of a member, or of a plain record's block
        raw = bytearray(whole)
        raw[(at[k] + at[k + 1]) // 2 if gz else at[k + 1] - 12] ^= 0xFF
        ids, gaps = read(bytes(raw))
        assert ids == [str(i) for i in range(6) if i != k] and gaps == [(at[k], at[k + 1])]
    assert read(b"junk" + whole) == (list("012345"), [(0, 4)])
    assert read(whole[: at[5] + 30]) == (list("01234"), [(at[5], at[5] + 30)])
    assert read(whole[: at[2] + 20] + whole[at[3] :]) == (list("01345"), [(at[2], at[2] + 20)])
    assert read(b"") == ([], []) and read(b"\x1f\x8b\x08") == ([], [(0, 3)])
    both = archive(True)[0] + archive(False)[1]
    assert read(both) == (["0", "1"], [])


def test_salvage_through_spark(spark, tmp_path):
    parts = archive(True)
    raw = bytearray(b"".join(parts))
    raw[len(parts[0]) + 12] ^= 1
    (tmp_path / "a.warc.gz").write_bytes(raw)
    (tmp_path / "b.warc").write_bytes(b"".join(archive(False, 2)))
    rows = read_warc(spark, str(tmp_path)).collect()
    assert sum(r.gap is None for r in rows) == 7
    (gap,) = [r for r in rows if r.gap]
    assert (gap.offset, gap.end) == (len(parts[0]), len(parts[0]) + len(parts[1])) and gap.file.endswith("a.warc.gz")


def test_salvage_inside_a_member():
    """Three sound records of a member come out beside one with a false digest, and what a cut member had inflated before."""
    from streamcheck.llm.warc import gzip_member, http_head, record, salvage

    made = [record("response", i, "http://x/", http_head(4) + b"page" + bytes([48 + i]), {}, "1970-01-01T00:00:00Z") for i in range(4)]
    made[1] = made[1].replace(b"page1", b"pagex")
    member, good = gzip_member(b"".join(made)), gzip_member(made[3])
    found = list(salvage(member + good))
    assert [x.fields["warc-record-id"] for x in found if not isinstance(x, tuple)] == ["<urn:page:0>", "<urn:page:2>", "<urn:page:3>", "<urn:page:3>"]
    assert [x for x in found if isinstance(x, tuple)] == [(0, len(member), "warc-block-digest differs")]
    rng = __import__("random").Random(1)
    long = [record("response", i, None, bytes(rng.randrange(256) for _ in range(5000)), {}, "d") for i in range(4)]
    cut = gzip_member(b"".join(long))[:-6000]
    found = list(salvage(cut + good))
    assert [x.fields["warc-record-id"] for x in found if not isinstance(x, tuple)] == ["<urn:page:0>", "<urn:page:1>", "<urn:page:3>"]
    assert [x[:2] for x in found if isinstance(x, tuple)] == [(0, len(cut))]


def test_archives_are_bounded_and_one_digest_may_hold_most_pages(spark, tmp_path):
    df = spark.createDataFrame([(k, f"http://h/{k}", "" if k % 3 else f"<p>{k}</p>") for k in range(300)], "page_id long, url string, html string").repartition(1)
    write_warc(df, str(tmp_path / "w"), archive_records=40)
    assert len(list((tmp_path / "w").glob("part-*"))) >= 8
    got = {r.page_id: (r.record_type, r.refers_to) for r in page_records(read_warc(spark, str(tmp_path / "w"))).collect()}
    assert got == {k: ("revisit", 1) if k % 3 and k != 1 else ("response", None) for k in range(300)}
