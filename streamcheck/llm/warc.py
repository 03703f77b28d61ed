"""WARC archives: writing with revisit records, and a reader that salvages damaged files.

Archives are standard ``.warc.gz``: one gzip member per record, one after the other.  Spark's
text writer puts the bytes down: every member ends with the zero byte of its length field
(an empty member follows where it does not), so the writer's line separator is that byte.
Archives are read with Spark's binary reader, one task per file; the writer's partitions
bound their size.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamcheck.llm.shared import Scratch

GZIP = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
FEED = 1 << 16
ARCHIVE_RECORDS = 100_000
EMPTY_MEMBER = zlib.compressobj(1, zlib.DEFLATED, 31).flush()


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def gzip_member(data: bytes, level: int = 6) -> bytes:
    press = zlib.compressobj(level, zlib.DEFLATED, 31)
    member = press.compress(data) + press.flush()
    return member if member.endswith(b"\0") else member + EMPTY_MEMBER


def record(kind: str, page_id: int | None, url: str | None, block: bytes, more: dict[str, str], date: str) -> bytes:
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}>", "WARC-Date": date}
    if url is not None:
        fields["WARC-Target-URI"] = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    fields |= {"Content-Type": "application/http; msgtype=response"} | more | {"WARC-Block-Digest": f"sha1:{base32_sha1(block)}", "Content-Length": str(len(block))}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()).encode() + b"\r\n" + block + b"\r\n\r\n"


def http_head(length: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()


def write_warc(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", revisit_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", archive_records: int = ARCHIVE_RECORDS) -> None:
    """Write one record per row under ``path``: the payload is the html in UTF-8 (null: empty).

    Of rows whose equal payloads have at least ``revisit_bytes``, that with the smallest id is a
    response and the others revisit it; smaller payloads are all responses.  Rows that repeat
    an id and a payload are responses of their own; a row without an id revisits one that has.
    Payloads are compressed before the one shuffle that carries them, which is keyed by id.  An archive
    has at most ``archive_records`` records.  The first ids of digests are a written table, so that rows of a
    very frequent digest (pages without text) can be dealt over tasks where they meet it.
    """

    def responses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, digests = [], []
            for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                payload = (html or "").encode("utf-8", "surrogatepass")
                digests.append(hashlib.sha1(payload).hexdigest())
                more = {"WARC-Payload-Digest": f"sha1:{base32_sha1(payload)}"}
                members.append(gzip_member(record("response", page_id, url, http_head(len(payload)) + payload, more, date)))
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "url": batch.column(1), "sha1": pa.array(digests, pa.string()), "member": pa.array(members, pa.binary())})

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page_id, url, sha1, size, refers, revisit, member in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                if revisit:
                    more = {
                        "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                        "WARC-Refers-To": f"<urn:page:{refers}>",
                        "WARC-Payload-Digest": f"sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}",
                        "WARC-Payload-Length": str(size),
                    }
                    member = gzip_member(record("revisit", page_id, url, http_head(size), more, date))
                out.append(member[:-1])
            yield pa.RecordBatch.from_pydict({"line": pa.array(out, pa.binary())})

    html = F.coalesce(F.col(html_col), F.lit(""))
    ids = pages.schema[id_col].dataType.simpleString()
    seen = pages.select(F.col(id_col).alias("id"), F.sha1(html).alias("sha1"), F.octet_length(html).cast("bigint").alias("size")).where(F.col("size") >= revisit_bytes)
    first = Scratch(pages.sparkSession, "warc-first").write(seen.groupBy("sha1").agg(F.min("id").alias("refers"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    revisits = seen.join(first, "sha1").where(F.col("refers").isNotNull() & ~F.col("id").eqNullSafe(F.col("refers"))).select(F.col("id").alias("r_id"), F.col("sha1").alias("r_sha1"), "size", "refers").distinct()
    made = pages.select(id_col, url_col, html_col).mapInArrow(responses, f"id {ids}, url string, sha1 string, member binary")
    joined = made.join(revisits, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("sha1") == F.col("r_sha1")), "left")
    rows = joined.select("id", "url", "sha1", "size", "refers", F.col("r_sha1").isNotNull().alias("revisit"), F.when(F.col("r_sha1").isNull(), F.col("member")).alias("member"))
    rows.mapInArrow(lines, "line binary").select(F.col("line").cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\0").option("maxRecordsPerFile", archive_records).text(path)


class Damaged(Exception):
    """A record or member that fails a check."""


@dataclass
class Record:
    offset: int
    end: int
    fields: dict[str, str]
    block: bytes = field(repr=False)

    @property
    def payload(self) -> bytes:
        if self.fields.get("content-type", "").startswith("application/http"):
            return self.block.partition(b"\r\n\r\n")[2]
        return self.block


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """(fields, block, end) of the record whose version line starts at ``at``; its checks must hold."""
    if not re.match(rb"WARC/1\.[01]\r\n", data[at : at + 10]):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", at)
    if stop < 0:
        raise Damaged("header without end")
    fields: dict[str, str] = {}
    name = ""
    for line in data[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            fields[name] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise Damaged("header line without colon")
        name = name.strip().lower()
        if name in fields and name in ("warc-type", "warc-record-id", "content-length"):
            raise Damaged("header runs into another")
        fields[name] = value.strip()
    length = fields.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", length) or "warc-type" not in fields or "warc-record-id" not in fields:
        raise Damaged("mandatory field missing")
    start, end = stop + 4, stop + 4 + int(length)
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("record end not where its length says")
    block = data[start:end]
    found = Record(at, end + 4, fields, block)
    for name, value in (("warc-block-digest", block), ("warc-payload-digest", found.payload)):
        algorithm, _, digest = fields.get(name, "").partition(":")
        if algorithm.lower() == "sha1" and not (name.startswith("warc-payload") and fields["warc-type"] == "revisit") and digest != base32_sha1(value):
            raise Damaged(f"{name} differs")
    return fields, block, end + 4


def inflate(raw: bytes, at: int) -> tuple[bytes, int | None, str]:
    """(content, end, fault) of the gzip member that starts at ``at``; where a check fails, what came out before, and no end."""
    press, out, pos = zlib.decompressobj(31), [], at
    while not press.eof:
        chunk = raw[pos : pos + FEED]
        if not chunk:
            return b"".join(out), None, "member without end"
        # Small steps: what a step that fails had inflated is lost.
        for lo in range(0, len(chunk), 256):
            try:
                out.append(press.decompress(chunk[lo : lo + 256]))
            except zlib.error:
                return b"".join(out), None, "member does not inflate"
            pos += len(chunk[lo : lo + 256])
            if press.eof:
                break
    return b"".join(out), pos - len(press.unused_data), ""


def next_start(raw: bytes, at: int) -> int:
    """The next place from ``at`` on where a member or a version line may start."""
    return min((x for x in (raw.find(GZIP, at), raw.find(VERSION, at)) if x >= 0), default=len(raw))


def records_within(content: bytes) -> tuple[list[tuple[dict[str, str], bytes]], str]:
    """Sound records of a member's content, and the first fault: after one, the next version line is tried."""
    found, pos, fault = [], 0, ""
    while pos < len(content):
        try:
            fields, block, pos = parse_record(content, pos)
            found.append((fields, block))
        except Damaged as e:
            fault = fault or str(e)
            pos = content.find(VERSION, pos + 1)
            if pos < 0:
                break
    return found, fault


def salvage(raw: bytes) -> Iterator[Record | tuple[int, int, str]]:
    """Records of an archive in order, and (start, end, reason) of each byte gap with something lost.

    Handles gzip members with one or more records each, and plain records.  A record that fails a
    check is not returned; reading goes on at the next version line of its member, and after a member
    that ends in a fault at the next member or version line from which whole records follow.  A
    member some of whose records are lost is a gap, and its other records are returned.  Offsets
    are those of the file; records that share a member share its offset.
    """
    at, gap, reason = 0, None, ""
    while at < len(raw):
        fault = ""
        if raw.startswith(GZIP, at):
            content, end, fault = inflate(raw, at)
            inner, lost = records_within(content)
            fault = fault or lost
            end = next_start(raw, at + 1) if end is None else end
            found = [Record(at, end, fields, block) for fields, block in inner]
        else:
            try:
                fields, block, end = parse_record(raw, at)
                found = [Record(at, end, fields, block)]
            except Damaged as e:
                found, fault, end = [], str(e), next_start(raw, at + 1)
        if gap is not None and (found or not fault):
            yield gap, at, reason
            gap = None
        if fault and gap is None:
            gap, reason = at, fault
        yield from found
        if gap is not None and found:
            yield gap, end, reason
            gap = None
        at = end
    if gap is not None:
        yield gap, len(raw), reason


READ = "file string, offset bigint, end bigint, gap string, record_type string, record_id string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, payload binary"


def read_warc(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Every record and every gap of the archives under ``path``.

    A gap is a row with its reason in ``gap`` and nulls but for file and byte range: the log
    of what was quarantined.  ``payload`` is null unless asked for; sizes and digests are of
    the full payload (a revisit states those of the record it refers to).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in READ.split(", ")]
        types = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
        kinds = [types[x.split()[1]] for x in READ.split(", ")]

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            for k, file in enumerate(batch.column(0).to_pylist()):
                rows, held = [], 0
                for x in salvage(batch.column(1)[k].as_py()):
                    if isinstance(x, tuple):
                        rows.append((file, x[0], x[1], x[2], *[None] * 7))
                        continue
                    f, revisit = x.fields, x.fields["warc-type"] == "revisit"
                    payload = x.payload
                    size = int(f.get("warc-payload-length", 0)) if revisit else len(payload)
                    digest = f.get("warc-payload-digest", "").partition(":")[2] if revisit else base32_sha1(payload)
                    rows.append((file, x.offset, x.end, None, f["warc-type"], f["warc-record-id"], f.get("warc-target-uri"), f.get("warc-refers-to"), size, digest, payload if payloads else None))
                    held += len(payload) * payloads
                    if held > 4 << 20 or len(rows) >= 5000:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")
    return files.mapInArrow(run, READ)


def page_records(records: DataFrame) -> DataFrame:
    """Per record of ``read_warc`` that ``write_warc`` made: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def page(name: str) -> Column:
        return F.regexp_extract(name, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")

    return records.where(F.col("gap").isNull()).select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
