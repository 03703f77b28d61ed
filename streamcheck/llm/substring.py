"""Removal of long word sequences that an earlier document has, over a compacted De Bruijn graph.

The graph's edges are all ``window``-word k-mers; an edge follows another where the two
overlap in all but one word.  Each edge has an anchor, the ``seed``-word sequence in it of
least hash, which depends on the edge's words alone.  A document is cut into segments:
maximal runs of successive edges that share one anchor place, each one row with its source
coordinates and the segments before and after it, about one row for each
``(window - seed) / 2`` words.  Segments are equal by a 128-bit digest of their letters.

Joins compact what repeats.  Anchors that only one document has are dropped.  Where all
segments of an anchor are equal, the path does not branch on them; a join of each such segment with
its successor links two where every copy of the one is followed by the other and every copy
of the other follows the one.  Linked segments have the same copies, shifted alike, so the chain
lies in one piece at the source coordinates of its least copy and becomes one long path there.
The words of the path are read from those coordinates, and every copy of the span is verified
against them before its words go.  Segments of an anchor that differ are opened: the
words of one copy of each are read from its coordinates, and its edges are compared one by
one, by a digest of their letters.  Documents are never cut to a prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamcheck.llm import textkit
from streamcheck.llm.shared import Scratch, free_names

WINDOW, SEED = 50, 10
LOW32 = np.uint64(0xFFFFFFFF)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of x[i : i + width] for every whole range."""
    step, out = 1, x
    while step * 2 <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - step :]) if step < width else out


def spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words of a group of documents joined by one space, and where each begins (one more entry at the end)."""
    bounds = [(int(starts[a]), int(ends[b - 1])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True) if a < b]
    at = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts + 1, out=at[1:])
    return b" ".join(b" ".join(data[lo:hi].tobytes().split()) for lo, hi in bounds), at


def digest(letters: bytes | memoryview) -> bytes:
    return hashlib.blake2b(letters, digest_size=16).digest()


def digests(text: bytes, at: np.ndarray, start: np.ndarray, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Both halves of the digests of the words start .. start+size-1."""
    view = memoryview(text)
    found = b"".join([digest(view[a:b]) for a, b in zip(at[start].tolist(), (at[start + size] - 1).tolist(), strict=True)])
    halves = np.frombuffer(found, dtype=np.int64).reshape(-1, 2)
    return halves[:, 0], halves[:, 1]


SEGMENT = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("anchor", pa.int64()), ("v1", pa.int64()), ("v2", pa.int64()), ("before", pa.int64()), ("after", pa.int64())])


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, first: np.ndarray, window: int, seed: int) -> dict[str, pa.Array]:
    """Segments of a group of documents: doc (index), and the fields of ``SEGMENT`` from start on.

    ``before`` and ``after`` are v1 of the neighbours in the document, null at its ends.
    """
    at, docs = textkit.windows_within(first, window)
    if not len(at):
        return {"doc": pa.array([], pa.int64())} | {f.name: pa.array([], f.type) for f in list(SEGMENT)[2:]}
    grams = textkit.span_hash(textkit.prefix_sums(hashes, "word"), np.arange(len(hashes) - seed + 1), seed, "word")
    least = sliding_min((grams & ~LOW32) | np.arange(len(grams), dtype=np.uint64), window - seed + 1)
    place = (least[at] & LOW32).astype(np.int64)
    begin = np.ones(len(at), dtype=bool)
    begin[1:] = (place[1:] != place[:-1]) | (docs[1:] != docs[:-1])
    head = np.flatnonzero(begin)
    n = np.diff(np.append(head, len(at)))
    start, doc = at[head], docs[head]
    v1, v2 = digests(*spelled(data, starts, ends, first), start, n + window - 1)
    opens = np.append(True, doc[1:] != doc[:-1])
    return {
        "doc": pa.array(doc),
        "start": pa.array((start - first[doc]).astype(np.int32)),
        "n": pa.array(n.astype(np.int32)),
        "anchor": pa.array(grams[place[head]].view(np.int64)),
        "v1": pa.array(v1),
        "v2": pa.array(v2),
        "before": pa.array(np.roll(v1, 1), mask=opens),
        "after": pa.array(np.roll(v1, -1), mask=np.roll(opens, -1)),
    }


def segment_table(docs: DataFrame, window: int, seed: int) -> DataFrame:
    """docs: (id, text, fp).  One row per segment of every document with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, _, data, starts, ends, first, hashes in textkit.text_groups(batch.column(1)):
                found = segments(data, starts, ends, hashes, first, window, seed)
                row = pa.array(found.pop("doc").to_numpy() + i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(2).take(row), *found.values()], schema=SEGMENT)

    return docs.where("id is not null").select("id", "text", "fp").mapInArrow(run, ", ".join(f"{f.name} {'int' if f.type == pa.int32() else 'bigint'}" for f in SEGMENT))


def compacted(straight: DataFrame) -> DataFrame:
    """Chains of linked segments as one path each: (id, fp, start, n, v1, v2), the last two those of its first segment.

    straight: (v1, v2, n, source struct(id, start, fp), before, after), one row per class of
    equal segments; ``before`` and ``after`` are v1 of the only neighbour, null where copies differ in it.
    A chain ends, as documents do, so none is a circle.  A group of the window is part of one document.
    """
    ahead = straight.where("after is not null").select(F.col("after").alias("v1"), F.col("v1").alias("before"), F.lit(0).alias("opens"))
    linked = straight.join(ahead, ["v1", "before"], "left").withColumn("opens", F.coalesce("opens", F.lit(1)))
    chain = F.sum("opens").over(Window.partitionBy("source.id", "source.fp").orderBy("source.start"))
    chains = linked.withColumn("chain", chain).groupBy(F.col("source.id").alias("id"), F.col("source.fp").alias("fp"), "chain")
    return chains.agg(F.min(F.struct("source.start", "v1", "v2")).alias("first"), F.sum("n").cast("int").alias("n")).select("id", "fp", "first.start", "n", "first.v1", "first.v2")


def opened(sources: DataFrame, window: int, seed: int) -> DataFrame:
    """What the source coordinates of each path in ``todo`` hold.

    ``sources``: (id, text, todo array of struct(start, n, v1, v2, whole)).  A whole path gives
    one row, i = -1, with the digest w1, w2 of its words; another one gives a row for each edge i with
    that of the edge.  A segment that its source coordinates do not give is an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            todo = batch.column(2)
            for i, j, data, starts, ends, first, _ in textkit.text_groups(batch.column(1)):
                words = spelled(data, starts, ends, first)
                own = todo.slice(i, j - i)
                each, count = own.flatten(), own.value_lengths().to_numpy(zero_copy_only=False)
                start, n, v1, v2 = (each.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("start", "n", "v1", "v2"))
                whole = each.field("whole").to_numpy(zero_copy_only=False).astype(bool)
                start, low = start + np.repeat(first[:-1], count), np.repeat(batch.column(0).slice(i, j - i).to_numpy(), count)
                d1, d2 = digests(*words, start, n + window - 1)
                if ((d1 != v1) | (d2 != v2))[~whole].any():
                    raise ValueError("a segment differs from the words at its source coordinates")
                times = np.where(whole, 1, n)
                row = np.repeat(np.arange(len(n)), times)
                k = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
                w1, w2 = d1[row], d2[row]
                edge = np.flatnonzero(~whole[row])
                w1[edge], w2[edge] = digests(*words, start[row[edge]] + k[edge], window)
                yield pa.RecordBatch.from_pydict({
                    "v1": pa.array(v1[row]),
                    "v2": pa.array(v2[row]),
                    "i": pa.array(np.where(whole[row], -1, k).astype(np.int32)),
                    "n": pa.array(n[row].astype(np.int32)),
                    "w1": pa.array(w1),
                    "w2": pa.array(w2),
                    "low": pa.array(low[row]),
                })

    return sources.select("id", "text", "todo").mapInArrow(run, "v1 bigint, v2 bigint, i int, n int, w1 bigint, w2 bigint, low bigint")


def repeated_spans(docs: DataFrame, scratch: Scratch, window: int, seed: int) -> DataFrame:
    """(id, fp, spans): word ranges [lo, hi) to remove from each document that has any.

    docs: (id, text, fp) with ``fp`` a fingerprint of the text, so that rows that share an id keep apart.
    Long paths carry the digest w1, w2 of their source's words; for single edges it is null.
    """
    found = scratch.write(segment_table(docs, window, seed), "segments")
    both = found.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("anchor")
    both = scratch.write(both, "anchors")  # a table of its own: the join's hot anchors can be split
    repeated = scratch.write(found.join(both, "anchor"), "repeated")
    scratch.drop("segments", "anchors")

    only = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c)).alias(c)
    source = F.min(F.struct("id", "start", "fp")).alias("source")
    paths = repeated.groupBy("anchor", "v1", "v2").agg(source, F.max("id").alias("last"), F.first("n").alias("n"), only("before"), only("after"))
    paths = scratch.write(paths, "paths")
    branches = paths.groupBy("anchor").agg(F.count("*").alias("variants"))
    straight = paths.where("last > source.id").join(branches.where("variants = 1").select("anchor"), "anchor", "left_semi")
    forked = paths.join(branches.where("variants > 1").select("anchor"), "anchor", "left_semi")

    parts = forked.select("source.id", "source.fp", F.struct("source.start", "n", "v1", "v2", F.lit(False).alias("whole")).alias("part"))
    wholes = compacted(straight).select("id", "fp", F.struct("start", "n", "v1", "v2", F.lit(True).alias("whole")).alias("part"))
    todo = scratch.write(parts.unionByName(wholes).groupBy("id", "fp").agg(F.collect_list("part").alias("todo")), "todo")
    read = scratch.write(opened(docs.join(todo, ["id", "fp"]), window, seed), "read")
    edges, wholes = read.where("i >= 0"), read.where("i < 0")
    least = edges.groupBy("w1", "w2").agg(F.min("low").alias("least"))
    least = scratch.write(least, "least")
    lows = scratch.write(edges.join(least, ["w1", "w2"]).groupBy("v1", "v2").agg(F.sort_array(F.collect_set(F.struct("i", "least"))).alias("lows")), "lows")

    whole = repeated.select("id", "fp", "start", "v1", "v2").join(wholes.select("v1", "v2", "n", "w1", "w2", "low"), ["v1", "v2"]).where("id > low")
    whole = whole.select("id", "fp", F.array(F.struct(F.col("start").alias("lo"), (F.col("start") + F.col("n") + (window - 1)).alias("hi"), "w1", "w2")).alias("spans"))
    none = "cast(null as bigint)"
    part = f"transform(filter(lows, x -> x.least < id), x -> struct(start + x.i as lo, start + x.i + {window} as hi, {none} as w1, {none} as w2))"
    parts = repeated.join(lows, ["v1", "v2"]).select("id", "fp", F.expr(part).alias("spans"))
    spans = whole.unionByName(parts.where("size(spans) > 0"))
    return spans.groupBy("id", "fp").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def checked(words: list[bytes], spans: list[tuple[int, int, int | None, int | None]]) -> None:
    """Long spans must have the words of their source, by the digest of those."""
    for lo, hi, w1, w2 in spans:
        if w1 is not None and digest(b" ".join(words[lo:hi])) != np.array([w1, w2], dtype=np.int64).tobytes():
            raise ValueError("a copy differs from the words at the source coordinates of its path")


def kept_words(words: list[bytes], spans: list[tuple[int, int, int | None, int | None]]) -> list[bytes]:
    steps = np.zeros(len(words) + 1, dtype=np.int64)
    for lo, hi, _, _ in spans:
        steps[lo] += 1
        steps[hi] -= 1
    keep = np.cumsum(steps[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, keep_text: bool = False) -> DataFrame:
    """Remove each word covered by a ``window``-word sequence that also starts in a document of smaller id.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; windows are judged on the input.  Returns one
    row per input row: ``id_col`` (an integer), ``n_words``, ``n_removed``, ``kept_sha256`` of the
    kept words joined by one space.  With ``keep_text`` it returns the input's columns instead,
    ``text_col`` being the kept words where any were removed and the input's text elsewhere.
    Null text has no words.  Rows of equal id do not count as smaller than each other; a row
    without an id is left whole and removes nothing elsewhere.
    """
    scratch = Scratch(docs.sparkSession, "substring")
    taken = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("fp"))
    spans = scratch.write(repeated_spans(taken, scratch, window, seed), "spans")
    scratch.drop("repeated", "paths", "todo", "read", "least", "lows")
    extra = [c for c in docs.columns if c not in (id_col, text_col)] if keep_text else []
    key, print_, *parts = free_names(docs, "id", "fingerprint", "lo", "hi", "w1", "w2")
    rows = docs.select(id_col, text_col, *extra).withColumns({key: F.col(id_col).cast("bigint"), print_: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    spans = spans.select(F.col("id").alias(key), F.col("fp").alias(print_), *(F.col(f"spans.{k}").alias(p) for k, p in zip(("lo", "hi", "w1", "w2"), parts, strict=True)))
    joined = rows.join(spans, [key, print_], "left").select(id_col, text_col, *parts, *extra)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, sha, texts = [], [], [], []
            for text, *gone in zip(*batch.columns[1:6], strict=True):
                text = text.as_py()
                words = kept = (text or "").encode("utf-8").split()
                if gone[0].is_valid:
                    found = list(zip(*(g.as_py() for g in gone), strict=True))
                    checked(words, found)
                    kept = kept_words(words, found)
                plain = b" ".join(kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(kept))
                sha.append(hashlib.sha256(plain).hexdigest())
                if keep_text:
                    texts.append(text if len(kept) == len(words) else plain.decode("utf-8"))
            if keep_text:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), *batch.columns[6:]], names=[id_col, text_col, *extra])
            else:
                yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())})

    if keep_text:
        return joined.mapInArrow(run, docs.select(id_col, text_col, *extra).schema).select(*docs.columns)
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_words bigint, n_removed bigint, kept_sha256 string"
    return joined.mapInArrow(run, schema)
