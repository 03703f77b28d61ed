"""MinHash near-deduplication with circulant permutations and exact verification.

Two permutations of the 32-bit integers make a whole signature: ``sigma`` scatters a
document's shingles, and coordinate k is the smallest ``pi`` of sigma's values circularly
shifted by k.  Coordinates in bands of ``rows`` name the buckets in which candidates meet.

Documents with equal shingle sets are one class, so copies cost one row each.  Candidates
are never expanded into all pairs of a bucket.  First, every member of a bucket is checked
against two hubs of it; the links that hold give components.  Then only buckets in which
more than one component is left go on: their members are dealt into cells of bounded size so
that every two of different components meet in a cell, and there signatures tell which may
still be similar.  Components that may touch form clusters, and the documents concerned meet
once more, by cluster and with their full sets, in cells of bounded size; pairs that links
have joined meanwhile are skipped.  So every colliding pair whose signatures allow it is
either checked or already in one component.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamcheck.llm import textkit
from streamcheck.llm.components import components
from streamcheck.llm.shared import Scratch

BANDS, ROWS, CELL = 25, 4, 1000
_CHUNK = 1 << 17


def sigma(values: np.ndarray) -> np.ndarray:
    """First permutation: 64-bit shingle hashes, folded to 32 bits and scattered."""
    x = (values >> np.uint64(32)).astype(np.uint32) ^ values.astype(np.uint32)
    x *= np.uint32(0x9E3779B1)
    x ^= x >> np.uint32(15)
    return x * np.uint32(0x85EBCA77)


def pi(x: np.ndarray) -> np.ndarray:
    """Second permutation of the 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


def signatures(shingles: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """(documents, size) signature; rows of documents without shingles hold the largest value."""
    out = np.full((size, len(first) - 1), 2**32 - 1, dtype=np.uint32)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out.T
    scattered = sigma(shingles)
    bounds = first[full]
    for lo in range(0, len(scattered), _CHUNK):
        hi = min(lo + _CHUNK, len(scattered))
        i = int(np.searchsorted(bounds, lo, side="right")) - 1
        j = int(np.searchsorted(bounds, hi))
        cuts = np.maximum(bounds[i:j], lo) - lo
        for k in range(size):
            found = np.minimum.reduceat(pi(scattered[lo:hi] - np.uint32(k)), cuts)
            out[k, full[i:j]] = np.minimum(out[k, full[i:j]], found)
    return out.T


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature[:, : bands * rows].astype(np.uint64).reshape(len(signature), bands, rows)
    keys = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), parts.shape[:2])
    for r in range(rows):
        keys = textkit.mix(keys ^ parts[:, :, r]) * np.uint64(0xD6E8FEB86659FD93)
    return keys.view(np.int64)


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def sketch(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int, lower: bool = True) -> DataFrame:
    """(id, fp, n_shingles, digest, keys, signature): one row per document; ``fp`` is a hash of its text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, _, _, _, first, hashes in textkit.text_groups(batch.column(1), lower=lower):
                sets, at = textkit.shingle_sets(hashes, first, words)
                raw, n = sets.view(np.uint8), np.diff(at)
                found = signatures(sets, at, bands * rows)
                keys = band_keys(found, bands, rows)
                empty = n == 0
                low = np.ascontiguousarray(found.astype(np.uint8))
                yield pa.RecordBatch.from_pydict({
                    "id": batch.column(0).slice(i, j - i),
                    "fp": batch.column(2).slice(i, j - i),
                    "n_shingles": pa.array(n),
                    "digest": pa.array([hashlib.blake2b(raw[a:b], digest_size=16).digest() if b > a else None for a, b in zip((at[:-1] * 8).tolist(), (at[1:] * 8).tolist(), strict=True)], pa.binary()),
                    "keys": pa.array([None if e else k for e, k in zip(empty, keys, strict=True)], pa.list_(pa.int64())),
                    "signature": pa.array([None if e else s.tobytes() for e, s in zip(empty, low, strict=True)], pa.binary()),
                })

    return docs.select(id_col, text_col, text_hash(text_col)).mapInArrow(run, f"id {kind}, fp bigint, n_shingles bigint, digest binary, keys array<bigint>, signature binary")


def shingle_table(docs: DataFrame, text_col: str, words: int, lower: bool = True) -> DataFrame:
    """(digest, shingles): the sorted distinct shingle hashes of each document, and the digest that names its class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, _, _, _, first, hashes in textkit.text_groups(batch.column(0), lower=lower):
                sets, at = textkit.shingle_sets(hashes, first, words)
                raw = sets.tobytes()
                own = [raw[8 * a : 8 * b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"digest": pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in own], pa.binary()), "shingles": pa.array(own, pa.binary())})

    return docs.select(text_col).mapInArrow(run, "digest binary, shingles binary")


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, of sorted distinct values."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(a) + len(b) - same)


def least_agreement(size: int, percent: int) -> int:
    """Signatures of a pair that reaches ``percent`` agree in fewer places with a chance under 1e-5."""
    p = percent / 100
    return int(np.floor(size * p - 4.4 * np.sqrt(size * p * (1 - p))))


def may_match(pairs: DataFrame, least: int) -> DataFrame:
    """Pairs (a, b, sa, sb) whose signatures agree in enough places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sa, sb = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
            keep = pa.array((sa == sb).sum(axis=1) >= least)
            yield batch.select([0, 1]).filter(keep)

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach ``percent``."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("xa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("xb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "xa", "xb").mapInArrow(run, "a bigint, b bigint")


def cells(members: DataFrame, cell: int, scratch: Scratch, name: str) -> DataFrame:
    """Deal the members (bucket, id, comp; a written table) of buckets with more than one component into cells.

    The bucket's first component is dealt into blocks and so are all others; each block meets
    each block of the others in a cell of at most about two blocks.  A bucket of one block
    gives each member one row.
    """
    by_comp = members.groupBy("bucket", "comp").agg(F.count("*").alias("n"))
    info = by_comp.groupBy("bucket").agg(F.min("comp").alias("base"), F.max("comp").alias("top"), F.min_by("n", "comp").alias("n_own"), F.sum("n").alias("n")).where("base <> top")
    blocks = scratch.write(info.select("bucket", "base", "n", F.ceil(F.col("n_own") / cell).alias("p"), F.ceil((F.col("n") - F.col("n_own")) / cell).alias("q")), name)
    placed = members.join(blocks, "bucket").withColumns({"own": F.col("comp") == F.col("base"), "h": F.xxhash64("id")})

    def cell_of(kind: int, i: Column, j: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))

    mine_p, mine_q = F.expr("int(pmod(h, p))"), F.expr("int(pmod(h, q))")
    as_own = F.transform(F.expr("sequence(0, int(q) - 1)"), lambda j: cell_of(0, mine_p, j))
    as_other = F.concat(
        F.transform(F.expr("sequence(0, int(p) - 1)"), lambda i: cell_of(0, i, mine_q)),
        F.transform(F.expr("sequence(0, int(q) - 1)"), lambda j: cell_of(1, F.least(j, mine_q), F.greatest(j, mine_q))),
    )
    whole = F.array(cell_of(2, F.lit(0), F.lit(0)))
    dealt = F.when(F.col("n") <= cell, whole).when(F.col("own"), as_own).otherwise(as_other)
    return placed.select("bucket", F.explode(dealt).alias("cell"), "id", "comp")


def in_cells(dealt: DataFrame, work: Callable[[pa.Table], tuple[list, list, list]], columns: list[str]) -> DataFrame:
    """(kind, x, y) rows that ``work`` makes of each cell; a cell is a run of sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in itertools.chain(batches_of(batches), [None]):
            table = held if batch is None else pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            key = np.column_stack([table[c].to_numpy() for c in ("bucket", "kind", "i", "j")])
            cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            bounds = [0, *cuts.tolist()] + ([table.num_rows] if batch is None else [])
            held = table.slice(bounds[-1]) if batch is not None else None
            kinds, xs, ys = [], [], []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if hi - lo > 1:
                    k, x, y = work(table.slice(lo, hi - lo))
                    kinds += k
                    xs += x
                    ys += y
            yield pa.RecordBatch.from_pydict({"kind": pa.array(kinds, pa.int32()), "x": pa.array(xs, pa.int64()), "y": pa.array(ys, pa.int64())})

    keys = ["bucket", "kind", "i", "j"]
    flat = dealt.select("bucket", "cell.kind", "cell.i", "cell.j", *columns).repartition(*keys).sortWithinPartitions(*keys)
    return flat.mapInArrow(run, "kind int, x bigint, y bigint")


def batches_of(batches: Iterator[pa.RecordBatch], rows: int = 2000) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def signature_rows(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table["signature"].to_pylist()), np.uint8).reshape(table.num_rows, -1)


def suspects(dealt: DataFrame, least: int) -> DataFrame:
    """Of each cell: kind 1, (component, component) that may touch, a forest of them; kind 0, (id, component) of members concerned."""

    def work(table: pa.Table) -> tuple[list, list, list]:
        signature, ids, comp = signature_rows(table), table["id"].to_numpy(), table["comp"].to_numpy()
        label, hit, found = comp.copy(), np.zeros(len(ids), dtype=bool), []
        for lo in range(0, len(ids), 32):
            near = ((signature[lo : lo + 32, None] == signature[None]).sum(axis=2) >= least) & (comp[lo : lo + 32, None] != comp[None])
            hit |= near.any(axis=0)
            for r in np.flatnonzero(near.any(axis=1)).tolist():
                i = lo + r
                for other in np.unique(comp[near[r]]).tolist():
                    a, b = label[i], label[comp == other][0]
                    if a != b:
                        found.append((int(comp[i]), other))
                        label[label == b] = a
        at = np.flatnonzero(hit)
        return [0] * len(at) + [1] * len(found), ids[at].tolist() + [a for a, _ in found], comp[at].tolist() + [b for _, b in found]

    return in_cells(dealt, work, ["id", "comp", "signature"]).distinct()


def cell_links(dealt: DataFrame, least: int, percent: int) -> DataFrame:
    """(a, b): links between components that meet in a cell; pairs that earlier links of the cell join are skipped."""

    def work(table: pa.Table) -> tuple[list, list, list]:
        signature, ids, label = signature_rows(table), table["id"].to_pylist(), table["comp"].to_numpy().copy()
        sets, xs, ys = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["shingles"]], [], []
        for i in range(len(ids) - 1):
            others = np.flatnonzero(label[i + 1 :] != label[i]) + i + 1
            agree = (signature[i] == signature[others]).sum(axis=1)
            for j in others[np.argsort(-agree, kind="stable")[: int((agree >= least).sum())]].tolist():
                if label[i] != label[j] and similar(sets[i], sets[j], percent):
                    xs.append(ids[i])
                    ys.append(ids[j])
                    label[label == label[j]] = label[i]
        return [0] * len(xs), xs, ys

    return in_cells(dealt, work, ["id", "comp", "signature", "shingles"]).select(F.col("x").alias("a"), F.col("y").alias("b"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, cell: int = CELL, lower: bool = True, text_fp: bool = False) -> DataFrame:
    """Link documents whose shingle sets have 100 * intersection >= percent * union.

    Returns one row per input row: ``id_col`` (an integer), ``n_shingles``, ``component_id``
    (the smallest id reachable by links, itself included), ``kept`` (it is its own
    component), and on request ``text_fp`` (``text_hash``, which tells rows of one id apart).  ASCII letters
    count as lower case; fewer than ``words`` words make one shingle; null, empty or blank text makes
    none and links with nothing.  A vertex is a class of equal sets, so rows that repeat an id
    each have the component of their own text; a null id gets the component of its equals, and is
    never kept beside them.
    """
    scratch = Scratch(docs.sparkSession, "minhash")
    least = least_agreement(bands * rows, percent)
    sketches = scratch.write(sketch(docs, id_col, text_col, words, bands, rows, lower), "sketches")
    full = sketches.where("n_shingles > 0")
    classes = full.groupBy("digest").agg(F.min("id").cast("bigint").alias("least_id"), F.first("keys").alias("keys"), F.first("signature").alias("signature"))
    classes = scratch.write(classes.withColumn("id", F.xxhash64("digest")), "classes")  # a class's vertex: ids may repeat
    known = classes.where("least_id is not null")
    members = scratch.write(known.select(F.explode("keys").alias("bucket"), "id"), "members")
    hubs = members.groupBy("bucket").agg(F.min("id").alias("h1"), F.min_by("id", F.xxhash64("id", F.lit(17))).alias("h2"), F.max("id").alias("top")).where("h1 <> top").select("bucket", "h1", "h2")
    hubs = scratch.write(hubs, "hubs")
    shared = scratch.write(members.join(hubs, "bucket"), "shared")  # members of buckets that hold more than one class
    star = shared.select(F.col("id").alias("a"), F.explode(F.array("h1", "h2")).alias("b")).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    signature = known.select("id", "signature")
    pairs = star.join(signature.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a").join(signature.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b")
    pairs = scratch.write(may_match(pairs, least), "pairs")
    # One shuffle of texts serves both checks: those of one row of each class that shares a bucket, and of rows that repeat its id.
    texts = docs.select(F.col(id_col).cast("bigint").alias("least_id"), F.col(text_col).alias("text"))
    wanted = known.join(shared.select("id").distinct(), "id", "left_semi").select("least_id").distinct()
    made = shingle_table(texts.join(wanted, "least_id", "left_semi"), "text", words, lower)
    sets = scratch.write(made.groupBy(F.xxhash64("digest").alias("id")).agg(F.max("shingles").alias("shingles")), "sets")
    links = scratch.write(verified(pairs, sets, percent), "links")
    comp = components(links, scratch, "stars")

    rest = scratch.write(shared.select("bucket", "id").join(comp, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("comp")), "rest")
    found = scratch.write(suspects(cells(rest, cell, scratch, "rest-blocks").join(signature, "id"), least), "suspects")
    touching = found.where("kind = 1").select(F.col("x").alias("a"), F.col("y").alias("b"))
    if not touching.isEmpty():
        cluster = components(touching, scratch, "clusters").select(F.col("id").alias("comp"), F.col("component").alias("cluster"))
        again = found.where("kind = 0").select(F.col("x").alias("id"), F.col("y").alias("comp")).join(cluster, "comp", "left")
        again = scratch.write(again.select(F.coalesce("cluster", "comp").alias("bucket"), "id", "comp"), "again")
        dealt = cells(again, cell, scratch, "again-blocks").join(signature, "id").join(sets, "id")
        links = scratch.write(links.union(cell_links(dealt, least, percent)).distinct(), "all-links")
        comp = components(links, scratch, "all")
    own = classes.join(comp.withColumnRenamed("id", "vertex"), F.col("id") == F.col("vertex"), "left").select("digest", "least_id", F.coalesce("component", "id").alias("root"))
    label = own.join(scratch.write(own.groupBy("root").agg(F.min("least_id").alias("component")), "roots"), "root").select("digest", "component")
    scratch.drop("members", "hubs", "pairs", "sets")
    return sketches.join(label, "digest", "left").select(
        F.col("id").alias(id_col),
        "n_shingles",
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id").eqNullSafe(F.coalesce("component", "id")), F.lit(False)).alias("kept"),
        *([F.col("fp").alias("text_fp")] if text_fp else []),
    )
