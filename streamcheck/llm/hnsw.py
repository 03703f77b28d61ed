"""Embedding near-deduplication over hierarchical navigable small-world graphs, one per shard.

Equal vectors are one class.  Classes are dealt into shards by hash; a task builds each shard's
graph.  Every class then queries every shard: a task holds one graph, of bounded size, and streams
many blocks of queries past it, so a graph is sent once for a share of all queries and not
for each block.  Searches run for many queries at a time in numpy.  A beam whose worst hit is still a link is widened until
it is not; and each task audits its recall on planted links, which every shard has however sparse
its own are, and on the links of some queries with others, and widens every beam until both audits
pass (in the limit all pairs are compared).  Audited recalls are kept with the links.  Links are
checked by their cosine in double precision, counted where they are found, and sent on as a
forest per task, so that a group of m near copies costs about m rows, not all its pairs.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamcheck.llm.components import components
from streamcheck.llm.shared import Scratch

COSINE = 0.95
LEAST_SHARDS, SHARD_ROWS, GROUP_ROWS = 8, 16384, 8192
BLOCKS = 32  # blocks of queries that one copy of a graph serves
LINKS, BUILD_BEAM, BEAM = 16, 48, 24
BRIDGES = 4  # vectors that get a link to one that no path reached
AUDIT, PLANTED, RECALL = 48, 200, 0.995
WIDEST = 1536
SELF = 1 - 1e-12  # a cosine from here on is a vector's match with itself
_TILE = 256


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Graph:
    """A navigable small-world graph with layers; layer 0 holds every vector."""

    def __init__(self, vectors: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM):
        self.x = unit(vectors.astype(np.float64)).astype(np.float32)
        n = len(self.x)
        level = (-np.log(np.random.Generator(np.random.PCG64(n)).random(n)) / np.log(links)).astype(np.int64)
        self.layers: list[np.ndarray] = []  # neighbours of each vector, -1: none; a vector above its level has none
        self.members: list[np.ndarray] = []
        order = np.argsort(-level, kind="stable")  # the entry point comes first in every layer, then the others of higher layers
        for k in range(int(level.max(initial=0)) + 1):
            self.layers.append(np.full((n, 2 * links if k == 0 else links), -1, dtype=np.int32))
            self.members.append(order[: int((level >= k).sum())])
        while len(self.members) > 1 and len(self.members[-1]) == 0:
            self.members.pop(), self.layers.pop()
        for k in range(len(self.layers) - 1, -1, -1):
            self.build(k, beam)
            self.mend(k)
        self.audited: dict[tuple[float, int], float] = {}  # recall of planted links by cosine and beam

    def build(self, layer: int, beam: int) -> None:
        nodes, done = self.members[layer], 0
        while done < len(nodes):
            batch = nodes[done : done + min(_TILE, max(64, done))]
            near = self.x[batch] @ self.x[batch].T
            np.fill_diagonal(near, -2)
            ids, sims = np.broadcast_to(batch, near.shape), near
            if done:
                found, score = self.search(self.x[batch], beam, bottom=layer)
                score = np.where(np.isin(found, batch), -2, score)  # a vector of the layer above may be in the batch
                ids, sims = np.concatenate([ids, found], axis=1), np.concatenate([near, score], axis=1)
            order = np.argsort(-sims, axis=1)[:, : beam + 16]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            chosen = self.choose(np.where(sims > -2, ids, -1), sims, self.layers[layer].shape[1] // (2 if layer == 0 else 1))
            self.layers[layer][batch, : chosen.shape[1]] = chosen
            self.link_back(layer, batch, chosen)
            done += len(batch)

    def choose(self, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
        """Of candidates sorted by similarity, those closer to the vector than to any chosen before; then the nearest others."""
        rows, width = ids.shape
        kept = np.zeros((rows, width), dtype=bool)
        for lo in range(0, rows, 64):
            part = slice(lo, lo + 64)
            v = self.x[np.maximum(ids[part], 0)]
            between = np.einsum("bid,bjd->bij", v, v)
            blocked = ids[part] < 0
            count = np.zeros(len(v), dtype=np.int64)
            for j in range(width):
                take = ~blocked[:, j] & (count < most) & ~((between[:, j, :] > sims[part, j : j + 1]) & kept[part]).any(axis=1)
                kept[part, j] |= take
                count += take
        rank = np.where(kept, 0, np.where(ids >= 0, 1, 2)) * width + np.arange(width)
        order = np.argsort(rank, axis=1)[:, :most]
        return np.take_along_axis(ids, order, 1)

    def link_back(self, layer: int, batch: np.ndarray, chosen: np.ndarray) -> None:
        links = self.layers[layer]
        to, source = chosen.ravel(), np.repeat(batch, chosen.shape[1])
        to, source = to[to >= 0], source[to >= 0]
        order = np.argsort(to, kind="stable")
        to, source = to[order], source[order]
        targets, first, counts = np.unique(to, return_index=True, return_counts=True)
        width = links.shape[1]
        extra = np.full((len(targets), int(counts.max(initial=0))), -1, dtype=np.int64)
        extra[np.repeat(np.arange(len(targets)), counts), np.arange(len(to)) - np.repeat(first, counts)] = source
        both = np.concatenate([links[targets], extra], axis=1)
        for lo in range(0, len(targets), 512):
            ids, own = both[lo : lo + 512], self.x[targets[lo : lo + 512]]
            sims = np.where(ids >= 0, np.einsum("bid,bd->bi", self.x[np.maximum(ids, 0)], own), -2)
            order = np.argsort(-sims, axis=1)[:, : width + 16]
            ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
            same = np.zeros(ids.shape, dtype=bool)
            same[:, 1:] = ids[:, 1:] == ids[:, :-1]
            ids = np.where(same, -1, ids)
            out = self.choose(ids, sims, width)
            links[targets[lo : lo + 512]] = -1
            links[targets[lo : lo + 512], : out.shape[1]] = out

    def flood(self, layer: int, met: np.ndarray, start: np.ndarray) -> None:
        """Mark in ``met`` what paths from ``start`` reach."""
        while len(start):
            met[start] = True
            around = np.unique(self.layers[layer][start])
            start = around[(around >= 0) & ~met[np.maximum(around, 0)]]

    def mend(self, layer: int) -> None:
        """Give vectors that no path from the entry point reaches links with the nearest ones that are reached.

        A cluster can keep all of its links to itself: no beam, however wide, would find it.
        """
        nodes, met, spare = self.members[layer], np.zeros(len(self.x), dtype=bool), {}
        self.flood(layer, met, self.members[-1][:1])
        while len(lost := nodes[~met[nodes]]):
            known = nodes[met[nodes]]
            near = known[np.argsort(-(self.x[known] @ self.x[lost[0]]), kind="stable")[:BRIDGES]]
            for i in near.tolist():
                spare.setdefault(i, []).append(lost[0])
            spare.setdefault(int(lost[0]), []).extend(near)
            self.flood(layer, met, lost[:1])
        if spare:
            more = np.full((len(self.x), max(map(len, spare.values()))), -1, dtype=np.int32)
            for i, to in spare.items():
                more[i, : len(to)] = to
            self.layers[layer] = np.concatenate([self.layers[layer], more], axis=1)

    def search(self, q: np.ndarray, beam: int, bottom: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities) of each query's ``beam`` best, from the top layer down to ``bottom``; -1 where there are fewer.

        The last layer is entered at what the layer above found, which may be unlinked there while it is built, and at the entry point.
        """
        out_i, out_s = [], []
        for lo in range(0, len(q), _TILE):
            part = q[lo : lo + _TILE]
            entry = np.broadcast_to(self.members[-1][:1], (len(part), 1))
            start = entry
            for k in range(len(self.layers) - 1, bottom, -1):
                start, _ = self.walk(part, start, k, 4)
            if bottom < len(self.layers) - 1:
                start = np.concatenate([start, np.where((start == entry).any(axis=1, keepdims=True), -1, entry)], axis=1)
            start, sims = self.walk(part, start, bottom, beam)
            out_i.append(start)
            out_s.append(sims)
        return (np.concatenate(out_i), np.concatenate(out_s)) if out_i else (np.zeros((0, beam), np.int64), np.zeros((0, beam), np.float32))

    def walk(self, q: np.ndarray, start: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        links, m, at_once = self.layers[layer], len(q), max(1, beam // 24)
        seen = np.zeros((m, len(self.x) + 1), dtype=bool)  # the last column stands for no neighbour
        ids = np.full((m, beam), -1, dtype=np.int64)
        sims = np.full((m, beam), -2, dtype=np.float32)
        begin = start[:, : min(beam, start.shape[1])]
        ids[:, : begin.shape[1]] = begin
        sims[:, : begin.shape[1]] = np.where(begin >= 0, np.einsum("bid,bd->bi", self.x[np.maximum(begin, 0)], q), -2)
        np.put_along_axis(seen, np.where(begin >= 0, begin, len(self.x)), True, 1)
        open_ = ids >= 0
        live = np.arange(m)
        while len(live):
            mine = open_[live]
            pick = np.argsort(~mine, axis=1, kind="stable")[:, :at_once]  # beams are sorted: the best open ones
            rows = live[:, None]
            good = np.take_along_axis(mine, pick, 1)
            open_[rows, pick] = False
            around = np.where(good[:, :, None], links[np.maximum(ids[rows, pick], 0)], -1).reshape(len(live), -1)
            around = np.where(around < 0, len(self.x), around)
            around = np.sort(around, axis=1)  # neighbours may repeat
            fresh = ~seen[rows, around]
            fresh[:, 1:] &= around[:, 1:] != around[:, :-1]
            fresh &= around < len(self.x)
            seen[rows, around] = True
            score = np.where(fresh, np.einsum("bid,bd->bi", self.x[np.minimum(around, len(self.x) - 1)], q[live]), -2).astype(np.float32)
            all_s = np.concatenate([sims[live], score], axis=1)
            all_i = np.concatenate([ids[live], np.where(fresh, around, -1)], axis=1)
            all_o = np.concatenate([open_[live], fresh], axis=1)
            order = np.argsort(-all_s, axis=1, kind="stable")[:, :beam]
            sims[live], ids[live], open_[live] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1), np.take_along_axis(all_o, order, 1)
            live = live[open_[live].any(axis=1)]
        return ids, sims

    def within(self, q: np.ndarray, least: float, beam: int) -> list[np.ndarray]:
        """Ids of similarity at or over ``least`` for each query; full beams of such are widened.

        A query that still fills a beam of ``WIDEST`` is in a large cluster: to compare it with the whole
        shard, a block of queries at a time, is less work than a wider beam.
        """
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
        todo, n = np.arange(len(q)), len(self.x)
        while len(todo):
            if beam > WIDEST and beam < n:
                for lo in range(0, len(todo), 64):
                    part = todo[lo : lo + 64]
                    for r, row in zip(part.tolist(), q[part] @ self.x.T, strict=True):
                        out[r] = np.flatnonzero(row >= least)
                break
            wide = min(beam, n)
            ids, sims = self.search(q[todo], wide)
            for r, i, s in zip(todo.tolist(), ids, sims, strict=True):
                out[r] = i[s >= least]
            full = (sims[:, -1] >= least) if wide < n else np.zeros(len(todo), dtype=bool)
            todo, beam = todo[full], beam * 4
        return out


def exact_links(q: np.ndarray, x: np.ndarray, cosine: float) -> list[np.ndarray]:
    """Brute force, in blocks: ids of unit vectors ``x`` whose cosine reaches ``cosine``, in double precision."""
    return [np.flatnonzero(row >= cosine) for lo in range(0, len(q), 64) for row in q[lo : lo + 64] @ x.T]


def planted(x: np.ndarray, n: int, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(origins, vectors): ``n`` seeded perturbations of vectors spread over ``x``, just over ``cosine`` from their origins."""
    origin = np.linspace(0, len(x) - 1, n).astype(np.int64)
    v, noise = x[origin], np.random.Generator(np.random.PCG64(len(x))).normal(size=(n, x.shape[1]))
    noise -= (noise * v).sum(axis=1, keepdims=True) * v
    c = cosine + 0.02 * (1 - cosine)
    return origin, unit(c * v + np.sqrt(1 - c * c) * noise / np.maximum(np.sqrt((noise * noise).sum(axis=1, keepdims=True)), 1e-300))


def audited_beam(graph: Graph, x: np.ndarray, q: np.ndarray, cosine: float, beam: int = BEAM, audit: int = AUDIT, recall: float = RECALL) -> tuple[float, int]:
    """(audited recall, beam): beams double until the audit passes; if none does it is the whole shard, and all pairs are compared."""
    few = np.unique(np.linspace(0, len(q) - 1, min(audit, len(q))).astype(np.int64))
    truth = [t[x[t] @ v < SELF] for t, v in zip(exact_links(q[few], x, cosine), q[few], strict=True)]
    origin, probes = planted(x, PLANTED, cosine)  # the same for all blocks of queries
    total, slack = sum(map(len, truth)), cosine - 1e-4
    while PLANTED < len(x) > beam:  # all pairs of a smaller shard are less work than its audit
        found = graph.within(q[few].astype(np.float32), slack, beam)
        hit = sum(np.isin(t, f).sum() for t, f in zip(truth, found, strict=True))
        if (cosine, beam) not in graph.audited:
            graph.audited[cosine, beam] = sum(o in f for o, f in zip(origin, graph.within(probes.astype(np.float32), slack, beam), strict=True)) / len(origin)
        audited = min(graph.audited[cosine, beam], hit / total if total else 1.0)
        if audited >= recall:
            return float(audited), beam
        beam *= 2
    return 1.0, len(x)


def links_of(graph: Graph, x: np.ndarray, q: np.ndarray, cosine: float, beam: int) -> list[np.ndarray]:
    """Ids linked with each query: found by the beam and verified in double precision, or by comparing all where it is the whole shard."""
    if beam >= len(x):
        return exact_links(q, x, cosine)
    return [i[(x[i] @ v) >= cosine] for i, v in zip(graph.within(q.astype(np.float32), cosine - 1e-4, beam), q, strict=True)]


def shard_links(graph: Graph, x: np.ndarray, q: np.ndarray, cosine: float, beam: int = BEAM, audit: int = AUDIT, recall: float = RECALL) -> tuple[list[np.ndarray], float, int]:
    """(linked ids by query, audited recall, beam)."""
    if not len(q):
        return [], 1.0, beam
    audited, beam = audited_beam(graph, x, q, cosine, beam, audit, recall)
    return links_of(graph, x, q, cosine, beam), audited, beam


class Unions:
    """Links of queries with the vectors of a shard, kept as a forest: memory goes with vectors and queries, not with links."""

    def __init__(self, reps: np.ndarray):
        self.reps, self.label = reps, np.arange(len(reps))
        self.place = {int(r): i for i, r in enumerate(reps.tolist())}
        self.edges: list[tuple[int, int]] = []

    def add(self, query: int, linked: np.ndarray) -> None:
        """One edge for each tree that the query links to and is not in."""
        labels, at = np.unique(self.label[linked], return_index=True)
        if not len(labels):
            return
        own = self.place.get(query)
        tree = -1 if own is None else self.label[own]
        self.edges += [(query, int(self.reps[linked[k]])) for k in at[labels != tree].tolist()]
        tree = labels[0] if own is None else tree
        others = labels[labels != tree]
        if len(others):
            self.label[np.isin(self.label, others)] = tree


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, digest, vector): null digest and vector where the row links with nothing."""
    kind = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = []
            for v in batch.column(1):
                x = np.array([np.nan if e is None else e for e in v.as_py()], dtype=np.float64) + 0.0 if v.is_valid else np.zeros(0)
                norm = (x * x).sum() if np.isfinite(x).all() else 0.0
                raw.append(x.tobytes() if batch.column(0)[len(raw)].is_valid and 0 < norm < np.inf else None)
            yield pa.RecordBatch.from_pydict({"id": batch.column(0), "digest": pa.array([None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in raw], pa.binary()), "vector": pa.array(raw, pa.binary())})

    return vectors.select(id_col, F.col(vector_col).cast("array<double>")).mapInArrow(run, f"id {kind}, digest binary, vector binary")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return unit(np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1))


def embedding_dedup(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, shard_rows: int = SHARD_ROWS, group_rows: int = GROUP_ROWS, least_shards: int = LEAST_SHARDS) -> DataFrame:
    """Link vectors whose cosine is at least ``cosine``.

    Returns one row per input row: ``id_col``, ``n_links`` (other rows linked directly),
    ``component_id`` (smallest id reachable), ``kept``, and ``audited_recall``, the least that any
    task's audit measured for its searches.  Vectors that are null, zero or hold a null or
    non-finite component, and rows without an id, link with nothing.  Vectors of different
    lengths link with nothing of another length.  A vertex is a class of equal vectors, so rows
    that repeat an id each have the links of their own vector.  Other columns are not read.
    """
    scratch = Scratch(vectors.sparkSession, "hnsw")
    rows = scratch.write(clean(vectors, id_col, vector_col), "rows")
    classes = rows.where("digest is not null").groupBy("digest").agg(F.min("id").cast("bigint").alias("least_id"), F.first("vector").alias("vector"), F.count("*").alias("size"))
    classes = classes.withColumns({"dim": (F.octet_length("vector") / 8).cast("int"), "rep": F.xxhash64("digest")})
    classes = scratch.write(classes, "classes")
    n = classes.count()
    shards, splits = max(least_shards, -(-n // shard_rows)), max(1, -(-n // (group_rows * BLOCKS)))
    dealt = classes.withColumns({"shard": F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"), "part": F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(splits)).cast("int")})

    def build(key: tuple, table: pa.Table) -> pa.Table:
        x = matrix(table["vector"])
        blob = pickle.dumps((Graph(x), x, table["rep"].to_numpy(), table["size"].to_numpy()), protocol=5)
        return pa.table({"dim": [key[0].as_py()], "shard": [key[1].as_py()], "graph": pa.array([blob], pa.binary())}, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("graph", pa.binary())]))

    # Partition numbers are given: a (shard, part) is heavy work on few bytes, which must not be coalesced.
    graphs = scratch.write(dealt.repartition(2 * shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, graph binary"), "graphs")
    queries = dealt.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), "part", F.lit(1).alias("kind"), "rep", "vector")
    copies = graphs.select("dim", "shard", F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("part"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("rep"), F.col("graph").alias("vector"))

    def answer(held: tuple, own: np.ndarray, q: np.ndarray) -> pa.RecordBatch:
        graph, x, reps, sizes = held
        recall, beam = audited_beam(graph, x, q, cosine)
        counts, unions = [], Unions(reps)
        for lo in range(0, len(q), _TILE):
            for i, r in zip(links_of(graph, x, q[lo : lo + _TILE], cosine, beam), own[lo : lo + _TILE].tolist(), strict=True):
                i = i[reps[i] != r]
                counts.append(int(sizes[i].sum()))
                unions.add(r, i)
        edges = unions.edges
        at = [k for k, c in enumerate(counts) if c]
        return pa.RecordBatch.from_pydict({
            "kind": pa.array([0] * len(at) + [1] * len(edges) + [2], pa.int32()),  # 2: beam and audited recall in millionths
            "x": pa.array([int(own[k]) for k in at] + [a for a, _ in edges] + [beam], pa.int64()),
            "y": pa.array([counts[k] for k in at] + [b for _, b in edges] + [int(recall * 1e6)], pa.int64()),
        })

    def query(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, own, raw = None, None, [], []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            place = list(zip(*(table[c].to_pylist() for c in ("dim", "shard", "part", "kind")), strict=True))
            cuts = [0, *(i for i in range(1, len(place)) if place[i] != place[i - 1]), len(place)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi == lo:
                    continue
                if place[lo][:3] != key or not place[lo][3]:
                    if own:
                        yield answer(held, np.array(own), unit(np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)))
                    key, held, own, raw = place[lo][:3], None, [], []
                if not place[lo][3]:
                    held = pickle.loads(table["vector"][lo].as_py())
                    continue
                if not held:  # a shard without vectors of this length has no graph and no link
                    continue
                at = lo
                while at < hi:
                    end = min(hi, at + group_rows - len(own))
                    own += table["rep"].slice(at, end - at).to_pylist()
                    raw += table["vector"].slice(at, end - at).to_pylist()
                    at = end
                    if len(own) >= group_rows:
                        yield answer(held, np.array(own), unit(np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)))
                        own, raw = [], []
        if own:
            yield answer(held, np.array(own), unit(np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)))

    keys = ["dim", "shard", "part"]
    asked = copies.unionByName(queries).repartition(2 * shards * splits, *keys).sortWithinPartitions(*keys, "kind")
    found = scratch.write(asked.mapInArrow(query, "kind int, x bigint, y bigint"), "found")
    recall = found.where("kind = 2").agg(F.min("y")).first()[0]
    comp = components(found.where("kind = 1"), scratch, "links", "x", "y")
    counts = found.where("kind = 0").groupBy(F.col("x").alias("rep")).agg(F.sum("y").alias("others"))
    label = classes.select("digest", "rep", "least_id", "size").join(counts, "rep", "left").join(comp, F.col("rep") == F.col("id"), "left")
    label = scratch.write(label.select("digest", "least_id", (F.coalesce("others", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("root")), "labels")
    least = scratch.write(label.groupBy("root").agg(F.min("least_id").alias("component")), "roots")
    scratch.drop("graphs", "classes")
    return rows.select("id", "digest").join(label.join(least, "root"), "digest", "left").select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component", "id"), F.lit(False)).alias("kept"),
        F.lit(1.0 if recall is None else recall / 1e6).alias("audited_recall"),
    )
