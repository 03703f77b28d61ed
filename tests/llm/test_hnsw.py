"""Embedding near-deduplication against brute force."""

import math
import tracemalloc

import numpy as np
import pytest

from streamcheck.llm import queries
from streamcheck.llm.hnsw import Graph, Unions, audited_beam, embedding_dedup, exact_links, links_of, shard_links, unit


def brute(rows, cosine):
    """{row number: (n_links, component)} by all pairs in double precision."""
    good = []
    for k, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(e is not None and math.isfinite(e) for e in v) and any(v):
            good.append(k)
    links, parent = {k: set() for k in range(len(rows))}, {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for dim in {len(rows[k][1]) for k in good}:
        own = [k for k in good if len(rows[k][1]) == dim]
        x = unit(np.array([rows[k][1] for k in own], dtype=np.float64))
        for a, near in enumerate(x @ x.T >= cosine):
            for b in np.flatnonzero(near):
                if a != b:
                    links[own[a]].add(own[b])
                    p, q = find(rows[own[a]][0]), find(rows[own[b]][0])
                    parent[max(p, q)] = min(p, q)
    return {k: (len(links[k]), find(i) if i is not None else None) for k, (i, v) in enumerate(rows)}


def clustered(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 10, dim))
    x = base[rng.integers(0, len(base), n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.1, 0.6], (n, 1))
    x[n // 2 : n // 2 + n // 5] = base[0] + rng.normal(size=(n // 5, dim)) * 0.03  # one large dense group
    return x.astype(np.float32)


@pytest.mark.parametrize("seed", [1, 2])
def test_graph_finds_neighbours(seed):
    x = unit(clustered(seed, 3000).astype(np.float64))
    found, recall, _ = shard_links(Graph(x), x, x, 0.95)
    truth = exact_links(x, x, 0.95)
    assert recall >= 0.99
    assert sum(np.isin(t, f).sum() for t, f in zip(truth, found, strict=True)) >= 0.99 * sum(map(len, truth))
    assert all(np.isin(f, t).all() for t, f in zip(truth, found, strict=True))


def test_audit_has_evidence_where_links_are_sparse():
    """No audited query has a link, and the graph is too thin for the first beam."""
    rng = np.random.default_rng(5)
    x = unit(rng.normal(size=(2000, 32)))
    q = rng.normal(size=(470, 32))
    for k in set(range(len(q))) - set(np.linspace(0, len(q) - 1, 48).astype(int).tolist()):
        q[k] = x[k + 500] + 0.05 * rng.normal(size=32)
    q = unit(q)
    found, recall, _ = shard_links(Graph(x, links=2, beam=2), x, q, 0.95)
    truth = exact_links(q, x, 0.95)
    assert recall >= 0.995
    assert sum(np.isin(t, f).sum() for t, f in zip(truth, found, strict=True)) >= 0.98 * sum(map(len, truth))


@pytest.mark.parametrize("n", [1, 2, 3, 40])
def test_small_graphs(n):
    x = unit(np.random.default_rng(n).normal(size=(n, 4)))
    found, recall, _ = shard_links(Graph(x), x, x, 0.5)
    assert recall == 1.0 and [sorted(f.tolist()) for f in found] == [t.tolist() for t in exact_links(x, x, 0.5)]


def test_unions_connect_what_all_links_connect():
    rng = np.random.default_rng(2)
    for _ in range(30):
        reps = rng.permutation(40)[:25]
        u, trees = Unions(reps), {i: i for i in range(60)}

        def root(v, trees=trees):
            while trees[v] != v:
                v = trees[v]
            return v

        for query in rng.permutation(60)[:30].tolist():
            linked = np.unique(rng.integers(0, 25, rng.integers(0, 4)))
            linked = linked[reps[linked] != query]
            u.add(query, linked)
            for r in reps[linked].tolist():
                trees[root(query)] = root(r)
        told = {i: i for i in range(60)}
        for a, b in u.edges:
            told[root(a, told)] = root(b, told)
        assert len({(root(a), root(a, told)) for a in range(60)}) == len({root(a) for a in range(60)}) == len({root(a, told) for a in range(60)})
        assert len(u.edges) <= 55


def test_thousands_of_near_copies_take_memory_for_vectors_not_for_pairs():
    rng = np.random.default_rng(9)
    x = unit(rng.normal(size=(1, 32)) + rng.normal(size=(4096, 32)) * 0.02)
    graph = Graph(x)
    tracemalloc.start()
    recall, beam = audited_beam(graph, x, x, 0.95)
    unions, n = Unions(np.arange(len(x))), 0
    for lo in range(0, len(x), 256):
        for q, i in zip(range(lo, lo + 256), links_of(graph, x, x[lo : lo + 256], 0.95, beam), strict=True):
            n += len(i) - 1
            unions.add(q, i[i != q])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert recall >= 0.995 and n >= 0.995 * sum(len(t) - 1 for t in exact_links(x, x, 0.95))
    assert len(unions.edges) == len(x) - 1 and peak < 400e6


def test_groups_without_a_graph_come_to_an_end(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links) for r in embedding_dedup(df, group_rows=2).collect()) == [(1, 1), (2, 1), (3, 0)]


def test_query_searches_graphs(spark):
    """Shards of more vectors than are compared pair by pair, through the query; near copies are planted among them."""
    rows = [(r.vec_id, [float(e) for e in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()]
    rng = np.random.default_rng(3)
    rows += [(100_000 + k, (np.array(rows[7 * k % len(rows)][1]) * (1 + 0.02 * rng.normal(size=len(rows[0][1])))).tolist()) for k in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = embedding_dedup(df, least_shards=4).collect()
    want = {rows[k][0]: r for k, r in brute(rows, 0.95).items()}
    found, all_links = sum(r.n_links for r in out), sum(n for n, _ in want.values())
    assert all_links >= 1000 and 0.99 * all_links <= found <= all_links
    assert sum(want[r.vec_id][1] == r.component_id for r in out) >= 0.99 * len(out) and min(r.audited_recall for r in out) >= 0.995


def test_rows(spark):
    x = clustered(4, 400)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000 + i, x[0].tolist()) for i in range(50)]  # equal vectors
    rows += [(2000, [float(e) * 2 for e in x[1]]), (2001, None), (2002, [0.0] * 16), (2003, [math.nan] * 16), (2004, [None] * 16), (2005, [math.inf] + [0.0] * 15), (2006, []), (2007, [1.0, 2.0]), (2008, [1.0, 2.0]), (None, x[2].tolist()), (2009, [-0.0, 1.0]), (2010, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, "c") for i, v in rows], "vec_id long, embedding array<float>, rep int, component string").repartition(4)
    rows = [(i, None if v is None else [None if e is None else float(np.float32(e)) for e in v]) for i, v in rows]
    want = {rows[k][0]: r for k, r in brute(rows, 0.95).items()}
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(df).collect()}
    assert got == want
    assert embedding_dedup(df.limit(0)).count() == 0
    again = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup(df, shard_rows=60, group_rows=100).collect()}
    assert again == want


def test_query_on_embeddings(spark):
    rows = [(r.vec_id, [float(e) for e in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op3_embeddings(spark, "/root/testdata/sf0.001").collect()}
    assert got == {rows[k][0]: (n, c, c == rows[k][0]) for k, (n, c) in brute(rows, 0.95).items()}


@pytest.mark.parametrize("kind", ["spread", "clusters"])
def test_every_vector_is_reached_from_the_entry_point(kind):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 48))
    if kind == "clusters":
        x = x[rng.integers(0, 12, 3000)] + rng.normal(size=(3000, 48)) * 0.05
    graph = Graph(x)
    for layer, nodes in enumerate(graph.members):
        met = np.zeros(3000, dtype=bool)
        graph.flood(layer, met, graph.members[-1][:1])
        assert met[nodes].all() and nodes[0] == graph.members[-1][0]
    ids, sims = graph.search(unit(x).astype(np.float32), 24)
    assert (ids == np.arange(3000)[:, None]).any(axis=1).mean() > 0.99
    assert all(len(set(row)) == len(row) for row in ids.tolist())
