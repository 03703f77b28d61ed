"""The trie of rebuilt conversations against a plain dictionary of prefixes."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from streamcheck.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def plain(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, t) for _, r, t in sorted(x)] for c, x in turns.items()}
    members = {}
    for c, x in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + x[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, len(path) == d))
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[x] for x in below) if below else 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        saved[node] = (len(members[node]) - 1) * words + sum(saved[x] for x in below)
    out = []
    for node, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, end in m if end))
        out.append((min(m)[0], len(node), min(members[node[:-1]])[0] if node else None, len(m), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, **options):
    return sorted((tuple(r) for r in trie.prefix_trie(spark.createDataFrame(rows, SCHEMA), **options).collect()), key=str)


def test_query_on_conversations(spark):
    from streamcheck.llm.queries import op11_trie

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in op11_trie(spark, "/root/testdata/sf0.01").collect()), key=str) == plain(rows)


@pytest.mark.parametrize("heavy", [1, 5, 20_000])
def test_few_words_many_shared_prefixes(spark, heavy, monkeypatch):
    draw = random.Random(heavy)
    rows = []
    for c in range(160):
        for turn in range(draw.choice([1, 2, 3, 4, 6, 9])):
            rows.append((c, draw.choice([turn, turn, turn, None]), draw.choice(["a", "b", None]), draw.choice(["x", "x y", "", None, "z\tz  z"])))
    assert found(spark, rows, heavy=heavy) == plain(rows)


def test_copies_long_conversations_and_edges(spark, monkeypatch):
    monkeypatch.setattr(trie, "CHUNK", 16)
    rows = [(c, t, "u", f"turn {t}") for c in (20, 21, 22, 23, 45) for t in range(100)]
    rows += [(47, None, None, None), (48, 0, "u", "a"), (48, 0, "u", "a"), (None, 1, "u", "lost"), (49, 5, "long", "w " * 5000)]
    rows += [(c, 0, "u", "same") for c in range(100, 400)]
    assert found(spark, rows, heavy=3) == plain(rows)
    assert found(spark, rows) == plain(rows)


def test_turnless_conversations_end_at_the_root(spark):
    turnless = next(c for c in range(1, 200) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    assert found(spark, [(turnless, 0, "u", "gone")]) == plain([(turnless, 0, "u", "gone")])
    assert found(spark, [(turnless, 0, "u", "gone")])[0][5] == 1


def test_empty_table_and_clashing_names(spark):
    assert found(spark, []) == []
    rows = [(c, t, "u", f"{t}") for c in (20, 21, 40) for t in range(5)]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], SCHEMA + ", d int, k1 int").select("k1", "text", "d", "role", "turn", "conv_id")
    assert sorted((tuple(r) for r in trie.prefix_trie(df).collect()), key=str) == plain(rows)


def test_level_order_and_rollups():
    draw = random.Random(4)
    n = 300
    parent = np.array([draw.choice([-1, *range(i)][-8:]) for i in range(n)])
    level = np.ones(n, np.int64)
    for i in range(n):
        level[i] = 1 if parent[i] < 0 else level[parent[i]] + 1
    order, bits = trie.louds(parent, level, np.arange(n))
    assert bits.sum() == n and len(bits) == 2 * n + 1
    place = np.empty(n + 1, np.int64)
    place[order], place[n] = np.arange(1, n + 1), 0
    assert (trie.parents(bits) == place[parent[order]]).all()
    own = np.ones((n + 1, 1), np.int64)
    ordered = level[order]
    levels = np.concatenate([[0], np.searchsorted(ordered, np.arange(1, ordered.max() + 2)) + 1])
    total = trie.rolled_up(bits, levels, own)
    below = [1] * n
    for i in range(n - 1, -1, -1):
        if parent[i] >= 0:
            below[parent[i]] += below[i]
    assert total[1:, 0].tolist() == [below[i] for i in order] and total[0, 0] == n + 1
