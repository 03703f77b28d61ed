"""Prefix trie of conversations: shared beginnings, what they save, and where conversations end.

Conversations become rows of one turn each; a prefix is known by its depth and a 128-bit key, the
exclusive or of a digest of (place, role, text) for each of its turns, so it needs no walk from the
first turn.  Nodes are the distinct prefixes, with their members counted by one aggregation.

Rollups go over succinct tries.  A node of more than ``heavy`` members is an upper one; the others
hang below them in prefix shards, of which a task takes many at a time: numpy builds a level-order
trie of each block of shards (LOUDS: for every node a 1 for each child and then a 0), labels and
values as arrays in the same order, and adds values from the last level to the first.  The upper
levels, of which there are at most depth x conversations / heavy nodes, are such a trie of their own,
into which the shards' sums go.  Below the first node that one conversation has for itself its nodes are
a chain, and no trie has to hold them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamcheck.llm.shared import Scratch

SHARED = 20  #: conversations c - c % 20 give their first turns to those that follow them
HEAVY = 20_000
BLOCK = 1 << 17
CHUNK = 1024
NODE = ("d", "k1", "k2")
NO_ENDS = hashlib.sha256(b"").hexdigest()


def louds(parent: np.ndarray, level: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, bits) of a forest under one root of its own, which is node 0 of the level order and not in the arrays.

    ``parent`` holds places in the arrays, -1 for the forest's roots; ``level`` is 1 for those.  ``order`` has the
    nodes by level, within it by their parents' places and their labels; ``bits`` has a 1 for each child of
    each node, the forest's root first, and a 0 after them.
    """
    n = len(parent)
    by_level = np.argsort(level, kind="stable")
    cuts = np.searchsorted(level[by_level], np.arange(1, int(level.max()) + 2)) if n else np.zeros(1, np.int64)
    place = np.zeros(n + 1, np.int64)  # the last for parent -1: node 0
    order, at = np.empty(n, np.int64), 0
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        nodes = by_level[a:b]
        nodes = nodes[np.lexsort((label[nodes], place[parent[nodes]]))]
        order[at : at + len(nodes)] = nodes
        place[nodes] = at + 1 + np.arange(len(nodes))
        at += len(nodes)
    degree = np.bincount(place[parent[order]], minlength=n + 1)
    bits = np.ones(2 * n + 1, bool)
    bits[np.cumsum(degree + 1) - 1] = False
    return order, bits


def parents(bits: np.ndarray) -> np.ndarray:
    """The parent of each node but the first: as many nodes have ended as there are zeros before the node's own 1."""
    ones = np.flatnonzero(bits)
    return ones - np.arange(len(ones))


def rolled_up(bits: np.ndarray, levels: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Sums over subtrees: ``own`` has a row for each node in level order, ``levels`` where each level begins, the root's first."""
    total, up = own.copy(), parents(bits)
    for a, b in zip(levels[-2:0:-1], levels[:1:-1], strict=True):
        np.add.at(total, up[a - 1 : b - 1], total[a:b])
    return total


FIELDS = "d bigint, k1 bigint, k2 bigint, p1 bigint, p2 bigint, conv_id bigint, n_convs bigint, n_ends bigint, end_one bigint, parent_conv_id bigint, n_children bigint, n_leaves bigint, saved bigint, top boolean"


def trie_block(rows: pa.Table) -> pa.RecordBatch:
    """One block of nodes: their parents' conversation, children, leaves and savings.

    ``more_children``, ``more_leaves`` and ``more_saved`` are what hangs below a node outside the block.
    Nodes whose parent is not in the block are ``top``.
    """
    c = {name: rows[name].to_numpy() for name in rows.column_names if name != "end_one"}
    n = rows.num_rows
    keys = np.ascontiguousarray(np.stack([np.concatenate([c["d"], c["d"] - 1]), np.concatenate([c["k1"], c["p1"]]), np.concatenate([c["k2"], c["p2"]])], axis=1)).view(np.dtype((np.void, 24))).ravel()
    _, known = np.unique(keys, return_inverse=True)
    at = np.full(int(known.max()) + 1, -1, np.int64)
    at[known[:n]] = np.arange(n)
    parent = at[known[n:]]
    level = np.ones(n, np.int64)
    by_depth = np.argsort(c["d"], kind="stable")
    depths, cuts = np.unique(c["d"][by_depth], return_index=True)
    for a, b in zip(cuts, [*cuts[1:], n], strict=True):
        nodes = by_depth[a:b]
        level[nodes] = np.where(parent[nodes] < 0, 1, level[parent[nodes]] + 1)
    order, bits = louds(parent, level, c["conv_id"])
    up = parents(bits)
    children = np.bincount(up, minlength=n + 1)[1:] + c["more_children"][order]
    own = np.zeros((n + 1, 2), np.int64)
    own[1:, 0] = c["more_leaves"][order] + ((children == 0) | ((c["n_convs"][order] == 1) & (c["more_leaves"][order] == 0)))
    own[1:, 1] = c["more_saved"][order] + (c["n_convs"][order] - 1) * c["words"][order]
    ordered = level[order]
    levels = np.concatenate([[0], np.searchsorted(ordered, np.arange(1, int(ordered.max()) + 2)) + 1])
    total = rolled_up(bits, levels, own)[1:]
    convs = np.concatenate([[0], c["conv_id"][order]])
    told = rows.select(["d", "k1", "k2", "p1", "p2", "conv_id", "n_convs", "n_ends", "end_one"]).take(pa.array(order)).combine_chunks()
    return pa.RecordBatch.from_pydict({name: told[name].combine_chunks() for name in told.column_names} | {
        "parent_conv_id": pa.array(convs[up], mask=up == 0),
        "n_children": pa.array(children.astype(np.int64)), "n_leaves": pa.array(total[:, 0]), "saved": pa.array(total[:, 1]), "top": pa.array(up == 0),
    })


def shard_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries of whole shards, at least ``BLOCK`` nodes at a time: rows come sorted by shard (r1, r2)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        r1, r2 = batch.column("r1").to_numpy(), batch.column("r2").to_numpy()
        if size >= BLOCK:
            last = held[-1].slice(held[-1].num_rows - 1)
            other = np.flatnonzero((r1 != last.column("r1")[0].as_py()) | (r2 != last.column("r2")[0].as_py()))
            if len(other):
                cut = int(other[0])
                yield trie_block(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held, size, batch = [], 0, batch.slice(cut)
        held.append(batch)
        size += batch.num_rows
    if held:
        yield trie_block(pa.Table.from_batches(held))


def hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ends: rows (d, k1, k2, chunk, ids) come sorted, and a hash goes on from row to row."""
    now, state, out = None, None, []
    for batch in batches:
        for d, k1, k2, ids in zip(*(batch.column(x).to_pylist() for x in (*NODE, "ids")), strict=True):
            if (d, k1, k2) == now:
                state.update(b",")
            else:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (d, k1, k2), hashlib.sha256()
            state.update(ids.encode())
        if len(out) > 10_000:
            yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "sha"), x, strict=True)) for x in out])
            out = []
    if now is not None:
        out.append((*now, state.hexdigest()))
        yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "sha"), x, strict=True)) for x in out])


def ordered_turns(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, at, l1, l2, words): turns with their place among all, in order of conversation, turn (null first), role and text.

    Rows are dealt by ranges and numbered within them, so a conversation of very many turns is spread.
    """
    spark = conversations.sparkSession
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("c"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("c is not null")
    order = (F.col("c"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"))
    sha = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    words = F.size(F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), 1)).cast("bigint")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("c", sha.alias("sha"), words.alias("words"), F.monotonically_increasing_id().alias("id"))
    part = F.shiftright("id", 33)

    def digits(start: int) -> Column:
        return F.conv(F.substr("sha", F.lit(start), F.lit(15)), 16, 10).cast("bigint")

    dealt = scratch.write(dealt.select("c", digits(1).alias("l1"), digits(16).alias("l2"), "words", "id"), "turns")
    sizes = sorted((p, n) for p, n in dealt.groupBy(part.alias("p")).agg(F.count("*")).collect())  # a row for each range
    starts = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    offsets = spark.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts, strict=False)], "p bigint, start bigint")
    return dealt.join(F.broadcast(offsets), F.col("p") == part).select("c", "l1", "l2", "words", (F.col("start") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).alias("at"))


def rebuilt(turns: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) after each takes the first h turns of c - c % 20 in place of its own, h = crc32(c) % 4.

    Conversations have (c, total); turns (c, d, l1, l2, words, total) with d from 1.
    """
    h = (F.crc32(F.col("c").cast("string").cast("binary")) % 4).cast("bigint")
    convs = scratch.write(turns.groupBy("c").agg(F.min("at").alias("first"), F.count("*").alias("n")), "first")
    base = convs.where(F.col("c") % SHARED == 0).select(F.col("c").alias("r"), F.col("n").alias("n_base"))
    r = F.col("c") - F.col("c") % SHARED
    taken = F.least(h, F.coalesce("n_base", F.lit(0)))
    known = convs.withColumn("r", r).join(base, "r", "left").select("c", "r", "first", h.alias("h"), taken.alias("taken"), (taken + F.greatest(F.col("n") - h, F.lit(0))).alias("total"))
    known = scratch.write(known, "known")
    placed = turns.join(known.select("c", "first", "h", "taken", "total"), "c").withColumn("place", F.col("at") - F.col("first") + 1)
    own = placed.where("place > h").select("c", (F.col("taken") + F.col("place") - F.col("h")).alias("d"), "l1", "l2", "words", "total")
    heads = placed.where((F.col("c") % SHARED == 0) & (F.col("place") <= 3)).select(F.col("c").alias("r"), F.col("place").alias("d"), "l1", "l2", "words")
    given = known.select("c", "r", "taken", "total").join(heads, "r").where("d <= taken").select("c", "d", "l1", "l2", "words", "total")
    return known.select("c", "total"), scratch.write(own.unionByName(given), "rebuilt")


def prefix_keys(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """(c, d, k1, k2, p1, p2, words, ends): the key of each prefix and of the one before it.

    Running exclusive ors go over chunks of a conversation; those of the chunks before are joined to long ones.
    """
    rows = turns.withColumns({"x1": F.xxhash64("d", "l1", "l2"), "x2": F.xxhash64("l2", "d", "l1"), "chunk": F.floor((F.col("d") - 1) / CHUNK)})
    so_far = Window.partitionBy("c", "chunk").orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy("c").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = rows.where(F.col("total") > CHUNK).groupBy("c", "chunk").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    carried = chunks.select("c", "chunk", F.bit_xor("x1").over(before).alias("c1"), F.bit_xor("x2").over(before).alias("c2"))
    local = rows.withColumns({"s1": F.bit_xor("x1").over(so_far), "s2": F.bit_xor("x2").over(so_far)}).join(carried, ["c", "chunk"], "left")
    k1, k2 = F.col("s1").bitwiseXOR(F.coalesce("c1", F.lit(0))), F.col("s2").bitwiseXOR(F.coalesce("c2", F.lit(0)))
    keyed = local.select("c", "d", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("x1")).alias("p1"), k2.bitwiseXOR(F.col("x2")).alias("p2"), "words", (F.col("d") == F.col("total")).alias("ends"))
    return scratch.write(keyed, "keys")


def prefix_trie(conversations: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations, the root of depth 0 included.

    Returns conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs (members),
    n_children, n_leaves (childless nodes of the subtree), saved_tokens (over the subtree, words of a
    node's last text for each member but one) and ends_sha256 (of the ids of members that end there).

    Rows without conv_id are left out.  Null roles and texts are empty; equal turns are ordered by role and
    text, null turns first; repeated rows are turns of their own.  Other columns are not read.  An
    empty table has no member, and gives no row.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark, "trie")
    convs, turns = rebuilt(ordered_turns(conversations, scratch), scratch)
    keys = prefix_keys(turns, scratch)
    root = convs.agg(F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), F.count_if(F.col("total") == 0).alias("n_ends"), F.min(F.when(F.col("total") == 0, F.col("c"))).alias("end_one")).where("n_convs > 0")
    nothing = F.lit(0).cast("bigint")
    root = root.select(*(nothing.alias(x) for x in ("d", "k1", "k2", "p1", "p2")), "n_convs", "conv_id", nothing.alias("words"), "n_ends", "end_one")
    ends = F.col("ends")
    nodes = keys.groupBy(*NODE).agg(F.first("p1").alias("p1"), F.first("p2").alias("p2"), F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), F.first("words").alias("words"), F.count_if(ends).alias("n_ends"), F.min(F.when(ends, F.col("c"))).alias("end_one"))
    nodes = scratch.write(nodes.unionByName(root), "nodes")

    # Of the nodes that one conversation has for itself only the first goes into a trie.
    alone = nodes.where("n_convs = 1 and d > 0")
    chain = alone.groupBy("conv_id").agg(F.min("d").alias("from"))
    alone = alone.join(chain, "conv_id")
    none = F.lit(None).cast("bigint")
    tails = alone.where("d > from").select(*NODE, "p1", "p2", "conv_id", "n_convs", "n_ends", "end_one", F.col("conv_id").alias("parent_conv_id"), (1 - F.col("n_ends")).alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), nothing.alias("saved"), F.lit(False).alias("top"))

    upper = nodes.where((F.col("n_convs") > heavy) | (F.col("d") == 0))
    below = nodes.where((F.col("n_convs") <= heavy) & (F.col("n_convs") > 1) & (F.col("d") > 0)).unionByName(alone.where("d = from").drop("from"))
    # Upper nodes are the first on every conversation's way; the one after them is its shard.
    deep = keys.join(upper.where("d > 0").select(*NODE), list(NODE)).groupBy("c").agg(F.max("d").alias("upper"))
    shards = keys.join(deep, "c", "left").where(F.col("d") == F.coalesce("upper", F.lit(0)) + 1).select(F.col("c").alias("conv_id"), F.col("k1").alias("r1"), F.col("k2").alias("r2"))
    more = {f"more_{x}": nothing for x in ("leaves", "saved")} | {"more_children": F.when((F.col("n_convs") == 1) & (F.col("n_ends") == 0), F.lit(1)).otherwise(0).cast("bigint")}
    dealt = below.join(shards, "conv_id").withColumns(more).repartition("r1", "r2").sortWithinPartitions("r1", "r2")
    light = scratch.write(dealt.mapInArrow(shard_tries, FIELDS), "light")

    hung = light.where("top").groupBy((F.col("d") - 1).alias("d"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("more_children"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    topped = upper.join(hung, list(NODE), "left").withColumns({x: F.coalesce(x, nothing) for x in ("more_children", "more_leaves", "more_saved")} | {"r1": nothing, "r2": nothing})
    above = scratch.write(topped.repartition(1).mapInArrow(shard_tries, FIELDS), "upper")
    owners = above.select((F.col("d") + 1).alias("d"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("owner"))
    joined = light.join(owners, ["d", "p1", "p2"], "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "owner")).drop("owner")
    # Upper nodes but the root have their parents among themselves.
    every = above.unionByName(joined).unionByName(tails)

    several = nodes.where("n_ends > 1").select(*NODE)
    last = keys.where("ends").select(*NODE, "c").unionByName(convs.where("total = 0").select(*(nothing.alias(x) for x in NODE), "c")).join(several, list(NODE))
    lists = last.groupBy(*NODE, F.floor(F.col("c") / 65536).alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("ids"))
    shas = lists.repartition(*NODE).sortWithinPartitions(*NODE, "chunk").mapInArrow(hashed_ends, "d bigint, k1 bigint, k2 bigint, sha string")
    told = every.join(shas, list(NODE), "left")
    sha = F.when(F.col("n_ends") == 0, F.lit(NO_ENDS)).when(F.col("n_ends") == 1, F.sha2(F.col("end_one").cast("string"), 256)).otherwise(F.col("sha"))
    return told.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), sha.alias("ends_sha256"))
