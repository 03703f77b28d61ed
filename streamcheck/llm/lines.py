"""Removal of repeated runs of lines: a suffix array over line ids by distributed prefix doubling.

The corpus is a sequence of line ids, cut at document ends.

1. *Doubling.*  Round k ranks the suffixes that still share their first 2**k lines with another
   by (rank, rank of the suffix 2**k lines on), until none shares more: then ranks give the suffix
   array.  Suffixes whose first line is unique are not in it.  Only distinct (rank, next rank)
   pairs are sorted: they are range-partitioned, and prefix sums over the partitions (one number
   each) give global ranks.
2. *Common prefixes.*  The longest common prefix with the suffix before it in the array shrinks by
   one from line to line of a document while that suffix moves on with it, so only where it jumps
   is it found anew, from the ranks of all rounds: the largest equal one tells 2**k equal lines.
3. *Intervals.*  A suffix lies in the nested intervals of the array that share 1, 2, ... lines; its
   maximal repeated run is as long as the deepest interval that holds an earlier place.  A pass
   over each range partition with a stack finds it among the partition's places; what the partitions
   before and after have is one short staircase for each (the least place by lines shared with the
   partition's edge, at most as many steps as the longest repeated run has lines).  These are passed
   on from range to range by a task that holds one of them at a time, and meet the few places that
   have no smaller one in their range; the driver sees none.

A run of at least ``least_bytes`` bytes is a copy of an earlier one, and its lines go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamcheck.llm.shared import Scratch

#: A repeated run of fewer bytes, line feeds not counted, stays: blank lines, brackets, short answers.
LEAST_BYTES = 32
WHOLE = 1 << 60
#: A task of the interval pass holds its range: this many suffixes on the average, or fewer.
RANGE_ROWS = 4_000_000


def line_table(docs: DataFrame) -> DataFrame:
    """docs: (id, fp, text).  (id, fp, pos, n, h1, h2): a row per line; null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                lines = [t.as_py().encode("utf-8", "surrogatepass").split(b"\n") for t in part.column(2)]
                n = np.array([len(x) for x in lines], dtype=np.int64)
                row = pa.array(np.repeat(np.arange(len(n)), n))
                ids = np.frombuffer(b"".join([hashlib.blake2b(x, digest_size=16).digest() for own in lines for x in own]), np.int64).reshape(-1, 2)
                pos = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_pydict({"id": part.column(0).take(row), "fp": part.column(1).take(row), "pos": pa.array(pos), "n": pa.array(np.repeat(n, n)), "h1": pa.array(ids[:, 0].copy()), "h2": pa.array(ids[:, 1].copy())})

    return docs.where("id is not null and text is not null").select("id", "fp", "text").mapInArrow(run, "id bigint, fp bigint, pos bigint, n bigint, h1 bigint, h2 bigint")


PLACE = ["id", "fp", "pos"]


def group_ranks(counts: DataFrame, keys: list[str], scratch: Scratch, name: str) -> tuple[DataFrame, int]:
    """((keys, c, before): ``before`` is the sum of ``c`` over smaller keys of the same first key; the number of keys whose suffixes go on).

    Where there is one key, or a pair of hashes, all are one group.
    """
    whole = keys == ["h1", "h2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, group, so_far = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            c, r = batch.column(len(keys)).to_numpy(), np.zeros(batch.num_rows, np.int64) if whole else batch.column(0).to_numpy()
            sums, new = np.cumsum(c), np.ones(len(c), dtype=bool)
            new[1:] = r[1:] != r[:-1]
            head = np.flatnonzero(new)
            start = (sums - c)[head]
            if r[0] == group:
                start[0] -= so_far
            before = sums - c - np.repeat(start, np.diff(np.append(head, len(c))))
            group, so_far = int(r[-1]), int(before[-1] + c[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(r), pa.array(np.full(len(c), part, dtype=np.int32))], names=[*keys, "c", "before", "g", "part"])

    ordered = counts.select(*keys, "c").repartitionByRange(*keys).sortWithinPartitions(*keys)
    local = scratch.write(ordered.mapInArrow(run, ", ".join(f"{k} bigint" for k in keys) + ", c bigint, before bigint, g bigint, part int"), name)
    goes_on = (F.col("c") > 1) & (F.lit(whole) | (F.col(keys[-1]) > 0))
    ends = local.groupBy("part").agg(F.min("g").alias("low"), F.max("g").alias("high"), F.max_by(F.col("before") + F.col("c"), F.struct("g", "before")).alias("end"), F.count_if(goes_on).alias("more"))
    held, carried, rows, more = None, 0, [], 0
    for r in sorted(ends.collect()):  # one row per partition: how much of its first group earlier ones hold
        given = carried if r.low == held else 0
        rows.append((r.part, r.low, given))
        held, carried, more = r.high, r.end + (given if r.low == r.high else 0), more + r.more
    table = pa.table({k: pa.array([x[i] for x in rows], t) for i, (k, t) in enumerate((("part", pa.int32()), ("low", pa.int64()), ("given", pa.int64())))})
    joined = local.join(F.broadcast(local.sparkSession.createDataFrame(table)), "part")
    return joined.select(*keys, "c", (F.col("before") + F.when(F.col("g") == F.col("low"), F.col("given")).otherwise(0)).alias("before")), more


def look_ahead(suffixes: DataFrame, step: int) -> DataFrame:
    """Adds to (id, fp, pos, n, ranks, live) the rank ``r`` and, for live rows, ``r2``: the rank of the suffix ``step`` lines on.

    After a document's end comes rank 0; a suffix of a unique line is one of its own, below all others.
    """
    ahead = Window.partitionBy("id", "fp").orderBy("pos").rangeBetween(step, step)
    alone = -1 - F.shiftrightunsigned(F.xxhash64("id", "fp", F.col("pos") + step), 1)
    r2 = F.when(F.col("pos") + step >= F.col("n"), F.lit(0)).otherwise(F.coalesce(F.first(F.element_at("ranks", -1)).over(ahead), alone))
    return suffixes.withColumns({"r": F.element_at("ranks", -1), "r2": F.when(F.col("live"), r2)})


def suffix_array(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, fp, pos, n, ranks) of every suffix of a shared line; ordered by the last rank, then by place, they are the suffix array.

    A round writes the ranks of distinct pairs, and all suffixes with what they ask for next; one
    equal to no other, or ended, is no longer live.  ``ranks`` has one rank for each round lived.
    """
    names, more = group_ranks(lines.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1"), ["h1", "h2"], scratch, "names")
    first = lines.join(names, ["h1", "h2"]).select(*PLACE, "n", F.array(F.col("before") + 1).alias("ranks"), F.lit(True).alias("live"))
    state = scratch.write(look_ahead(first.repartition("id", "fp").dropDuplicates(PLACE), 1), "round-0")
    level = 0
    while more:
        live = state.where("live")
        ranks, more = group_ranks(live.groupBy("r", "r2").agg(F.count("*").alias("c")), ["r", "r2"], scratch, f"pairs-{level}")
        moved = live.join(ranks, ["r", "r2"]).select(*PLACE, "n", F.concat("ranks", F.array(F.col("r") + F.col("before"))).alias("ranks"), ((F.col("c") > 1) & (F.col("r2") > 0)).alias("live"))
        suffixes = moved.unionByName(state.where("not live").select(*moved.columns))
        state = scratch.write(look_ahead(suffixes, 2 << level), f"round-{level + 1}")
        scratch.drop(f"round-{level}", f"pairs-{level}")
        level += 1
    return state.select(*PLACE, "n", "ranks")


def with_suffix_before(suffixes: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, at, id, fp, pos, n, r0, q_id, q_fp, q_pos, q_r0): places in the array's order (part, at), each with the place before it."""
    order = ["r", *PLACE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, last = TaskContext.get().partitionId(), 0, [None] * 4
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            held = {k: batch.column(i) for i, k in enumerate([*PLACE, "n", "r0"])}
            before = {f"q_{k}": pa.concat_arrays([pa.array([x], pa.int64()), held[k].slice(0, n - 1)]) for k, x in zip([*PLACE, "r0"], last, strict=True)}
            last = [held[k][n - 1].as_py() for k in [*PLACE, "r0"]]
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(n, part)), "at": pa.array(np.arange(at, at + n))} | held | before)
            at += n

    ordered = suffixes.select(*PLACE, "n", F.col("ranks")[0].alias("r0"), F.element_at("ranks", -1).alias("r")).repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["part", "at", *PLACE, "n", "r0", *(f"q_{k}" for k in [*PLACE, "r0"])]
    table = scratch.write(ordered.select(*PLACE, "n", "r0").mapInArrow(run, ", ".join(f"{k} bigint" for k in names)), "order")
    ends = sorted(table.groupBy("part").agg(F.max_by(F.struct(*PLACE, "r0"), "at").alias("e")).collect())  # one row per partition
    edges = pa.table({"part": pa.array([b.part for b in ends[1:]], pa.int64())} | {f"e_{k}": pa.array([a.e[k] for a in ends[:-1]], pa.int64()) for k in [*PLACE, "r0"]})
    joined = table.join(F.broadcast(table.sparkSession.createDataFrame(edges)), "part", "left")
    return joined.withColumns({f"q_{k}": F.when(F.col("at") == 0, F.col(f"e_{k}")).otherwise(F.col(f"q_{k}")) for k in [*PLACE, "r0"]}).select(*names)


def common_prefixes(suffixes: DataFrame, scratch: Scratch) -> DataFrame:
    """(part, at, id, fp, pos, lcp): lines that each suffix shares with the one before it in the array."""
    down = Window.partitionBy("id", "fp").orderBy("pos")

    def was(name: str, less: int = 0):
        return F.lag(name).over(down) == F.col(name) - less

    follows = was("pos", 1) & was("q_id") & was("q_fp") & was("q_pos", 1) & (F.lag("r0").over(down) == F.lag("q_r0").over(down))
    chained = scratch.write(with_suffix_before(suffixes, scratch).withColumn("jump", ~F.coalesce(follows, F.lit(False))), "chained")
    active = chained.where("jump and r0 = q_r0").select(*PLACE, "n", "q_id", "q_fp", "q_pos", F.lit(0).cast("bigint").alias("m"))
    mine = suffixes.select(F.col("id").alias("a_id"), F.col("fp").alias("a_fp"), F.col("pos").alias("a_pos"), F.col("ranks").alias("a"))
    other = suffixes.select(F.col("id").alias("b_id"), F.col("fp").alias("b_fp"), F.col("pos").alias("b_pos"), F.col("ranks").alias("b"))
    found, rounds = [], 0
    while True:
        here = active.join(mine, (F.col("id") == F.col("a_id")) & (F.col("fp") == F.col("a_fp")) & (F.col("pos") + F.col("m") == F.col("a_pos")), "left")
        here = here.join(other, (F.col("q_id") == F.col("b_id")) & (F.col("q_fp") == F.col("b_fp")) & (F.col("q_pos") + F.col("m") == F.col("b_pos")), "left")
        k = F.expr("array_max(filter(sequence(0, least(size(a), size(b)) - 1), k -> a[k] = b[k]))")
        here = here.withColumn("k", F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), k))
        more = F.when(F.col("k").isNotNull(), F.least(F.expr("shiftleft(1L, k)"), F.col("n") - F.col("pos") - F.col("m"))).otherwise(0)
        step = here.select(*PLACE, "n", "q_id", "q_fp", "q_pos", (F.col("m") + more).alias("m"), F.col("k").isNotNull().alias("goes"))
        step = scratch.write(step.withColumn("goes", F.col("goes") & (F.col("pos") + F.col("m") < F.col("n"))), f"prefix-{rounds}")
        found.append(step.where("not goes").select(*PLACE, "m"))
        active, rounds = step.where("goes").drop("goes"), rounds + 1
        if active.isEmpty():
            break
    jumps = found[0]
    for f in found[1:]:
        jumps = jumps.unionByName(f)
    known = chained.join(jumps, PLACE, "left").withColumn("m", F.when(F.col("jump"), F.coalesce("m", F.lit(0))))
    start = F.last(F.when(F.col("jump"), F.struct("m", F.col("pos").alias("s"))), ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, 0))
    return known.withColumn("start", start).select("part", "at", *PLACE, F.greatest(F.lit(0), F.col("start.m") - (F.col("pos") - F.col("start.s"))).alias("lcp"))


def before_and_after(x: list[int], lcp: list[int]) -> tuple[list[int], list[int], list[int], list[tuple[int, int]], list[tuple[int, int]]]:
    """Of a range of the array, with places as numbers ``x`` and ``lcp`` with the suffix before each:

    (most lines shared with a smaller place of the range; least lcp since the range's start where none is
    smaller on that side, else -1; the same to its end; and the staircases (lines, index) at its end
    and at its start).
    """
    n = len(x)
    best, left, right = [0] * n, [-1] * n, [-1] * n
    stack: list[tuple[int, int]] = []
    for i in range(n):
        c = lcp[i]
        while stack and x[stack[-1][0]] > x[i]:
            c = min(c, stack.pop()[1])
        if stack:
            best[i] = c
        else:
            left[i] = c
        stack.append((i, c))
    at_end = stairs(stack, WHOLE)
    stack = []
    for i in range(n - 1, -1, -1):
        c = lcp[i + 1] if i + 1 < n else WHOLE
        while stack and x[stack[-1][0]] > x[i]:
            c = min(c, stack.pop()[1])
        if stack:
            best[i] = max(best[i], c)
        else:
            right[i] = c
        stack.append((i, c))
    return best, left, right, at_end, stairs(stack, lcp[0] if n else WHOLE)


def stairs(stack: list[tuple[int, int]], shared: int) -> list[tuple[int, int]]:
    """(lines, index) from the top of a stack of rising places down: for each number of lines the least place."""
    out: list[tuple[int, int]] = []
    for i, c in reversed(stack):
        if not shared:
            break
        if out and out[-1][0] == shared:
            out.pop()
        out.append((shared, i))
        shared = min(shared, c)
    return out


Stairs = list[tuple[int, tuple[int, int, int]]]
STAIRS = "part bigint, lines array<bigint>, id array<bigint>, fp array<bigint>, pos array<bigint>"


def lower(old: Stairs, most: int, new: Stairs) -> Stairs:
    """The staircase of ``new`` and, beyond it, of ``old`` through ``most`` shared lines: fewer lines, smaller places."""
    out: Stairs = []
    for lines, place in sorted([*new, *((min(lines, most), p) for lines, p in old)], key=lambda s: (-s[0], s[1])):
        if lines and (not out or place < out[-1][1]):
            out.append((lines, place))
    return out


def reach(steps: Stairs, place: tuple[int, int, int]) -> int:
    """The most lines shared with a place before ``place``."""
    lo, hi = 0, len(steps)  # places fall along the steps: the first that is smaller
    while lo < hi:
        middle = (lo + hi) // 2
        if steps[middle][1] < place:
            hi = middle
        else:
            lo = middle + 1
    return steps[lo][0] if lo < len(steps) else 0


def passed_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, staircase that comes to it): staircases go from range to range, one is held at a time.

    Rows come range by range in the order of passing, each range's least lcp (kind 3) before its own steps.
    """
    held: Stairs = []
    now, least, own = None, 0, []

    def told(part: int) -> dict:
        return {"part": part, "lines": [n for n, _ in held]} | {k: [p[i] for _, p in held] for i, k in enumerate(PLACE)}

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["part"] != now:
                held = lower(held, least, own)
                now, own = r["part"], []
                out.append(told(now))
            if r["kind"] == 3:
                least = r["lines"]
            else:
                own.append((r["lines"], (r["id"], r["fp"], r["pos"])))
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("part", pa.int64()), *((k, pa.list_(pa.int64())) for k in ["lines", *PLACE])]))


def meet(rows: pa.Table, behind: pa.Table, ahead: pa.Table) -> pa.Table:
    """The rows of a range that no smaller place of it precedes on some side, with what the staircases from both sides tell."""
    steps = []
    for found in (behind, ahead):
        kept = found.to_pylist()
        steps.append([(n, p) for r in kept for n, p in zip(r["lines"], zip(r["id"], r["fp"], r["pos"], strict=True), strict=True)])
    places = zip(*(rows[k].to_pylist() for k in PLACE), strict=True)
    best = [max(n, min(h, reach(steps[0], p)), min(t, reach(steps[1], p))) for p, n, h, t in zip(places, *(rows[k].to_pylist() for k in ("lines", "head", "tail")), strict=True)]
    return pa.table({k: rows[k] for k in PLACE} | {"lines": pa.array(best, pa.int64())})


def earlier_runs(prefixes: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, fp, pos, lines): the length of each suffix's longest run that also starts at an earlier place, where there is one."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, whole = TaskContext.get().partitionId(), pa.Table.from_batches([b for b in batches if b.num_rows] or [pa.RecordBatch.from_pydict({k: pa.array([], pa.int64()) for k in [*PLACE, "lcp"]})])
        n = whole.num_rows
        if not n:
            return
        columns = [whole[k].to_numpy() for k in PLACE]
        x = np.empty(n, dtype=np.int64)
        x[np.lexsort(columns[::-1])] = np.arange(n)
        lcp = whole["lcp"].to_pylist()
        best, left, right, at_end, at_start = before_and_after(x.tolist(), lcp)
        steps = [(kind, lines, i) for kind, found in ((1, at_end), (2, at_start)) for lines, i in found]
        kinds = [0] * n + [k for k, _, _ in steps] + [3]
        rows = np.array([*range(n), *(i for _, _, i in steps), 0])
        best += [lines for _, lines, _ in steps] + [min(lcp)]
        extra = [-1] * (len(kinds) - n)
        yield pa.RecordBatch.from_pydict({k: pa.array(c[rows]) for k, c in zip(PLACE, columns, strict=True)} | {"part": pa.array(np.full(len(kinds), part)), "kind": pa.array(kinds, pa.int64()), "lines": pa.array(best, pa.int64()), "head": pa.array(left + extra, pa.int64()), "tail": pa.array(right + extra, pa.int64())})

    names = [*PLACE, "part", "kind", "lines", "head", "tail"]
    ranges = -(-prefixes.count() // RANGE_ROWS)  # read from footers
    dealt = prefixes.repartitionByRange(ranges, "part", "at") if ranges > int(prefixes.sparkSession.conf.get("spark.sql.shuffle.partitions")) else prefixes.repartitionByRange("part", "at")
    ordered = dealt.sortWithinPartitions("part", "at").select(*PLACE, "lcp")
    found = scratch.write(ordered.mapInArrow(local, ", ".join(f"{k} bigint" for k in names)), "runs-local")
    known, opened = F.greatest("head", "tail") <= 0, found.where("kind = 0 and greatest(head, tail) > 0")

    def staircases(kind: int, *order: Column) -> DataFrame:
        edges = found.where(F.col("kind").isin(kind, 3)).select("part", "kind", "lines", *PLACE)
        return edges.repartition(1).sortWithinPartitions(*order, F.desc("kind")).mapInArrow(passed_on, STAIRS)

    behind = scratch.write(staircases(1, F.asc("part")), "stairs-behind")
    ahead = scratch.write(staircases(2, F.desc("part")), "stairs-ahead")
    both = behind.withColumn("side", F.lit(0)).unionByName(ahead.withColumn("side", F.lit(1)))

    def joined(rows: pa.Table, stairs: pa.Table) -> pa.Table:
        side = stairs["side"].to_numpy()
        return meet(rows, stairs.filter(pa.array(side == 0)), stairs.filter(pa.array(side == 1)))

    told = opened.groupBy("part").cogroup(both.groupBy("part")).applyInArrow(joined, "id bigint, fp bigint, pos bigint, lines bigint")
    return found.where((F.col("kind") == 0) & known).select(*PLACE, "lines").unionByName(told).where("lines > 0")


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_bytes: int = LEAST_BYTES, keep_text: bool = False) -> DataFrame:
    """Delete each line of a run of lines, of ``least_bytes`` bytes or more, that also starts at an earlier place.

    Runs are as long as they repeat, from one line on; places are ordered by (id, line); lines are what
    line feeds separate, unchanged, and blank ones go with their run.  Bytes are those of the
    lines in UTF-8.  Returns one row per input row: ``id_col`` (an integer), ``n_lines``, ``n_removed``,
    ``kept_sha256`` of the kept lines joined by line feeds; with ``keep_text`` also ``kept_text``.
    Null text has no lines; empty text has one.  A row without an id is left whole and counts for
    nothing elsewhere; rows that repeat id and text are one document; of rows with one id and
    other texts the order is that of a hash.
    """
    scratch = Scratch(docs.sparkSession, "lines")
    rows = docs.select(F.col(id_col).alias("key"), F.col(id_col).cast("bigint").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("fp"), F.col(text_col).alias("text"))
    lines = scratch.write(line_table(rows), "lines")
    suffixes = suffix_array(lines, scratch)
    scratch.drop("lines", "names")
    prefixes = scratch.write(common_prefixes(suffixes, scratch), "prefixes")
    runs = earlier_runs(prefixes, scratch)
    runs = scratch.write(runs.groupBy("id", "fp").agg(F.collect_list(F.struct("pos", "lines")).alias("runs")), "runs")
    scratch.drop("order", "chained", "prefixes", "runs-local", "stairs-behind", "stairs-ahead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, found in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
                own = text.as_py().encode("utf-8", "surrogatepass").split(b"\n") if text.is_valid else []
                size, edge = np.cumsum([0, *map(len, own)]), np.zeros(len(own) + 1, dtype=np.int64)
                for r in found or ():
                    if size[r["pos"] + r["lines"]] - size[r["pos"]] >= least_bytes:
                        edge[r["pos"]] += 1
                        edge[r["pos"] + r["lines"]] -= 1
                gone = np.cumsum(edge[:-1]) > 0
                kept = b"\n".join([x for x, g in zip(own, gone.tolist(), strict=True) if not g])
                out.append((len(own), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "surrogatepass") if keep_text else None))
            n, gone, sha, kept = zip(*out, strict=True) if out else ([],) * 4
            columns = {id_col: batch.column(0), "n_lines": pa.array(n, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | ({"kept_text": pa.array(kept, pa.string())} if keep_text else {}))

    joined = rows.join(runs, ["id", "fp"], "left").select("key", "text", "runs")
    kind = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"{id_col} {kind}, n_lines bigint, n_removed bigint, kept_sha256 string" + (", kept_text string" if keep_text else ""))
