"""Giant streams in time chunks: each chunk is judged in a task of its own, with what it needs from before it.

A stream of more than ``chunk_rows`` readings is numbered in order of time by a range shuffle and cut
every ``chunk_rows`` readings.  Rules over counts of readings need the last few before a chunk: these
go along as its halo.  The anchor of an unchanged run may be as old as the stream, so it is carried
otherwise: whatever the anchor at a chunk's beginning is, the chunk makes one at its end of it, and
this map is worked out for all chunks at once (``ChunkMap``).  Going through the small maps in order
then tells the anchor at the beginning of each chunk, and rows are judged within it.

The map of a chunk: a reading leaves anchors outside of an interval around it, so an entry anchor is
left by the first reading whose interval lacks it.  The running intersection of intervals shrinks;
the entries that each step cuts off, at its low or high side, begin a run at that reading, and from
there all goes as within the chunk.  Entries in the last intersection are the anchor still.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamcheck.operators.anchor import STREAM
from streamcheck.storage import Scratch

CHUNK_ROWS = 4_000_000
#: Readings of a task, on the average, that sorts streams or ranges: shuffles get partitions by this, not by a setting.
TASK_ROWS = 1_500_000


@dataclass
class StreamSizes:
    """How many streams and readings there are, how many readings in giant streams, and (source, metric) of those, None where there is none.

    ``keys`` are the parts of a stream's name that differ between streams: a part with one value may be
    a literal, which the optimizer takes out of windows but not out of a shuffle that is to serve them.
    """

    streams: int
    rows: int
    in_giants: int
    giants: DataFrame | None
    keys: list[str]


def stream_sizes(df: DataFrame, chunk_rows: int) -> StreamSizes:
    """One count by stream, combined before its small shuffle.  At most rows / chunk_rows streams are giants, of more than ``chunk_rows`` readings."""
    sizes = df.groupBy(*STREAM).agg(F.count("*").alias("n"))
    giant = (F.col("n") > chunk_rows) & F.col("source").isNotNull() & F.col("metric").isNotNull()
    totals = {"streams": F.count("*"), "rows": F.sum("n"), "in_giants": F.sum(F.when(giant, F.col("n"))), "giants": F.collect_list(F.when(giant, F.struct(*STREAM)))}
    differ = {k: F.min(k) < F.max(k) for k in STREAM}
    told = sizes.agg(*(c.alias(k) for k, c in (totals | differ).items())).first()
    giants = df.sparkSession.createDataFrame(told.giants, "source string, metric string") if told.giants else None
    return StreamSizes(told.streams, told.rows or 0, told.in_giants or 0, giants, [k for k in STREAM if told[k]])


def tasks(spark: SparkSession, rows: int, groups: int) -> list[int]:
    """The number of partitions for a shuffle of ``rows`` readings in ``groups`` that stay whole, as its first argument.

    Few groups get more partitions than they are, so that seldom two meet.  Empty where one task could
    hold all rows: Spark may choose.
    """
    return [max(-(-rows // TASK_ROWS), min(4 * groups, 8 * spark.sparkContext.defaultParallelism))] if rows > TASK_ROWS else []


def held_by_stream(df: DataFrame) -> int:
    """Into how many partitions by (source, metric) the rows come dealt already, as from ``store.lay_out``; 0 where they do not."""
    dealt = df._jdf.queryExecution().sparkPlan().outputPartitioning()
    return dealt.numPartitions() if re.fullmatch(r"hashpartitioning\(source#\d+, metric#\d+, \d+\)", dealt.toString()) else 0


def numbered(df: DataFrame, scratch: Scratch, parts: list[int]) -> DataFrame:
    """The rows with ``_i``, their place in their stream from 0 on, in order of ts_us and seq.

    Rows are dealt by ranges and sorted there, so a stream is spread over tasks; a row's place is that
    in its range after the rows of the ranges before it.
    """
    spark, order = df.sparkSession, (*STREAM, "ts_us", "seq")
    dealt = df.repartitionByRange(*parts, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    dealt = scratch.write(dealt, "ranges")
    part = F.shiftright("_id", 33)
    sizes = sorted((p, n) for p, n in dealt.groupBy(part.alias("p")).agg(F.count("*")).collect())  # a row for each range
    starts = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    offsets = spark.createDataFrame([(p, s) for (p, _), s in zip(sizes, starts, strict=False)], "_p bigint, _start bigint")
    at = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = dealt.join(F.broadcast(offsets), F.col("_p") == part).withColumn("_at", at)
    first = placed.groupBy(*STREAM).agg(F.min("_at").alias("_first"))
    return placed.join(first, list(STREAM)).withColumn("_i", F.col("_at") - F.col("_first")).select(*df.columns, "_i")


def interval(values: np.ndarray, tol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest anchor that each value does not leave (``abs(value - anchor) <= tol``), to the last bit."""
    with np.errstate(invalid="ignore", over="ignore"):
        none = ~np.isfinite(values) | ~(tol >= 0)
        low, high = np.where(none, np.inf, values - tol), np.where(none, -np.inf, values + tol)
        for bound, out in ((low, -np.inf), (high, np.inf)):
            sure = (np.abs(values - bound) <= tol) & ~(np.abs(values - np.nextafter(bound, out)) <= tol)
            at = np.flatnonzero(~sure & ~none & np.isfinite(tol))
            if len(at):
                bound[at] = _outermost(values[at], tol[at], out)
    return low, high


def _outermost(values: np.ndarray, tol: np.ndarray, out: float) -> np.ndarray:
    """The last number towards ``out`` that is near each value: a search by halves over the order of all numbers."""

    def order(x: np.ndarray) -> np.ndarray:
        i = x.view(np.int64)
        return np.where(i < 0, np.int64(-(2**63)) - i, i)

    def number(i: np.ndarray) -> np.ndarray:
        return np.where(i < 0, np.int64(-(2**63)) - i, i).view(np.float64)

    near, far = order(values), order(np.full(len(values), out))
    while (np.abs(far // 2 - near // 2) > 1).any():
        middle = near // 2 + far // 2 + (near % 2 + far % 2) // 2
        fits = np.abs(values - number(middle)) <= tol
        near, far = np.where(fits, middle, near), np.where(fits, far, middle)
    for _ in range(4):
        step = near + np.int64(1 if out > 0 else -1)
        near = np.where(np.abs(values - number(step)) <= tol, step, near)
    return number(near)


def next_leaving(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each row as anchor the first later row that leaves it, or the number of rows: jumps by powers of two."""
    n = len(values)
    tables = [(low, high)]
    while 2 << (len(tables) - 1) <= n:
        half = 1 << (len(tables) - 1)
        a, b = tables[-1]
        tables.append((np.maximum(a[:-half], a[half:]), np.minimum(b[:-half], b[half:])))
    at = np.arange(1, n + 1)
    for k in range(len(tables) - 1, -1, -1):
        most, least = tables[k]
        there = np.minimum(at, len(most) - 1)
        stays = (at < len(most)) & (most[there] <= values) & (least[there] >= values)
        at = np.where(stays, at + (1 << k), at)
    return at


@dataclass
class ChunkMap:
    """From the anchor before a run of rows to the one after them.

    ``low``: ascending bounds, entries under one and not under that before end with its anchor; ``high``
    likewise descending.  Entries from ``least`` to ``most`` stay.  ``start`` is the end where there was no
    anchor before, or none that a reading can be near to (NaN, infinite).
    """

    least: float = -np.inf
    most: float = np.inf
    low: np.ndarray = field(default_factory=lambda: np.zeros(0))
    high: np.ndarray = field(default_factory=lambda: np.zeros(0))
    low_end: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))  # value, and time below
    high_end: np.ndarray = field(default_factory=lambda: np.zeros((2, 0)))
    low_us: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    high_us: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    start: tuple[float, int] | None = None

    def after(self, entry: tuple[float, int] | None) -> tuple[float, int] | None:
        """The anchor after the rows."""
        if entry is None or not np.isfinite(entry[0]):
            return entry if self.start is None else self.start
        a = entry[0]
        if self.least <= a <= self.most:
            return entry
        if a < self.least:
            k = int(np.searchsorted(self.low, a, side="right"))
            return float(self.low_end[0, k]), int(self.low_us[k])
        k = int(np.searchsorted(-self.high, -a, side="right"))
        return float(self.high_end[0, k]), int(self.high_us[k])

    def extend(self, values: np.ndarray, times: np.ndarray, tol: np.ndarray) -> None:
        """Go on over further rows."""
        n = len(values)
        if not n:
            return
        low, high = interval(values, tol)
        following = next_leaving(values, low, high)
        last = np.where(following < n, np.minimum(following, n - 1), np.arange(n))
        for _ in range(int(n).bit_length()):
            last = last[last]
        least, most = np.maximum.accumulate(low), np.minimum.accumulate(high)

        def moved(value: np.ndarray, us: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(least, value, side="right"), np.searchsorted(-most, -value, side="right"))
            at = np.where(np.isfinite(value), at, 0)
            left = at < n
            to = last[np.minimum(at, n - 1)]
            return np.where(left, values[to], value), np.where(left, times[to], us)

        self.start = (float(values[last[0]]), int(times[last[0]])) if self.start is None else tuple(x[0].item() for x in moved(np.array([self.start[0]]), np.array([self.start[1]])))
        low_v, low_us = moved(self.low_end[0], self.low_us)
        high_v, high_us = moved(self.high_end[0], self.high_us)
        lows, highs = self.low, self.high
        if self.least <= self.most:
            inner, outer = np.maximum(least, self.least), np.minimum(most, self.most)
            gone = np.flatnonzero(inner > outer)
            end = int(gone[0]) if len(gone) else n
            up = np.flatnonzero(np.diff(inner[:end], prepend=self.least) > 0)
            down = np.flatnonzero(np.diff(outer[:end], prepend=self.most) < 0)
            if self.least == -np.inf and end:  # differences with infinities are not numbers
                up = np.flatnonzero(inner[:end] > np.concatenate([[self.least], inner[: end - 1]]))
            if self.most == np.inf and end:
                down = np.flatnonzero(outer[:end] < np.concatenate([[self.most], outer[: end - 1]]))
            lows, low_v, low_us = np.concatenate([lows, inner[up]]), np.concatenate([low_v, values[last[up]]]), np.concatenate([low_us, times[last[up]]])
            highs, high_v, high_us = np.concatenate([highs, outer[down]]), np.concatenate([high_v, values[last[down]]]), np.concatenate([high_us, times[last[down]]])
            if end:
                self.least, self.most = float(inner[end - 1]), float(outer[end - 1])
            if end < n:  # all that were left leave here
                bound = np.nextafter(self.most, np.inf)
                lows, low_v, low_us = np.append(lows, bound), np.append(low_v, values[last[end]]), np.append(low_us, times[last[end]])
                self.least = float(bound) if bound > self.most else np.inf
        self.low, self.low_end, self.low_us = _merged(lows, low_v, low_us)
        self.high, self.high_end, self.high_us = _merged(highs, high_v, high_us)


def _merged(bounds: np.ndarray, value: np.ndarray, us: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Neighbours that end with one anchor become one."""
    keep = np.ones(len(bounds), bool)
    keep[:-1] = (us[1:] != us[:-1]) | (value.view(np.int64)[1:] != value.view(np.int64)[:-1])
    return bounds[keep], value[keep][None, :], us[keep]


MAP = "source string, metric string, _chunk bigint, least double, most double, low array<double>, low_v array<double>, low_us array<bigint>, high array<double>, high_v array<double>, high_us array<bigint>, start_v double, start_us bigint"


def runs(batch: pa.RecordBatch, keys: tuple[str, ...]) -> Iterator[tuple[tuple, int, int]]:
    """(key, from, to) of the runs of equal keys in a batch."""
    n = batch.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        codes = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    cuts = [*np.flatnonzero(new).tolist(), n]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield tuple(batch.column(k)[a].as_py() for k in keys), a, b


def chunk_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The map of each chunk: rows come sorted by source, metric, _chunk and _i."""

    def told(key: tuple, m: ChunkMap) -> pa.RecordBatch:
        row = {"source": key[0], "metric": key[1], "_chunk": key[2], "least": m.least, "most": m.most, "low": m.low.tolist(), "low_v": m.low_end[0].tolist(), "low_us": m.low_us.tolist(), "high": m.high.tolist(), "high_v": m.high_end[0].tolist(), "high_us": m.high_us.tolist(), "start_v": m.start[0], "start_us": m.start[1]}
        kinds = {"low": pa.list_(pa.float64()), "low_v": pa.list_(pa.float64()), "low_us": pa.list_(pa.int64()), "high": pa.list_(pa.float64()), "high_v": pa.list_(pa.float64()), "high_us": pa.list_(pa.int64())}
        return pa.RecordBatch.from_pydict({k: pa.array([v], kinds.get(k)) for k, v in row.items()})

    now, m = None, ChunkMap()
    for batch in batches:
        value, ts, tol = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("value", "ts_us", "_tol"))
        for key, a, b in runs(batch, (*STREAM, "_chunk")):
            if key != now:
                if now is not None:
                    yield told(now, m)
                now, m = key, ChunkMap()
            m.extend(value[a:b].astype(float), ts[a:b], tol[a:b].astype(float))
    if now is not None:
        yield told(now, m)


def chunk_entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The anchor before each chunk: maps come sorted by source, metric and _chunk, and are gone through one at a time."""
    stream, held = None, None
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            if (r["source"], r["metric"]) != stream:
                stream, held = (r["source"], r["metric"]), None
            if held is not None:
                rows.append({"source": r["source"], "metric": r["metric"], "_chunk": r["_chunk"], "entry_v": held[0], "entry_us": held[1]})
            arrays = {k: np.array(r[k], np.int64 if k.endswith("us") else float) for k in ("low", "low_v", "low_us", "high", "high_v", "high_us")}
            m = ChunkMap(r["least"], r["most"], arrays["low"], arrays["high"], arrays["low_v"][None, :], arrays["high_v"][None, :], arrays["low_us"], arrays["high_us"], (r["start_v"], r["start_us"]))
            held = m.after(held)
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("source", pa.string()), ("metric", pa.string()), ("_chunk", pa.int64()), ("entry_v", pa.float64()), ("entry_us", pa.int64())]))


def entry_anchors(rows: DataFrame, scratch: Scratch, parts: list[int]) -> DataFrame:
    """(source, metric, _chunk, entry_v, entry_us): the anchor before each chunk but the first.

    rows: source, metric, _chunk, _i, value, ts_us, _tol.  Chunks are gone through side by side; only their
    maps, a few numbers each where runs meet, come together by stream.
    """
    cells = rows.select(*STREAM, "_chunk", "_i", "value", "ts_us", "_tol").repartition(*parts, *STREAM, "_chunk").sortWithinPartitions(*STREAM, "_chunk", "_i")
    maps = scratch.write(cells.mapInArrow(chunk_maps, MAP), "maps")
    ordered = maps.repartition(*STREAM).sortWithinPartitions(*STREAM, "_chunk")
    return scratch.write(ordered.mapInArrow(chunk_entries, "source string, metric string, _chunk bigint, entry_v double, entry_us bigint"), "entries")


def in_chunks(df: DataFrame, history: int, chunk_rows: int, n_rows: int) -> DataFrame:
    """The readings with ``_chunk``, ``_i`` and ``_halo``, and beside them each chunk's halo.

    Streams whose ``_tol`` is null get the last ``history`` readings before the chunk.  The others get one row:
    its value and ts_us are the anchor at the chunk's beginning, ``_then_value`` and ``_then_us`` the last reading's.
    Order by ``_i`` within (source, metric, _chunk), by which rows are dealt; ``n_rows`` readings are expected.
    """
    size = max(chunk_rows, history, 1)
    scratch = Scratch(df.sparkSession, "chunks")
    parts = tasks(df.sparkSession, n_rows, -(-n_rows // size))
    rows = numbered(df, scratch, parts)
    rows = rows.withColumns({"_chunk": F.floor(F.col("_i") / size), "_halo": F.lit(False), "_then_value": F.col("value"), "_then_us": F.col("ts_us")})
    place = F.col("_i") % size
    before = rows.where(F.col("_tol").isNull() & (place >= size - max(history, 1))).withColumns({"_chunk": F.col("_chunk") + 1, "_halo": F.lit(True)})
    entries = entry_anchors(rows.where("_tol is not null"), scratch, parts)
    last = rows.where(F.col("_tol").isNotNull() & (place == size - 1)).withColumns({"_chunk": F.col("_chunk") + 1, "_halo": F.lit(True)})
    carried = last.join(entries, [*STREAM, "_chunk"]).withColumns({"value": F.col("entry_v"), "ts_us": F.col("entry_us")}).select(*rows.columns)
    return rows.unionByName(before).unionByName(carried).repartition(*parts, *STREAM, "_chunk")
