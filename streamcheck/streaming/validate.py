"""Structured Streaming twins of validation, pairing and the session join, and sinks.

Readings arrive in micro-batches; each key's rows of a batch are sorted by time before they
meet its state.  State per stream is small: the values that the count rule looks back on,
the last reading, the run's anchor, and the rows that wait for their turn.  With a ``delay`` a
stream's readings wait until one that much newer has come (its own watermark) or until the
stream has been silent that long, so rows out of order by less are judged in order.  A row older
than one already judged is late: it is judged against what the key knows, changes nothing there,
and is marked, so that a sink can put it aside.  None is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from streamcheck.config import DURATION, MetricConfig, ValidatorConfig, number_text
from streamcheck.functions import rules
from streamcheck.operators import panes
from streamcheck.operators.asof import session_lookup
from streamcheck.operators.tier1 import resolve_config
from streamcheck.sources.store import store_batch
from streamcheck.storage import CommittedTable

OUTPUT = "source string, metric string, value double, ts_us bigint, raw_value bigint, seq bigint, quality string, rule string, reason string, late boolean"
STATE = "recent array<double>, last_value double, last_us bigint, anchor_value double, anchor_us bigint, newest_us bigint, waiting array<struct<value:double,ts_us:bigint,raw_value:bigint,seq:bigint>>"


def config_for(config: ValidatorConfig, source: str, metric: str) -> MetricConfig | None:
    group = config.groups.get(source.split("/", 1)[0])
    return (group.metrics.get(metric) if group else None) or config.metrics.get(metric)


def judge(c: MetricConfig | None, v: float, ts: int, raw: int | None, recent: list[float], last: tuple[float, int] | None, anchor: tuple[float, int] | None) -> str:
    """The rule that decides on one reading, "" where it is good."""
    if c is None:
        return ""
    if v != v or v < c.low or v > c.high:
        return "value_range"
    if raw is not None and c.raw_low is not None and c.raw_high is not None and not c.raw_low <= raw <= c.raw_high:
        return "raw_range"
    if c.stuck_mode == DURATION:
        if anchor and not abs(v - anchor[0]) > c.stuck_tolerance and ts - anchor[1] >= c.stuck_window:
            return "stuck_reading"
    elif len(recent) >= c.history and all(abs(x - v) <= c.stuck_tolerance for x in recent[len(recent) - c.history :]):
        return "stuck_reading"
    if last and c.max_rate < float("inf") and 1_000_000 <= ts - last[1] <= c.rate_window and abs(v - last[0]) > c.max_rate:
        return "rate_of_change"
    return ""


def sentence(c: MetricConfig | None, rule: str, metric: str, v: float, ts: int, raw: int | None, last: tuple[float, int] | None, anchor: tuple[float, int] | None) -> str:
    """T11 for one reading, in the fixed formats of the rules' definition."""
    if rule == "value_range":
        return f"{metric} value is NaN" if v != v else f"{metric} = {v:.2f} outside plausible range [{number_text(c.low)}, {number_text(c.high)}]"
    if rule == "raw_range":
        return f"raw value = {raw} outside plausible range [{c.raw_low}, {c.raw_high}]"
    if rule == "stuck_reading" and c.stuck_mode == DURATION:
        return f"value unchanged ({v:.2f} ±{number_text(c.stuck_tolerance)}) for {(ts - anchor[1]) // 60_000_000} min — source may be stuck"
    if rule == "stuck_reading":
        return f"{c.stuck_count} consecutive readings within {number_text(c.stuck_tolerance)} of {v:.2f} — source may be stuck"
    if rule == "rate_of_change":
        return f"{metric} changed by {abs(v - last[0]):.2f} in {(ts - last[1]) // 1_000_000}s (threshold {c.max_rate:.2f}/{c.rate_window // 1_000_000}s)"
    return ""


def validate_stream(readings: DataFrame, config: ValidatorConfig, delay_us: int = 0) -> DataFrame:
    """A stream of readings with verdicts; key state never expires."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        source, metric = key
        c = config_for(config, source, metric)
        recent, last, anchor, newest, waiting = [], None, None, None, []
        if state.exists:
            values, lv, lt, av, at, newest, held = state.get
            recent, waiting = list(values), [(float(r["value"]), int(r["ts_us"]), r["raw_value"], int(r["seq"])) for r in held]
            last, anchor = (None, None) if lt is None else ((lv, lt), (av, at))
        for frame in frames:
            for v, ts, raw, seq in zip(frame["value"], frame["ts_us"], frame["raw_value"], frame["seq"], strict=True):
                waiting.append((float(v), int(ts), None if pd.isna(raw) else int(raw), int(seq)))
        waiting.sort(key=lambda r: (r[1], r[3]))
        newest = max([r[1] for r in waiting] + ([] if newest is None else [newest]), default=newest)
        turn = len(waiting) if state.hasTimedOut or not delay_us else sum(r[1] <= newest - delay_us for r in waiting)
        out, keep = [], max(c.history if c else 0, 1)
        for v, ts, raw, seq in waiting[:turn]:
            late = last is not None and ts < last[1]
            rule = judge(c, v, ts, raw, recent, last, anchor)
            quality = rules.GOOD if not rule else rules.INVALID if rule.endswith("range") else rules.SUSPECT
            out.append((source, metric, v, ts, raw, seq, quality, rule, sentence(c, rule, metric, v, ts, raw, last, anchor), late))
            if late:
                continue
            if anchor is None or not abs(v - anchor[0]) <= (c.stuck_tolerance if c else 0.0):
                anchor = (v, ts)
            recent, last = [*recent, v][-keep:], (v, ts)
        state.update((recent, *(last or (None, None)), *(anchor or (None, None)), newest, waiting[turn:]))
        if turn < len(waiting):
            state.setTimeoutDuration(max(1, delay_us // 1000))
        frame = pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")])
        frame["raw_value"] = frame["raw_value"].astype("Int64")
        yield frame

    timeout = GroupStateTimeout.ProcessingTimeTimeout if delay_us else GroupStateTimeout.NoTimeout
    return readings.select("source", "metric", "value", "ts_us", "raw_value", "seq").groupBy("source", "metric").applyInPandasWithState(step, OUTPUT, STATE, "append", timeout)


def pair_stream(readings: DataFrame, value_metric: str = "moisture", raw_metric: str = "moisture_raw", limit_us: int = 30_000_000) -> DataFrame:
    """Raw counts held per source until the next reading takes them or they are too old.

    A reading takes a count of its own time or before, never a later one, and a count that is taken is
    gone.  Rows older than one seen before are ``late``: a late reading that does not fit the count
    held leaves it to others, a late count replaces none.
    """
    columns = ["source", "metric", "value", "ts_us", "raw_value", "seq"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, at, last = state.get if state.exists else (None, None, None)
        out = []
        for metric, v, ts, seq in pd.concat(list(frames)).sort_values(["ts_us", "seq"], kind="stable")[["metric", "value", "ts_us", "seq"]].itertuples(index=False):
            ts, late = int(ts), last is not None and int(ts) < last
            last = ts if last is None else max(last, ts)
            if metric == raw_metric:
                if not late:
                    held, at = int(v), ts
                continue
            fits = held is not None and 0 <= (ts - at) // 1_000_000 < limit_us // 1_000_000
            out.append((key[0], metric, float(v), ts, held if fits else None, int(seq), late))
            if fits or not late:
                held, at = None, None
        state.update((held, at, last))
        frame = pd.DataFrame(out, columns=[*columns, "late"])
        frame["raw_value"] = frame["raw_value"].astype("Int64")
        yield frame

    both = readings.where(F.col("metric").isin(value_metric, raw_metric)).select(*columns)
    return both.groupBy("source").applyInPandasWithState(step, "source string, metric string, value double, ts_us bigint, raw_value bigint, seq bigint, late boolean", "raw bigint, at bigint, last bigint", "append", GroupStateTimeout.NoTimeout)


def join_sessions(readings: DataFrame, sessions: DataFrame) -> DataFrame:
    """A stream of readings (unit, ts_us, ...) with the session of a stored log that each falls into, else null.

    Stateless: equi-joins and a search in the unit's sorted sessions (``asof.session_lookup``); the log is
    read again for every micro-batch.
    """
    return session_lookup(readings, sessions)


def persist_batches(path: str, counters: str | None = None, late: str | None = None, kept_panes: str | None = None, config: ValidatorConfig | None = None, stream: str = "stream") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink: readings go to the table at ``path``, late ones to that at ``late`` if there is one.

    Each batch is a unit of these tables, named by ``stream`` and its epoch, and seen when it is committed: a
    batch that runs again leaves each reading once.  Streams with checkpoints of their own need names of
    their own.  ``counters`` gets a table of readings by zone, zone id, metric and verdict for each batch.
    ``kept_panes`` gets the batch's moments for the health of ticks (``streaming.health``), with ``config``'s check interval as width.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch = batch.persist()
        unit = f"{stream}-{epoch}"
        rows = batch if "reason" in batch.columns else batch.withColumn("reason", F.col("rule"))
        if late is None:
            store_batch(rows, path, unit)
        else:
            store_batch(rows.where("not late"), path, unit)
            store_batch(rows.where("late"), late, unit)
        if kept_panes is not None:
            known = resolve_config(rows, config)
            CommittedTable(batch.sparkSession, kept_panes).write(panes.moment_panes(known, panes.Fixed(config.check_interval).column(F.col("ts_us"))), unit)
        if counters is not None:
            zone, zone_id = rules.split_source(F.col("source"))
            counted = batch.groupBy(zone.alias("zone"), zone_id.alias("zone_id"), "metric", "quality").agg(F.count("*").alias("n"))
            counted.write.mode("overwrite").parquet(f"{counters}/epoch={epoch}")
        batch.unpersist()

    return write
