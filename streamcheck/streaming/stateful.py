"""Validation and pairing as stateful processors (X1, X3, H18): state by kind, timers, and state that expires.

Recent values are a list, what is known of a stream is one value, and rows that wait for their turn are a
map by time, so a batch adds and removes rows and does not write all of them again.  State is kept by the
RocksDB provider, which ``use_rocksdb`` sets for queries that start after it.  A query with timers or
expiring state does not end by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from streamcheck.config import ValidatorConfig
from streamcheck.functions import rules
from streamcheck.streaming.validate import OUTPUT, config_for, judge, sentence

PAIRED = "source string, metric string, value double, ts_us bigint, raw_value bigint, seq bigint, late boolean"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in schema.split(", ")])
    out["raw_value"] = out["raw_value"].astype("Int64")
    return out


class Validator(StatefulProcessor):
    """Judges a stream's readings in order of time once one ``delay_us`` newer has come, or after that long a silence."""

    def __init__(self, config: ValidatorConfig, delay_us: int):
        self.config, self.delay_us = config, delay_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.recent = handle.getListState("recent", "value double")
        self.known = handle.getValueState("known", "last_value double, last_us bigint, anchor_value double, anchor_us bigint, newest_us bigint")
        self.waiting = handle.getMapState("waiting", "ts_us bigint, seq bigint, twin bigint", "value double, raw_value bigint")

    def judged(self, key: tuple, rows: list[tuple], newest: int | None) -> pd.DataFrame:
        source, metric = key
        c = config_for(self.config, source, metric)
        recent = [r[0] for r in self.recent.get()] if self.recent.exists() else []
        last = anchor = None
        if self.known.exists():
            lv, lt, av, at, before = self.known.get()
            last, anchor = (None, None) if lt is None else ((lv, lt), (av, at))
            newest = before if newest is None else newest if before is None else max(newest, before)
        out, keep = [], max(c.history if c else 0, 1)
        for v, ts, raw, seq in sorted(rows, key=lambda r: (r[1], r[3])):
            late = last is not None and ts < last[1]
            rule = judge(c, v, ts, raw, recent, last, anchor)
            quality = rules.GOOD if not rule else rules.INVALID if rule.endswith("range") else rules.SUSPECT
            out.append((source, metric, v, ts, raw, seq, quality, rule, sentence(c, rule, metric, v, ts, raw, last, anchor), late))
            if not late:
                if anchor is None or not abs(v - anchor[0]) <= (c.stuck_tolerance if c else 0.0):
                    anchor = (v, ts)
                recent, last = [*recent, v][-keep:], (v, ts)
        if out:
            self.recent.put([(v,) for v in recent])
        self.known.update((*(last or (None, None)), *(anchor or (None, None)), newest))
        return _frame(out, OUTPUT)

    def take(self, keys: list[tuple]) -> list[tuple]:
        rows = []
        for k in keys:
            v, raw = self.waiting.getValue(k)
            rows.append((v, k[0], raw, k[1]))
            self.waiting.removeKey(k)
        return rows

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        come = []
        for frame in rows:
            for v, ts, raw, seq in zip(frame["value"], frame["ts_us"], frame["raw_value"], frame["seq"], strict=True):
                come.append((float(v), int(ts), None if pd.isna(raw) else int(raw), int(seq)))
        if not self.delay_us:
            yield self.judged(key, come, None)
            return
        for v, ts, raw, seq in come:
            twin = 0
            while self.waiting.containsKey((ts, seq, twin)):
                twin += 1
            self.waiting.updateValue((ts, seq, twin), (v, raw))
        newest = max((r[1] for r in come), default=None)
        before = self.known.get()[4] if self.known.exists() else None
        newest = before if newest is None else newest if before is None else max(newest, before)
        keys = [tuple(k) for k in self.waiting.keys()]
        due = [k for k in keys if k[0] <= newest - self.delay_us]
        yield self.judged(key, self.take(due), newest)
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at[0] if isinstance(at, tuple) else at)
        if len(due) < len(keys):
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + max(1, self.delay_us // 1000))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        yield self.judged(key, self.take([tuple(k) for k in self.waiting.keys()]), None)

    def close(self) -> None:
        pass


def validate_stateful(readings: DataFrame, config: ValidatorConfig, delay_us: int = 0) -> DataFrame:
    """``streaming.validate.validate_stream`` with state by kind; the same verdicts, sentences and late marks."""
    mode = "processingTime" if delay_us else "none"
    return readings.select("source", "metric", "value", "ts_us", "raw_value", "seq").groupBy("source", "metric").transformWithStateInPandas(Validator(config, delay_us), OUTPUT, "append", mode)


class Pairing(StatefulProcessor):
    """Raw counts held until the next reading takes them; a source's state is gone ``limit_us`` after its last row."""

    def __init__(self, raw_metric: str, limit_us: int):
        self.raw_metric, self.limit_us = raw_metric, limit_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "raw bigint, at bigint, last bigint", ttlDurationMs=max(1, self.limit_us // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        held, at, last = self.held.get() if self.held.exists() else (None, None, None)
        out = []
        for metric, v, ts, seq in pd.concat(list(rows)).sort_values(["ts_us", "seq"], kind="stable")[["metric", "value", "ts_us", "seq"]].itertuples(index=False):
            ts, late = int(ts), last is not None and int(ts) < last
            last = ts if last is None else max(last, ts)
            if metric == self.raw_metric:
                if not late:
                    held, at = int(v), ts
                continue
            fits = held is not None and 0 <= (ts - at) // 1_000_000 < self.limit_us // 1_000_000
            out.append((key[0], metric, float(v), ts, held if fits else None, int(seq), late))
            if fits or not late:
                held, at = None, None
        self.held.update((held, at, last))
        yield _frame(out, PAIRED)

    def close(self) -> None:
        pass


def pair_stateful(readings: DataFrame, value_metric: str = "moisture", raw_metric: str = "moisture_raw", limit_us: int = 30_000_000) -> DataFrame:
    """``streaming.validate.pair_stream`` with state that expires: silent sources leave none behind.

    After that silence nothing is held and nothing counts as late.
    """
    both = readings.where(F.col("metric").isin(value_metric, raw_metric)).select("source", "metric", "value", "ts_us", "raw_value", "seq")
    return both.groupBy("source").transformWithStateInPandas(Pairing(raw_metric, limit_us), PAIRED, "append", "processingTime")
