"""Validator settings as dataclasses, and as the small tables that jobs broadcast.

A configuration has one row per configured metric and group: its size is set by whoever
writes it, not by the data, so broadcasting it is safe at any scale.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

SECOND, MINUTE, DAY = 1_000_000, 60_000_000, 86_400_000_000
COUNT, DURATION = "count", "duration"
FULL, TIER1_ONLY = "full", "tier1_only"


@dataclass(frozen=True)
class MetricConfig:
    """Rules of one metric; durations in microseconds."""

    low: float = -math.inf
    high: float = math.inf
    raw_low: int | None = None
    raw_high: int | None = None
    max_rate: float = math.inf
    rate_window: int = 600 * SECOND
    stuck_mode: str = COUNT
    stuck_threshold: float = 0.01
    stuck_count: int = 6
    resolution: float | None = None
    stuck_window: int = 60 * MINUTE
    cadence: int = 60 * SECOND

    def with_stuck_defaults_for(self, metric: str) -> MetricConfig:
        """Slow, coarsely quantised metrics are judged by time without change, not by a count of readings."""
        if metric.lower() in ("temperature", "humidity"):
            return replace(self, stuck_mode=DURATION, resolution=0.1, stuck_window=60 * MINUTE)
        return self

    @property
    def stuck_tolerance(self) -> float:
        """C6."""
        return self.resolution if self.stuck_mode == DURATION and self.resolution is not None else self.stuck_threshold

    @property
    def history(self) -> int:
        """Readings before the current one that the count rule looks at."""
        return max(self.stuck_count - 1, 0)


@dataclass(frozen=True)
class GroupConfig:
    """A source group (the source's text before the first slash): its policy and whole-metric overrides."""

    policy: str = FULL
    metrics: dict[str, MetricConfig] = field(default_factory=dict)


@dataclass(frozen=True)
class ValidatorConfig:
    metrics: dict[str, MetricConfig] = field(default_factory=dict)
    groups: dict[str, GroupConfig] = field(default_factory=dict)
    baseline_window: int = 7 * DAY
    recent_window: int = 60 * MINUTE
    check_interval: int = 30 * SECOND
    bad_threshold: float = 40.0
    recovery_threshold: float = 70.0
    consecutive: int = 3

    def __post_init__(self) -> None:
        if self.bad_threshold > self.recovery_threshold:
            raise ValueError("bad_threshold must not exceed recovery_threshold")

    def all_metrics(self) -> list[MetricConfig]:
        return [*self.metrics.values(), *(m for g in self.groups.values() for m in g.metrics.values())]


FIELDS = {"low": pa.float64(), "high": pa.float64(), "raw_low": pa.int64(), "raw_high": pa.int64(), "max_rate": pa.float64(), "rate_window": pa.int64(), "stuck_mode": pa.string(), "stuck_tolerance": pa.float64(), "stuck_count": pa.int32(), "stuck_window": pa.int64(), "cadence": pa.int64(), "low_text": pa.string(), "high_text": pa.string(), "tolerance_text": pa.string()}
CFG = pa.struct(list(FIELDS.items()))


def number_text(x: float) -> str:
    """A number as reasons print it: the shortest digits that tell it, no exponent, no ``.0``."""
    x = float(x)
    if not math.isfinite(x):
        return "NaN" if x != x else "inf" if x > 0 else "-inf"
    text = format(Decimal(repr(x)), "f")
    return text.rstrip("0").rstrip(".") if "." in text else text


def _fields(m: MetricConfig) -> dict:
    texts = {"low_text": number_text(m.low), "high_text": number_text(m.high), "tolerance_text": number_text(m.stuck_tolerance)}
    return texts | {k: float(getattr(m, k)) if kind == pa.float64() else getattr(m, k) for k, kind in FIELDS.items() if k not in texts}


def _local(spark: SparkSession, columns: dict[str, list]) -> DataFrame:
    """A local relation: no job runs to make or broadcast it."""
    return spark.createDataFrame(pa.table({k: pa.array(v, CFG if k == "cfg" else pa.string()) for k, v in columns.items()}))


def metric_table(spark: SparkSession, config: ValidatorConfig) -> DataFrame:
    """(metric, cfg): settings for any group."""
    return _local(spark, {"metric": list(config.metrics), "cfg": [_fields(m) for m in config.metrics.values()]})


def override_table(spark: SparkSession, config: ValidatorConfig) -> DataFrame:
    """(grp, metric, cfg): settings that replace a metric's whole configuration for one group."""
    own = [(g, k, _fields(m)) for g, c in config.groups.items() for k, m in c.metrics.items()]
    return _local(spark, {"grp": [x[0] for x in own], "metric": [x[1] for x in own], "cfg": [x[2] for x in own]})


def policy_table(spark: SparkSession, config: ValidatorConfig) -> DataFrame:
    return _local(spark, {"grp": list(config.groups), "policy": [c.policy for c in config.groups.values()]})


def csv_run_config(metric: str, cadence: int = 60 * SECOND, low: float = -math.inf, high: float = math.inf, max_rate: float = 10.0, consecutive: int = 3) -> ValidatorConfig:
    """Settings of an offline run over one file."""
    rules = MetricConfig(low=low, high=high, max_rate=max_rate, rate_window=10 * cadence, cadence=cadence).with_stuck_defaults_for(metric)
    return ValidatorConfig(metrics={metric: rules}, consecutive=consecutive)


BENCH_ZONE = "charstation"


def deployed_config() -> ValidatorConfig:
    """Settings of the deployed mix of probes (C7): garden metrics, and a bench group that is judged by tier 1 alone.

    Values are fixed.  The bench reads raw counts every two seconds, and steps between its readings are
    what is studied, so its own settings have no rate rule.
    """
    def rules(metric: str, **own: float) -> MetricConfig:
        return MetricConfig(**own).with_stuck_defaults_for(metric)

    counts = rules("raw_adc", low=0.0, high=4095.0, raw_low=100, raw_high=3995, max_rate=480.0)
    metrics = {
        "moisture": rules("moisture", low=0.0, high=100.0, raw_low=100, raw_high=3995, max_rate=30.0),
        "humidity": rules("humidity", low=0.0, high=100.0, max_rate=30.0),
        "temperature": rules("temperature", low=-40.0, high=200.0, max_rate=20.0),
        "raw_adc": counts,
    }
    bench = GroupConfig(policy=TIER1_ONLY, metrics={"raw_adc": replace(counts, max_rate=math.inf, cadence=2 * SECOND)})
    return ValidatorConfig(metrics=metrics, groups={BENCH_ZONE: bench})
