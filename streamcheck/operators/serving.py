"""Latest values, history, activity and outages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamcheck.functions import rules
from streamcheck.operators.anchor import STREAM


def sensors_latest(readings: DataFrame) -> DataFrame:
    """A1: every stream with its latest row by seq: one aggregation, no sort of the facts."""
    zone, zone_id = rules.split_source(F.col("source"))
    latest = readings.groupBy(*STREAM).agg(F.max_by(F.struct("seq", "value", "ts_us", "quality"), "seq").alias("r"))
    return latest.select(zone.alias("zone"), zone_id.alias("zone_id"), "metric", "r.*").orderBy("zone", "zone_id", "metric")


def stream_latest(readings: DataFrame, source: str, metric: str) -> DataFrame:
    """A2."""
    return readings.where((F.col("source") == source) & (F.col("metric") == metric)).orderBy(F.desc("seq")).limit(1)


def reading_history(readings: DataFrame, source: str, metric: str, now_us: int, hours: int = 24) -> DataFrame:
    """A3: a stream's readings of the last hours, by seq."""
    own = (F.col("source") == source) & (F.col("metric") == metric) & (F.col("ts_us") >= now_us - hours * 3_600_000_000)
    return readings.where(own).orderBy("seq")


def quality_window(validated: DataFrame, now_us: int, window_us: int = 86_400_000_000) -> DataFrame:
    """Readings by verdict in the window that ends now."""
    recent = validated.where((F.col("ts_us") > now_us - window_us) & (F.col("ts_us") <= now_us))
    return recent.groupBy("quality").agg(F.count("*").alias("n"))


def reading_rate(validated: DataFrame, window_us: int = 300_000_000, step_us: int = 30_000_000) -> DataFrame:
    """Readings per second of each stream and verdict in sliding windows (start, start + window].

    Readings are counted in panes of a step first, which combines before the shuffle; a pane falls into
    window / step windows.
    """
    first = F.floor((F.col("ts_us") - window_us) / step_us) + 1
    counted = validated.groupBy(*STREAM, "quality", first.alias("pane")).agg(F.count("*").alias("n"))
    spread = counted.select(*STREAM, "quality", "n", F.explode(F.sequence("pane", F.col("pane") + (window_us // step_us - 1))).alias("k"))
    return spread.groupBy(*STREAM, "quality", (F.col("k") * step_us + window_us).alias("tick_us")).agg((F.sum("n") / (window_us / 1e6)).alias("per_second"))


def last_reading_age(readings: DataFrame, now_us: int) -> DataFrame:
    """Seconds, to the millisecond, since each stream's last reading of any verdict."""
    return readings.groupBy(*STREAM).agg((F.floor((F.lit(now_us) - F.max("ts_us")) / 1000) / 1000.0).alias("age_s"))


def outages(readings: DataFrame, now_us: int, limit_s: float = 900.0) -> DataFrame:
    """A10: streams silent for longer than the limit."""
    return last_reading_age(readings, now_us).where(F.col("age_s") > limit_s)


def deduplicated_latest(readings: DataFrame) -> DataFrame:
    """The row of highest seq for each stream and time, for appends that were retried."""
    order = Window.partitionBy(*STREAM, "ts_us").orderBy(F.desc("seq"))
    return readings.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def dashboard_readings(readings: DataFrame) -> DataFrame:
    """Raw moisture counts are a side channel, not a reading to show."""
    return readings.where(F.col("metric") != "moisture_raw")


def usable_samples(readings: DataFrame, digits: int = 1) -> DataFrame:
    """Samples that a probe failed to take (NaN) are left out, others are rounded as they are published."""
    return readings.where(~F.isnan("value") & F.col("value").isNotNull()).withColumn("value", F.round("value", digits))
