"""The test tables seen as streams of readings, sessions and messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamcheck.config import MINUTE, SECOND, TIER1_ONLY, GroupConfig, MetricConfig, ValidatorConfig
from streamcheck.functions.parsing import micros

KINDS = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_readings(spark: SparkSession, sf_dir: str, busy: bool = False) -> DataFrame:
    """Events as readings: 20 streams of four sources, or with ``busy`` one source and so 5 streams."""
    e = table(spark, sf_dir, "events")
    k = F.col("user_id") % 4
    source = F.lit("site/all") if busy else F.concat(F.when(k == 0, "bench/").otherwise("site/"), k.cast("string"))
    return e.select(source.alias("source"), F.col("event_type").alias("metric"), "value", micros(e.schema, "ts").alias("ts_us"), F.get_json_object("props", "$.k").try_cast("bigint").alias("raw_value"), F.col("event_id").alias("seq"))


RULES = MetricConfig(low=0.5, high=200.0, raw_low=2, raw_high=97, max_rate=100.0, rate_window=1800 * SECOND, stuck_threshold=5.0, stuck_count=3, cadence=1200 * SECOND)
SLOW = MetricConfig(low=0.5, high=300.0, max_rate=100.0, rate_window=1800 * SECOND, stuck_mode="duration", resolution=60.0, stuck_window=40 * MINUTE, cadence=1200 * SECOND)


def event_config(recent_hours: int = 6) -> ValidatorConfig:
    """Rules for the events: views are judged by time without change; bench sources have their own rules for errors and no health."""
    metrics = {m: RULES for m in KINDS if m != "view"} | {"view": SLOW}
    bench = GroupConfig(policy=TIER1_ONLY, metrics={"error": MetricConfig(low=5.0, high=50.0, stuck_count=1000)})
    return ValidatorConfig(metrics=metrics, groups={"bench": bench}, recent_window=recent_hours * 60 * MINUTE)


def lineitem_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a large stream with many equal times: one stream per supplier."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.select(F.concat(F.lit("supp/"), F.col("l_suppkey").cast("string")).alias("source"), F.lit("quantity").alias("metric"), F.col("l_quantity").alias("value"), micros(l.schema, "l_shipdate").alias("ts_us"), F.lit(None).cast("bigint").alias("raw_value"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"))


LINEITEM_RULES = MetricConfig(low=2.0, high=49.0, max_rate=30.0, rate_window=2 * 86_400 * SECOND, stuck_threshold=3.0, stuck_count=3)


def bench_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events other than signups, by unit, with a simple verdict."""
    e = table(spark, sf_dir, "events").where("event_type <> 'signup'")
    quality = F.when(F.col("value") > 400, "invalid").when(F.col("value") > 300, "suspect").otherwise("good")
    return e.select((F.col("user_id") % 16 + 1).cast("string").alias("unit"), "value", micros(e.schema, "ts").alias("ts_us"), F.col("event_id").alias("seq"), quality.alias("quality"))


def bench_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signups as sessions of units."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return e.select((F.col("user_id") % 16 + 1).cast("string").alias("unit"), F.col("event_id").alias("id"), micros(e.schema, "ts").alias("started_us"), F.concat(F.lit("batch-"), F.get_json_object("props", "$.k")).alias("batch_label"))
