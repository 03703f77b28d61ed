"""Validation's tasks hold as many rows however long the input is, and their rows carry no settings."""

import re

import pytest
from pyspark.sql import functions as F

from streamcheck.config import MINUTE, SECOND, MetricConfig, ValidatorConfig
from streamcheck.operators import chunks, tier1
from streamcheck.sources import store

COUNTED = MetricConfig(low=2, max_rate=40, stuck_count=3)
TIMED = MetricConfig(stuck_mode="duration", resolution=9.0, stuck_window=2 * MINUTE)
CONFIG = ValidatorConfig(metrics={"m": COUNTED, "m1": COUNTED, "m2": TIMED})
ONE = ValidatorConfig(metrics={"m": COUNTED})


def readings(spark, n, source, metric):
    i = F.col("id")
    return spark.range(0, n, 1, 4).select(F.expr(source).alias("source"), F.expr(metric).alias("metric"), (F.pmod(F.xxhash64(i), F.lit(60))).cast("double").alias("value"), (F.floor(i / 50) * SECOND).alias("ts_us"), F.lit(None).cast("bigint").alias("raw_value"), i.alias("seq"))


def judged(df, config, chunk_rows=chunks.CHUNK_ROWS):
    return tier1.validate_readings(df, config, chunk_rows)


def shares(df):
    return [r[1] for r in df.groupBy(F.spark_partition_id()).count().collect()]


STREAMS = {
    "one metric": ("concat('s/', id % 400)", "'m'", ONE),
    "one source": ("'s/1'", "concat('m', id % 400)", CONFIG),
    "both": ("concat('s/', id % 200)", "concat('m', id div 200 % 3)", CONFIG),
}


@pytest.mark.parametrize("kind", sorted(STREAMS))
def test_the_largest_task_does_not_grow_with_the_input(spark, monkeypatch, kind):
    source, metric, config = STREAMS[kind]
    monkeypatch.setattr(chunks, "TASK_ROWS", 500)
    for n in (4_000, 16_000):
        df = readings(spark, n, source, metric)
        out = judged(df, config)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 1
        found = shares(out)
        assert sum(found) == n and max(found) < 2.5 * 500
    assert out.exceptAll(judged(df, config, None)).count() == 0


@pytest.mark.parametrize("config", [ONE, CONFIG])
def test_rows_that_are_shuffled_and_sorted_carry_no_settings(spark, tmp_path, config):
    path = str(tmp_path / "r")
    readings(spark, 100, *STREAMS["both"][:2]).write.parquet(path)
    plan = judged(spark.read.parquet(path), config)._jdf.queryExecution().executedPlan().toString().splitlines()
    under = plan[next(i for i, line in enumerate(plan) if "Exchange hashpartitioning" in line) + 1]
    assert ("Project [" in under or "FileScan" in under) and not re.search(r"cfg#\d+[,\]]", under)


def test_streams_in_chunks_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(chunks, "TASK_ROWS", 500)
    df = readings(spark, 16_000, "'s/1'", "if(id % 2 = 0, 'm1', 'm2')")
    out = judged(df, CONFIG, 400)
    found = shares(out)
    assert max(found) < 4 * 500 and sum(found) == 16_000
    assert out.exceptAll(judged(df, CONFIG, None)).count() == 0


def test_a_table_in_buckets_is_dealt_anew_only_where_buckets_are_too_large(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(chunks, "TASK_ROWS", 100)
    name = "sized_" + tmp_path.name.replace("-", "_")
    store.lay_out(readings(spark, 4_000, *STREAMS["both"][:2]), name, str(tmp_path / "t"), buckets=4)
    for chunk_rows, shuffles in ((1000, 0), (900, 1)):
        out = judged(spark.table(name), CONFIG, chunk_rows)
        assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == shuffles
        assert out.exceptAll(judged(spark.table(name), CONFIG, None)).count() == 0
    spark.sql(f"DROP TABLE {name}")
