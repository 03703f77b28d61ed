"""Time chunks of giant streams against whole streams and sequential walks."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from streamcheck.config import DURATION, MINUTE, SECOND, MetricConfig, ValidatorConfig
from streamcheck.jobs.datasets import event_config, event_readings
from streamcheck.operators import tier1
from streamcheck.operators.chunks import ChunkMap

READING = "source string, metric string, value double, ts_us bigint, raw_value bigint, seq bigint"


def walked(values, times, tol, held):
    for v, t in zip(values, times, strict=True):
        if held is None or not abs(v - held[0]) <= tol:
            held = (v, t)
    return held


def same(a, b):
    return a == b or (a and b and a[1] == b[1] and a[0] != a[0] and b[0] != b[0])


def test_maps_of_random_cuts_tell_the_anchor_of_every_entry():
    draw = random.Random(7)
    for _ in range(400):
        n, tol, step = draw.randint(1, 30), draw.choice([0.0, 0.1, 0.3, 1.0, 5.0]), draw.choice([0.05, 0.1, 0.5, 2])
        x, values = draw.choice([0.0, 68.7, -3.2, 1e6]), []
        for _ in range(n):
            x += draw.choice([-1, 0, 0, 1]) * step
            values.append(draw.choice([math.nan, math.inf, -math.inf]) if draw.random() < 0.05 else round(x, 1) if draw.random() < 0.5 else x)
        times = list(range(100, 100 + n))
        cuts = [0, *sorted(draw.sample(range(n + 1), min(n + 1, 3))), n]
        m = ChunkMap()
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            m.extend(np.array(values[a:b]), np.array(times[a:b], np.int64), np.full(b - a, tol))
        entries = [None, (math.nan, 7), (math.inf, 7), *((v + d, 7) for v in values for d in (0, tol, -tol, tol * 1.0000001, -0.05))]
        assert all(same(walked(values, times, tol, e), m.after(e)) for e in entries), (values, tol, cuts)


def test_the_map_of_a_long_chunk_stays_small():
    steps = np.random.default_rng(0).choice([-0.1, 0.0, 0.1], 200_000)
    values, m = np.round(np.cumsum(steps), 1), ChunkMap()
    for a in range(0, len(values), 10_000):
        m.extend(values[a : a + 10_000], np.arange(a, a + 10_000), np.full(10_000, 0.5))
    assert len(m.low) + len(m.high) < 20


def judged(df, config, chunk_rows):
    out = tier1.validate_readings(df, config, chunk_rows)
    return sorted(tuple(r) for r in out.select("source", "metric", "seq", "quality", "rule", "reason").collect())


def test_chunks_judge_as_whole_streams(spark):
    readings, config = event_readings(spark, "/root/testdata/sf0.001", busy=True), event_config()
    whole = judged(readings, config, None)
    for chunk_rows in (1, 7, 60):
        assert judged(readings, config, chunk_rows) == whole


def test_cuts_within_long_runs_and_odd_values(spark):
    draw = random.Random(3)
    rows = []
    for k, metric in enumerate(("slow", "counted", "slow")):
        x = 50.0
        for i in range(300):
            x = round(x + draw.choice([0] * 8 + [-0.1, 0.1]), 1)
            v = draw.choice([math.nan, math.inf, x]) if draw.random() < 0.03 else x
            rows.append((f"s{k}", metric, v, draw.choice([i, i, i // 2]) * 10 * SECOND, None, i))
    slow = MetricConfig(stuck_mode=DURATION, resolution=0.2, stuck_window=5 * MINUTE, max_rate=0.05)
    config = ValidatorConfig(metrics={"slow": slow, "counted": MetricConfig(stuck_count=40, stuck_threshold=0.3, max_rate=0.05)})
    df = spark.createDataFrame(rows, READING)
    whole = judged(df, config, None)
    assert {r[4] for r in whole} >= {"stuck_reading", "rate_of_change"}
    assert judged(df, config, 50) == whole and judged(df, config, 299) == whole


def test_one_stream_of_a_million_is_spread_over_the_tasks(spark):
    n = 1_000_000
    i = F.col("id")
    df = spark.range(0, n, 1, 8).select(F.lit("one/1").alias("source"), F.lit("t").alias("metric"), F.round(F.sin(i / 5000) * 3, 1).alias("value"), (i * SECOND).alias("ts_us"), F.lit(None).cast("bigint").alias("raw_value"), i.alias("seq"))
    config = ValidatorConfig(metrics={"t": MetricConfig(stuck_mode=DURATION, resolution=0.1, stuck_window=5 * MINUTE, max_rate=5.0)})
    out = tier1.validate_readings(df, config, 50_000)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # a few MB would become one task
    shares = [r[1] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*")).collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(shares) == n and len(shares) >= 5 and max(shares) < 0.4 * n
    told = {r[0]: r[1] for r in out.groupBy("rule").agg(F.count("*")).collect()}
    held, stuck = None, 0
    values = [round(v, 1) for v in (np.sin(np.arange(n) / 5000) * 3).tolist()]
    for k, v in enumerate(values):
        stuck += held is not None and not abs(v - held[0]) > 0.1 and k - held[1] >= 300
        if held is None or not abs(v - held[0]) <= 0.1:
            held = (v, k)
    assert told["stuck_reading"] == stuck
