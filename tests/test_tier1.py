"""Tier-1 rules on small series, the anchor against a sequential walk, and plans."""

import math
import random

import pytest
from pyspark.sql import functions as F

from streamcheck.config import MINUTE, SECOND, TIER1_ONLY, GroupConfig, MetricConfig, ValidatorConfig, deployed_config
from streamcheck.operators.anchor import prior_anchors
from streamcheck.operators.tier1 import resolve_config, validate_readings, with_rules

READING = "source string, metric string, value double, ts_us bigint, raw_value bigint, seq bigint"
PLAIN = MetricConfig(low=0.0, high=100.0, raw_low=100, raw_high=3995, max_rate=20.0)


def series(values, step=10 * SECOND, source="bed/1", metric="moisture", raw=None, start=0):
    return [(source, metric, float(v), start + i * step, raw, i) for i, v in enumerate(values)]


def judge(spark, rows, config=None):
    config = config or ValidatorConfig(metrics={"moisture": PLAIN})
    out = validate_readings(spark.createDataFrame(rows, READING), config).orderBy("source", "metric", "ts_us", "seq").collect()
    return [(r.quality, r.rule) for r in out], [r.reason for r in out]


def test_value_and_raw_range(spark):
    rows = [("s", "moisture", v, i * 3600 * SECOND, raw, i) for i, (v, raw) in enumerate([(105.0, None), (-5.0, None), (math.nan, None), (42.0, 2400), (42.0, 0), (42.0, 4095), (200.0, 0), (0.0, 100), (100.0, 3995)])]
    got, why = judge(spark, rows)
    assert [r for _, r in got] == ["value_range"] * 3 + ["", "raw_range", "raw_range", "value_range", "", ""]
    assert why[2] == "moisture value is NaN" and why[0] == "moisture = 105.00 outside plausible range [0, 100]"


def test_stuck_by_count(spark):
    assert [r for _, r in judge(spark, series([42.5] * 6))[0]] == [""] * 5 + ["stuck_reading"]
    assert [r for _, r in judge(spark, series([42.5, 42.5, 43.0, 42.5, 42.5, 42.5]))[0]] == [""] * 6
    one = ValidatorConfig(metrics={"moisture": MetricConfig(stuck_count=1)})
    assert judge(spark, series([1.0, 50.0]), one)[0] == [("suspect", "stuck_reading")] * 2


def test_rate_of_change(spark):
    got = lambda *rows: judge(spark, [("s", "moisture", float(v), t * SECOND, None, i) for i, (v, t) in enumerate(rows)])[0][-1][1]
    assert got((20, 0), (80, 60)) == "rate_of_change"
    assert got((40, 0), (42, 60)) == "" and got((20, 0), (80, 3600)) == "" and got((20, 0)) == ""
    assert got((20, 0), (80, 0)) == "" and got((999, 0), (50, 60)) == "rate_of_change"  # an invalid spike still counts as the reading before


FROZEN = ValidatorConfig(metrics={"temperature": MetricConfig(stuck_mode="duration", resolution=0.1, stuck_window=60 * MINUTE)})


def test_stuck_by_time(spark):
    rows = series([68.7] * 720, metric="temperature")
    flagged = [i for i, (_, r) in enumerate(judge(spark, rows, FROZEN)[0]) if r]
    assert flagged[0] * 10 == 3600 and flagged == list(range(360, 720))
    moving = series([68.7] * 270 + [70 + i * 0.3 for i in range(100)], metric="temperature")
    assert not any(r for _, r in judge(spark, moving, FROZEN)[0])
    back = [("s", "temperature", 70.0, 7200 * SECOND, None, 1), ("s", "temperature", 70.0, 0, None, 0)]
    assert judge(spark, back, FROZEN)[0] == [("good", ""), ("suspect", "stuck_reading")]


def test_streams_are_independent_and_unknown_metrics_are_good(spark):
    rows = series([42.5] * 6, source="a/1") + series([1, 9, 3, 12, 5, 14], source="b/1") + series([math.nan, 7, 7, 7, 7, 7, 7], metric="vibration")
    got, _ = judge(spark, rows)
    assert [r for _, r in got] == [""] * 5 + ["stuck_reading"] + [""] * 6 + [""] * 7


def test_groups_replace_whole_configurations(spark):
    config = ValidatorConfig(metrics={"m": PLAIN}, groups={"bench": GroupConfig(policy=TIER1_ONLY, metrics={"m": MetricConfig(low=5.0)})})
    df = spark.createDataFrame([("bench/1", "m"), ("bed/1", "m"), ("bench", "other"), ("benchmark/1", "m")], "source string, metric string")
    got = {(r.source, r.metric): (r.policy, r.cfg.low if r.cfg else None, r.cfg.raw_low if r.cfg else None) for r in resolve_config(df, config).collect()}
    assert got == {("bench/1", "m"): ("tier1_only", 5.0, None), ("bed/1", "m"): ("full", 0.0, 100), ("bench", "other"): ("tier1_only", None, None), ("benchmark/1", "m"): ("full", 0.0, 100)}


@pytest.mark.parametrize("seed", range(4))
def test_anchor_equals_sequential_walk(spark, seed):
    rng = random.Random(seed)
    tol = rng.choice([0.0, 0.5, 2.0])
    rows = []
    for s in range(6):
        v = 0.0
        for i in range(120):
            v = rng.choice([v, v + rng.uniform(-tol - 0.1, tol + 0.1), rng.uniform(-5, 5), math.nan, math.inf]) if rng.random() < 0.9 else v + 50
            if not math.isfinite(v) and rng.random() < 0.7:
                v = 0.0
            rows.append((f"s{s}", "m", v, rng.randrange(60) * SECOND, None, i))
    want, by = {}, {}
    for r in sorted(rows, key=lambda r: (r[0], r[3], r[5])):
        before = by.get(r[0])
        want[r[0], r[5]] = before
        if before is None or not abs(r[2] - before[0]) <= tol:
            by[r[0]] = (r[2], r[3])
    for parts in (1, 7):
        df = spark.createDataFrame(rows, READING).withColumn("tol", F.lit(tol)).repartition(parts)
        got = {(r.source, r.seq): None if r.prior_anchor_us is None else (r.prior_anchor_value, r.prior_anchor_us) for r in prior_anchors(df).collect()}
        assert {k: None if v is None else (str(v[0]), v[1]) for k, v in got.items()} == {k: None if v is None else (str(v[0]), v[1]) for k, v in want.items()}


def test_validation_is_one_shuffle(spark):
    config = ValidatorConfig(metrics={"moisture": PLAIN, "raw_adc": MetricConfig(stuck_count=4)})
    plan = validate_readings(spark.createDataFrame(series([1, 2, 3]), READING), config)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Cartesian" not in plan


def test_time_rules_keep_one_shuffle_and_one_scan(spark, tmp_path):
    config = ValidatorConfig(metrics={"moisture": PLAIN, "temperature": MetricConfig(stuck_mode="duration", resolution=0.1), "raw_adc": MetricConfig(stuck_count=1000)})
    spark.createDataFrame(series([1, 2, 3]), READING).write.parquet(str(tmp_path / "r"))
    plan = validate_readings(spark.read.parquet(str(tmp_path / "r")), config)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("FileScan") == 1 and plan.count("Sort [") == 1


@pytest.mark.parametrize("count", [2, 17, 18, 33, 40, 65])
def test_long_frames_equal_a_look_at_every_reading(spark, count):
    rng = random.Random(count)
    rows = []
    for s in range(5):
        v = 0.0
        for i in range(150):
            v = rng.choice([v, v, v, v + rng.choice([-1, 0.5, 9])]) if rng.random() < 0.9 else rng.choice([math.nan, 1.0])
            v = 0.0 if math.isnan(v) and rng.random() < 0.8 else v
            rows.append((f"s{s}", "m", v, i * SECOND, None, i))
    config = ValidatorConfig(metrics={"m": MetricConfig(stuck_count=count, stuck_threshold=1.5)})
    got = {(r.source, r.seq): r.stuck_reading for r in with_rules(spark.createDataFrame(rows, READING), config).collect()}
    by = {}
    for s, _, v, _, _, i in rows:
        before = by.setdefault(s, [])
        assert got[s, i] == (len(before) >= count - 1 and all(abs(x - v) <= 1.5 for x in before[len(before) - count + 1 :])), (s, i)
        before.append(v)


def test_filters_after_the_rules_do_not_change_anchors(spark):
    rows = [("s", "temperature", 10.0 + (i % 7) * 0.06, i * 600 * SECOND, None, i) for i in range(60)]
    marked = with_rules(spark.createDataFrame(rows, READING), FROZEN)
    whole = {r.seq: r.prior_anchor_us for r in marked.collect()}
    assert {r.seq: r.prior_anchor_us for r in marked.where("seq % 3 = 1 and value > 10.1").collect()}.items() <= whole.items()


def test_deployed_preset(spark):
    config = deployed_config()
    rows = [("charstation/3", "raw_adc", 3000.0, 0, 3000, 0), ("charstation/3", "raw_adc", 1200.0, 2 * SECOND, 1200, 1), ("charstation/3", "raw_adc", 12.0, 4 * SECOND, 12, 2), ("bed/9", "raw_adc", 3000.0, 0, 3000, 3), ("bed/9", "raw_adc", 1200.0, 2 * SECOND, 1200, 4), ("bed/9", "temperature", -41.0, 0, None, 5)]
    out = {r.seq: (r.rule, r.policy) for r in validate_readings(spark.createDataFrame(rows, READING), config).collect()}
    assert out == {0: ("", "tier1_only"), 1: ("", "tier1_only"), 2: ("raw_range", "tier1_only"), 3: ("", "full"), 4: ("rate_of_change", "full"), 5: ("value_range", "full")}


def test_two_digits_round_the_exact_value_and_halves_to_even(spark):
    from streamcheck.functions.rules import two_digits

    values = [0.125, 0.375, -0.125, 2.675, 1.005, 0.0, -0.0, 0.005, 0.015, 99.995, 1234567.885, 1e9 + 0.005, 12345678901.235, 1e14, 0.1 + 0.2, 200.0, 490.02, -7.555]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(two_digits(F.col("v"))).collect()]
    assert got == ["%.2f" % v for v in values]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (float("-inf"),)], "v double").select(two_digits(F.col("v"))).collect()
    assert [r[0] for r in odd] == ["NaN", "inf", "-inf"]


def test_numbers_in_reasons_have_no_exponent_and_no_point_zero():
    from streamcheck.config import number_text

    assert [number_text(x) for x in (0, 100.0, 5.0, 0.01, -40.0, 1e21, 1e-7, float("inf"), float("-inf"), 2.5)] == ["0", "100", "5", "0.01", "-40", "1" + "0" * 21, "0.0000001", "inf", "-inf", "2.5"]
