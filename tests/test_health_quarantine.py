"""Health signals, tick history and the quarantine machine."""

import math
import random

import pytest
from pyspark.sql import functions as F

from streamcheck.config import DAY, MINUTE, SECOND, MetricConfig, ValidatorConfig
from streamcheck.operators import panes
from streamcheck.operators.health import health_history, score_health, scores_from_panes
from streamcheck.operators.quarantine import quarantine_history

VALIDATED = "source string, metric string, value double, ts_us bigint, seq bigint, quality string"
CONFIG = ValidatorConfig()
NOW = 100 * DAY


def validated(spark, rows):
    df = spark.createDataFrame([(s, "m", float(v), t, i, q) for i, (s, v, t, q) in enumerate(rows)], VALIDATED)
    return df.withColumns({"policy": F.lit("full"), "cfg": F.struct(F.lit(60 * SECOND).cast("bigint").alias("cadence"))})


def score(spark, rows):
    return score_health(validated(spark, rows), CONFIG, F.lit(NOW)).first()


def test_silent_stream(spark):
    r = score(spark, [("a", 1.0, NOW - 2 * DAY, "good")])
    assert (r.quality_rate, r.reporting_cadence, r.drift, r.variance_ratio, r.recency) == (0, 0, 1, 1, 0)
    assert abs(r.overall - 30) < 1e-9 and r.last_good_us is None


def test_healthy_and_half_suspect(spark):
    rows = [("a", 50 + math.sin(i), NOW - i * MINUTE, "good") for i in range(60)]
    r = score(spark, rows)
    assert r.overall > 90 and min(r.quality_rate, r.reporting_cadence, r.drift, r.variance_ratio, r.recency) > 0.99
    r = score(spark, [("a", 50.0, NOW - i * MINUTE, "good" if i % 2 else "suspect") for i in range(40)])
    assert r.quality_rate == 0.5


def test_drift_and_old_rows(spark):
    rows = [("a", 50 + 0.5 * math.sin(i), NOW - 6 * DAY + i * 20 * MINUTE, "good") for i in range(400)] + [("a", 80.0, NOW - i * MINUTE, "good") for i in range(30)]
    assert score(spark, rows).drift < 0.5
    r = score(spark, [("a", 1.0, NOW - 8 * DAY, "good"), ("a", 9.0, NOW, "good")])
    assert r.readings_in_window == 1 and r.variance_ratio == 1.0


def test_nan_values_leave_signals_at_one(spark):
    r = score(spark, [("a", math.nan if i == 3 else float(i), NOW - i * MINUTE, "good") for i in range(50)])
    assert r.drift == r.variance_ratio == 1.0


def test_history_equals_single_scores(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), rng.gauss(50, 5), NOW - rng.randrange(9 * 24 * 60) * MINUTE, rng.choice(["good", "good", "suspect", "invalid"])) for _ in range(1500)]
    df = validated(spark, rows)
    ticks = list(range(NOW - 3 * DAY, NOW + 1, DAY))
    got = {(r.source, r.tick_us): r for r in health_history(df, CONFIG, ticks[0], ticks[-1], DAY).collect()}
    assert len(got) == 2 * len(ticks)
    for t in ticks:
        for r in score_health(df.where(F.col("ts_us") <= t), CONFIG, F.lit(t)).collect():
            h = got[r.source, t]
            assert (h.readings_in_window, h.last_good_us) == (r.readings_in_window, r.last_good_us)
            assert all(abs(h[c] - r[c]) < 1e-9 for c in ("overall", "drift", "variance_ratio", "recency", "quality_rate"))


def machine(scores, bad, fine, need):
    """The state machine, step by step."""
    q = at = None
    q, b, r, out = False, 0, 0, []
    for t, s in enumerate(scores):
        change = "unchanged"
        if not q:
            if s < bad:
                b, r = b + 1, 0
                if b >= need:
                    q, at, change = True, t, "entered"
            else:
                b = 0
        elif s >= fine:
            r, b = r + 1, 0
            if r >= need:
                q, at, b, r, change = False, None, 0, 0, "recovered"
        else:
            r = 0
        out.append((q, at, b, r, change))
    return out


@pytest.mark.parametrize("need,bad,fine", [(3, 40, 70), (2, 20, 60), (1, 50, 50), (0, 40, 70)])
def test_quarantine_equals_machine(spark, need, bad, fine):
    rng = random.Random(need)
    cases = {f"s{k}": [rng.choice([10.0, 30.0, 50.0, 65.0, 80.0, math.nan]) if rng.random() < 0.6 else rng.choice([15.0, 75.0]) for _ in range(60)] for k in range(30)}
    cases |= {"enter": [30.0] * 3 + [80.0] * 2 + [75.0] * 3, "hold": [30.0] * 3 + [50.0] * 10, "never": [30.0, 30.0, 50.0, 30.0], "reset": [30.0] * 3 + [80.0, 80.0, 60.0]}
    df = spark.createDataFrame([(s, "m", t, v) for s, vs in cases.items() for t, v in enumerate(vs)], "source string, metric string, tick_us bigint, overall double")
    config = ValidatorConfig(bad_threshold=bad, recovery_threshold=fine, consecutive=need)
    got = {(r.source, r.tick_us): (r.is_quarantined, r.quarantined_us, r.consecutive_bad, r.consecutive_recovery, r.transition) for r in quarantine_history(df, config).collect()}
    for s, vs in cases.items():
        assert [got[s, t] for t in range(len(vs))] == machine(vs, bad, fine, need), s


def test_thresholds_must_not_cross():
    with pytest.raises(ValueError):
        ValidatorConfig(metrics={"m": MetricConfig()}, bad_threshold=80, recovery_threshold=70)


def test_a_level_shift_leaves_later_windows_exact(spark):
    """A million off before the window: the deviation inside it keeps its digits."""
    rng = random.Random(11)
    rows = [("a", 1e6 + rng.gauss(0, 1), NOW - 20 * DAY + i * 10 * MINUTE, "good") for i in range(1500)]
    rows += [("a", rng.gauss(0, 1), NOW - 9 * DAY + i * 10 * MINUTE, "good") for i in range(9 * 144 + 1)]
    df = validated(spark, rows)
    for r in health_history(df, CONFIG, NOW - DAY, NOW, DAY // 4).collect():
        one = score_health(df.where(F.col("ts_us") <= r.tick_us), CONFIG, F.lit(r.tick_us)).first()
        assert abs(one.drift - r.drift) < 1e-9 and abs(one.variance_ratio - r.variance_ratio) < 1e-9 and 0 < r.drift < 1


def test_kept_panes_score_as_readings_do(spark):
    """Batches make panes, repeated panes merge, old ones are let go: each tick's score is that of the readings."""
    rng = random.Random(8)
    rows = [(rng.choice("abc"), rng.choice([math.nan, 7.0, 7.0] if rng.random() < 0.02 else [rng.gauss(50, 5)]), NOW - rng.randrange(10 * 24 * 3600) * SECOND, rng.choice(["good", "good", "suspect"])) for _ in range(2000)]
    rows += [("a", 3.0, NOW - k * MINUTE, "good") for k in (0, 30, 60, 7 * 24 * 60)]
    df = validated(spark, rows)
    width = 30 * MINUTE
    parts = [panes.moment_panes(df.where(F.col("seq") % 3 == k), panes.Fixed(width).column(F.col("ts_us"))) for k in range(3)]
    kept = panes.trim_panes(parts[0].unionByName(parts[1]).unionByName(parts[2]), CONFIG, NOW - 2 * width, width)
    ticks = [NOW - 2 * width, NOW - width, NOW]
    got = {(r.source, r.tick_us): r for r in scores_from_panes(kept, CONFIG, width, ticks).collect()}
    assert len(got) == 9
    for t in ticks:
        for one in score_health(df.where(F.col("ts_us") <= t), CONFIG, F.lit(t)).collect():
            r = got[one.source, t]
            assert (r.readings_in_window, r.last_good_us) == (one.readings_in_window, one.last_good_us)
            assert all(abs(one[c] - r[c]) < 1e-9 for c in ("overall", "quality_rate", "reporting_cadence", "drift", "variance_ratio", "recency"))
    with pytest.raises(ValueError):
        scores_from_panes(kept, CONFIG, width, [NOW + 1])
