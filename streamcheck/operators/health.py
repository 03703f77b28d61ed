"""Tier 2: the health of each stream (H1-H19), at one instant or at every tick of a grid.

``score_at_last`` goes over its readings more than once: give it a written table
(``tier1.validated_table``), or the verdicts are judged again for each pass.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamcheck.config import FULL, MINUTE, ValidatorConfig
from streamcheck.functions import rules
from streamcheck.operators import panes
from streamcheck.operators.anchor import STREAM

WARM_UP = 30


def _signals(df: DataFrame, config: ValidatorConfig, now: Column) -> DataFrame:
    """df has per stream: recent, good, base counts, means, deviations, last_good_us, cadence_us."""
    warm = (F.col("base") >= WARM_UP) & (F.col("good") > 0) & F.col("finite")
    scored = df.withColumns({
        "quality_rate": rules.quality_rate(F.col("good"), F.col("recent")),
        "reporting_cadence": rules.reporting_cadence(F.col("recent"), F.coalesce("cadence_us", F.lit(MINUTE)), config.recent_window),
        "drift": rules.drift_signal(warm, F.col("mean_recent"), F.col("mean_base"), F.col("sd_base")),
        "variance_ratio": rules.variance_signal(warm, F.col("sd_recent"), F.col("sd_base")),
        "recency": rules.recency_signal(F.col("last_good_us"), now),
    })
    overall = rules.overall_score(*(F.col(c) for c in ("quality_rate", "reporting_cadence", "drift", "variance_ratio", "recency")))
    return scored.withColumn("overall", overall).withColumn("readings_in_window", F.col("recent"))


SCORE_COLUMNS = ["overall", "quality_rate", "reporting_cadence", "drift", "variance_ratio", "recency", "readings_in_window", "last_good_us"]


def score_health(validated: DataFrame, config: ValidatorConfig, now: Column, *extra: str) -> DataFrame:
    """One score per full-policy stream at ``now`` (a literal, or a column constant within a stream).

    One aggregation with map-side partial sums.  NaN and infinite good values, which only
    metrics without a range can have, leave drift and variance at 1.
    """
    ts, v = F.col("ts_us"), F.col("value")
    recent, base = ts >= now - config.recent_window, ts >= now - config.baseline_window
    good = F.col("quality") == rules.GOOD
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    use = F.when(finite, v)
    summed = validated.where(F.col("policy") == FULL).groupBy(*STREAM, *extra).agg(
        F.count_if(recent).alias("recent"),
        F.count_if(recent & good).alias("good"),
        F.count_if(base & good).alias("base"),
        (F.count_if(base & good & ~finite) == 0).alias("finite"),
        F.avg(F.when(recent & good, use)).alias("mean_recent"),
        F.avg(F.when(base & good, use)).alias("mean_base"),
        F.coalesce(F.stddev_samp(F.when(recent & good, use)), F.lit(0.0)).alias("sd_recent"),
        F.coalesce(F.stddev_samp(F.when(base & good, use)), F.lit(0.0)).alias("sd_base"),
        F.max(F.when(recent & good, ts)).alias("last_good_us"),
        F.first("cfg.cadence").alias("cadence_us"),
        F.max(now).alias("computed_us"),
    )
    return _signals(summed, config, F.col("computed_us")).select(*STREAM, *extra, *SCORE_COLUMNS, "computed_us")


def score_at_last(validated: DataFrame, config: ValidatorConfig) -> DataFrame:
    """Every stream scored at the last reading of its metric."""
    last = validated.groupBy("metric").agg(F.max("ts_us").alias("_now"))
    return score_health(validated.join(last, "metric"), config, F.col("_now"), "_now").drop("_now")


def health_history(validated: DataFrame, config: ValidatorConfig, start_us: int, end_us: int, step_us: int) -> DataFrame:
    """A score for each stream at each tick from its first reading on.

    The readings are aggregated once, into panes between the bounds of the ticks' windows; each window is
    merged from its own panes (``operators.panes``), so neither a stream's length nor what it was before
    a window has a part in it.
    """
    grid = panes.Grid(config, start_us, end_us, step_us)
    cells = panes.moment_panes(validated.where(F.col("ts_us") <= end_us), grid.column(F.col("ts_us")))
    ticks = np.arange(grid.ticks, dtype=np.int64) * step_us + start_us
    windows = panes.pane_windows(cells, config, grid, lambda first: ticks[ticks >= first])
    return _signals(windows, config, F.col("tick_us")).select(*STREAM, "tick_us", *SCORE_COLUMNS)


def scores_from_panes(kept: DataFrame, config: ValidatorConfig, width_us: int, ticks_us: list[int]) -> DataFrame:
    """H10 at each of some ticks, from kept panes of ``width_us``: no reading is read again.

    Ticks and both windows have to be multiples of the width.  A stream is scored from its first kept pane on.
    """
    if any(x % width_us for x in (*ticks_us, config.recent_window, config.baseline_window)):
        raise ValueError("ticks and windows must be multiples of the panes' width")
    ticks = np.array(sorted(ticks_us), dtype=np.int64)
    windows = panes.pane_windows(panes.merge_panes(kept), config, panes.Fixed(width_us), lambda first: ticks[ticks >= first])
    return _signals(windows, config, F.col("tick_us")).select(*STREAM, "tick_us", *SCORE_COLUMNS)


def worst_source(scores: DataFrame) -> DataFrame:
    """Of each metric the lowest score (of equals the first source)."""
    return scores.groupBy("metric").agg(F.min(F.struct("overall", "source")).alias("w"), F.count("*").alias("streams")).select("metric", F.col("w.source").alias("source"), F.col("w.overall").alias("overall"), "streams")


def health_listing(scores: DataFrame) -> DataFrame:
    """Scores with their status, the lowest first."""
    return scores.withColumn("status", rules.health_status(F.col("overall"))).orderBy("overall", *STREAM)


def average_by_metric(scores: DataFrame) -> DataFrame:
    """H19."""
    return scores.groupBy("metric").agg(F.avg("overall").alias("overall"), F.count("*").alias("streams"))


def scored_streams(scores: DataFrame) -> DataFrame:
    """H17."""
    return scores.select(*STREAM).distinct().orderBy(*STREAM)
