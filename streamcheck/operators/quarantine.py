"""Tier 3: quarantine with hysteresis over health scores (Q1-Q7).

A stream enters after ``consecutive`` scores in a row under the bad threshold and leaves after as
many at or over the recovery threshold.  As the first is not above the second, a run that
could enter and one that could leave never overlap, so the state is the last of such events,
and windows replace the state machine.  A NaN score belongs to neither run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamcheck.config import SECOND, ValidatorConfig
from streamcheck.operators.anchor import STREAM


def quarantine_history(scores: DataFrame, config: ValidatorConfig, tick: str = "tick_us") -> DataFrame:
    """scores: source, metric, tick, overall.  Adds state, transition, counters, entry time and reason."""
    n = max(1, config.consecutive)
    order = Window.partitionBy(*STREAM).orderBy(tick)
    last = order.rowsBetween(-(n - 1), 0)
    score = F.col("overall")
    bad, fine = (score < config.bad_threshold) & ~F.isnan(score), (score >= config.recovery_threshold) & ~F.isnan(score)

    def all_of(what: Column) -> Column:
        return (F.count("*").over(last) == n) & (F.sum(what.cast("int")).over(last) == n)

    event = F.when(all_of(bad), 1).when(all_of(fine), 0)
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    state = scores.withColumn("_event", event).withColumn("_state", F.coalesce(F.last("_event", ignorenulls=True).over(so_far), F.lit(0)))
    state = state.withColumn("_before", F.coalesce(F.lag("_state").over(order), F.lit(0)))
    entered, left = (F.col("_state") == 1) & (F.col("_before") == 0), (F.col("_state") == 0) & (F.col("_before") == 1)
    state = state.withColumns({
        "transition": F.when(entered, "entered").when(left, "recovered").otherwise("unchanged"),
        "_row": F.row_number().over(order),
    })
    # A counter is the number of rows since it was last reset: by a row of the other kind, or by a change of state.
    state = state.withColumns({
        "_bad_reset": F.max(F.when(~bad | left, F.col("_row"))).over(so_far),
        "_fine_reset": F.max(F.when(~fine | entered, F.col("_row"))).over(so_far),
    })
    since = {k: F.col("_row") - F.coalesce(F.col(f"_{k}_reset"), F.lit(0)) for k in ("bad", "fine")}
    quarantined = F.col("_state") == 1
    state = state.withColumns({
        "_entry": F.last(F.when(entered, F.struct(F.col(tick).alias("t"), F.col("_row").alias("row"))), ignorenulls=True).over(so_far),
        "_fine": F.max(F.when(fine, F.col("_row"))).over(so_far),
    })
    held = F.when(F.coalesce("_fine", F.lit(0)) > F.col("_entry.row"), F.lit(0)).otherwise(F.lit(n))  # until a score counts towards recovery
    reason = F.format_string("Health score below %s for %d+ seconds", F.lit(config.bad_threshold).cast("int").cast("string"), F.lit(config.check_interval // SECOND * config.consecutive).cast("bigint"))
    out = state.withColumns({
        "is_quarantined": quarantined,
        "quarantined_us": F.when(quarantined, F.col("_entry.t")),
        "quarantine_reason": F.when(quarantined, reason),
        "consecutive_bad": F.when(quarantined, held).otherwise(since["bad"]),
        "consecutive_recovery": F.when(quarantined & ~entered, since["fine"]).otherwise(F.lit(0)),
    })
    return out.drop("_event", "_state", "_before", "_row", "_bad_reset", "_fine_reset", "_entry", "_fine")


def quarantine_events(history: DataFrame) -> DataFrame:
    """Q6: entries, exits and ticks in quarantine of each stream."""
    return history.groupBy(*STREAM).agg(
        F.count_if(F.col("transition") == "entered").alias("entered"),
        F.count_if(F.col("transition") == "recovered").alias("recovered"),
        F.count_if("is_quarantined").alias("ticks_quarantined"),
        F.count("*").alias("ticks"),
    )


def quarantine_current(history: DataFrame, latest_scores: DataFrame, tick: str = "tick_us") -> DataFrame:
    """Streams now in quarantine with their latest score (0 where there is none), the lowest first."""
    now = history.groupBy(*STREAM).agg(F.max_by(F.struct("is_quarantined", "quarantined_us"), tick).alias("s")).where("s.is_quarantined")
    score = latest_scores.select(*STREAM, F.col("overall").alias("score"))
    return now.join(score, list(STREAM), "left").select(*STREAM, F.col("s.quarantined_us").alias("quarantined_us"), F.coalesce("score", F.lit(0.0)).alias("score")).orderBy("score", *STREAM)


def quarantine_totals(history: DataFrame, tick: str = "tick_us") -> DataFrame:
    """Q5: scored streams, and those in quarantine."""
    now = history.groupBy(*STREAM).agg(F.max_by("is_quarantined", tick).alias("q"))
    return now.agg(F.count("*").alias("total_active"), F.count_if("q").alias("total_quarantined"))
