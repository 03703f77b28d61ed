"""Validation reports and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamcheck.functions import rules


def quality_counts(validated: DataFrame, *keys: str) -> DataFrame:
    """Readings by verdict, and their percentages (0 of nothing)."""
    q = F.col("quality")
    counted = validated.groupBy(*keys).agg(F.count("*").alias("total"), *(F.count_if(q == k).alias(k) for k in (rules.GOOD, rules.SUSPECT, rules.INVALID)))
    share = {f"{k}_pct": F.when(F.col("total") > 0, F.col(k) * 100.0 / F.col("total")).otherwise(0.0) for k in (rules.GOOD, rules.SUSPECT, rules.INVALID)}
    return counted.withColumns(share)


def flagged_rules(validated: DataFrame, *keys: str) -> DataFrame:
    """R2, flat: how often each rule decided."""
    return validated.where(F.col("quality") != rules.GOOD).groupBy(*keys, "rule").agg(F.count("*").alias("n"))


def flagged_readings(validated: DataFrame) -> DataFrame:
    """The readings that are not good, as a table."""
    return validated.where(F.col("quality") != rules.GOOD).select("ts_us", "source", "metric", "value", "quality", "rule", "reason")


def metric_report(validated: DataFrame, scores: DataFrame | None = None, quarantine: DataFrame | None = None, skipped: DataFrame | None = None) -> DataFrame:
    """One row per metric, with its rules as a map and its sources as an array.

    The readings are read once: counts by metric, source, verdict and rule combine before the one
    shuffle that carries them, and all else is made of those few rows.
    """
    q, n = F.col("quality"), F.col("n")
    cells = validated.groupBy("metric", "source", "quality", "rule").agg(F.count("*").alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))
    by_rule = cells.groupBy("metric", "quality", "rule").agg(F.sum("n").alias("n"), F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.collect_set("source").alias("sources"))
    kinds = (rules.GOOD, rules.SUSPECT, rules.INVALID)
    out = by_rule.groupBy("metric").agg(
        F.sum("n").alias("total"), *(F.coalesce(F.sum(F.when(q == k, n)), F.lit(0)).alias(k) for k in kinds),
        F.min("first_us").alias("first_us"), F.max("last_us").alias("last_us"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        F.map_from_entries(F.sort_array(F.collect_list(F.when(q != rules.GOOD, F.struct("rule", "n"))))).alias("flagged_rules"),
    )
    out = out.withColumns({f"{k}_pct": F.col(k) * 100.0 / F.col("total") for k in kinds} | {"duration_s": F.greatest(F.lit(0), F.floor((F.col("last_us") - F.col("first_us")) / 1_000_000))})
    if skipped is not None:
        out = out.join(skipped, "metric", "left")
    if scores is not None:
        worst = scores.groupBy("metric").agg(F.min_by(F.struct(*[c for c in scores.columns if c != "metric"]), F.struct("overall", "source")).alias("health"))
        out = out.join(worst, "metric", "left")
    if quarantine is not None:
        out = out.join(quarantine.groupBy("metric").agg(F.count_if("is_quarantined").alias("quarantined"), F.count_if(F.col("transition") == "entered").alias("quarantine_events")), "metric", "left")
    return out


def batch_summary(joined: DataFrame) -> DataFrame:
    """A4: readings by unit, batch and session; invalid ones left out."""
    kept = joined.where(F.col("quality") != rules.INVALID)
    keys = [F.col("unit"), F.col("session.batch_label").alias("batch_label"), F.col("session.started_us").alias("started_us")]
    return kept.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("low"), F.max("value").alias("high"))


def noise_floor(joined: DataFrame) -> DataFrame:
    """A5: mean and peak-to-peak of each session; suspect readings stay and are counted."""
    kept = joined.where(F.col("quality") != rules.INVALID)
    keys = [F.col("unit"), F.col("session.batch_label").alias("batch_label"), F.col("session.started_us").alias("started_us")]
    return kept.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"), (F.max("value") - F.min("value")).alias("peak_to_peak"), F.count_if(F.col("quality") == rules.SUSPECT).alias("suspect_rows"))


def readings_total(validated: DataFrame) -> DataFrame:
    """Readings by zone, zone id, metric and verdict."""
    zone, zone_id = rules.split_source(F.col("source"))
    return validated.groupBy(zone.alias("zone"), zone_id.alias("zone_id"), "metric", "quality").agg(F.count("*").alias("n"))


def oversample_mean(samples: DataFrame, keys: list[Column], value: str, half_up: bool = False) -> DataFrame:
    """The whole-number mean of a reading's raw samples, truncated or rounded half up."""
    total, n = F.sum(F.col(value).cast("bigint")), F.count("*")
    grouped = samples.groupBy(*keys).agg(total.alias("_sum"), n.alias("samples"))
    top = F.col("_sum") + F.floor(F.col("samples") / 2) if half_up else F.col("_sum")
    return grouped.withColumn("mean", F.floor(top / F.col("samples")).cast("bigint")).drop("_sum")
