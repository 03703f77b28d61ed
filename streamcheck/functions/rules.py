"""Column functions: single rules, health signals and names.

Comparisons with NaN are false in the rules' definition; Spark orders NaN above every number,
so guards are explicit.
"""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

GOOD, SUSPECT, INVALID = "good", "suspect", "invalid"


def source_group(source: Column) -> Column:
    """Text before the first slash, else all."""
    return F.substring_index(source, "/", 1)


def split_source(source: Column) -> tuple[Column, Column]:
    """(zone, zone_id); without a slash both are the source."""
    at = F.locate("/", source)
    return F.when(at > 0, F.substring_index(source, "/", 1)).otherwise(source), F.when(at > 0, F.substr(source, at + 1)).otherwise(source)


def calibrate_moisture(raw: Column, dry: Column, wet: Column) -> Column:
    """Raw count to percent between a dry and a wet reference."""
    return F.least(F.greatest((dry - raw) * 100.0 / (dry - wet), F.lit(0.0)), F.lit(100.0))


def out_of_range(value: Column, low: Column, high: Column) -> Column:
    """NaN, or outside the inclusive range."""
    return F.isnan(value) | (value < low) | (value > high)


def raw_out_of_range(raw: Column, low: Column, high: Column) -> Column:
    """Both the raw value and a range are there, and it is outside."""
    return F.coalesce((raw < low) | (raw > high), F.lit(False))


def stuck_by_count(value: Column, n_before: Column, low_before: Column, high_before: Column, count: Column, tolerance: Column) -> Column:
    """At least count - 1 readings before, all within tolerance of this one; a count under 2 always holds."""
    near = (high_before - value <= tolerance) & (value - low_before <= tolerance)
    return (count <= 1) | ((n_before >= count - 1) & F.coalesce(near, F.lit(False)))


def stuck_by_time(value: Column, ts: Column, anchor_value: Column, anchor_ts: Column, tolerance: Column, window: Column) -> Column:
    """T5: the run's anchor before this reading is not left, and is at least ``window`` old."""
    left = F.abs(value - anchor_value)
    return anchor_ts.isNotNull() & ~F.coalesce((left > tolerance) & ~F.isnan(left), F.lit(False)) & (ts - anchor_ts >= window)


def rate_exceeded(value: Column, ts: Column, last_value: Column, last_ts: Column, max_rate: Column, window: Column) -> Column:
    """A change over ``max_rate`` since the reading before, of whole seconds over 0 and at most ``window`` ago."""
    delta, gap = F.abs(value - last_value), ts - last_ts
    on = ~F.isnan(max_rate) & (max_rate < float("inf")) & last_ts.isNotNull()
    return on & (gap >= 1_000_000) & (gap <= window) & (delta > max_rate) & ~F.isnan(delta)


def two_digits(value: Column) -> Column:
    """A number with two digits after the point, rounded by its exact value and halves to even, as reasons print it.

    The format function of the JVM rounds the shortest digits that tell a number, halves up.  Here the
    number is compared with the middle of two hundredths without error: 200 x is the sum of a product
    and of what its rounding lost, which the halves of the factors give.
    """
    x = F.abs(value)
    cents = F.floor(x * 100).cast("double")
    cents = F.when(cents > x * 100, cents - 1).otherwise(cents)
    big = x * 134217729.0
    head = big - (big - x)
    product = x * 200.0
    lost = (head * 200.0 - product) + (x - head) * 200.0
    over = (product - (cents * 2 + 1)) + lost
    whole = (cents + F.when((over > 0) | ((over == 0) & (F.pmod(cents, F.lit(2)) == 1)), 1).otherwise(0)).cast("bigint")
    plain = F.concat((F.floor(whole / 100)).cast("string"), F.lit("."), F.lpad((whole % 100).cast("string"), 2, "0"))
    sign = F.when((value < 0) | (value.cast("string") == "-0.0"), "-").otherwise("")
    text = F.when(F.isnan(value), "NaN").when(x == float("inf"), "inf").when(x < 1e13, plain).otherwise(F.format_string("%.2f", x))
    return F.concat(F.when(F.isnan(value), "").otherwise(sign), text)


def health_status(score: Column) -> Column:
    """H13."""
    return F.when(score >= 90, "healthy").when(score >= 70, "degraded").when(score >= 40, "suspect").otherwise("bad")


def quality_rate(good: Column, recent: Column) -> Column:
    """H2."""
    return F.when(recent > 0, F.try_divide(good, recent)).otherwise(0.0)


def reporting_cadence(recent: Column, cadence_us: Column, window_us: int) -> Column:
    """H3: readings against those expected in the window."""
    seconds = F.greatest(F.lit(1), F.floor(cadence_us / 1_000_000))
    return F.least(F.lit(1.0), recent / F.greatest(F.lit(1), F.floor(F.lit(window_us // 1_000_000) / seconds)))


def drift_signal(warm: Column, mean_recent: Column, mean_base: Column, sd_base: Column) -> Column:
    """H5, H6: distance of the recent mean from the baseline in standard deviations, 3 or more being 0."""
    z = F.try_divide(F.abs(mean_recent - mean_base), sd_base)
    on = warm & (sd_base > 0) & ~F.isnan(sd_base) & ~F.isnan(z)
    return F.when(on, F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), z / 3))).otherwise(1.0)


def variance_signal(warm: Column, sd_recent: Column, sd_base: Column) -> Column:
    """H5, H7: ratio of deviations, full within a factor of two."""
    ratio = F.try_divide(sd_recent, sd_base)
    on = warm & (sd_base > 0) & ~F.isnan(sd_base) & ~F.isnan(ratio)
    return F.when(~on | on.isNull(), 1.0).when(ratio < 0.5, ratio / 0.5).when(ratio > 2, F.try_divide(F.lit(2.0), ratio)).otherwise(1.0)


def recency_signal(last_good_us: Column, now_us: Column) -> Column:
    """H8: whole seconds since the last good reading, 600 or more being 0."""
    age = F.greatest(F.lit(0), F.floor((now_us - last_good_us) / 1_000_000))
    return F.when(last_good_us.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), age / 600)))


def overall_score(quality: Column, cadence: Column, drift: Column, variance: Column, recency: Column) -> Column:
    """H9."""
    return (0.35 * quality + 0.25 * cadence + 0.20 * drift + 0.10 * variance + 0.10 * recency) * 100


def register_sql(spark: SparkSession) -> None:
    """Make ``health_status(score)`` callable from SQL, as a function that the optimizer inlines."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION health_status(score DOUBLE) RETURNS STRING RETURN CASE WHEN score >= 90 THEN 'healthy' WHEN score >= 70 THEN 'degraded' WHEN score >= 40 THEN 'suspect' ELSE 'bad' END")
