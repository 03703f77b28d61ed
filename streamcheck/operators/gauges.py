"""Values exported on a tick grid, dropped where a stream has gone stale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamcheck.functions import rules
from streamcheck.operators.anchor import STREAM

STALE_US = 300_000_000


def stale_gauge(validated: DataFrame, start_us: int, end_us: int, step_us: int = 30_000_000, timeout_us: int = STALE_US) -> DataFrame:
    """Each stream's exported value at each tick from its first reading on.

    The value is the last good one, unless a tick since then found the last reading of any
    verdict older than the timeout (then it is removed until the next good reading).  The raw
    value is that of the last good row that had one, and goes with it.  Readings come before a
    tick of the same instant; those without a time are not looked at.

    Readings between two ticks become one row (its latest time, its last good values) that is combined
    before the shuffle; windows run over these rows, at most one for each tick that saw a new reading, and the
    ticks until the next one are laid out last.
    """
    good, at, until = F.col("quality") == rules.GOOD, F.col("ts_us"), end_us - (end_us - start_us) % step_us
    tick = F.lit(start_us) + F.greatest(F.ceil((at - start_us) / step_us), F.lit(0)) * step_us
    panes = validated.where(at <= until).groupBy(*STREAM, tick.alias("tick")).agg(
        F.max(at).alias("last_us"),
        F.max_by(F.when(good, F.struct("value", at.alias("t"))), F.when(good, F.struct(at, "seq"))).alias("g"),
        F.max_by(F.struct("raw_value", at.alias("t")), F.when(good & F.col("raw_value").isNotNull(), F.struct(at, "seq"))).alias("graw"),
    )
    order = Window.partitionBy(*STREAM).orderBy("tick")
    so_far, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    held = panes.withColumns({
        "last_us": F.max("last_us").over(so_far),
        "g": F.last("g", ignorenulls=True).over(so_far),
        "graw": F.last("graw", ignorenulls=True).over(so_far),
        "to": F.coalesce(F.lead("tick").over(order) - step_us, F.lit(until)),
    })
    # The last tick before the next reading is the first to tell whether the value was removed meanwhile.
    removed = held.withColumn("removed_us", F.max(F.when(F.col("to") - F.col("last_us") > timeout_us, F.col("to"))).over(earlier))
    ticks = removed.withColumn("tick_us", F.explode(F.sequence("tick", "to", F.lit(step_us))))
    fresh = F.col("tick_us") - F.col("last_us") <= timeout_us

    def shown(name: str, field: str) -> Column:
        return F.when(fresh & (F.col(f"{name}.t") > F.coalesce("removed_us", F.lit(-(2**62)))), F.col(f"{name}.{field}")).alias(field)

    return ticks.select(*STREAM, "tick_us", shown("g", "value"), shown("graw", "raw_value"), ((F.col("tick_us") - F.col("last_us")) / 1e6).alias("age_s"))


def gauge_pivot(gauges: DataFrame, metrics: list[str]) -> DataFrame:
    """One row per tick and place, one column per metric."""
    zone, zone_id = rules.split_source(F.col("source"))
    return gauges.groupBy("tick_us", zone.alias("zone"), zone_id.alias("zone_id")).pivot("metric", metrics).agg(F.first("value"))
