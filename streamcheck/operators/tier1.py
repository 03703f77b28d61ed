"""Tier 1: a verdict on each reading (T1-T12), with the configuration that applies to it.

Readings are ``source, metric, value, ts_us, raw_value, seq``; ``seq`` breaks ties of time.
All window expressions share one specification, so validation is one shuffle by stream and
one sort, with metrics judged by time without change too.  Streams of more than ``chunk_rows``
readings are judged in time chunks (``operators.chunks``), so no task holds one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from streamcheck.config import DURATION, ValidatorConfig, metric_table, override_table, policy_table
from streamcheck.functions import rules
from streamcheck.operators.anchor import STREAM, prior_anchors, stream_order
from streamcheck.operators.chunks import CHUNK_ROWS, StreamSizes, held_by_stream, in_chunks, stream_sizes, tasks
from streamcheck.storage import Scratch


def resolve_config(df: DataFrame, config: ValidatorConfig) -> DataFrame:
    """Adds ``cfg`` (a group's whole override, else the metric's, else null) and ``policy``."""
    spark = df.sparkSession
    grouped = df.withColumn("_grp", rules.source_group(F.col("source")))
    out = grouped.join(F.broadcast(metric_table(spark, config)), "metric", "left")
    own = override_table(spark, config).withColumnsRenamed({"grp": "_grp", "cfg": "_own"})
    out = out.join(F.broadcast(own), ["_grp", "metric"], "left")
    out = out.join(F.broadcast(policy_table(spark, config).withColumnRenamed("grp", "_grp")), "_grp", "left")
    return out.select(*df.columns, F.coalesce("_own", "cfg").alias("cfg"), F.coalesce("policy", F.lit("full")).alias("policy"))


FRAME = 16


def with_history(df: DataFrame, config: ValidatorConfig, order: WindowSpec | None = None, value: str = "value", us: str = "ts_us") -> DataFrame:
    """What the rules ask of earlier readings: the last one, their number, and extremes of the last count - 1 of them.

    Short frames are window frames.  The extremes of a long one are put together from lags by
    powers of two, a few steps for each reading however long the frame is.  All windows share one
    specification, that of the stream or ``order``; ``value`` and ``us`` name the columns that later readings see.
    """
    order = order or stream_order()
    out = df.withColumns({"last_value": F.lag(value).over(order), "last_us": F.lag(us).over(order), "_before": F.row_number().over(order) - 1})
    widths = sorted({max(m.stuck_count - 1, 1) for m in config.all_metrics() if m.stuck_mode != DURATION})
    for w in (w for w in widths if w <= FRAME):
        frame = order.rowsBetween(-w, -1)
        out = out.withColumns({f"_low{w}": F.min(value).over(frame), f"_high{w}": F.max(value).over(frame)})
    long = [w for w in widths if w > FRAME]
    out = out.withColumns({"_low": F.col("last_value"), "_high": F.col("last_value")})
    size = 1
    while long:
        for w in [w for w in long if w < 2 * size]:
            reach = {f"_low{w}": F.least("_low", F.lag("_low", w - size).over(order)), f"_high{w}": F.greatest("_high", F.lag("_high", w - size).over(order))}
            out = out.withColumns(reach if w > size else {f"_low{w}": F.col("_low"), f"_high{w}": F.col("_high")})
            long.remove(w)
        if long:
            out = out.withColumns({"_low": F.least("_low", F.lag("_low", size).over(order)), "_high": F.greatest("_high", F.lag("_high", size).over(order))})
            size *= 2
    return out.drop("_low", "_high")


def rule_columns(df: DataFrame, config: ValidatorConfig) -> dict[str, Column]:
    """The four rules as booleans; ``df`` has cfg, history, and prior anchors where some metric is judged by time."""
    v, ts, c = F.col("value"), F.col("ts_us"), F.col("cfg")
    by_count = F.lit(False)
    for n in sorted({m.stuck_count for m in config.all_metrics() if m.stuck_mode != DURATION}):
        w = max(n - 1, 1)
        hit = rules.stuck_by_count(v, F.col("_before"), F.col(f"_low{w}"), F.col(f"_high{w}"), F.lit(n), c["stuck_tolerance"])
        by_count = F.when(c["stuck_count"] == n, hit).otherwise(by_count)
    by_anchor = rules.stuck_by_time(v, ts, F.col("prior_anchor_value"), F.col("prior_anchor_us"), c["stuck_tolerance"], c["stuck_window"]) if "prior_anchor_us" in df.columns else F.lit(False)
    return {
        "value_range": rules.out_of_range(v, c["low"], c["high"]),
        "raw_range": rules.raw_out_of_range(F.col("raw_value"), c["raw_low"], c["raw_high"]),
        "stuck_reading": F.when(c["stuck_mode"] == DURATION, by_anchor).otherwise(by_count),
        "rate_of_change": rules.rate_exceeded(v, ts, F.col("last_value"), F.col("last_us"), c["max_rate"], c["rate_window"]),
    }


def _ruled(slim: DataFrame, config: ValidatorConfig, order: WindowSpec, value: str = "value", us: str = "ts_us") -> DataFrame:
    """Anchors come last of the windows: the shuffle's order is not known to hold after their UDF."""
    known = with_history(slim, config, order, value, us)
    if by_time(config):
        known = prior_anchors(known, "_tol", order)
    known = resolve_config(known, config)
    return known.withColumns(rule_columns(known, config))


def by_time(config: ValidatorConfig) -> bool:
    return any(m.stuck_mode == DURATION for m in config.all_metrics())


def with_rules(df: DataFrame, config: ValidatorConfig, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """Adds cfg, policy and a boolean column for each rule (null where no configuration applies).

    Streams of more than ``chunk_rows`` readings, which a count by stream finds first, are judged in
    chunks of that size; with None none is looked for.  By the same count rows are dealt to tasks of about
    ``TASK_ROWS``, unless they come by stream already, in partitions of at most ``chunk_rows``.
    """
    sizes = stream_sizes(df, chunk_rows) if chunk_rows else StreamSizes(0, 0, 0, None, [])
    giants, n_rest = sizes.giants, sizes.rows - sizes.in_giants
    # The settings stay out of shuffles and sorts: windows need the tolerance alone, and rules meet the settings afterwards.
    slim = df
    if by_time(config):
        tol = F.when(F.col("cfg.stuck_mode") == DURATION, F.col("cfg.stuck_tolerance"))
        slim = resolve_config(df, config).select(*df.columns, tol.alias("_tol"))
    rest = slim if giants is None else slim.join(F.broadcast(giants), list(STREAM), "left_anti")
    parts = tasks(df.sparkSession, n_rest, sizes.streams)
    if parts and sizes.keys and n_rest > chunk_rows * held_by_stream(df):
        rest = rest.repartition(*parts, *sizes.keys)
    ruled = _ruled(rest, config, stream_order())
    if giants is None:
        return ruled
    history = max([1, *(m.history for m in config.all_metrics() if m.stuck_mode != DURATION)])
    far = slim.join(F.broadcast(giants), list(STREAM))
    far = far if by_time(config) else far.withColumn("_tol", F.lit(None).cast("double"))
    spread = in_chunks(far.select(*df.columns, "_tol"), history, chunk_rows, sizes.in_giants)
    order = Window.partitionBy(*STREAM, "_chunk").orderBy("_i")
    far = _ruled(spread, config, order, "_then_value", "_then_us")
    return ruled.unionByName(far.where("not _halo").select(*ruled.columns))


def reason() -> Column:
    """The sentence for the rule that decided, in the fixed formats of the rules' definition."""
    v, c = rules.two_digits(F.col("value")), F.col("cfg")
    minutes = F.floor((F.col("ts_us") - F.col("prior_anchor_us")) / 60_000_000)
    by_count = F.format_string("%d consecutive readings within %s of %s — source may be stuck", c["stuck_count"], c["tolerance_text"], v)
    unchanged = F.format_string("value unchanged (%s ±%s) for %d min — source may be stuck", v, c["tolerance_text"], minutes)
    return (
        F.when((F.col("rule") == "value_range") & F.isnan("value"), F.concat("metric", F.lit(" value is NaN")))
        .when(F.col("rule") == "value_range", F.format_string("%s = %s outside plausible range [%s, %s]", "metric", v, c["low_text"], c["high_text"]))
        .when(F.col("rule") == "raw_range", F.format_string("raw value = %d outside plausible range [%d, %d]", "raw_value", c["raw_low"], c["raw_high"]))
        .when(F.col("rule") == "stuck_reading", F.when(c["stuck_mode"] == DURATION, unchanged).otherwise(by_count))
        .when(F.col("rule") == "rate_of_change", F.format_string("%s changed by %s in %ds (threshold %s/%ds)", "metric", rules.two_digits(F.abs(F.col("value") - F.col("last_value"))), F.floor((F.col("ts_us") - F.col("last_us")) / 1_000_000), rules.two_digits(c["max_rate"]), F.floor(c["rate_window"] / 1_000_000)))
        .otherwise("")
    )


def validate_readings(df: DataFrame, config: ValidatorConfig, chunk_rows: int | None = CHUNK_ROWS) -> DataFrame:
    """The input's columns with ``quality``, ``rule`` and ``reason``.

    The more severe verdict wins and of equals the first, so the order is value range, raw
    range, stuck, rate.  A metric without configuration is good.  Later readings see all
    earlier ones, whatever their verdict.
    """
    marked = with_rules(df, config, chunk_rows)
    if "prior_anchor_us" not in marked.columns:
        marked = marked.withColumn("prior_anchor_us", F.lit(None).cast("bigint"))
    rule = F.when(F.col("cfg").isNull(), "").when(F.col("value_range"), "value_range").when(F.col("raw_range"), "raw_range").when(F.col("stuck_reading"), "stuck_reading").when(F.col("rate_of_change"), "rate_of_change").otherwise("")
    judged = marked.withColumn("rule", rule)
    quality = F.when(F.col("rule") == "", rules.GOOD).when(F.col("rule").isin("value_range", "raw_range"), rules.INVALID).otherwise(rules.SUSPECT)
    return judged.withColumns({"quality": quality, "reason": reason()}).select(*df.columns, "policy", "cfg", "quality", "rule", "reason")


def validated_table(df: DataFrame, config: ValidatorConfig) -> DataFrame:
    """``validate_readings`` written once as a table in the shared folder, for results that read it several times.

    Health, histories, gauges and reports each go over their readings more than once; over this
    table a pass reads the columns it needs, and no rule is judged again.
    """
    judged = validate_readings(df, config).withColumn("cfg", F.struct(F.col("cfg.cadence").alias("cadence")))
    return Scratch(df.sparkSession, "validated").write(judged, "readings")
