"""T4: the anchor of each run of unchanged values.

A run goes on while a value stays within ``tol`` of the run's first value, its anchor; a value
that leaves it becomes the next anchor.  That is sequential, but a step of over twice the
tolerance surely starts a run, whatever the anchor was.  Such steps cut a stream into
segments, and in a segment every row up to the first that leaves the segment's first value has
that value as anchor, while the row that leaves it is the next anchor.  Running windows of one
specification find all of these.  Only rows after a second anchor of a segment need the walk:
an Arrow UDF over the sorted rows looks at their columns alone and carries one anchor from
batch to batch, so there is no further shuffle or sort and memory does not grow with a stream.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

STREAM = ("source", "metric")
ANCHOR = pa.struct([("value", pa.float64()), ("us", pa.int64())])


def stream_order() -> WindowSpec:
    return Window.partitionBy(*STREAM).orderBy("ts_us", "seq")


def walk(values: list[float], times: list[int], tols: list[float], given: list[tuple[float, int] | None], held: tuple[float, int]) -> tuple[list[tuple[float, int]], tuple[float, int]]:
    """The anchor before each row, and that after the last; ``given`` replaces the carried anchor where it is set."""
    out = []
    for v, t, tol, start in zip(values, times, tols, given, strict=True):
        if start is not None:
            held = start
        out.append(held)
        if not abs(v - held[0]) <= tol:
            held = (v, t)
    return out, held


def walked_anchors(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Per batch (walks, value, ts_us, tol, given value, given us): the anchor before each row that walks, null elsewhere."""
    held = (0.0, 0)
    for walks, value, ts, tol, given, given_us in batches:
        at = np.flatnonzero(walks.fill_null(False).to_numpy(zero_copy_only=False))
        out: list[tuple[float, int] | None] = [None] * len(walks)
        if len(at):
            rows = pa.array(at)
            start = [None if u is None else (v, u) for v, u in zip(given.take(rows).to_pylist(), given_us.take(rows).to_pylist(), strict=True)]
            found, held = walk(value.take(rows).to_pylist(), ts.take(rows).to_pylist(), tol.take(rows).to_pylist(), start, held)
            for i, a in zip(at.tolist(), found, strict=True):
                out[i] = a
        yield pa.array([None if a is None else {"value": a[0], "us": a[1]} for a in out], ANCHOR)


def _last(what: Column, order: WindowSpec) -> Column:
    return F.last(what, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))


def prior_anchors(df: DataFrame, tol: str = "tol", order: WindowSpec | None = None) -> DataFrame:
    """Adds ``prior_anchor_value`` and ``prior_anchor_us``: the anchor before each row.

    df: source, metric, ts_us, seq, value, ``tol``, ....  Null at a stream's start, and on all
    rows of a stream whose ``tol`` is null (it is not judged by time); NaN leaves every anchor.
    One shuffle by stream and one sort.  ``order`` replaces the stream's own order, as in chunks of a stream.
    """
    order, own = order or stream_order(), F.struct("value", F.col("ts_us").alias("us"))
    step = F.abs(F.col("value") - F.lag("value").over(order))
    cut = F.coalesce(F.isnan(step) | (step > F.col(tol) * 2 * (1 + 1e-9)), F.lit(True))
    rows = df.withColumns({"_cut": cut, "_row": F.row_number().over(order)})
    rows = rows.withColumns({"_first": _last(F.when(F.col("_cut"), own), order), "_cut_at": _last(F.when(F.col("_cut"), F.col("_row")), order)})
    left = ~F.col("_cut") & ~F.coalesce(F.abs(F.col("value") - F.col("_first.value")) <= F.col(tol), F.lit(False))
    so_far, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_left", left)
    at = F.when(F.col("_left"), F.col("_row"))
    rows = rows.withColumns({"_left_at": F.max(at).over(so_far), "_left_before": F.max(at).over(before)})
    unmoved = F.coalesce(F.col("_left_at") < F.col("_cut_at"), F.lit(True))
    second = F.col("_left") & F.coalesce(F.col("_left_before") < F.col("_cut_at"), F.lit(True))
    rows = rows.withColumns({"_known": F.col("_cut") | unmoved | second, "_anchor": F.when(F.col("_cut") | second, own).otherwise(F.col("_first"))})
    rows = rows.withColumns({"_known_before": F.lag("_known").over(order), "_anchor_before": F.lag("_anchor").over(order)})

    walks = F.col(tol).isNotNull() & (~F.col("_known") | ~F.coalesce("_known_before", F.lit(True)))
    given = F.col("_known_before")
    # Nondeterministic, so that no later filter moves below it: it must see all rows of a stream in order.
    walker = F.arrow_udf(walked_anchors, "struct<value:double,us:bigint>").asNondeterministic()
    rows = rows.withColumn("_walked", walker(walks, F.col("value"), F.col("ts_us"), F.col(tol), F.when(given, F.col("_anchor_before.value")), F.when(given, F.col("_anchor_before.us"))))
    prior = F.when(F.col(tol).isNotNull(), F.when(F.coalesce("_known_before", F.lit(True)), F.col("_anchor_before")).otherwise(F.col("_walked")))
    return rows.withColumn("_prior", prior).select(*df.columns, F.col("_prior.value").alias("prior_anchor_value"), F.col("_prior.us").alias("prior_anchor_us"))
