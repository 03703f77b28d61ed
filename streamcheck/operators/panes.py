"""Moments of good readings in panes of time: what windows over a stream need, merged without loss of digits.

A pane has, for one stream and one stretch of time, the counts of readings, the mean and the sum of squares
about it (m2), and the last good time.  Two panes merge by the pairwise update of mean and m2, so a window
is put together from its own panes only: what a stream did before, such as a level far off, leaves no trace in
its digits, and no sum grows with the stream.  Panes are made by one aggregation that combines before its
shuffle; from there on work goes with panes, whose number is set by windows and ticks, not by readings.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from streamcheck.config import FULL, ValidatorConfig
from streamcheck.functions import rules
from streamcheck.operators.anchor import STREAM

PANE = "source string, metric string, pane bigint, n bigint, good bigint, odd bigint, mean double, m2 double, good_us bigint, first_us bigint, cadence_us bigint"
WINDOWS = "source string, metric string, tick_us bigint, recent bigint, good bigint, base bigint, finite boolean, mean_recent double, mean_base double, sd_recent double, sd_base double, last_good_us bigint, cadence_us bigint"


class Grid:
    """Panes between the bounds that the windows of a grid of ticks have, and panes of the bounds themselves.

    A pane's number is how many bounds are before it and how many are not after it, so it rises with time and
    all readings of a pane are in the same windows, whatever the steps and widths are.
    """

    def __init__(self, config: ValidatorConfig, start_us: int, end_us: int, step_us: int):
        self.start, self.step, self.ticks = start_us, step_us, max(0, (end_us - start_us) // step_us + 1)
        self.origins = [start_us - w for w in (config.baseline_window, config.recent_window, 0)]

    def column(self, ts: Column) -> Column:
        def clamped(x: Column) -> Column:
            return F.least(F.greatest(x, F.lit(0)), F.lit(self.ticks))

        parts = []
        for a in self.origins:
            past = F.pmod(ts - a, F.lit(self.step))
            whole = ((ts - a - past) / self.step).cast("bigint")
            parts += [clamped(whole + 1), clamped(F.when(past == 0, whole).otherwise(whole + 1))]
        return reduce(lambda x, y: x + y, parts)

    def number(self, ts: np.ndarray) -> np.ndarray:
        out = np.zeros(len(ts), np.int64)
        for a in self.origins:
            whole, past = np.divmod(ts - a, self.step)
            out += np.clip(whole + 1, 0, self.ticks) + np.clip(whole + (past > 0), 0, self.ticks)
        return out


class Fixed:
    """Panes of one width, and panes of the instants between them: for panes that are kept and added to."""

    def __init__(self, width_us: int):
        self.width = width_us

    def column(self, ts: Column) -> Column:
        past = F.pmod(ts, F.lit(self.width))
        return ((ts - past) / self.width * 2 + F.when(past > 0, 1).otherwise(0)).cast("bigint")

    def number(self, ts: np.ndarray) -> np.ndarray:
        whole, past = np.divmod(ts, self.width)
        return 2 * whole + (past > 0)


def moment_panes(validated: DataFrame, pane: Column) -> DataFrame:
    """Panes of full-policy streams.  NaN and infinite good values are counted (``odd``) and left out of the moments."""
    v, good = F.col("value"), F.col("quality") == rules.GOOD
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    use = F.when(good & finite, v)
    return validated.where(F.col("policy") == FULL).groupBy(*STREAM, pane.alias("pane")).agg(
        F.count("*").alias("n"), F.count_if(good).alias("good"), F.count_if(good & ~finite).alias("odd"),
        F.coalesce(F.avg(use), F.lit(0.0)).alias("mean"), F.coalesce(F.var_pop(use) * F.count(use), F.lit(0.0)).alias("m2"),
        F.max(F.when(good, F.col("ts_us"))).alias("good_us"), F.min("ts_us").alias("first_us"), F.max("cfg.cadence").alias("cadence_us"),
    )


def merge_panes(panes: DataFrame) -> DataFrame:
    """One row for each stream and pane of a table in which they repeat, as after several batches."""

    def together(a: Column, b: Column) -> Column:
        n, m = a["n"], b["n"]
        total, apart = n + m, b["mean"] - a["mean"]
        return F.struct(
            total.alias("n"),
            F.when(n == 0, b["mean"]).when(m == 0, a["mean"]).otherwise(a["mean"] + apart * m / total).alias("mean"),
            F.when(n == 0, b["m2"]).when(m == 0, a["m2"]).otherwise(a["m2"] + b["m2"] + apart * apart * n * m / total).alias("m2"),
        )

    held = (F.col("good") - F.col("odd")).cast("double")
    parts = F.sort_array(F.collect_list(F.struct(F.col("first_us"), held.alias("n"), "mean", "m2")))
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    merged = panes.groupBy(*STREAM, "pane").agg(
        F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("odd").alias("odd"), F.aggregate(parts, zero, together).alias("moments"),
        F.max("good_us").alias("good_us"), F.min("first_us").alias("first_us"), F.max("cadence_us").alias("cadence_us"),
    )
    return merged.select(*STREAM, "pane", "n", "good", "odd", "moments.mean", "moments.m2", "good_us", "first_us", "cadence_us")


def trim_panes(panes: DataFrame, config: ValidatorConfig, now_us: int, width_us: int) -> DataFrame:
    """Panes that no baseline window from ``now_us`` on reaches are let go."""
    return panes.where(F.col("pane") >= int(Fixed(width_us).number(np.array([now_us - config.baseline_window]))[0]))


def merged(n1, mean1, square1, n2, mean2, square2):
    """Count, mean and m2 of two parts together; a part of no reading changes nothing."""
    n = n1 + n2
    with np.errstate(invalid="ignore", divide="ignore"):
        apart = mean2 - mean1
        mean = np.where(n1 == 0, mean2, np.where(n2 == 0, mean1, mean1 + apart * n2 / n))
        square = np.where(n1 == 0, square2, np.where(n2 == 0, square1, square1 + square2 + apart * apart * (n1 * n2 / n)))
    return n, mean, square


def range_moments(n: np.ndarray, mean: np.ndarray, square: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merged moments of the panes lo .. hi - 1 of each window: parts of 1, 2, 4, ... panes, as the length's binary digits say."""
    total, mid, about = np.zeros(len(lo)), np.zeros(len(lo)), np.zeros(len(lo))
    at, length = lo.copy(), hi - lo
    k = 0
    while len(n) and (length >> k).any():
        use = np.flatnonzero(length >> k & 1)
        p = at[use]
        total[use], mid[use], about[use] = merged(total[use], mid[use], about[use], n[p], mean[p], square[p])
        at[use] += 1 << k
        half = 1 << k
        n, mean, square = merged(n[:-half], mean[:-half], square[:-half], n[half:], mean[half:], square[half:])
        k += 1
    return total, mid, about


def pane_windows(panes: DataFrame, config: ValidatorConfig, cut: Grid | Fixed, ticks: Callable[[int], np.ndarray]) -> DataFrame:
    """``WINDOWS`` of each stream at the ticks that ``ticks(first_us)`` gives; panes as ``cut`` numbers them, none twice.

    A stream's panes come together in one task: as many as the baseline window and the ticks have, however
    many readings it has.
    """

    def windows(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("pane")
        pane, t = frame["pane"].to_numpy(), ticks(int(frame["first_us"].min()))
        hi = np.searchsorted(pane, cut.number(t), side="right")
        sums = {c: np.concatenate([[0], np.cumsum(frame[c].to_numpy())]) for c in ("n", "good", "odd")}
        held = (frame["good"] - frame["odd"]).to_numpy().astype(float)
        mean, square = frame["mean"].to_numpy(float), frame["m2"].to_numpy(float)
        last = np.concatenate([[-1], np.maximum.accumulate(frame["good_us"].fillna(-1).to_numpy().astype(np.int64))])[hi]
        out = {"source": frame["source"].iloc[0], "metric": frame["metric"].iloc[0], "tick_us": t}
        for name, width in (("recent", config.recent_window), ("base", config.baseline_window)):
            lo = np.minimum(np.searchsorted(pane, cut.number(t - width), side="left"), hi)
            n, mid, about = range_moments(held, mean, square, lo, hi)
            about = np.where(about <= 1e-26 * n * mid * mid, 0.0, about)  # what rounding leaves of equal values
            out[f"mean_{name}"] = np.where(n > 0, mid, np.nan)
            out[f"sd_{name}"] = np.where(n > 1, np.sqrt(about / np.maximum(n - 1, 1)), 0.0)
            if name == "recent":
                out["recent"], out["good"] = sums["n"][hi] - sums["n"][lo], sums["good"][hi] - sums["good"][lo]
            else:
                out["base"], out["finite"] = sums["good"][hi] - sums["good"][lo], sums["odd"][hi] == sums["odd"][lo]
        frame_out = pd.DataFrame(out)
        frame_out["last_good_us"] = pd.array(np.where(last >= t - config.recent_window, last, -1), dtype="Int64")
        frame_out.loc[frame_out["last_good_us"] < t - config.recent_window, "last_good_us"] = pd.NA
        cadence = frame["cadence_us"].dropna()
        frame_out["cadence_us"] = pd.array([int(cadence.iloc[0]) if len(cadence) else pd.NA] * len(t), dtype="Int64")
        return frame_out[[c.split()[0] for c in WINDOWS.split(", ")]]

    out = panes.groupBy(*STREAM).applyInPandas(windows, WINDOWS)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("mean_recent", "mean_base")})
