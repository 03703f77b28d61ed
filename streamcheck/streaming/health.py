"""Health and quarantine at every tick, of silent streams too.

Ticks come in micro-batches of a stream that goes on by itself (the ``rate`` source): at each all
known streams are scored, those that have sent nothing included, and the quarantine machine moves
one step from the table of the ticks before.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamcheck.config import SECOND, ValidatorConfig
from streamcheck.operators.anchor import STREAM
from streamcheck.operators.health import score_health, scores_from_panes
from streamcheck.operators.panes import PANE, Fixed, moment_panes, trim_panes
from streamcheck.operators.tier1 import resolve_config
from streamcheck.sources.store import read_readings
from streamcheck.storage import CommittedTable

MACHINE = "source string, metric string, is_quarantined boolean, quarantined_us bigint, consecutive_bad bigint, consecutive_recovery bigint"
#: What a stream without a reading in the recent window scores: nothing for rate, cadence and recency, all for drift and variance.
SILENT = {"overall": 30.0, "quality_rate": 0.0, "reporting_cadence": 0.0, "drift": 1.0, "variance_ratio": 1.0, "recency": 0.0}


def quarantine_step(before: DataFrame, scores: DataFrame, config: ValidatorConfig, tick_us: int) -> DataFrame:
    """Q1-Q4 for one tick: ``before`` is the machine's table (``MACHINE``), scores have one row per stream.

    A stream that ``before`` does not know starts active.  One join by stream.
    """
    n, score = max(1, config.consecutive), F.col("overall")
    bad = (score < config.bad_threshold) & ~F.isnan(score)
    fine = (score >= config.recovery_threshold) & ~F.isnan(score)
    old = before.select(*STREAM, *(F.col(c).alias(f"_{c}") for c in ("is_quarantined", "quarantined_us", "consecutive_bad", "consecutive_recovery")))
    both = scores.join(old, list(STREAM), "left").withColumns({
        "_was": F.coalesce("_is_quarantined", F.lit(False)),
        "_run": F.when(F.coalesce("_is_quarantined", F.lit(False)), F.when(fine, F.coalesce("_consecutive_recovery", F.lit(0)) + 1).otherwise(0)).otherwise(F.when(bad, F.coalesce("_consecutive_bad", F.lit(0)) + 1).otherwise(0)),
    })
    entered, left = ~F.col("_was") & (F.col("_run") >= n), F.col("_was") & (F.col("_run") >= n)
    now = F.when(entered, True).when(left, False).otherwise(F.col("_was"))
    held = F.when(fine, 0).otherwise(F.coalesce("_consecutive_bad", F.lit(0)))
    return both.withColumns({
        "is_quarantined": now,
        "quarantined_us": F.when(entered, F.lit(tick_us)).when(now, F.col("_quarantined_us")),
        "consecutive_bad": F.when(left, 0).when(F.col("_was"), held).otherwise(F.col("_run")).cast("bigint"),
        "consecutive_recovery": F.when(F.col("_was") & ~left, F.col("_run")).otherwise(0).cast("bigint"),
        "transition": F.when(entered, "entered").when(left, "recovered").otherwise("unchanged"),
        "quarantine_reason": F.when(now, F.lit(f"Health score below {int(config.bad_threshold)} for {config.check_interval * config.consecutive // SECOND}+ seconds")),
    }).drop("_was", "_run", "_is_quarantined", "_quarantined_us", "_consecutive_bad", "_consecutive_recovery")


def rescore(readings: DataFrame, known: DataFrame, config: ValidatorConfig, now_us: int) -> DataFrame:
    """H10 at ``now_us`` for each full-policy stream of ``readings`` up to then or of ``known`` (source, metric), silent ones too."""
    window = readings.where((F.col("ts_us") <= now_us) & (F.col("ts_us") >= now_us - config.baseline_window))
    scores = score_health(resolve_config(window, config), config, F.lit(now_us).cast("bigint")).drop("computed_us")
    silent = known.select(*STREAM).join(scores.select(*STREAM), list(STREAM), "left_anti")
    silent = silent.select(*STREAM, *(F.lit(v).alias(c) for c, v in SILENT.items()), F.lit(0).cast("bigint").alias("readings_in_window"), F.lit(None).cast("bigint").alias("last_good_us"))
    return scores.unionByName(silent)


def quarantine_ticks(before: DataFrame, scores: DataFrame, config: ValidatorConfig) -> DataFrame:
    """Q1-Q4 over several ticks: ``scores`` has a row for each stream and tick, ``before`` is the machine before the first.

    A stream's few ticks are gone through in order; the last one's row is the machine after them.
    """
    n = max(1, config.consecutive)
    sentence = f"Health score below {int(config.bad_threshold)} for {config.check_interval // SECOND * config.consecutive}+ seconds"
    old = before.select(*STREAM, *(F.col(c).alias(f"_{c}") for c in ("is_quarantined", "quarantined_us", "consecutive_bad", "consecutive_recovery")))
    both, columns = scores.join(old, list(STREAM), "left"), scores.columns

    def steps(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("tick_us", ignore_index=True)
        was = frame.iloc[0]
        inside = bool(was["_is_quarantined"]) if not pd.isna(was["_is_quarantined"]) else False
        since, bad, fine = (None if pd.isna(was[c]) else int(was[c]) for c in ("_quarantined_us", "_consecutive_bad", "_consecutive_recovery"))
        bad, fine, out = bad or 0, fine or 0, []
        for tick, score in zip(frame["tick_us"], frame["overall"], strict=True):
            change = "unchanged"
            if not inside:
                bad, fine = (bad + 1, 0) if score < config.bad_threshold else (0, fine)
                if bad >= n:
                    inside, since, change = True, int(tick), "entered"
            else:
                fine, bad = (fine + 1, 0) if score >= config.recovery_threshold else (0, bad)
                if fine >= n:
                    inside, since, bad, fine, change = False, None, 0, 0, "recovered"
            out.append((inside, since, bad, fine, change, sentence if inside else None))
        told = pd.DataFrame(out, columns=["is_quarantined", "quarantined_us", "consecutive_bad", "consecutive_recovery", "transition", "quarantine_reason"])
        told["quarantined_us"] = told["quarantined_us"].astype("Int64")
        return pd.concat([frame[columns], told], axis=1)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in scores.schema)
    return both.groupBy(*STREAM).applyInPandas(steps, f"{kinds}, is_quarantined boolean, quarantined_us bigint, consecutive_bad bigint, consecutive_recovery bigint, transition string, quarantine_reason string")


def scored_ticks(kept: DataFrame, known: DataFrame, config: ValidatorConfig, width_us: int, ticks: list[int]) -> DataFrame:
    """A score for each tick and each stream that has a pane by then or is ``known`` from before, silent ones too."""
    scores = scores_from_panes(kept, config, width_us, ticks)
    every = known.select(*STREAM).withColumn("tick_us", F.explode(F.lit(ticks).cast("array<bigint>")))
    silent = every.join(scores.select(*STREAM, "tick_us"), [*STREAM, "tick_us"], "left_anti")
    silent = silent.select(*STREAM, "tick_us", *(F.lit(v).alias(c) for c, v in SILENT.items()), F.lit(0).cast("bigint").alias("readings_in_window"), F.lit(None).cast("bigint").alias("last_good_us"))
    return scores.unionByName(silent)


def tick_batches(readings_path: str, state_path: str, config: ValidatorConfig, panes_path: str | None = None, keep: int | None = None) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function over a stream of ticks with a ``tick_us`` column: scores and states at every tick.

    A batch of several ticks, as after a delay or a restart, steps the machine once for each.  It writes
    the table ``state_path/epoch=<n>`` and reads that of the last batch before it that had ticks, so one
    that runs again gives the same table; a batch without ticks writes nothing.  With ``keep`` only that many
    tables stay.  Scores come from the moments kept at ``panes_path`` by the sink of readings (ticks must
    then be multiples of the check interval), else from the stored readings of the baseline window.
    """

    def tick(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        ticks = sorted(r[0] for r in batch.select("tick_us").where("tick_us is not null").distinct().collect())
        if not ticks:
            return
        before = machine_before(spark, state_path, epoch)
        since = ticks[0] - config.baseline_window
        if panes_path is None:
            width = math.gcd(*ticks, config.recent_window, config.baseline_window)
            first_day = F.date_from_unix_date(F.floor(F.lit(since) / 86_400_000_000).cast("int"))
            readings = read_readings(spark, readings_path).where((F.col("day") >= first_day) & (F.col("ts_us") >= since) & (F.col("ts_us") <= ticks[-1]))
            kept = moment_panes(resolve_config(readings, config), Fixed(width).column(F.col("ts_us")))
        else:
            width = config.check_interval
            kept = trim_panes(CommittedTable(spark, panes_path).read(PANE), config, ticks[0], width)
        scores = scored_ticks(kept, before, config, width, ticks)
        quarantine_ticks(before, scores, config).write.mode("overwrite").parquet(f"{state_path}/epoch={epoch}")
        if keep is not None:
            fs, path = _folder(spark, state_path)
            for old in _epochs(spark, state_path, epoch)[: max(0, len(_epochs(spark, state_path, epoch)) - keep + 1)]:
                fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/epoch={old}"), True)

    return tick


def _folder(spark: SparkSession, path: str):  # noqa: ANN202
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), path.rstrip("/")


def _epochs(spark: SparkSession, state_path: str, before: int) -> list[int]:
    """The finished epochs under ``before`` that have a table."""
    fs, path = _folder(spark, state_path)
    at = spark._jvm.org.apache.hadoop.fs.Path
    if not fs.exists(at(path)):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at(path))]
    found = sorted(int(x[6:]) for x in names if x.startswith("epoch="))
    return [e for e in found if e < before and fs.exists(at(f"{path}/epoch={e}/_SUCCESS"))]


def machine_before(spark: SparkSession, state_path: str, epoch: int) -> DataFrame:
    """The machine after the last ticks before ``epoch``; empty before the first."""
    found = _epochs(spark, state_path, epoch)
    if not found:
        return spark.createDataFrame([], MACHINE)
    names = [c.split()[0] for c in MACHINE.split(", ")]
    table = spark.read.parquet(f"{state_path}/epoch={found[-1]}")
    last = table.groupBy(*STREAM).agg(F.max_by(F.struct(*names[2:]), "tick_us").alias("m"))
    return last.select(*STREAM, "m.*")


def tick_stream(spark: SparkSession, interval_s: int = 30) -> DataFrame:
    """Ticks that come whether readings do or not: multiples of ``interval_s`` seconds.

    The clock's seconds go on from the checkpoint after a stop, so ticks that were missed come too.
    """
    seconds = spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(F.unix_seconds("timestamp").alias("s"))
    return seconds.where(F.col("s") % interval_s == 0).select((F.col("s") * SECOND).alias("tick_us"))
