"""Tables of readings and sessions, and JSON reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamcheck.functions import rules
from streamcheck.operators.anchor import STREAM
from streamcheck.storage import CommittedTable


#: Columns of stored readings: files written before one was added have it null.
READINGS = "zone_id string, metric string, value double, ts_us bigint, raw_adc bigint, seq bigint, quality string, validation_reason string, zone string, day date"


def stored_columns(validated: DataFrame) -> DataFrame:
    """A row for every reading, whatever its verdict; a reason only where it is not good."""
    zone, zone_id = rules.split_source(F.col("source"))
    return validated.select(
        zone.alias("zone"), zone_id.alias("zone_id"), "metric", "value", "ts_us", F.col("raw_value").alias("raw_adc"), "seq", "quality",
        F.when(F.col("quality") != rules.GOOD, F.col("reason")).alias("validation_reason"),
        F.date_from_unix_date(F.floor(F.col("ts_us") / 86_400_000_000).cast("int")).alias("day"),
    )


def append_readings(validated: DataFrame, path: str) -> None:
    """Append readings to a plain table by zone and day; a call that runs again appends again."""
    stored_columns(validated).write.mode("append").partitionBy("zone", "day").parquet(path)


def store_batch(validated: DataFrame, path: str, unit: str) -> bool:
    """Store a batch's readings as a unit of a table of units, by zone and day: once, however often it runs."""
    return CommittedTable(validated.sparkSession, path).write(stored_columns(validated), unit, "zone", "day")


def compact_readings(spark: SparkSession, path: str) -> None:
    """Put the units of many batches into one; readers see the same rows before, meanwhile and after."""
    CommittedTable(spark, path).compact(READINGS, "zone", "day")


def lay_out(readings: DataFrame, name: str, path: str, buckets: int = 256) -> None:
    """Append readings (source, metric, ts_us, seq, ...) to the table ``name`` at ``path``, in buckets of streams.

    A bucket's rows are sorted by stream and time, one file for each bucket and call.  What goes by stream (validation,
    scores, latest readings) reads the table without a shuffle, and a stream's history skips row groups.
    ``buckets`` holds from the first call on; take as many as tasks that shall work side by side, and enough for
    buckets of at most ``chunk_rows`` readings: validation shuffles larger ones.
    """
    dealt = readings.repartition(buckets, *STREAM)
    dealt.write.format("parquet").bucketBy(buckets, *STREAM).sortBy(*STREAM, "ts_us", "seq").mode("append").option("path", path).saveAsTable(name)


def compact_layout(spark: SparkSession, name: str, path: str) -> None:
    """Write a laid-out table anew at ``path``, one file for each bucket, and turn the table's name to it; the old files stay for those who read them."""
    spec = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
    staged = f"{name}_compacted"
    # Read as plain files: over the table itself the planner leaves out the shuffle by buckets, and then the buckets too.
    lay_out(spark.read.schema(spark.table(name).schema).parquet(spec["Location"]), staged, path, int(spec["Num Buckets"]))
    spark.sql(f"ALTER TABLE {name} SET LOCATION '{path}'")
    spark.sql(f"DROP TABLE {staged}")  # the name alone: its files have a path of their own
    spark.catalog.refreshTable(name)


def append_sessions(sessions: DataFrame, path: str) -> None:
    """S18."""
    sessions.write.mode("append").parquet(path)


def read_readings(spark: SparkSession, path: str) -> DataFrame:
    """Readings of files old and new, of committed units where the table has such; a missing verdict is good.

    The columns are stated, so no footer is read to find them; those that older files lack are null.
    """
    units = CommittedTable(spark, path)
    df = units.read(READINGS) if units.exists() else spark.read.schema(READINGS).parquet(path)
    return df.withColumns({"quality": F.coalesce("quality", F.lit(rules.GOOD)), "source": F.concat_ws("/", "zone", "zone_id")})


def report_json(report: DataFrame) -> DataFrame:
    """One JSON object per report row."""
    return report.select(F.to_json(F.struct(*report.columns)).alias("json"))
