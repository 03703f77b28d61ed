"""CSV files of readings (S1-S11), and the offline report over one."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from streamcheck.config import SECOND, ValidatorConfig, csv_run_config
from streamcheck.functions import parsing
from streamcheck.operators.health import score_at_last
from streamcheck.operators.quarantine import quarantine_history
from streamcheck.operators.report import flagged_readings, metric_report
from streamcheck.operators.tier1 import validated_table

# Header names of each role, in the order in which roles are tried.
ALIASES = {
    "timestamp": ("timestamp", "time", "datetime", "date", "ts"),
    "source": ("source", "sensor", "device", "node", "id"),
    "raw": ("raw", "raw_value", "adc"),
    "value": ("value", "reading", "measurement", "data"),
}


@dataclass
class Roles:
    timestamp: str | None = None
    source: str | None = None
    raw: str | None = None
    values: dict[str, str] = field(default_factory=dict)  # column: metric


#: Where a row stands: its file, the byte its split begins at, and an id that rises within the split.
PLACE = ("__file", "__split", "__at")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, headers trimmed; short rows are filled with nulls, blank lines are no
    rows; quotes as in RFC 4180.

    Files are split over tasks unless some quoted cell holds a line feed, which a pass over the
    lines finds (a line with an odd number of quotes).  Adds the columns of ``PLACE``.
    """
    odd = (F.length("value") - F.length(F.replace("value", F.lit('"')))) % 2 == 1
    feeds = not spark.read.text(path).where(odd).isEmpty()
    df = spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE", escape='"', multiLine=feeds, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    if not df.columns:
        raise ValueError("no header")
    names = [c.strip().removeprefix("\ufeff").strip() for c in df.columns]
    df = df.select("*", F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()).toDF(*names, *PLACE)
    if df.isEmpty():
        raise ValueError("no data rows")
    return df


def detect_roles(df: DataFrame) -> Roles:
    """Roles by header; other columns hold values if every cell that is not blank is a number, and one is.

    The first column of a role other than value has it; every column with a value's name is a
    value column, under that name in lower case.  All other candidates are examined over all rows
    in one aggregation.  Value columns keep the header's order.
    """
    roles, named, rest = Roles(), {}, []
    columns = [c for c in df.columns if c not in PLACE]
    for c in columns:
        name = c.lower()
        role = next((r for r, names in ALIASES.items() if name in names), None)
        if role == "value":
            named[c] = name
        elif role is None:
            rest.append(c)
        elif getattr(roles, role) is None:
            setattr(roles, role, c)
    if rest:
        def cell(c: str) -> Column:
            return F.col(f"`{c}`")

        counts = df.agg(*[x for i, c in enumerate(rest) for x in (
            F.count_if(parsing.number(cell(c)).isNotNull()).alias(f"n{i}"),
            F.count_if((F.trim(cell(c)) != "") & parsing.number(cell(c)).isNull()).alias(f"bad{i}"),
        )]).first()
        named |= {c: c for i, c in enumerate(rest) if counts[f"n{i}"] > 0 and counts[f"bad{i}"] == 0}
    roles.values = {c: named[c] for c in columns if c in named}
    return roles


def choose_metrics(roles: Roles, metric: str | None) -> dict[str, str]:
    """The first column of the named metric; if there is none of that name, the first value column under that name; else all."""
    if not roles.values:
        raise ValueError("no numeric value columns")
    if metric is None:
        return roles.values
    named = [(c, m) for c, m in roles.values.items() if m.lower() == metric.lower()]
    return dict(named[:1]) or {next(iter(roles.values)): metric}


def with_row_index(df: DataFrame) -> DataFrame:
    """``seq``, the dense place of each row, files by path and each from its start.

    Rows are counted by split; the number of rows before each split (one row per split) is
    broadcast.  No row passes through Python, and no window gathers them.
    """
    splits = df.groupBy("__file", "__split").agg(F.count("*").alias("n"), F.min("__at").alias("first")).toArrow().sort_by([("__file", "ascending"), ("__split", "ascending")])
    n = splits["n"].to_numpy()
    table = pa.table({"__file": splits["__file"], "__split": splits["__split"], "__before": pa.array(n.cumsum() - n - splits["first"].to_numpy())})
    return df.join(F.broadcast(df.sparkSession.createDataFrame(table)), ["__file", "__split"]).withColumn("seq", F.col("__at") + F.col("__before")).drop(*PLACE, "__before")


def build_readings(df: DataFrame, roles: Roles, metrics: dict[str, str], default_source: str = "default", start_us: int = 0, cadence_us: int = 60 * SECOND, strict: bool = True) -> DataFrame:
    """(source, metric, value, ts_us, raw_value, seq, skipped), a row per cell.

    A blank or non-numeric cell has ``skipped`` true and no value.  Where there is no time
    column, row i is at ``start_us`` + i cadences; where there is one, ``seq`` only orders equal times.  A time that cannot be read fails the job, or
    with ``strict`` false leaves ``ts_us`` null for the caller to quarantine.
    """
    indexed = with_row_index(df) if roles.timestamp is None else df.withColumn("seq", F.col(PLACE[2]))

    def cell(c: str | None) -> Column:
        return F.col(f"`{c}`") if c else F.lit(None).cast("string")

    source = F.coalesce(F.nullif(F.trim(cell(roles.source)), F.lit("")), F.lit(default_source))
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), cell(c).alias("cell")) for c, m in metrics.items()])
    long = indexed.select("seq", source.alias("source"), parsing.whole_number(cell(roles.raw)).alias("raw_value"), cell(roles.timestamp).alias("_time"), F.explode(cells).alias("_c"))
    long = long.select("source", "_c.metric", parsing.number(F.col("_c.cell")).alias("value"), "_time", "raw_value", "seq")
    ts = parsing.timestamp_micros(F.col("_time")) if roles.timestamp else F.lit(start_us) + F.col("seq") * cadence_us
    if strict and roles.timestamp:
        ts = F.when(F.col("value").isNull() | ts.isNotNull(), ts).otherwise(F.raise_error(F.concat(F.lit("cannot read time: "), F.coalesce("_time", F.lit("")))).cast("bigint"))
    return long.withColumns({"ts_us": ts, "skipped": F.col("value").isNull()}).drop("_time")


def csv_report(spark: SparkSession, path: str, metric: str | None = None, config: ValidatorConfig | None = None, **run: float) -> tuple[DataFrame, DataFrame]:
    """(one report row per metric, the flagged readings)."""
    df = read_csv(spark, path)
    roles = detect_roles(df)
    chosen = choose_metrics(roles, metric)
    cadence = int(run.pop("cadence", 60 * SECOND))
    readings = build_readings(df, roles, chosen, cadence_us=cadence)
    skipped = readings.groupBy("metric").agg(F.count_if("skipped").alias("skipped_rows"))
    if config is None:
        made = [csv_run_config(m, cadence, **run) for m in chosen.values()]
        config = ValidatorConfig(metrics={k: v for c in made for k, v in c.metrics.items()})
    validated = validated_table(readings.where("not skipped").drop("skipped"), config)
    scores = score_at_last(validated, config)
    quarantine = quarantine_history(scores, config, "computed_us")
    return metric_report(validated, scores, quarantine, skipped), flagged_readings(validated)
