"""Joins in time: raw side channels, session logs, ranges of age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RAW_AGE_US = 30_000_000
PAIR_US = 3_600_000_000


def with_halo(df: DataFrame, width_us: int, before_us: int) -> DataFrame:
    """The rows with ``_cell``, their piece of ``width_us`` of time, and again (``_halo``) those of the last ``before_us`` of a piece, in the next piece.

    ``before_us`` must not be over ``width_us``.  Nothing is shuffled; rows without a time have no cell and no copy.
    """
    cell = F.floor(F.col("ts_us") / width_us)
    near_end = F.col("ts_us") - cell * width_us >= width_us - before_us
    places = F.when(near_end, F.array(F.struct(cell.alias("c"), F.lit(False).alias("h")), F.struct((cell + 1).alias("c"), F.lit(True).alias("h"))))
    return df.withColumn("_p", F.explode(F.coalesce(places, F.array(F.struct(cell.alias("c"), F.lit(False).alias("h")))))).withColumns({"_cell": F.col("_p.c"), "_halo": F.col("_p.h")}).drop("_p")


def raw_pairing(readings: DataFrame, value_metric: str = "moisture", raw_metric: str = "moisture_raw", limit_us: int = RAW_AGE_US, width_us: int = PAIR_US) -> DataFrame:
    """Each ``value_metric`` reading takes the raw count that came directly before it, if under ``limit_us`` old.

    readings: source, metric, value, ts_us, seq, with bad payloads dropped.  A raw count is used
    once, and a newer one replaces it, so only the row directly before can match.  Ages are
    whole seconds.  Returns the value readings with ``raw_value``.

    A row over ``limit_us`` old cannot match, so a source is cut in pieces of time that each know
    the last ``limit_us`` before them: one shuffle by source and piece, and no task holds a whole source.
    """
    both = with_halo(readings.where(F.col("metric").isin(value_metric, raw_metric)), max(width_us, limit_us), limit_us)
    order = Window.partitionBy("source", "_cell").orderBy("ts_us", "seq")
    before = both.withColumns({"_m": F.lag("metric").over(order), "_v": F.lag("value").over(order), "_t": F.lag("ts_us").over(order)})
    age = F.floor((F.col("ts_us") - F.col("_t")) / 1_000_000)
    fits = (F.col("_m") == raw_metric) & (age < limit_us // 1_000_000)
    return before.where((F.col("metric") == value_metric) & ~F.col("_halo")).withColumn("raw_value", F.when(fits, F.col("_v").try_cast("bigint"))).drop("_m", "_v", "_t", "_cell", "_halo")


def own_raw(readings: DataFrame, metric: str = "raw_adc") -> DataFrame:
    """Readings of ``metric`` carry their own rounded value as raw value."""
    own = F.round("value").try_cast("bigint")
    return readings.withColumn("raw_value", F.when(F.col("metric") == metric, own).otherwise(F.col("raw_value")))


def _carried(readings: DataFrame, log: DataFrame, *keys: str) -> DataFrame:
    """The readings with ``session``: the last of the log's sessions at or before each, by ``keys``."""
    rows = readings.select(*keys, F.col("ts_us").alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("bigint").alias("_tie"), F.struct(*readings.columns).alias("_r"))
    order = Window.partitionBy(*keys).orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    held = log.unionByName(rows, allowMissingColumns=True).withColumn("session", F.last("_s", ignorenulls=True).over(order))
    return held.where("_side = 1").select("_r.*", "session")


SESSION_US = 86_400_000_000


def session_asof(readings: DataFrame, sessions: DataFrame, width_us: int = SESSION_US) -> DataFrame:
    """Each reading with the latest session of its unit that began at or before it, else nulls.

    readings: unit, ts_us, ...; sessions: unit, id, started_us, ....  Of sessions that start together the
    highest id holds.  A unit's time is cut in pieces of ``width_us``.  The pieces that have readings, one
    row each, first get the session that holds when they begin; then readings, sessions and these
    go into one table and the last session is carried forward: one shuffle of readings, by unit and
    piece, no range join, and no task holds a whole unit.
    """
    fields = [c for c in sessions.columns if c != "unit"]
    log = sessions.select("unit", F.col("started_us").alias("_t"), F.lit(0).alias("_side"), F.col("id").cast("bigint").alias("_tie"), F.struct(*fields).alias("_s"))
    cell = F.floor(F.col("ts_us") / width_us)
    pieces = readings.select("unit", cell.alias("_cell")).distinct().withColumn("ts_us", F.col("_cell") * width_us - 1)
    before = _carried(pieces, log, "unit").where("session is not null").select("unit", "_cell", F.col("ts_us").alias("_t"), F.lit(0).alias("_side"), F.lit(0).cast("bigint").alias("_tie"), F.col("session").alias("_s"))
    within = log.withColumn("_cell", F.floor(F.col("_t") / width_us))
    return _carried(readings.withColumn("_cell", cell), before.unionByName(within), "unit", "_cell").drop("_cell")


def session_intervals(sessions: DataFrame) -> DataFrame:
    """(unit, _from_us, _to_us, session): each session until its unit's next; of those that start together the highest id.

    One window over the log, which is small against the readings.
    """
    fields = [c for c in sessions.columns if c != "unit"]
    order = Window.partitionBy("unit").orderBy("started_us", F.col("id").cast("bigint"))
    until = F.coalesce(F.lead("started_us").over(order), F.lit(2**63 - 1))
    log = sessions.select("unit", F.col("started_us").alias("_from_us"), until.alias("_to_us"), F.struct(*fields).alias("session"))
    return log.where("_from_us < _to_us")


BLOCK = 256


def session_blocks(sessions: DataFrame, size: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """((unit, starts), (unit, block, log)): each unit's sessions in order of start and id, cut into arrays of ``size``, and where those begin."""
    fields = [c for c in sessions.columns if c != "unit"]
    order = Window.partitionBy("unit").orderBy("started_us", F.col("id").cast("bigint"))
    rows = sessions.where("unit is not null").select("unit", F.floor((F.row_number().over(order) - 1) / size).alias("block"), F.struct(F.col("started_us").alias("at"), F.col("id").cast("bigint").alias("tie"), F.struct(*fields).alias("session")).alias("s"))
    blocks = rows.groupBy("unit", "block").agg(F.sort_array(F.collect_list("s")).alias("log"))
    starts = blocks.select("unit", F.struct(F.col("log")[0]["at"].alias("at"), "block").alias("s")).groupBy("unit").agg(F.sort_array(F.collect_list("s")).alias("starts"))
    return starts, blocks


def not_after(items: Column, ts: Column) -> Column:
    """How many of the structs of a sorted array have ``at`` not after ``ts``: a search by halves."""
    low, high = F.lit(0), F.size(items)

    def step(s: Column, _: Column) -> Column:
        middle = F.floor((s["lo"] + s["hi"] + 1) / 2).cast("int")
        fits = F.try_element_at(items, F.greatest(middle, F.lit(1)))["at"] <= ts
        done = s["lo"] >= s["hi"]
        return F.struct(F.when(~done & fits, middle).otherwise(s["lo"]).alias("lo"), F.when(~done & ~fits, middle - 1).otherwise(s["hi"]).alias("hi"))

    rounds = F.sequence(F.lit(1), F.ceil(F.log2(F.size(items) + 1)).cast("int"))
    return F.when(items.isNull() | ts.isNull(), 0).otherwise(F.aggregate(rounds, F.struct(low.alias("lo"), high.alias("hi")), step)["lo"])


def session_lookup(readings: DataFrame, sessions: DataFrame, size: int = BLOCK) -> DataFrame:
    """As ``session_asof``, by two equi-joins with a small log and searches in sorted arrays.

    A reading meets its unit's block starts and then one block: no condition on times is left to a join, and
    a unit's many readings are not brought together.  The log may be a table while readings are a stream.
    """
    starts, blocks = session_blocks(sessions, size)
    starts, blocks = starts.withColumnRenamed("unit", "_unit"), blocks.withColumnsRenamed({"unit": "_u", "block": "_b"})
    at = readings.join(starts, F.col("unit") == F.col("_unit"), "left").withColumn("_block", not_after(F.col("starts"), F.col("ts_us")) - 1).drop("_unit", "starts")
    held = at.join(blocks, (F.col("unit") == F.col("_u")) & (F.col("_block") == F.col("_b")), "left")
    n = not_after(F.col("log"), F.col("ts_us"))
    return held.withColumn("session", F.when(n > 0, F.try_element_at("log", F.greatest(n, F.lit(1)))["session"])).drop("_u", "_b", "_block", "log")


def in_session(readings: DataFrame, sessions: DataFrame) -> DataFrame:
    """Readings that fall into a session."""
    return session_asof(readings, sessions).where(F.col("session").isNotNull())
