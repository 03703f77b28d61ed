"""Exact deduplication with a heavy-hitter split.

One pass over the texts leaves a narrow table of digests.  A Misra-Gries summary of each
partition finds every digest that may hold ``1 / heavy`` of all rows; the few candidates are
counted exactly and checked, then broadcast, so that their rows are resolved where they
stand.  All other digests take one ordinary shuffle in which no group is large.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamcheck.llm.shared import Scratch

HEAVY = 1024


class MisraGries:
    """Frequency summary with ``size`` counters; each count is low by at most n / (size + 1)."""

    def __init__(self, size: int):
        self.size, self.counts, self.n = size, {}, 0

    def add(self, values: pa.Array) -> None:
        self.n += len(values)
        seen = values.value_counts()
        counts = self.counts
        for v, c in zip(seen.field("values").to_pylist(), seen.field("counts").to_pylist(), strict=True):
            counts[v] = counts.get(v, 0) + c
        if len(counts) > self.size:
            low = sorted(counts.values(), reverse=True)[self.size]
            self.counts = {v: c - low for v, c in counts.items() if c > low}


def frequent(df: DataFrame, column: str, heavy: int = HEAVY) -> DataFrame:
    """Values that may hold 1/heavy of the rows (all that do are there): at most 4/3 heavy of them.

    Counters are 4 x heavy a partition, so a summed count is low by less than n / (4 heavy).
    """
    kind = df.schema[column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = MisraGries(4 * heavy)
        for batch in batches:
            summary.add(batch.column(0))
        found = [(v, c, 0) for v, c in summary.counts.items()] + [(None, 0, summary.n)]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], df_type), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found], pa.int64())], names=[column, "low", "n"])

    df_type = pa.binary() if kind == "binary" else pa.string() if kind == "string" else pa.int64()
    sums = df.select(column).mapInArrow(run, f"{column} {kind}, low bigint, n bigint").groupBy(column).agg(F.sum("low").alias("low"), F.sum("n").alias("n"))
    total = sums.select(F.sum("n").alias("total")).where("total is not null")
    least = F.greatest(F.lit(2), F.ceil(F.col("total") * 0.75 / heavy))
    return sums.where(F.col(column).isNotNull()).crossJoin(F.broadcast(total)).where(F.col("low") >= least).select(column)


def digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, digest, check, row): one narrow row per document; ``row`` is unique."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"),
        F.unhex(F.sha2(text, 256)).alias("digest"),
        F.xxhash64(text, F.octet_length(text)).alias("check"),
        F.monotonically_increasing_id().alias("row"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", heavy: int = HEAVY) -> DataFrame:
    """Group rows of identical text; of each group the row with the largest id stays.

    Returns one row per input row: ``id_col``, ``keep_id``, ``group_size``, ``kept``,
    ``text_sha256``.  Null text counts as empty.  A null id is smaller than any other; of
    rows that repeat id and text one stays.  Other columns are not read; no rows, no result.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows = scratch.write(digests(docs, id_col, text_col), "digests")
    best = F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "row"))
    counted = rows.join(F.broadcast(frequent(rows, "digest", heavy)), "digest").groupBy("digest").agg(best.alias("best"), F.count("*").alias("size"), F.min("check").alias("low"), F.max("check").alias("high"))
    winners = scratch.write(counted.where("low = high").select("digest", "best", "size").coalesce(1), "winners")
    frequent_rows = rows.join(F.broadcast(winners), "digest")
    same = Window.partitionBy("digest")
    other_rows = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti").withColumns({"best": best.over(same), "size": F.count("*").over(same)})
    columns = ["id", "digest", "row", "best", "size"]
    return frequent_rows.select(*columns).unionByName(other_rows.select(*columns)).select(
        F.col("id").alias(id_col),
        F.col("best.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
