"""Reading tables, tables of a run in the shared folder, and names for helper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from streamcheck.storage import Scratch, shared_root

__all__ = ["Scratch", "free_names", "shared_root", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as make them no column of ``df`` in any case."""
    taken, lead = {c.lower() for c in df.columns}, "__"
    while any((lead + n).lower() in taken for n in names):
        lead += "_"
    return [lead + n for n in names]
