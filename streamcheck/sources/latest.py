"""The latest reading of every stream as a table that batches keep up to date (A1, A2)."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamcheck.operators.anchor import STREAM

LATEST = "source string, metric string, seq bigint, value double, ts_us bigint, quality string"


class LatestTable:
    """A snapshot in buckets of streams; a batch rewrites the buckets that it touches and no other.

    Versions are folders; the newest manifest in ``_versions`` names for each bucket the version that holds it.
    A batch is named by its epoch: one that runs again after its manifest changes nothing, and one
    whose writer died before it is not seen.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.at = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _versions(self) -> list[int]:
        folder = self.at(f"{self.path}/_versions")
        return sorted(int(f.getPath().getName()) for f in self.fs.listStatus(folder)) if self.fs.exists(folder) else []

    def manifest(self) -> dict[int, int]:
        """The version of each bucket that has rows."""
        found = self._versions()
        if not found:
            return {}
        stream = self.fs.open(self.at(f"{self.path}/_versions/{found[-1]}"))
        try:
            return {int(k): v for k, v in json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")).items()}
        finally:
            stream.close()

    def _read(self, cells: dict[int, int]) -> DataFrame:
        if not cells:
            return self.spark.createDataFrame([], LATEST)
        return self.spark.read.schema(LATEST).parquet(*(f"{self.path}/version={v}/bucket={b}" for b, v in sorted(cells.items())))

    def read(self) -> DataFrame:
        return self._read(self.manifest())

    def stream(self, source: str, metric: str) -> DataFrame:
        """A2: one stream's latest reading, from its bucket alone."""
        key = self.spark.createDataFrame([(source, metric)], "source string, metric string")
        bucket = key.select(F.pmod(F.xxhash64(*STREAM), F.lit(self.buckets))).first()[0]
        cells = self.manifest()
        return self._read({bucket: cells[bucket]} if bucket in cells else {}).where((F.col("source") == source) & (F.col("metric") == metric))

    def update(self, batch: DataFrame, epoch: int) -> None:
        """Take in a batch of readings (source, metric, seq, value, ts_us, quality); of each stream the highest seq stays."""
        if epoch in self._versions():
            return
        fields = ("seq", "value", "ts_us", "quality")

        def newest(df: DataFrame) -> DataFrame:
            return df.groupBy(*STREAM).agg(F.max_by(F.struct(*fields), "seq").alias("r")).select(*STREAM, "r.*")

        bucket = F.pmod(F.xxhash64(*STREAM), F.lit(self.buckets)).alias("bucket")
        come = newest(batch.select(*STREAM, *fields)).persist()
        cells = self.manifest()
        touched = [r[0] for r in come.select(bucket).distinct().collect()]  # at most the number of buckets
        held = self._read({b: cells[b] for b in touched if b in cells})
        rows = newest(held.unionByName(come)).withColumn("bucket", bucket)
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={epoch}")
        come.unpersist()
        out = self.fs.create(self.at(f"{self.path}/_versions/{epoch}"), True)
        out.write(bytearray(json.dumps(cells | dict.fromkeys(touched, epoch)).encode()))
        out.close()
