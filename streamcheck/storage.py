"""Tables in the folder that driver and executors share: they cut lineage, and let several results read one computation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset, a temporary folder serves a ``local`` master only; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    root = tempfile.mkdtemp(prefix="streamcheck-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Parquet tables of one run of one operator, under the shared folder.

    A written table cuts lineage as a checkpoint does: a lost executor re-reads files and
    recomputes nothing from before.  ``drop`` deletes tables that nothing reads any more.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_root(spark)}/streamcheck/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.mode("overwrite").options(**options).parquet(self.path(name))
        return self.read(name, df)

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)


class CommittedTable:
    """A table of units (one for each micro-batch) of which readers see the committed ones only.

    A unit is a folder, written whole and then named by a marker in ``_commits``.  A unit that is written
    again after its commit changes nothing, and one whose writer died before it is not seen and is written
    anew: a batch that runs twice leaves its rows once.  ``compact`` puts many units into one, whose
    marker names those that it replaces.  Units of different streams need different names.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.jvm = spark._jvm
        self.root = self.jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = self.root.getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):  # noqa: ANN202
        return self.jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def exists(self) -> bool:
        return self.fs.exists(self._at("_commits"))

    def _markers(self) -> list[str]:
        return sorted(f.getPath().getName() for f in self.fs.listStatus(self._at("_commits"))) if self.exists() else []

    def _replaced(self, marker: str) -> set[str]:
        stream = self.fs.open(self._at("_commits", marker))
        try:
            return set(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split())
        finally:
            stream.close()

    def _state(self) -> tuple[list[str], set[str]]:
        markers = self._markers()
        gone = set().union(*(self._replaced(m) for m in markers if m.startswith("base-")))
        return [m for m in markers if m not in gone], gone

    def units(self) -> list[str]:
        """The committed units that no other replaces."""
        return self._state()[0]

    def commit(self, unit: str, replaces: tuple[str, ...] = ()) -> None:
        out = self.fs.create(self._at("_commits", unit), True)
        out.write(bytearray("\n".join(replaces).encode()))
        out.close()

    def write(self, df: DataFrame, unit: str, *partitions: str) -> bool:
        """Write and commit a unit; False, and nothing done, where it is committed already."""
        live, gone = self._state()
        if unit in live or unit in gone:
            return False
        df.write.mode("overwrite").partitionBy(*partitions).parquet(f"{self.path}/unit={unit}")
        self.commit(unit)
        return True

    def read(self, schema: str) -> DataFrame:
        """All rows of committed units; columns that a file lacks are null."""
        found = [f"{self.path}/unit={u}" for u in self.units()]
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, unit string").option("basePath", self.path).parquet(*found).drop("unit")

    def compact(self, schema: str, *partitions: str, keep: int = 1) -> None:
        """All units but the newest ``keep`` become one; what an earlier call replaced is deleted."""
        live, gone = self._state()
        for unit in gone:
            self.fs.delete(self._at(f"unit={unit}"), True)
        old = sorted(live, key=lambda u: self.fs.getFileStatus(self._at("_commits", u)).getModificationTime())[: len(live) - keep]
        if len(old) < 2:
            return
        rows = self.spark.read.schema(f"{schema}, unit string").option("basePath", self.path).parquet(*(f"{self.path}/unit={u}" for u in old)).drop("unit")
        base = f"base-{uuid.uuid4().hex}"
        rows.repartition(*partitions).write.partitionBy(*partitions).parquet(f"{self.path}/unit={base}") if partitions else rows.write.parquet(f"{self.path}/unit={base}")
        # A base that is replaced goes on to name what it replaced: a late replay of those is still known.
        self.commit(base, tuple(sorted({*old, *(x for u in old if u.startswith("base-") for x in self._replaced(u))})))
        for unit in old:
            self.fs.delete(self._at(f"unit={unit}"), True)
