"""Messages of a partitioned log as a stream with offsets.

A log is a folder with ``partition=<k>`` folders of segments, ``<offset of the first message>.jsonl``, one JSON
message a line (topic, payload, received_us, seq).  Segments are only added to.  A query's place is an
offset for each partition, kept in its checkpoint; each partition is read by a task of its own, from any
store that pyarrow's file systems open.  A batch has at most ``maxPerPartition`` messages of each
(and a query that is to end with what is there takes one such batch).
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

LOGGED = "topic string, payload string, received_us bigint, seq bigint, log_partition int, log_offset bigint"


@dataclass
class Stretch(InputPartition):
    partition: int
    begin: int
    end: int


class LogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.uri, self.most = options["path"], int(options.get("maxPerPartition", 100_000))
        self.first = {int(k): int(v) for k, v in json.loads(options.get("startingOffsets", "{}")).items()}
        self.given: dict[int, int] | None = None  # what this reader has handed out last

    def store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri) if "://" in self.uri else (fs.LocalFileSystem(), self.uri)

    def segments(self) -> dict[int, list[tuple[int, str]]]:
        """(first offset, path) of each partition's segments in order."""
        store, root = self.store()
        out: dict[int, list[tuple[int, str]]] = {}
        for f in store.get_file_info(fs.FileSelector(root, recursive=True)):
            if f.is_file and f.extension == "jsonl":
                out.setdefault(int(f.path.rsplit("partition=", 1)[1].split("/")[0]), []).append((int(f.base_name[: -len(".jsonl")]), f.path))
        return {k: sorted(v) for k, v in out.items()}

    def lines(self, path: str) -> list[bytes]:
        """Whole lines: one that is still being written is not there yet."""
        store, _ = self.store()
        with store.open_input_stream(path) as f:
            return f.read().split(b"\n")[:-1]

    def initialOffset(self) -> dict:  # noqa: N802
        return {str(k): self.first.get(k, v[0][0]) for k, v in self.segments().items()}

    def latestOffset(self) -> dict:  # noqa: N802
        ends = {k: v[-1][0] + len(self.lines(v[-1][1])) for k, v in self.segments().items()}
        if self.given is not None:
            ends = {k: min(end, self.given.get(k, self.first.get(k, 0)) + self.most) for k, end in ends.items()}
        elif self.first or self.most:
            begins = {int(k): v for k, v in self.initialOffset().items()}
            ends = {k: min(end, begins[k] + self.most) for k, end in ends.items()}
        return {str(k): v for k, v in ends.items()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        self.given = {int(k): v for k, v in end.items()}
        begins = self.initialOffset() if any(k not in start for k in end) else {}
        return [Stretch(int(k), start.get(k, begins.get(k, 0)), v) for k, v in end.items() if v > start.get(k, begins.get(k, 0))]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        segments = self.segments()[partition.partition]
        for k, (first, path) in enumerate(segments):
            following = segments[k + 1][0] if k + 1 < len(segments) else partition.end
            if first >= partition.end or following <= partition.begin:
                continue
            for offset, line in enumerate(self.lines(path), first):
                if partition.begin <= offset < partition.end:
                    m = json.loads(line)
                    yield m.get("topic"), m.get("payload"), m.get("received_us"), m.get("seq"), partition.partition, offset

    def commit(self, end: dict) -> None:
        self.given = {int(k): v for k, v in end.items()}


class MessageLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "message_log"

    def schema(self) -> str:
        return LOGGED

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return LogReader(self.options)


def log_stream(spark: SparkSession, path: str, most: int = 100_000, starting: dict[int, int] | None = None) -> DataFrame:
    """The log at ``path`` from its beginning, or from ``starting`` offsets by partition."""
    spark.dataSource.register(MessageLog)
    return spark.readStream.format("message_log").option("path", path).option("maxPerPartition", most).option("startingOffsets", json.dumps(starting or {})).load()
