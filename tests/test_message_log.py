"""The log source: every message once, in bounded batches, over a restart, and again from an offset."""

import json

from streamcheck.sources.message_log import LogReader, log_stream


def append(folder, partition, first, n, base):
    path = folder / f"partition={partition}"
    path.mkdir(parents=True, exist_ok=True)
    with open(path / f"{first:020d}.jsonl", "a") as f:
        f.writelines(json.dumps({"topic": "garden/bed/1/moisture", "payload": str(k), "received_us": k, "seq": base + k}) + "\n" for k in range(n))


def drain(spark, folder, out, checkpoint, **options):
    q = log_stream(spark, str(folder), **options).writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(100)
        return [p["numInputRows"] for p in q.recentProgress]
    finally:
        q.stop()


def rows(spark, out):
    return sorted((r.log_partition, r.log_offset, r.seq) for r in spark.read.parquet(str(out)).collect())


def test_offsets_segments_and_restart(spark, tmp_path):
    log = tmp_path / "log"
    append(log, 0, 0, 5, 0), append(log, 0, 5, 3, 100), append(log, 1, 0, 4, 200)
    drain(spark, log, tmp_path / "o", tmp_path / "c")
    first = rows(spark, tmp_path / "o")
    assert len(first) == 12 and len({x[2] for x in first}) == 12
    append(log, 0, 8, 2, 300), append(log, 1, 0, 2, 400), append(log, 2, 0, 1, 500)
    drain(spark, log, tmp_path / "o", tmp_path / "c")
    again = rows(spark, tmp_path / "o")
    assert len(again) == 17 and set(first) <= set(again) and (2, 0, 500) in again
    drain(spark, log, tmp_path / "p", tmp_path / "d", starting={0: 6, 1: 4, 2: 0})
    assert rows(spark, tmp_path / "p") == [x for x in again if x >= (0, 6, 0) and not (x[0] == 1 and x[1] < 4)]


def test_batches_are_bounded_and_unfinished_lines_wait(tmp_path):
    append(tmp_path, 0, 0, 10, 0)
    with open(tmp_path / "partition=0" / f"{0:020d}.jsonl", "a") as f:
        f.write('{"topic": "x"')
    reader = LogReader({"path": str(tmp_path), "maxPerPartition": "4"})
    at, sizes = reader.initialOffset(), []
    for _ in range(4):
        end = reader.latestOffset()
        sizes.append(sum(len(list(reader.read(p))) for p in reader.partitions(at, end)))
        reader.commit(end)
        at = end
    assert sizes == [4, 4, 2, 0]
    assert LogReader({"path": str(tmp_path)}).latestOffset() == {"0": 10}
