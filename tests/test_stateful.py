"""The stateful processors give the batch results, over a restart too, and their state expires."""

import json
import os
import random
import time

import pytest
from pyspark.sql import functions as F
from test_streaming import CONFIG, READING

from streamcheck.config import SECOND
from streamcheck.operators.asof import raw_pairing
from streamcheck.operators.tier1 import validate_readings
from streamcheck.streaming.stateful import pair_stateful, use_rocksdb, validate_stateful

NAMES = [x.split()[0] for x in READING.split(", ")]


@pytest.fixture(autouse=True)
def rocksdb(spark):
    use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def feed(folder, k, rows):
    folder.mkdir(exist_ok=True)
    path = folder / f"{k}.json"
    path.write_text("".join(json.dumps(dict(zip(NAMES, r, strict=True))) + "\n" for r in rows))
    os.utime(path, (1_700_000_000 + 60 * k,) * 2)


def start(spark, tmp_path, make):
    stream = spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    return make(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()


def wait(spark, tmp_path, q, n):
    end = time.monotonic() + 120
    while time.monotonic() < end and q.isActive:
        if (tmp_path / "out" / "_spark_metadata").exists() and spark.read.schema("seq bigint").parquet(str(tmp_path / "out")).count() >= n:
            break
        time.sleep(0.5)


def test_validation_goes_on_after_a_restart_in_the_middle(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"s{i % 2}", rng.choice(["m", "temperature"]), float(rng.choice([10, 11, 12, 50, 70])), i * 20 * SECOND, rng.choice([None, 5, 9]), i) for i in range(160)]
    want = {r.seq: (r.quality, r.rule, r.reason) for r in validate_readings(spark.createDataFrame(rows, READING), CONFIG).collect()}
    for k, part in enumerate((rows[:90], rows[90:])):
        feed(tmp_path / "in", k, part)
        q = start(spark, tmp_path, lambda s: validate_stateful(s, CONFIG))
        wait(spark, tmp_path, q, (90, 160)[k])
        q.stop()
    out = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(out) == 160 and {r.seq: (r.quality, r.rule, r.reason) for r in out} == want


def test_waiting_rows_come_in_order_and_silence_lets_them_go(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"s{i % 2}", "m", float(rng.choice([10, 11, 12, 50, 70])), i * 20 * SECOND, None, i) for i in range(100)]
    want = {r.seq: r.rule for r in validate_readings(spark.createDataFrame(rows, READING), CONFIG).collect()}
    mixed = sorted(rows, key=lambda r: r[3] + rng.randrange(100) * SECOND)
    feed(tmp_path / "in", 0, mixed[:60])
    q = start(spark, tmp_path, lambda s: validate_stateful(s, CONFIG, delay_us=200 * SECOND))
    wait(spark, tmp_path, q, 40)
    q.stop()
    feed(tmp_path / "in", 1, [*mixed[60:], *((f"s{k}", "m", 0.0, 10**5 * SECOND, None, 1000 + k) for k in range(2))])
    q = start(spark, tmp_path, lambda s: validate_stateful(s, CONFIG, delay_us=200 * SECOND))
    wait(spark, tmp_path, q, 100)
    q.stop()
    assert {r.seq: (r.rule, r.late) for r in spark.read.parquet(str(tmp_path / "out")).where("seq < 1000").collect()} == {k: (v, False) for k, v in want.items()}


def test_pairing_parity_and_state_that_expires(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"b{i % 2}", rng.choice(["moisture", "moisture_raw"]), float(rng.randrange(100)), i * 9 * SECOND, None, i) for i in range(60)]
    want = {r.seq: r.raw_value for r in raw_pairing(spark.createDataFrame(rows, READING), limit_us=5 * SECOND).collect()}
    feed(tmp_path / "in", 0, rows)
    q = start(spark, tmp_path, lambda s: pair_stateful(s, limit_us=5 * SECOND))
    try:
        wait(spark, tmp_path, q, len(want))
        end, left = time.monotonic() + 60, None
        while time.monotonic() < end and left != 0:
            time.sleep(1)
            told = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
            left = told[-1] if told and max(told) > 0 else None
    finally:
        q.stop()
    assert {r.seq: r.raw_value for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    assert left == 0
