"""The streaming twins give the batch results."""

import json
import math
import os
import random
import time

import pytest
from pyspark.sql import functions as F

from streamcheck.config import DAY, MINUTE, SECOND, TIER1_ONLY, GroupConfig, MetricConfig, ValidatorConfig
from streamcheck.operators.asof import raw_pairing, session_asof
from streamcheck.operators.health import health_history
from streamcheck.operators.quarantine import quarantine_history
from streamcheck.operators.tier1 import validate_readings
from streamcheck.sources import store
from streamcheck.streaming.health import quarantine_step, rescore, tick_batches, tick_stream
from streamcheck.streaming.validate import join_sessions, pair_stream, persist_batches, validate_stream

READING = "source string, metric string, value double, ts_us bigint, raw_value bigint, seq bigint"
CONFIG = ValidatorConfig(metrics={"m": MetricConfig(low=0.0, high=60.0, raw_low=1, raw_high=8, max_rate=30.0, stuck_count=3, stuck_threshold=2.0), "temperature": MetricConfig(stuck_mode="duration", resolution=3.0, stuck_window=3 * MINUTE)})


def run(spark, rows, tmp_path, make, name, until=None):
    """Feed rows in three files, one micro-batch each; a query with timeouts has no end, so it goes on for ``until`` rows."""
    names = [x.split()[0] for x in READING.split(", ")]
    (tmp_path / "in").mkdir()
    cuts = [0, len(rows) // 3, 2 * len(rows) // 3, len(rows)]
    for k in range(3):
        path = tmp_path / "in" / f"{k}.json"
        with open(path, "w") as f:
            f.writelines(json.dumps(dict(zip(names, r, strict=True))) + "\n" for r in rows[cuts[k] : cuts[k + 1]])
        os.utime(path, (1_700_000_000 + 60 * k,) * 2)  # files are taken by modification time
    stream = spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = make(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "c"))
    q = (q if until else q.trigger(availableNow=True)).start()
    try:
        if until:
            end = time.monotonic() + 90
            while spark.table(name).count() < until and time.monotonic() < end and q.isActive:
                time.sleep(0.5)
        else:
            assert q.awaitTermination(100)
    finally:
        q.stop()
    return spark.table(name).collect()


def test_validation_parity(spark, tmp_path):
    rng = random.Random(1)
    rows = [(f"s{i % 3}", rng.choice(["m", "temperature", "free"]), float(rng.choice([10, 11, 12, 50, 70])), i * 20 * SECOND, rng.choice([None, 5, 9]), i) for i in range(240)]
    want = {r.seq: (r.quality, r.rule) for r in validate_readings(spark.createDataFrame(rows, READING), CONFIG).collect()}
    got = {r.seq: (r.quality, r.rule) for r in run(spark, rows, tmp_path, lambda s: validate_stream(s, CONFIG), "verdicts")}
    assert got == want and {r for _, r in want.values()} >= {"value_range", "raw_range", "stuck_reading", "rate_of_change"}


def test_pairing_parity(spark, tmp_path):
    rng = random.Random(2)
    rows = [(f"b{i % 2}", rng.choice(["moisture", "moisture_raw"]), float(rng.randrange(100)), i * rng.choice([9, 10]) * SECOND, None, i) for i in range(90)]
    rows.sort(key=lambda r: (r[3], r[5]))
    want = {r.seq: r.raw_value for r in raw_pairing(spark.createDataFrame(rows, READING)).collect()}
    got = {r.seq: r.raw_value for r in run(spark, rows, tmp_path, pair_stream, "pairs")}
    assert got == want and any(v is not None for v in want.values())


def test_readings_never_take_later_counts(spark, tmp_path):
    rows = [("b", "moisture_raw", 7.0, 100 * SECOND, None, 0), ("b", "moisture", 1.0, 90 * SECOND, None, 1), ("b", "moisture", 2.0, 110 * SECOND, None, 2)]
    got = {r.seq: (r.raw_value, r.late) for r in run(spark, rows, tmp_path, pair_stream, "late_pairs")}
    assert got == {1: (None, True), 2: (7, False)}


def test_delay_puts_rows_in_order(spark, tmp_path):
    """Rows out of order by less than the delay get the batch's verdicts; later ones are marked and change nothing."""
    rng = random.Random(5)
    rows = [(f"s{i % 3}", "m", float(rng.choice([10, 11, 12, 50, 70])), i * 20 * SECOND, None, i) for i in range(240)]
    want = {r.seq: r.rule for r in validate_readings(spark.createDataFrame(rows, READING), CONFIG).collect()}
    mixed = sorted(rows, key=lambda r: r[3] + rng.randrange(200) * SECOND)
    flush = [(f"s{k}", "m", 0.0, 10**6 * SECOND, None, 1000 + k) for k in range(3)]
    late = [("s0", "m", 999.0, 5 * SECOND, None, 2000)]
    out = run(spark, mixed + flush + late, tmp_path, lambda s: validate_stream(s, CONFIG, delay_us=400 * SECOND), "ordered", until=240)
    got = {r.seq: (r.rule, r.late) for r in out if r.seq < 240}
    assert got == {k: (v, False) for k, v in want.items()}


def test_late_rows_and_counters_are_stored(spark, tmp_path):
    rows = [("bed/1", "m", 10.0, 100 * SECOND, None, 0), ("bed/1", "m", 99.0, 200 * SECOND, None, 1), ("bed/1", "m", 30.0, 150 * SECOND, None, 2)]
    df = spark.createDataFrame([(*r, q, x, late) for r, q, x, late in zip(rows, ["good", "invalid", "good"], ["", "value_range", ""], [False, False, True], strict=True)], READING + ", quality string, rule string, late boolean")
    write = persist_batches(str(tmp_path / "r"), str(tmp_path / "n"), str(tmp_path / "late"))
    write(df, 0), write(df.limit(0), 1)
    assert store.read_readings(spark, str(tmp_path / "r")).count() == 2 and store.read_readings(spark, str(tmp_path / "late")).first().seq == 2
    assert {(r.zone, r.quality): r.n for r in spark.read.parquet(str(tmp_path / "n")).collect()} == {("bed", "good"): 2, ("bed", "invalid"): 1}


def test_session_join_parity(spark, tmp_path):
    log = spark.createDataFrame([("s0", 1, 0, "air"), ("s0", 2, 100 * SECOND, "sand"), ("s0", 3, 100 * SECOND, "wet"), ("s1", 4, 300 * SECOND, "late")], "unit string, id int, started_us bigint, batch_label string")
    rows = [(f"s{i % 3}", "m", float(i), i * 20 * SECOND, None, i) for i in range(30)]
    unit = lambda df: df.withColumn("unit", F.col("source"))
    want = {r.seq: r.session and r.session.id for r in session_asof(unit(spark.createDataFrame(rows, READING)), log).collect()}
    got = {r.seq: r.session and r.session.id for r in run(spark, rows, tmp_path, lambda s: join_sessions(unit(s), log), "sessions")}
    assert got == want and set(want.values()) == {None, 1, 3, 4}


def test_silent_streams_are_scored_at_every_tick(spark, tmp_path):
    """A stream of ticks over stored readings gives the batch history, and a stream that has stopped is quarantined."""
    config = ValidatorConfig(metrics={"m": MetricConfig(low=0.0, high=100.0)}, groups={"bench": GroupConfig(policy=TIER1_ONLY)})
    rows = [(s, "m", 50 + math.sin(i), i * MINUTE, None, k * 1000 + i) for k, (s, n) in enumerate([("bed/1", 400), ("bed/2", 100), ("bench/1", 400)]) for i in range(n)]
    judged = validate_readings(spark.createDataFrame(rows, READING), config)
    store.append_readings(judged, str(tmp_path / "readings"))
    ticks = [90 * MINUTE + k * 30 * MINUTE for k in range(10)]
    (tmp_path / "ticks").mkdir()
    for k, t in enumerate(ticks):
        path = tmp_path / "ticks" / f"{k}.json"
        path.write_text(json.dumps({"tick_us": t}))
        os.utime(path, (1_700_000_000 + 60 * k,) * 2)
    stream = spark.readStream.schema("tick_us bigint").option("maxFilesPerTrigger", 1).json(str(tmp_path / "ticks"))
    q = stream.writeStream.foreachBatch(tick_batches(str(tmp_path / "readings"), str(tmp_path / "state"), config)).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(150)
    finally:
        q.stop()
    told = ["overall", "is_quarantined", "quarantined_us", "consecutive_bad", "consecutive_recovery", "transition", "quarantine_reason"]
    plain = lambda df: {(r.source, r.tick_us): tuple(round(r[c], 6) if c == "overall" else r[c] for c in told) for r in df.collect()}
    got = plain(spark.read.parquet(str(tmp_path / "state")))
    want = plain(quarantine_history(health_history(judged, config, ticks[0], ticks[-1], 30 * MINUTE), config))
    assert got == want and any(v[1] for v in got.values()) and {k[0] for k in got} == {"bed/1", "bed/2"}


def test_streams_older_than_the_baseline_stay_known(spark):
    config = ValidatorConfig(metrics={"m": MetricConfig()})
    known = spark.createDataFrame([("bed/1", "m")], "source string, metric string")
    rows = spark.createDataFrame([("bed/1", "m", 1.0, 0, None, 0, "good")], READING + ", quality string")
    (r,) = rescore(rows, known, config, 9 * DAY).collect()
    assert (r.overall, r.readings_in_window) == (30.0, 0)
    assert tick_stream(spark).isStreaming


@pytest.mark.parametrize("need", [1, 2, 3])
def test_quarantine_steps_equal_history(spark, need):
    rng = random.Random(need)
    config = ValidatorConfig(consecutive=need)
    rows = [(f"s{k}", "m", t, rng.choice([10.0, 30.0, 50.0, 80.0, 90.0])) for k in range(12) for t in range(12)]
    df = spark.createDataFrame(rows, "source string, metric string, tick_us bigint, overall double")
    want = {(r.source, r.tick_us): (r.is_quarantined, r.quarantined_us, r.consecutive_bad, r.consecutive_recovery, r.transition) for r in quarantine_history(df, config).collect()}
    state = spark.createDataFrame([], "source string, metric string, is_quarantined boolean, quarantined_us bigint, consecutive_bad bigint, consecutive_recovery bigint")
    for t in range(12):
        out = quarantine_step(state, df.where(F.col("tick_us") == t), config, t).collect()
        assert {(r.source, t): (r.is_quarantined, r.quarantined_us, r.consecutive_bad, r.consecutive_recovery, r.transition) for r in out} == {k: v for k, v in want.items() if k[1] == t}
        state = spark.createDataFrame([(r.source, r.metric, r.is_quarantined, r.quarantined_us, r.consecutive_bad, r.consecutive_recovery) for r in out], state.schema)


def judged_batch(spark, rows):
    return validate_readings(spark.createDataFrame(rows, READING), CONFIG).withColumn("late", F.lit(False))


def test_a_batch_that_runs_twice_is_stored_once_and_half_written_ones_are_not_seen(spark, tmp_path):
    path = str(tmp_path / "r")
    rows = [("bed/1", "m", float(v), k * 20 * SECOND, None, k) for k, v in enumerate([10, 99, 10, 50])]
    write = persist_batches(path)
    for epoch, part in ((0, rows[:2]), (0, rows[:2]), (1, rows[2:])):
        write(judged_batch(spark, part), epoch)
    table = store.read_readings(spark, path)
    assert sorted(r.seq for r in table.collect()) == [0, 1, 2, 3]
    assert {r.seq: r.validation_reason for r in table.collect()}[1] == "m = 99.00 outside plausible range [0, 60]"
    store.stored_columns(judged_batch(spark, rows)).write.partitionBy("zone", "day").parquet(f"{path}/unit=stream-2")  # its writer died before the commit
    assert store.read_readings(spark, path).count() == 4
    write(judged_batch(spark, [("bed/1", "m", 11.0, 10**9, None, 9)]), 2)
    assert sorted(r.seq for r in store.read_readings(spark, path).collect()) == [0, 1, 2, 3, 9]
    store.compact_readings(spark, path)
    write(judged_batch(spark, rows[:2]), 0)  # replaced by the compacted unit, and still known
    assert sorted(r.seq for r in store.read_readings(spark, path).collect()) == [0, 1, 2, 3, 9]
    store.compact_readings(spark, path), store.compact_readings(spark, path)
    assert sorted(r.seq for r in store.read_readings(spark, path).collect()) == [0, 1, 2, 3, 9]


def test_stream_and_batch_give_the_same_sentences(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"s{i % 3}", rng.choice(["m", "temperature"]), rng.choice([10.125, 11.0, 12.0, 50.0, 70.555, math.nan]) if i % 9 else 11.0, i * 40 * SECOND, rng.choice([None, 5, 9]), i) for i in range(240)]
    rows = [r if r[2] == r[2] else (*r[:2], 1e9, *r[3:]) for r in rows]
    want = {r.seq: (r.rule, r.reason) for r in validate_readings(spark.createDataFrame(rows, READING), CONFIG).collect()}
    got = {r.seq: (r.rule, r.reason) for r in run(spark, rows, tmp_path, lambda s: validate_stream(s, CONFIG), "sentences")}
    assert got == want and {r for r, _ in want.values()} >= {"value_range", "raw_range", "stuck_reading", "rate_of_change"}


def test_every_tick_of_a_batch_counts_and_kept_panes_serve(spark, tmp_path):
    """Ticks one by one, or three in a batch that runs twice, over readings or over kept panes: the same scores and states."""
    config = ValidatorConfig(metrics={"m": MetricConfig(low=0.0, high=100.0)}, groups={"bench": GroupConfig(policy=TIER1_ONLY)}, check_interval=30 * MINUTE)
    rows = [(s, "m", 50 + math.sin(i), i * MINUTE, None, k * 1000 + i) for k, (s, n) in enumerate([("bed/1", 400), ("bed/2", 100), ("bench/1", 400)]) for i in range(n)]
    judged = validate_readings(spark.createDataFrame(rows, READING), config).withColumn("late", F.lit(False)).drop("policy", "cfg")
    sink = persist_batches(str(tmp_path / "readings"), kept_panes=str(tmp_path / "panes"), config=config)
    for epoch in range(3):
        sink(judged.where(F.col("seq") % 3 == epoch), epoch)
        sink(judged.where(F.col("seq") % 3 == epoch), epoch)
    ticks = [90 * MINUTE + k * 30 * MINUTE for k in range(12)]
    told = ["overall", "is_quarantined", "quarantined_us", "consecutive_bad", "consecutive_recovery", "transition", "quarantine_reason"]
    results = []
    for name, size, kept in (("one", 1, None), ("three", 3, None), ("kept", 3, str(tmp_path / "panes"))):
        state = str(tmp_path / name)
        tick = tick_batches(str(tmp_path / "readings"), state, config, kept)
        for epoch, k in enumerate(range(0, 12, size)):
            batch = spark.createDataFrame([(t,) for t in ticks[k : k + size]], "tick_us bigint")
            tick(batch, 2 * epoch)
            tick(batch, 2 * epoch)
            tick(batch.limit(0), 2 * epoch + 1)
        results.append({(r.source, r.tick_us): tuple(round(r[c], 6) if c == "overall" else r[c] for c in told) for r in spark.read.parquet(state).collect()})
        assert len(list((tmp_path / name).glob("epoch=*"))) == 12 // size
    assert results[0] == results[1] == results[2] and any(v[5] == "entered" for v in results[0].values())
    want = quarantine_history(health_history(judged.withColumns({"policy": F.when(F.col("source") == "bench/1", "tier1_only").otherwise("full"), "cfg": F.struct(F.lit(60 * SECOND).cast("bigint").alias("cadence"))}), config, ticks[0], ticks[-1], 30 * MINUTE), config)
    assert results[0] == {(r.source, r.tick_us): tuple(round(r[c], 6) if c == "overall" else r[c] for c in told) for r in want.collect()}
    tick = tick_batches(str(tmp_path / "readings"), str(tmp_path / "few"), config, keep=2)
    for epoch, t in enumerate(ticks[:5]):
        tick(spark.createDataFrame([(t,)], "tick_us bigint"), epoch)
    assert len(list((tmp_path / "few").glob("epoch=*"))) == 2
