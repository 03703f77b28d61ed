"""Hot sources in pieces of time, gauges from rows by tick, and tables in buckets of streams."""

import random

from pyspark.sql import functions as F

from streamcheck.config import MINUTE, SECOND, MetricConfig, ValidatorConfig
from streamcheck.functions import rules
from streamcheck.operators import tier1
from streamcheck.operators.asof import raw_pairing, session_asof
from streamcheck.operators.gauges import stale_gauge
from streamcheck.sources import store

READING = "source string, metric string, value double, ts_us bigint, raw_value bigint, seq bigint"


def paired(rows, limit_us):
    """A sequential walk: the row directly before a reading is its raw count, if young enough."""
    want, before = {}, {}
    for source, metric, value, ts, _, seq in sorted((r for r in rows if r[3] is not None), key=lambda r: (r[3], r[5])):
        if metric == "moisture":
            m, v, t = before.get(source, (None, None, None))
            want[seq] = int(v) if m == "moisture_raw" and (ts - t) // SECOND < limit_us // SECOND else None
        before[source] = (metric, value, ts)
    return want


def test_pairing_in_pieces_of_time_equals_a_walk(spark):
    draw = random.Random(11)
    rows = [(draw.choice("ab"), draw.choice(["moisture", "moisture_raw"]), float(draw.randrange(4000)), draw.randrange(-900, 900) * SECOND + draw.choice([0, 0, 1, SECOND - 1]), None, i) for i in range(1500)]
    rows.append(("a", "moisture", 1.0, None, None, 9999))
    df = spark.createDataFrame(rows, READING)
    for limit, width in ((5 * SECOND, 7 * SECOND), (5 * SECOND, 5 * SECOND), (30 * SECOND, SECOND), (5 * SECOND, 3600 * SECOND)):
        got = [(r.seq, r.raw_value) for r in raw_pairing(df, limit_us=limit, width_us=width).collect()]
        assert len(got) == len(dict(got)) and dict(got) == paired(rows, limit) | {9999: None}
    assert raw_pairing(df.limit(0)).count() == 0


def test_one_hot_source_is_spread_over_pieces(spark):
    hot = spark.range(200_000).select(F.lit("a").alias("source"), F.when(F.col("id") % 2 == 0, "moisture_raw").otherwise("moisture").alias("metric"), F.lit(1.0).alias("value"), (F.col("id") * SECOND).alias("ts_us"), F.lit(None).cast("bigint").alias("raw_value"), F.col("id").alias("seq"))
    plan = raw_pairing(hot)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1 and all("_cell" in line for line in text.splitlines() if "Exchange hashpartitioning" in line)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        most = plan.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert most < 50_000 and plan.where("raw_value = 1").count() == 100_000


def test_sessions_over_pieces_of_time_equal_a_look_at_the_whole_log(spark):
    draw = random.Random(8)
    log = [(draw.choice(["a", "b", None]), i, draw.randrange(-200, 400), f"b{i % 3}") for i in range(60)] + [("d", 99, 5, "only")]
    rows = [(draw.choice(["a", "b", "c", "d", None]), draw.randrange(-300, 500), i) for i in range(600)] + [("a", None, 600)]
    sessions = spark.createDataFrame(log, "unit string, id int, started_us bigint, batch_label string")
    readings = spark.createDataFrame(rows, "unit string, ts_us bigint, seq int")
    want = {seq: max(((at, i) for u, i, at, _ in log if u == unit and ts is not None and at <= ts), default=(None, None))[1] for unit, ts, seq in rows}
    for width in (1, 7, 100, 10**6):
        out = [(r.seq, r.session and r.session.id) for r in session_asof(readings, sessions, width).collect()]
        assert len(out) == len(rows) and dict(out) == want
    assert {r.session for r in session_asof(readings, sessions.limit(0)).collect()} == {None}
    plan = session_asof(readings, sessions, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and sum("hashpartitioning(unit" in x and "_cell" not in x for x in plan.splitlines()) == 1  # the pieces alone


def exported(rows, start, end, step, timeout):
    """The gauge as a process keeps it: readings set it, ticks remove what has gone stale."""
    out = []
    for key in {r[:2] for r in rows}:
        own = sorted((r for r in rows if r[:2] == key), key=lambda r: (r[3], r[5]))
        value = raw = last = None
        i = 0
        for tick in range(start, end + 1, step):
            while i < len(own) and own[i][3] <= tick:
                _, _, v, last, adc, _, quality = own[i]
                if quality == rules.GOOD:
                    value, raw = v, adc if adc is not None else raw
                i += 1
            if last is None:
                continue
            if tick - last > timeout:
                value = raw = None
            out.append((*key, tick, value, raw, (tick - last) / 1e6))
    return sorted(out, key=str)


def test_gauges_equal_a_process_that_keeps_them(spark):
    draw = random.Random(5)
    for start, end, step, timeout in ((0, 1000, 10, 50), (5, 996, 30, 20), (300, 600, 7, 200), (0, 1000, 10, 3)):
        rows, seq = [], 0
        for key in (("s/1", "m"), ("s/2", "m"), ("s/1", "n")):
            for burst in range(0, 1100, 110):
                for _ in range(draw.randrange(0, 9)):
                    seq += 1
                    rows.append((*key, float(seq), (burst + draw.randrange(0, 60) // 10 * 10 - 30) * SECOND, draw.choice([None, seq]), seq, draw.choice([rules.GOOD, rules.GOOD, rules.SUSPECT])))
        df = spark.createDataFrame(rows, READING + ", quality string")
        got = stale_gauge(df, start * SECOND, end * SECOND, step * SECOND, timeout * SECOND)
        assert sorted(map(tuple, got.collect()), key=str) == exported(rows, start * SECOND, end * SECOND, step * SECOND, timeout * SECOND)


def test_gauges_combine_before_they_shuffle_and_scan_once(spark, tmp_path):
    path = str(tmp_path / "r")
    spark.createDataFrame([("s", "m", 1.0, 5 * SECOND, None, 1, rules.GOOD)], READING + ", quality string").write.parquet(path)
    plan = stale_gauge(spark.read.parquet(path), 0, 60 * MINUTE)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "partial_max_by" in plan and "Generate explode" in plan
    assert plan.index("Generate explode") < plan.index("Window [")  # ticks are laid out after the windows


def test_a_table_in_buckets_is_validated_without_a_shuffle(spark, tmp_path):
    draw = random.Random(2)
    rows = [(f"s/{i % 13}", draw.choice("mn"), float(draw.randrange(60)), i * SECOND, None, i) for i in range(900)]
    df = spark.createDataFrame(rows, READING)
    config = ValidatorConfig(metrics={"m": MetricConfig(low=2, max_rate=40, stuck_count=3), "n": MetricConfig(stuck_mode="duration", resolution=9.0, stuck_window=2 * MINUTE)})
    want = sorted(map(tuple, tier1.validate_readings(df, config).select("seq", "quality", "rule").collect()))
    name = "readings_" + tmp_path.name.replace("-", "_")
    for part in range(3):
        store.lay_out(df.where(F.col("seq") % 3 == part), name, str(tmp_path / "batches"), buckets=4)

    def check():
        judged = tier1.validate_readings(spark.table(name), config)
        plan = judged._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
        assert sorted(map(tuple, judged.select("seq", "quality", "rule").collect())) == want

    check()
    assert len(list((tmp_path / "batches").glob("*.parquet"))) > 4
    store.compact_layout(spark, name, str(tmp_path / "compacted"))
    check()
    assert len(list((tmp_path / "compacted").glob("*.parquet"))) == 4
    assert all("/compacted/" in f for f in spark.table(name).inputFiles())
    spark.sql(f"DROP TABLE {name}")
