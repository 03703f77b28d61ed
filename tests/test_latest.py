"""The kept table of latest readings, and the session lookup."""

import random

from pyspark.sql import functions as F

from streamcheck.operators.asof import session_asof, session_lookup
from streamcheck.operators.serving import sensors_latest
from streamcheck.sources.latest import LatestTable


def test_latest_after_each_of_ten_batches_touches_few_buckets(spark, tmp_path):
    rng = random.Random(1)
    kept, all_rows = LatestTable(spark, str(tmp_path / "t"), buckets=16), []
    schema = "source string, metric string, seq bigint, value double, ts_us bigint, quality string"
    for epoch in range(10):
        rows = [(f"bed/{rng.choice([epoch, epoch + 1])}", "m", 100 * rng.choice([epoch, epoch - 1]) + k, rng.random(), epoch * 10 + k, "good") for k in range(5)]
        all_rows += rows
        before = kept.manifest()
        batch = spark.createDataFrame(rows, schema)
        kept.update(batch, epoch)
        after = kept.manifest()
        assert sum(before.get(b) != v for b, v in after.items()) <= len({r[0] for r in rows})
        kept.update(batch.withColumn("value", F.lit(-1.0)), epoch)  # the same epoch again
        zone = sensors_latest(spark.createDataFrame(all_rows, schema))
        want = sorted((f"{r.zone}/{r.zone_id}", r.metric, r.seq) for r in zone.collect())
        assert sorted((r.source, r.metric, r.seq) for r in kept.read().collect()) == want
    assert kept.stream("bed/3", "m").count() == 1 and kept.stream("bed/99", "m").count() == 0


def test_session_lookup_is_the_asof_join_without_range_conditions(spark):
    rng = random.Random(2)
    log = [(rng.choice("abc"), i, rng.randrange(60), f"b{i}") for i in range(50)] + [("d", 99, 5, "only")]
    rows = [(rng.choice(["a", "b", "c", "d", "e", None]), rng.randrange(-5, 70), i) for i in range(300)]
    sessions = spark.createDataFrame(log, "unit string, id int, started_us bigint, batch_label string")
    readings = spark.createDataFrame(rows, "unit string, ts_us bigint, seq int")
    want = {r.seq: r.session and r.session.id for r in session_asof(readings, sessions).collect()}
    for size in (1, 3, 256):
        out = session_lookup(readings, sessions, size)
        assert {r.seq: r.session and r.session.id for r in out.collect()} == want
    plan = out._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("<" in j or "NestedLoop" in j or "Cartesian" in j for j in joins)
