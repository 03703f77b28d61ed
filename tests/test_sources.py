"""CSV goldens, parsing, messages, sessions, joins, gauges and the stored table."""

import math

import pytest
from pyspark.sql import functions as F

from streamcheck.config import MINUTE, SECOND, MetricConfig, ValidatorConfig
from streamcheck.functions import parsing, rules
from streamcheck.operators import asof, gauges, report, serving
from streamcheck.operators.tier1 import validate_readings
from streamcheck.sources import csv, messages, store


def clean_file(path):
    start = 10 * 3600
    with open(path, "w") as f:
        f.write("﻿timestamp, sensor,value,raw\n")
        for i in range(100):
            v = 50.0 if 40 <= i <= 46 else round(60 - 0.1521 * i + 0.4 * math.sin(i), 2)
            t = start + 30 * i
            f.write(f"2026-05-16T{t // 3600:02}:{t // 60 % 60:02}:{t % 60:02}Z,bed/1,{v:.2f},{550 + i}\n")
    return str(path)


def test_csv_report(spark, tmp_path):
    out, flagged = csv.csv_report(spark, clean_file(tmp_path / "a.csv"))
    (r,) = out.collect()
    assert (r.metric, r.total, r.good, r.suspect, r.invalid, r.duration_s, r.sources, r.skipped_rows) == ("value", 100, 98, 2, 0, 2970, ["bed/1"], 0)
    assert r.flagged_rules == {"stuck_reading": 2} and r.health.readings_in_window == 100 and r.quarantined == 0
    assert abs(r.health.quality_rate - 0.98) < 1e-9 and r.health.reporting_cadence == 1 and r.health.recency == 1
    assert [x.ts_us // SECOND % 3600 for x in flagged.orderBy("ts_us").collect()] == [22 * 60 + 30, 23 * 60]
    assert abs(r.health.overall - 99.3) < 1e-9 and round(r.good_pct, 1) == 98.0 and round(r.suspect_pct, 1) == 2.0
    assert store.report_json(out).first().json.startswith('{"metric":"value"')


def test_noisy_csv_report(spark, tmp_path):
    """200 rows: eight equal ones, a gap, a spike and the step back from it, a slow ramp at the end."""
    with open(tmp_path / "n.csv", "w") as f:
        f.write("timestamp,sensor,value\n")
        for i in range(200):
            v = 999.0 if i == 120 else 72.0 if 50 <= i <= 57 else 70 + 0.5 * max(0, i - 149) + math.sin(i)
            t = 10 * 3600 + 30 * i + (300 if i >= 80 else 0)
            f.write(f"2026-05-16T{t // 3600:02}:{t // 60 % 60:02}:{t % 60:02}Z,bed/1,{v:.2f}\n")
    out, flagged = csv.csv_report(spark, str(tmp_path / "n.csv"), low=-40.0, high=200.0)
    (r,) = out.collect()
    assert (r.total, r.good, r.suspect, r.invalid) == (200, 195, 4, 1) and (r.good_pct, r.suspect_pct, r.invalid_pct) == (97.5, 2.0, 0.5)
    assert r.flagged_rules == {"stuck_reading": 3, "value_range": 1, "rate_of_change": 1} and r.health.readings_in_window == 120
    clock = lambda us: f"{us // SECOND // 3600 % 24}:{us // SECOND // 60 % 60:02}:{us // SECOND % 60:02}"
    assert [(clock(x.ts_us), x.rule) for x in flagged.orderBy("ts_us").collect()] == [("10:27:30", "stuck_reading"), ("10:28:00", "stuck_reading"), ("10:28:30", "stuck_reading"), ("11:05:00", "value_range"), ("11:05:30", "rate_of_change")]
    assert [x.reason for x in flagged.orderBy("ts_us").collect()][3] == "value = 999.00 outside plausible range [-40, 200]"


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_roles_and_skips(spark, tmp_path):
    df = csv.read_csv(spark, write(tmp_path / "a.csv", 'value\n1.0\n""\n\noops\n2.0\n'))
    r = csv.build_readings(df, csv.detect_roles(df), {"value": "value"}, cadence_us=30 * SECOND).orderBy("seq").collect()
    assert [(x.value, x.skipped, x.ts_us // SECOND, x.source, x.seq) for x in r] == [(1.0, False, 0, "default", 0), (None, True, 30, "default", 1), (None, True, 60, "default", 2), (2.0, False, 90, "default", 3)]
    df = csv.read_csv(spark, write(tmp_path / "b.csv", "Time,Temperature,humidity,note,ID,Raw\n2026-05-16 12:00:00,1,nan,x,,7\n2026-05-16,inf,2,,n,1.5\n"))
    roles = csv.detect_roles(df)
    assert (roles.timestamp, roles.source, roles.raw, roles.values) == ("Time", "ID", "Raw", {"Temperature": "Temperature", "humidity": "humidity"})
    assert csv.choose_metrics(roles, "TEMPERATURE") == {"Temperature": "Temperature"} and csv.choose_metrics(roles, "cpu") == {"Temperature": "cpu"}
    got = csv.build_readings(df, roles, roles.values).where("metric = 'humidity'").orderBy("seq").collect()
    assert math.isnan(got[0].value) and [(x.source, x.raw_value) for x in got] == [("default", 7), ("n", None)]
    for text, error in (("value\n", "no data rows"), ("name,note\na,b\n", "no numeric")):
        with pytest.raises(ValueError, match=error):
            csv.csv_report(spark, write(tmp_path / "c.csv", text))
    bad = csv.read_csv(spark, write(tmp_path / "d.csv", "ts,value\nnot-a-date,1\n"))
    with pytest.raises(Exception, match="cannot read time"):
        csv.build_readings(bad, csv.detect_roles(bad), {"value": "value"}).collect()
    assert csv.build_readings(bad, csv.detect_roles(bad), {"value": "value"}, strict=False).first().ts_us is None


def test_csv_value_columns_and_quotes(spark, tmp_path):
    df = csv.read_csv(spark, write(tmp_path / "a.csv", 'temp,value,note,data\n1,2,"say ""x"", or",3\n4,5,"two\nlines",6\n7\n'))
    roles = csv.detect_roles(df)
    assert list(roles.values.items()) == [("temp", "temp"), ("value", "value"), ("data", "data")]
    assert csv.choose_metrics(roles, "cpu") == {"temp": "cpu"} and csv.choose_metrics(roles, "DATA") == {"data": "data"}
    assert [r.note for r in csv.with_row_index(df).orderBy("seq").collect()] == ['say "x", or', "two\nlines", None]


def test_csv_rows_are_numbered_over_files_and_splits(spark, tmp_path):
    (tmp_path / "d").mkdir()
    for k, n in enumerate((3, 2000, 500)):
        write(tmp_path / "d" / f"{k}.csv", "value\n" + "".join(f"{k * 10000 + i}\n" for i in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = csv.with_row_index(csv.read_csv(spark, str(tmp_path / "d"))).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [int(r.value) for r in rows] == [k * 10000 + i for k, n in enumerate((3, 2000, 500)) for i in range(n)]
    assert [r.seq for r in rows] == list(range(2503))


def one(spark, column, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", column(F.col("t")).alias("x")).orderBy("i").collect()]


def test_parsing(spark):
    noon = 1778932800 * SECOND
    forms = ["2026-05-16T12:00:00Z", "2026-05-16T14:00:00+02:00", "2026-05-16 12:00:00", "2026-05-16T12:00:00.000", "2026/05/16 12:00:00", "Sat, 16 May 2026 12:00:00 GMT", "16 May 2026 12:00:00 +0000", "1778932800", "1778932800000", "2026-05-16", "2026", "not-a-date", "", "12d", "2026-13-01"]
    assert one(spark, parsing.timestamp_micros, forms) == [noon] * 9 + [noon - 12 * 3600 * SECOND, 2026 * SECOND, None, None, None, None]
    got = one(spark, parsing.number, ["1.5", " 2 ", "12d", "", "abc", "-inf", "1e3", ".5", "0x1", "nan"])
    assert got[:9] == [1.5, 2.0, None, None, None, -math.inf, 1000.0, 0.5, None] and math.isnan(got[9])
    assert one(spark, parsing.whole_number, ["550", "550.0", "-3", "99999999999999999999", ""]) == [550, None, -3, None, None]


GOOD = ["garden/bed/1/moisture", "garden/bed/1/moisture_raw", "garden/bed//temperature", "garden/bed/7/humidity", "garden/greenhouse/temperature", "garden/greenhouse/humidity", "charstation/1/raw_adc", "charstation/16/temperature"]
BAD = ["garden/bed/1/water/command", "other/bed/1/moisture", "garden/bed/1/pressure", "", "charstation/0/raw_adc", "charstation/17/raw_adc", "charstation/-1/raw_adc", "charstation/03/raw_adc", "charstation/abc/raw_adc", "charstation//raw_adc", "charstation/3/moisture", "charstation/session", "charstation/control/unit", "charstation/3/raw_adc/extra", "garden/bed/1/raw_adc", "garden/greenhouse/moisture_raw"]


def test_topics(spark):
    assert all(one(spark, parsing.parse_topic, GOOD)) and not any(one(spark, parsing.parse_topic, BAD))
    assert one(spark, parsing.route, [GOOD[0], GOOD[1], "charstation/session", "charstation/control/x", "x"]) == ["reading", "raw", "session", "control", "unrecognised"]


def test_sessions(spark):
    keep = ['{"unit_id":" 3 ","batch":"sand","batch_label":"x","insertion":2,"notes":"n"}', '{"unit_id":7,"batch":"b"}', '{"unit_id":42,"batch":"b","notes":" "}']
    drop = ["", "not json at all", "{", '{"unit_id":1}', '{"batch":"b"}', '{"unit_id":"","batch":"b"}', '{"unit_id":1,"batch":" "}', '{"unit_id":1,"batch":"b","insertion":"four"}', '["unit_id","3"]', "null", '{"unit_id":1.5,"batch":"b"}', '{"unit_id":1,"batch":5}']
    got = one(spark, parsing.parse_session, keep + drop)
    assert [tuple(x) for x in got[:3]] == [("3", "sand", 2, "n", True), ("7", "b", None, None, True), ("42", "b", None, None, False)]
    assert got[3:] == [None] * len(drop)


def test_messages_to_readings(spark):
    rows = [("garden/bed/1/moisture_raw", "2400", 0), ("garden/bed/1/moisture", "42.5", 1), ("garden/bed/1/moisture", "43", 2), ("garden/bed/2/moisture_raw", "2000", 0), ("garden/bed/2/moisture_raw", "bad", 1), ("garden/bed/2/temperature", "20", 2), ("garden/bed/2/moisture", "40", 29), ("garden/bed/3/moisture_raw", "1", 0), ("garden/bed/3/moisture", "40", 30), ("charstation/3/raw_adc", "1487.4", 5)]
    df = spark.createDataFrame([(t, p, s * SECOND, i) for i, (t, p, s) in enumerate(rows)], messages.MESSAGE)
    got = {r.seq: (r.source, r.value, r.raw_value) for r in messages.readings(df).collect()}
    assert got == {1: ("bed/1", 42.5, 2400), 2: ("bed/1", 43.0, None), 5: ("bed/2", 20.0, None), 6: ("bed/2", 40.0, 2000), 8: ("bed/3", 40.0, None), 9: ("charstation/3", 1487.4, 1487)}
    assert messages.numeric_readings(df).where("rejected").count() == 1


def test_session_join(spark):
    log = spark.createDataFrame([("3", 1, 100, "air"), ("3", 2, 200, "sand"), ("3", 3, 200, "wet"), ("4", 4, 0, "other")], "unit string, id int, started_us bigint, batch_label string")
    rows = spark.createDataFrame([("3", 99, 1.0, "good"), ("3", 100, 2.0, "good"), ("3", 199, 4.0, "suspect"), ("3", 200, 9.0, "invalid"), ("3", 500, 8.0, "good"), ("5", 500, 8.0, "good")], "unit string, ts_us bigint, value double, quality string")
    got = {(r.unit, r.ts_us): r.session.batch_label if r.session else None for r in asof.session_asof(rows, log).collect()}
    assert got == {("3", 99): None, ("3", 100): "air", ("3", 199): "air", ("3", 200): "wet", ("3", 500): "wet", ("5", 500): None}
    floor = {r.batch_label: (r.n, r.mean, r.peak_to_peak, r.suspect_rows) for r in report.noise_floor(asof.in_session(rows, log)).collect()}
    assert floor == {"air": (2, 3.0, 2.0, 1), "wet": (1, 8.0, 0.0, 0)}


def test_gauge_timeline(spark):
    rows = [("bed/x", "temperature", 73.0, 0, None, 0, "good"), ("bed/x", "temperature", 65.8, 920 * SECOND, None, 1, "good"), ("bed/x", "temperature", 999.0, 1000 * SECOND, None, 2, "invalid"), ("bed/x", "moisture", 40.0, 0, 2400, 3, "good"), ("bed/x", "moisture", 999.0, 200 * SECOND, 1, 4, "invalid")]
    df = spark.createDataFrame(rows, "source string, metric string, value double, ts_us bigint, raw_value bigint, seq bigint, quality string")
    got = {(r.metric, r.tick_us // SECOND): (r.value, r.raw_value) for r in gauges.stale_gauge(df, 0, 1300 * SECOND, 20 * SECOND).collect()}
    t = {s: got["temperature", s][0] for s in (0, 120, 300, 320, 900, 920, 1000, 1300)}
    assert t == {0: 73.0, 120: 73.0, 300: 73.0, 320: None, 900: None, 920: 65.8, 1000: 65.8, 1300: 65.8}
    assert got["moisture", 500] == (40.0, 2400) and got["moisture", 520] == (None, None)
    ages = {r.metric: r.age_s for r in serving.last_reading_age(df, 1900 * SECOND).collect()}
    assert ages == {"temperature": 900.0, "moisture": 1700.0} and serving.outages(df, 1900 * SECOND).count() == 1


def test_store_round_trip(spark, tmp_path):
    config = ValidatorConfig(metrics={"moisture": MetricConfig(low=0, high=100)})
    df = spark.createDataFrame([("bed/1", "moisture", 40.0, 0, 7, 0), ("bed/1", "moisture", 400.0, MINUTE, None, 1)], "source string, metric string, value double, ts_us bigint, raw_value bigint, seq bigint")
    path = str(tmp_path / "r")
    store.append_readings(validate_readings(df, config), path)
    spark.createDataFrame([("bed", "1", "moisture", 41.0, 2 * MINUTE, 2)], "zone string, zone_id string, metric string, value double, ts_us bigint, seq bigint").selectExpr("*", "date'1970-01-01' AS day").write.mode("append").partitionBy("zone", "day").parquet(path)
    got = store.read_readings(spark, path).orderBy("seq").collect()
    assert [(r.source, r.quality, r.validation_reason is None, r.raw_adc) for r in got] == [("bed/1", "good", True, 7), ("bed/1", "invalid", False, None), ("bed/1", "good", True, None)]


def test_small_functions(spark):
    df = spark.createDataFrame([("bed/1/x", 1), ("bed", 2)], "s string, i int")
    zone, zone_id = rules.split_source(F.col("s"))
    assert [tuple(r) for r in df.select(zone, zone_id, rules.source_group(F.col("s"))).collect()] == [("bed", "1/x", "bed"), ("bed", "bed", "bed")]
    rules.register_sql(spark)
    assert [r[0] for r in spark.sql("SELECT health_status(x) FROM VALUES (90D), (89.9D), (40D), (1D) AS t(x)").collect()] == ["healthy", "degraded", "suspect", "bad"]
    samples = spark.createDataFrame([(1, v) for v in (10, 11, 11)] + [(2, 5)], "k int, v int")
    assert sorted(r["mean"] for r in report.oversample_mean(samples, [F.col("k")], "v").collect()) == [5, 10]
    assert sorted(r["mean"] for r in report.oversample_mean(samples, [F.col("k")], "v", half_up=True).collect()) == [5, 11]
