"""Registered queries of the stream operators over the test tables, with SQL that states the same results."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamcheck.config import MetricConfig, ValidatorConfig, deployed_config
from streamcheck.functions import parsing, rules
from streamcheck.jobs import sql
from streamcheck.jobs.datasets import (
    LINEITEM_RULES,
    KINDS,
    bench_readings,
    bench_sessions,
    event_config,
    event_readings,
    lineitem_readings,
    table,
)
from streamcheck.operators import asof, gauges, health, quarantine, report, serving, tier1
from streamcheck.operators.anchor import prior_anchors
from streamcheck.sources import csv, messages, store
from streamcheck.sources.latest import LatestTable
from streamcheck.storage import Scratch
from streamcheck.streaming.validate import join_sessions

Query = Callable[[SparkSession, str], DataFrame]
REGISTERED: dict[str, tuple[Query, str]] = {}


def query(text: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        REGISTERED[f.__name__] = (f, text)
        return f

    return register


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def busy_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tier1.with_rules(event_readings(spark, sf_dir, busy=True), event_config())


def verdicts(spark: SparkSession, sf_dir: str, busy: bool = False) -> DataFrame:
    return tier1.validate_readings(event_readings(spark, sf_dir, busy), event_config())


def judged_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts as a written table, for results that go over them more than once."""
    return tier1.validated_table(event_readings(spark, sf_dir), event_config())


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.score_at_last(judged_table(spark, sf_dir), event_config())


# ---- tier 1


@query(sql.verdicts(True) + "SELECT seq, value_range FROM marked")
def tier1_value_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return busy_rules(spark, sf_dir).select("seq", "value_range")


@query(sql.verdicts(True) + "SELECT seq, raw_range FROM marked")
def tier1_raw_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return busy_rules(spark, sf_dir).select("seq", "raw_range")


@query(sql.verdicts(True) + "SELECT seq, stuck_reading FROM marked WHERE metric <> 'view'")
def tier1_stuck_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return busy_rules(spark, sf_dir).where("metric <> 'view'").select("seq", "stuck_reading")


@query(sql.verdicts(True) + "SELECT seq, stuck_reading FROM marked WHERE metric = 'view'")
def tier1_stuck_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return busy_rules(spark, sf_dir).where("metric = 'view'").select("seq", "stuck_reading")


@query(sql.verdicts(True) + "SELECT seq, rate_of_change FROM marked")
def tier1_rate_of_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return busy_rules(spark, sf_dir).select("seq", "rate_of_change")


@query(sql.anchors("120.0") + "SELECT n.seq, p.av AS prior_anchor_value, p.at_us AS prior_anchor_us FROM numbered n LEFT JOIN anchors p ON p.source = n.source AND p.metric = n.metric AND p.rn = n.rn - 1")
def tier1_run_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings = event_readings(spark, sf_dir, busy=True).withColumn("tol", F.lit(120.0))
    return prior_anchors(readings).select("seq", "prior_anchor_value", "prior_anchor_us")


@query(sql.verdicts(True) + "SELECT seq, source, metric, value, raw_value, ts_us, quality, rule FROM v")
def tier1_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir, busy=True).select("seq", "source", "metric", "value", "raw_value", "ts_us", "quality", "rule")


@query(sql.verdicts(True) + "SELECT seq, source, metric, quality, rule FROM v")
def tier1_verdict_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdicts of five streams that are cut every thousand readings."""
    judged = tier1.validate_readings(event_readings(spark, sf_dir, busy=True), event_config(), chunk_rows=1000)
    return judged.select("seq", "source", "metric", "quality", "rule")


@query(sql.LINEITEM + "SELECT source, ts_us, seq, value, rule, quality FROM v")
def tier1_verdict_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = tier1.validate_readings(lineitem_readings(spark, sf_dir), ValidatorConfig(metrics={"quantity": LINEITEM_RULES}))
    return judged.select("source", "ts_us", "seq", "value", "rule", "quality")


@query(sql.verdicts(False) + "SELECT source, metric, policy, lo AS low, hi AS high, stuck_n AS stuck_count, count(*) AS n FROM marked GROUP BY ALL")
def config_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = tier1.resolve_config(event_readings(spark, sf_dir), event_config())
    return known.groupBy("source", "metric", "policy", F.col("cfg.low").alias("low"), F.col("cfg.high").alias("high"), F.col("cfg.stuck_count").alias("stuck_count")).agg(F.count("*").alias("n"))


# ---- reports


@query(sql.verdicts(False) + sql.QUALITY_COUNTS.format(keys="metric"))
def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.quality_counts(verdicts(spark, sf_dir), "metric"), "good_pct", "suspect_pct", "invalid_pct")


@query(sql.verdicts(False) + sql.QUALITY_COUNTS.format(keys="source, metric"))
def stream_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.quality_counts(verdicts(spark, sf_dir), "source", "metric"), "good_pct", "suspect_pct", "invalid_pct")


@query(sql.verdicts(False) + "SELECT metric, rule, count(*) AS n FROM v WHERE quality <> 'good' GROUP BY ALL")
def flagged_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.flagged_rules(verdicts(spark, sf_dir), "metric")


@query(sql.verdicts(False) + "SELECT ts_us, source, metric, value, quality, rule FROM v WHERE quality <> 'good'")
def flagged_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.flagged_readings(verdicts(spark, sf_dir)).drop("reason")


@query(sql.verdicts(False) + sql.HEALTH_LAST + sql.METRIC_REPORT)
def metric_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, config = judged_table(spark, sf_dir), event_config()
    scored = health.score_at_last(judged, config)
    out = report.metric_report(judged, scored, quarantine.quarantine_history(scored, config, "computed_us"))
    text = F.array_join(F.transform(F.map_entries("flagged_rules"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("metric", "total", "good", "suspect", "invalid", "first_us", "last_us", "duration_s", F.array_join("sources", ",").alias("sources"), text.alias("flagged"), F.col("health.source").alias("worst_source"), F.round("health.overall", 6).alias("worst_score"), "quarantined", "quarantine_events")


# ---- tier 2


SIGNALS = ["overall", "quality_rate", "reporting_cadence", "drift", "variance_ratio", "recency"]


@query(sql.verdicts(False) + sql.HEALTH_LAST + "SELECT source, metric, round(overall, 6) AS overall, round(quality_rate, 6) AS quality_rate, round(reporting_cadence, 6) AS reporting_cadence, round(drift, 6) AS drift, round(variance_ratio, 6) AS variance_ratio, round(recency, 6) AS recency, recent AS readings_in_window, last_good_us FROM health")
def health_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(scores(spark, sf_dir), *SIGNALS).drop("computed_us")


@query(sql.verdicts(False) + sql.health("SELECT metric, 1705500000000000 AS now FROM v GROUP BY metric") + "SELECT source, metric, round(overall, 6) AS overall, recent AS readings_in_window FROM health")
def health_score_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = 1_705_500_000_000_000
    judged = verdicts(spark, sf_dir)
    return rounded(health.score_health(judged, event_config(), F.lit(now)), "overall").select("source", "metric", "overall", "readings_in_window")


@query(sql.verdicts(False) + sql.HEALTH_LAST + "SELECT source, metric, round(overall, 6) AS overall, CASE WHEN overall >= 90 THEN 'healthy' WHEN overall >= 70 THEN 'degraded' WHEN overall >= 40 THEN 'suspect' ELSE 'bad' END AS status FROM health")
def health_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(health.health_listing(scores(spark, sf_dir)), "overall").select("source", "metric", "overall", "status")


@query(sql.verdicts(False) + sql.HEALTH_LAST + "SELECT metric, arg_min(source, (overall, source)) AS source, round(min(overall), 6) AS overall, count(*) AS streams FROM health GROUP BY metric")
def worst_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(health.worst_source(scores(spark, sf_dir)), "overall")


@query(sql.verdicts(False) + sql.HEALTH_LAST + "SELECT metric, round(avg(overall), 6) AS overall, count(*) AS streams FROM health GROUP BY metric")
def health_by_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(health.average_by_metric(scores(spark, sf_dir)), "overall")


@query(sql.verdicts(False) + sql.HEALTH_LAST + "SELECT DISTINCT source, metric FROM health")
def scored_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.scored_streams(scores(spark, sf_dir))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.health_history(judged_table(spark, sf_dir), event_config(), sql.GRID_START, sql.GRID_END, sql.GRID_STEP)


@query(sql.verdicts(False) + sql.HEALTH_TICKS + "SELECT source, metric, tick_us, round(overall, 5) AS overall, round(drift, 5) AS drift, round(variance_ratio, 5) AS variance_ratio, recent AS readings_in_window, last_good_us FROM health")
def health_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = history(spark, sf_dir).withColumns({c: F.round(c, 5) for c in ("overall", "drift", "variance_ratio")})
    return out.select("source", "metric", "tick_us", "overall", "drift", "variance_ratio", "readings_in_window", "last_good_us")


# ---- tier 3


def quarantine_config() -> ValidatorConfig:
    base = event_config()
    return ValidatorConfig(base.metrics, base.groups, recent_window=base.recent_window, bad_threshold=sql.BAD, recovery_threshold=sql.RECOVERY, consecutive=2)


def quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine.quarantine_history(history(spark, sf_dir).select("source", "metric", "tick_us", "overall"), quarantine_config())


@query(sql.verdicts(False) + sql.HEALTH_TICKS + sql.QUARANTINE + "SELECT source, metric, tick_us, q AS is_quarantined, q_us AS quarantined_us, bad AS consecutive_bad, rec AS consecutive_recovery, transition FROM machine")
def quarantine_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantined(spark, sf_dir).select("source", "metric", "tick_us", "is_quarantined", "quarantined_us", F.col("consecutive_bad").cast("int").alias("consecutive_bad"), F.col("consecutive_recovery").cast("int").alias("consecutive_recovery"), "transition")


@query(sql.verdicts(False) + sql.HEALTH_TICKS + sql.QUARANTINE + "SELECT source, metric, tick_us, 'Health score below 60 for 60+ seconds' AS reason FROM machine WHERE q")
def quarantine_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantined(spark, sf_dir).where("is_quarantined").select("source", "metric", "tick_us", F.col("quarantine_reason").alias("reason"))


@query(sql.verdicts(False) + sql.HEALTH_TICKS + sql.QUARANTINE + "SELECT source, metric, count(*) FILTER (WHERE transition = 'entered') AS entered, count(*) FILTER (WHERE transition = 'recovered') AS recovered, count(*) FILTER (WHERE q) AS ticks_quarantined, count(*) AS ticks FROM machine GROUP BY ALL")
def quarantine_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine.quarantine_events(quarantined(spark, sf_dir))


@query(sql.verdicts(False) + sql.HEALTH_TICKS + sql.QUARANTINE + "SELECT source, metric, arg_max(q_us, tick_us) AS quarantined_us, round(arg_max(overall, tick_us), 5) AS score FROM machine GROUP BY ALL HAVING arg_max(q, tick_us)")
def quarantine_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = quarantined(spark, sf_dir)
    latest = told.groupBy("source", "metric").agg(F.max_by("overall", "tick_us").alias("overall"))
    return quarantine.quarantine_current(told, latest).withColumn("score", F.round("score", 5))


@query(sql.verdicts(False) + sql.HEALTH_TICKS + sql.QUARANTINE + "SELECT count(*) AS total_active, count(*) FILTER (WHERE q) AS total_quarantined FROM (SELECT arg_max(q, tick_us) AS q FROM machine GROUP BY source, metric)")
def quarantine_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quarantine.quarantine_totals(quarantined(spark, sf_dir))


# ---- joins in time


@query(sql.readings(False) + sql.RAW_PAIRING)
def raw_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = asof.raw_pairing(event_readings(spark, sf_dir), "click", "view", 3_600_000_000)
    return out.select("seq", "source", "value", "raw_value")


@query(sql.SESSIONS + "SELECT r.seq, r.unit, r.ts_us, s.id AS session_id, s.batch_label FROM bench r LEFT JOIN LATERAL (SELECT id, batch_label FROM log WHERE log.unit = r.unit AND started_us <= r.ts_us ORDER BY started_us DESC, id DESC LIMIT 1) s ON true")
def session_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = asof.session_asof(bench_readings(spark, sf_dir), bench_sessions(spark, sf_dir))
    return out.select("seq", "unit", "ts_us", F.col("session.id").alias("session_id"), F.col("session.batch_label").alias("batch_label"))


@query(sql.SESSIONS + sql.IN_SESSION + "SELECT unit, batch_label, started_us, count(*) AS n, round(avg(value), 6) AS mean, min(value) AS low, max(value) AS high FROM joined WHERE quality <> 'invalid' GROUP BY ALL")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.batch_summary(asof.in_session(bench_readings(spark, sf_dir), bench_sessions(spark, sf_dir))), "mean")


@query(sql.SESSIONS + sql.IN_SESSION + "SELECT unit, batch_label, started_us, count(*) AS n, round(avg(value), 6) AS mean, round(max(value) - min(value), 6) AS peak_to_peak, count(*) FILTER (WHERE quality = 'suspect') AS suspect_rows FROM joined WHERE quality <> 'invalid' GROUP BY ALL")
def noise_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(report.noise_floor(asof.in_session(bench_readings(spark, sf_dir), bench_sessions(spark, sf_dir))), "mean", "peak_to_peak")


# ---- serving and monitoring


@query(sql.verdicts(False) + "SELECT split_part(source, '/', 1) AS zone, split_part(source, '/', 2) AS zone_id, metric, max(seq) AS seq, arg_max(value, seq) AS value, arg_max(ts_us, seq) AS ts_us, arg_max(quality, seq) AS quality FROM v GROUP BY source, metric")
def sensors_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.sensors_latest(verdicts(spark, sf_dir))


@query(sql.verdicts(False) + "SELECT source, metric, max(seq) AS seq, arg_max(value, seq) AS value, arg_max(ts_us, seq) AS ts_us, arg_max(quality, seq) AS quality FROM v GROUP BY source, metric")
def latest_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest reading of each stream after four batches of a table that they keep up to date."""
    judged = judged_table(spark, sf_dir)
    kept = LatestTable(spark, Scratch(spark, "latest").path("table"))
    for epoch in range(4):
        kept.update(judged.where(F.pmod(F.xxhash64("seq"), F.lit(4)) == epoch), epoch)
    return kept.read()


@query(sql.readings(False) + "SELECT seq, ts_us, value FROM readings WHERE source = 'site/1' AND metric = 'view' ORDER BY seq DESC LIMIT 1")
def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.stream_latest(event_readings(spark, sf_dir), "site/1", "view").select("seq", "ts_us", "value")


@query(sql.readings(False) + f"SELECT seq, ts_us, value FROM readings WHERE source = 'site/1' AND metric = 'view' AND ts_us >= {sql.NOW} - 86400000000 * 5")
def reading_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.reading_history(event_readings(spark, sf_dir), "site/1", "view", sql.NOW, hours=120).select("seq", "ts_us", "value")


@query(sql.verdicts(False) + "SELECT split_part(source, '/', 1) AS zone, split_part(source, '/', 2) AS zone_id, metric, quality, count(*) AS n FROM v GROUP BY ALL")
def readings_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.readings_total(verdicts(spark, sf_dir))


@query(sql.verdicts(False) + f"SELECT quality, count(*) AS n FROM v WHERE ts_us > {sql.NOW} - 86400000000 AND ts_us <= {sql.NOW} GROUP BY ALL")
def quality_24h(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.quality_window(verdicts(spark, sf_dir), sql.NOW)


@query(sql.verdicts(False) + "SELECT source, metric, quality, (ts_us // 30000000 + 1 + d) * 30000000 - CASE WHEN ts_us % 30000000 = 0 THEN 30000000 ELSE 0 END AS tick_us, count(*) / 300.0 AS per_second FROM v, range(0, 10) AS t(d) GROUP BY ALL")
def rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.reading_rate(verdicts(spark, sf_dir))


@query(sql.readings(False) + f"SELECT source, metric, floor(({sql.NOW} - max(ts_us)) / 1000) / 1000.0 AS age_s FROM readings GROUP BY ALL")
def last_reading_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.last_reading_age(event_readings(spark, sf_dir), sql.NOW)


@query(sql.readings(False) + f"SELECT * FROM (SELECT source, metric, floor(({sql.NOW} - max(ts_us)) / 1000) / 1000.0 AS age_s FROM readings GROUP BY ALL) WHERE age_s > 3600")
def outage_alert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serving.outages(event_readings(spark, sf_dir), sql.NOW, 3600.0)


def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauges.stale_gauge(judged_table(spark, sf_dir), sql.GRID_START, sql.GRID_END, 3_600_000_000, 4 * 3_600_000_000)


@query(sql.verdicts(False) + sql.STALE_GAUGE + "SELECT source, metric, tick_us, value, raw_value, round(age_s, 6) AS age_s FROM gauge")
def stale_gauge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stale(spark, sf_dir), "age_s")


@query(sql.verdicts(False) + sql.STALE_GAUGE + "SELECT tick_us, split_part(source, '/', 1) AS zone, split_part(source, '/', 2) AS zone_id, " + ", ".join(f"max(value) FILTER (WHERE metric = '{m}') AS \"{m}\"" for m in KINDS) + " FROM gauge GROUP BY ALL")
def gauge_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gauges.gauge_pivot(stale(spark, sf_dir), list(KINDS))


# ---- parsing


@query(sql.TOPICS)
def topic_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k")
    topic = F.when(F.col("event_type") == "view", F.concat(F.lit("garden/bed/"), k, F.lit("/moisture"))).when(F.col("event_type") == "click", F.concat(F.lit("charstation/"), k, F.lit("/raw_adc"))).when(F.col("event_type") == "error", F.concat(F.lit("garden/greenhouse/"), F.when(F.col("user_id") % 2 == 0, "humidity").otherwise("pressure"))).when(F.col("event_type") == "signup", F.lit("charstation/session")).otherwise(F.concat(F.lit("garden/bed/"), k, F.lit("/moisture_raw")))
    p = parsing.parse_topic(F.col("topic"))
    return e.select("event_id", topic.alias("topic")).select("event_id", parsing.route(F.col("topic")).alias("route"), p["zone"].alias("zone"), p["zone_id"].alias("zone_id"), p["metric"].alias("metric"))


@query("SELECT event_id, CASE WHEN event_id % 5 = 1 THEN epoch_us(ts) // 1000000 * 1000000 WHEN event_id % 5 = 2 THEN epoch_us(ts) // 1000 * 1000 WHEN event_id % 5 = 3 THEN epoch_us(date_trunc('day', ts)) WHEN event_id % 5 = 4 THEN epoch_us(ts) // 1000000 * 1000000 ELSE epoch_us(ts) END AS ts_us FROM events")
def timestamp_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    ntz, us = F.col("ts").cast("timestamp_ntz"), parsing.micros(e.schema, "ts")
    k = F.col("event_id") % 5
    text = F.when(k == 1, F.floor(us / 1_000_000).cast("string")).when(k == 2, F.floor(us / 1000).cast("string")).when(k == 3, F.date_format(ntz, "yyyy-MM-dd")).when(k == 4, F.date_format(ntz, "yyyy/MM/dd HH:mm:ss")).otherwise(F.concat(F.date_format(ntz, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")))
    return e.select("event_id", parsing.timestamp_micros(text).alias("ts_us"))


@query("SELECT event_type, count(*) AS cells, count(*) FILTER (WHERE user_id % 3 <> 0) AS numbers, count(*) FILTER (WHERE user_id % 3 = 0) AS skipped, round(sum(CASE WHEN user_id % 3 <> 0 THEN value END), 4) AS total FROM events GROUP BY ALL")
def numeric_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("user_id") % 3 == 0, F.concat(F.col("value").cast("string"), F.lit("d"))).otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
    n = parsing.number(text)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("cells"), F.count_if(n.isNotNull()).alias("numbers"), F.count_if(n.isNull()).alias("skipped"), F.round(F.sum(n), 4).alias("total"))


@query("SELECT event_id, round(least(greatest((2800 - value * 10) * 100.0 / (2800 - (1200 + user_id % 4)), 0.0), 100.0), 6) AS moisture FROM events")
def calibrate_moisture(spark: SparkSession, sf_dir: str) -> DataFrame:
    wet = F.lit(1200) + F.col("user_id") % 4
    return table(spark, sf_dir, "events").select("event_id", F.round(rules.calibrate_moisture(F.col("value") * 10, F.lit(2800), wet), 6).alias("moisture"))


@query("SELECT event_type, event_id // 16 AS reading, count(*) AS samples, (sum(k) + count(*) // 2) // count(*) AS mean FROM (SELECT event_type, event_id, TRY_CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM events) GROUP BY ALL")
def oversample_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return report.oversample_mean(e, [F.col("event_type"), F.floor(F.col("event_id") / 16).alias("reading")], "k", half_up=True)


# ---- sources, presets and tables


def messages_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as broker messages, a thousand times faster; payloads of every sixth user are no numbers."""
    e = table(spark, sf_dir, "events")
    k, kind, spoilt = F.get_json_object("props", "$.k"), F.col("event_type"), F.col("user_id") % 6 == 0
    topic = F.when(kind == "view", F.concat(F.lit("garden/bed/"), k, F.lit("/moisture"))).when(kind == "purchase", F.concat(F.lit("garden/bed/"), k, F.lit("/moisture_raw"))).when(kind == "click", F.concat(F.lit("charstation/"), k, F.lit("/raw_adc"))).otherwise("garden/greenhouse/humidity")
    payload = F.when(spoilt, "12d").when(kind == "purchase", F.floor("value").cast("string")).otherwise(F.concat(F.lit(" "), F.col("value").cast("string")))
    return e.select(topic.alias("topic"), payload.alias("payload"), F.floor(parsing.micros(e.schema, "ts") / 1000).alias("received_us"), F.col("event_id").alias("seq"))


@query(sql.MESSAGES)
def message_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.readings(messages_of(spark, sf_dir)).select("seq", "source", "metric", "value", "raw_value")


@query("SELECT event_type, count(*) FILTER (WHERE user_id % 6 = 0 AND (event_type <> 'click' OR TRY_CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INT) BETWEEN 1 AND 16)) AS rejected FROM events GROUP BY ALL")
def message_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = messages.numeric_readings(messages_of(spark, sf_dir)).select("seq", "rejected")
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type")
    return e.join(told, "seq", "left").groupBy("event_type").agg(F.count_if("rejected").alias("rejected"))


@query("SELECT event_id AS id, epoch_us(ts) AS started_us, CAST(user_id % 20 AS VARCHAR) AS unit_id, 'batch-' || (user_id % 9) AS batch_label, CASE WHEN user_id % 3 = 0 THEN user_id % 5 END AS insertion_number, user_id % 20 BETWEEN 1 AND 16 AS unit_known FROM events WHERE event_type = 'signup' AND user_id % 7 <> 0 AND user_id % 11 <> 0")
def session_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = table(spark, sf_dir, "events").where("event_type = 'signup'"), F.col("user_id")
    batch = F.when(u % 7 == 0, " ").otherwise(F.concat(F.lit("batch-"), (u % 9).cast("string")))
    insertion = F.when(u % 11 == 0, ',"insertion":"four"').when(u % 3 == 0, F.concat(F.lit(',"insertion":'), (u % 5).cast("string"))).otherwise("")
    payload = F.concat(F.lit('{"unit_id":'), F.when(u % 2 == 0, (u % 20).cast("string")).otherwise(F.concat(F.lit('"'), (u % 20).cast("string"), F.lit('"'))), F.lit(',"batch":"'), batch, F.lit('"'), insertion, F.lit("}"))
    log = messages.sessions(e.select(F.lit("charstation/session").alias("topic"), payload.alias("payload"), parsing.micros(e.schema, "ts").alias("received_us"), F.col("event_id").alias("seq")))
    path = Scratch(spark, "sessions").path("log")
    store.append_sessions(log, path)
    return spark.read.parquet(path).select("id", "started_us", "unit_id", "batch_label", "insertion_number", "unit_known")


@query("SELECT CASE WHEN user_id % 5 = 0 THEN 'default' ELSE 'u' || (user_id % 5) END AS source, m AS metric, count(*) AS cells, count(*) FILTER (WHERE m = 'value' AND user_id % 7 = 0) AS skipped, round(sum(CASE WHEN m = 'Level' THEN user_id WHEN user_id % 7 <> 0 THEN value END), 4) AS total, sum(CASE WHEN event_id % 3 <> 0 THEN user_id END)::BIGINT AS raw_total, min(epoch_us(ts)) AS first_us, max(epoch_us(ts)) AS last_us FROM events, (VALUES ('value'), ('Level')) AS t(m) GROUP BY ALL")
def csv_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = table(spark, sf_dir, "events"), F.col("user_id")
    iso = F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))
    cells = e.select(iso.alias("Time"), F.when(u % 5 == 0, " ").otherwise(F.concat(F.lit("u"), (u % 5).cast("string"))).alias(" sensor"), F.when(u % 7 == 0, "oops").otherwise(F.col("value").cast("string")).alias("value"), u.cast("string").alias("Level"), F.when(F.col("event_id") % 3 == 0, F.concat(u.cast("string"), F.lit(".0"))).otherwise(u.cast("string")).alias("adc"), F.concat(F.lit('say "x", '), F.col("event_type")).alias("note"))
    path = Scratch(spark, "csv").path("events")
    cells.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df = csv.read_csv(spark, path)
    roles = csv.detect_roles(df)
    out = csv.build_readings(df, roles, csv.choose_metrics(roles, None))
    return out.groupBy("source", "metric").agg(F.count("*").alias("cells"), F.count_if("skipped").alias("skipped"), F.round(F.sum("value"), 4).alias("total"), F.sum("raw_value").alias("raw_total"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


@query("SELECT seq, value, 1000000 + seq * 30000000 AS ts_us FROM (SELECT row_number() OVER (ORDER BY event_id) - 1 AS seq, value FROM events)")
def csv_synthetic_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "csv").path("values")
    table(spark, sf_dir, "events").repartitionByRange(8, "event_id").sortWithinPartitions("event_id").select("value").write.csv(path, header=True)
    df = csv.read_csv(spark, path)
    roles = csv.detect_roles(df)
    return csv.build_readings(df, roles, csv.choose_metrics(roles, "VALUE"), start_us=1_000_000, cadence_us=30_000_000).select("seq", "value", "ts_us")


@query(sql.verdicts(False) + "SELECT source, metric, seq, value, raw_value AS raw_adc, quality, quality = 'good' AS plain FROM v")
def stored_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "store").path("readings")
    store.append_readings(verdicts(spark, sf_dir), path)
    return store.read_readings(spark, path).select("source", "metric", "seq", "value", "raw_adc", "quality", F.col("validation_reason").isNull().alias("plain"))


@query(sql.verdicts(False) + "SELECT seq, source, metric, quality, rule FROM v")
def laid_out_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on a table in buckets of streams that two batches filled and a compaction put together: no shuffle."""
    scratch, name = Scratch(spark, "layout"), f"readings_{uuid.uuid4().hex}"
    readings = event_readings(spark, sf_dir)
    for half in (0, 1):
        store.lay_out(readings.where(F.pmod(F.xxhash64("seq"), F.lit(2)) == half), name, scratch.path("batches"), buckets=16)
    store.compact_layout(spark, name, scratch.path("compacted"))
    return tier1.validate_readings(spark.table(name), event_config()).select("seq", "source", "metric", "quality", "rule")


@query(sql.verdicts(False) + "SELECT metric, count(*) AS total, count(*) FILTER (WHERE quality = 'good') AS good, count(*) FILTER (WHERE rule = 'rate_of_change') AS rates FROM v GROUP BY metric")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = store.report_json(report.metric_report(verdicts(spark, sf_dir)))
    return lines.select(F.get_json_object("json", "$.metric").alias("metric"), *(F.coalesce(F.get_json_object("json", f"$.{path}").cast("bigint"), F.lit(0)).alias(name) for path, name in (("total", "total"), ("good", "good"), ("flagged_rules.rate_of_change", "rates"))))


@query(sql.verdicts(False) + sql.REASONS)
def reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(spark, sf_dir).where("quality <> 'good'").select("seq", "rule", "reason")


@query("SELECT event_type AS metric, CASE WHEN event_type = 'click' AND value > 100 THEN 'invalid' ELSE 'good' END AS quality, count(*) AS n FROM events GROUP BY ALL")
def unknown_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = ValidatorConfig(metrics={"click": MetricConfig(high=100.0, stuck_count=10**9)})
    return tier1.validate_readings(event_readings(spark, sf_dir), config).groupBy("metric", "quality").agg(F.count("*").alias("n"))


NAMES = {"view": "Temperature", "click": "humidity", "purchase": "moisture", "error": "raw_adc", "signup": "temperature"}


def renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in NAMES.items() for x in pair])
    zone = F.when(F.col("metric") == "error", "charstation/1").otherwise(F.col("source"))
    return event_readings(spark, sf_dir).withColumns({"source": zone, "metric": names[F.col("metric")]})


@query("SELECT CASE event_type WHEN 'view' THEN 'Temperature' WHEN 'click' THEN 'humidity' WHEN 'purchase' THEN 'moisture' WHEN 'error' THEN 'raw_adc' ELSE 'temperature' END AS metric, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'duration' ELSE 'count' END AS stuck_mode, CASE WHEN event_type IN ('view', 'click', 'signup') THEN 0.1 ELSE 0.01 END::DOUBLE AS stuck_tolerance, count(*) AS n FROM events GROUP BY ALL")
def stuck_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = ValidatorConfig(metrics={m: MetricConfig().with_stuck_defaults_for(m) for m in NAMES.values()})
    known = tier1.resolve_config(renamed(spark, sf_dir), config)
    return known.groupBy("metric", F.col("cfg.stuck_mode").alias("stuck_mode"), F.col("cfg.stuck_tolerance").alias("stuck_tolerance")).agg(F.count("*").alias("n"))


@query(sql.DEPLOYED)
def deployed_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = tier1.with_rules(renamed(spark, sf_dir), deployed_config())
    return marked.groupBy("metric", "policy", F.col("cfg.cadence").alias("cadence_us")).agg(F.count("*").alias("n"), F.count_if("value_range").alias("out"), F.count_if("raw_range").alias("raw_out"), F.count_if("rate_of_change").alias("rates"))


@query("SELECT event_id AS seq, round(value / 7 + 0.0013, 1) AS value FROM events WHERE user_id % 9 <> 0")
def usable_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.when(F.col("user_id") % 9 == 0, float("nan")).otherwise(F.col("value") / 7 + 0.0013)
    return serving.usable_samples(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), failed.alias("value")))


@query("SELECT CASE event_type WHEN 'view' THEN 'moisture' ELSE event_type END AS metric, count(*) AS n FROM events WHERE event_type <> 'purchase' GROUP BY ALL")
def dashboard_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    metric = F.when(F.col("metric") == "view", "moisture").when(F.col("metric") == "purchase", "moisture_raw").otherwise(F.col("metric"))
    return serving.dashboard_readings(event_readings(spark, sf_dir).withColumn("metric", metric)).groupBy("metric").agg(F.count("*").alias("n"))


@query(sql.SESSIONS + "SELECT r.seq, s.id AS session_id, s.batch_label FROM bench r LEFT JOIN LATERAL (SELECT id, batch_label FROM log WHERE log.unit = r.unit AND started_us <= r.ts_us ORDER BY started_us DESC, id DESC LIMIT 1) s ON true")
def session_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small blocks, so that units have several."""
    out = asof.session_lookup(bench_readings(spark, sf_dir), bench_sessions(spark, sf_dir), size=8)
    return out.select("seq", F.col("session.id").alias("session_id"), F.col("session.batch_label").alias("batch_label"))


@query(sql.SESSIONS + "SELECT r.seq, s.id AS session_id FROM bench r LEFT JOIN LATERAL (SELECT id FROM log WHERE log.unit = r.unit AND started_us <= r.ts_us ORDER BY started_us DESC, id DESC LIMIT 1) s ON true")
def session_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_sessions(bench_readings(spark, sf_dir), bench_sessions(spark, sf_dir)).select("seq", F.col("session.id").alias("session_id"))


def queries() -> dict[str, Query]:
    return {name: f for name, (f, _) in REGISTERED.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text for name, (_, text) in REGISTERED.items()}
