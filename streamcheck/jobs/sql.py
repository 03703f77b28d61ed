"""DuckDB SQL that states the registered queries' results over the same tables."""

from __future__ import annotations

GRID_START, GRID_END, GRID_STEP = 1_704_067_200_000_000, 1_706_659_200_000_000, 6 * 3_600_000_000
NOW = 1_706_659_200_000_000
RECENT, BASELINE = 6 * 3_600_000_000, 7 * 86_400_000_000
BAD, RECOVERY = 60.0, 75.0

SOURCE = {
    False: "CASE WHEN user_id % 4 = 0 THEN 'bench/' ELSE 'site/' END || (user_id % 4)",
    True: "'site/all'",
}


def readings(busy: bool, recursive: bool = False) -> str:
    return f"""WITH {"RECURSIVE " if recursive else ""}readings AS (
  SELECT {SOURCE[busy]} AS source, event_type AS metric, value, epoch_us(ts) AS ts_us,
         TRY_CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS raw_value, event_id AS seq
  FROM events) """


def anchors(tolerance: str, busy: bool = True) -> str:
    return readings(busy, recursive=True) + f""", numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source, metric ORDER BY ts_us, seq) AS rn FROM readings
), anchors AS (
  SELECT source, metric, rn, value AS av, ts_us AS at_us FROM numbered WHERE rn = 1
  UNION ALL
  SELECT n.source, n.metric, n.rn,
         CASE WHEN abs(n.value - a.av) <= {tolerance} THEN a.av ELSE n.value END,
         CASE WHEN abs(n.value - a.av) <= {tolerance} THEN a.at_us ELSE n.ts_us END
  FROM anchors a JOIN numbered n ON n.source = a.source AND n.metric = a.metric AND n.rn = a.rn + 1
) """


def verdicts(busy: bool) -> str:
    """CTEs ``marked`` (a column per rule) and ``v`` (quality and rule)."""
    return anchors("60.0", busy) + """, c AS (
  SELECT n.*, CASE WHEN source LIKE 'bench/%' THEN 'tier1_only' ELSE 'full' END AS policy,
         CASE WHEN source LIKE 'bench/%' AND metric = 'error' THEN 'own' WHEN metric = 'view' THEN 'slow' ELSE 'rules' END AS kind
  FROM numbered n
), k AS (
  SELECT c.*, CASE kind WHEN 'own' THEN 5.0 ELSE 0.5 END AS lo, CASE kind WHEN 'own' THEN 50.0 WHEN 'slow' THEN 300.0 ELSE 200.0 END AS hi,
         CASE kind WHEN 'own' THEN 1000 WHEN 'slow' THEN 6 ELSE 3 END AS stuck_n
  FROM c
), w AS (
  SELECT k.*, lag(value) OVER s AS lv, lag(ts_us) OVER s AS lt,
         count(*) OVER (s ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS n2,
         min(value) OVER (s ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS lo2,
         max(value) OVER (s ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS hi2,
         count(*) OVER (s ROWS BETWEEN 999 PRECEDING AND 1 PRECEDING) AS n999,
         min(value) OVER (s ROWS BETWEEN 999 PRECEDING AND 1 PRECEDING) AS lo999,
         max(value) OVER (s ROWS BETWEEN 999 PRECEDING AND 1 PRECEDING) AS hi999
  FROM k WINDOW s AS (PARTITION BY source, metric ORDER BY ts_us, seq)
), marked AS (
  SELECT w.*, value < lo OR value > hi AS value_range,
         coalesce(kind = 'rules' AND (raw_value < 2 OR raw_value > 97), false) AS raw_range,
         CASE kind
           WHEN 'slow' THEN p.at_us IS NOT NULL AND abs(w.value - p.av) <= 60 AND w.ts_us - p.at_us >= 2400000000
           WHEN 'own' THEN n999 >= 999 AND hi999 - value <= 0.01 AND value - lo999 <= 0.01
           ELSE n2 >= 2 AND hi2 - value <= 5 AND value - lo2 <= 5 END AS stuck_reading,
         coalesce(kind <> 'own' AND ts_us - lt >= 1000000 AND ts_us - lt <= 1800000000 AND abs(value - lv) > 100, false) AS rate_of_change
  FROM w LEFT JOIN anchors p ON p.source = w.source AND p.metric = w.metric AND p.rn = w.rn - 1
), v AS (
  SELECT *, CASE WHEN rule = '' THEN 'good' WHEN rule IN ('value_range', 'raw_range') THEN 'invalid' ELSE 'suspect' END AS quality
  FROM (SELECT *, CASE WHEN value_range THEN 'value_range' WHEN raw_range THEN 'raw_range' WHEN stuck_reading THEN 'stuck_reading' WHEN rate_of_change THEN 'rate_of_change' ELSE '' END AS rule FROM marked)
) """


LINEITEM = """WITH r AS (
  SELECT 'supp/' || l_suppkey AS source, l_quantity AS value, epoch_us(l_shipdate) AS ts_us, l_orderkey * 10 + l_linenumber AS seq FROM lineitem
), w AS (
  SELECT *, lag(value) OVER s AS lv, lag(ts_us) OVER s AS lt, count(*) OVER b AS n2, min(value) OVER b AS lo2, max(value) OVER b AS hi2
  FROM r WINDOW s AS (PARTITION BY source ORDER BY ts_us, seq), b AS (PARTITION BY source ORDER BY ts_us, seq ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)
), v AS (
  SELECT *, CASE WHEN rule = '' THEN 'good' WHEN rule = 'value_range' THEN 'invalid' ELSE 'suspect' END AS quality
  FROM (SELECT *, CASE WHEN value < 2 OR value > 49 THEN 'value_range'
                       WHEN n2 >= 2 AND hi2 - value <= 3 AND value - lo2 <= 3 THEN 'stuck_reading'
                       WHEN ts_us - lt >= 1000000 AND ts_us - lt <= 172800000000 AND abs(value - lv) > 30 THEN 'rate_of_change' ELSE '' END AS rule FROM w)
) """

QUALITY_COUNTS = """SELECT {keys}, count(*) AS total, count(*) FILTER (WHERE quality = 'good') AS good,
  count(*) FILTER (WHERE quality = 'suspect') AS suspect, count(*) FILTER (WHERE quality = 'invalid') AS invalid,
  round(count(*) FILTER (WHERE quality = 'good') * 100.0 / count(*), 6) AS good_pct,
  round(count(*) FILTER (WHERE quality = 'suspect') * 100.0 / count(*), 6) AS suspect_pct,
  round(count(*) FILTER (WHERE quality = 'invalid') * 100.0 / count(*), 6) AS invalid_pct
FROM v GROUP BY ALL"""

SIGNALS = """, signals AS (
  SELECT *, CASE WHEN recent > 0 THEN good::DOUBLE / recent ELSE 0.0 END AS quality_rate,
    least(1.0, recent::DOUBLE / greatest(1, 21600 // 1200)) AS reporting_cadence,
    CASE WHEN base >= 30 AND good > 0 AND sd_base > 0 THEN greatest(0.0, 1 - least(1.0, abs(mean_recent - mean_base) / sd_base / 3)) ELSE 1.0 END AS drift,
    CASE WHEN base >= 30 AND good > 0 AND sd_base > 0 THEN
      CASE WHEN sd_recent / sd_base < 0.5 THEN sd_recent / sd_base / 0.5 WHEN sd_recent / sd_base > 2 THEN 2 / (sd_recent / sd_base) ELSE 1.0 END ELSE 1.0 END AS variance_ratio,
    CASE WHEN last_good_us IS NULL THEN 0.0 ELSE greatest(0.0, 1 - least(1.0, greatest(0, (now - last_good_us) // 1000000) / 600.0)) END AS recency
  FROM sums
), health AS (
  SELECT *, (0.35 * quality_rate + 0.25 * reporting_cadence + 0.20 * drift + 0.10 * variance_ratio + 0.10 * recency) * 100 AS overall FROM signals
) """


def _sums(source: str, key: str, upper: str = "") -> str:
    recent, base = f"ts_us >= now - {RECENT}{upper}", f"ts_us >= now - {BASELINE}{upper}"
    good = "quality = 'good'"
    return f"""sums AS (
  SELECT source, metric, {key}, count(*) FILTER (WHERE {recent}) AS recent, count(*) FILTER (WHERE {recent} AND {good}) AS good,
    count(*) FILTER (WHERE {base} AND {good}) AS base, avg(value) FILTER (WHERE {recent} AND {good}) AS mean_recent, avg(value) FILTER (WHERE {base} AND {good}) AS mean_base,
    coalesce(stddev_samp(value) FILTER (WHERE {recent} AND {good}), 0) AS sd_recent, coalesce(stddev_samp(value) FILTER (WHERE {base} AND {good}), 0) AS sd_base,
    max(ts_us) FILTER (WHERE {recent} AND {good}) AS last_good_us
  FROM {source} GROUP BY ALL
)"""


def health(now: str) -> str:
    """CTE ``health`` of every full-policy stream at the ``now`` of its metric."""
    return f", nows AS ({now}), " + _sums("v JOIN nows USING (metric) WHERE policy = 'full'", "now") + SIGNALS


HEALTH_LAST = health("SELECT metric, max(ts_us) AS now FROM v GROUP BY metric")

HEALTH_TICKS = (
    f""", firsts AS (SELECT source, metric, min(ts_us) AS first_us FROM v WHERE policy = 'full' GROUP BY ALL),
ticks AS (SELECT source, metric, t AS now FROM firsts, range({GRID_START}, {GRID_END} + 1, {GRID_STEP}) AS g(t) WHERE t >= first_us), """
    + _sums(f"(SELECT t.source, t.metric, t.now, v.ts_us, v.value, v.quality FROM ticks t LEFT JOIN v ON v.source = t.source AND v.metric = t.metric AND v.ts_us <= t.now AND v.ts_us >= t.now - {BASELINE})", "now, now AS tick_us")
    + SIGNALS
)

QUARANTINE = f""", steps AS (SELECT source, metric, tick_us, overall, row_number() OVER (PARTITION BY source, metric ORDER BY tick_us) AS step FROM health),
machine AS (
  SELECT source, metric, tick_us, overall, step, false AS q, CAST(NULL AS BIGINT) AS q_us, CASE WHEN overall < {BAD} THEN 1 ELSE 0 END AS bad, 0 AS rec, 'unchanged' AS transition FROM steps WHERE step = 1
  UNION ALL
  SELECT s.source, s.metric, s.tick_us, s.overall, s.step,
    CASE WHEN NOT m.q THEN s.overall < {BAD} AND m.bad + 1 >= 2 ELSE NOT (s.overall >= {RECOVERY} AND m.rec + 1 >= 2) END,
    CASE WHEN NOT m.q THEN CASE WHEN s.overall < {BAD} AND m.bad + 1 >= 2 THEN s.tick_us END ELSE CASE WHEN NOT (s.overall >= {RECOVERY} AND m.rec + 1 >= 2) THEN m.q_us END END,
    CASE WHEN NOT m.q THEN CASE WHEN s.overall < {BAD} THEN m.bad + 1 ELSE 0 END ELSE CASE WHEN s.overall >= {RECOVERY} THEN 0 ELSE m.bad END END,
    CASE WHEN NOT m.q THEN CASE WHEN s.overall < {BAD} THEN 0 ELSE m.rec END WHEN s.overall >= {RECOVERY} THEN CASE WHEN m.rec + 1 >= 2 THEN 0 ELSE m.rec + 1 END ELSE 0 END,
    CASE WHEN NOT m.q THEN CASE WHEN s.overall < {BAD} AND m.bad + 1 >= 2 THEN 'entered' ELSE 'unchanged' END ELSE CASE WHEN s.overall >= {RECOVERY} AND m.rec + 1 >= 2 THEN 'recovered' ELSE 'unchanged' END END
  FROM machine m JOIN steps s ON s.source = m.source AND s.metric = m.metric AND s.step = m.step + 1
) """

METRIC_REPORT = """SELECT m.metric, m.total, m.good, m.suspect, m.invalid, m.first_us, m.last_us, (m.last_us - m.first_us) // 1000000 AS duration_s, m.sources, f.flagged,
  h.source AS worst_source, round(h.overall, 6) AS worst_score, q.quarantined, 0 AS quarantine_events
FROM (SELECT metric, count(*) AS total, count(*) FILTER (WHERE quality = 'good') AS good, count(*) FILTER (WHERE quality = 'suspect') AS suspect, count(*) FILTER (WHERE quality = 'invalid') AS invalid,
        min(ts_us) AS first_us, max(ts_us) AS last_us, string_agg(DISTINCT source, ',' ORDER BY source) AS sources FROM v GROUP BY metric) m
LEFT JOIN (SELECT metric, string_agg(rule || '=' || n, ',' ORDER BY rule) AS flagged FROM (SELECT metric, rule, count(*) AS n FROM v WHERE quality <> 'good' GROUP BY ALL) GROUP BY metric) f ON f.metric = m.metric
LEFT JOIN (SELECT metric, arg_min(source, (overall, source)) AS source, min(overall) AS overall FROM health GROUP BY metric) h ON h.metric = m.metric
LEFT JOIN (SELECT metric, 0 AS quarantined FROM health GROUP BY metric) q ON q.metric = m.metric"""

RAW_PAIRING = """SELECT seq, source, value, CASE WHEN lm = 'view' AND (ts_us - lt) // 1000000 < 3600 THEN TRY_CAST(trunc(lv) AS BIGINT) END AS raw_value
FROM (SELECT *, lag(metric) OVER s AS lm, lag(value) OVER s AS lv, lag(ts_us) OVER s AS lt FROM readings WHERE metric IN ('click', 'view') WINDOW s AS (PARTITION BY source ORDER BY ts_us, seq))
WHERE metric = 'click'"""

SESSIONS = """WITH bench AS (
  SELECT CAST(user_id % 16 + 1 AS VARCHAR) AS unit, value, epoch_us(ts) AS ts_us, event_id AS seq, CASE WHEN value > 400 THEN 'invalid' WHEN value > 300 THEN 'suspect' ELSE 'good' END AS quality
  FROM events WHERE event_type <> 'signup'
), log AS (
  SELECT CAST(user_id % 16 + 1 AS VARCHAR) AS unit, event_id AS id, epoch_us(ts) AS started_us, 'batch-' || regexp_extract(props, '"k": *([0-9]+)', 1) AS batch_label
  FROM events WHERE event_type = 'signup'
) """

IN_SESSION = """, joined AS (
  SELECT r.*, s.batch_label, s.started_us FROM bench r, LATERAL (SELECT batch_label, started_us FROM log WHERE log.unit = r.unit AND started_us <= r.ts_us ORDER BY started_us DESC, id DESC LIMIT 1) s
) """

STALE_GAUGE = f""", grid AS (
  SELECT source, metric, t AS tick_us FROM (SELECT source, metric, min(ts_us) AS first_us FROM v GROUP BY ALL), range({GRID_START}, {GRID_END} + 1, 3600000000) AS g(t) WHERE t >= first_us
), seen AS (
  SELECT g.*, a.ts_us AS last_us, b.ts_us AS good_us, b.value AS good_value, b.raw_value AS good_raw
  FROM grid g
  ASOF LEFT JOIN (SELECT source, metric, ts_us FROM v) a ON a.source = g.source AND a.metric = g.metric AND a.ts_us <= g.tick_us
  ASOF LEFT JOIN (SELECT source, metric, ts_us, value, raw_value FROM v WHERE quality = 'good') b ON b.source = g.source AND b.metric = g.metric AND b.ts_us <= g.tick_us
), removed AS (
  SELECT *, max(CASE WHEN tick_us - last_us > 14400000000 THEN tick_us END) OVER (PARTITION BY source, metric ORDER BY tick_us) AS removed_us FROM seen
), gauge AS (
  SELECT source, metric, tick_us, CASE WHEN removed_us IS NULL OR good_us > removed_us THEN good_value END AS value,
         CASE WHEN removed_us IS NULL OR good_us > removed_us THEN good_raw END AS raw_value, (tick_us - last_us) / 1e6 AS age_s
  FROM removed
) """

TOPICS = """WITH t AS (
  SELECT event_id, event_type, user_id, regexp_extract(props, '"k": *([0-9]+)', 1) AS k FROM events
)
SELECT event_id,
  CASE event_type WHEN 'view' THEN 'reading' WHEN 'click' THEN CASE WHEN CAST(k AS INT) BETWEEN 1 AND 16 THEN 'reading' ELSE 'unrecognised' END
    WHEN 'error' THEN CASE WHEN user_id % 2 = 0 THEN 'reading' ELSE 'unrecognised' END WHEN 'signup' THEN 'session' ELSE 'raw' END AS route,
  CASE WHEN event_type IN ('view', 'purchase') THEN 'bed' WHEN event_type = 'click' AND CAST(k AS INT) BETWEEN 1 AND 16 THEN 'charstation' WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'greenhouse' END AS zone,
  CASE WHEN event_type IN ('view', 'purchase') THEN k WHEN event_type = 'click' AND CAST(k AS INT) BETWEEN 1 AND 16 THEN k WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'greenhouse' END AS zone_id,
  CASE WHEN event_type = 'view' THEN 'moisture' WHEN event_type = 'purchase' THEN 'moisture_raw' WHEN event_type = 'click' AND CAST(k AS INT) BETWEEN 1 AND 16 THEN 'raw_adc' WHEN event_type = 'error' AND user_id % 2 = 0 THEN 'humidity' END AS metric
FROM t"""


MESSAGES = """WITH m AS (
  SELECT event_id AS seq, event_type, value, epoch_us(ts) // 1000 AS ts_us, user_id % 6 = 0 AS spoilt, regexp_extract(props, '"k": *([0-9]+)', 1) AS k FROM events
), r AS (
  SELECT *, CASE WHEN event_type IN ('view', 'purchase') THEN 'bed/' || k WHEN event_type = 'click' THEN 'charstation/' || k ELSE 'greenhouse/greenhouse' END AS source,
    CASE event_type WHEN 'view' THEN 'moisture' WHEN 'purchase' THEN 'moisture_raw' WHEN 'click' THEN 'raw_adc' ELSE 'humidity' END AS metric
  FROM m WHERE NOT spoilt AND (event_type <> 'click' OR CAST(k AS INT) BETWEEN 1 AND 16)
), p AS (
  SELECT *, lag(metric) OVER s AS lm, lag(value) OVER s AS lv, lag(ts_us) OVER s AS lt FROM r WHERE metric IN ('moisture', 'moisture_raw') WINDOW s AS (PARTITION BY source ORDER BY ts_us, seq)
)
SELECT seq, source, metric, value, CASE WHEN lm = 'moisture_raw' AND (ts_us - lt) // 1000000 < 30 THEN CAST(floor(lv) AS BIGINT) END AS raw_value FROM p WHERE metric = 'moisture'
UNION ALL
SELECT seq, source, metric, value, CASE WHEN metric = 'raw_adc' THEN CAST(round(value) AS BIGINT) END FROM r WHERE metric NOT IN ('moisture', 'moisture_raw')"""

# Bounds and tolerances are printed as the shortest digits that tell them: 200, 0.5, 0.01.
REASONS = """SELECT v.seq, rule, CASE rule
    WHEN 'value_range' THEN printf('%s = %.2f outside plausible range [%s, %s]', v.metric, v.value, CASE kind WHEN 'own' THEN '5' ELSE '0.5' END, CASE kind WHEN 'own' THEN '50' WHEN 'slow' THEN '300' ELSE '200' END)
    WHEN 'raw_range' THEN printf('raw value = %d outside plausible range [2, 97]', v.raw_value)
    WHEN 'stuck_reading' THEN CASE kind
      WHEN 'slow' THEN printf('value unchanged (%.2f ±60) for %d min — source may be stuck', v.value, (v.ts_us - p.at_us) // 60000000)
      ELSE printf('%d consecutive readings within %s of %.2f — source may be stuck', stuck_n, CASE kind WHEN 'own' THEN '0.01' ELSE '5' END, v.value) END
    ELSE printf('%s changed by %.2f in %ds (threshold 100.00/1800s)', v.metric, abs(v.value - lv), (v.ts_us - lt) // 1000000) END AS reason
FROM v LEFT JOIN anchors p ON p.source = v.source AND p.metric = v.metric AND p.rn = v.rn - 1 WHERE quality <> 'good'"""

DEPLOYED = """WITH r AS (
  SELECT CASE WHEN event_type = 'error' THEN 'charstation/1' WHEN user_id % 4 = 0 THEN 'bench/0' ELSE 'site/' || (user_id % 4) END AS source,
    CASE event_type WHEN 'view' THEN 'Temperature' WHEN 'click' THEN 'humidity' WHEN 'purchase' THEN 'moisture' WHEN 'error' THEN 'raw_adc' ELSE 'temperature' END AS metric,
    value, epoch_us(ts) AS ts_us, TRY_CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS BIGINT) AS raw_value, event_id AS seq FROM events
), w AS (
  SELECT *, value - lag(value) OVER s AS change, ts_us - lag(ts_us) OVER s AS gap FROM r WINDOW s AS (PARTITION BY source, metric ORDER BY ts_us, seq)
)
SELECT metric, CASE WHEN source = 'charstation/1' THEN 'tier1_only' ELSE 'full' END AS policy, CASE metric WHEN 'raw_adc' THEN 2000000 WHEN 'Temperature' THEN NULL ELSE 60000000 END AS cadence_us, count(*) AS n,
  count(*) FILTER (WHERE CASE metric WHEN 'temperature' THEN value < -40 OR value > 200 WHEN 'raw_adc' THEN value > 4095 WHEN 'Temperature' THEN false ELSE value > 100 END) AS out,
  count(*) FILTER (WHERE metric IN ('moisture', 'raw_adc') AND (raw_value < 100 OR raw_value > 3995)) AS raw_out,
  count(*) FILTER (WHERE metric IN ('temperature', 'moisture', 'humidity') AND gap BETWEEN 1000000 AND 600000000 AND abs(change) > CASE metric WHEN 'temperature' THEN 20 ELSE 30 END) AS rates
FROM w GROUP BY ALL"""
