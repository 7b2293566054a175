"""Queries: alert sources, normalisation, triage and dashboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.severity import queue_band
from ..operators import dashboard, normalise as nz, triage
from ..session import scratch_path
from ..sources import alerts as src, feeds
from .inputs import Registry

R = Registry()

BAND = (
    "CASE WHEN rule_level >= 12 THEN 'CRITICAL' WHEN rule_level >= 8 THEN 'HIGH' "
    "WHEN rule_level >= 4 THEN 'MEDIUM' ELSE 'LOW' END"
)
CATEGORY = """CASE event_type WHEN 'error' THEN 'brute_force' WHEN 'signup' THEN 'malware'
  WHEN 'view' THEN 'reconnaissance' WHEN 'click' THEN 'privilege_escalation'
  ELSE 'reconnaissance' END"""
SRC_IP = "CASE WHEN srcip <> '' THEN srcip ELSE src_ip_alt END"
DST_IP = "CASE WHEN dstip <> '' THEN dstip ELSE agent_ip END"
USER = "CASE WHEN dstuser <> '' THEN dstuser WHEN srcuser <> '' THEN srcuser ELSE username END"
HASH = """CASE WHEN md5_json = 'null' THEN NULL WHEN md5_json IS NOT NULL
  THEN replace(md5_json, '"', '') ELSE sha256 END"""
KEPT = "rule_level >= 5 AND rule_id NOT IN ('533', '531', '510')"


def raw(t):
    return src.read_alerts(t.spark, t.landed("raw_lines"))


def posted(t):
    return nz.read_normalised(t.spark, t.landed("posted"), "seq BIGINT")


def triage_alerts(t):
    """Flat alerts with the columns the triage reads use."""
    return t.alerts.withColumnRenamed("srcip", "src_ip")


# --- sources -------------------------------------------------------------------------------

def landed_flows(t):
    """Line items as flow CSV files, with blanks in the header names as the public sets have them."""
    path = scratch_path(t.spark, "flows")
    t.lineitem.select(
        F.concat(F.lit(" "), "l_returnflag", F.lit(" ")).alias(" Label"),
        F.concat(F.lit("10.1."), F.col("l_suppkey").cast("string")).alias("Src IP "),
        F.col("l_linenumber").cast("string").alias(" Dst Port"),
        F.col("l_orderkey").cast("string").alias("Flow Duration"),
    ).write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    return path


R.add("s5_read_flows", """
SELECT l_returnflag AS label, '10.1.' || CAST(l_suppkey AS STRING) AS src_ip,
  CAST(l_linenumber AS STRING) AS dst_port, CAST(l_orderkey AS STRING) AS flow_duration
FROM lineitem""")(lambda t: feeds.flow_view(feeds.read_flows(t.spark, landed_flows(t))))

R.add("s1_read_alert_lines", """
SELECT CAST(seq AS STRING) AS id, 'agent-' AS agent_prefix, 1 AS n_rules FROM mixed_lines
WHERE form > 2""", "mixed_lines")(
    lambda t: src.read_alerts(t.spark, t.landed("mixed_lines")).select(
        "id", F.left("agent.name", F.lit(6)).alias("agent_prefix"),
        F.when(F.col("rule.id").isNotNull(), 1).alias("n_rules"),
    )
)

R.add("s1_rejected_lines", """
SELECT line, count(*) AS n FROM (SELECT trim(value) AS line, form FROM mixed_lines) x
WHERE form IN (0, 2) GROUP BY line""", "mixed_lines")(
    lambda t: src.rejected_lines(
        src.parse_lines(src.read_lines(t.spark, t.landed("mixed_lines")))
    ).groupBy("line")
    .agg(F.count("*").alias("n"))
)

# --- normalise -----------------------------------------------------------------------------

R.add("n1_normalise", f"""
SELECT alert_id, timestamp, agent_name, agent_ip, rule_id, description AS rule_description,
  rule_level, {CATEGORY} AS category, left(coalesce(full_log, message, ''), 500) AS raw_log,
  {SRC_IP} AS src_ip, {DST_IP} AS dst_ip, {USER} AS username, process AS process_name,
  {HASH} AS file_hash, technique_id, technique_name, 'new' AS status FROM raw_fields""",
      "raw_fields")(
    lambda t: nz.normalise(raw(t)).select(
        "alert_id", "timestamp", "source.agent_name", "source.agent_ip",
        F.col("rule.id").alias("rule_id"), F.col("rule.description").alias("rule_description"),
        F.col("rule.level").alias("rule_level"), "category", "raw_log",
        "indicators.src_ip", "indicators.dst_ip", "indicators.username",
        "indicators.process_name", "indicators.file_hash", "mitre_hint.technique_id",
        "mitre_hint.technique_name", "status",
    )
)

R.add("n2_category", f"""
SELECT category, count(*) AS n FROM (SELECT {CATEGORY} AS category FROM alerts) x
GROUP BY category""", "alerts")(
    lambda t: raw(t).groupBy(
        nz.infer_category("rule.groups", "rule.description").alias("category")
    ).agg(F.count("*").alias("n"))
)

R.add("n3_forward", f"SELECT alert_id, rule_id, rule_level FROM alerts WHERE {KEPT}", "alerts")(
    lambda t: nz.forward(raw(t)).select(
        F.col("id").alias("alert_id"), F.col("rule.id").alias("rule_id"),
        nz.rule_level("rule.level").alias("rule_level"),
    )
)

R.add("n4_indicators", f"""
SELECT alert_id, {SRC_IP} AS src_ip, {DST_IP} AS dst_ip, {USER} AS username,
  process AS process_name, {HASH} AS file_hash FROM raw_fields""", "raw_fields")(
    lambda t: nz.with_data(raw(t)).select(
        F.col("id").alias("alert_id"), nz.source_ip().alias("src_ip"),
        nz.destination_ip().alias("dst_ip"), nz.username().alias("username"),
        F.col("data.process").alias("process_name"), nz.file_hash().alias("file_hash"),
    )
)

R.add("n5_technique_hint", """
SELECT technique_id, technique_name, count(*) AS n FROM alerts
GROUP BY technique_id, technique_name""", "alerts")(
    lambda t: nz.normalise(raw(t)).groupBy(
        "mitre_hint.technique_id", "mitre_hint.technique_name"
    ).agg(F.count("*").alias("n"))
)

R.add("n6_raw_log", """
SELECT alert_id, left(coalesce(full_log, message, ''), 500) AS raw_log,
  length(left(coalesce(full_log, message, ''), 500)) AS n_chars FROM raw_fields""", "raw_fields")(
    lambda t: nz.normalise(raw(t)).select(
        "alert_id", "raw_log", F.length("raw_log").alias("n_chars")
    )
)

POST_ERRORS = """array_to_string(list_filter([
  CASE WHEN k % 11 = 0 THEN 'alert_id' END, CASE WHEN k % 13 = 0 THEN 'source.agent_ip' END,
  CASE WHEN k % 17 = 0 THEN 'rule.level' END, CASE WHEN k % 23 = 0 THEN 'indicators' END],
  lambda x: x IS NOT NULL), ',')"""

R.add("n7_validate", f"""
SELECT seq, {POST_ERRORS} AS errors, CASE WHEN k % 2 = 0 THEN 'seen' ELSE 'new' END AS status
FROM posted""", "posted")(
    lambda t: nz.validated(posted(t)).select(
        "seq", F.array_join("errors", ",").alias("errors"), "status"
    )
)

R.add("n7_rejected", f"""
SELECT errors, count(*) AS n FROM (SELECT {POST_ERRORS} AS errors FROM posted) x
WHERE errors <> '' GROUP BY errors""", "posted")(
    lambda t: nz.rejected_alerts(posted(t))
    .groupBy(F.array_join("errors", ",").alias("errors")).agg(F.count("*").alias("n"))
)

R.add("n8_forward_counts", f"""
SELECT {KEPT} AS forwarded, count(*) AS n FROM alerts GROUP BY 1""", "alerts")(
    lambda t: nz.forward_counts(raw(t))
)

R.add("n9_index_level", "SELECT alert_id, rule_level FROM alerts WHERE rule_level >= 3", "alerts")(
    lambda t: nz.at_level(t.alerts, nz.INDEX_LEVEL).select("alert_id", "rule_level")
)
R.add("n9_mail_level", "SELECT alert_id, rule_level FROM alerts WHERE rule_level >= 12", "alerts")(
    lambda t: nz.at_level(t.alerts, nz.MAIL_LEVEL).select("alert_id", "rule_level")
)

# --- triage --------------------------------------------------------------------------------

R.add("t1_min_level", """
SELECT alert_id, agent_name, rule_level FROM alerts WHERE rule_level >= 10""", "alerts")(
    lambda t: triage.at_or_above(t.alerts, 10).select("alert_id", "agent_name", "rule_level")
)

R.add("t2_by_id", """
SELECT alert_id, timestamp, description FROM alerts WHERE alert_id = '421'""", "alerts")(
    lambda t: triage.by_id(t.alerts, "421").select("alert_id", "timestamp", "description")
)

R.add("t3_route_requests", """
, words AS (SELECT request_id, unnest(regexp_split_to_array(lower(text), '\\s+')) AS w,
    generate_subscripts(regexp_split_to_array(lower(text), '\\s+'), 1) AS p FROM requests),
hits AS (SELECT w.request_id, w.w, w.p FROM words w JOIN (SELECT DISTINCT alert_id FROM alerts) a
    ON w.w = a.alert_id JOIN (SELECT DISTINCT request_id FROM words
      WHERE regexp_full_match(w, '[0-9]+')) d ON d.request_id = w.request_id
    JOIN requests r ON r.request_id = w.request_id AND contains(lower(r.text), 'alert')
    WHERE regexp_full_match(w.w, '[0-9]+') OR starts_with(w.w, '171')),
named AS (SELECT request_id, arg_min(w, p) AS alert_id FROM hits GROUP BY request_id),
routed AS (SELECT r.request_id, n.alert_id, CASE
    WHEN regexp_matches(lower(r.text), 'critical|level 10|high priority') THEN 10
    WHEN regexp_matches(lower(r.text), 'high|level 7|important') THEN 7 END AS min_level
  FROM requests r LEFT JOIN named n ON n.request_id = r.request_id),
counted AS (SELECT *, CASE WHEN min_level = 10 THEN 'CRITICAL (level 10+)' WHEN min_level = 7
    THEN 'HIGH severity (level 7+)' ELSE 'recent' END AS lab,
  (SELECT count(*) FROM alerts a WHERE a.rule_level >= coalesce(min_level, 0)) AS n FROM routed)
SELECT request_id, CASE WHEN alert_id IS NULL THEN 'filter' ELSE 'id' END AS route, alert_id,
  CASE WHEN alert_id IS NULL THEN min_level END AS min_level,
  CASE WHEN alert_id IS NULL THEN lab END AS label,
  CASE WHEN alert_id IS NULL THEN n ELSE 1 END AS n_matches,
  CASE WHEN alert_id IS NOT NULL THEN 'Alert Details:'
    WHEN n = 0 THEN 'No ' || lab || ' alerts found in SIEM.'
    ELSE 'Found ' || CAST(n AS STRING) || ' ' || lab || ' alerts:' END AS header
FROM counted""", "requests", "alerts")(
    lambda t: triage.route_requests(t.requests.select("request_id", "text"), t.alerts)
)

SUMMARY = """'[Alert ' || alert_id || '] Level ' || CAST(rule_level AS STRING) || '/15 | '
  || description || ' | Host: ' || agent_name || ' (' || agent_ip || ') | Source IP: '
  || coalesce(srcip, 'N/A')
  || CASE WHEN attempts = 0 THEN '' ELSE ', ' || CAST(attempts AS STRING) || ' attempts' END
  || ' | Time: ' || timestamp"""

R.add("t4_summary_line", f"SELECT alert_id, {SUMMARY} AS summary FROM alerts", "alerts")(
    lambda t: triage_alerts(t).select("alert_id", triage.summary_line().alias("summary"))
)

R.add("t3_route_rows", f"""
SELECT label, alert_id, {SUMMARY} AS summary FROM alerts JOIN (VALUES ('CRITICAL (level 10+)', 10),
  ('HIGH severity (level 7+)', 7), ('recent', -1)) r(label, low) ON rule_level >= low""", "alerts")(
    lambda t: triage.route_rows(triage_alerts(t))
)

R.add("t5_queue_band", f"SELECT alert_id, {BAND} AS band FROM alerts", "alerts")(
    lambda t: triage.with_band(t.alerts).select("alert_id", "band")
)

R.add("t6_queue_view", """
SELECT alert_id, rule_level, description FROM alerts WHERE rule_level >= 8 AND rule_level < 12
  AND (contains(lower(description), 'ssh') OR contains(lower(agent_name), 'ssh')
    OR contains(lower(agent_ip), 'ssh') OR contains(lower(alert_id), 'ssh'))""", "alerts")(
    lambda t: triage.queue_view(t.alerts, "HIGH", "SSH").select(
        "alert_id", "rule_level", "description"
    )
)

R.add("t6_queue_search_ip", """
SELECT alert_id, agent_ip FROM alerts WHERE contains(lower(description), '.2.')
  OR contains(lower(agent_name), '.2.') OR contains(lower(agent_ip), '.2.')
  OR contains(lower(alert_id), '.2.')""", "alerts")(
    lambda t: triage.queue_view(t.alerts, search=".2.").select("alert_id", "agent_ip")
)

R.add("t7_queue_order", "SELECT alert_id, rule_level FROM alerts ORDER BY rule_level DESC, alert_id",
      "alerts")(
    lambda t: triage.queue_order(t.alerts).select("alert_id", "rule_level")
)

R.add("t8_most_recent", """
SELECT alert_id, timestamp, agent_name FROM alerts ORDER BY ts DESC, alert_id DESC LIMIT 50""",
      "alerts")(
    lambda t: triage.most_recent(t.alerts, 50).select("alert_id", "timestamp", "agent_name")
)

R.add("t9_time_window", """
SELECT alert_id, timestamp FROM alerts
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 12:00:00'""", "alerts")(
    lambda t: triage.in_window(t.alerts, "2024-01-05 00:00:00", "2024-01-12 12:00:00").select(
        "alert_id", "timestamp"
    )
)

# --- dashboards ----------------------------------------------------------------------------

R.add("a1_severity_chart", f"""
SELECT name, count(*) AS value FROM (SELECT {BAND} AS name FROM alerts) x GROUP BY name""",
      "alerts")(lambda t: dashboard.severity_chart(t.alerts))

R.add("a2_severity_strip", f"""
SELECT count(*) AS total, count(*) FILTER (b = 'CRITICAL') AS critical,
  count(*) FILTER (b = 'HIGH') AS high, count(*) FILTER (b = 'MEDIUM') AS medium,
  count(*) FILTER (b = 'LOW') AS low FROM (SELECT {BAND} AS b FROM alerts) x""", "alerts")(
    lambda t: dashboard.severity_strip(t.alerts)
)

R.add("a3_level_bars", """
SELECT alert_id, CASE WHEN length(description) > 18 THEN left(description, 18) || '…'
    ELSE description END AS name, CAST(rule_level AS BIGINT) AS level,
  CASE WHEN rule_level >= 12 THEN '#e53e3e' WHEN rule_level >= 8 THEN '#ed8936'
    WHEN rule_level >= 4 THEN '#ecc94b' ELSE '#38a169' END AS fill FROM alerts""", "alerts")(
    lambda t: dashboard.level_bars(t.alerts)
)

R.add("a4_tag_counts", """
SELECT array_to_string(list_transform(string_split(replace(tag, '_', ' '), ' '),
    lambda w: upper(w[1]) || w[2:]), ' ') AS name, count(*) AS count
FROM (SELECT unnest(rule_groups) AS tag FROM alerts) x GROUP BY 1
ORDER BY count DESC, name LIMIT 8""", "alerts")(lambda t: dashboard.tag_counts(t.alerts))

R.add("a5_kpis", """
SELECT count(*) AS total, count(*) FILTER (rule_level >= 12) AS critical,
  round(avg(CAST(rule_level AS DOUBLE)), 4) AS mean_level,
  printf('%.1f', avg(CAST(rule_level AS DOUBLE))) AS mean_level_text FROM alerts""", "alerts")(
    lambda t: dashboard.kpis(t.alerts).withColumn("mean_level", F.round("mean_level", 4))
)

STORED = """SELECT alert_id AS id, timestamp, rule_id, rule_level, description, agent_name,
  agent_ip, 'UNKNOWN' AS severity, ts AS created_at FROM alerts"""

R.add("a6_stored_alerts", f"{STORED} ORDER BY ts DESC, id", "alerts")(
    lambda t: dashboard.stored_alerts(t.alerts.select(
        F.col("alert_id").alias("id"), "timestamp", "rule_id", "rule_level", "description",
        "agent_name", "agent_ip", F.lit("UNKNOWN").alias("severity"),
        F.col("ts").alias("created_at"),
    ))
)

R.add("a7_report_list", """
SELECT id, alert_id, severity, agent_name, report_preview,
  left(report_preview, 60) || '...' AS table_preview, created_at
FROM (SELECT *, CASE WHEN length(report_text) > 200 THEN left(report_text, 200) || '...'
    ELSE report_text END AS report_preview FROM reports) x""", "reports")(
    lambda t: dashboard.report_list(t.reports)
)

R.add("a8_report_by_id", """
SELECT id, alert_id, severity, agent_name, report_text, created_at FROM reports WHERE id = 7""",
      "reports")(lambda t: dashboard.report_by_id(t.reports, 7))

R.add("a9_flow_labels", """
SELECT label AS label, count(*) AS n, round(avg(l_quantity), 4) AS mean_duration
FROM (SELECT l_returnflag || l_linestatus AS label, l_quantity FROM lineitem) x
GROUP BY 1""")(
    lambda t: dashboard.flow_labels(t.lineitem.select(
        F.concat("l_returnflag", "l_linestatus").alias("label"),
        F.col("l_quantity").cast("string").alias("flow_duration"),
    )).withColumn("mean_duration", F.round("mean_duration", 4))
)

R.add("a10_latest_classification", """
, latest AS (SELECT alert_id, severity, classified_at FROM (SELECT *, row_number() OVER (
    PARTITION BY alert_id ORDER BY classified_at DESC, id DESC) AS rn FROM classifications) x
  WHERE rn = 1)
SELECT a.alert_id, l.classified_at, coalesce(l.severity, 'UNKNOWN') AS current_severity
FROM alerts a LEFT JOIN latest l ON a.alert_id = l.alert_id""", "alerts", "classifications")(
    lambda t: dashboard.with_latest_classification(
        t.alerts.select("alert_id", F.lit("UNKNOWN").alias("severity")), t.classifications
    ).select("alert_id", "classified_at", "current_severity")
)

R.add("a11_severity_by_hour", f"""
SELECT date_trunc('hour', ts) AS hour, agent_name, {BAND} AS band, count(*) AS n FROM alerts
GROUP BY ROLLUP (date_trunc('hour', ts), agent_name, {BAND})""", "alerts")(
    lambda t: dashboard.severity_by_hour(t.alerts)
)

# --- flagship ------------------------------------------------------------------------------


def severity_by_agent(t):
    """Forwarded alerts per agent and band, from the raw lines."""
    kept = nz.forward(raw(t))
    return kept.groupBy(
        F.col("agent.name").alias("agent_name"), queue_band("rule.level").alias("band")
    ).agg(F.count("*").alias("n"))


R.add("f1_forwarded_by_agent", f"""
SELECT agent_name, {BAND} AS band, count(*) AS n FROM alerts WHERE {KEPT}
GROUP BY agent_name, {BAND}""", "alerts")(severity_by_agent)
