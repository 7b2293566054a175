"""Queries: detections over time and the stored tables.

The test events are sparse, so the windows are wider than the defaults.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import detections as dt, stores
from ..session import scratch_path
from ..sources import alerts as src
from .alerts import raw
from .inputs import Registry

R = Registry()

SEC = "CAST(floor(epoch(ts)) AS BIGINT)"
RANGE6H = "OVER (PARTITION BY agent_name ORDER BY second RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW)"

R.add("d1_brute_force", f"""
, s AS (SELECT agent_name, {SEC} AS second, count(*) AS n FROM alerts GROUP BY 1, 2),
w AS (SELECT agent_name, second, sum(n) {RANGE6H} AS attempts, min(second) {RANGE6H} AS first FROM s)
SELECT agent_name, second, CAST(attempts AS BIGINT) AS attempts, second - first AS timespan_seconds
FROM w WHERE attempts > 8""", "alerts")(
    lambda t: dt.brute_force(t.alerts, "agent_name", more_than=8, seconds=21600)
)

RANGE_IP = "OVER (PARTITION BY srcip ORDER BY second RANGE BETWEEN 604800 PRECEDING AND CURRENT ROW)"

R.add("d1_failures_per_source", f"""
, s AS (SELECT srcip, {SEC} AS second, count(*) AS n FROM alerts
  WHERE srcip <> '' AND tags LIKE '%authentication_failed%' GROUP BY 1, 2),
w AS (SELECT srcip, second, sum(n) {RANGE_IP} AS attempts, min(second) {RANGE_IP} AS first FROM s)
SELECT srcip AS src_ip, second, CAST(attempts AS BIGINT) AS attempts,
  second - first AS timespan_seconds FROM w WHERE attempts > 1""", "alerts")(
    lambda t: dt.brute_force(
        dt.login_failures(t.alerts.withColumnRenamed("srcip", "src_ip")), more_than=1, seconds=604800
    )
)

R.add("d1_brute_force_windows", """
SELECT agent_name, window_start, window_start + INTERVAL 6 HOUR AS window_end,
  count(*) AS attempts FROM (
  SELECT agent_name, date_trunc('hour', ts) - INTERVAL 1 HOUR * unnest(range(6)) AS window_start
  FROM alerts) x GROUP BY agent_name, window_start HAVING count(*) > 8""", "alerts")(
    lambda t: dt.brute_force_windows(t.alerts, "agent_name", length="6 hours", slide="1 hour")
)

R.add("d2_decode_sshd", """
SELECT alert_id, CASE WHEN event_type = 'error' THEN 'user' || CAST(k AS STRING) END AS user,
  CASE WHEN event_type = 'error' THEN '198.51.100.' || CAST(k AS STRING) END AS ip,
  CASE WHEN event_type = 'error' THEN 40000 + k END AS port,
  CASE WHEN event_type = 'error' THEN 'ssh2' END AS service FROM raw_fields""", "raw_fields")(
    lambda t: dt.decode_sshd(t.raw_fields.select("alert_id", F.coalesce("full_log", F.lit(""))
                                                 .alias("raw_log")))
    .select("alert_id", "user", "ip", "port", "service")
)

CHANGES = """, changes AS (SELECT * FROM (SELECT *, lag(hash) OVER (PARTITION BY host, path
  ORDER BY ts, seq) AS old_hash FROM file_events) x
  WHERE old_hash IS NOT NULL AND old_hash <> hash)
"""

R.add("d3_file_changes", CHANGES + """
SELECT host, path, ts, seq, old_hash, hash AS new_hash FROM changes""", "file_events")(
    lambda t: dt.file_changes(t.file_events).select(
        "host", "path", "ts", "seq", "old_hash", "new_hash"
    )
)

R.add("d4_drop_ignored", """
SELECT seq, path FROM (SELECT seq, CASE WHEN k < 30 THEN '/etc/mtab' WHEN k < 50
    THEN '/etc/app' || CAST(k AS STRING) || '.log' ELSE '/etc/file' || CAST(k AS STRING) END AS path
  FROM alerts) x
WHERE path <> '/etc/mtab' AND NOT regexp_matches(path, '\\.log$|\\.swp$')""", "alerts")(
    lambda t: dt.drop_ignored(t.alerts.select(
        "seq",
        F.when(F.col("k") < 30, "/etc/mtab")
        .when(F.col("k") < 50, F.concat(F.lit("/etc/app"), F.col("k").cast("string"), F.lit(".log")))
        .otherwise(F.concat(F.lit("/etc/file"), F.col("k").cast("string"))).alias("path"),
    ))
)

FREQUENT = f"""
, s AS (SELECT host, path, {SEC} AS second, count(*) AS n FROM file_events GROUP BY 1, 2, 3),
w AS (SELECT host, path, sum(n) OVER (PARTITION BY host, path ORDER BY second
  RANGE BETWEEN 259200 PRECEDING AND CURRENT ROW) AS changes FROM s),
noisy AS (SELECT host, path, CAST(max(changes) AS BIGINT) AS max_changes FROM w
  WHERE changes > 3 GROUP BY host, path)
"""

R.add("d4_frequent_changes", FREQUENT + "SELECT * FROM noisy", "file_events")(
    lambda t: dt.frequent_changes(t.file_events, 3, 259200)
)

R.add("d4_without_frequent", FREQUENT + """
SELECT f.host, f.path, f.seq FROM file_events f LEFT JOIN noisy n
  ON n.host = f.host AND n.path = f.path WHERE n.host IS NULL""", "file_events")(
    lambda t: dt.without_frequent(t.file_events, 3, 259200).select("host", "path", "seq")
)

R.add("d5_silent_agents", f"""
, g AS (SELECT agent_name, lag({SEC}) OVER (PARTITION BY agent_name ORDER BY ts) AS last_seen,
  {SEC} AS next_seen FROM alerts)
SELECT *, next_seen - last_seen AS gap_seconds FROM g WHERE next_seen - last_seen > 36000""",
      "alerts")(lambda t: dt.silent_agents(t.alerts, 36000))

R.add("d6_mail_queue", """
SELECT alert_id, period, position FROM (SELECT *, date_trunc('day', ts) AS period, row_number() OVER (
    PARTITION BY date_trunc('day', ts) ORDER BY ts, alert_id) AS position
  FROM alerts WHERE rule_level >= 12) x WHERE position <= 12""", "alerts")(
    lambda t: dt.mail_queue(t.alerts, period="day").select(
        "alert_id", F.col("period").cast("timestamp_ntz").alias("period"), "position"
    )
)

R.add("d7_disk_alerts", """
SELECT alert_id, '/dev/sda' || CAST(k % 4 AS STRING) AS filesystem, '/var' AS mount,
  k AS usage_percent, CASE WHEN k > 90 THEN 'full' ELSE 'high' END AS state
FROM alerts WHERE k > 80""", "alerts")(
    lambda t: dt.disk_alerts(t.alerts.select(
        "alert_id", F.format_string("output: 'df -P': /dev/sda%d 100G 9G 1G %d%% /var",
                                    F.col("k") % 4, "k").alias("raw_log"),
    )).select("alert_id", "filesystem", "mount", "usage_percent", "state")
)

R.add("d8_allow_list", """
SELECT alert_id, srcip FROM (SELECT alert_id, CASE WHEN k % 9 = 0 THEN '127.0.0.1' WHEN k % 9 = 1
    THEN 'localhost.localdomain' ELSE srcip END AS srcip FROM alerts) x
WHERE srcip IS NULL OR srcip NOT IN ('127.0.0.1', 'localhost.localdomain')""", "alerts")(
    lambda t: dt.drop_allowed(t.alerts.select(
        "alert_id", F.when(F.col("k") % 9 == 0, "127.0.0.1")
        .when(F.col("k") % 9 == 1, "localhost.localdomain").otherwise(F.col("srcip")).alias("srcip"),
    ), "srcip")
)

R.add("d8_allow_table", """
SELECT alert_id, srcip FROM alerts WHERE srcip IS NULL OR srcip NOT IN (
  SELECT '198.51.100.' || CAST(s_suppkey AS STRING) FROM supplier WHERE s_acctbal > 0)""",
      "alerts")(
    lambda t: dt.drop_allowed_table(
        t.alerts.select("alert_id", "srcip"),
        t.supplier.where("s_acctbal > 0").select(
            F.concat(F.lit("198.51.100."), F.col("s_suppkey").cast("string")).alias("ip")
        ),
        "srcip",
    )
)

R.add("d9_failures_without_success", f"""
, s AS (SELECT agent_name, {SEC} AS second, count(*) FILTER (event_type = 'error') AS failures,
  count(*) FILTER (event_type = 'click') AS ok FROM alerts GROUP BY 1, 2)
SELECT agent_name, second, failures FROM s a WHERE failures > 0 AND NOT EXISTS (
  SELECT 1 FROM s b WHERE b.agent_name = a.agent_name AND b.ok > 0
    AND b.second BETWEEN a.second - 10800 AND a.second + 10800)""", "alerts")(
    lambda t: dt.failures_without_success(
        t.alerts, "agent_name", F.col("event_type") == "error", F.col("event_type") == "click", 10800
    )
)

R.add("d10_rootkit_signs", """
SELECT alert_id, k AS hidden_pid FROM alerts WHERE event_type = 'signup' AND k % 2 = 0
UNION ALL SELECT alert_id, NULL FROM alerts WHERE event_type = 'signup' AND k % 2 = 1""",
      "alerts")(
    lambda t: dt.rootkit_signs(t.alerts.select("alert_id", F.when(
        F.col("event_type") != "signup", F.col("description")
    ).when(F.col("k") % 2 == 0, F.concat(
        F.lit("rootcheck: Hidden PID detected: "), F.col("k").cast("string"), F.lit(".")
    )).otherwise("Process not visible in /proc filesystem").alias("raw_log"))).select(
        "alert_id", "hidden_pid"
    )
)

R.add("d11_port_scans", """
SELECT agent_name, date_trunc('day', ts) AS window_start, count(DISTINCT k) AS ports FROM alerts
GROUP BY 1, 2 HAVING count(DISTINCT k) > 15""", "alerts")(
    lambda t: dt.port_scans(t.alerts, "agent_name", "k", 15, "1 day")
)

R.add("d12_mass_changes", CHANGES + """
SELECT host, date_trunc('day', ts) AS window_start, count(DISTINCT path) AS files FROM changes
GROUP BY 1, 2 HAVING count(DISTINCT path) > 10""", "file_events")(
    lambda t: dt.mass_changes(dt.file_changes(t.file_events), 10, "1 day")
)

R.add("d13_port_changes", """
, seen AS (SELECT DISTINCT host, port, snap FROM ports)
SELECT coalesce(o.host, n.host) AS host, coalesce(o.port, n.port) AS port,
  CASE WHEN o.host IS NULL THEN 'opened' ELSE 'closed' END AS change
FROM (SELECT * FROM seen WHERE snap = 'old') o FULL JOIN (SELECT * FROM seen WHERE snap = 'new') n
  ON o.host = n.host AND o.port = n.port WHERE o.host IS NULL OR n.host IS NULL""", "ports")(
    lambda t: dt.port_changes(t.ports)
)

# --- stored tables -------------------------------------------------------------------------


def saved_alerts(t):
    """Save the failures with a severity first, then all alerts twice."""
    path = scratch_path(t.spark, "alerts")
    rows = src.read_whole_alerts(t.spark, t.landed("raw_lines"))
    early = rows.where(F.array_contains("rule.groups", "sshd")).withColumn("severity", F.lit("HIGH"))
    at = lambda text: F.lit(text).cast("timestamp")
    stores.save_alerts(t.spark, stores.alert_records(early, at("2024-02-01 00:00:00")), path)
    for _ in range(2):
        stores.save_alerts(
            t.spark, stores.alert_records(rows.unionByName(rows), at("2024-02-02 00:00:00")), path
        )
    return t.spark.read.parquet(path)


R.add("s6_save_alerts", """
SELECT alert_id AS id, timestamp, rule_id, rule_level, description, agent_name, agent_ip,
  CASE WHEN event_type = 'error' THEN 'HIGH' ELSE 'UNKNOWN' END AS severity,
  CASE WHEN event_type = 'error' THEN '2024-02-01' ELSE '2024-02-02' END AS saved_on,
  value AS raw_data
FROM alerts a JOIN raw_lines r ON a.seq = r.seq""", "alerts", "raw_lines")(
    lambda t: saved_alerts(t).withColumn("saved_on", F.date_format("created_at", "yyyy-MM-dd"))
    .drop("created_at", "day")
)


def stored_range(t):
    path = scratch_path(t.spark, "alerts")
    at = F.lit("2024-02-01 00:00:00").cast("timestamp")
    stores.save_alerts(t.spark, stores.alert_records(raw(t), at), path)
    return stores.stored_between(
        t.spark.read.parquet(path), "2024-01-05T00:00:00.000Z", "2024-01-12T12:00:00.000Z"
    )


R.add("s6_stored_between", """
SELECT alert_id AS id, timestamp, CAST(CAST(ts AS DATE) AS STRING) AS day FROM alerts
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 12:00:00'""", "alerts")(
    lambda t: stored_range(t).select("id", "timestamp", F.col("day").cast("string").alias("day"))
)


def saved_classifications(t):
    path = scratch_path(t.spark, "classifications")
    rows = t.alerts.select(
        "alert_id", F.when(F.col("rule_level") >= 10, "CRITICAL").otherwise("LOW").alias("severity"),
        F.col("description").alias("reasoning"), F.col("tags").alias("mitre_tactics"),
        F.col("ts").alias("classified_at"),
    )
    for batch in (1, 2, 2):  # a batch that is run again adds nothing
        stores.save_classifications(t.spark, rows, path, batch)
    return stores.saved_classifications(t.spark, path)


R.add("s7_save_classifications", """
, numbered AS (SELECT *, row_number() OVER (ORDER BY ts, alert_id) AS rn,
  (SELECT count(*) FROM alerts) AS total FROM alerts)
SELECT rn + total * again AS id, alert_id,
  CASE WHEN rule_level >= 10 THEN 'CRITICAL' ELSE 'LOW' END AS severity,
  description AS reasoning, tags AS mitre_tactics FROM numbered, (VALUES (0), (1)) v(again)""",
      "alerts")(lambda t: saved_classifications(t).drop("classified_at"))


def saved_reports(t):
    path = scratch_path(t.spark, "reports")
    stores.save_reports(t.spark, t.reports.drop("id"), path)
    return stores.saved_reports(t.spark, path)


R.add("s8_save_reports", """
SELECT row_number() OVER (ORDER BY created_at, alert_id, agent_name) AS id, alert_id, severity,
  agent_name, report_text FROM reports""", "reports")(
    lambda t: saved_reports(t).drop("created_at")
)


def saved_knowledge(t):
    """Rebuild by force over older rows, then try other rows, which are ignored."""
    path = scratch_path(t.spark, "knowledge")
    columns = ["source", "id", "name"]
    stores.save_knowledge(t.spark, t.cve_vectors.select(*columns), path)
    stores.save_knowledge(t.spark, t.technique_vectors.select(*columns), path, force=True)
    stores.save_knowledge(t.spark, t.cve_vectors.select(*columns), path)
    return t.spark.read.parquet(path)


R.add("s9_save_knowledge", "SELECT source, id, name FROM technique_vectors",
      "technique_vectors")(saved_knowledge)
