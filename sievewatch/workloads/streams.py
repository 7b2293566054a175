"""Queries: the streaming jobs, run over the landed alert lines until the input is used up.

Windows and sessions are emitted when the watermark closes them, so the SQL twins leave out those
that are still open at the end of the input.
"""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from ..operators import snapshots
from ..session import scratch_path
from ..sources import alerts as src
from ..streaming import live, stateful
from .alerts import KEPT
from .inputs import Registry

R = Registry()


def finish(t, stream, name: str):
    """Run a stream to its end and read what it wrote."""
    path = scratch_path(t.spark, name)
    live.start(stream, path, scratch_path(t.spark, f"{name}-cp"), once=True).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(path)


def raw_stream(t):
    return src.stream_alerts(t.spark, t.landed("raw_lines"))


def flat_live(raw):
    """Every alert (no forward filter), normalised and flat, with event time."""
    alerts = live.live_alerts(raw, min_level=0, skip=[])
    return alerts.select(
        "alert_id", "ts", F.col("source.agent_name").alias("agent_name"),
        F.col("rule.level").alias("rule_level"), "category", "rule",
        F.col("mitre_hint.technique_id").alias("technique_id"),
    )


def all_live(t):
    return flat_live(raw_stream(t))


SECONDS = "SELECT *, date_trunc('second', ts) AS t0 FROM alerts"
CLOSED = "(SELECT max(t0) - INTERVAL 10 MINUTE FROM s)"

R.add("st1_live_alerts", f"""
SELECT alert_id, timestamp, agent_name, rule_level FROM alerts WHERE {KEPT}""", "alerts")(
    lambda t: finish(t, live.live_alerts(raw_stream(t)).select(
        "alert_id", "timestamp", F.col("source.agent_name").alias("agent_name"),
        F.col("rule.level").alias("rule_level"),
    ), "live")
)

R.add("st2_without_repeats", "SELECT alert_id, rule_level FROM alerts", "alerts")(
    lambda t: finish(t, live.without_repeats(
        all_live(t).unionByName(all_live(t))
    ).select("alert_id", "rule_level"), "dedup")
)


def stored(t):
    path = scratch_path(t.spark, "store")
    stream = live.live_alerts(raw_stream(t))
    for _ in range(2):  # a second run from the start adds nothing
        live.each_batch(
            stream, live.alert_store(path), scratch_path(t.spark, "store-cp"), once=True
        ).awaitTermination()
    return t.spark.read.parquet(path)


R.add("st3_alert_store", f"""
SELECT alert_id AS id, timestamp, rule_id, rule_level, description, agent_name, agent_ip,
  'UNKNOWN' AS severity FROM alerts WHERE {KEPT}""", "alerts")(
    lambda t: stored(t).drop("raw_data", "created_at", "day")
)

R.add("st4_brute_force_stream", f"""
, s AS ({SECONDS}), x AS (SELECT agent_name, date_trunc('hour', t0) - INTERVAL 1 HOUR
    * unnest(range(6)) AS window_start FROM s)
SELECT agent_name, window_start, window_start + INTERVAL 6 HOUR AS window_end, count(*) AS attempts
FROM x GROUP BY agent_name, window_start
HAVING count(*) > 8 AND window_start + INTERVAL 6 HOUR <= {CLOSED}""", "alerts")(
    lambda t: finish(t, live.brute_force_stream(
        all_live(t), "agent_name", length="6 hours", slide="1 hour"
    ), "windows")
)

TRAILING = "OVER (PARTITION BY agent_name ORDER BY second RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW)"

# the trailing window of the batch detection, moment by moment
R.add("st4_brute_force_trailing", f"""
, s AS ({SECONDS}), c AS (SELECT agent_name, CAST(epoch(t0) AS BIGINT) AS second, count(*) AS n FROM s GROUP BY 1, 2),
w AS (SELECT agent_name, second, sum(n) {TRAILING} AS attempts, min(second) {TRAILING} AS first FROM c)
SELECT agent_name, second, CAST(attempts AS BIGINT) AS attempts, second - first AS timespan_seconds
FROM w WHERE attempts > 8 AND second + 1 <= (SELECT max(second) - 600 FROM c)""", "alerts")(
    lambda t: finish(t, stateful.brute_force_trailing(
        all_live(t).select("agent_name", "ts"), "agent_name", more_than=8, seconds=21600), "trailing")
)

R.add("st4_port_scan_sketch", f"""
, s AS ({SECONDS})
SELECT agent_name, date_trunc('day', t0) AS window_start, count(DISTINCT rule_id) AS ports FROM s
GROUP BY 1, 2 HAVING count(DISTINCT rule_id) > 10
  AND date_trunc('day', t0) + INTERVAL 1 DAY <= {CLOSED}""", "alerts")(
    # few ports: the sketch still counts them exactly
    lambda t: finish(t, live.port_scan_sketch_stream(
        all_live(t).withColumn("port", F.col("rule.id")), "agent_name", "port", more_than=10, length="1 day", error=0.01,
    ), "sketches").where("ports > 10").select("agent_name", "window_start", "ports")
)

R.add("st4_port_scan_stream", f"""
, s AS ({SECONDS})
SELECT agent_name, date_trunc('day', t0) AS window_start, count(DISTINCT rule_id) AS ports FROM s
GROUP BY 1, 2 HAVING count(DISTINCT rule_id) > 10
  AND date_trunc('day', t0) + INTERVAL 1 DAY <= {CLOSED}""", "alerts")(
    lambda t: finish(t, live.port_scan_stream(
        all_live(t).withColumn("port", F.col("rule.id")), "agent_name", "port", more_than=10,
        length="1 day",
    ), "scans")
)

SESSIONS = f"""
, s AS ({SECONDS}), g AS (SELECT *, CASE WHEN epoch(t0) - epoch(lag(t0) OVER w) < 36000 THEN 0
    ELSE 1 END AS opens FROM s WINDOW w AS (PARTITION BY agent_name ORDER BY ts, seq)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY agent_name ORDER BY ts, seq) AS sid FROM g),
sessions AS (SELECT agent_name, min(t0) AS session_start, max(t0) + INTERVAL 10 HOUR
    AS session_end, max(t0) AS last_seen, count(*) AS n, max(rule_level) AS max_level
  FROM n GROUP BY agent_name, sid)
"""

R.add("st5_incident_sessions", SESSIONS + f"""
SELECT * FROM sessions WHERE session_end <= {CLOSED}""", "alerts")(
    lambda t: finish(t, live.incident_sessions(all_live(t), "10 hours"), "sessions")
)

R.add("st5_silent_agents_stream", SESSIONS + f"""
SELECT agent_name, last_seen, session_end AS silent_since FROM sessions
WHERE session_end <= {CLOSED}""", "alerts")(
    lambda t: finish(t, live.silent_agents_stream(all_live(t), "10 hours"), "silent")
)


def fallen_silent(t, wait_seconds: int = 300):
    """Follow the landed file, after which nothing comes any more, until every alert that can be read is in a report.

    However long the file takes, its alerts are waited for; once they are read, an agent that is not reported for ``wait_seconds``
    more is an error, as is a stream that ended: part of the agents is no answer.
    """
    path, landed = scratch_path(t.spark, "clock"), t.landed("raw_lines")
    alerts = all_live(t).select("agent_name", "ts")
    arrived = flat_live(src.read_alerts(t.spark, landed)).count()
    query = live.start(stateful.silent_agents_by_clock(alerts, 2), path, scratch_path(t.spark, "clock-cp"), interval="1 second")
    rows = t.spark.createDataFrame([], "agent_name STRING, last_seen TIMESTAMP, events LONG")
    told, since = 0, None
    try:
        while told < arrived or since is None:
            time.sleep(1)
            if query.exception() is not None:
                raise query.exception()
            if not query.isActive:
                raise RuntimeError(f"the stream ended: {told} of {arrived} alerts are in a report")
            if not query.recentProgress:  # the file is still being read
                continue
            rows = t.spark.read.schema(rows.schema).parquet(path)
            before, told = told, rows.agg(F.coalesce(F.sum("events"), F.lit(0))).first()[0]
            since = time.monotonic() if since is None or told > before else since
            if told < arrived and time.monotonic() - since > wait_seconds:
                raise TimeoutError(f"{told} of {arrived} alerts are in a report {wait_seconds} s after the last one")
    finally:
        query.stop()
    # an agent with a pause in between is reported once per silence
    return rows.groupBy("agent_name").agg(F.max("last_seen").alias("last_seen"), F.sum("events").alias("events"))


R.add("st5_silent_by_clock", f"""
, s AS ({SECONDS})
SELECT agent_name, max(t0) AS last_seen, count(*) AS events FROM s GROUP BY agent_name""", "alerts")(
    lambda t: fallen_silent(t).select("agent_name", "last_seen", "events")
)


def counted(t):
    path = scratch_path(t.spark, "counts")
    live.each_batch(
        live.running_counts(raw_stream(t)), live.latest_table(path),
        scratch_path(t.spark, "counts-cp"), mode="complete", once=True,
    ).awaitTermination()
    return snapshots.read(t.spark, path, "forwarded BOOLEAN, n BIGINT")


R.add("st6_running_counts", f"SELECT {KEPT} AS forwarded, count(*) AS n FROM alerts GROUP BY 1",
      "alerts")(counted)


def split_lines(t):
    good, bad = scratch_path(t.spark, "good"), scratch_path(t.spark, "bad")
    lines = src.stream_lines(t.spark, t.landed("mixed_lines"))
    live.each_batch(
        src.parse_lines(lines), live.lines_store(good, bad), scratch_path(t.spark, "lines-cp"),
        once=True,
    ).awaitTermination()
    kinds = [("alerts", good), ("rejects", bad)]
    tables = [t.spark.read.parquet(p).agg(F.count("*").alias("n"))
              .withColumn("kind", F.lit(k)) for k, p in kinds]
    return tables[0].unionByName(tables[1])


R.add("st7_rejects_aside", """
SELECT 'alerts' AS kind, count(*) AS n FROM mixed_lines WHERE form > 2
UNION ALL SELECT 'rejects', count(*) FROM mixed_lines WHERE form IN (0, 2)""", "mixed_lines")(
    split_lines
)

def live_outcomes(t):
    paths = [scratch_path(t.spark, n) for n in ("kept", "rejects", "outcomes")]
    lines = src.parse_lines(src.stream_lines(t.spark, t.landed("live_lines")))
    live.each_batch(lines, live.live_store(*paths), scratch_path(t.spark, "outcomes-cp"), once=True).awaitTermination()
    return [t.spark.read.parquet(p) for p in paths]


R.add("st1_rejected", """
SELECT CASE WHEN form IN (0, 2) THEN 'line' ELSE 'rule.level' END AS errors, trim(value) AS line
FROM (SELECT l.value AS value, form FROM live_lines l JOIN mixed_lines m ON l.seq = m.seq) x WHERE form IN (0, 2, 3)""",
      "live_lines")(
    lambda t: live_outcomes(t)[1].select(F.array_join("errors", ",").alias("errors"), "line")
)

R.add("st1_outcomes", """
SELECT CASE WHEN fate IN ('malformed', 'rule.level') THEN 'rejected' ELSE fate END AS outcome, count(*) AS n
FROM live_lines WHERE fate <> 'blank' GROUP BY 1""", "live_lines")(
    lambda t: live_outcomes(t)[2].groupBy("outcome").agg(F.sum("n").alias("n"))
)

R.add("st8_enriched_stream", """
SELECT a.alert_id, a.technique_id, v.name AS technique, v.phase_name AS tactics FROM alerts a
LEFT JOIN techniques v ON v.technique_id = a.technique_id AND NOT deprecated AND NOT revoked""",
      "alerts", "techniques")(
    lambda t: finish(t, live.with_techniques(
        all_live(t), t.techniques.where("NOT deprecated AND NOT revoked").select(
            F.col("technique_id").alias("id"), "name", F.col("phase_name").alias("tactics")
        )
    ).select("alert_id", "technique_id", "technique", "tactics"), "enriched")
)


def mailed(t):
    path = scratch_path(t.spark, "mail")
    live.each_batch(
        all_live(t), live.mail_store(path, period="day"), scratch_path(t.spark, "mail-cp"), once=True
    ).awaitTermination()
    return t.spark.read.parquet(path)


R.add("st9_mail_queue_stream", f"""
, s AS ({SECONDS})
SELECT alert_id, position FROM (SELECT alert_id, row_number() OVER (
    PARTITION BY date_trunc('day', t0) ORDER BY t0, alert_id) AS position
  FROM s WHERE rule_level >= 12) x WHERE position <= 12""", "alerts")(
    lambda t: mailed(t).select("alert_id", "position")
)
