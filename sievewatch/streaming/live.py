"""Structured Streaming jobs: the live form of normalisation, storage and detections.

The jobs take streaming DataFrames of raw alerts (``sources.alerts.stream_alerts``, or lines of
``sources.tail`` through ``parse_lines``) and use the batch operators wherever these are stateless.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import iso_timestamp
from ..operators import detections as dt, normalise as nz, snapshots, stores
from ..sources.alerts import alerts_of, rejected_lines

LATENESS = "10 minutes"
POLL = "5 seconds"
SESSION_GAP = "10 minutes"


def live_alerts(raw: DataFrame, **rules) -> DataFrame:
    """Forwarded, normalised, valid alerts with their event time ``ts``."""
    valid = nz.valid_alerts(nz.normalise(nz.forward(raw, **rules)))
    return valid.withColumn("ts", iso_timestamp("timestamp"))


def judged_lines(parsed: DataFrame, **rules) -> DataFrame:
    """Every parsed line (``sources.alerts.parse_lines``) with its ``outcome`` and ``errors``.

    ``kept``: forwarded and valid, with the normalised columns and ``ts``; ``skipped``: below the level or a noise rule;
    ``rejected``: a malformed line (error ``line``) or an alert that lacks a required field, such as a level that cannot be read.
    Kept, skipped and rejected lines together are the lines read.
    """
    raw = alerts_of(parsed, with_line=True)
    passed = raw.withColumn("_passed", nz.should_forward(raw, **rules))
    checked = nz.validated(nz.normalise(passed)).withColumn("ts", iso_timestamp("timestamp"))
    outcome = F.when(F.size("errors") > 0, "rejected").when(F.col("_passed"), "kept").otherwise("skipped")
    judged = checked.withColumn("outcome", outcome).drop("_passed")
    broken = rejected_lines(parsed).withColumns({"outcome": F.lit("rejected"), "errors": F.array(F.lit("line"))})
    return judged.unionByName(broken, allowMissingColumns=True)


def without_repeats(alerts: DataFrame, lateness: str = LATENESS, key: str = "alert_id") -> DataFrame:
    """Each alert id once, also when a source sends it again within the lateness bound."""
    return alerts.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def brute_force_stream(failures: DataFrame, source: str, lateness: str = LATENESS,
                       **limits) -> DataFrame:
    return dt.brute_force_windows(failures.withWatermark("ts", lateness), source, **limits)


def port_scan_stream(
    rows: DataFrame, source: str, port: str, more_than: int = 100, length: str = "60 seconds",
    lateness: str = LATENESS,
) -> DataFrame:
    """Exact distinct ports per source and window: repeats are dropped, then counted.

    The state holds each (source, window, port) once until the watermark closes the window.
    """
    once = (
        rows.withWatermark("ts", lateness)
        .select(source, F.window("ts", length).alias("w"), port)
        .dropDuplicates([source, "w", port])
    )
    return (
        once.groupBy(source, "w").agg(F.count("*").alias("ports"))
        .where(F.col("ports") > more_than)
        .select(source, F.col("w.start").alias("window_start"), "ports")
    )


def port_scan_sketch_stream(
    rows: DataFrame, source: str, port: str, more_than: int = 100, length: str = "60 seconds",
    lateness: str = LATENESS, error: float = 0.02,
) -> DataFrame:
    """``port_scan_stream`` from distinct sketches: state of a fixed size per source and window, whatever is scanned.

    Sketches merge in the map tasks before the shuffle. ``ports`` is an estimate with a relative
    standard deviation of ``error``; ``sure`` says that the limit is passed by more than three of them. Sources near the limit are
    for the exact form.
    """
    ports = F.approx_count_distinct(port, error)
    return (
        rows.withWatermark("ts", lateness).groupBy(source, F.window("ts", length).alias("w")).agg(ports.alias("ports"))
        .where(F.col("ports") > more_than * (1 - 3 * error))
        .select(source, F.col("w.start").alias("window_start"), "ports", (F.col("ports") > more_than * (1 + 3 * error)).alias("sure"))
    )


def incident_sessions(alerts: DataFrame, gap: str = SESSION_GAP, lateness: str = LATENESS,
                      agent: str = "agent_name") -> DataFrame:
    """Runs of alerts of an agent without a pause of ``gap``: start, last event, count, top level."""
    return (
        alerts.withWatermark("ts", lateness)
        .groupBy(F.session_window("ts", gap).alias("w"), agent)
        .agg(F.count("*").alias("n"), F.max("rule_level").alias("max_level"),
             F.max("ts").alias("last_seen"))
        .select(agent, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"),
                "last_seen", "n", "max_level")
    )


def silent_agents_stream(alerts: DataFrame, silence: str = SESSION_GAP, lateness: str = LATENESS,
                         agent: str = "agent_name") -> DataFrame:
    """An agent that sent nothing for ``silence``: a row as soon as the watermark shows it.

    That is the moment its session closes, so the session state doubles as the timer.
    """
    return incident_sessions(alerts, silence, lateness, agent).select(
        agent, "last_seen", F.col("session_end").alias("silent_since")
    )


def running_counts(raw: DataFrame, **rules) -> DataFrame:
    """Forwarded and skipped so far (two rows of state; update or complete mode)."""
    return nz.forward_counts(raw, **rules)


def with_techniques(alerts: DataFrame, techniques: DataFrame) -> DataFrame:
    """Technique facts by the alert's hint; the technique side is a static table."""
    facts = techniques.select(
        F.col("id").alias("technique_id"), F.col("name").alias("technique"), "tactics"
    )
    return alerts.join(facts, "technique_id", "left")


# --- sinks ---------------------------------------------------------------------------------

def start(stream: DataFrame, path: str, checkpoint: str, once: bool = False,
          interval: str = POLL) -> StreamingQuery:
    """Write a stream to a Parquet table; ``once`` stops when the input is used up."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": interval}
    return writer.outputMode("append").trigger(**trigger).start(path)


def each_batch(stream: DataFrame, fn, checkpoint: str, mode: str = "append", once: bool = False,
               interval: str = POLL) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if once else {"processingTime": interval}
    return writer.outputMode(mode).trigger(**trigger).start()


def alert_store(path: str):
    """Batch writer for normalised alerts: appends the ids that are not stored yet.

    A batch that is run again after a failure finds its rows stored and adds nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        columns = [c for c in batch.columns if c != "ts"]
        batch = batch.select(*columns).persist()
        try:
            stores.save_alerts(batch.sparkSession, stores.normalised_records(batch), path)
        finally:
            batch.unpersist()

    return write


def lines_store(alerts_path: str, rejects_path: str):
    """Batch writer for parsed lines: readable alerts to one table, the rest aside.

    Each batch owns one folder per table, so a repeated batch replaces its own rows.
    """
    def write(parsed: DataFrame, batch_id: int) -> None:
        parsed = parsed.persist()
        try:
            alerts_of(parsed).write.mode("overwrite").parquet(f"{alerts_path}/batch={batch_id}")
            rejected_lines(parsed).write.mode("overwrite").parquet(f"{rejects_path}/batch={batch_id}")
        finally:
            parsed.unpersist()

    return write


def live_store(alerts_path: str, rejects_path: str, counts_path: str, **rules):
    """Batch writer for parsed lines: kept alerts, rejected lines with their errors, and how many lines had which outcome.

    Each batch owns one folder per table, so a repeated batch replaces its own rows.
    """
    def write(parsed: DataFrame, batch_id: int) -> None:
        parsed = parsed.persist()
        try:
            judged = judged_lines(parsed, **rules)
            tables = {
                alerts_path: judged.where("outcome = 'kept'").drop("outcome", "errors"),
                rejects_path: judged.where("outcome = 'rejected'").select("line", "errors"),
                counts_path: judged.groupBy("outcome").agg(F.count("*").alias("n")),
            }
            for path, rows in tables.items():
                rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            parsed.unpersist()

    return write


def latest_table(path: str, writer: str = "latest"):
    """Batch writer for small running results: a new version of the table takes the place of the old one.

    Readers (``snapshots.read``) keep the version they have begun with; the last few stay, older ones are deleted.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        snapshots.commit(batch.sparkSession, path, lambda old: batch, replace=True, writer=writer, batch=batch_id)
        snapshots.vacuum(batch.sparkSession, path, keep=5)

    return write


MAIL_TABLE = "alert_id STRING, period TIMESTAMP, position INT, ts TIMESTAMP"


def mail_store(path: str, per_period: int = dt.MAILS_PER_HOUR, period: str = "hour",
               min_level: int = dt.MAIL_LEVEL):
    """Batch writer of the mail queue: at most ``per_period`` mails per hour over all batches.

    Mails already queued count first; the table has at most ``per_period`` rows per hour.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        queued = stores.read_table(spark, path, MAIL_TABLE)
        fresh = batch.join(queued.select("alert_id"), "alert_id", "left_anti")
        ranked = dt.mail_queue(fresh, min_level, per_period, period)
        used = queued.groupBy("period").agg(F.max("position").alias("used"))
        placed = ranked.join(used, "period", "left").withColumn(
            "position", F.col("position") + F.coalesce("used", F.lit(0))
        )
        placed.where(F.col("position") <= per_period).select(
            "alert_id", F.col("period").cast("timestamp"), "position", F.col("ts").cast("timestamp")
        ).write.mode("append").parquet(path)

    return write
