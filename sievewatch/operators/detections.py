"""Detections over time on flat alerts and file, port and log rows.

The limits default to the documented settings; all are arguments. Windows that belong to one
source are cut into time slabs (``plans.slabs``), so one busy source is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import col
from ..plans.slabs import epoch_seconds, gaps, previous_value, range_sums

# fixed values: limits of the detections
BRUTE_COUNT, BRUTE_SECONDS = 8, 60
MAIL_LEVEL, MAILS_PER_HOUR = 12, 12
SILENT_SECONDS = 600
CHANGE_COUNT, CHANGE_SECONDS = 10, 3600
DISK_PERCENT, DISK_FULL_PERCENT = 80, 90
ALLOWED_IPS, ALLOWED_PATTERNS = ["127.0.0.1"], ["^localhost.localdomain$"]
IGNORED_PATHS = [
    "/etc/mtab", "/etc/hosts.deny", "/etc/mail/statistics", "/etc/random-seed",
    "/etc/random.seed", "/etc/adjtime", "/etc/httpd/logs", "/etc/utmpx", "/etc/wtmpx",
    "/etc/cups/certs", "/etc/dumpdates", "/etc/svc/volatile",
]
IGNORED_SUFFIXES = r"\.log$|\.swp$"


# fixed values: rule groups of a failed login
FAILURE_GROUPS = ["authentication_failed", "authentication_failures"]


def login_failures(alerts: DataFrame, groups: str = "rule_groups", source: str = "src_ip") -> DataFrame:
    """Failed logins with a known source: the input of the brute-force detections."""
    failed = F.arrays_overlap(F.coalesce(groups, F.array().cast("array<string>")), F.array(*map(F.lit, FAILURE_GROUPS)))
    return alerts.where(failed & (F.length(source) > 0))


def _per_second(rows: DataFrame, keys: list[str], ts: str, **measures: Column) -> DataFrame:
    return rows.groupBy(*keys, epoch_seconds(ts).alias("second")).agg(
        *[c.alias(n) for n, c in measures.items()]
    )


def brute_force(
    failures: DataFrame, source: str = "src_ip", ts: str = "ts",
    more_than: int = BRUTE_COUNT, seconds: int = BRUTE_SECONDS,
) -> DataFrame:
    """Moments with more than ``more_than`` failures of a source in the trailing window.

    ``attempts`` is the number in the window, ``timespan_seconds`` how long they took.
    """
    counted = _per_second(failures, [source], ts, n=F.count("*"))
    out = range_sums(counted, [source], {"attempts": "n"}, before=seconds, first="_first")
    return out.where(F.col("attempts") > more_than).select(
        source, "second", "attempts", (F.col("second") - F.col("_first")).alias("timespan_seconds")
    )


def brute_force_windows(
    failures: DataFrame, source: str = "src_ip", ts: str = "ts", more_than: int = BRUTE_COUNT,
    length: str = "60 seconds", slide: str = "10 seconds",
) -> DataFrame:
    """The sliding-window form, for batch and stream; partial counts merge before the shuffle."""
    return (
        failures.groupBy(F.window(ts, length, slide).alias("w"), source)
        .agg(F.count("*").alias("attempts"))
        .where(F.col("attempts") > more_than)
        .select(source, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                "attempts")
    )


SSHD_LINE = r"for (?:invalid user )?(\S+) from (\S+) port (\d+)(?: (\S+))?"


def decode_sshd(rows: DataFrame, text: str = "raw_log") -> DataFrame:
    """User, address, port and service of an sshd log line; nulls when it is none."""
    def part(i: int) -> Column:
        return F.nullif(F.regexp_extract(text, SSHD_LINE, i), F.lit(""))

    process = F.nullif(F.regexp_extract(text, r"\b(\w+)\[\d+\]:", 1), F.lit(""))
    return rows.select(
        "*", part(1).alias("user"), part(2).alias("ip"), part(3).try_cast("int").alias("port"),
        part(4).alias("service"), process.alias("process"),
    )


def file_changes(events: DataFrame, slab_seconds: int = 3600) -> DataFrame:
    """File events whose hash differs from the preceding one of the same host and path.

    Repeated deliveries of an event are merged first; they can never be a change.
    """
    out = previous_value(
        events.dropDuplicates(), ["host", "path"], ["ts", "seq"], "hash", "ts", "old_hash", slab_seconds
    )
    return out.where("old_hash IS NOT NULL AND old_hash <> hash").withColumnRenamed(
        "hash", "new_hash"
    )


def drop_ignored(events: DataFrame, path: str = "path", paths: list[str] = IGNORED_PATHS,
                 suffixes: str = IGNORED_SUFFIXES) -> DataFrame:
    """Without the listed paths and file types (both are fixed settings, no join needed)."""
    return events.where(~F.col(path).isin(*paths) & ~F.col(path).rlike(suffixes))


def frequent_changes(
    events: DataFrame, more_than: int = CHANGE_COUNT, seconds: int = CHANGE_SECONDS
) -> DataFrame:
    """Files that changed more than ``more_than`` times in ``seconds`` at some moment."""
    counted = _per_second(events, ["host", "path"], "ts", n=F.count("*"))
    out = range_sums(counted, ["host", "path"], {"changes": "n"}, before=seconds)
    return out.where(F.col("changes") > more_than).groupBy("host", "path").agg(
        F.max("changes").alias("max_changes")
    )


def without_frequent(events: DataFrame, more_than: int = CHANGE_COUNT,
                     seconds: int = CHANGE_SECONDS) -> DataFrame:
    """Auto-ignore (off by default): leave out the files that change too often."""
    noisy = frequent_changes(events, more_than, seconds)
    return events.join(noisy, ["host", "path"], "left_anti")


def silent_agents(alerts: DataFrame, seconds: int = SILENT_SECONDS) -> DataFrame:
    """Gaps of more than ``seconds`` between neighbouring events of an agent."""
    return gaps(alerts, ["agent_name"], "ts", seconds)


def mail_queue(
    alerts: DataFrame, min_level: int = MAIL_LEVEL, per_period: int = MAILS_PER_HOUR,
    period: str = "hour",
) -> DataFrame:
    """High alerts in order of time, at most ``per_period`` in each hour (or day).

    The limit is the feature. The rank filter already runs in the map tasks, so a busy hour sends
    only its first few rows.
    """
    order = Window.partitionBy("period").orderBy("ts", "alert_id")
    return (
        alerts.where(F.col("rule_level") >= min_level)
        .withColumn("period", F.date_trunc(period, "ts"))
        .withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= per_period)
    )


DF_LINE = r"(\S+)\s+\S+\s+\S+\s+\S+\s+(\d+)%\s+(\S+)"


def disk_alerts(rows: DataFrame, text: str = "raw_log", percent: int = DISK_PERCENT,
                full: int = DISK_FULL_PERCENT) -> DataFrame:
    """Usage of ``df -P`` lines above ``percent``; ``state`` tells 'high' from 'full'."""
    usage = F.regexp_extract(text, DF_LINE, 2).try_cast("int")
    return (
        rows.withColumn("filesystem", F.regexp_extract(text, DF_LINE, 1))
        .withColumn("mount", F.regexp_extract(text, DF_LINE, 3))
        .withColumn("usage_percent", usage)
        .where(F.col("usage_percent") > percent)
        .withColumn("state", F.when(F.col("usage_percent") > full, "full").otherwise("high"))
    )


def drop_allowed(alerts: DataFrame, source: str = "src_ip", ips: list[str] = ALLOWED_IPS,
                 patterns: list[str] = ALLOWED_PATTERNS) -> DataFrame:
    """Without alerts whose source is on the allow-list of the settings; a null source stays."""
    listed = F.col(source).isin(*ips)
    for pattern in patterns:
        listed = listed | F.col(source).rlike(pattern)
    return alerts.where(~F.coalesce(listed, F.lit(False)))


def drop_allowed_table(alerts: DataFrame, allowed: DataFrame, source: str = "src_ip") -> DataFrame:
    """The same with an allow-list table (``ip``); Spark broadcasts it when it is small."""
    return alerts.join(allowed.select("ip").distinct(), alerts[source] == F.col("ip"), "left_anti")


def failures_without_success(
    events: DataFrame, source: str, failed: Column, succeeded: Column, seconds: int, ts: str = "ts"
) -> DataFrame:
    """Seconds with failures of a source and no success of it within ``seconds`` around."""
    counted = _per_second(
        events, [source], ts,
        failures=F.count(F.when(failed, 1)), _ok=F.count(F.when(succeeded, 1)),
    ).where("failures > 0 OR _ok > 0")
    near = range_sums(counted, [source], {"_near": "_ok"}, before=seconds, after=seconds)
    return near.where("failures > 0 AND _near = 0").select(source, "second", "failures")


ROOTKIT_WORDS = r"(?i)rootkit|rootcheck|hidden (?:pid|process|file|port)|not visible in /proc"
HIDDEN_PID = r"(?i)hidden pid(?: detected)?[: ]+(\d+)"


def rootkit_signs(rows: DataFrame, text: Column | str = "raw_log") -> DataFrame:
    """Log rows that speak of hidden processes or rootkits, with the process id named."""
    t = col(text)
    return rows.where(t.rlike(ROOTKIT_WORDS)).withColumn(
        "hidden_pid", F.regexp_extract(t, HIDDEN_PID, 1).try_cast("int")
    )


def port_scans(
    rows: DataFrame, source: str, port: str, more_than: int = 100, length: str = "60 seconds",
    ts: str = "ts",
) -> DataFrame:
    """Sources that touch more than ``more_than`` distinct ports in a window."""
    return (
        rows.groupBy(source, F.window(ts, length).alias("w"))
        .agg(F.countDistinct(port).alias("ports"))
        .where(F.col("ports") > more_than)
        .select(source, F.col("w.start").alias("window_start"), "ports")
    )


def mass_changes(changes: DataFrame, more_than: int = 100, length: str = "60 seconds") -> DataFrame:
    """Hosts on which more than ``more_than`` files changed in a window."""
    return (
        changes.groupBy("host", F.window("ts", length).alias("w"))
        .agg(F.countDistinct("path").alias("files"))
        .where(F.col("files") > more_than)
        .select("host", F.col("w.start").alias("window_start"), "files")
    )


def port_changes(snapshots: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Listening ports that appear or vanish between two snapshots (``host, port, snap``).

    One aggregate with map-side combine instead of a full outer join.
    """
    seen = snapshots.groupBy("host", "port").agg(
        F.max(F.col("snap") == old).alias("was"), F.max(F.col("snap") == new).alias("is_now")
    )
    return seen.where("was <> is_now").select(
        "host", "port", F.when(F.col("is_now"), "opened").otherwise("closed").alias("change")
    )
