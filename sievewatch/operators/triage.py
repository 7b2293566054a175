"""Triage reads over flat alerts (``alert_id, ts, agent_name, agent_ip, rule_level, ...``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.severity import REQUEST_CRITICAL, REQUEST_HIGH, level_number, queue_band
from ..functions.text import PY_BLANKS, col


def at_or_above(alerts: DataFrame, min_level: int) -> DataFrame:
    return alerts.where(F.col("rule_level") >= min_level)


def by_id(alerts: DataFrame, alert_id: str) -> DataFrame:
    """The first alert with this id."""
    return alerts.where(F.col("alert_id") == alert_id).limit(1)


# fixed values: request keywords, lowest level, label
REQUEST_ROUTES = [
    (["critical", "level 10", "high priority"], REQUEST_CRITICAL, "CRITICAL (level 10+)"),
    (["high", "level 7", "important"], REQUEST_HIGH, "HIGH severity (level 7+)"),
]
RECENT = "recent"
ID_PREFIX = "171"


def _route(text: Column, pick) -> Column:
    out = F
    for row in REQUEST_ROUTES:
        hit = F.lit(False)
        for word in row[0]:
            hit = hit | text.contains(word)
        out = out.when(hit, F.lit(pick(row)))
    return out


def parse_requests(requests: DataFrame) -> DataFrame:
    """``(request_id, text)`` -> keyword route and the words that may be an alert id."""
    text = F.lower("text")
    edge, end = f"(?:^|[{PY_BLANKS}])", f"(?=[{PY_BLANKS}]|$)"
    id_words = F.regexp_extract_all(
        text, F.lit(rf"{edge}(\p{{Nd}}+|{ID_PREFIX}[^{PY_BLANKS}]*){end}"), F.lit(1)
    )
    # a number between blanks is one of the words, so the text is searched once
    found = requests.select(
        "request_id", F.when(text.contains("alert"), id_words).alias("words"),
        _route(text, lambda r: r[1]).otherwise(F.lit(None).cast("int")).alias("min_level"),
        _route(text, lambda r: r[2]).otherwise(F.lit(RECENT)).alias("label"),
    )
    has_number = F.exists("words", lambda w: w.rlike(r"^\p{Nd}+\z"))
    return found.select(
        "request_id",
        F.when(has_number, F.col("words"))
        .otherwise(F.array().cast("array<string>")).alias("id_words"),
        "min_level", "label",
    )


def label_counts(alerts: DataFrame) -> DataFrame:
    """Alerts per route label: one scan gives all three counts, as rows ``(label, n)``."""
    sums = [
        F.count(F.when(F.col("rule_level") >= low, 1)).alias(f"n{i}")
        for i, (_, low, _) in enumerate(REQUEST_ROUTES)
    ]
    entries = ", ".join(f"'{label}', n{i}" for i, (_, _, label) in enumerate(REQUEST_ROUTES))
    return alerts.agg(*sums, F.count("*").alias("n_all")).selectExpr(
        f"stack({len(REQUEST_ROUTES) + 1}, {entries}, '{RECENT}', n_all) AS (label, n)"
    )


def route_requests(requests: DataFrame, alerts: DataFrame) -> DataFrame:
    """Answer free-text requests: the alert named in the text, else a keyword filter.

    Output per request: ``route`` ('id' or 'filter'), ``alert_id``, ``min_level``, ``label``,
    ``n_matches`` and the ``header`` line. The rows of a filter route are ``route_alerts``; they
    are the same for every request of that route, so they are not repeated per request.
    """
    parsed = parse_requests(requests)
    # an inner generator would search the texts a second time, in a filter on the size of the list
    words = parsed.select(
        "request_id", F.posexplode_outer("id_words").alias("word_pos", "alert_id")
    ).where("alert_id is not null")
    # reduce the alerts to the ids that are asked for (the alerts are only scanned when the
    # words fit a broadcast), one row per id, so that a much-repeated id cannot multiply the join
    wanted = words.select("alert_id").distinct()
    known = alerts.select("alert_id").join(wanted, "alert_id", "left_semi").distinct()
    named = (
        words.join(known, "alert_id")
        .groupBy("request_id")
        .agg(F.min(F.struct("word_pos", "alert_id")).alias("first"))
        .select("request_id", F.col("first.alert_id").alias("alert_id"))
    )
    n = F.coalesce("n", F.lit(0))
    return (
        parsed.join(named, "request_id", "left")
        .join(F.broadcast(label_counts(alerts)), "label", "left")  # three rows
        .select(
            "request_id",
            F.when(F.col("alert_id").isNotNull(), "id").otherwise("filter").alias("route"),
            "alert_id",
            F.when(F.col("alert_id").isNull(), F.col("min_level")).alias("min_level"),
            F.when(F.col("alert_id").isNull(), F.col("label")).alias("label"),
            F.when(F.col("alert_id").isNotNull(), F.lit(1)).otherwise(n).alias("n_matches"),
            F.when(F.col("alert_id").isNotNull(), F.lit("Alert Details:"))
            .when(n == 0, F.format_string("No %s alerts found in SIEM.", "label"))
            .otherwise(F.format_string("Found %d %s alerts:", n, "label")).alias("header"),
        )
    )


def route_alerts(alerts: DataFrame, label: str) -> DataFrame:
    """Alerts behind a route label."""
    low = {lab: level for _, level, lab in REQUEST_ROUTES}.get(label)
    return alerts if low is None else at_or_above(alerts, low)


def summary_line(attempts: str | None = "attempts", src_ip: str = "src_ip") -> Column:
    """One line per alert; the attempts part only when there is a non-zero number."""
    tries = col(attempts).cast("string") if attempts else F.lit(None).cast("string")
    shown = F.coalesce(tries, F.lit("")).isin("", "0")
    return F.concat(
        F.lit("[Alert "), F.col("alert_id"), F.lit("] Level "), F.col("rule_level").cast("string"),
        F.lit("/15 | "), F.col("description"), F.lit(" | Host: "), F.col("agent_name"),
        F.lit(" ("), F.col("agent_ip"), F.lit(") | Source IP: "),
        F.coalesce(col(src_ip), F.lit("N/A")),
        F.when(shown, F.lit("")).otherwise(F.concat(F.lit(", "), tries, F.lit(" attempts"))),
        F.lit(" | Time: "), F.col("timestamp"),
    )


def route_rows(alerts: DataFrame, **line: str | None) -> DataFrame:
    """``label, alert_id, summary``: the lines behind each filter route, in one scan.

    An answer is its header and the lines of its label; the lines are not repeated per request.
    """
    labels = [F.when(F.col("rule_level") >= low, F.lit(label)) for _, low, label in REQUEST_ROUTES]
    return alerts.select(
        F.explode(F.array_compact(F.array(*labels, F.lit(RECENT)))).alias("label"),
        "alert_id", summary_line(**line).alias("summary"),
    )


def id_details(routed: DataFrame, shown: DataFrame) -> DataFrame:
    """``request_id, alert_id, answer`` of the id route: the alert itself, as indented JSON.

    ``shown`` holds ``alert_id, alert_json``; of a repeated id the smallest text is taken.
    """
    asked = routed.where(F.col("route") == "id").select("request_id", "alert_id", "header")
    one = shown.join(asked.select("alert_id").distinct(), "alert_id", "left_semi")
    one = one.groupBy("alert_id").agg(F.min("alert_json").alias("alert_json"))
    return asked.join(one, "alert_id").select(
        "request_id", "alert_id", F.concat("header", F.lit("\n"), "alert_json").alias("answer")
    )


def with_band(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("band", queue_band("rule_level"))


SEARCHED = ["description", "agent_name", "agent_ip", "alert_id"]


def queue_view(alerts: DataFrame, severity: str = "ALL", search: str = "") -> DataFrame:
    """Alerts of one band ('ALL' for every band) that hold the search text in a shown field."""
    out = alerts
    if severity != "ALL":
        out = out.where(queue_band("rule_level") == severity)
    if search:
        hit = F.lit(False)
        for name in SEARCHED:
            hit = hit | F.lower(F.coalesce(name, F.lit(""))).contains(search.lower())
        out = out.where(hit)
    return out


def queue_order(alerts: DataFrame, sort: str = "level_desc") -> DataFrame:
    level = level_number("rule_level")
    keys = {
        "level_desc": [level.desc(), F.col("alert_id")],
        "level_asc": [level.asc(), F.col("alert_id")],
        "id_asc": [F.col("alert_id")],
    }[sort]
    return alerts.orderBy(*keys)


def most_recent(alerts: DataFrame, limit: int) -> DataFrame:
    return alerts.orderBy(F.col("ts").desc(), F.col("alert_id").desc()).limit(limit)


def in_window(alerts: DataFrame, start: str, end: str) -> DataFrame:
    """Alerts with ``start <= ts < end``; the bounds are pushed to the scan."""
    kind = alerts.schema["ts"].dataType.simpleString()
    return alerts.where(
        (F.col("ts") >= F.lit(start).cast(kind)) & (F.col("ts") < F.lit(end).cast(kind))
    )
