"""Dashboard aggregates and list views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.severity import QUEUE_BANDS, level_number, queue_band, queue_colour
from ..functions.text import capitalise_words, cut


def severity_chart(alerts: DataFrame) -> DataFrame:
    """Counts per band, bands without alerts left out."""
    return alerts.groupBy(queue_band("rule_level").alias("name")).agg(F.count("*").alias("value"))


def severity_strip(alerts: DataFrame) -> DataFrame:
    """One row: total and the count of every band, zeros kept."""
    band = queue_band("rule_level")
    return alerts.agg(
        F.count("*").alias("total"),
        *[F.count(F.when(band == name, 1)).alias(name.lower()) for name, _, _ in QUEUE_BANDS],
    )


def level_bars(alerts: DataFrame) -> DataFrame:
    """Level per alert with a short label and the colour of its band."""
    text = F.coalesce(F.nullif("description", F.lit("")), F.lit("Unknown"))
    return alerts.select(
        "alert_id",
        F.when(F.length(text) > 18, F.concat(cut(text, 18), F.lit("…"))).otherwise(text)
        .alias("name"),
        level_number("rule_level").alias("level"),
        queue_colour("rule_level").alias("fill"),
    )


def tag_counts(alerts: DataFrame, top: int = 8) -> DataFrame:
    """Most frequent rule groups. Raw tags are counted first, so labels are built once per tag."""
    raw = alerts.select(F.explode("rule_groups").alias("tag")).groupBy("tag").agg(
        F.count("*").alias("n")
    )
    label = capitalise_words(F.replace(F.col("tag"), F.lit("_"), F.lit(" ")))
    return (
        raw.groupBy(label.alias("name")).agg(F.sum("n").alias("count"))
        .orderBy(F.col("count").desc(), "name").limit(top)
    )


def kpis(alerts: DataFrame) -> DataFrame:
    level = level_number("rule_level")
    mean = F.avg(level.cast("double"))
    return alerts.agg(
        F.count("*").alias("total"),
        F.count(F.when(queue_band("rule_level") == "CRITICAL", 1)).alias("critical"),
        F.coalesce(mean, F.lit(0.0)).alias("mean_level"),
        F.when(mean.isNull(), F.lit("0")).otherwise(F.format_string("%.1f", mean))
        .alias("mean_level_text"),
    )


def stored_alerts(table: DataFrame) -> DataFrame:
    """All stored alerts, newest saved first."""
    return table.orderBy(F.col("created_at").desc(), "id")


def preview(text: Column | str, n: int = 200) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.when(F.length(c) > n, F.concat(cut(c, n), F.lit("..."))).otherwise(c)


def report_list(reports: DataFrame) -> DataFrame:
    """Reports, newest first, with the list preview and the shorter table preview."""
    shown = preview("report_text")
    return reports.select(
        "id", "alert_id", "severity", "agent_name",
        shown.alias("report_preview"),
        F.concat(cut(shown, 60), F.lit("...")).alias("table_preview"),
        "created_at",
    ).orderBy(F.col("created_at").desc(), F.col("id").desc())


def report_by_id(reports: DataFrame, report_id: int) -> DataFrame:
    return reports.where(F.col("id") == report_id)


def flow_labels(flows: DataFrame) -> DataFrame:
    """Number of flows and mean duration per label; durations that are no number are ignored."""
    return flows.groupBy("label").agg(
        F.count("*").alias("n"),
        F.avg(F.col("flow_duration").try_cast("double")).alias("mean_duration"),
    )


def with_latest_classification(alerts: DataFrame, classifications: DataFrame) -> DataFrame:
    """Alerts with the newest classification of their id, else the stored severity.

    The rank filter keeps one row per id already before the shuffle, so an alert that was
    classified very often sends only one row per task.
    """
    newest = Window.partitionBy("alert_id").orderBy(F.col("classified_at").desc(), F.col("id").desc())
    latest = (
        classifications.withColumn("rn", F.row_number().over(newest)).where("rn = 1")
        .select(
            "alert_id", F.col("severity").alias("new_severity"), "classified_at",
        )
    )
    return alerts.join(latest, "alert_id", "left").withColumn(
        "current_severity", F.coalesce("new_severity", "severity")
    ).drop("new_severity")


def severity_by_hour(alerts: DataFrame) -> DataFrame:
    """Alerts per hour, agent and band with subtotals (null = all)."""
    return (
        alerts.select(
            F.date_trunc("hour", "ts").alias("hour"), "agent_name",
            queue_band("rule_level").alias("band"),
        )
        .rollup("hour", "agent_name", "band")
        .agg(F.count("*").alias("n"))
    )
