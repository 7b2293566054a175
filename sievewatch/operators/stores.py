"""The stored tables: alerts, classifications, reports and the knowledge collections.

Alerts are a Parquet folder with a single writer: a save is an append of new rows only, so saving the
same batch again adds nothing. Classifications and reports are versioned tables (``snapshots``).
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import schemas
from ..functions.text import iso_timestamp
from ..plans.row_ids import with_row_ids
from ..session import reliable_checkpoint
from ..sources.alerts import RAW_FIELDS
from . import snapshots
from .normalise import rule_level

BROADCAST_IDS = 200_000  # new ids of a batch that may be broadcast


def read_table(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """The table, or no rows when it was never written."""
    try:
        return spark.read.schema(ddl).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ddl)


def alert_records(raw: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Raw alerts in table shape; missing fields become '' or 0, the severity 'UNKNOWN'.

    ``raw_data`` is the whole source line if the reader kept it (``read_whole_alerts``), else what
    the raw fields hold of it.
    """
    extra = [c for c in raw.columns if c not in RAW_FIELDS and c != "line"]
    empty = F.lit("")
    severity = F.col("severity") if "severity" in raw.columns else F.lit(None).cast("string")
    whole = F.struct(*[c for c in RAW_FIELDS if c in raw.columns])
    return raw.select(
        *[c for c in extra if c != "severity"],
        F.coalesce("id", empty).alias("id"),
        F.coalesce("timestamp", empty).alias("timestamp"),
        F.coalesce("rule.id", empty).alias("rule_id"),
        F.coalesce(rule_level("rule.level"), F.lit(0)).alias("rule_level"),
        F.coalesce("rule.description", empty).alias("description"),
        F.coalesce("agent.name", empty).alias("agent_name"),
        F.coalesce("agent.ip", empty).alias("agent_ip"),
        F.coalesce(severity, F.lit("UNKNOWN")).alias("severity"),
        (F.col("line") if "line" in raw.columns else F.to_json(whole)).alias("raw_data"),
        (created_at if created_at is not None else F.current_timestamp()).alias("created_at"),
    )


def normalised_records(alerts: DataFrame, created_at: Column | None = None) -> DataFrame:
    """Normalised alerts in table shape."""
    whole = F.struct(*alerts.columns)
    return alerts.select(
        F.col("alert_id").alias("id"), "timestamp", F.col("rule.id").alias("rule_id"),
        F.col("rule.level").alias("rule_level"), F.col("rule.description").alias("description"),
        F.col("source.agent_name").alias("agent_name"), F.col("source.agent_ip").alias("agent_ip"),
        F.lit("UNKNOWN").alias("severity"), F.to_json(whole).alias("raw_data"),
        (created_at if created_at is not None else F.current_timestamp()).alias("created_at"),
    )


def first_per_id(records: DataFrame, arrival: str | None = None) -> DataFrame:
    """One record per id, the first by arrival; copies are merged before the shuffle."""
    columns = [c for c in records.columns if c not in {"id", arrival}]
    order = [arrival] if arrival else []
    first = F.min(F.struct(*order, *columns)).alias("r")
    return records.groupBy("id").agg(first).select("id", *[f"r.{c}" for c in columns])


def new_records(records: DataFrame, table: DataFrame, arrival: str | None = None) -> DataFrame:
    """Records whose id is not stored yet.

    The new ids are found first, from the id columns alone, so that whole records are shuffled only
    for them, and not at all when they are few enough for a broadcast.
    """
    if table.isEmpty():
        return first_per_id(records, arrival)
    ids = records.select("id").distinct().join(table.select("id"), "id", "left_anti")
    ids = reliable_checkpoint(ids)
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    new = first_per_id(records.join(ids, "id", "left_semi"), arrival)
    return new.union(first_per_id(records.where("id is null"), arrival))  # null is never known


def save_alerts(spark: SparkSession, records: DataFrame, path: str,
                arrival: str | None = None) -> None:
    """Append the alerts whose id is not stored yet (the first write wins).

    The table is partitioned by the UTC day of the alert, so that reads of a time range touch only
    the folders of its days; alerts whose time cannot be read lie in the folder without a day.
    """
    table = read_table(spark, path, schemas.ALERTS_TABLE)
    columns = [c for c in table.columns if c != "day"]
    day = F.to_date(iso_timestamp("timestamp")).alias("day")
    new_records(records, table, arrival).select(*columns, day).write.mode("append").partitionBy(
        "day"
    ).parquet(path)


def stored_between(table: DataFrame, start: str, end: str) -> DataFrame:
    """Stored alerts with ``start <= time < end``, compared as instants; days are pruned.

    ``start`` and ``end`` are ISO text, in UTC unless they name an offset.
    """
    low, high = (F.lit(x).cast("timestamp") for x in (start, end))
    days = F.col("day").between(F.to_date(low), F.to_date(high))
    ts = iso_timestamp("timestamp")
    return table.where(days & (ts >= low) & (ts < high))


def stored_without_time(table: DataFrame) -> DataFrame:
    """Stored alerts whose time cannot be read; no range read returns them."""
    return table.where(F.col("day").isNull())


def _append_numbered(
    spark: SparkSession, rows: DataFrame, path: str, ddl: str, order: list[str], batch: int | str | None, writer: str
) -> bool:
    fields = T.StructType.fromDDL(ddl).fields
    n = None

    def numbered(old: dict) -> tuple[DataFrame, int]:
        nonlocal n
        n = rows.count() if n is None else n
        out = with_row_ids(rows, order, start=old["last_id"])
        return out.select([F.col(f.name).cast(f.dataType) for f in fields]), old["last_id"] + n

    return snapshots.commit(spark, path, numbered, writer=writer, batch=batch)


def save_classifications(spark: SparkSession, rows: DataFrame, path: str, batch: int | str | None = None, writer: str = "") -> bool:
    """Append ``alert_id, severity, reasoning, mitre_tactics, classified_at`` with running ids, as one version of the table.

    A ``batch`` that a ``writer`` has saved before adds nothing (False); two writers never give the same id.
    """
    return _append_numbered(
        spark, rows, path, schemas.CLASSIFICATIONS_TABLE,
        ["classified_at", "alert_id", "severity", "reasoning"], batch, writer,
    )


def save_reports(spark: SparkSession, rows: DataFrame, path: str, batch: int | str | None = None, writer: str = "") -> bool:
    """Append ``alert_id, severity, agent_name, report_text, created_at`` with running ids, as ``save_classifications``."""
    return _append_numbered(
        spark, rows, path, schemas.REPORTS_TABLE, ["created_at", "alert_id", "agent_name"], batch, writer
    )


def saved_classifications(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return snapshots.read(spark, path, schemas.CLASSIFICATIONS_TABLE, version)


def saved_reports(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return snapshots.read(spark, path, schemas.REPORTS_TABLE, version)


def save_knowledge(spark: SparkSession, rows: DataFrame, path: str, force: bool = False) -> bool:
    """Fill a knowledge table unless it has rows; ``force`` rebuilds it. True when written."""
    if not force:
        try:
            if not spark.read.parquet(path).isEmpty():
                return False
        except AnalysisException:
            pass  # not there, or a folder without files
    rows.write.mode("overwrite").parquet(path)
    return True
