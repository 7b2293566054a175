"""Alerts as JSON lines: batch and live readers, and the lines that cannot be read.

Files and folders go through Spark's JSON source, which parses each line once and only the
columns a job asks for. Lines that arrive as text from another source (such as ``tail``) use
``parse_lines``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas
from ..functions.text import py_strip

CORRUPT = "_corrupt"
RAW_FIELDS = ["id", "timestamp", "location", "full_log", "message", "rule", "agent", "data"]
# objects inside an alert: read as text, so that a field of another kind never spoils its line
OBJECTS = {"rule": schemas.RULE, "agent": schemas.AGENT}
_LINE = ", ".join(f"{f} STRING" for f in RAW_FIELDS)
_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}


def readable(rows: DataFrame, witness: str) -> DataFrame:
    """Rows of well-formed lines. The second test never holds; it makes the reader parse a line
    also for jobs that ask for no column at all, such as a count."""
    return rows.where(F.col(CORRUPT).isNull() | (F.col(witness) == F.col(CORRUPT))).drop(CORRUPT)


def with_objects(rows: DataFrame, objects: dict[str, str]) -> DataFrame:
    """Parse object columns from their text; what does not fit becomes null, field by field."""
    return rows.withColumns({name: F.from_json(name, layout) for name, layout in objects.items()})


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """Readable alerts of a file or folder; blank and malformed lines are left out.

    Which rows come back does not depend on the columns asked for: every well-formed line is a row.
    """
    df = spark.read.schema(f"{_LINE}, {CORRUPT} STRING").options(**_OPTIONS).json(path)
    return with_objects(readable(df, "id"), OBJECTS)


def stream_alerts(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    """The same for the files that land in a folder; each file is read once.

    ``max_files`` limits the files of one micro-batch.
    """
    reader = spark.readStream.schema(f"{_LINE}, {CORRUPT} STRING").options(**_OPTIONS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return with_objects(readable(reader.json(folder), "id"), OBJECTS)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def stream_lines(spark: SparkSession, folder: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(folder)


def parse_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Every non-blank line with its parsed ``alert``; ``alert._corrupt`` is set if malformed."""
    return (
        lines.select(py_strip(value).alias("line"))
        .where(F.length("line") > 0)
        .select("line", F.from_json("line", f"{_LINE}, {CORRUPT} STRING", _OPTIONS).alias("alert"))
    )


def alerts_of(parsed: DataFrame, with_line: bool = False) -> DataFrame:
    """The readable alerts, one column per raw field; ``with_line`` keeps the whole source line,
    for jobs that store alerts or need an id from all their keys."""
    line = ["line"] if with_line else []
    rows = parsed.select(*line, f"alert.{CORRUPT}", *[f"alert.{f}" for f in RAW_FIELDS])
    return with_objects(rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT), OBJECTS)


def read_whole_alerts(spark: SparkSession, path: str) -> DataFrame:
    """``read_alerts`` with the source line of each alert."""
    return alerts_of(parse_lines(read_lines(spark, path)), with_line=True)


def rejected_lines(parsed: DataFrame) -> DataFrame:
    """The lines a reader would silently drop."""
    return parsed.where(F.col(f"alert.{CORRUPT}").isNotNull()).select("line")
