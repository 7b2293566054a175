"""Raw alert -> normalised alert: projection, category, forward filter, validation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .. import schemas
from ..functions.text import col, cut, first_truthy
from ..sources.alerts import CORRUPT, RAW_FIELDS, readable, with_objects

# fixed values: lowest level and skipped rules of the forwarder
MIN_LEVEL = 5
SKIP_RULES = ["533", "531", "510"]
# fixed values: lowest level to index and to mail
INDEX_LEVEL, MAIL_LEVEL = 3, 12
RAW_LOG_LENGTH = 500

# fixed values: category by rule group (exact, tested first), then by words in the description
GROUP_CATEGORIES = [
    ("brute_force", ["authentication_failed", "authentication_failures", "sshd"]),
    ("malware", ["rootcheck", "rootkit", "trojan"]),
    ("reconnaissance", ["recon", "scan", "nmap"]),
    ("privilege_escalation", ["privilege_escalation", "sudo"]),
]
WORD_CATEGORIES = [
    ("brute_force", ["brute", "authentication fail"]),
    ("malware", ["rootkit", "hidden"]),
    ("reconnaissance", ["scan", "port"]),
]


def infer_category(groups: Column | str, description: Column | str) -> Column:
    names = F.transform(F.coalesce(col(groups), F.array().cast("array<string>")), F.lower)
    words = F.lower(F.coalesce(col(description), F.lit("")))
    branches = [
        (F.arrays_overlap(names, F.array(*map(F.lit, keys))), name)
        for name, keys in GROUP_CATEGORIES
    ]
    for name, keys in WORD_CATEGORIES:
        hit = F.lit(False)
        for key in keys:
            hit = hit | words.contains(key)
        branches.append((hit, name))
    out = F
    for test, name in branches:
        out = out.when(test, F.lit(name))
    return out.otherwise(F.lit("other"))


def rule_level(level: Column | str) -> Column:
    """Level as int: missing is 0, decimals are cut toward zero, other text is null (and fails
    validation)."""
    text = F.trim(F.coalesce(col(level), F.lit("0")))
    return F.regexp_replace(text, r"^([+-]?\d+)\.\d*$", "$1").try_cast("int")


def rule_id(rule: Column | str) -> Column:
    return F.coalesce(col(rule), F.lit("0"))


def should_forward(
    raw: DataFrame, min_level: int = MIN_LEVEL, skip: list[str] = SKIP_RULES
) -> Column:
    """Forward predicate over the raw columns; false when the level cannot be read."""
    return F.coalesce(rule_level(raw["rule.level"]) >= min_level, F.lit(False)) & ~rule_id(
        raw["rule.id"]
    ).isin(*skip)


def forward(raw: DataFrame, min_level: int = MIN_LEVEL, skip: list[str] = SKIP_RULES) -> DataFrame:
    return raw.where(should_forward(raw, min_level, skip))


def forward_counts(raw: DataFrame, **rules) -> DataFrame:
    """Number of forwarded and skipped alerts."""
    flag = should_forward(raw, **rules)
    return raw.groupBy(flag.alias("forwarded")).agg(F.count("*").alias("n"))


def at_level(alerts: DataFrame, min_level: int, level: str = "rule_level") -> DataFrame:
    """Alerts to index (3) or to mail (12), by site settings."""
    return alerts.where(F.col(level) >= min_level)


def with_data(raw: DataFrame) -> DataFrame:
    """Parse the known keys of ``data`` once; ``data_keys`` tells absent from null."""
    data = F.coalesce("data", F.lit("{}"))
    return raw.withColumn("data_keys", F.json_object_keys(data)).withColumn(
        "data", F.from_json(data, schemas.ALERT_DATA)
    )


def source_ip() -> Column:
    return first_truthy("data.srcip", "data.src_ip")


def destination_ip() -> Column:
    return first_truthy("data.dstip", "agent.ip")


def username() -> Column:
    return first_truthy("data.dstuser", "data.srcuser", "data.user")


def file_hash() -> Column:
    """md5 if that key is present, whatever its value, else sha256."""
    has_md5 = F.array_contains("data_keys", "md5")
    return F.when(has_md5, F.col("data.md5")).otherwise(F.col("data.sha256"))


def normalise(raw: DataFrame, ingest_time: Column | None = None) -> DataFrame:
    """Project raw alerts to the normalised schema.

    A missing id becomes a hash of the content (of the whole ``line`` where the reader kept it, so
    that keys outside the raw fields count too) and a missing time the ``ingest_time``, so that a
    rerun gives the same row. Columns other than the raw fields are carried along.
    """
    keep = [c for c in raw.columns if c not in RAW_FIELDS]
    content = F.col("line") if "line" in keep else F.to_json(F.struct(*RAW_FIELDS))
    now = ingest_time if ingest_time is not None else F.current_timestamp()
    null_int = F.lit(None).cast("int")
    fallback_id = F.concat(F.lit("alert-"), F.sha2(content, 256))
    raw = with_data(raw.withColumn("id", F.coalesce("id", fallback_id)))
    return raw.select(
        *keep,
        F.col("id").alias("alert_id"),
        F.coalesce("timestamp", F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")).alias(
            "timestamp"
        ),
        F.struct(
            F.coalesce("agent.name", F.lit("unknown")).alias("agent_name"),
            F.coalesce("agent.ip", F.lit("unknown")).alias("agent_ip"),
        ).alias("source"),
        F.struct(
            rule_id("rule.id").alias("id"),
            F.coalesce("rule.description", F.lit("Unknown")).alias("description"),
            rule_level("rule.level").alias("level"),
        ).alias("rule"),
        infer_category("rule.groups", "rule.description").alias("category"),
        cut(F.coalesce("full_log", "message", F.lit("")), RAW_LOG_LENGTH).alias("raw_log"),
        F.struct(
            source_ip().alias("src_ip"),
            destination_ip().alias("dst_ip"),
            null_int.alias("src_port"),
            null_int.alias("dst_port"),
            username().alias("username"),
            F.col("data.process").alias("process_name"),
            file_hash().alias("file_hash"),
        ).alias("indicators"),
        F.struct(
            F.get("rule.mitre.id", F.lit(0)).alias("technique_id"),
            F.get("rule.mitre.technique", F.lit(0)).alias("technique_name"),
        ).alias("mitre_hint"),
        F.lit("new").alias("status"),
    )


# required fields of a normalised alert, by path
REQUIRED = [
    "alert_id", "timestamp", "source.agent_name", "source.agent_ip", "rule.id",
    "rule.description", "rule.level", "category", "raw_log", "indicators", "mitre_hint",
]
# paths whose value has the wrong type; made by read_normalised, used by validated
TYPE_ERRORS = "_type_errors"
_NUMBERS = ["rule.level", "indicators.src_port", "indicators.dst_port"]


def validated(alerts: DataFrame) -> DataFrame:
    """Add ``errors``, the paths of missing required fields; a null status becomes 'new'."""
    checks = [F.when(F.col(path).isNull(), F.lit(path)) for path in REQUIRED]
    errors = F.array_compact(F.array(*checks))
    if TYPE_ERRORS in alerts.columns:
        errors = F.array_union(errors, F.col(TYPE_ERRORS))
    return alerts.withColumn("errors", errors).drop(TYPE_ERRORS).withColumn(
        "status", F.coalesce("status", F.lit("new"))
    )


def valid_alerts(alerts: DataFrame) -> DataFrame:
    return validated(alerts).where(F.size("errors") == 0).drop("errors")


def rejected_alerts(alerts: DataFrame) -> DataFrame:
    return validated(alerts).where(F.size("errors") > 0)


def read_normalised(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """Alerts that arrive as normalised JSON lines; ``extra`` names further fields to keep.

    Every well-formed line is a row: objects are read as text and their fields one by one, numbers
    by a cast that may fail. Paths that hold something of the wrong type are kept in ``_type_errors``,
    so that such an alert is among the rejected ones.
    """
    fields = T.StructType.fromDDL(schemas.NORMALISED_ALERT).fields
    objects = {f.name: f.dataType for f in fields if isinstance(f.dataType, T.StructType)}
    line = ", ".join(f"{f.name} STRING" for f in fields)
    layout = f"{extra}, {line}, {CORRUPT} STRING" if extra else f"{line}, {CORRUPT} STRING"
    reader = spark.read.schema(layout).option("columnNameOfCorruptRecord", CORRUPT)
    rows = readable(reader.json(path), "alert_id")
    loose = {
        name: ", ".join(f"{f.name} STRING" for f in kind.fields) for name, kind in objects.items()
    }
    parsed = with_objects(rows.withColumns({f"_{n}_text": F.trim(n) for n in objects}), loose)
    wrong = [
        F.when(F.col(f"_{n}_text").isNotNull() & ~F.col(f"_{n}_text").startswith("{"), F.lit(n))
        for n in objects
    ]
    wrong += [
        F.when(F.col(p).isNotNull() & F.col(p).try_cast("int").isNull(), F.lit(p)) for p in _NUMBERS
    ]
    marked = parsed.withColumn(TYPE_ERRORS, F.array_compact(F.array(*wrong)))
    for path in _NUMBERS:
        name, field = path.split(".")
        marked = marked.withColumn(name, F.col(name).withField(field, F.col(path).try_cast("int")))
    return marked.drop(*[f"_{n}_text" for n in objects])


def flat(normalised: DataFrame) -> DataFrame:
    """Flat view of normalised alerts for the triage, dashboard and detection jobs."""
    return normalised.select(
        "alert_id",
        F.col("timestamp"),
        F.regexp_replace("timestamp", r"([+-]\d{2})(\d{2})$", "$1:$2")
        .try_cast("timestamp").alias("ts"),
        F.col("source.agent_name").alias("agent_name"),
        F.col("source.agent_ip").alias("agent_ip"),
        F.col("rule.id").alias("rule_id"),
        F.col("rule.level").alias("rule_level"),
        F.col("rule.description").alias("description"),
        "category", "raw_log", "status",
        F.col("indicators.src_ip").alias("src_ip"),
        F.col("indicators.dst_ip").alias("dst_ip"),
        F.col("indicators.username").alias("username"),
        F.col("indicators.file_hash").alias("file_hash"),
        F.col("mitre_hint.technique_id").alias("technique_id"),
    )
