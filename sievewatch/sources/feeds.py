"""Technique bundles (STIX), vulnerability feeds and network-flow CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schemas


def read_stix_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Objects of the bundle documents under ``path`` with document name and position.

    A multi-line document is read by one task; land large ones by line (``read_stix_lines``).
    """
    docs = spark.read.schema(schemas.STIX_BUNDLE).json(path, multiLine=True)
    return explode_bundle(docs.withColumn("doc", F.input_file_name()), ["doc"])


def in_document_order(rows: DataFrame) -> DataFrame:
    """Rows of several documents with a ``pos`` that orders all of them: by document name, then
    position. The operators only compare positions, so "the last definition wins" and "first
    groups" hold across documents."""
    return rows.withColumn("pos", F.struct("doc", "pos"))


def parse_stix_bundles(docs: DataFrame, text: str = "value") -> DataFrame:
    """Objects of bundle documents that are held as text, one document per row."""
    keep = [c for c in docs.columns if c != text]
    parsed = docs.select(*keep, F.from_json(text, schemas.STIX_BUNDLE).alias("b"))
    return explode_bundle(parsed.select(*keep, "b.objects"), keep)


def explode_bundle(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    return docs.select(*keep, F.posexplode("objects").alias("pos", "o")).select(*keep, "pos", "o.*")


def read_stix_lines(spark: SparkSession, path: str) -> DataFrame:
    """Objects that were landed one per line with their ``pos``; the layout for large graphs,
    since Spark can split the files and read only the fields a job uses."""
    return spark.read.schema(f"pos BIGINT, {schemas.STIX_FIELDS}").json(path)


def read_cve_feed(spark: SparkSession, path: str) -> DataFrame:
    """CVE items of the feed documents under ``path`` with document name and position, without
    items that have no id. A multi-line document is read by one task."""
    docs = spark.read.schema(schemas.CVE_FEED).json(path, multiLine=True)
    return explode_feed(docs.withColumn("doc", F.input_file_name()), ["doc"])


def explode_feed(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    items = docs.select(*keep, F.posexplode("vulnerabilities").alias("pos", "v")).select(*keep, "pos", "v.cve.*")
    return items.where("id IS NOT NULL AND id <> ''")


def parse_cve_feeds(docs: DataFrame, text: str = "value") -> DataFrame:
    return explode_feed(docs.select(F.from_json(text, schemas.CVE_FEED).alias("f")).select("f.*"))


def read_cve_lines(spark: SparkSession, path: str) -> DataFrame:
    """CVE items that were landed one per line with their ``pos``."""
    items = spark.read.schema(f"pos BIGINT, {schemas.CVE_ITEM}").json(path)
    return items.where("id IS NOT NULL AND id <> ''")


def cached_feed(spark: SparkSession, landed: str, cache: str, reader) -> DataFrame:
    """Parse a landed document once into Parquet and read that from then on.

    Only a cache that was written to its end counts; what a failed write left is replaced.
    """
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{cache}/_SUCCESS")
    if not mark.getFileSystem(spark._jsc.hadoopConfiguration()).exists(mark):
        reader(spark, landed).write.mode("overwrite").parquet(cache, compression="zstd")
    return spark.read.parquet(cache)


FLOW_COLUMNS = ["Label", "Src IP", "Dst Port", "Flow Duration"]


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """Flow CSV with a header; blanks around header names are removed, all columns are text."""
    raw = spark.read.csv(path, header=True, mode="PERMISSIVE")
    return trim_header(raw)


def trim_header(raw: DataFrame) -> DataFrame:
    return raw.toDF(*[c.strip() for c in raw.columns])


def flow_view(flows: DataFrame) -> DataFrame:
    """The four columns of the flow listing; a missing column reads 'N/A'."""
    have = set(flows.columns)

    def pick(name: str):
        return F.col(f"`{name}`") if name in have else F.lit("N/A")

    def clean(name: str):
        # bytes that are no UTF-8 arrive as U+FFFD; they are dropped
        return F.replace(pick(name), F.lit("\ufffd"), F.lit(""))

    return flows.select(
        F.trim(clean("Label")).alias("label"),
        clean("Src IP").alias("src_ip"),
        clean("Dst Port").alias("dst_port"),
        clean("Flow Duration").alias("flow_duration"),
    )


def first_flows(flows: DataFrame, limit: int = 10) -> DataFrame:
    return flow_view(flows).limit(limit)
