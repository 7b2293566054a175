"""Vulnerability knowledge from CVE items (``id, published, descriptions, metrics, ...``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.severity import cvss_text
from ..functions.text import col, cut, join_or, py_strip
from ..plans.joins import broadcast_if_small
from ..session import reliable_checkpoint

NO_DESCRIPTION = "No description available"
# fixed values: metric lists in order of preference
METRICS = ["cvssMetricV31", "cvssMetricV30", "cvssMetricV2"]
# fixed values: how many configurations, nodes, matches and products are read
MAX_CONFIGS, MAX_NODES, MAX_MATCHES, MAX_PRODUCTS = 3, 5, 3, 10
CVE_PATTERN = r"(?i)\bCVE-[0-9]{4}-[0-9]{4,}\b"


def english_description() -> Column:
    english = F.get(F.filter("descriptions", lambda d: d["lang"] == "en"), F.lit(0))
    return F.coalesce(english["value"], F.lit(NO_DESCRIPTION))


def _metric(name: str) -> tuple[Column, Column]:
    c = F.col(f"metrics.{name}")
    return F.coalesce(F.size(c) > 0, F.lit(False)), F.get(c, F.lit(0))


def _prefer(names, value, default: Column) -> Column:
    """Value from the first metric list that is present and not empty."""
    out = F
    for name in names:
        present, first = _metric(name)
        out = out.when(present, F.coalesce(value(name, first), default))
    return out.otherwise(default)


def severity() -> Column:
    """Severity by version preference; version 2 keeps it beside ``cvssData``."""
    return _prefer(
        METRICS,
        lambda n, m: m["baseSeverity"] if n == "cvssMetricV2" else m["cvssData"]["baseSeverity"],
        F.lit("UNKNOWN"),
    )


def score() -> Column:
    return _prefer(METRICS, lambda n, m: m["cvssData"]["baseScore"], F.lit(0.0))


def lookup_score() -> Column:
    """Variant of the id lookup: null when there is no metric."""
    return _prefer(METRICS, lambda n, m: m["cvssData"]["baseScore"], F.lit(None).cast("double"))


def lookup_severity() -> Column:
    """Variant of the id lookup: from ``cvssData``, else from the metric, else 'Unknown'."""
    any_metric = F.lit(False)
    for name in METRICS:
        any_metric = any_metric | _metric(name)[0]
    found = _prefer(
        METRICS, lambda n, m: F.coalesce(m["cvssData"]["baseSeverity"], m["baseSeverity"]),
        F.lit("Unknown"),
    )
    return F.when(any_metric, found)


def listing_severity() -> Column:
    """Variant of the listing: version 3.1, else version 2, else 'N/A'."""
    return _prefer(
        ["cvssMetricV31", "cvssMetricV2"],
        lambda n, m: m["baseSeverity"] if n == "cvssMetricV2" else m["cvssData"]["baseSeverity"],
        F.lit("N/A"),
    )


def weaknesses() -> Column:
    """English weakness ids in feed order, repeats kept."""
    per = F.transform(
        "weaknesses",
        lambda w: F.transform(
            F.filter(F.coalesce(w["description"], F.array()), lambda d: d["lang"] == "en"),
            lambda d: F.coalesce(d["value"], F.lit("")),
        ),
    )
    return F.coalesce(F.flatten(per), F.array().cast("array<string>"))


def named_products(configs: int | None = None, nodes: int | None = None, matches: int | None = None) -> Column:
    """Distinct 'vendor product' pairs of the CPE names in feed order; ``None`` sets no limit."""
    def some(items: Column, most: int | None) -> Column:
        items = F.coalesce(items, F.array())
        return items if most is None else F.slice(items, 1, most)

    def of_config(config: Column) -> Column:
        return F.flatten(F.transform(some(config["nodes"], nodes), lambda n: some(n["cpeMatch"], matches)))

    cpes = F.flatten(F.transform(some(F.col("configurations"), configs), of_config))
    parts = F.transform(cpes, lambda m: F.split(F.coalesce(m["criteria"], F.lit("")), ":"))
    named = F.filter(parts, lambda p: (F.size(p) >= 5) & (p[3] != "*") & (p[4] != "*"))
    pairs = F.array_distinct(F.transform(named, lambda p: F.concat(p[3], F.lit(" "), p[4])))
    return F.coalesce(pairs, F.array().cast("array<string>"))


def affected_products() -> Column:
    """The products shown in texts and metadata: the first ten of the first configurations."""
    return F.slice(named_products(MAX_CONFIGS, MAX_NODES, MAX_MATCHES), 1, MAX_PRODUCTS)


def published_day(default: str) -> Column:
    return cut(F.coalesce("published", F.lit(default)), 10)


def with_facts(items: DataFrame) -> DataFrame:
    """Evaluate each extraction once; the document and metadata columns build on these."""
    return items.select(
        "id", english_description().alias("description"), severity().alias("severity"),
        score().alias("cvss_score"), weaknesses().alias("weaknesses"),
        affected_products().alias("products"), published_day("Unknown").alias("published"),
        published_day("").alias("published_date"),
    )


def cve_document() -> Column:
    """Document text over the columns of ``with_facts``."""
    return py_strip(F.concat(
        F.lit("CVE: "), F.col("id"), F.lit("\nSeverity: "), F.col("severity"),
        F.lit(" (CVSS Score: "), F.col("cvss_score").cast("string"),
        F.lit(")\nPublished: "), F.col("published"),
        F.lit("\n\nDescription:\n"), F.col("description"),
        F.lit("\n\nWeakness Type: "), join_or("weaknesses", "Not specified"),
        F.lit("\nAffected Products: "), join_or("products", "Not specified"), F.lit("\n"),
    ))


def cve_rows(items: DataFrame) -> DataFrame:
    """Knowledge rows: document text and flat metadata."""
    return with_facts(items).select(
        F.lit("NVD CVE").alias("source"), "id", F.col("id").alias("name"),
        cve_document().alias("text"), "severity", "cvss_score", "published_date",
        join_or(F.slice("products", 1, 5), "unknown").alias("affected_products"),
        join_or(F.slice("weaknesses", 1, 3), "unknown").alias("weakness_types"),
    )


# fixed values: the built-in answers of the id lookup (id, description, score, severity, day)
LOCAL_CACHE = [
    ("CVE-2021-44228", "Apache Log4j2 remote code execution vulnerability. Allows attackers to "
     "execute arbitrary code via JNDI lookup.", 10.0, "CRITICAL", "2021-12-10"),
    ("CVE-2023-38408", "OpenSSH ssh-agent PKCS#11 remote code execution. Allows remote attackers "
     "to execute arbitrary commands.", 9.8, "CRITICAL", "2023-07-20"),
    ("CVE-2022-30190", "Microsoft Windows Support Diagnostic Tool (MSDT) remote code execution "
     "vulnerability (Follina).", 7.8, "HIGH", "2022-06-01"),
    ("CVE-2021-34527", "Windows Print Spooler remote code execution vulnerability "
     "(PrintNightmare).", 8.8, "HIGH", "2021-07-02"),
    ("CVE-2023-44487", "HTTP/2 Rapid Reset Attack causing denial of service in multiple web "
     "servers.", 7.5, "HIGH", "2023-10-10"),
]
LOOKUP_SCHEMA = (
    "cve_id STRING, description STRING, cvss_score DOUBLE, cvss_severity STRING, published STRING"
)


def local_cache(spark) -> DataFrame:
    return spark.createDataFrame(LOCAL_CACHE, LOOKUP_SCHEMA)


def lookup_rows(items: DataFrame) -> DataFrame:
    """Feed rows in the shape of the id lookup, the first item per id."""
    shaped = items.select(
        F.upper("id").alias("cve_id"), F.struct(
            "pos", cut(english_description(), 300).alias("description"),
            lookup_score().alias("cvss_score"), lookup_severity().alias("cvss_severity"),
            published_day("Unknown").alias("published"),
        ).alias("r"),
    )
    return shaped.groupBy("cve_id").agg(F.min("r").alias("r")).select(
        "cve_id", "r.description", "r.cvss_score", "r.cvss_severity", "r.published"
    )


def lookup_cves(requests: DataFrame, items: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Answer ``(request_id, cve_id)`` rows from the cache, else from the feed.

    ``status`` is 'cache', 'feed' or 'not found'; ``answer`` is the text shown to an analyst.
    """
    cache = local_cache(requests.sparkSession) if cache is None else cache
    asked = requests.withColumn("cve_id", py_strip(F.upper("cve_id")))
    fields = ["description", "cvss_score", "cvss_severity", "published"]
    hit = cache.select("cve_id", F.struct(*fields).alias("c"))
    fed = lookup_rows(items).select("cve_id", F.struct(*fields).alias("f"))
    out = (
        asked.join(F.broadcast(hit), "cve_id", "left")  # the cache is a fixed list
        .join(fed, "cve_id", "left")
        .withColumn("r", F.coalesce("c", "f"))
        .withColumn(
            "status",
            F.when(F.col("c").isNotNull(), "cache").when(F.col("f").isNotNull(), "feed")
            .otherwise("not found"),
        )
        .select("request_id", "cve_id", "status", "r.*")
    )
    return out.withColumn("answer", lookup_answer())


def lookup_answer() -> Column:
    found = F.concat(
        F.lit("CVE: "), F.col("cve_id"), F.lit("\nPublished: "), F.col("published"),
        F.lit("\nCVSS Score: "), cvss_text("cvss_score"),
        F.lit("\nSeverity: "), F.coalesce("cvss_severity", F.lit("None")),
        F.lit("\nDescription: "), F.col("description"), F.lit("..."),
    )
    missing = F.concat(
        F.lit("CVE lookup failed: CVE "), F.col("cve_id"), F.lit(" not found in NVD database")
    )
    return F.when(F.col("status") == "not found", missing).otherwise(found)


def cves_in_text(rows: DataFrame, text: str, key: str) -> DataFrame:
    """Distinct CVE ids a text names, upper case: ``key, cve_id``."""
    ids = F.array_distinct(
        F.transform(F.regexp_extract_all(col(text), F.lit(CVE_PATTERN), F.lit(0)), F.upper)
    )
    return rows.select(key, F.explode(ids).alias("cve_id"))


def match_text_cves(rows: DataFrame, cves: DataFrame, text: str, key: str) -> DataFrame:
    """Texts with the known CVEs they name. The CVE side has one row per id, so a CVE named
    by very many texts only lengthens the text side, which AQE can split."""
    return cves_in_text(rows, text, key).join(cves, F.col("cve_id") == cves["id"]).drop("id")


def software_facts(items: DataFrame) -> DataFrame:
    """What ``match_software`` needs of a feed: every product an item names."""
    return items.select(
        "id", severity().alias("severity"), score().alias("cvss_score"),
        named_products().alias("products"),
    )


def match_software(inventory: DataFrame, cves: DataFrame) -> DataFrame:
    """Installed software (``host, vendor, product``) with the CVEs that name it.

    ``cves`` holds ``id, severity, cvss_score`` and ``products``, here every product of the feed
    item (``named_products()``), not the short list of the texts. Inventory rows are grouped by product first: hosts are counted per product, and the CVE
    join sees each product once. The products of a feed are never broadcast: the size of its files says little of how many it names.
    The counted side is broadcast while it is small by count.
    """
    per_product = reliable_checkpoint(inventory.groupBy("vendor", "product").agg(
        F.countDistinct("host").alias("n_hosts")
    ))
    named = cves.select(
        F.col("id").alias("cve_id"), "severity", "cvss_score",
        F.explode("products").alias("vendor_product"),
    )
    installed = per_product.withColumn("vendor_product", F.concat_ws(" ", "vendor", "product"))
    return broadcast_if_small(installed).join(named.hint("merge"), "vendor_product").drop("vendor_product")


def first_cves(items: DataFrame, n: int = 10) -> DataFrame:
    """The first CVEs of a feed with day, severity and a short text."""
    return items.orderBy("pos").limit(n).select(
        "pos", "id", published_day("N/A").alias("published"), listing_severity().alias("severity"),
        F.concat(cut(english_description(), 200), F.lit("...")).alias("summary"),
    )
