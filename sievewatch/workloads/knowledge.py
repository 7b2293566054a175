"""Queries: technique and vulnerability knowledge."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import techniques as tq, vulnerabilities as vu
from ..sources import feeds
from .inputs import Registry

R = Registry()

ACTIVE = "NOT deprecated AND NOT revoked"
TACTICS = """CASE phase_name WHEN 'credential-access' THEN 'Credential Access'
  WHEN 'command-and-control' THEN 'Command And Control' ELSE 'Defense Evasion' END
  || ', Initial Access'"""


def first(listed: str, n: int, empty: str) -> str:
    return (
        f"CASE WHEN {listed} IS NULL THEN '{empty}' "
        f"ELSE array_to_string((string_split({listed}, ','))[1:{n}], ', ') END"
    )


DOCUMENT = f"""trim('MITRE ATT&CK Technique: ' || coalesce(technique_id, 'UNKNOWN') || ' — ' || name
  || chr(10) || chr(10) || 'Tactics: ' || {TACTICS} || chr(10) || 'Platforms: '
  || {first('platform_list', 99, 'Unknown')} || chr(10) || chr(10) || 'Description:' || chr(10)
  || left(plain_text, 1500) || chr(10) || chr(10) || 'Detection Data Sources: '
  || {first('source_list', 5, 'Not specified')})"""


def objects(t):
    """The landed objects, parsed once into Parquet."""
    landed = t.landed("stix_lines")
    return feeds.cached_feed(t.spark, landed, f"{landed}-parsed", feeds.read_stix_lines)


R.add("s3_bundle_objects", """
SELECT doc, 1 AS pos, 'attack-pattern' AS type, 'attack-pattern--' || CAST(doc AS STRING) AS id,
  p_name AS name FROM stix_bundles JOIN part ON p_partkey = doc
UNION ALL
SELECT doc, 0, 'x-mitre-tactic', 'x-' || CAST(p_size AS STRING), NULL
FROM stix_bundles JOIN part ON p_partkey = doc""", "stix_bundles")(
    lambda t: feeds.parse_stix_bundles(t.stix_bundles).select("doc", "pos", "type", "id", "name")
)

R.add("s10_cached_feed", """
SELECT pos, 'attack-pattern' AS type, name FROM techniques
UNION ALL SELECT 10000000 + s_suppkey, 'intrusion-set', s_name FROM supplier
UNION ALL SELECT pos, 'relationship', NULL FROM uses_edges""", "techniques", "uses_edges")(
    lambda t: objects(t).select("pos", "type", "name")
)

R.add("k1_active_techniques", f"SELECT stix_id AS id, name FROM techniques WHERE {ACTIVE}",
      "techniques")(
    lambda t: tq.active_techniques(objects(t)).select("id", "name")
)

R.add("k2_technique_id", "SELECT stix_id AS id, technique_id FROM techniques", "techniques")(
    lambda t: objects(t).where(F.col("type") == tq.TECHNIQUE).select(
        "id", tq.technique_id().alias("technique_id")
    )
)

R.add("k3_tactics", f"SELECT stix_id AS id, {TACTICS} AS tactics FROM techniques", "techniques")(
    lambda t: objects(t).where(F.col("type") == tq.TECHNIQUE).select(
        "id", F.array_join(tq.tactics(), ", ").alias("tactics")
    )
)

R.add("k4_platforms_sources", f"""
SELECT stix_id AS id, {first('platform_list', 5, 'unknown')} AS platforms,
  {first('source_list', 3, '')} AS detection, {first('source_list', 5, 'Not specified')} AS sources
FROM techniques""", "techniques")(
    lambda t: objects(t).where(F.col("type") == tq.TECHNIQUE).select(
        "id", tq.join_or(tq.platforms(5), "unknown").alias("platforms"),
        tq.join_or(tq.data_sources(3), "").alias("detection"),
        tq.join_or(tq.data_sources(5), "Not specified").alias("sources"),
    )
)

R.add("k5_strip_links", "SELECT stix_id AS id, plain_text AS description FROM techniques",
      "techniques")(
    lambda t: objects(t).where(F.col("type") == tq.TECHNIQUE).select(
        "id", tq.strip_links("description").alias("description")
    )
)

R.add("k6_technique_document", f"""
SELECT stix_id AS id, {DOCUMENT} AS text FROM techniques WHERE {ACTIVE}""", "techniques")(
    lambda t: tq.with_parts(tq.active_techniques(objects(t))).select(
        "id", tq.technique_document().alias("text")
    )
)

R.add("k7_plain_document", f"""
SELECT technique_id AS id, name, technique_id || ' - ' || name || chr(10) || chr(10)
  || 'Description: ' || linked_text || chr(10) || chr(10) || 'Detection: '
  || coalesce(detection_text, 'No detection guidance available') || chr(10) AS text
FROM techniques WHERE {ACTIVE} AND technique_id IS NOT NULL""", "techniques")(
    lambda t: tq.plain_techniques(objects(t))
)

R.add("k8_object_index", """
SELECT id, pos, type, name FROM (SELECT *, row_number() OVER (
    PARTITION BY id ORDER BY pos DESC, name DESC) AS rn FROM (
  SELECT 'relationship--' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) AS id,
    l_orderkey * 10 + l_linenumber AS pos, 'relationship' AS type,
    l_returnflag || l_linestatus AS name FROM lineitem) x) y WHERE rn = 1""")(
    lambda t: tq.object_index(t.lineitem.select(
        F.concat(F.lit("relationship--"), F.col("l_partkey").cast("string"), F.lit("-"),
                 F.col("l_suppkey").cast("string")).alias("id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"),
        F.lit("relationship").alias("type"),
        F.concat("l_returnflag", "l_linestatus").alias("name"),
    ))
)

EDGES = """SELECT 'attack-pattern--' || CAST(l_partkey AS STRING) AS stix_id, pos,
  s_name AS group_name FROM uses_edges JOIN supplier ON l_suppkey = s_suppkey
  JOIN part ON l_partkey = p_partkey"""

R.add("k9_group_edges", EDGES, "uses_edges")(lambda t: tq.group_edges(objects(t)))

R.add("k10_group_count", f"SELECT count(DISTINCT group_name) AS n_groups FROM ({EDGES}) e",
      "uses_edges")(lambda t: tq.group_count(tq.group_edges(objects(t))))

R.add("k11_technique_rows", f"""
, g AS (SELECT stix_id, string_agg(group_name, ', ' ORDER BY pos) AS threat_groups FROM (
    SELECT *, row_number() OVER (PARTITION BY stix_id ORDER BY pos) AS rn FROM ({EDGES}) e) x
  WHERE rn <= 10 GROUP BY stix_id)
SELECT 'MITRE ATT&CK' AS source, t.stix_id, technique_id AS id, name, {DOCUMENT} AS text,
  {TACTICS} AS tactics, {first('platform_list', 5, 'unknown')} AS platforms,
  contains(technique_id, '.') AS is_subtechnique, {first('source_list', 3, '')} AS detection,
  coalesce(threat_groups, 'none') AS threat_groups
FROM techniques t LEFT JOIN g ON g.stix_id = t.stix_id
WHERE {ACTIVE} AND technique_id IS NOT NULL""", "techniques", "uses_edges")(
    lambda t: tq.technique_rows(objects(t))
)

R.add("k12_techniques_of_group", f"""
SELECT stix_id AS id, name FROM techniques WHERE stix_id IN (
  SELECT stix_id FROM ({EDGES}) e WHERE group_name = 'Supplier#000000007')""",
      "techniques", "uses_edges")(
    lambda t: tq.techniques_of_group(
        tq.group_edges(objects(t)),
        objects(t).where(F.col("type") == tq.TECHNIQUE).select("id", "name"),
        "Supplier#000000007",
    )
)

R.add("k13_first_techniques", """
SELECT pos, coalesce(technique_id, 'N/A') AS technique_id, name,
  replace(left(linked_text, 200), chr(10), ' ') || '...' AS summary
FROM techniques ORDER BY pos LIMIT 10""", "techniques")(
    lambda t: tq.first_techniques(objects(t))
)

# --- vulnerabilities -----------------------------------------------------------------------

DESCRIPTION = "CASE WHEN lang = 'en' THEN description ELSE 'No description available' END"
SEVERITY = "CASE WHEN metric_key IS NULL THEN 'UNKNOWN' ELSE band END"
SCORE = "CASE WHEN metric_key IS NULL THEN 0.0::DOUBLE ELSE base_score END"
WEAK = """list_concat(['CWE-' || CAST(p_size AS STRING), 'CWE-79', 'CWE-79'],
  CASE WHEN wide THEN ['CWE-20'] ELSE [] END)"""
# every product of a feed item, beyond what the texts show
ALL_PRODUCTS = """list_distinct(list_concat([vendor || ' ' || product, 'late late',
    vendor || ' tool_' || CAST(p_size AS STRING)], CASE WHEN wide THEN list_concat(['fourth config'],
    [vendor || ' x' || CAST(i AS STRING) FOR i IN range(1, 7)],
    [vendor || ' y' || CAST(i AS STRING) FOR i IN range(1, 7)]) ELSE [] END))"""
PRODUCTS = """list_concat([vendor || ' ' || product, vendor || ' tool_' || CAST(p_size AS STRING)],
  CASE WHEN wide THEN [vendor || ' x1', vendor || ' y1', vendor || ' x2', vendor || ' y2',
    vendor || ' x3', vendor || ' y3', vendor || ' x4', vendor || ' y4'] ELSE [] END)"""
CVE_TEXT = f"""'CVE: ' || cve_id || chr(10) || 'Severity: ' || {SEVERITY} || ' (CVSS Score: '
  || CAST({SCORE} AS STRING) || ')' || chr(10) || 'Published: ' || day || chr(10) || chr(10)
  || 'Description:' || chr(10) || {DESCRIPTION} || chr(10) || chr(10) || 'Weakness Type: '
  || array_to_string({WEAK}, ', ') || chr(10) || 'Affected Products: '
  || array_to_string({PRODUCTS}, ', ')"""


def items(t):
    """The landed items, parsed once into Parquet."""
    landed = t.landed("cve_lines")
    return feeds.cached_feed(t.spark, landed, f"{landed}-parsed", feeds.read_cve_lines)


R.add("s4_feed_items", "SELECT 0 AS pos, cve_id AS id, day AS published FROM cves", "cves")(
    lambda t: feeds.parse_cve_feeds(t.cve_docs).select("pos", "id", "published")
)

R.add("v1_english_description", f"SELECT cve_id AS id, {DESCRIPTION} AS description FROM cves",
      "cves")(lambda t: items(t).select("id", vu.english_description().alias("description")))

R.add("v2_severity", f"SELECT cve_id AS id, {SEVERITY} AS severity FROM cves", "cves")(
    lambda t: items(t).select("id", vu.severity().alias("severity"))
)

R.add("v3_score", f"SELECT cve_id AS id, {SCORE} AS score FROM cves", "cves")(
    lambda t: items(t).select("id", vu.score().alias("score"))
)

R.add("v4_lookup_variant", """
SELECT cve_id AS id, CASE WHEN metric_key IS NULL THEN NULL ELSE base_score END AS score,
  CASE WHEN metric_key IS NULL THEN NULL ELSE band END AS severity FROM cves""", "cves")(
    lambda t: items(t).select(
        "id", vu.lookup_score().alias("score"), vu.lookup_severity().alias("severity")
    )
)

R.add("v5_listing_variant", """
SELECT cve_id AS id, CASE WHEN metric_key IN ('cvssMetricV31', 'cvssMetricV2') THEN band
  ELSE 'N/A' END AS severity FROM cves""", "cves")(
    lambda t: items(t).select("id", vu.listing_severity().alias("severity"))
)

R.add("v6_weaknesses", f"SELECT cve_id AS id, array_to_string({WEAK}, ', ') AS weaknesses FROM cves",
      "cves")(
    lambda t: items(t).select("id", F.array_join(vu.weaknesses(), ", ").alias("weaknesses"))
)

R.add("v7_affected_products", f"""
SELECT cve_id AS id, array_to_string({PRODUCTS}, ', ') AS products FROM cves""", "cves")(
    lambda t: items(t).select("id", F.array_join(vu.affected_products(), ", ").alias("products"))
)

R.add("v8_cve_document", f"SELECT cve_id AS id, trim({CVE_TEXT}) AS text FROM cves", "cves")(
    lambda t: vu.with_facts(items(t)).select("id", vu.cve_document().alias("text"))
)

R.add("v9_cve_rows", f"""
SELECT 'NVD CVE' AS source, cve_id AS id, cve_id AS name, trim({CVE_TEXT}) AS text,
  {SEVERITY} AS severity, {SCORE} AS cvss_score, day AS published_date,
  array_to_string(({PRODUCTS})[1:5], ', ') AS affected_products,
  array_to_string(({WEAK})[1:3], ', ') AS weakness_types FROM cves""", "cves")(
    lambda t: vu.cve_rows(items(t))
)

CVSS = """CASE WHEN cvss_score IS NULL THEN 'No CVSS score available' ELSE
  CAST(cvss_score AS STRING) || CASE WHEN cvss_score >= 9 THEN '/10 — CRITICAL (immediate action required)'
    WHEN cvss_score >= 7 THEN '/10 — HIGH (urgent attention needed)'
    WHEN cvss_score >= 4 THEN '/10 — MEDIUM (schedule remediation)' ELSE '/10 — LOW (monitor)' END END"""
CACHE_ROWS = ", ".join(
    f"('{i}', '{d}', {s}::DOUBLE, '{v}', '{p}')" for i, d, s, v, p in vu.LOCAL_CACHE
)
LOOKUP = f"""
, cache(cve_id, description, cvss_score, cvss_severity, published) AS (VALUES {CACHE_ROWS}),
feed AS (SELECT cve_id, left({DESCRIPTION}, 300) AS description,
    CASE WHEN metric_key IS NULL THEN NULL ELSE base_score END AS cvss_score,
    CASE WHEN metric_key IS NULL THEN NULL ELSE band END AS cvss_severity, day AS published
  FROM cves),
found AS (SELECT request_id, upper(trim(r.cve_id)) AS cve_id,
    CASE WHEN c.cve_id IS NOT NULL THEN 'cache' WHEN f.cve_id IS NOT NULL THEN 'feed'
      ELSE 'not found' END AS status, coalesce(c.description, f.description) AS description,
    coalesce(c.cvss_score, f.cvss_score) AS cvss_score,
    coalesce(c.cvss_severity, f.cvss_severity) AS cvss_severity,
    coalesce(c.published, f.published) AS published
  FROM cve_requests r LEFT JOIN cache c ON c.cve_id = upper(trim(r.cve_id))
  LEFT JOIN feed f ON f.cve_id = upper(trim(r.cve_id)))
"""

R.add("v10_cve_lookup", LOOKUP + """
SELECT request_id, cve_id, status, description, cvss_score, cvss_severity, published FROM found""",
      "cves", "cve_requests")(
    lambda t: vu.lookup_cves(t.cve_requests, items(t)).drop("answer")
)

R.add("v11_cve_answer", LOOKUP + f"""
SELECT request_id, CASE WHEN status = 'not found'
    THEN 'CVE lookup failed: CVE ' || cve_id || ' not found in NVD database'
  ELSE 'CVE: ' || cve_id || chr(10) || 'Published: ' || published || chr(10) || 'CVSS Score: '
    || {CVSS} || chr(10) || 'Severity: ' || coalesce(cvss_severity, 'None') || chr(10)
    || 'Description: ' || description || '...' END AS answer FROM found""",
      "cves", "cve_requests")(
    lambda t: vu.lookup_cves(t.cve_requests, items(t)).select("request_id", "answer")
)

R.add("v12_cves_in_text", f"""
, ids AS (SELECT DISTINCT doc_id, upper(unnest(regexp_extract_all(text,
    '(?i)\\bCVE-[0-9]{{4}}-[0-9]{{4,}}\\b'))) AS cve_id FROM notes)
SELECT doc_id, i.cve_id, {SEVERITY} AS severity, {SCORE} AS cvss_score
FROM ids i JOIN cves c ON c.cve_id = i.cve_id""", "notes", "cves")(
    lambda t: vu.match_text_cves(
        t.notes,
        items(t).select("id", vu.severity().alias("severity"), vu.score().alias("cvss_score")),
        "text", "doc_id",
    )
)

R.add("v13_software_match", f"""
, inv AS (SELECT vendor, product, count(DISTINCT host) AS n_hosts FROM inventory
  GROUP BY vendor, product),
named AS (SELECT cve_id, {SEVERITY} AS severity, {SCORE} AS cvss_score,
    unnest({ALL_PRODUCTS}) AS vp FROM cves)
SELECT vendor, product, n_hosts, cve_id, severity, cvss_score FROM inv
JOIN named ON vp = vendor || ' ' || product""", "inventory", "cves")(
    lambda t: vu.match_software(t.inventory, vu.software_facts(items(t)))
)

R.add("v14_first_cves", f"""
SELECT pos, cve_id AS id, day AS published, CASE WHEN metric_key IN ('cvssMetricV31',
  'cvssMetricV2') THEN band ELSE 'N/A' END AS severity, left({DESCRIPTION}, 200) || '...' AS summary
FROM cves ORDER BY pos LIMIT 10""", "cves")(lambda t: vu.first_cves(items(t)))
