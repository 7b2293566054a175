"""Column layouts of the inputs and tables, as Spark DDL."""

RULE = (
    "id STRING, level STRING, description STRING, groups ARRAY<STRING>, "
    "mitre STRUCT<id: ARRAY<STRING>, technique: ARRAY<STRING>>"
)
# rule.id and rule.level come as number or as string, so both are read as text.
# `data` is an open object and stays JSON text.
AGENT = "id STRING, name STRING, ip STRING"
RAW_ALERT = (
    "id STRING, timestamp STRING, location STRING, full_log STRING, message STRING, "
    f"rule STRUCT<{RULE}>, agent STRUCT<{AGENT}>, data STRING"
)
# keys of `data` the jobs read
ALERT_DATA = (
    "srcip STRING, src_ip STRING, dstip STRING, dstuser STRING, srcuser STRING, user STRING, "
    "process STRING, md5 STRING, sha256 STRING, attempt_count STRING"
)
NORMALISED_ALERT = (
    "alert_id STRING, timestamp STRING, "
    "source STRUCT<agent_name: STRING, agent_ip: STRING>, "
    "rule STRUCT<id: STRING, description: STRING, level: INT>, "
    "category STRING, raw_log STRING, "
    "indicators STRUCT<src_ip: STRING, dst_ip: STRING, src_port: INT, dst_port: INT, "
    "username: STRING, process_name: STRING, file_hash: STRING>, "
    "mitre_hint STRUCT<technique_id: STRING, technique_name: STRING>, status STRING"
)
STIX_FIELDS = (
    "id STRING, type STRING, name STRING, description STRING, revoked BOOLEAN, "
    "x_mitre_deprecated BOOLEAN, "
    "external_references ARRAY<STRUCT<source_name: STRING, external_id: STRING>>, "
    "kill_chain_phases ARRAY<STRUCT<kill_chain_name: STRING, phase_name: STRING>>, "
    "x_mitre_platforms ARRAY<STRING>, x_mitre_data_sources ARRAY<STRING>, "
    "x_mitre_detection STRING, relationship_type STRING, source_ref STRING, target_ref STRING"
)
STIX_BUNDLE = f"type STRING, id STRING, objects ARRAY<STRUCT<{STIX_FIELDS}>>"

_METRIC = (
    "ARRAY<STRUCT<cvssData: STRUCT<baseScore: DOUBLE, baseSeverity: STRING>, baseSeverity: STRING>>"
)
CVE_ITEM = (
    "id STRING, published STRING, descriptions ARRAY<STRUCT<lang: STRING, value: STRING>>, "
    f"metrics STRUCT<cvssMetricV31: {_METRIC}, cvssMetricV30: {_METRIC}, cvssMetricV2: {_METRIC}>, "
    "weaknesses ARRAY<STRUCT<description: ARRAY<STRUCT<lang: STRING, value: STRING>>>>, "
    "configurations ARRAY<STRUCT<nodes: ARRAY<STRUCT<cpeMatch: ARRAY<STRUCT<criteria: STRING>>>>>>"
)
CVE_FEED = f"vulnerabilities ARRAY<STRUCT<cve: STRUCT<{CVE_ITEM}>>>"

ALERTS_TABLE = (
    "id STRING, timestamp STRING, rule_id STRING, rule_level INT, description STRING, "
    "agent_name STRING, agent_ip STRING, severity STRING, raw_data STRING, created_at TIMESTAMP"
)
CLASSIFICATIONS_TABLE = (
    "id BIGINT, alert_id STRING, severity STRING, reasoning STRING, mitre_tactics STRING, "
    "classified_at TIMESTAMP"
)
REPORTS_TABLE = (
    "id BIGINT, alert_id STRING, severity STRING, agent_name STRING, report_text STRING, "
    "created_at TIMESTAMP"
)
