"""Alert, feed and answer shaped rows derived from the test tables.

Each derived input is one SELECT whose text runs unchanged on Spark and on DuckDB. The Spark
jobs read the JSON text columns through the real parsers; the SQL twins use the flat columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import scratch_path

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

LANDED_ROWS = 100_000  # lines of a landed file

DERIVED: dict[str, str] = {}

# the one function whose name differs between the engines
DIALECT = {"list_reverse(": "reverse("}

# one alert per event; k is the number inside props
DERIVED["alerts"] = """
SELECT CAST(event_id AS STRING) AS alert_id, ts,
  replace(left(CAST(ts AS STRING), 19), ' ', 'T') || '.000Z' AS timestamp,
  'agent-' || lpad(CAST(user_id % 25 AS STRING), 2, '0') AS agent_name,
  '10.0.' || CAST(user_id % 4 AS STRING) || '.' || CAST(user_id % 250 AS STRING) AS agent_ip,
  CAST(CASE WHEN k IN (10, 31, 33) THEN 500 + k ELSE 5700 + k END AS STRING) AS rule_id,
  CAST(least(15, floor(value / 12)) AS INT) AS rule_level,
  CASE event_type WHEN 'error' THEN 'sshd: authentication failed'
    WHEN 'signup' THEN 'Host-based anomaly detection event' WHEN 'view' THEN 'Nmap probe'
    WHEN 'click' THEN 'sudo to root' ELSE 'Usage report written' END AS description,
  split(tags, ',') AS rule_groups, tags,
  CASE WHEN k % 5 = 0 THEN '' WHEN k % 5 = 1 THEN NULL
    ELSE '198.51.100.' || CAST(k AS STRING) END AS srcip,
  '203.0.113.' || CAST(k AS STRING) AS src_ip_alt,
  CASE WHEN k % 3 = 0 THEN k * 11 ELSE 0 END AS attempts,
  CASE event_type WHEN 'error' THEN 'T1110' WHEN 'signup' THEN 'T1014' END AS technique_id,
  CASE event_type WHEN 'error' THEN 'Brute Force' WHEN 'signup' THEN 'Rootkit' END
    AS technique_name,
  k, event_type, event_id AS seq
FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k,
  CASE event_type WHEN 'error' THEN 'syslog,sshd,authentication_failed'
    WHEN 'signup' THEN 'ossec,rootcheck' WHEN 'view' THEN 'recon,network'
    WHEN 'click' THEN 'syslog,sudo' ELSE 'syslog' END AS tags FROM events) e
"""

# the open fields of the raw alert
DERIVED["raw_fields"] = """
SELECT *,
  CASE k % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE '10.9.0.' || CAST(k AS STRING) END AS dstip,
  CASE k % 4 WHEN 0 THEN 'root' WHEN 1 THEN '' END AS dstuser,
  CASE k % 4 WHEN 2 THEN 'svc' WHEN 1 THEN '' END AS srcuser,
  CASE WHEN k % 4 > 0 AND k % 7 > 0 THEN 'user' || CAST(k AS STRING) END AS username,
  CASE event_type WHEN 'click' THEN 'sudo' WHEN 'error' THEN 'sshd' END AS process,
  CASE k % 3 WHEN 0 THEN 'null' WHEN 2 THEN '"m' || CAST(k AS STRING) || '"' END AS md5_json,
  CASE WHEN k % 2 = 0 THEN 's' || CAST(k AS STRING) END AS sha256,
  CASE event_type WHEN 'error' THEN 'Failed password for user' || CAST(k AS STRING)
      || ' from 198.51.100.' || CAST(k AS STRING) || ' port ' || CAST(40000 + k AS STRING) || ' ssh2'
    WHEN 'view' THEN repeat('probe ', 1 + rule_level * 12) END AS full_log,
  CASE event_type WHEN 'click' THEN 'sudo: session opened' END AS message
FROM alerts
"""

DERIVED["raw_lines"] = """
SELECT seq, '{"id":"' || alert_id || '","timestamp":"' || timestamp || '",'
  || CASE WHEN full_log IS NULL THEN '' ELSE '"full_log":"' || full_log || '",' END
  || CASE WHEN message IS NULL THEN '' ELSE '"message":"' || message || '",' END
  || '"rule":{"id":' || CASE WHEN k % 2 = 0 THEN rule_id ELSE '"' || rule_id || '"' END
  || ',"level":' || CASE WHEN k % 3 = 0 THEN '"' || CAST(rule_level AS STRING) || '"'
      ELSE CAST(rule_level AS STRING) END
  || ',"description":"' || description || '","groups":["' || replace(tags, ',', '","')
  || '"]' || CASE WHEN technique_id IS NULL THEN CASE WHEN k % 2 = 0 THEN ''
      ELSE ',"mitre":{"id":[],"technique":[]}' END
    ELSE ',"mitre":{"id":["' || technique_id || '"],"technique":["' || technique_name || '"]}' END
  || '},"agent":{"id":"001","name":"' || agent_name || '","ip":"' || agent_ip || '"},"data":{'
  || CASE WHEN srcip IS NULL THEN '' ELSE '"srcip":"' || srcip || '",' END
  || CASE WHEN dstip IS NULL THEN '' ELSE '"dstip":"' || dstip || '",' END
  || CASE WHEN dstuser IS NULL THEN '' ELSE '"dstuser":"' || dstuser || '",' END
  || CASE WHEN srcuser IS NULL THEN '' ELSE '"srcuser":"' || srcuser || '",' END
  || CASE WHEN username IS NULL THEN '' ELSE '"user":"' || username || '",' END
  || CASE WHEN process IS NULL THEN '' ELSE '"process":"' || process || '",' END
  || CASE WHEN md5_json IS NULL THEN '' ELSE '"md5":' || md5_json || ',' END
  || CASE WHEN sha256 IS NULL THEN '' ELSE '"sha256":"' || sha256 || '",' END
  || '"attempt_count":' || CAST(attempts AS STRING) || ',"src_ip":"' || src_ip_alt || '"}}' AS value
FROM raw_fields
"""

# the same file with broken and blank lines in it
DERIVED["mixed_lines"] = """
SELECT seq, CASE WHEN k % 19 = 0 THEN left(value, 40) WHEN k % 19 = 1 THEN '   '
  WHEN k % 19 = 2 THEN 'restarted log' ELSE '  ' || value || ' ' END AS value, k % 19 AS form
FROM (SELECT r.seq, r.value, a.k FROM raw_lines r JOIN alerts a ON r.seq = a.seq) x
"""

# and some alerts whose level cannot be read
DERIVED["live_lines"] = """
SELECT m.seq AS seq, CASE WHEN form = 3 THEN replace(m.value, '"level":', '"level":"n/a","was":') ELSE m.value END AS value,
  CASE WHEN form = 1 THEN 'blank' WHEN form IN (0, 2) THEN 'malformed' WHEN form = 3 THEN 'rule.level'
    WHEN rule_level >= 5 AND rule_id NOT IN ('533', '531', '510') THEN 'kept' ELSE 'skipped' END AS fate
FROM mixed_lines m JOIN alerts a ON m.seq = a.seq
"""

# alerts in the normalised JSON form, some with a required field missing or of the wrong type
DERIVED["posted"] = """
SELECT seq, '{"seq":' || CAST(seq AS STRING) || ',"alert_id":' || CASE WHEN k % 11 = 0 THEN 'null' ELSE '"' || alert_id || '"' END
  || ',"timestamp":"' || timestamp || '"'
  || ',"source":{"agent_name":"' || agent_name || '"'
  || CASE WHEN k % 13 = 0 THEN '' ELSE ',"agent_ip":"' || agent_ip || '"' END || '}'
  || ',"rule":{"id":"' || rule_id || '","description":"' || description || '","level":'
  || CASE WHEN k % 17 = 0 THEN '"high"' ELSE CAST(rule_level AS STRING) END || '}'
  || ',"category":"other","raw_log":""'
  || CASE WHEN k % 23 = 0 THEN '' ELSE ',"indicators":{"src_ip":null}' END
  || ',"mitre_hint":{}' || CASE WHEN k % 2 = 0 THEN ',"status":"seen"' ELSE '' END || '}' AS value,
  alert_id, k
FROM alerts
"""

# free-text requests, one per conversation turn
DERIVED["requests"] = """
SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS request_id,
  CASE WHEN turn = 0 THEN 'Show ALERT ' || CAST(conv_id AS STRING) || ' please'
    WHEN turn = 1 THEN text || ' any critical alerts ?'
    WHEN turn = 2 THEN 'high severity ' || text
    WHEN turn = 3 THEN 'alert 171x99 or ' || CAST(conv_id + 1 AS STRING)
    WHEN turn = 4 THEN 'alert 99999999999 level 7'
    ELSE text END AS text, conv_id, turn
FROM conversations
"""

DERIVED["file_events"] = """
SELECT agent_name AS host, '/etc/file' || CAST(k % 50 AS STRING) AS path,
  'h' || CAST(rule_level AS STRING) AS hash, ts, seq FROM alerts
"""

DERIVED["classifications"] = """
SELECT CAST(CAST(alert_id AS BIGINT) % 1000 AS STRING) AS alert_id,
  CASE WHEN rule_level >= 10 THEN 'CRITICAL' WHEN rule_level >= 5 THEN 'MEDIUM' ELSE 'LOW' END
    AS severity, ts AS classified_at, CAST(alert_id AS BIGINT) AS id FROM alerts
"""

DERIVED["ports"] = """
SELECT agent_name AS host, 1000 + k AS port,
  CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'old' ELSE 'new' END AS snap FROM alerts
"""

DERIVED["reports"] = """
SELECT doc_id AS id, CAST(doc_id AS STRING) AS alert_id,
  CASE WHEN n_chars > 3000 THEN 'HIGH' ELSE 'LOW' END AS severity, source AS agent_name,
  text AS report_text, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * (n_chars % 50)
    AS created_at FROM documents
"""

# --- technique graph -----------------------------------------------------------------------

DERIVED["techniques"] = """
SELECT p_partkey AS pos, 'attack-pattern--' || CAST(p_partkey AS STRING) AS stix_id,
  CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE 'T' || CAST(1000 + p_partkey AS STRING)
    || CASE WHEN p_partkey % 3 = 0 THEN '.001' ELSE '' END END AS technique_id,
  p_name AS name, p_partkey % 17 = 0 AS deprecated, p_partkey % 19 = 0 AS revoked,
  CASE CAST(p_size % 3 AS INT) WHEN 0 THEN 'credential-access' WHEN 1 THEN 'command-and-control'
    ELSE 'defense-evasion' END AS phase_name,
  CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN 'Linux'
    ELSE 'Windows,Linux,macOS,IaaS,SaaS,Network,Containers' END AS platform_list,
  CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 5 = 1 THEN 'File'
    ELSE 'Process,File,Logon Session,Network Traffic,Driver,Firmware' END AS source_list,
  CASE WHEN p_size % 6 = 0 THEN NULL ELSE 'Watch ' || lower(p_brand) END AS detection_text,
  lower(p_type) || ' use of ' || repeat(p_name || ' ', p_size * 3) AS plain_text,
  '[' || lower(p_type) || '](https://example.org/' || CAST(p_size AS STRING) || ') use of '
    || repeat(p_name || ' ', p_size * 3) AS linked_text, p_size
FROM part
"""

DERIVED["uses_edges"] = """
SELECT DISTINCT l_partkey, l_suppkey,
  100000000 + l_partkey * 100000 + l_suppkey AS pos FROM lineitem
"""

DERIVED["stix_lines"] = """
SELECT '{"pos":' || CAST(pos AS STRING) || ',"type":"attack-pattern","id":"' || stix_id
  || '","name":"' || name || '","description":"' || linked_text || '"'
  || CASE WHEN deprecated THEN ',"x_mitre_deprecated":true' ELSE '' END
  || CASE WHEN revoked THEN ',"revoked":true' ELSE '' END
  || ',"external_references":[{"source_name":"capec","external_id":"CAPEC-1"}'
  || CASE WHEN technique_id IS NULL THEN '' ELSE ',{"source_name":"mitre-attack","external_id":"'
    || technique_id || '"},{"source_name":"mitre-attack","external_id":"T0"}' END
  || '],"kill_chain_phases":[{"kill_chain_name":"mitre-attack","phase_name":"' || phase_name
  || '"},{"kill_chain_name":"other","phase_name":"x"},{"kill_chain_name":"mitre-attack",'
  || '"phase_name":"initial-access"}]'
  || CASE WHEN platform_list IS NULL THEN '' ELSE ',"x_mitre_platforms":["'
    || replace(platform_list, ',', '","') || '"]' END
  || CASE WHEN source_list IS NULL THEN '' ELSE ',"x_mitre_data_sources":["'
    || replace(source_list, ',', '","') || '"]' END
  || CASE WHEN detection_text IS NULL THEN '' ELSE ',"x_mitre_detection":"' || detection_text
    || '"' END || '}' AS value FROM techniques
UNION ALL
SELECT '{"pos":' || CAST(10000000 + s_suppkey AS STRING) || ',"type":"intrusion-set","id":"'
  || 'intrusion-set--' || CAST(s_suppkey AS STRING) || '","name":"' || s_name || '"}' FROM supplier
UNION ALL
SELECT '{"pos":' || CAST(pos AS STRING) || ',"type":"relationship","id":"relationship--'
  || CAST(pos AS STRING) || '","relationship_type":"uses","source_ref":"intrusion-set--'
  || CAST(l_suppkey AS STRING) || '","target_ref":"attack-pattern--'
  || CAST(l_partkey AS STRING) || '"}' FROM uses_edges
"""

# one small bundle per technique: the technique and a tactic object
DERIVED["stix_bundles"] = """
SELECT p_partkey AS doc, '{"type":"bundle","id":"bundle--' || CAST(p_partkey AS STRING)
  || '","objects":[{"type":"x-mitre-tactic","id":"x-' || CAST(p_size AS STRING)
  || '"},{"type":"attack-pattern","id":"attack-pattern--' || CAST(p_partkey AS STRING)
  || '","name":"' || p_name || '"}]}' AS value FROM part
"""

# --- vulnerability feed --------------------------------------------------------------------

DERIVED["cves"] = """
SELECT p_partkey AS pos, 'CVE-' || CAST(2000 + p_partkey % 25 AS STRING) || '-'
    || lpad(CAST(p_partkey AS STRING), 7, '0') AS cve_id,
  CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'cvssMetricV31' WHEN 1 THEN 'cvssMetricV30'
    WHEN 2 THEN 'cvssMetricV2' END AS metric_key,
  p_size / CAST(5 AS DOUBLE) AS base_score,
  CASE WHEN p_size >= 45 THEN 'CRITICAL' WHEN p_size >= 35 THEN 'HIGH' WHEN p_size >= 20
    THEN 'MEDIUM' ELSE 'LOW' END AS band,
  lower(p_brand) AS vendor, replace(p_name, ' ', '_') AS product,
  CASE WHEN p_partkey % 7 = 0 THEN 'es' ELSE 'en' END AS lang,
  p_type || ' flaw in ' || repeat(p_name || ' ', 1 + p_size) AS description,
  CAST(2000 + p_partkey % 25 AS STRING) || '-03-1' || CAST(p_size % 10 AS STRING) AS day,
  p_size, p_size > 40 AS wide FROM part
"""

_WIDE_NODES = "".join(
    f""" || ',{{"cpeMatch":[{{"criteria":"cpe:2.3:a:' || vendor || ':x{i}:1"}},'"""
    f""" || '{{"criteria":"cpe:2.3:a:' || vendor || ':y{i}:1"}}]}}'"""
    for i in range(1, 7)
)
DERIVED["cve_lines"] = """
SELECT '{"pos":' || CAST(pos AS STRING) || ',"id":"' || cve_id || '","published":"' || day
  || 'T10:15:00.000","descriptions":[{"lang":"' || lang || '","value":"' || description
  || '"},{"lang":"fr","value":"autre"}],"metrics":{'
  || CASE metric_key
    WHEN 'cvssMetricV31' THEN '"cvssMetricV2":[{"cvssData":{"baseScore":1.0},"baseSeverity":'
      || '"LOW"}],"cvssMetricV31":[{"cvssData":{"baseScore":' || CAST(base_score AS STRING)
      || ',"baseSeverity":"' || band || '"}}]'
    WHEN 'cvssMetricV30' THEN '"cvssMetricV31":[],"cvssMetricV30":[{"cvssData":{"baseScore":'
      || CAST(base_score AS STRING) || ',"baseSeverity":"' || band || '"}}]'
    WHEN 'cvssMetricV2' THEN '"cvssMetricV2":[{"cvssData":{"baseScore":'
      || CAST(base_score AS STRING) || '},"baseSeverity":"' || band || '"}]' ELSE '' END
  || '},"weaknesses":[{"description":[{"lang":"en","value":"CWE-' || CAST(p_size AS STRING)
  || '"},{"lang":"es","value":"x"}]},{"description":[{"lang":"en","value":"CWE-79"},'
  || '{"lang":"en","value":"CWE-79"}]}' || CASE WHEN wide THEN
    ',{"description":[{"lang":"en","value":"CWE-20"}]}' ELSE '' END
  || '],"configurations":[{"nodes":[{"cpeMatch":[{"criteria":"cpe:2.3:a:' || vendor || ':'
  || product || ':1"},{"criteria":"cpe:2.3:a:' || vendor || ':' || product || ':2"},'
  || '{"criteria":"cpe:2.3:o:*:' || product || ':1"},{"criteria":"cpe:2.3:a:late:late:1"}]},'
  || '{"cpeMatch":[{"criteria":"cpe:2.3:a:short"},{"criteria":"cpe:2.3:a:' || vendor || ':tool_'
  || CAST(p_size AS STRING) || ':1"}]}]}' || CASE WHEN wide THEN ',{"nodes":[{"cpeMatch":[]}'
""" + _WIDE_NODES + """
  || ']},{"nodes":[]},{"nodes":[{"cpeMatch":[{"criteria":"cpe:2.3:a:fourth:config:1"}]}]}'
    ELSE '' END || ']}' AS value FROM cves
"""

DERIVED["cve_docs"] = """
SELECT '{"vulnerabilities":[{"cve":{"id":"' || cve_id || '","published":"' || day
  || '"}},{"cve":{"id":""}},{"cve":{}}]}' AS value FROM cves
"""

# id lookups of the analysts: many ask for the same well-known CVE
DERIVED["cve_requests"] = """
SELECT o_orderkey AS request_id, CASE WHEN o_orderpriority LIKE '1%' THEN ' cve-2021-44228 '
  WHEN o_orderstatus = 'P' THEN 'CVE-1999-0001'
  ELSE 'cve-' || CAST(2000 + o_custkey % 25 AS STRING) || '-'
    || lpad(CAST(o_custkey AS STRING), 7, '0') END AS cve_id FROM orders
"""

DERIVED["notes"] = """
SELECT doc_id, text || ' seen CVE-' || CAST(2000 + (doc_id * 2) % 25 AS STRING) || '-'
  || lpad(CAST(doc_id * 2 AS STRING), 7, '0') || ', then cve-2001-0000001; not CVE-20-1.'
  AS text FROM documents
"""

DERIVED["inventory"] = """
SELECT 'host-' || CAST(l_suppkey AS STRING) AS host, lower(p_brand) AS vendor,
  replace(p_name, ' ', '_') AS product FROM lineitem JOIN part ON l_partkey = p_partkey
UNION ALL SELECT 'host-' || CAST(p_size AS STRING), lower(p_brand),
  CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN 'x6' WHEN 1 THEN 'y1' WHEN 2 THEN 'tool_45' ELSE 'x3' END
  FROM part WHERE p_partkey % 20 < 4
UNION ALL SELECT 'host-' || CAST(s_suppkey AS STRING), 'fourth', 'config' FROM supplier
"""

# --- vector collections --------------------------------------------------------------------

DERIVED["technique_vectors"] = """
SELECT 'MITRE ATT&CK' AS source, 'T' || lpad(CAST(vec_id AS STRING), 6, '0') AS id,
  'Technique ' || CAST(vec_id AS STRING) AS name, coalesce(d.text, 'no text') AS text, embedding,
  'Tactic ' || CAST(label AS STRING) AS tactics, 'Linux' AS platforms,
  CASE WHEN label < 3 THEN 'none' ELSE 'Group ' || CAST(label AS STRING) END AS threat_groups,
  label
FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id
"""

DERIVED["cve_vectors"] = """
SELECT 'NVD CVE' AS source, 'CVE-2024-' || lpad(CAST(vec_id AS STRING), 6, '0') AS id,
  'CVE-2024-' || lpad(CAST(vec_id AS STRING), 6, '0') AS name,
  coalesce(d.text, 'no text') AS text, list_reverse(embedding) AS embedding,
  CASE WHEN label < 5 THEN 'HIGH' ELSE 'LOW' END AS severity,
  CAST(label AS DOUBLE) AS cvss_score, 'vendor tool_' || CAST(label AS STRING)
    AS affected_products, label
FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id
"""

DERIVED["vector_queries"] = """
SELECT CAST(vec_id AS STRING) AS query_id, 'query ' || CAST(vec_id AS STRING) AS query,
  embedding, label FROM embeddings
"""

# one vector for each search text that occurs in the alerts
DERIVED["query_vectors"] = """
SELECT query, embedding FROM (
  SELECT query, e.embedding, row_number() OVER (PARTITION BY query ORDER BY vec_id) AS rn
  FROM (SELECT DISTINCT description || ' ' || replace(tags, ',', ' ') AS query,
    CASE event_type WHEN 'error' THEN 0 WHEN 'signup' THEN 1 WHEN 'view' THEN 2 WHEN 'click' THEN 3
      ELSE 4 END AS want FROM alerts) a JOIN embeddings e ON e.label = a.want) x WHERE rn = 1
"""

# searches in words: passages, many of which occur in the documents
DERIVED["text_queries"] = """
SELECT CAST(item_id AS STRING) AS query_id, text AS query FROM benchmark
"""

# --- model answers and agent steps ---------------------------------------------------------

DERIVED["completions"] = """
SELECT doc_id AS alert_id, 'Sure.' || chr(10)
  || CASE lang WHEN 'en' THEN 'SEVERITY: CRITICAL' WHEN 'fr' THEN 'Severity:  Medium'
    WHEN 'de' THEN 'No rating given' ELSE '  severity: low' END || chr(10) || chr(10)
  || CASE WHEN n_chars % 3 = 0 THEN '' ELSE 'MITRE TECHNIQUES IDENTIFIED:' || chr(10)
    || '- T1110 - Brute Force' || chr(10) || ' • T1021 Remote Services' || chr(10) || chr(10) END
  || 'REASONING:' || chr(10) || '- ' || text || chr(10) || '• second point' || chr(10) || chr(10)
  || 'RECOMMENDED ACTION:' || chr(10) || 'Isolate host ' || CAST(doc_id AS STRING) || chr(10)
  AS text FROM documents
"""

DERIVED["mapping_answers"] = """
SELECT doc_id AS alert_id, 'PRIMARY TECHNIQUE: T' || CAST(1000 + doc_id AS STRING)
  || ' - Technique of ' || source || chr(10) || 'CONFIDENCE: ' || CASE WHEN n_chars > 2000
    THEN 'High' ELSE 'Low ' END || chr(10) || 'REASON: ' || replace(text, chr(10), ' ') || chr(10)
  || CASE WHEN n_chars % 2 = 0 THEN 'SECONDARY TECHNIQUE (if applicable): T1 - Other' ELSE '' END
  AS text FROM documents
"""

DERIVED["agent_steps"] = """
SELECT conv_id AS investigation, 'Alert ID ' || CAST(conv_id AS STRING) AS alert, turn + 1 AS step,
  CASE WHEN role = 'system' THEN text
    WHEN turn = 5 AND conv_id % 2 = 0 THEN 'Thought: done' || chr(10) || 'Action: generate_report'
      || chr(10) || 'Action Input: all findings'
    ELSE 'Thought: ' || text || chr(10) || 'Action: ' || CASE turn % 4 WHEN 0 THEN 'query_siem'
        WHEN 1 THEN 'Check_CVE' WHEN 2 THEN 'map_to_mitre' ELSE 'open_shell' END || chr(10)
      || 'Action Input: "' || CAST(conv_id AS STRING) || '"' || chr(10) || chr(10)
      || 'Observation: none yet' END AS reply, text AS observation
FROM conversations
"""

NEEDS = {
    "completions": ["documents"],
    "mapping_answers": ["documents"],
    "agent_steps": ["conversations"],
    "technique_vectors": ["embeddings", "documents"],
    "cve_vectors": ["embeddings", "documents"],
    "vector_queries": ["embeddings"],
    "text_queries": ["benchmark"],
    "query_vectors": ["alerts", "embeddings"],
    "techniques": ["part"],
    "uses_edges": ["lineitem"],
    "stix_lines": ["techniques", "supplier", "uses_edges"],
    "stix_bundles": ["part"],
    "cves": ["part"],
    "cve_lines": ["cves"],
    "cve_docs": ["cves"],
    "cve_requests": ["orders"],
    "notes": ["documents"],
    "inventory": ["lineitem", "part", "supplier"],
    "alerts": ["events"],
    "raw_fields": ["alerts"],
    "raw_lines": ["raw_fields"],
    "mixed_lines": ["raw_lines", "alerts"],
    "live_lines": ["mixed_lines", "alerts"],
    "posted": ["alerts"],
    "requests": ["conversations"],
    "file_events": ["alerts"],
    "classifications": ["alerts"],
    "ports": ["alerts"],
    "reports": ["documents"],
}


def _closure(names) -> list[str]:
    """The names with everything they are derived from, inputs first."""
    out: list[str] = []
    for name in names:
        for dep in NEEDS.get(name, []):
            out += [n for n in _closure([dep]) if n not in out]
        if name not in out:
            out.append(name)
    return out


def with_inputs(body: str, *names: str) -> str:
    """``body`` as a statement that can use the named derived inputs."""
    ctes = [f"{n} AS ({DERIVED[n].strip()})" for n in _closure(names) if n in DERIVED]
    return f"WITH {', '.join(ctes)} {body.strip()}" if ctes else body.strip()


class Tables:
    """Access to the test tables of one folder and to the inputs derived from them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.base(name)
        if name not in DERIVED:
            raise AttributeError(name)
        for dep in _closure([name]):
            if dep in BASE:
                self.base(dep).createOrReplaceTempView(dep)
        text = with_inputs(f"SELECT * FROM {name}", name)
        for theirs, ours in DIALECT.items():
            text = text.replace(theirs, ours)
        return self.spark.sql(text)


    def landed(self, name: str) -> str:
        """Folder with the ``value`` column of a derived input as text lines.

        The lines are written once per session, as a log collector would leave them.
        """
        known = self.spark.sparkContext.__dict__.setdefault("_sievewatch_landed", {})
        key = (self.folder, name)
        if key not in known:
            path = scratch_path(self.spark, name)
            # packed as a collector leaves old logs; a packed file is read by one task, so none gets long
            getattr(self, name).select("value").write.option("maxRecordsPerFile", LANDED_ROWS).text(path, compression="gzip")
            known[key] = path
        return known[key]


class Registry:
    """Collects ``name -> (job, oracle SQL)``."""

    def __init__(self):
        self.jobs: dict[str, object] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, oracle: str | None = None, *inputs: str):
        def register(fn):
            self.jobs[name] = lambda spark, folder: fn(Tables(spark, folder))
            if oracle is not None:
                self.sql[name] = with_inputs(oracle, *inputs)
            return fn

        return register
