"""Queries: prompts, model answers, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import answers as an, normalise as nz, prompts as pr, reports as rp, retrieval as rv, triage
from .alerts import CATEGORY, DST_IP, HASH, SRC_IP, USER, raw
from .inputs import Registry
from .retrieval import CONTEXT, CVE_NULLS, ranked

R = Registry()


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def filled(template: str, **values: str) -> str:
    """SQL text of a template with its places filled by SQL expressions."""
    out = lit(template)
    for name, sql in values.items():
        out = out.replace(f"{{{name}}}", f"' || {sql} || '")
    return out


def quoted(sql: str) -> str:
    return f"""coalesce('"' || {sql} || '"', 'null')"""


ALERT_JSON = f"""'{{
  "alert_id": "' || alert_id || '",
  "timestamp": "' || timestamp || '",
  "source": {{
    "agent_name": "' || agent_name || '",
    "agent_ip": "' || agent_ip || '"
  }},
  "rule": {{
    "id": "' || rule_id || '",
    "description": "' || description || '",
    "level": ' || CAST(rule_level AS STRING) || '
  }},
  "category": "' || {CATEGORY} || '",
  "raw_log": "' || left(coalesce(full_log, message, ''), 500) || '",
  "indicators": {{
    "src_ip": ' || {quoted(SRC_IP)} || ',
    "dst_ip": ' || {quoted(DST_IP)} || ',
    "src_port": null,
    "dst_port": null,
    "username": ' || {quoted(USER)} || ',
    "process_name": ' || {quoted('process')} || ',
    "file_hash": ' || {quoted(HASH)} || '
  }},
  "mitre_hint": {{
    "technique_id": ' || {quoted('technique_id')} || ',
    "technique_name": ' || {quoted('technique_name')} || '
  }},
  "status": "new"
}}'"""


def alert_structs(t):
    n = nz.normalise(raw(t))
    return n.select("alert_id", F.struct(*n.columns).alias("alert"))


R.add("p1_classify_prompts", f"""
SELECT alert_id, {filled(pr.CLASSIFY_PROMPT, alert_json='(' + ALERT_JSON + ')')} AS prompt
FROM raw_fields""", "raw_fields")(lambda t: pr.classify_prompts(alert_structs(t)))

R.add("p2_context_prompts", CONTEXT + f"""
, both_parts AS (SELECT r.*, c.mitre_context FROM raw_fields r JOIN asked a
  ON a.alert_id = r.alert_id JOIN ctx c ON c.query = a.query)
SELECT alert_id, {filled(pr.CONTEXT_PROMPT, mitre_context='mitre_context',
                         alert_json='(' + ALERT_JSON + ')')} AS prompt FROM both_parts""",
      "raw_fields", "alerts", "query_vectors", "technique_vectors")(
    lambda t: pr.context_prompts(
        alert_structs(t), rv.alert_context(t.alerts, t.query_vectors, t.technique_vectors)
    )
)

R.add("p3_mapping_prompts", f"""
, {CVE_NULLS}, tk AS ({ranked('tv', 3)}),
cand AS (SELECT query_id, query, string_agg('[' || id || '] ' || name || ': ' || left(text, 300)
  || chr(10) || chr(10), '' ORDER BY rank) AS c FROM tk GROUP BY query_id, query)
SELECT query_id, {filled(pr.MAPPING_PROMPT, alert_description='query', mitre_candidates='c')}
  AS prompt FROM cand""", "vector_queries", "technique_vectors", "cve_vectors")(
    lambda t: pr.mapping_prompts(t.vector_queries, t.technique_vectors)
)

FINDINGS = """'Alert: {''id'': ''' || alert_id || ''', ''level'': ' || CAST(rule_level AS STRING)
  || ', ''groups'': [''' || replace(tags, ',', ''', ''') || '''], ''srcip'': '
  || coalesce('''' || srcip || '''', 'None') || '}' || chr(10) || 'Classification: '
  || CASE WHEN rule_level >= 5 THEN '{''severity'': ''HIGH'', ''note'': "it''s"}' ELSE '{}' END"""


def found(t):
    rows = t.alerts.select(
        "alert_id",
        F.struct(F.col("alert_id").alias("id"), F.col("rule_level").alias("level"),
                 F.col("rule_groups").alias("groups"), "srcip").alias("alert"),
        F.when(F.col("rule_level") >= 5, F.struct(
            F.lit("HIGH").alias("severity"), F.lit("it's").alias("note")
        )).alias("classification"),
    )
    return rows.select("alert_id", pr.findings(rows).alias("findings"))


R.add("p4_findings", f"SELECT alert_id, {FINDINGS} AS findings FROM alerts", "alerts")(found)

R.add("p4_report_prompts", f"""
SELECT alert_id, {filled(pr.report_layout('INCIDENT REPORT'), findings='(' + FINDINGS + ')',
                         timestamp="'2024-03-01 12:00:00'")} AS prompt FROM alerts""", "alerts")(
    lambda t: pr.report_prompts(found(t), F.lit("2024-03-01 12:00:00").cast("timestamp"))
)

R.add("t3_id_details", f"""
, asked AS (SELECT CAST(o_orderkey AS STRING) AS request_id,
    CAST(o_custkey AS STRING) AS alert_id FROM orders)
SELECT request_id, alert_id, 'Alert Details:' || chr(10) || {ALERT_JSON} AS answer
FROM asked JOIN raw_fields USING (alert_id)""", "raw_fields")(
    lambda t: triage.id_details(
        triage.route_requests(t.orders.select(
            F.col("o_orderkey").cast("string").alias("request_id"),
            F.concat(F.lit("show alert "), F.col("o_custkey").cast("string")).alias("text"),
        ), t.alerts),
        (lambda rows: rows.select(
            "alert_id", pr.alert_json("alert", rows.schema["alert"].dataType).alias("alert_json")
        ))(alert_structs(t)),
    )
)

STEP_SQL = r"""
, parsed AS (SELECT *, nullif(regexp_extract(reply, 'Action:\s*([a-zA-Z_]+)', 1), '') AS act,
    nullif(regexp_extract(reply, '(?s)Action Input:\s*(.+?)(?:\n\n|\nThought|\nAction:|$)', 1), '')
      AS given,
    nullif(regexp_extract(reply, '(?s)Thought:\s*(.+?)(?:\nAction:|$)', 1), '') AS th
  FROM agent_steps),
steps AS (SELECT investigation, alert, step, observation, reply,
    CASE WHEN act IS NOT NULL AND given IS NOT NULL THEN act END AS action,
    CASE WHEN act IS NOT NULL AND given IS NOT NULL THEN trim(regexp_replace(regexp_replace(given,
      '^\s+|\s+$', '', 'g'), '^["'']+|["'']+$', '', 'g')) END AS action_input,
    coalesce(regexp_replace(th, '^\s+|\s+$', '', 'g'), 'Investigating...') AS thought FROM parsed)
"""

R.add("p5_investigation_logs", STEP_SQL + """
, stop AS (SELECT investigation, min(step) FILTER (action = 'generate_report') AS report_step
  FROM steps WHERE step <= 7 GROUP BY investigation),
logs AS (SELECT s.investigation, s.alert, any_value(report_step) AS report_step,
    string_agg(CASE WHEN s.step < coalesce(report_step, 8) THEN CASE WHEN action IS NULL
      THEN chr(10) || 'Step ' || CAST(step AS STRING) || ': LLM response unclear, continuing...'
        || chr(10)
      ELSE chr(10) || 'Step ' || CAST(step AS STRING) || ':' || chr(10) || 'Thought: ' || thought
        || chr(10) || 'Action: ' || action || chr(10) || 'Action Input: ' || action_input || chr(10)
        || 'Observation: ' || left(observation, 600) || chr(10) END END, '' ORDER BY step) AS log,
    coalesce(string_agg(CASE WHEN s.step < coalesce(report_step, 8) THEN action END, ', '
      ORDER BY step), '') AS tools_used
  FROM steps s JOIN stop p ON p.investigation = s.investigation WHERE step <= 7
  GROUP BY s.investigation, s.alert)
SELECT investigation, alert, report_step, coalesce(log, '') AS log, tools_used,
  CASE WHEN report_step IS NOT NULL THEN 'Alert: ' || alert || chr(10) || chr(10)
    || 'Real findings from investigation:' || chr(10) || coalesce(log, '') || chr(10) || chr(10)
    || 'Tools used: ' || tools_used || chr(10)
  ELSE 'Alert: ' || alert || chr(10) || chr(10) || 'Findings:' || chr(10) || coalesce(log, '')
  END AS findings FROM logs""", "agent_steps")(
    lambda t: pr.investigation_logs(t.agent_steps)
)

# --- answers -------------------------------------------------------------------------------

CLEAN = r"""regexp_replace(regexp_replace(replace(replace({0}, '\n', chr(10)), chr(10) || '- ',
  chr(10) || '• '), '(?m)^\s*[-•]\s*', '• ', 'g'), '^\s+|\s+$', '', 'g')"""

ANSWER = r"""
SELECT alert_id, nullif(regexp_extract(raw, '(?i)SEVERITY[:\s]+([A-Z]+)', 1), '') AS severity,
  """ + CLEAN.format(
    r"regexp_extract(raw, '(?is)REASONING[:\s]+(.*?)(?:RECOMMENDED|MITRE|\z)', 1)"
) + r""" AS reasoning, regexp_replace(nullif(regexp_extract(raw,
  '(?is)MITRE TECHNIQUES?[:\s]+(.*?)(?:CONFIDENCE|RECOMMENDED|\z)', 1), ''), '^\s+|\s+$', '', 'g')
  AS technique FROM """

R.add("p6_parse_answers", ANSWER + "(SELECT alert_id, text AS raw FROM completions) c",
      "completions")(lambda t: an.parse_answers(t.completions).drop("text"))

R.add("p6_parse_endpoint_json", ANSWER + """(SELECT alert_id, '{"success":true,"classification":'
  || CAST(to_json(text) AS STRING) || '}' AS raw FROM completions) c""", "completions")(
    lambda t: an.parse_answers(
        t.completions.select("alert_id", an.endpoint_json("text").alias("text"))
    ).drop("text")
)

BULLETS = r"""array_to_string(list_transform(list_filter(string_split({0}, chr(10)),
  lambda x: regexp_matches(x, '^\s*[-•]')), lambda x: regexp_replace(regexp_replace(x,
  '^\s*[-•]\s*', ''), '^\s+|\s+$', '', 'g')), '|')"""

R.add("p7_parse_sections", r"""
SELECT alert_id, nullif(upper(regexp_extract(text, '(?im)^[ \t]*SEVERITY:[ \t]*([A-Z]+)', 1)), '')
    AS severity,
  """ + BULLETS.format(
    r"regexp_extract(text, '(?ims)^[ \t]*MITRE TECHNIQUES IDENTIFIED:[ \t]*(.*?)"
    r"(?:^[ \t]*REASONING:|^[ \t]*RECOMMENDED ACTION:|\z)', 1)"
) + " AS techniques, " + BULLETS.format(
    r"regexp_extract(text, '(?ims)^[ \t]*REASONING:[ \t]*(.*?)"
    r"(?:^[ \t]*MITRE TECHNIQUES IDENTIFIED:|^[ \t]*RECOMMENDED ACTION:|\z)', 1)"
) + r""" AS reasons, 'Isolate host ' || CAST(alert_id AS STRING) AS action
FROM completions""", "completions")(
    lambda t: an.parse_sections(t.completions).select(
        "alert_id", "severity", F.array_join("techniques", "|").alias("techniques"),
        F.array_join("reasons", "|").alias("reasons"), "action",
    )
)

R.add("p7_parse_mapping", r"""
SELECT alert_id, 'T' || CAST(1000 + alert_id AS STRING) AS primary_id,
  regexp_extract(text, '(?m)^PRIMARY TECHNIQUE: \S+ - ([^\n]*)', 1) AS primary_name,
  CASE WHEN contains(text, 'CONFIDENCE: High') THEN 'High' ELSE 'Low' END AS confidence,
  regexp_replace(regexp_extract(text, '(?m)^REASON:[ \t]*([^\n]*)', 1), '^\s+|\s+$', '', 'g')
    AS reason,
  CASE WHEN contains(text, 'SECONDARY TECHNIQUE (if') THEN 'T1 - Other' END AS secondary
FROM mapping_answers""", "mapping_answers")(
    lambda t: an.parse_sections(t.mapping_answers).select(
        "alert_id", "primary_id", "primary_name", "confidence", "reason", "secondary"
    )
)

R.add("p8_clean_text", f"SELECT alert_id, {CLEAN.format('text')} AS text FROM completions",
      "completions")(
    lambda t: t.completions.select("alert_id", an.clean_text("text").alias("text"))
)

R.add("p9_text_severity", """
, first_line AS (SELECT alert_id, coalesce((list_filter(string_split(upper(text), chr(10)),
  lambda x: contains(x, 'SEVERITY:')))[1], '') AS l FROM completions)
SELECT alert_id, CASE WHEN contains(l, 'CRITICAL') THEN 'CRITICAL' WHEN contains(l, 'HIGH')
  THEN 'HIGH' WHEN contains(l, 'MEDIUM') THEN 'MEDIUM' WHEN contains(l, 'LOW') THEN 'LOW'
  ELSE 'UNKNOWN' END AS severity FROM first_line""", "completions")(
    lambda t: t.completions.select("alert_id", an.text_severity("text").alias("severity"))
)

R.add("p10_parse_action", STEP_SQL + """
SELECT investigation, step, action, action_input, thought FROM steps""", "agent_steps")(
    lambda t: an.step_parts(t.agent_steps).select(
        "investigation", "step", "action", "action_input", "thought"
    )
)

R.add("p11_tool_usage", STEP_SQL + """
SELECT lower(action) AS tool, CASE WHEN action IS NULL THEN 'unreadable' WHEN lower(action) IN
  ('query_siem', 'lookup_threat_intel', 'map_to_mitre', 'check_cve', 'generate_report')
  THEN 'known' ELSE 'unknown' END AS status, count(*) AS n FROM steps GROUP BY 1, 2""",
      "agent_steps")(lambda t: an.tool_usage(t.agent_steps))

R.add("p12_saved_classification", """
SELECT alert_id, CASE WHEN technique_id IS NULL THEN 'UNKNOWN' ELSE 'HIGH' END AS severity,
  coalesce(technique_name, '') AS reasoning, replace(tags, ',', ', ') AS mitre_tactics
FROM alerts""", "alerts")(
    lambda t: an.saved_classification(t.alerts.select(
        "alert_id", F.when(F.col("technique_id").isNotNull(), "HIGH").alias("severity"),
        F.col("technique_name").alias("reasoning"), F.col("rule_groups").alias("mitre_tactics"),
    ))
)

# --- reports -------------------------------------------------------------------------------

R.add("p13_basic_report", f"""
SELECT id, {filled(rp.BASIC_REPORT, title="'INCIDENT REPORT'", generated="'2024-06-01 00:00:00'",
                   findings='report_text')} AS report FROM reports""", "reports")(
    lambda t: t.reports.select(
        "id", rp.basic_report("report_text", F.lit("2024-06-01 00:00:00")).alias("report")
    )
)

BAND_SQL = "CASE WHEN rule_level >= 10 THEN 'CRITICAL' ELSE 'LOW' END"
HOST = "agent_name || ' (' || agent_ip || ')'"
LEVEL = "CASE WHEN rule_level = 0 THEN '—' ELSE CAST(rule_level AS STRING) END"


def incidents(t):
    return t.alerts.select(
        "alert_id", "timestamp", "agent_name", "agent_ip", "rule_id", "rule_level", "description",
        F.col("technique_name").alias("technique"),
        F.when(F.col("rule_level") >= 10, "CRITICAL").otherwise("LOW").alias("severity"),
    )


R.add("p14_incident_summary", f"""
SELECT alert_id, {BAND_SQL} AS severity, 'Under Investigation' AS status,
  'SIEM — Rule ' || rule_id AS detection_source, {HOST} AS affected_host,
  {LEVEL} || ' / 15' AS rule_level FROM alerts""", "alerts")(
    lambda t: rp.incident_summary(incidents(t))
)

R.add("p15_incident_timeline", f"""
SELECT alert_id, timestamp, 1 AS step, 'SIEM' AS detection_source,
  'Alert triggered — ' || description || ' on ' || {HOST} AS event FROM alerts
UNION ALL SELECT alert_id, timestamp, 2, 'Retrieval', 'MITRE ATT&CK technique mapped: '
  || coalesce(technique_name, 'Under analysis') FROM alerts
UNION ALL SELECT alert_id, timestamp, 3, 'Classification', 'Severity classified as ' || {BAND_SQL}
  || ' — incident report generated' FROM alerts""", "alerts")(
    lambda t: rp.incident_timeline(incidents(t))
)

R.add("p16_affected_assets", """
SELECT DISTINCT agent_name AS server, agent_ip AS ip_address, 'Production Server' AS purpose,
  'Suspected Compromised' AS status, description AS comments FROM alerts""", "alerts")(
    lambda t: rp.affected_assets(incidents(t))
)


def template_sql(text: str) -> str:
    return filled(
        text, host="agent_name", ip="agent_ip", level=f"({LEVEL})",
        technique="coalesce(technique_name, 'identified attack technique')",
    )


R.add("p17_recommended_actions", " UNION ALL ".join(
    f"SELECT alert_id, {i} AS step, {lit(label)} AS label, {template_sql(text)} AS action FROM alerts"
    for i, (label, text) in enumerate(rp.ACTIONS, start=1)
), "alerts")(lambda t: rp.recommended_actions(incidents(t)))

R.add("p17_section_items", " UNION ALL ".join(
    f"SELECT alert_id, {lit(name)} AS section, {i} AS item, {template_sql(text)} AS text FROM alerts"
    for name, items in rp.SECTIONS for i, text in enumerate(items, start=1)
), "alerts")(lambda t: rp.section_items(incidents(t)))
