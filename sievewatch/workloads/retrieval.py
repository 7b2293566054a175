"""Queries: vector and exact search, context text, retrieval checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval as rv
from ..plans import inverted, postings
from .inputs import Registry

R = Registry()


def ranked(docs: str, k: int, where: str = "TRUE") -> str:
    """CTE body: the ``k`` nearest rows of a collection for every query."""
    return f"""SELECT query_id, query, distance, rank, source, id, name, text, label, want,
  tactics, platforms, threat_groups, severity, cvss_score, affected_products FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM (
    SELECT q.query_id, q.query, q.label AS want, d.*, round(power(list_distance(
      q.embedding::DOUBLE[], d.embedding::DOUBLE[]), 2), 6) AS distance
    FROM vector_queries q, {docs} d WHERE {where}) p) r WHERE rank <= {k}"""


CVE_NULLS = """tv AS (SELECT *, NULL::VARCHAR AS severity, NULL::DOUBLE AS cvss_score,
  NULL::VARCHAR AS affected_products FROM technique_vectors),
cv AS (SELECT *, NULL::VARCHAR AS tactics, NULL::VARCHAR AS platforms,
  NULL::VARCHAR AS threat_groups FROM cve_vectors)"""


def both(k: int) -> str:
    return f""", {CVE_NULLS}, t AS ({ranked('tv', k)}), c AS ({ranked('cv', k)}),
both_hits AS (SELECT * REPLACE (row_number() OVER (PARTITION BY query_id ORDER BY distance,
    CASE source WHEN 'MITRE ATT&CK' THEN 0 ELSE 1 END, id) AS rank)
  FROM (SELECT * FROM t UNION ALL SELECT * FROM c) u)
"""


R.add("r1_text_vectors", """
SELECT doc_id, 256 AS dims,
  CASE WHEN regexp_matches(text, '[\\p{L}\\p{Nd}]') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS length
FROM documents""")(
    lambda t: rv.text_vectors(rv.fit_text_vectors(t.documents), t.documents).select(
        "doc_id", F.size("embedding").alias("dims"),
        F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), 3).alias("length"),
    )
)

R.add("r2_nearest_techniques", f"""
, {CVE_NULLS}, t AS ({ranked('tv', 5)})
SELECT query_id, source, id, name, left(text, 500) AS text, tactics, distance, rank FROM t""",
      "vector_queries", "technique_vectors", "cve_vectors")(
    lambda t: rv.search(t.vector_queries, rv.require_filled(t.technique_vectors, "techniques"), 5)
    .select("query_id", "source", "id", "name", "text", "tactics", "distance",
            F.col("rank").cast("bigint").alias("rank"))
)

R.add("r3_nearest_cves", f"""
, {CVE_NULLS}, c AS ({ranked('cv', 3)})
SELECT query_id, source, id, name, left(text, 500) AS text, severity, cvss_score, distance, rank
FROM c""", "vector_queries", "technique_vectors", "cve_vectors")(
    lambda t: rv.search(t.vector_queries, rv.require_filled(t.cve_vectors, "CVEs"), 3).select(
        "query_id", "source", "id", "name", "text", "severity", "cvss_score", "distance", "rank"
    )
)

R.add("r4_k_above_size", f"""
, {CVE_NULLS}, t AS ({ranked('tv', 100000)})
SELECT query_id, count(*) AS n, max(rank) AS last_rank FROM t GROUP BY query_id""",
      "vector_queries", "technique_vectors", "cve_vectors")(
    lambda t: rv.nearest(t.vector_queries, t.technique_vectors, 100000).groupBy("query_id").agg(
        F.count("*").alias("n"), F.max("rank").alias("last_rank")
    )
)

R.add("r5_search_both", both(3) + """
SELECT query_id, source, id, distance, rank FROM both_hits""",
      "vector_queries", "technique_vectors", "cve_vectors")(
    lambda t: rv.search_both(t.vector_queries, t.technique_vectors, t.cve_vectors, 3).select(
        "query_id", "source", "id", "distance", "rank"
    )
)

R.add("r6_technique_by_id", """
, asked AS (SELECT alert_id AS query_id, 'T' || lpad(CAST(seq AS STRING), 6, '0')
    AS technique_id FROM alerts)
SELECT query_id, technique_id, source, id, name, text,
  CASE WHEN id IS NOT NULL THEN 0.0::DOUBLE END AS distance
FROM asked LEFT JOIN technique_vectors ON id = technique_id""", "alerts", "technique_vectors")(
    lambda t: rv.techniques_by_id(t.alerts.select(
        F.col("alert_id").alias("query_id"),
        F.concat(F.lit("T"), F.lpad(F.col("seq").cast("string"), 6, "0")).alias("technique_id"),
    ), t.technique_vectors).select(
        "query_id", "technique_id", "source", "id", "name", "text", "distance"
    )
)

R.add("r7_cve_by_id", """
, asked AS (SELECT alert_id AS query_id, 'CVE-2024-' || lpad(CAST(seq AS STRING), 6, '0')
    AS cve_id FROM alerts)
SELECT query_id, source, id, name, text, 0.0::DOUBLE AS distance
FROM asked JOIN cve_vectors ON id = cve_id""", "alerts", "cve_vectors")(
    lambda t: rv.cves_by_id(t.alerts.select(
        F.col("alert_id").alias("query_id"),
        F.concat(F.lit("CVE-2024-"), F.lpad(F.col("seq").cast("string"), 6, "0")).alias("cve_id"),
    ), t.cve_vectors).select("query_id", "source", "id", "name", "text", "distance")
)


def cve_searches(t):
    """Every query vector as a request: by id, by vector, or with neither."""
    return t.vector_queries.select(
        "query_id",
        F.when(F.col("label") < 4, F.concat(F.lit("CVE-2024-"), F.lpad("query_id", 6, "0")))
        .when(F.col("label") == 4, F.lit("")).alias("cve_id"),
        F.when(F.col("label") < 8, F.col("embedding")).alias("embedding"),
    )


R.add("r8_cve_search", f"""
, {CVE_NULLS}, c AS ({ranked('cv', 3)})
SELECT query_id, id, distance, rank FROM c WHERE want >= 4 AND want < 8
UNION ALL SELECT query_id, d.id, 0.0, 1 FROM vector_queries q JOIN cve_vectors d
  ON d.id = 'CVE-2024-' || lpad(query_id, 6, '0') WHERE q.label < 4""",
      "vector_queries", "technique_vectors", "cve_vectors")(
    lambda t: rv.search_cves(cve_searches(t), t.cve_vectors)[0].select(
        "query_id", "id", "distance", F.col("rank").cast("bigint").alias("rank")
    )
)

R.add("r8_cve_search_rejects", """
SELECT query_id, 'provide cve_id or query' AS error FROM vector_queries WHERE label >= 8""",
      "vector_queries")(lambda t: rv.search_cves(cve_searches(t), t.cve_vectors)[1])

R.add("r9_snippets", """
SELECT id, left(text, 500) AS result_text, left(text, 300) AS prompt_text,
  replace(left(text, 200), chr(10), ' ') AS tool_text FROM technique_vectors""",
      "technique_vectors")(
    lambda t: t.technique_vectors.select(
        "id", rv.cut("text", rv.RESULT_TEXT).alias("result_text"),
        rv.cut("text", rv.PROMPT_SNIPPET).alias("prompt_text"),
        rv.one_line(rv.cut("text", rv.TOOL_SNIPPET)).alias("tool_text"),
    )
)

R.add("r10_relevance", f"""
, {CVE_NULLS}, c AS ({ranked('cv', 3)})
SELECT query_id, id, round(1 - distance, 6) AS relevance_raw,
  round(greatest(0.0::DOUBLE, 1 - distance), 6) AS relevance FROM c""",
      "vector_queries", "technique_vectors", "cve_vectors")(
    lambda t: rv.nearest(t.vector_queries, t.cve_vectors, 3).select(
        "query_id", "id", F.round(rv.relevance_raw(), 6).alias("relevance_raw"),
        F.round(rv.relevance(), 6).alias("relevance"),
    )
)

ENTRY = """chr(10) || '[' || CAST(rank AS STRING) || '] Source: ' || source || ' | ID: ' || id
  || ' | ' || name || chr(10) || '    Relevance score: '
  || CAST(round(CAST(1 - distance AS DECIMAL(18, 6)), 2) AS STRING) || chr(10)
  || CASE source WHEN 'NVD CVE' THEN '    Severity: ' || severity || ' (CVSS: '
      || CAST(cvss_score AS STRING) || ')' || chr(10) || '    Affected: ' || affected_products
    ELSE '    Tactics: ' || tactics || chr(10) || '    Platforms: ' || platforms || chr(10)
      || '    Known threat groups: ' || threat_groups END
  || chr(10) || '    Details: ' || left(text, 300) || '...'"""

R.add("r11_context_blocks", both(2) + f"""
SELECT query_id, 'RELEVANT THREAT INTELLIGENCE CONTEXT:' || chr(10) || repeat('=', 50) || chr(10)
  || string_agg({ENTRY}, chr(10) ORDER BY rank) AS context FROM both_hits GROUP BY query_id""",
      "vector_queries", "technique_vectors", "cve_vectors")(
    lambda t: rv.context_blocks(
        t.vector_queries, rv.search_both(t.vector_queries, t.technique_vectors, t.cve_vectors, 2)
    )
)

R.add("r12_technique_lists", f"""
, {CVE_NULLS}, t AS ({ranked('tv', 3)})
SELECT query_id, 'Top MITRE ATT&CK techniques matching ''' || query || ''':' || chr(10) || chr(10)
  || string_agg(CAST(rank AS STRING) || '. [' || id || '] ' || name || chr(10) || '   '
    || replace(left(text, 200), chr(10), ' ') || '...' || chr(10), chr(10) ORDER BY rank) AS answer
FROM t GROUP BY query_id, query""", "vector_queries", "technique_vectors", "cve_vectors")(
    lambda t: rv.technique_lists(
        t.vector_queries, rv.search(t.vector_queries, t.technique_vectors, 3)
    )
)

# alerts share few texts: one search per text, as in the job
CONTEXT = """, tk AS (SELECT query, id, name, text, row_number() OVER (
    PARTITION BY query ORDER BY distance, id) AS rank FROM (
  SELECT q.query, d.id, d.name, d.text, round(power(list_distance(q.embedding::DOUBLE[],
    d.embedding::DOUBLE[]), 2), 6) AS distance FROM query_vectors q, technique_vectors d) p),
ctx AS (SELECT query, string_agg('[' || id || '] ' || name || ':' || chr(10) || left(text, 300)
    || '...', chr(10) || chr(10) ORDER BY rank) AS mitre_context FROM tk WHERE rank <= 3
  GROUP BY query),
asked AS (SELECT alert_id, description || ' ' || replace(tags, ',', ' ') AS query FROM alerts)
"""

R.add("r13_alert_context", CONTEXT + """
SELECT alert_id, a.query, mitre_context FROM asked a LEFT JOIN ctx c ON c.query = a.query""",
      "alerts", "query_vectors", "technique_vectors")(
    lambda t: rv.alert_context(t.alerts, t.query_vectors, t.technique_vectors).select(
        "alert_id", "query", "mitre_context"
    )
)

R.add("r14_hinted_technique", """
, hinted AS (SELECT alert_id, 'T' || lpad(CAST(k AS STRING), 6, '0') AS technique_id FROM alerts)
SELECT alert_id, technique_id, name AS technique, tactics, threat_groups
FROM hinted LEFT JOIN technique_vectors ON id = technique_id""", "alerts", "technique_vectors")(
    lambda t: rv.with_hinted_technique(t.alerts.select(
        "alert_id",
        F.concat(F.lit("T"), F.lpad(F.col("k").cast("string"), 6, "0")).alias("technique_id"),
    ), t.technique_vectors)
)

R.add("r15_filtered_search", f"""
, {CVE_NULLS}, c AS ({ranked('cv', 3, "severity = 'HIGH'")})
SELECT query_id, id, severity, distance, rank FROM c""",
      "vector_queries", "technique_vectors", "cve_vectors")(
    lambda t: rv.search(
        t.vector_queries, t.cve_vectors.where(F.col("severity") == "HIGH"), 3
    ).select("query_id", "id", "severity", "distance", "rank")
)

CHECK = f"""
, {CVE_NULLS}, c AS ({ranked('cv', 3)}),
checked AS (SELECT q.query_id, min(c.rank) FILTER (c.label = q.label) AS hit_rank
  FROM vector_queries q LEFT JOIN c ON c.query_id = q.query_id GROUP BY q.query_id)
"""


def label_check(t):
    hits = rv.search(t.vector_queries, t.cve_vectors, 3)
    return rv.retrieval_check(t.vector_queries, hits, "label", "label")


R.add("r16_retrieval_check", CHECK + """
SELECT query_id, hit_rank IS NOT NULL AS passed, hit_rank,
  round(coalesce(1.0::DOUBLE / hit_rank, 0.0), 6) AS reciprocal_rank FROM checked""",
      "vector_queries", "technique_vectors", "cve_vectors")(
    lambda t: label_check(t).withColumn("reciprocal_rank", F.round("reciprocal_rank", 6))
)

R.add("r16_check_totals", CHECK + """
SELECT count(hit_rank) AS passed, count(*) - count(hit_rank) AS failed,
  round(avg(CASE WHEN hit_rank IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE), 6) AS hit_rate,
  round(avg(coalesce(1.0::DOUBLE / hit_rank, 0.0)), 6) AS mean_reciprocal_rank FROM checked""",
      "vector_queries", "technique_vectors", "cve_vectors")(
    lambda t: rv.check_totals(label_check(t)).select(
        "passed", "failed", F.round("hit_rate", 6).alias("hit_rate"),
        F.round("mean_reciprocal_rank", 6).alias("mean_reciprocal_rank"),
    )
)

R.add("r17_collection_sizes", """
SELECT source, count(*) AS n FROM technique_vectors GROUP BY source
UNION ALL SELECT source, count(*) FROM cve_vectors GROUP BY source""",
      "technique_vectors", "cve_vectors")(
    lambda t: rv.collection_sizes(t.technique_vectors, t.cve_vectors)
)

R.add("r18_pruned_search", f"""
, {CVE_NULLS}, c AS ({ranked('cv', 5)})
SELECT query_id, id, severity, distance, rank FROM c""",
      "vector_queries", "technique_vectors", "cve_vectors")(
    lambda t: rv.search(t.vector_queries, t.cve_vectors, 5, pruned=True).select(
        "query_id", "id", "severity", "distance", "rank"
    )
)

# the index is approximate; its recall beside the full search is what is checked
R.add("r18_index_recall", """
SELECT count(*) AS queries, 5 * count(*) AS answers, TRUE AS recall_holds, TRUE AS fewer_rows_read
FROM vector_queries""", "vector_queries")(lambda t: index_recall(t))


def index_recall(t):
    index = inverted.scratch_index(t.cve_vectors)
    hits = rv.search(t.vector_queries, t.cve_vectors, 5, index=index).select("query_id", "id")
    exact = rv.nearest(t.vector_queries, t.cve_vectors, 5).select("query_id", "id")
    found = exact.join(hits.withColumn("hit", F.lit(1)), ["query_id", "id"], "left").agg(
        F.countDistinct("query_id").alias("queries"), (F.count("hit") / F.count("*") >= 0.9).alias("recall_holds"))
    read = index.rows_searched(t.vector_queries).agg((F.avg("searched") < index.n).alias("fewer_rows_read"))
    # three tables of one row each
    return found.join(hits.agg(F.count("*").alias("answers")), F.lit(True)).join(read, F.lit(True)).select(
        "queries", "answers", "recall_holds", "fewer_rows_read")


R.add("r18_index_search")(
    lambda t: rv.search(t.vector_queries, t.cve_vectors, 5, index=inverted.scratch_index(t.cve_vectors))
    .select("query_id", "id", "severity", "distance", "rank")
)


def unit_words(name: str, table: str, key: str, text: str) -> str:
    """CTEs: weighted words of unit length; ``idf`` comes from the collection."""
    return f"""{name}_c AS (SELECT {key} AS key, term, count(*) AS tf FROM (SELECT {key},
    unnest(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{Nd}}]+')) AS term FROM {table}) x GROUP BY 1, 2)"""


def weighted(name: str) -> str:
    return f"""{name}_w AS (SELECT key, term, tf * idf AS w FROM {name}_c JOIN idf USING (term)),
{name}_u AS (SELECT key, term, w / sqrt(sum(w * w) OVER (PARTITION BY key)) AS w FROM {name}_w)"""


def text_ranked(docs: str, queries: str, k: int, key: str = "query_id", text: str = "query") -> str:
    """CTEs up to ``hits (query_id, id, distance, rank)``: the full product over all words."""
    return f"""{unit_words('d', docs, 'id', 'text')}, {unit_words('q', queries, key, text)},
idf AS (SELECT term, ln((n + 1.0::DOUBLE) / (count(*) + 1)) AS idf FROM d_c,
  (SELECT count(*) AS n FROM {docs} WHERE text IS NOT NULL) s GROUP BY term, n),
{weighted('d')}, {weighted('q')},
scored AS (SELECT q.key AS query_id, d.key AS id, round(greatest(0.0::DOUBLE, 2 - 2 * sum(q.w * d.w)), 6) AS distance
  FROM q_u q JOIN d_u d ON q.term = d.term WHERE q.w > 0 AND d.w > 0 GROUP BY q.key, d.key),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank
  FROM scored) r WHERE rank <= {k})
"""


R.add("r2_text_search", f"""
, {text_ranked('technique_vectors', 'text_queries', 5)}
SELECT query_id, source, h.id AS id, name, left(text, 500) AS text, tactics, distance, rank
FROM hits h JOIN technique_vectors d ON d.id = h.id""", "technique_vectors", "text_queries")(
    lambda t: rv.search_text(t.text_queries, rv.require_filled(t.technique_vectors, "techniques"), 5)
    .select("query_id", "source", "id", "name", "text", "tactics", "distance",
            F.col("rank").cast("bigint").alias("rank"))
)

R.add("r3_text_search", f"""
, {text_ranked('cve_vectors', 'text_queries', 3)}
SELECT query_id, source, h.id AS id, name, left(text, 500) AS text, severity, cvss_score, distance, rank
FROM hits h JOIN cve_vectors d ON d.id = h.id""", "cve_vectors", "text_queries")(
    lambda t: rv.search_text(t.text_queries, rv.require_filled(t.cve_vectors, "CVEs"), 3).select(
        "query_id", "source", "id", "name", "text", "severity", "cvss_score", "distance", "rank"
    )
)

# the collections share their texts, so a tie at every place: techniques first
R.add("r5_text_search_both", f"""
, {text_ranked('technique_vectors', 'text_queries', 3)},
both_hits AS (SELECT query_id, id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, place, id) AS rank FROM (
  SELECT query_id, id, distance, 0 AS place FROM hits
  UNION ALL SELECT query_id, 'CVE-2024-' || substr(id, 2), distance, 1 FROM hits) u)
SELECT * FROM both_hits""", "technique_vectors", "text_queries")(
    lambda t: rv.search_both(
        t.text_queries, t.technique_vectors, t.cve_vectors, 3, postings.scratch_text_index(t.technique_vectors),
        postings.scratch_text_index(t.cve_vectors)).select("query_id", "id", "distance", "rank")
)

R.add("r13_alert_context_from_text", f"""
, asked AS (SELECT alert_id, description || ' ' || replace(tags, ',', ' ') AS query FROM alerts),
texts AS (SELECT DISTINCT query FROM asked),
{text_ranked('technique_vectors', 'texts', 3, 'query', 'query')},
ctx AS (SELECT query_id AS query, string_agg('[' || h.id || '] ' || name || ':' || chr(10) || left(text, 300)
    || '...', chr(10) || chr(10) ORDER BY rank) AS mitre_context
  FROM hits h JOIN technique_vectors d ON d.id = h.id GROUP BY query_id)
SELECT alert_id, a.query, mitre_context FROM asked a LEFT JOIN ctx c ON c.query = a.query""",
      "alerts", "technique_vectors")(
    lambda t: rv.alert_context(t.alerts, None, t.technique_vectors).select("alert_id", "query", "mitre_context")
)
