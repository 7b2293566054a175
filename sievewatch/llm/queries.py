"""The registered queries of the operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship_package
from . import balltree, bpe, divergence, exact, hosts, jaccard, language, packing, pii, shards, simhash, templates, whitening
from .common import LOWER, UPPER, bounded_batches, stored

#: The rules of the url query.
URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    bounded_batches(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 4 == 2


def language_net(docs: DataFrame) -> language.ByteNet:
    """Trained on labelled documents outside the held-out quarter."""
    return language.fit(docs.where(~F.coalesce(held_out(), F.lit(False))))


def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    found = language.identify(docs.select("doc_id", "text"), language_net(docs))
    return found.select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("language.label").alias("lang_pred"),
        F.col("language.score").alias("score"))


def op2_line_templates(spark: SparkSession, folder: str) -> DataFrame:
    return templates.drop_recurring_lines(read(spark, folder, "documents"))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode_documents(
        read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
        outputs=("n_tokens", "ids_sha256", "decoded_sha256"))


def op4_host_reputation(spark: SparkSession, folder: str) -> DataFrame:
    labels = read(spark, folder, "labels").select(
        F.col("doc_id").alias("id"), ((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("bad"))
    return hosts.judge(read(spark, folder, "pages"), labels, URL_RULES).drop("bound")


def op5_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(read(spark, folder, "documents"), k=3, percent=90)


def op6_even_shards(spark: SparkSession, folder: str) -> DataFrame:
    return shards.shard_documents(read(spark, folder, "documents"), 24)


def op7_exact_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return exact.mark_duplicates(read(spark, folder, "documents"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digest(pii.scan(read(spark, folder, "documents")))


def op10_ball_tree(spark: SparkSession, folder: str) -> DataFrame:
    return balltree.top_k(read(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = stored(simhash.compare_with_edits(read(spark, folder, "documents")), "fingerprints")
    return simhash.near_groups(found)


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(read(spark, folder, "embeddings"))


def op13_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.audit(read(spark, folder, "documents"))


QUERIES = {
    f.__name__: f for f in (
        op1_language, op2_line_templates, op3_byte_bpe, op4_host_reputation, op5_ngram_join, op6_even_shards,
        op7_exact_duplicates, op8_packing, op9_personal_data, op10_ball_tree, op11_simhash, op12_whitening, op13_source_divergence)
}

_LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

_RULE_CASES = "\n".join(
    f"  WHEN (host = '{r.partition('/')[0]}' OR ends_with(host, '.{r.partition('/')[0]}')) "
    f"AND starts_with(path, '/{r.partition('/')[2]}') THEN '{v} {r}'"
    for v, r in sorted(URL_RULES, key=lambda x: (-len(x[1]), x[1]))
)


def _weight_sql(level: str) -> str:
    return f"""SELECT greatest({hosts.LEAST_WEIGHT}, least({hosts.MOST_WEIGHT},
    CASE WHEN k > 1 AND m > 0 AND m < 1 AND rho > 0 THEN (1 - rho) / rho ELSE {hosts.MOST_WEIGHT} END)) AS w
  FROM (SELECT k, m, round((y2 - t * m * m - (k - 1) * m * (1 - m)) / (t - n2 / t) / (m * (1 - m)), 9) AS rho
    FROM (SELECT count(*) AS k, sum(n) AS t, sum(bad) / sum(n) AS m, sum(n * n) AS n2, sum(bad * bad / n) AS y2
      FROM (SELECT CAST(n AS DOUBLE) AS n, CAST(bad AS DOUBLE) AS bad FROM {level} WHERE n > 0) a) b) c"""


SQL = {
    "op4_host_reputation": f"""
WITH cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
l AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN bad THEN 1 ELSE 0 END) AS bad
  FROM (SELECT doc_id, toxic = 1 OR quality = 0 AS bad FROM labels) x WHERE bad IS NOT NULL GROUP BY doc_id),
h AS (SELECT host, sum(coalesce(l.n, 0)) AS n, sum(coalesce(l.bad, 0)) AS bad,
  CASE WHEN host LIKE '%.%' THEN regexp_extract(host, '([^.]*[.][^.]*)$', 1) ELSE host END AS domain,
  regexp_extract(host, '([^.]*)$', 1) AS suffix
  FROM p LEFT JOIN l ON p.page_id = l.doc_id GROUP BY host),
d AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d GROUP BY suffix),
ws AS ({_weight_sql('s')}), wd AS ({_weight_sql('d')}), wh AS ({_weight_sql('h')}),
m AS (SELECT coalesce(sum(bad) / sum(n), 0) AS m FROM s),
ps AS (SELECT suffix, (bad + w * m) / (n + w) AS ms FROM s, ws, m),
pd AS (SELECT domain, (bad + w * ms) / (n + w) AS md FROM d JOIN ps USING (suffix), wd),
ph AS (SELECT host, (bad + w * md) / (n + w) AS mean, n + w AS t FROM h JOIN pd USING (domain), wh),
b AS (SELECT host, round(mean - {hosts.DEVIATIONS} * sqrt(mean * (1 - mean) / (t + 1)), 9) AS bound FROM ph),
r AS (SELECT page_id, host, path, CASE
{_RULE_CASES} END AS fit FROM p)
SELECT page_id, r.host AS host, path, CASE WHEN fit IS NOT NULL THEN split_part(fit, ' ', 2) END AS rule,
  coalesce(CASE WHEN fit IS NOT NULL THEN split_part(fit, ' ', 1) END,
    CASE WHEN bound > {hosts.BAD_RATE} THEN 'block' ELSE 'allow' END) AS verdict
FROM r JOIN b ON r.host = b.host""",
    "op7_exact_duplicates": f"""
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM (SELECT doc_id, sha256({_LOWERED}) AS text_sha256 FROM documents) t
WINDOW same AS (PARTITION BY text_sha256)""",
    "op10_ball_tree": """
WITH v AS (SELECT vec_id, [CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id != c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op13_source_divergence": rf"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS text, row_number() OVER () AS r FROM documents),
o AS (SELECT lang, source, r, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT r) >= {divergence.LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM o JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT n.lang AS lang, n.source AS source, k.term AS term, coalesce(c.c, 0) AS c,
    1 + (CAST({divergence.ONE} AS HUGEINT) * (coalesce(c.c, 0) + 2)) // (n.n + 2 * v.v) AS p
  FROM n JOIN v ON n.lang = v.lang JOIN kept k ON k.lang = n.lang
  LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
w AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY lang, term),
q AS (SELECT w.lang AS lang, w.term AS term, 1 + (CAST({divergence.ONE} AS HUGEINT) * (w.c + 2)) // (t.n + 2 * v.v) AS q
  FROM w JOIN (SELECT lang, sum(c) AS n FROM c GROUP BY lang) t ON w.lang = t.lang JOIN v ON v.lang = w.lang),
f AS (SELECT x.lang AS lang, x.source AS source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source != y.source GROUP BY x.lang, x.source, y.source),
pairs AS (SELECT a.lang AS lang, a.source AS source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source != b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
terms AS (SELECT p.lang AS lang, p.source AS source, 'term' AS part, p.term AS item,
    CAST(((p.p - q.q) * (p.p - q.q)) // (p.p + q.q) AS BIGINT) AS value
  FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p.p > q.q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms) u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}""",
}
