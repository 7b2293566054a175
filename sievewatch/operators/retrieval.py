"""Search in the knowledge collections: nearest by vector, exact by id, context text.

A collection is a DataFrame with ``source, id, name, text, embedding`` and its metadata columns.
Queries are rows too (``query_id, embedding``), so one job answers all of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import col, cut, one_line
from ..plans.inverted import Index
from ..plans.nearest import nearest
from ..plans.postings import TextIndex, scratch_text_index
from ..plans.pruned import nearest_pruned
from ..session import reliable_checkpoint

TECHNIQUES, CVES = "MITRE ATT&CK", "NVD CVE"
TECHNIQUE_META = ["tactics", "platforms", "threat_groups"]
CVE_META = ["severity", "cvss_score", "affected_products"]
# fixed values: text lengths of results, prompt and tool snippets
RESULT_TEXT, PROMPT_SNIPPET, TOOL_SNIPPET = 500, 300, 200
BROADCAST_CONTEXTS = 10_000  # texts of some 1 kB that may be broadcast
NO_CONTEXT = "No relevant threat intelligence found."
NO_TECHNIQUES = "No matching MITRE techniques found."


# --- vectors -------------------------------------------------------------------------------

def fit_text_vectors(texts: DataFrame, text: str = "text", size: int = 256) -> PipelineModel:
    """Hashed tf-idf vectors of unit length: the fallback when there is no embedding model."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"[^\p{L}\p{Nd}]+"),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=size),
        IDF(inputCol="_tf", outputCol="_idf"),
        Normalizer(inputCol="_idf", outputCol="_unit", p=2.0),
    ]).fit(texts.where(F.col(text).isNotNull()))


def text_vectors(model: PipelineModel, texts: DataFrame) -> DataFrame:
    out = model.transform(texts)
    return out.withColumn("embedding", vector_to_array("_unit", "float32")).drop(
        "_words", "_tf", "_idf", "_unit"
    )


def embed_with(texts: DataFrame, fn: Callable, text: str = "text") -> DataFrame:
    """Vectors from a caller's model: ``fn`` maps a pandas Series of texts to lists of floats."""
    return texts.withColumn("embedding", F.pandas_udf(fn, "array<float>")(text))


# --- search --------------------------------------------------------------------------------

def require_filled(collection: DataFrame, name: str) -> DataFrame:
    if collection.isEmpty():
        raise ValueError(f"collection {name} is empty; fill it first")
    return collection


def _with_facts(hits: DataFrame, collection: DataFrame) -> DataFrame:
    # only the shown part of the text travels to the hits
    shown = collection.drop("embedding").withColumn("text", cut("text", RESULT_TEXT))
    return hits.join(shown, "id")


def search(queries: DataFrame, collection: DataFrame, k: int, pruned: bool = False,
           index: Index | TextIndex | None = None, **limits) -> DataFrame:
    """``query_id, distance, rank`` with the columns of the ``k`` nearest rows.

    ``pruned`` uses the cluster search for large collections; the rows are the same. An ``index`` of
    the collection is asked instead of the collection: vectors approximately (``plans.inverted``), query
    texts exactly (``plans.postings``, column ``query``).
    """
    find = index.search if index is not None else nearest_pruned if pruned else nearest
    hits = find(queries, k, **limits) if index is not None else find(queries, collection, k, **limits)
    return _with_facts(hits, collection)


def search_text(queries: DataFrame, collection: DataFrame, k: int, index: TextIndex | None = None,
                **limits) -> DataFrame:
    """``search`` from texts (``query_id, query``) over the tf-idf weights of the collection's texts.

    Without a stored ``index`` one is built for this job.
    """
    return search(queries, collection, k, index=index or scratch_text_index(collection), **limits)


def search_both(
    queries: DataFrame, techniques: DataFrame | None, cves: DataFrame | None, k: int = 3,
    technique_index: Index | TextIndex | None = None, cve_index: Index | TextIndex | None = None,
) -> DataFrame:
    """Best ``k`` of each collection, merged by distance; at equal distance techniques first.

    A collection that is not there is left out. With text indexes the queries are texts.
    """
    found = None
    for part, index in ((techniques, technique_index), (cves, cve_index)):
        if part is not None:
            hits = search(queries, part, k, index=index).drop("rank")
            found = hits if found is None else found.unionByName(hits, allowMissingColumns=True)
    if found is None:
        raise ValueError("no collection given")
    # at most 2k rows per query
    order = Window.partitionBy("query_id").orderBy(
        "distance", F.when(F.col("source") == TECHNIQUES, 0).otherwise(1), "id"
    )
    return found.withColumn("rank", F.row_number().over(order))


def techniques_by_id(requests: DataFrame, techniques: DataFrame) -> DataFrame:
    """Exact technique per request (``query_id, technique_id``), null if absent, full text."""
    hit = techniques.drop("embedding").withColumn("distance", F.lit(0.0))
    return requests.join(hit, F.col("technique_id") == F.col("id"), "left")


def cves_by_id(requests: DataFrame, cves: DataFrame) -> DataFrame:
    """Exact CVE per request (``query_id, cve_id``) with full text; unknown ids give no row."""
    hit = cves.drop("embedding").withColumn("distance", F.lit(0.0))
    return requests.join(hit, F.col("cve_id") == F.col("id")).drop("cve_id")


def search_cves(requests: DataFrame, cves: DataFrame, k: int = 3) -> tuple[DataFrame, DataFrame]:
    """Requests with an id (exact), else with a vector (nearest); the rest is rejected.

    Returns (results, rejects).
    """
    by_id = F.coalesce(F.length("cve_id") > 0, F.lit(False))
    by_vector = ~by_id & F.col("embedding").isNotNull()
    exact = cves_by_id(requests.where(by_id).select("query_id", "cve_id"), cves)
    near = search(requests.where(by_vector).select("query_id", "embedding"), cves, k)
    results = exact.withColumn("rank", F.lit(1)).unionByName(near)
    rejects = requests.where(~by_id & F.col("embedding").isNull()).select(
        "query_id", F.lit("provide cve_id or query").alias("error")
    )
    return results, rejects


# --- relevance and context -----------------------------------------------------------------

def relevance_raw() -> Column:
    return 1 - F.col("distance")


def relevance() -> Column:
    return F.greatest(F.lit(0.0), relevance_raw())


def _two_places(value: Column) -> Column:
    return F.round(value.cast("decimal(18,6)"), 2).cast("string")


def _meta(name: str, columns: list[str], empty: str = "N/A") -> Column:
    if name not in columns:
        return F.lit(empty)
    return F.coalesce(F.col(name).cast("string"), F.lit(empty))


def context_entry(columns: list[str]) -> Column:
    """Lines of one result in the context block."""
    technique = F.concat(
        F.lit("    Tactics: "), _meta("tactics", columns),
        F.lit("\n    Platforms: "), _meta("platforms", columns),
        F.lit("\n    Known threat groups: "), _meta("threat_groups", columns, "none"), F.lit("\n"),
    )
    cve = F.concat(
        F.lit("    Severity: "), _meta("severity", columns),
        F.lit(" (CVSS: "), _meta("cvss_score", columns),
        F.lit(")\n    Affected: "), _meta("affected_products", columns), F.lit("\n"),
    )
    return F.concat(
        F.lit("\n["), F.col("rank").cast("string"), F.lit("] Source: "), F.col("source"),
        F.lit(" | ID: "), F.col("id"), F.lit(" | "), F.col("name"),
        F.lit("\n    Relevance score: "), _two_places(relevance_raw()), F.lit("\n"),
        F.when(F.col("source") == TECHNIQUES, technique)
        .when(F.col("source") == CVES, cve).otherwise(F.lit("")),
        F.lit("    Details: "), cut("text", PROMPT_SNIPPET), F.lit("..."),
    )


def _joined(results: DataFrame, entry: Column, sep: str) -> DataFrame:
    """Entries of a query in rank order; a query has at most a few results."""
    rows = F.array_sort(F.collect_list(F.struct("rank", entry.alias("entry"))))
    texts = F.transform(rows, lambda r: r["entry"])
    return results.groupBy("query_id").agg(F.array_join(texts, sep).alias("body"))


def context_blocks(queries: DataFrame, results: DataFrame) -> DataFrame:
    """One context text per query; a query without results gets the fixed sentence."""
    body = _joined(results, context_entry(results.columns), "\n")
    head = "RELEVANT THREAT INTELLIGENCE CONTEXT:\n" + "=" * 50 + "\n"
    return queries.select("query_id").join(body, "query_id", "left").select(
        "query_id",
        F.coalesce(F.concat(F.lit(head), "body"), F.lit(NO_CONTEXT)).alias("context"),
    )


def technique_lists(queries: DataFrame, results: DataFrame) -> DataFrame:
    """Numbered technique list per query (``query_id, query``)."""
    entry = F.concat(
        F.col("rank").cast("string"), F.lit(". ["), F.col("id"), F.lit("] "), F.col("name"),
        F.lit("\n   "), one_line(cut("text", TOOL_SNIPPET)), F.lit("...\n"),
    )
    body = _joined(results, entry, "\n")
    return queries.select("query_id", "query").join(body, "query_id", "left").select(
        "query_id",
        F.when(F.col("body").isNull(), F.lit(NO_TECHNIQUES)).otherwise(F.concat(
            F.lit("Top MITRE ATT&CK techniques matching '"), "query", F.lit("':\n\n"), "body"
        )).alias("answer"),
    )


def alert_query(description: Column | str = "description",
                groups: Column | str = "rule_groups") -> Column:
    """Search text of an alert: description and its groups."""
    listed = F.coalesce(F.array_join(col(groups), " "), F.lit(""))
    return F.concat(F.coalesce(col(description), F.lit("")), F.lit(" "), listed)


def alert_context(
    alerts: DataFrame, vectors: DataFrame | None, techniques: DataFrame, k: int = 3,
    index: Index | TextIndex | None = None,
) -> DataFrame:
    """``alert_id, query, mitre_context``: the ``k`` nearest techniques as prompt text.

    Alerts repeat few distinct texts, so every text is searched once and the context joined back.
    ``vectors`` holds ``query, embedding``; without vectors the texts themselves are searched.
    """
    asked = alerts.select("alert_id", alert_query().alias("query"))
    texts = asked.select("query").distinct()
    if vectors is None:
        hits = search_text(texts.withColumn("query_id", F.col("query")), techniques, k, index)
    else:
        texts = texts.join(vectors, "query")
        hits = search(texts.select(F.col("query").alias("query_id"), "embedding"), techniques, k, index=index)
    entry = F.concat(
        F.lit("["), F.col("id"), F.lit("] "), F.col("name"), F.lit(":\n"),
        cut("text", PROMPT_SNIPPET), F.lit("..."),
    )
    context = _joined(hits, entry, "\n\n").select(
        F.col("query_id").alias("query"), F.col("body").alias("mitre_context")
    )
    # searched once, however often the answer is read
    context = reliable_checkpoint(context)
    return asked.join(F.broadcast(context) if context.count() <= BROADCAST_CONTEXTS else context, "query", "left")


def with_hinted_technique(alerts: DataFrame, techniques: DataFrame) -> DataFrame:
    """Alerts with name, tactics and groups of the technique their own hint names.

    The technique side has one row per id; AQE broadcasts it when it is small and splits a hot
    hint otherwise.
    """
    facts = techniques.select(
        F.col("id").alias("technique_id"), F.col("name").alias("technique"), "tactics",
        "threat_groups",
    )
    return alerts.join(facts, "technique_id", "left")


# --- checks --------------------------------------------------------------------------------

def retrieval_check(queries: DataFrame, results: DataFrame, expected: str, found: str) -> DataFrame:
    """Per query: is the expected value among the results, and at which rank.

    ``queries`` has ``query_id`` and ``expected``; ``found`` is the result column to compare.
    """
    hit = results.join(queries.select("query_id", F.col(expected).alias("_want")), "query_id")
    best = hit.where(F.col(found) == F.col("_want")).groupBy("query_id").agg(
        F.min("rank").alias("hit_rank")
    )
    return queries.select("query_id", expected).join(best, "query_id", "left").select(
        "query_id", F.col("hit_rank").isNotNull().alias("passed"), "hit_rank",
        F.coalesce(1.0 / F.col("hit_rank"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def check_totals(checked: DataFrame) -> DataFrame:
    return checked.agg(
        F.count(F.when(F.col("passed"), 1)).alias("passed"),
        F.count(F.when(~F.col("passed"), 1)).alias("failed"),
        F.avg(F.col("passed").cast("double")).alias("hit_rate"),
        F.avg("reciprocal_rank").alias("mean_reciprocal_rank"),
    )


def collection_sizes(*collections: DataFrame) -> DataFrame:
    sizes = [c.groupBy("source").agg(F.count("*").alias("n")) for c in collections]
    out = sizes[0]
    for s in sizes[1:]:
        out = out.unionByName(s)
    return out
