"""Search by words: a stored inverted index of tf-idf weights, searched with max-score pruning.

The weights are those of ``fit_text_vectors`` without the hashing: count times ``ln((n + 1) / (df + 1))``, scaled to unit length.
A query's best rows are found without looking at all postings of its words:

1. the words that can add most (weight times the largest weight of any row) give partial scores; the ``k``-th best of them is a floor;
2. words that together cannot reach the floor are not essential: a row that holds only such words is out, so their postings, the long ones
   of frequent words, bring no row in;
3. rows found by essential words stay if what they have and all that the others could add reaches the floor, and the ``k``-th best of what
   they have; only these are completed.

Words are counted within their row, so no text or count is shuffled; tables of words, rows and candidates are broadcast while they
are measured to be small.

The answer equals the full sparse product. Rows that share no word with a query are no hits.

Files of an index folder: ``postings`` (sorted by word, a word of any size lies in several files), ``terms``, ``rows``, and ``meta``, written last.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import reliable_checkpoint, scratch_path

GAPS = r"[^\p{L}\p{Nd}]+"  # what parts words
DIGITS = 6
SEEDS = 3  # words whose partial scores set the floor
BROADCAST_ROWS = 1_000_000  # counted rows of a word and a few numbers that may be broadcast
_ROOM = 1e-9  # sums of the same weights in another order
_TIE = 10.0 ** -DIGITS  # scores that are farther apart have different rounded distances


def words(text: Column) -> Column:
    """Lower-cased words of a text, in order, with repeats."""
    return F.filter(F.split(F.lower(text), GAPS), lambda w: F.length(w) > 0)


def _small(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has few rows; it is run once to count them."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``found``, the words of the text with their number ``tf``, counted within the row."""
    starts = F.filter(F.sequence(F.lit(1), F.size("_w")), lambda i: (i == 1) | (F.get("_w", i - 1) != F.get("_w", i - 2)))
    ends = F.concat(F.slice("_at", 2, F.size("_w")), F.array(F.size("_w") + 1))
    # both lists are made once a row, not once a word
    runs = F.zip_with("_at", ends, lambda s, e: F.struct(F.get("_w", s - 1).alias("term"), (e - s).cast("long").alias("tf")))
    sorted_words = rows.select(*keys, F.sort_array(words(F.col("text"))).alias("_w"))
    at = sorted_words.withColumn("_at", F.when(F.size("_w") > 0, starts))
    return at.select(*keys, F.when(F.col("_at").isNotNull(), runs).alias("found"))


def _counts(rows: DataFrame, key: str) -> DataFrame:
    """``key, term, tf``; each key has one row."""
    # an inner generator would have its input computed in a filter as well
    return _counted(rows, key).select(key, F.inline_outer("found")).where("term is not null")


def _unit(weighted: DataFrame, key: str) -> DataFrame:
    """Scale ``w`` to unit length for each key; rows of weight 0 go."""
    norms = weighted.groupBy(F.col(key).alias("_k")).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("_norm"))
    norms = _small(reliable_checkpoint(norms))
    return weighted.where("w > 0").join(norms, F.col(key) == F.col("_k")).withColumn("w", F.col("w") / F.col("_norm")).drop("_k", "_norm")


def build_text_index(docs: DataFrame, path: str, *, key: str = "id", text: str = "text") -> TextIndex:
    """Index the texts of ``docs`` under ``path`` (a folder that does not exist yet) and open it.

    Rows without a text or an id are left out, rows that repeat an id are rows of their own. No list of words or
    postings is ever gathered in one place: a word of a third of all rows is a range of its own.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    found = scratch_path(spark, "text-words")
    _counted(rows.withColumn("row", F.monotonically_increasing_id()), "row", "id").write.parquet(found)
    found = spark.read.parquet(found)
    n = found.count()
    counts = found.select("row", F.inline("found"))
    terms = reliable_checkpoint(counts.groupBy("term").agg(F.count("*").alias("df")).withColumn("idf", F.log((F.lit(n) + 1) / (F.col("df") + 1))))
    weights = scratch_path(spark, "text-weights")
    counts.join(_small(terms), "term").select("row", "term", (F.col("tf") * F.col("idf")).alias("w")).write.parquet(weights)
    weighted = spark.read.parquet(weights)
    _unit(weighted, "row").select("term", "row", "w").repartitionByRange("term", "row").sortWithinPartitions("term", "row").write.parquet(f"{path}/postings")
    top = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.max("w").alias("top"))
    terms.join(top, "term").repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{path}/terms")
    found.select("row", "id").write.parquet(f"{path}/rows")
    spark.createDataFrame([(n,)], "n long").write.parquet(f"{path}/meta")
    return TextIndex(spark, path)


@dataclass
class TextIndex:
    """A stored index; opening it reads one row."""

    spark: SparkSession
    path: str

    def __post_init__(self):
        try:
            self.n = self.spark.read.parquet(f"{self.path}/meta").first().n
        except AnalysisException as e:
            raise ValueError(f"{self.path} holds no finished index") from e
        self.postings = self.spark.read.schema("term string, row long, w double").parquet(f"{self.path}/postings")
        self.terms = self.spark.read.schema("term string, df long, idf double, top double").parquet(f"{self.path}/terms")
        self.rows = self.spark.read.schema("row long, id string").parquet(f"{self.path}/rows")

    def query_terms(self, queries: DataFrame) -> DataFrame:
        """``q, term, w, most``: weights of the known words, and the most that a word can add to a score."""
        counts = _small(reliable_checkpoint(_counts(queries.select("q", "text"), "q")))
        known = reliable_checkpoint(self.terms.join(counts, "term").select("q", "term", (F.col("tf") * F.col("idf")).alias("w"), "top"))
        return _unit(known, "q").select("q", "term", "w", (F.col("w") * F.col("top")).alias("most"))

    def _scores(self, asked: DataFrame) -> DataFrame:
        """``q, row, score`` over the given words of the queries."""
        return self.postings.withColumnRenamed("w", "there").join(_small(asked.select("q", "term", "w")), "term").groupBy("q", "row").agg(
            F.sum(F.col("w") * F.col("there")).alias("score"))

    def plan(self, terms: DataFrame, k: int) -> DataFrame:
        """``terms`` with ``essential``, the ``floor`` of their query and what its other words can add at most, ``rest``.

        Windows hold the words of one query.
        """
        by_most = Window.partitionBy("q").orderBy(F.desc("most"), "term")
        seeds = terms.withColumn("_at", F.row_number().over(by_most)).where(F.col("_at") <= SEEDS)
        best = Window.partitionBy("q").orderBy(F.desc("score"), "row")
        kth = self._scores(seeds).withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
        floors = kth.groupBy("q").agg(F.count("*").alias("_n"), F.min("score").alias("_low")).where(F.col("_n") >= k).select(
            "q", (F.col("_low") - _ROOM).alias("floor"))
        rising = Window.partitionBy("q").orderBy("most", "term").rowsBetween(Window.unboundedPreceding, 0)
        # fewer than k rows hold a seed: no floor, all words are essential
        marked = terms.join(floors, "q", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))).withColumn(
            "essential", F.sum("most").over(rising) >= F.col("floor"))
        other = F.sum(F.when(F.col("essential"), 0.0).otherwise(F.col("most"))).over(Window.partitionBy("q"))
        return marked.withColumn("rest", other)

    def search(self, queries: DataFrame, k: int, *, query_key: str = "query_id", text: str = "query") -> DataFrame:
        """``query_id, id, distance, rank`` of the ``k`` nearest rows of each query text.

        ``distance`` is the squared L2 of the unit vectors, so 2 minus twice the score; ties go to the smaller id. Queries
        without a known word have no rows; each query row is answered for itself.
        """
        asked = reliable_checkpoint(queries.where(F.col(text).isNotNull() & F.col(query_key).isNotNull()).select(
            F.monotonically_increasing_id().alias("q"), F.col(query_key).cast("string").alias("query_id"), F.col(text).alias("text")))
        terms = reliable_checkpoint(self.plan(reliable_checkpoint(self.query_terms(asked)), k))
        floors = _small(terms.groupBy("q").agg(F.max("floor").alias("floor"), F.max("rest").alias("rest")))
        found = self._scores(terms.where("essential")).join(floors, "q").where(F.col("score") + F.col("rest") >= F.col("floor"))
        found = reliable_checkpoint(found.select("q", "row", "score", "rest"))
        # what the essential words alone give the k-th best row is a higher floor
        best = Window.partitionBy("q").orderBy(F.desc("score"), "row")
        kth = found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") == k).select("q", (F.col("score") - _TIE).alias("floor"))
        near = found.join(_small(reliable_checkpoint(kth)), "q", "left").where(F.col("floor").isNull() | (F.col("score") + F.col("rest") >= F.col("floor")))
        near = reliable_checkpoint(near.select("q", "row", "score"))
        others = reliable_checkpoint(terms.where("not essential").select("q", "term", "w"))
        wanted = _small(near.select("q", "row").join(_small(others), "q"))
        held = self.postings.withColumnRenamed("w", "there").join(_small(others.select("term").distinct()), "term", "left_semi")
        more = held.join(wanted, ["term", "row"]).groupBy("q", "row").agg(F.sum(F.col("w") * F.col("there")).alias("more"))
        scored = near.join(more, ["q", "row"], "left").join(self.rows, "row").select(
            "q", "id", F.round(F.greatest(F.lit(0.0), 2 - 2 * (F.col("score") + F.coalesce("more", F.lit(0.0)))), DIGITS).alias("distance"))
        order = Window.partitionBy("q").orderBy("distance", "id")
        best = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return best.join(asked.select("q", "query_id"), "q").select("query_id", "id", "distance", "rank")


def scratch_text_index(docs: DataFrame, **options) -> TextIndex:
    """An index in the scratch area, for jobs that need it once."""
    return build_text_index(docs, scratch_path(docs.sparkSession, "text-index"), **options)
