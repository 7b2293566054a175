"""Exact duplicates by two passes over a counting Bloom filter, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path
from .common import lower_ascii, private, stored

#: Places of the filter for each row, and those of the rows that are looked at in one go: more rows go in slices of the hash range.
PLACES_PER_ROW, MOST_PLACES = 16, 1 << 28
#: A word of the filter packs this many counters of so many bits.
COUNTERS, WIDTH = 8, 7
#: Most words with a repeat that are broadcast (about 30 bytes each); where a slice has more, all its hashes are shuffled.
MOST_WORDS = 3_000_000
#: A group of more than this share of all rows meets its rows by a broadcast: there are at most so many.
HOT_GROUPS = 10_000
#: Most rows of the broadcast list of dropped rows (about 200 bytes each).
GONE_ROWS = 200_000


def _possibly_repeated(rows: DataFrame, n: int) -> DataFrame:
    """``rows (doc_id, text_sha256)`` with ``maybe``: false if no other row can have the hash.

    Each hash counts at one place of the filter. Words of ``COUNTERS`` counters are added up in the map tasks and merged; a counter above 1, or any
    in a word of so many hashes that a counter may have run over, marks its place.
    """
    places = 1 << max(10, (PLACES_PER_ROW * n).bit_length())
    place = F.pmod(F.xxhash64("text_sha256"), F.lit(places))
    word, counter = F.shiftright(place, COUNTERS.bit_length() - 1), F.pmod(place, F.lit(COUNTERS)).cast("int")
    one = F.expr("shiftleft(1L, cast(_counter as int))")
    words = rows.select(word.alias("_word"), (counter * WIDTH).alias("_counter")).groupBy("_word").agg(
        F.try_sum(one).alias("sums"), F.count("*").alias("hashes"))
    most = (1 << WIDTH) - 1
    above = [F.when(F.shiftright("sums", WIDTH * i).bitwiseAND(most) > 1, F.lit(1 << i)).otherwise(0) for i in range(COUNTERS)]
    mask = F.when(F.col("sums").isNull() | (F.col("hashes") > most), F.lit((1 << COUNTERS) - 1)).otherwise(sum(above[1:], above[0]))
    words = stored(words.select("_word", mask.cast("long").alias("_mask")).where("_mask != 0"), "repeats")
    if words.count() > MOST_WORDS:
        return rows.withColumn("maybe", F.lit(True))
    tested = rows.withColumns({"_at": word, "_counter": counter}).join(F.broadcast(words), F.col("_at") == F.col("_word"), "left")
    return tested.select("doc_id", "text_sha256", F.coalesce(F.expr("getbit(_mask, _counter) = 1"), F.lit(False)).alias("maybe"))


def _marked(rows: DataFrame, n: int) -> DataFrame:
    """Marks of ``rows``, among which all copies of each text are."""
    tested = _possibly_repeated(rows, n)
    maybe = tested.where("maybe").select("doc_id", "text_sha256")
    groups = stored(
        maybe.groupBy(F.col("text_sha256").alias("_sha")).agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    big = F.col("group_size") > max(1, n // HOT_GROUPS)
    columns = ["doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"]
    same = F.col("text_sha256") == F.col("_sha")
    # rows of big groups stay where they are; the others meet their group by hash
    met = maybe.join(F.broadcast(groups.where(big)), same, "left")
    hot = met.where(F.col("_sha").isNotNull()).select(*columns)
    rest = met.where(F.col("_sha").isNull()).select("doc_id", "text_sha256").join(groups.where(~big), same).select(*columns)
    single = tested.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return single.unionByName(hot).unionByName(rest)


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of a group the row
    with the largest id stays. Pass one counts every hash at its place of a Bloom filter and keeps the places that
    were met twice; pass two tests each row: a row whose place was met once cannot have a copy and passes
    straight through, only the others are shuffled, as (hash, id), never as text. What is broadcast does not grow with the data: beyond
    ``MOST_PLACES`` the hashes are taken in slices of the hash range, one after the other.

    Null ids: a null id is smaller than any other; of a group with null ids only, or of rows that
    share the winning id, one row per equal (hash, id) pair counts as kept for each row, so repeated
    ids of a winner are all marked kept. Other columns are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = stored(
        docs.select(F.col(id_col).alias("doc_id"), F.sha2(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), 256)
                    .alias("text_sha256")), "hashes")
    n = rows.count()
    slices = -(-n * PLACES_PER_ROW // MOST_PLACES)
    if slices <= 1:
        return _marked(rows, n)
    path, out = scratch_path(spark, "marks"), None
    for i in range(slices):
        out = _marked(rows.where(F.pmod(F.xxhash64("text_sha256", F.lit(1)), F.lit(slices)) == i), n // slices + 1)
        out.write.parquet(f"{path}/slice{i}")
    return spark.read.schema(out.schema).parquet(*[f"{path}/slice{i}" for i in range(slices)])


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Dropped rows are removed by id and hash, so a repeated id with another text stays. Of rows that
    share id and text, one stays. The list of dropped rows is broadcast up to ``GONE_ROWS``.
    """
    gone_id, gone_sha = private(docs.columns, "_gone_id", "_gone_sha")
    marks = stored(mark_duplicates(docs, id_col, text_col), "marks")
    named = [F.col("doc_id").alias(gone_id), F.col("text_sha256").alias(gone_sha)]
    gone = marks.where("not kept").select(*named)
    twins = marks.where("kept and group_size > 1").groupBy("doc_id", "text_sha256").count().where("count > 1").select(*named)
    sha = F.sha2(lower_ascii(F.coalesce(docs[text_col], F.lit(""))), 256)
    same = docs[id_col].eqNullSafe(F.col(gone_id)) & (sha == F.col(gone_sha))
    out = docs.join(F.broadcast(gone) if gone.count() <= GONE_ROWS else gone, same, "left_anti")
    if twins.isEmpty():
        return out
    once = out.join(twins, same, "left_semi").withColumn(gone_sha, sha)
    once = once.dropDuplicates([id_col, gone_sha]).drop(gone_sha)
    return out.join(twins, same, "left_anti").unionByName(once)
