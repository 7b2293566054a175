"""How far the sources of a language differ in their words, and by which words.

Equal texts of a language are collapsed first: a text is read once, with the number of its rows in each source, and its terms count
with these weights. Rates of terms are whole numbers (billionths), differences are compared by ``f``; all arithmetic is exact. The sum of ``f`` over
all terms for a pair of sources is put together from what is sparse: terms that a source has, grouped by their count, and terms that both have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bounded_batches, stored

LEAST_DOCUMENTS = 10  # documents of its language that hold a kept term
TOP_TERMS = 10
ONE = 1_000_000_000
SOURCES_AT_ONCE = 256  # sources of one text in one row; a text with more of them is read once per so many
HELD_COUNTS = 1 << 20  # counts that a task holds before it sends them on
HELD_PAIRS = 1 << 20  # pairs of sources whose sums a task holds
#: Each byte as it counts in a term: letters lower-cased (A-Z only), bytes above 7F as they are, 0 for what parts terms.
_BYTE = np.zeros(256, np.uint8)
for _b in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _BYTE[_b] = _b + 32 if _b < 0x5B else _b


def collapsed(docs: DataFrame) -> DataFrame:
    """``lang, text, weights array<struct<source, n>>, docs``: one row per different text of a language.

    Copies are merged in the map tasks, so a text travels once per task at most. ``docs`` is the number of rows. A text in many sources comes in
    rows of about ``SOURCES_AT_ONCE`` sources, each with the rows of its sources.
    """
    rows = docs.select("lang", "source", "text", F.sha2("text", 256).alias("sha"))
    counts = rows.groupBy("lang", "sha", "source").agg(F.count("*").alias("n"))
    sources = F.count("*").over(Window.partitionBy("lang", "sha"))
    parts = counts.withColumn("chunk", F.pmod(F.xxhash64("source"), F.ceil(sources / SOURCES_AT_ONCE)))
    weights = parts.groupBy("lang", "sha", "chunk").agg(F.collect_list(F.struct("source", "n")).alias("weights"), F.sum("n").alias("docs"))
    texts = rows.groupBy("lang", "sha").agg(F.min("text").alias("text"))
    return texts.join(weights, ["lang", "sha"]).select("lang", "text", "weights", "docs")


def term_counts(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """``(terms, text, term, count)``: the different terms, and for each text and term the number of occurrences."""
    raw = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts.to_pylist()]
    begins = np.cumsum([0, *map(len, raw)])
    data = _BYTE[np.frombuffer(b"".join(raw), np.uint8)]
    inside = data != 0
    # a term begins behind a gap or at the start of a text
    cut = np.r_[True, ~inside, True]
    cut[begins[begins < len(data)]] = True
    first = np.flatnonzero(inside & cut[: len(data)])
    after = np.r_[~inside[1:], True] if len(data) else np.zeros(0, bool)
    after[begins[(begins > 0) & (begins <= len(data))] - 1] = True
    last = np.flatnonzero(inside & after)
    offsets = np.cumsum(np.r_[0, last + 1 - first]).astype(np.int32)
    flat = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), pa.py_buffer(data[inside].tobytes()))
    coded = flat.dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.searchsorted(begins, first, side="right") - 1
    key, count = np.unique(owner * max(1, len(terms)) + code, return_counts=True)
    text, term = np.divmod(key, max(1, len(terms)))
    return terms, text, term, count


def _added_up(tables: list[pa.Table]) -> pa.Table:
    keys = ["lang", "source", "term"]
    table = pa.concat_tables(tables).group_by(keys).aggregate([("c", "sum"), ("docs", "sum")])
    return table.select([*keys, "c_sum", "docs_sum"]).rename_columns([*keys, "c", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with weights to ``(lang, source, term, c, docs)``, added up in the task; a text's ``docs`` go with its first source."""
    held: list[pa.Table] = []
    size = 0
    for b in batches:
        if not b.num_rows:
            continue
        terms, text, term, count = term_counts(b["text"])
        # one row per text and source
        sources = b["weights"].flatten()
        owner = pc.list_parent_indices(b["weights"]).to_numpy(zero_copy_only=False)
        n = sources.field("n").to_numpy(zero_copy_only=False)
        docs = np.where(np.r_[True, owner[1:] != owner[:-1]], b["docs"].to_numpy(zero_copy_only=False)[owner], 0)
        names = pa.StructArray.from_arrays([b["lang"].take(pa.array(owner)), sources.field("source")], names=["lang", "source"])
        group = names.field("lang").dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        coded = names.field("source").dictionary_encode()
        group = group * len(coded.dictionary) + coded.indices.to_numpy(zero_copy_only=False)
        group, first_of, group_of = np.unique(group, return_index=True, return_inverse=True)
        # the terms of a text, once for each of its sources
        starts, per_text = np.searchsorted(text, owner), np.searchsorted(text, owner, side="right")
        lengths = per_text - starts
        row = np.repeat(np.arange(len(owner)), lengths)
        at = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[row]
        key, place = np.unique(group_of[row] * max(1, len(terms)) + term[at], return_inverse=True)
        c, d = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        np.add.at(c, place, count[at] * n[row])
        np.add.at(d, place, docs[row])
        which, of_term = np.divmod(key, max(1, len(terms)))
        rows = names.take(pa.array(first_of[which]))
        held.append(pa.table({
            "lang": rows.field("lang"), "source": rows.field("source"), "term": terms.take(pa.array(of_term)), "c": c, "docs": d}))
        size += len(key)
        if size >= HELD_COUNTS:
            held = [_added_up(held)]
            size = held[0].num_rows
            if size >= HELD_COUNTS // 2:
                yield from held[0].to_batches(max_chunksize=1 << 16)
                held, size = [], 0
    if held:
        yield from _added_up(held).to_batches(max_chunksize=1 << 16)


def rate(count: Column, total: Column, kept: Column) -> Column:
    """Smoothed share of a term in billionths: ``1 + floor(ONE * (count + 2) / (total + 2 * kept))``."""
    over = ((count + 2).cast("decimal(20,0)") * F.lit(ONE)).cast("decimal(38,0)")
    return 1 + F.call_function("div", over, (total + 2 * kept).cast("decimal(38,0)"))


def gap(p: Column, q: Column) -> Column:
    """``floor((p - q)^2 / (p + q))``; the same both ways. Rates are at most ONE + 1, so the square fits in 64 bits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least_documents: int = LEAST_DOCUMENTS, top: int = TOP_TERMS,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` and part ``term`` of each (lang, source) group.

    Null text, lang and source are ''. A language keeps the terms of ``least_documents`` of its documents. ``pair``: every other source of the
    language with the sum of ``gap`` over all kept terms. ``term``: the ``top`` terms that the group uses more than its language does, by ``gap``.
    Ties go by the item. A group without terms still has its pairs; a language without kept terms has pairs of value 0.
    An empty table gives no rows; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    own = {"text": text_col, "lang": lang_col, "source": source_col}
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in own.items()])
    partial = stored(
        collapsed(rows).mapInArrow(_count, "lang string, source string, term string, c long, docs long")
        .groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("docs").alias("docs")), "terms")
    kept = partial.groupBy("lang", "term").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= least_documents).select("lang", "term")
    words = stored(partial.select("lang", "source", "term", "c").join(kept, ["lang", "term"], "left_semi"), "kept")
    sizes = words.select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("v"))
    groups = rows.select("lang", "source").distinct()
    spoken = words.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count("*").alias("k"))
    groups = stored(
        groups.join(spoken, ["lang", "source"], "left").join(sizes, "lang", "left")
        .select("lang", "source", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "k", "v")])
        .withColumn("z", F.when(F.col("v") > 0, rate(F.lit(0).cast("long"), F.col("n"), F.col("v"))).otherwise(0)), "groups")
    rates = words.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "c", "z", "k", "v", rate(F.col("c"), F.col("n"), F.col("v")).alias("p"))
    return _pairs(groups, rates).unionByName(_terms(words, groups, rates, top))


def _gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by term and source to ``(lang, a, b, f)``, ``a`` before ``b``: what shared terms change, added up in the task.

    Each row meets the next one, the one after it and so on as long as the term is the same, so pairs are made column by column and never listed.
    """
    names: dict[tuple[str, str], int] = {}
    sums: dict[int, int] = {}

    def flush() -> pa.RecordBatch:
        shown = list(names)
        pairs = [(shown[k >> 32], shown[k & 0xFFFFFFFF][1], f) for k, f in sums.items()]
        return pa.RecordBatch.from_pydict({
            "lang": pa.array([x[0] for x, _, _ in pairs], pa.string()), "a": pa.array([x[1] for x, _, _ in pairs], pa.string()),
            "b": pa.array([y for _, y, _ in pairs], pa.string()), "f": pa.array([f for _, _, f in pairs], pa.int64())})

    held = None
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
        source = [names.setdefault(x, len(names)) for x in zip(table["lang"].to_pylist(), table["source"].to_pylist(), strict=True)]
        source = np.array(source, np.int64)
        p, z = (table[c].to_numpy() for c in ("p", "z"))
        lang, term = (table[c].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64) for c in ("lang", "term"))
        word = lang << 32 | term
        fresh = 0 if held is None else held.num_rows  # pairs of held rows have been made
        for step in range(1, len(p)):
            same = np.flatnonzero(word[step:] == word[:-step])
            if not len(same):
                break
            same = same[same + step >= fresh]
            x, y = same, same + step
            f = _gap(p[x], p[y]) - _gap(p[x], z[y]) - _gap(z[x], p[y]) + _gap(z[x], z[y])
            key, place = np.unique(source[x] << 32 | source[y], return_inverse=True)
            total = np.zeros(len(key), np.int64)
            np.add.at(total, place, f)
            for k, v in zip(key.tolist(), total.tolist(), strict=True):
                sums[k] = sums.get(k, 0) + v
        # the last term may go on in the next batch
        rest = int(np.flatnonzero(word == word[-1])[0])
        held = table.slice(rest).to_batches()[0]
        if len(sums) >= HELD_PAIRS:
            yield flush()
            names, sums = {}, {}
    if sums:
        yield flush()


def _pairs(groups: DataFrame, rates: DataFrame) -> DataFrame:
    """Sum of ``gap`` over all kept terms of each pair of sources, from sparse parts.

    With ``z`` the rate of a term that a source lacks: all terms at (z, z), then the terms of the one at (p, z) and those of the other at
    (z, q) in place of that, and for terms of both the error of having replaced twice.
    """
    x = groups.select("lang", F.col("source").alias("a"), F.col("z").alias("za"), F.col("k").alias("ka"), "v")
    y = groups.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"), F.col("k").alias("kb"))
    pairs = x.join(y, "lang").where("a != b")
    base = pairs.select("lang", "a", "b", F.when(
        F.col("v") > 0, (F.col("v") - F.col("ka") - F.col("kb")) * gap(F.col("za"), F.col("zb"))).otherwise(0).alias("f"))
    # terms of one source by their rate: far fewer rows than terms
    levels = rates.groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    lone = levels.withColumnRenamed("source", "a").join(y, "lang").where("a != b").select(
        "lang", "a", "b", (F.col("m") * gap(F.col("p"), F.col("zb"))).alias("f"))
    lone = lone.groupBy("lang", "a", "b").agg(F.sum("f").alias("f"))
    other = lone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "f")
    dealt = rates.select("lang", "term", "source", "p", "z").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    both = dealt.mapInArrow(_shared, "lang string, a string, b string, f long").groupBy("lang", "a", "b").agg(F.sum("f").alias("f"))
    mirrored = both.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "f")
    total = base.unionByName(lone).unionByName(other).unionByName(both).unionByName(mirrored).groupBy("lang", "a", "b").agg(F.sum("f").alias("value"))
    order = Window.partitionBy("lang", "a").orderBy(F.desc("value"), "b")  # one row per other source
    return total.select(
        "lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), F.col("value").cast("long").alias("value"),
        F.row_number().over(order).alias("rank"))


def _terms(words: DataFrame, groups: DataFrame, rates: DataFrame, top: int) -> DataFrame:
    whole = words.groupBy("lang", "term").agg(F.sum("c").alias("c"))
    size = groups.groupBy("lang").agg(F.sum("n").alias("n"), F.max("v").alias("v"))
    whole = whole.join(size, "lang").select("lang", "term", rate(F.col("c"), F.col("n"), F.col("v")).alias("q"))
    more = rates.join(whole, ["lang", "term"]).where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(
        "lang", "source", F.lit("term").alias("part"), "item", F.col("value").cast("long").alias("value"), "rank")
