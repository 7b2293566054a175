"""SimHash fingerprints, and the search of all fingerprints within a Hamming radius by permuted block tables.

A text's terms are its words (lower-cased A-Z) and its pairs of neighbouring words. Each distinct term hash votes on
all bits with its weight, for a bit that it has and against one that it has not; the signs are the fingerprint.

The search cuts fingerprints into ``radius + 1`` blocks: two fingerprints within the radius agree in one block
at least, so a table per block (the block permuted to the front, as its key) brings them together. Fingerprints of one key are
compared in bounded cells, and of what is found only a forest leaves a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, components, stored
from .shingles import mix, word_hashes

BITS = 128
WORD, PAIR = 1, 2  # weights of a word and of a pair that occur once
RADIUS = 3
CELL = 1 << 14  # fingerprints of one key that are compared in one go
PART_BYTES = 256 << 20  # text of one range partition, on average
MOST_PARTS = 1 << 16
SAMPLES = 8  # sampled ids for each range partition: they decide the layout, not the result
_TERMS = 1 << 12
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _terms(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term hashes and their weights: a term's weight grows with the logarithm of its occurrences."""
    out = []
    for hashes, weight in ((words, WORD), (mix(words[:-1] * _ODD + words[1:]), PAIR)):
        terms, n = np.unique(hashes, return_counts=True)
        out.append((terms, weight * (1 + np.floor(np.log2(n)).astype(np.int64)) if len(n) else n))
    return np.concatenate([t for t, _ in out]), np.concatenate([w for _, w in out])


def simhash(texts: list[str | None]) -> np.ndarray:
    """``(len(texts), 16)`` bytes; a text without words has a fingerprint of zeros."""
    out = np.zeros((len(texts), BITS // 8), np.uint8)
    with np.errstate(over="ignore"):
        for i, words in enumerate(word_hashes([(t or "").encode("utf-8", "surrogatepass") for t in texts])):
            if not len(words):
                continue
            terms, weights = _terms(words)
            votes = np.zeros(BITS)
            for at in range(0, len(terms), _TERMS):
                t, w = terms[at : at + _TERMS], weights[at : at + _TERMS]
                bits = np.unpackbits(np.stack([mix(t + _ODD), mix(t ^ _ODD)], axis=1).view(np.uint8), axis=1)
                votes += 2 * (w.astype(np.float32) @ bits.astype(np.float32)) - w.sum()  # whole numbers, exact
            out[i] = np.packbits(votes > 0)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine that the number of different bits stands for, 0 at least: 1 for equal fingerprints."""
    away = np.bitwise_count(a ^ b).sum(axis=-1)
    return np.round(np.maximum(0.0, np.cos(np.pi * away / BITS)), 9)


def hexed(prints: np.ndarray) -> list[str]:
    return [p.tobytes().hex() for p in prints]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (32 hex digits).

    A null text counts as empty; ids may be null or repeat; other columns are not read.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "fingerprint": pa.array(hexed(simhash(b["text"].to_pylist())), pa.string())})

    return rows.mapInArrow(prints, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string")


# --- neighbours in the order of the ids ----------------------------------------------------


def _ranges(rows: DataFrame):
    """Ascending range bounds ``(id, h)`` from a bounded sample of the ids, and a function to the range of a row.

    ``h`` parts rows of one repeated id; nulls come first.
    """
    spark = rows.sparkSession
    size = rows.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (size.bytes or 0) // PART_BYTES)
    parts = max(1, min(parts, MOST_PARTS, size.n))
    drawn = rows.sample(fraction=min(1.0, 2.0 * SAMPLES * parts / max(size.n, 1)), seed=7).limit(4 * SAMPLES * parts)
    found = sorted(((r.id, r.h) for r in drawn.select("id", "h").collect()), key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[1]))
    bounds = [found[len(found) * i // parts] for i in range(1, parts)] if found else []
    nulls = [h for i, h in bounds if i is None]
    ids = [i for i, _ in bounds if i is not None]
    hashes = [h for i, h in bounds if i is not None]

    def spread(id_: pd.Series, h: pd.Series) -> pd.Series:
        out = np.zeros(len(id_), np.int32)
        none = id_.isna().to_numpy()
        out[none] = np.searchsorted(np.array(nulls, np.int64), h.to_numpy()[none], side="right")
        if ids:
            keys = np.array(ids)
            x = id_[~none].to_numpy().astype(keys.dtype, copy=False)
            low, high = np.searchsorted(keys, x, side="left"), np.searchsorted(keys, x, side="right")
            own = h.to_numpy()[~none]
            for i in np.flatnonzero(low < high).tolist():  # the id is a bound
                low[i] += np.searchsorted(np.array(hashes[low[i] : high[i]], np.int64), own[i], side="right")
            out[~none] = low + len(nulls)
        else:
            out[~none] = len(nulls)
        return pd.Series(out)

    return F.pandas_udf(spread, "int"), parts


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, text, range, halo`` in partitions in which each row is followed by the next one in descending order of the id.

    Rows are dealt by ranges of the id (one shuffle of the texts). The first row of each range is sent a second
    time, as the ``halo`` row behind the last one of the range before, and the very first row behind the very last one. Null ids come last,
    rows of one id follow the hash of their text. Only the range bounds and one id per range reach the driver (at most ``MOST_PARTS``).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    slim = stored(rows.select("id", "h", F.octet_length("text").cast("long").alias("bytes")), "ids")
    spread, parts = _ranges(slim)
    firsts = slim.groupBy(spread("id", "h").alias("range")).agg(F.max(F.struct("id", "h")).alias("first"))
    heads = sorted(((r["range"], r["first"]) for r in firsts.collect()), reverse=True)
    # the first row of a range goes behind the range before it in descending order, the first of all behind the last of all
    behind = [(at, f.id, f.h, heads[i - 1][0]) for i, (at, f) in enumerate(heads)]
    kind = slim.schema["id"].dataType.simpleString()
    table = spark.createDataFrame(behind, f"_range int, _id {kind}, _h long, _behind int")
    dealt = rows.withColumn("range", spread("id", "h"))
    same = (F.col("range") == F.col("_range")) & F.col("id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))
    places = F.array_compact(F.array(
        F.struct(F.col("range"), F.lit(False).alias("halo")),
        F.when(F.col("_behind").isNotNull(), F.struct(F.col("_behind").alias("range"), F.lit(True).alias("halo")))))
    dealt = dealt.join(F.broadcast(table), same, "left").select("id", "h", "text", F.explode(places).alias("to"))
    dealt = dealt.select("id", "h", "text", "to.range", "to.halo").repartitionById(parts, "range")
    order = ["range", "halo", F.desc_nulls_last("id"), F.desc("h")]
    return dealt.sortWithinPartitions(*order).select(F.col("id").alias("doc_id"), "text", "range", "halo")


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the first as many characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: its fingerprint beside those of an edited text and of the next document.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` (and ``edited_text``).
    The edited text takes its last half from the start of the next document in descending order of the ids (see
    ``with_next``; a single document follows itself). Null texts count as empty, other columns are not read, an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = with_next(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row so far: its follower is still to come
        for b in batches:
            ids, texts = b["doc_id"], b["text"].to_pylist()
            ranges, halo = b["range"].to_pylist(), b["halo"].to_pylist()
            prints = simhash(texts)
            if held:
                ids = pa.concat_arrays([held[0], ids])
                texts, ranges, halo = [held[1], *texts], [held[2], *ranges], [held[3], *halo]
                prints = np.concatenate([held[4], prints])
            at = [i for i in range(len(texts) - 1) if not halo[i] and ranges[i] == ranges[i + 1]]
            after = [i + 1 for i in at]
            changed = [edited(texts[i], texts[i + 1]) for i in at]
            others = simhash(changed)
            out = {
                "doc_id": ids.take(pa.array(at, pa.int64())),
                "n_chars": pa.array([len(texts[i]) for i in at], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
                "fingerprint": pa.array(hexed(prints[at]), pa.string()), "edited_fingerprint": pa.array(hexed(others), pa.string()),
                "near_edited": pa.array(likeness(prints[at], others), pa.float64()),
                "near_next": pa.array(likeness(prints[at], prints[after]), pa.float64()),
            }
            if with_text:
                out["edited_text"] = pa.array(changed, pa.string())
            yield pa.RecordBatch.from_pydict(out)
            if len(texts):
                held = (ids.slice(len(ids) - 1, 1), texts[-1], ranges[-1], halo[-1], prints[-1:].copy())

    return rows.mapInArrow(
        compare, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double" + (", edited_text string" if with_text else ""))


# --- search within a radius ----------------------------------------------------------------


def _forest(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join all of ``prints`` reachable within ``radius`` of each other: one fewer than members of each component."""
    left, links = np.arange(len(prints)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count(prints[left] ^ prints[x]).sum(axis=1) <= radius
            hit = left[near].tolist()
            links += [(x, y) for y in hit]
            queue += hit
            left = left[~near]
    return links


def _cells(radius: int):
    """Runs of equal ``(block, key, cell)`` to links between their fingerprints."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links() -> pa.RecordBatch:
            prints = np.frombuffer(b"".join(held), np.uint64).reshape(-1, BITS // 64)
            found = _forest(prints, radius) if len(held) > 1 else []
            return pa.RecordBatch.from_pydict({
                "a": pa.array([held[i] for i, _ in found], pa.binary()), "b": pa.array([held[j] for _, j in found], pa.binary())})

        for b in batches:
            for k, f in zip(zip(*(b[c].to_pylist() for c in ("block", "key", "cell")), strict=True), b["f"].to_pylist(), strict=True):
                if k != key:
                    if len(held) > 1:
                        yield links()
                    key, held = k, []
                held.append(f)
        if len(held) > 1:
            yield links()

    return rows


def radius_links(prints: DataFrame, radius: int = RADIUS, cell: int | None = None) -> DataFrame:
    """Links ``(a, b)`` between distinct fingerprints ``(f binary)`` that give the same components as all pairs within ``radius``.

    Keys held by one fingerprint go no further. A key with more than ``CELL`` fingerprints is cut into slices by hash, and each pair of slices is a cell of
    its own, so that no cell grows with the data and no pair is left out.
    """
    cell = cell or CELL
    blocks = radius + 1
    cuts = [BITS // 8 * i // blocks for i in range(blocks + 1)]  # whole bytes
    keyed = prints.select("f", F.posexplode(F.array(*[
        F.substring("f", x + 1, y - x) for x, y in zip(cuts, cuts[1:], strict=False)])).alias("block", "key"))
    busy = keyed.groupBy("block", "key").agg(F.count("*").alias("n")).where("n > 1")
    keyed = keyed.join(busy, ["block", "key"])
    slices = F.ceil(F.col("n") / F.lit(cell)).cast("int")
    keyed = keyed.withColumn("slices", slices).withColumn("slice", F.pmod(F.xxhash64("f"), F.col("slices")).cast("int"))
    cells = F.expr("transform(sequence(0, slices - 1), x -> struct(least(x, slice) as x, greatest(x, slice) as y))")
    celled = keyed.select("block", "key", "f", F.explode(cells).alias("cell")).select(
        "block", "key", "f", F.concat_ws(":", "cell.x", "cell.y").alias("cell"))
    dealt = celled.repartition("block", "key", "cell").sortWithinPartitions("block", "key", "cell")
    return dealt.mapInArrow(_cells(radius), "a binary, b binary")


def near_groups(prints: DataFrame, radius: int = RADIUS, id_col: str = "doc_id", print_col: str = "fingerprint") -> DataFrame:
    """``prints`` with ``near_id``: the smallest id reachable by fingerprints at most ``radius`` bits apart.

    Equal fingerprints are one vertex, however many rows share it. Rows without a fingerprint, or with the zeros of a wordless
    text, keep their own id; ids may be null or repeat (a group takes its smallest non-null id).
    """
    if not 0 <= radius < BITS // 8:
        raise ValueError(f"radius must be from 0 to {BITS // 8 - 1}")
    f = F.unhex(F.col(print_col))
    real = prints.where(F.col(print_col) != "0" * (BITS // 4))
    classes = stored(real.groupBy(f.alias("f")).agg(F.min(id_col).alias("id")), "prints")
    roots = components(radius_links(classes.select("f"), radius))
    named = classes.join(roots, classes["f"] == roots["v"], "left").select("f", "id", F.coalesce("root", "f").alias("root"))
    least = named.groupBy(F.col("root").alias("r")).agg(F.min("id").alias("_near"))
    # only groups of several fingerprints or rows can change an id
    moved = named.join(least, F.col("root") == F.col("r")).select(F.lower(F.hex("f")).alias("_f"), "_near")
    return prints.join(moved, F.col(print_col) == F.col("_f"), "left").select(
        *[prints[c] for c in prints.columns], F.coalesce("_near", prints[id_col]).alias("near_id"))
