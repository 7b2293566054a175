"""Removal of lines that follow a recurring template: a fixed-depth log-template tree.

The tree has the number of tokens on its first level and the leading tokens below, down to the third one without a digit. Tokens with a
digit are variable from the start. In a leaf shared by enough documents a token is fixed at its place by
its share of the lines of the leaf, at several levels: a line follows the template of all its words, and
at each level the one that keeps only the tokens with that share or more. Fields with few values thus
part a leaf at the low levels only, whatever the size of the input. This needs counts only, so it does not depend on the
order in which lines are met, and a leaf of any size is counted on the map side.

Lines that recur word for word are counted besides by their exact text: short ones have no leaf, longer
ones need fewer documents, and one occurrence of each stays.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, stored

DEPTH = 3  # leading tokens without a digit of a leaf; those with a digit before them belong to it too
LEAST_TOKENS = 4  # shorter lines have no template, they count by their exact text
LEAST_DOCUMENTS = 8  # a template recurs from here on
#: Documents from which on a line recurs by its exact text: with LEAST_TOKENS tokens, and with LONG_TOKENS; shorter ones need LEAST_DOCUMENTS.
VERBATIM_DOCUMENTS, LONG_TOKENS, LONG_DOCUMENTS = 4, 50, 2
#: Levels: least share of the lines of a leaf that hold a fixed token. At most 1 / SHARES[0] tokens of a place are listed.
SHARES = (0.05, 0.2, 0.5, 0.9)
#: Rows of the lists that are broadcast instead of shuffling lines or texts (up to 20 and about 60 bytes a row).
BROADCAST_LEAVES, BROADCAST_ROWS = 2_000_000, 300_000
SLICE_LINES = 4096  # lines of one leaf that meet its list of tokens in one place
_VARIABLE = re.compile(r"\S*[0-9]\S*")


def line_tokens(line: str) -> list[str]:
    """The tokens of a line; those with a digit are ``<*>``."""
    return _VARIABLE.sub("<*>", line).split()


def _hash(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _needed(tokens: list[str], line: str) -> int:
    """Documents from which on the exact text of a line recurs; 0 if it never does."""
    if len(tokens) >= LONG_TOKENS:
        return LONG_DOCUMENTS
    if len(tokens) >= LEAST_TOKENS:
        return VERBATIM_DOCUMENTS if any(x != "<*>" for x in tokens) else 0
    return LEAST_DOCUMENTS if any(map(str.isalpha, line)) else 0  # blank lines, brackets, rules and bare numbers stay


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``(row, line, exact, need, leaf, tokens)`` for each line that may recur; leaf and tokens are null if it has no template."""
    for b in batches:
        out = {c: [] for c in ("row", "line", "exact", "need", "leaf", "tokens")}
        for row, text in zip(b["row"].to_pylist(), b["text"].to_pylist(), strict=True):
            for at, line in enumerate((text or "").split("\n")):
                t = line_tokens(line)
                words = [i for i, x in enumerate(t) if x != "<*>"]
                need = _needed(t, line)
                leaf = tokens = None
                if len(t) >= LEAST_TOKENS and words:
                    end = words[min(DEPTH, len(words)) - 1] + 1
                    leaf = _hash(f"{len(t)} {' '.join(t[:end])}".encode("utf-8", "surrogatepass"))
                    tokens = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in t], "<u4").tobytes()
                if need or leaf is not None:
                    exact = _hash(line.strip().encode("utf-8", "surrogatepass")) if need else None
                    for c, x in zip(out, (row, at, exact, need, leaf, tokens), strict=True):
                        out[c].append(x)
        yield pa.RecordBatch.from_pydict({
            "row": pa.array(out["row"], pa.int64()), "line": pa.array(out["line"], pa.int32()), "exact": pa.array(out["exact"], pa.int64()),
            "need": pa.array(out["need"], pa.int32()), "leaf": pa.array(out["leaf"], pa.int64()), "tokens": pa.array(out["tokens"], pa.binary())})


_WILD = zlib.crc32(b"<*>")
_LEVEL_BITS = 3


def _after_lead(tokens: list[int]) -> int:
    """The first place behind the tokens of the leaf."""
    words = [i for i, x in enumerate(tokens) if x != _WILD]
    return words[min(DEPTH, len(words)) - 1] + 1


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts by leaf and place, added up within the batch."""
    for b in batches:
        counts: dict[tuple[int, int, int], int] = {}
        for leaf, tokens in zip(b["leaf"].to_pylist(), b["tokens"].to_pylist(), strict=True):
            t = np.frombuffer(tokens, "<u4").tolist()
            lead = _after_lead(t)
            for place, token in enumerate(t):
                if token != _WILD and place >= lead:
                    key = (leaf, place, token)
                    counts[key] = counts.get(key, 0) + 1
        keys = list(counts)
        yield pa.RecordBatch.from_pydict({
            "leaf": pa.array([k[0] for k in keys], pa.int64()), "place": pa.array([k[1] for k in keys], pa.int32()),
            "token": pa.array([k[2] for k in keys], pa.int64()), "n": pa.array(counts.values(), pa.int64())})


def _templates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with the listed tokens of their leaf to ``(row, line, exact, template)``: the different templates of all levels."""
    for b in batches:
        out, known, last = {"row": [], "line": [], "exact": [], "template": []}, {}, None
        for row, line, exact, leaf, tokens, fixed in zip(
                *(b[c].to_pylist() for c in ("row", "line", "exact", "leaf", "tokens", "fixed")), strict=True):
            if leaf != last:
                known, last = {x >> _LEVEL_BITS: x & (1 << _LEVEL_BITS) - 1 for x in fixed or ()}, leaf
            t = np.frombuffer(tokens, "<u4")
            lead = _after_lead(t.tolist())
            # level of each place; below 0 it is a wildcard at every level but the first
            level = np.array([
                -2 if x == _WILD else len(SHARES) if i < lead else known.get(i << 32 | x, -1) for i, x in enumerate(t.tolist())])
            words, before = int((level > -2).sum()), -1
            for least in range(-1, len(SHARES)):
                stay = level >= least
                n = int(stay.sum())
                if 2 * n <= words:
                    break  # no more fixed words than variable ones; higher levels keep less
                if n != before:
                    before = n
                    key = leaf.to_bytes(8, "little", signed=True) + np.where(stay, t, 0).astype("<u4").tobytes()
                    out["row"].append(row)
                    out["line"].append(line)
                    out["exact"].append(exact)
                    out["template"].append(_hash(key))
        yield pa.RecordBatch.from_pydict({
            "row": pa.array(out["row"], pa.int64()), "line": pa.array(out["line"], pa.int32()), "exact": pa.array(out["exact"], pa.int64()),
            "template": pa.array(out["template"], pa.int64())})


def _sent(stored_rows: DataFrame, most: int) -> DataFrame:
    """Marked for broadcast if it is small enough; else Spark joins by a shuffle."""
    return F.broadcast(stored_rows) if stored_rows.count() <= most else stored_rows


def recurring_lines(rows: DataFrame) -> DataFrame:
    """``row, line`` of every line to drop, for ``rows (row, text)`` with unique ``row``."""
    bounded_batches(rows.sparkSession)
    all_lines = stored(rows.mapInArrow(_lines, "row long, line int, exact long, need int, leaf long, tokens binary"), "lines")
    exact = (
        all_lines.where("need > 0").select("row", "exact", "need").distinct().groupBy("exact").agg(F.count("*").alias("docs"), F.min("need").alias("need"))
        .where("docs >= need").select("exact")
    )
    verbatim = all_lines.where("need > 0").select("row", "line", "exact").join(_sent(stored(exact, "exact"), BROADCAST_LEAVES), "exact")
    verbatim = stored(verbatim, "verbatim")
    # one occurrence of each text stays
    stays = verbatim.groupBy("exact").agg(F.min(F.struct("row", "line")).alias("first")).select("first.row", "first.line")
    copies = verbatim.select("row", "line").join(stays, ["row", "line"], "left_anti")
    lines = all_lines.where("leaf is not null").select("row", "line", "exact", "leaf", "tokens")
    leaves = (
        lines.groupBy("row", "leaf").agg(F.count("*").alias("k")).groupBy("leaf").agg(F.count("*").alias("docs"), F.sum("k").alias("lines"))
        .where(F.col("docs") >= LEAST_DOCUMENTS).select("leaf", "lines")
    )
    # the lines of a leaf are dealt to slices of bounded size
    leaves = stored(leaves.withColumn("slices", F.ceil(F.col("lines") / SLICE_LINES).cast("int")), "leaves")
    slice_ = F.pmod(F.xxhash64("row", "line"), F.col("slices")).cast("int").alias("slice")
    met = lines.join(_sent(leaves.select("leaf", "slices"), BROADCAST_LEAVES), "leaf")
    met = stored(met.select("row", "line", "exact", "leaf", slice_, "tokens"), "met")
    places = met.select("leaf", "tokens").mapInArrow(_places, "leaf long, place int, token long, n long")
    places = places.groupBy("leaf", "place", "token").agg(F.sum("n").alias("n"))
    # a token of fewer lines than LEAST_DOCUMENTS is in no recurring template
    places = places.where(F.col("n") >= LEAST_DOCUMENTS).join(_sent(leaves, BROADCAST_LEAVES), "leaf")
    places = places.where(F.col("n") >= F.col("lines") * SHARES[0])
    level = sum((F.col("n") >= F.col("lines") * x).cast("long") for x in SHARES) - 1
    # (place << 32 | token) and its level; no more than 1 / SHARES[0] at each place
    entry = F.expr(f"shiftleft(shiftleft(cast(place as bigint), 32) | token, {_LEVEL_BITS})").bitwiseOR(level)
    fixed = places.groupBy("leaf", "slices").agg(F.collect_list(entry).alias("fixed"))
    fixed = fixed.select("leaf", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "fixed")
    found = met.join(fixed, ["leaf", "slice"], "left").select("row", "line", "exact", "leaf", "tokens", "fixed").mapInArrow(
        _templates, "row long, line int, exact long, template long")
    found = stored(found, "templates")
    # a template of one text only is that text word for word
    often = (
        found.groupBy("row", "template").agg(F.min("exact").alias("low"), F.max("exact").alias("high"))
        .groupBy("template").agg(F.count("*").alias("docs"), F.min("low").alias("low"), F.max("high").alias("high"))
        .where((F.col("docs") >= LEAST_DOCUMENTS) & (F.col("low") != F.col("high"))).select("template")
    )
    return found.select("row", "line", "template").join(_sent(stored(often, "often"), BROADCAST_LEAVES), "template").select("row", "line").union(copies)


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_lines, n_dropped, text``: one row per input row, without its recurring lines.

    A line goes in every document if one of its templates occurs in ``LEAST_DOCUMENTS`` documents or more, in different wordings, and
    has more fixed words than variable ones there; tokens with a digit count on neither side. It also goes if its
    exact text, without white space at its ends, occurs in ``LONG_DOCUMENTS`` (from ``LONG_TOKENS`` tokens on),
    ``VERBATIM_DOCUMENTS`` (from ``LEAST_TOKENS`` on) or ``LEAST_DOCUMENTS`` documents (shorter ones), but for one occurrence (the
    smallest hash of id and text, there the first line), so that no text is lost with its last copy. Short lines without a letter and
    lines of numbers below ``LONG_TOKENS`` tokens stay. A null text stays
    null and has no lines; an empty text has one. Rows are told apart by content, so null and repeated ids do
    no harm: rows that share id and text are one document and get the same text. Other columns are not read.
    """
    text = F.col(text_col)
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(id_col).isNull(), text, text.isNull())
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), key.alias("row"))
    gone = stored(recurring_lines(base.select("row", "text")).distinct(), "dropped")
    per_row = stored(gone.groupBy("row").agg(F.collect_list("line").alias("_gone")), "gone")
    joined = base.join(_sent(per_row, BROADCAST_ROWS), "row", "left")
    rest = F.expr("array_join(filter(split(text, '\\n', -1), (x, i) -> not array_contains(coalesce(_gone, array()), i)), '\\n')")
    return joined.select(
        "doc_id", F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"), rest.alias("text"))
