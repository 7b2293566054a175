"""Exact k-nearest-neighbour joins (squared L2) without emitting the pairs.

Distances are computed as matrix products inside the tasks and only the best ``k`` of each
query leave a task. Four layouts, chosen by the measured size of the vectors:

* the collection fits the broadcast limit: every query finds its answer where it lies, no shuffle;
* ``k`` is a large part of a collection that fits a task: the collection is sent to each block of queries, so that
  the vectors are shuffled and the answers, which are far more, are not;
* the queries fit: the collection is scanned in place, the per-task answers are merged;
* neither fits: both sides are cut into blocks of bounded size by a hash of their id, and each
  pair of blocks meets in one task.

Distances are rounded to six places and ties go to the smaller id, so the ranking does not depend
on the layout.
"""

from __future__ import annotations

import math
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..session import reliable_checkpoint

BROADCAST_BYTES = 32 << 20
BLOCK_ROWS, MOST_BLOCK_ROWS = 4096, 32768
DIGITS = 6
WIDE_BYTES = 512 << 20  # a collection that a task may hold
WIDE_QUERIES = 8192  # queries that meet a sent collection
_CELLS = 2 << 20  # distances held at a time in one task
_ROWS = 1 << 18  # answers held at a time in one task
_PAIRS = 1 << 16
LARGE = 64.0  # from here on the last digit depends on the order of the sums, so all of it is done in one way


def matrix(column) -> np.ndarray:
    """A list column of equal-length vectors as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    lengths = pc.unique(pc.list_value_length(column))
    if len(lengths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(lengths.to_pylist())[:5]}")
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return values.reshape(n, -1) if n else values.reshape(0, 0)


def answers(queries: np.ndarray, docs: np.ndarray, doc_ids: np.ndarray, k: int):
    """``top_k`` in slices of queries: what is held at a time does not grow with the queries or with ``k``."""
    if not len(queries) or not len(docs):
        return
    k = min(k, len(docs))
    if _takes_most(queries, docs, k):
        for start, c, v in _sorted_all(queries, docs, k):
            yield np.repeat(np.arange(start, start + len(c)), k), doc_ids[c.ravel()], v.ravel()
        return
    norms, coarse = (docs * docs).sum(axis=1), _coarse(queries, docs) if k < len(docs) else None
    step = max(1, min(_CELLS // len(docs), _ROWS // k))
    for start in range(0, len(queries), step):
        q = queries[start:start + step]
        r, c, v = _near(q, docs, norms, coarse, k) if coarse is not None else _all(q, docs, norms, k)
        order = np.lexsort((c, v, r))
        r, c, v = r[order], c[order], v[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
        yield r[keep] + start, doc_ids[c[keep]], v[keep]


def _takes_most(queries: np.ndarray, docs: np.ndarray, k: int) -> bool:
    """Nothing can be ruled out before the sort."""
    return 2 * k >= len(docs) > _ROWS >> 6 and bool(np.isfinite(docs).all() and np.isfinite(queries).all())


def _sorted_all(queries: np.ndarray, docs: np.ndarray, k: int):
    """(first query, places of the docs, distances), a row for each query: the distances are sorted as whole numbers of the last digit.

    The place stands in the lower bits, so that ties stay in its order.
    """
    k = min(k, len(docs))
    norms, bits = (docs * docs).sum(axis=1), int(len(docs) - 1).bit_length()
    place, mask = np.arange(len(docs)), (1 << bits) - 1
    step = max(1, min(_CELLS // len(docs), _ROWS // k))
    for start in range(0, len(queries), step):
        q = queries[start:start + step]
        d = (q * q).sum(axis=1)[:, None] + norms[None, :] - 2.0 * (q @ docs.T)
        d = np.rint(np.maximum(d, 0.0) * 10.0 ** DIGITS)
        if d.max() < 2.0 ** (62 - bits):
            keys = (d.astype(np.int64) << bits) | place
            keys.sort(axis=1)
            keys = keys[:, :k]
            yield start, keys & mask, (keys >> bits) / 10.0 ** DIGITS
        else:
            c = np.argsort(d, axis=1, kind="stable")[:, :k]
            yield start, c, np.take_along_axis(d, c, axis=1) / 10.0 ** DIGITS


def top_k(queries: np.ndarray, docs: np.ndarray, doc_ids: np.ndarray, k: int):
    """Per query the ``k`` nearest docs: (query row, doc id, distance) arrays.

    ``doc_ids`` must be sorted, so that the column order is the tie order.
    """
    found = list(answers(queries, docs, doc_ids, k))
    if not found:
        return np.empty(0, int), np.empty(0, object), np.empty(0)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _all(q: np.ndarray, docs: np.ndarray, norms: np.ndarray, k: int):
    """Every distance of ``q``, and the pairs up to the k-th of each row."""
    d = (q * q).sum(axis=1)[:, None] + norms[None, :] - 2.0 * (q @ docs.T)
    d = np.round(np.maximum(d, 0.0), DIGITS)
    kth = np.partition(d, k - 1, axis=1)[:, k - 1]
    r, c = np.nonzero(d <= kth[:, None])
    return r, c, d[r, c]


def _coarse(queries: np.ndarray, docs: np.ndarray):
    """(docs with their squared length in single precision, bound of the error) or None if a value is too large or missing."""
    if not (np.abs(queries).max(initial=0.0) < LARGE and np.abs(docs).max(initial=0.0) < LARGE):  # also for nan
        return None
    wide = np.hstack([-2.0 * docs, (docs * docs).sum(axis=1)[:, None]]).astype(np.float32)
    longest = np.sqrt((docs * docs).sum(axis=1).max())
    # four times the bound of a sum of dims + 2 rounded products, times the length of a query plus one
    return wide, 4.0 * (docs.shape[1] + 2) * 2.0 ** -24 * max(longest * longest, 2.0 * longest)


def _near(q: np.ndarray, docs: np.ndarray, norms: np.ndarray, coarse, k: int):
    """The pairs of ``_all`` and a few more: those that single precision cannot rule out, with their exact distances."""
    wide, error = coarse
    own = (q * q).sum(axis=1)
    s = np.hstack([q, np.ones((len(q), 1))]).astype(np.float32) @ wide.T
    groups = min(len(docs), max(256, 8 * k))
    tops = s[:, :len(docs) // groups * groups].reshape(len(q), -1, groups).min(axis=1)
    # k groups hold a row up to this each, so the k-th row is no farther
    limit = np.partition(tops, k - 1, axis=1)[:, k - 1] + 2.0 * error * (1.0 + np.sqrt(own)) + 2.0 * 10.0 ** -DIGITS
    at = np.flatnonzero(s <= np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None])
    if len(at) > _PAIRS and len(at) > 4 * k * len(q):  # many copies
        return _all(q, docs, norms, k)
    r, c = np.divmod(at, len(docs))
    d = own[r] + norms[c] - 2.0 * np.einsum("ij,ij->i", q[r], docs[c])
    return r, c, np.round(np.maximum(d, 0.0), DIGITS)


def _batch(query_ids: np.ndarray, ids: np.ndarray, dists: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids, pa.string()), pa.array(ids, pa.string()),
         pa.array(dists, pa.float64())],
        names=["query_id", "id", "distance"],
    )


OUT = "query_id string, id string, distance double"


def _sorted_docs(table) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array(table.column("id").to_pylist(), dtype=object)
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix(table.column("vector"))[order]


def measure(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes of the vectors as float64 and of the ids as Python objects)."""
    n, low, high, text = df.agg(
        F.count("*"), F.min(F.size("vector")), F.max(F.size("vector")), F.sum(F.octet_length("id"))
    ).first()
    if low != high:
        raise ValueError(f"vectors of different lengths: {low} to {high}")
    return n, n * ((high or 0) * 8 + 64) + (text or 0)


def _as_pairs(df: DataFrame, key: str, vector: str) -> DataFrame:
    return df.where(F.col(vector).isNotNull()).select(
        F.col(key).cast("string").alias("id"), F.col(vector).cast("array<float>").alias("vector")
    )


_NUMBER = 17  # separator and row number behind the id


def numbered(queries: DataFrame) -> DataFrame:
    """Query ids with a row number behind them, so that each query row is answered for itself.

    The numbers hold for one run of the plan; checkpoint it before it is used twice.
    """
    row = F.lpad(F.hex(F.monotonically_increasing_id()), 16, "0")
    return queries.where("id is not null").withColumn("id", F.concat("id", F.lit("\x1f"), row))


def unnumbered(answers: DataFrame) -> DataFrame:
    return answers.withColumn(
        "query_id", F.expr(f"substring(query_id, 1, length(query_id) - {_NUMBER})"))


def _best(partial: DataFrame, k: int) -> DataFrame:
    """Merge per-task answers: at most ``k`` rows per query come from each task."""
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _local_to_queries(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    shared = queries.sparkSession.sparkContext.broadcast(_sorted_docs(docs.toArrow()))

    def answer(batches):
        doc_ids, vectors = shared.value
        for b in batches:
            if b.num_rows:
                ids = np.array(b.column("id").to_pylist(), dtype=object)
                for r, i, d in answers(matrix(b.column("vector")), vectors, doc_ids, k):
                    rank = np.arange(len(r)) - np.searchsorted(r, r, side="left") + 1
                    out = _batch(ids[r], i, d)
                    yield out.append_column("rank", pa.array(rank, pa.int32()))

    # all answers of a query come from one task, already ranked
    return queries.mapInArrow(answer, f"{OUT}, rank int")


def _local_to_blocks(queries: DataFrame, docs: DataFrame, n_q: int, k: int) -> DataFrame:
    """The whole collection meets each block of queries: no answer is shuffled, those of a query leave its task in order."""
    cores = queries.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n_q / min(WIDE_QUERIES, max(1, math.ceil(n_q / (2 * cores))))))
    own = F.pmod(F.monotonically_increasing_id(), F.lit(blocks))
    asked = queries.where("id is not null").select(own.cast("int").alias("blk"), F.lit(True).alias("asks"), "id", "vector")
    there = docs.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("blk"), F.lit(False).alias("asks"), "id", "vector")
    met = there.unionByName(asked).repartition(2 * blocks, "blk").sortWithinPartitions("blk", "asks", "id")

    def answer(batches):
        at, held, vectors, ids = None, [], None, None
        for b in batches:
            blk, asks = b.column("blk").to_numpy(), b.column("asks").to_numpy(zero_copy_only=False)
            for lo, hi in pairwise([0, *(np.flatnonzero((np.diff(blk) != 0) | (np.diff(asks.view(np.int8)) != 0)) + 1).tolist(), len(blk)]):
                part = b.slice(lo, hi - lo)
                if blk[lo] != at:
                    at, held, vectors = blk[lo], [], None
                if not asks[lo]:
                    held.append(part.select(["id", "vector"]))
                    continue
                if vectors is None:
                    ids, vectors = _sorted_docs(pa.Table.from_batches(held)) if held else (np.empty(0, object), np.empty((0, 0)))
                    ids, held = pa.array(ids, pa.string()), []
                names = part.column("id")
                asked = matrix(part.column("vector"))
                # a row for each query, taken apart behind the task; the rank is the place in the list
                if _takes_most(asked, vectors, k):
                    found = ((np.arange(at, at + len(c)), np.arange(len(c) + 1) * c.shape[1], c.ravel(), d.ravel()) for at, c, d in _sorted_all(asked, vectors, k))
                else:
                    found = ((r[n], np.append(n, len(r)), c, d) for r, c, d in answers(asked, vectors, np.arange(len(vectors)), k)
                             for n in [np.flatnonzero(np.diff(r, prepend=-1))])
                for q, ends, c, d in found:
                    ends = pa.array(ends, pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [names.take(pa.array(q)), pa.ListArray.from_arrays(ends, ids.take(pa.array(c))), pa.ListArray.from_arrays(ends, pa.array(d))],
                        names=["query_id", "ids", "distances"])

    lists = met.mapInArrow(answer, "query_id string, ids array<string>, distances array<double>")
    return lists.select("query_id", F.posexplode(F.arrays_zip("ids", "distances")).alias("at", "a")).select(
        "query_id", F.col("a.ids").alias("id"), F.col("a.distances").alias("distance"), (F.col("at") + 1).alias("rank"))


def _scan(batches, query_ids: np.ndarray, vectors: np.ndarray, k: int):
    """Answers of all queries from the documents of a task; with a large ``k`` those of each batch, in slices of queries."""
    best = None  # the best k of all batches of the task so far
    for b in batches:
        if not b.num_rows:
            continue
        doc_ids, m = _sorted_docs(b)
        if len(vectors) * k > _CELLS:
            for r, i, d in answers(vectors, m, doc_ids, k):
                yield _batch(query_ids[r], i, d)
            continue
        found = top_k(vectors, m, doc_ids, k)
        if best is not None:
            r, i, d = (np.concatenate(x) for x in zip(best, found, strict=True))
            order = np.lexsort((i, d, r))
            r, i, d = r[order], i[order], d[order]
            keep = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
            found = r[keep], i[keep], d[keep]
        best = found
    if best is not None:
        yield _batch(query_ids[best[0]], best[1], best[2])


def _local_to_docs(queries: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    table = queries.toArrow()
    shared = queries.sparkSession.sparkContext.broadcast(
        (np.array(table.column("id").to_pylist(), dtype=object), matrix(table.column("vector")))
    )

    def answer(batches):
        yield from _scan(batches, *shared.value, k)

    return _best(docs.mapInArrow(answer, OUT), k)


def _answer_cell(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """Best ``k`` of one block pair."""
    if not left.num_rows or not right.num_rows:
        return pa.Table.from_batches([_batch(np.empty(0, object), np.empty(0, object), np.empty(0))])
    ids = np.array(left.column("id").to_pylist(), dtype=object)
    doc_ids, m = _sorted_docs(right)
    r, i, d = top_k(matrix(left.column("vector")), m, doc_ids, k)
    return pa.Table.from_batches([_batch(ids[r], i, d)])


def _cells(queries: DataFrame, docs: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Partial answers of all block pairs that share ``keys``."""
    cells = queries.groupBy(*keys).cogroup(docs.groupBy(*keys))
    return cells.applyInArrow(lambda left, right: _answer_cell(left, right, k), OUT)


def block_of(n_blocks) -> F:
    return F.pmod(F.xxhash64("id"), F.lit(n_blocks) if isinstance(n_blocks, int) else n_blocks)


def block_rows_for(n_q: int, n_d: int, k: int, cores: int) -> int:
    """Rows of a block: as many as a task can hold, since each side is sent once per block of the other, but work for all cores.

    A large ``k`` takes smaller blocks, so that the answers of a cell stay bounded.
    """
    shared = math.isqrt(n_q * n_d // max(1, 4 * cores))
    most = min(MOST_BLOCK_ROWS, max(1, (_ROWS << 4) // max(1, k)))
    return max(min(BLOCK_ROWS, math.isqrt(_ROWS << 4)) if k > BLOCK_ROWS else BLOCK_ROWS, min(shared, most))


def _grid(queries: DataFrame, n_q: int, docs: DataFrame, n_d: int, k: int, rows: int) -> DataFrame:
    q_blocks, d_blocks = max(1, math.ceil(n_q / rows)), max(1, math.ceil(n_d / rows))
    left = queries.withColumn("qb", block_of(q_blocks)).withColumn(
        "db", F.explode(F.sequence(F.lit(0), F.lit(d_blocks - 1)))
    )
    right = docs.withColumn("db", block_of(d_blocks)).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1)))
    )
    as_int = lambda df: df.withColumn("qb", F.col("qb").cast("int")).withColumn(
        "db", F.col("db").cast("int")
    )
    return _best(_cells(as_int(left), as_int(right), ["qb", "db"], k), k)


def nearest(
    queries: DataFrame, docs: DataFrame, k: int, *, query_key: str = "query_id",
    doc_key: str = "id", vector: str = "embedding", broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int | None = None,
) -> DataFrame:
    """``query_id, id, distance, rank`` of the ``k`` nearest docs of every query.

    Every query row is answered for itself, also when ids repeat; documents that repeat an id are
    rows of their own. Fewer docs than ``k`` give fewer rows. Vectors of different lengths raise an
    error. Queries without an id or a vector are left out.
    """
    q, d = _as_pairs(queries, query_key, vector), _as_pairs(docs, doc_key, vector)
    n_d, d_bytes = measure(d)
    if d_bytes <= broadcast_bytes:
        return _local_to_queries(q.where("id is not null"), d, k)
    n_q, q_bytes = measure(q)
    if k > BLOCK_ROWS and d_bytes <= WIDE_BYTES:
        return _local_to_blocks(q, d, n_q, k)
    if q_bytes <= broadcast_bytes:
        return unnumbered(_local_to_docs(numbered(q), d, k))
    rows = block_rows or block_rows_for(n_q, n_d, k, q.sparkSession.sparkContext.defaultParallelism)
    return unnumbered(_grid(reliable_checkpoint(numbered(q)), n_q, d, n_d, k, rows))
