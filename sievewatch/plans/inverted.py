"""Approximate nearest neighbours: a stored index of inverted lists with product-quantised residuals.

``build_index`` cuts the space into lists (k-means cells) and stores, list by list, a code of a few bytes for each vector (what is
left of it behind its centroid, quantised in subspaces) beside the vectors themselves. A search opens the nearest
``n_probe`` lists of each query, ranks their rows by codes alone, and reads the whole vectors of the best few only, which are then ranked by the
exact distance. Every row is indexed; what is fitted on a sample is the centroids (``TRAIN_ROWS``) and the number of lists to open
(``TUNE_QUERIES``, compared with the exact search).

Files of an index folder: ``codes`` and ``vectors`` (Parquet, partitioned by list), ``lists``, ``codebooks``, and ``meta``, which
is written last: a folder without it is no index.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import reliable_checkpoint, scratch_path
from .nearest import DIGITS, _as_pairs, matrix, nearest
from .pruned import centroids_of, groups_of

MOST_LISTS = 4096
TRAIN_ROWS = 65_536  # bounded sample for centroids and codebooks
TUNE_QUERIES = 200  # sampled rows whose exact neighbours set the number of lists to open
TUNE_K = 10
SUBSPACES, CODES = 16, 256
RECALL = 0.95  # share of true neighbours that lie in the opened lists
RERANK = 20  # exact distances per wanted row
SLICE_ROWS = 1 << 16  # rows of one stored file
GROUP_ROWS = 1 << 20  # codes of one cell of a search
SLICE_QUERIES, MOST_SLICE_QUERIES = 1 << 11, 1 << 13  # queries of one cell
BLOCK_VECTORS, MOST_CHOSEN = 1 << 17, 6 << 20  # vectors and chosen rows of one cell of the exact comparison
_SLICE = 1 << 10
_ROOM = 1 << 10  # places that are added to the best at a time
_LAST, _HOLDS = float(np.finfo(np.float32).max), 1e15
_NONE = np.uint64(0xffffffffffffffff)
_CELLS = 4 << 20


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2.0 * (x @ y.T), 0.0)


def _cuts(dims: int, parts: int) -> list[int]:
    return [dims * i // parts for i in range(parts + 1)]


# --- building ------------------------------------------------------------------------------


def _train_codebook(residuals: np.ndarray, codes: int, seed: int, rounds: int = 12) -> np.ndarray:
    """Centroids of one subspace by Lloyd's rounds; an empty cell moves to the row that is farthest off."""
    rng = np.random.default_rng(seed)
    centres = residuals[rng.choice(len(residuals), codes, replace=len(residuals) < codes)]
    for _ in range(rounds):
        d = _squared(residuals, centres)
        own = d.argmin(axis=1)
        n = np.bincount(own, minlength=codes)
        sums = np.stack([np.bincount(own, v, codes) for v in residuals.T], axis=1)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
        empty = np.flatnonzero(n == 0)
        if len(empty):
            far = np.argsort(-d[np.arange(len(own)), own], kind="stable")[: len(empty)]
            centres[empty[: len(far)]] = residuals[far]
    return centres


def _codebooks(sample: DataFrame, centroids, dims: int, parts: int, seed: int) -> np.ndarray:
    """``(dims, CODES)`` values of all subspaces, each trained in a task of its own on the sample's residuals."""
    cuts = _cuts(dims, parts)

    def residuals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("vector"))
                r = x - c[_squared(x, c).argmin(axis=1)]
                yield pa.RecordBatch.from_pydict({
                    "sub": pa.array(np.repeat(np.arange(parts, dtype=np.int32), len(r))),
                    "part": pa.array([v.tolist() for lo, hi in zip(cuts, cuts[1:], strict=False) for v in r[:, lo:hi]], pa.list_(pa.float64()))})

    def train(rows: pd.DataFrame) -> pd.DataFrame:
        sub = int(rows["sub"].iloc[0])
        # in an order of their own, so that the outcome does not depend on the arrival of rows
        points = np.array(sorted(tuple(v) for v in rows["part"]))
        centres = _train_codebook(points, CODES, seed + sub)
        return pd.DataFrame({"sub": sub, "code": np.arange(CODES), "centre": centres.tolist()})

    # the sample is a single partition; few subspaces, and Spark would merge them into one task
    tasks = sample.sparkSession.sparkContext.defaultParallelism
    found = sample.repartition(tasks).mapInArrow(residuals, "sub int, part array<double>").repartition(4 * parts, "sub").groupBy("sub").applyInPandas(
        train, "sub int, code int, centre array<double>").collect()  # SUBSPACES * CODES rows
    books = np.zeros((dims, CODES))
    for r in found:
        books[cuts[r.sub]:cuts[r.sub + 1], r.code] = r.centre
    return books


def _encoded(docs: DataFrame, centroids, books, parts: int) -> DataFrame:
    """``id, row, vector, list, code``: the nearest list of each row and the code of what is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, b_ = centroids.value, books.value
        cuts = _cuts(c.shape[1], parts)
        for b in batches:
            if not b.num_rows:
                continue
            x = matrix(b.column("vector"))
            own = _squared(x, c).argmin(axis=1)
            r = x - c[own]
            codes = np.stack([
                _squared(r[:, lo:hi], b_[lo:hi].T).argmin(axis=1) for lo, hi in zip(cuts, cuts[1:], strict=False)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("row"), b.column("vector"), pa.array(own.astype(np.int32)),
                 pa.array([v.tobytes() for v in codes], pa.binary())], names=["id", "row", "vector", "list", "code"])

    return docs.mapInArrow(run, "id string, row long, vector array<float>, list int, code binary")


def build_index(
    docs: DataFrame, path: str, *, doc_key: str = "id", vector: str = "embedding", n_lists: int | None = None,
    recall: float = RECALL, seed: int = 7,
) -> "Index":
    """Index all rows of ``docs`` under ``path`` (a folder that does not exist yet) and open it.

    Rows without a vector are left out; documents that repeat an id are rows of their own. ``recall`` is the share of
    true neighbours that the opened lists are to hold, measured on sampled rows.
    """
    spark = docs.sparkSession
    d = reliable_checkpoint(_as_pairs(docs, doc_key, vector).where("id is not null").withColumn("row", F.monotonically_increasing_id()))
    n, low, high = d.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if not n:
        raise ValueError("nothing to index")
    if low != high or not low:
        raise ValueError(f"vectors of different lengths: {low} to {high}")
    lists = n_lists or max(1, min(MOST_LISTS, math.isqrt(n)))
    parts = min(SUBSPACES, low)
    sample = reliable_checkpoint(d.sample(fraction=min(1.0, 1.2 * TRAIN_ROWS / n), seed=seed).limit(TRAIN_ROWS).select("vector"))
    if sample.isEmpty():
        sample = d.limit(TRAIN_ROWS).select("vector")
    centres = centroids_of(sample.distinct(), lists, seed)  # copies do not draw lists to them
    sc = spark.sparkContext
    centroids = sc.broadcast(centres)
    books = _codebooks(sample, centroids, low, parts, seed)
    rows = reliable_checkpoint(_encoded(d, centroids, sc.broadcast(books), parts))

    sizes = rows.groupBy("list").agg(F.count("*").alias("n"))
    sizes = spark.createDataFrame([(r.list, r.n) for r in sizes.collect()], "list int, n long")  # at most MOST_LISTS rows
    # a much-filled list is written by several tasks
    dealt = rows.join(F.broadcast(sizes), "list").withColumn(
        "slice", F.pmod(F.xxhash64("row"), F.ceil(F.col("n") / SLICE_ROWS))).repartition(4 * sc.defaultParallelism, "list", "slice")
    for name, columns in (("codes", ["row", "code"]), ("vectors", ["row", "id", "vector"])):
        dealt.select("list", *columns).sortWithinPartitions("list", "row").write.partitionBy("list").parquet(f"{path}/{name}")
    sizes.join(
        spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(centres)], "list int, centre array<double>"), "list",
    ).coalesce(1).write.parquet(f"{path}/lists")
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(books)], "dim int, centres array<double>").coalesce(1).write.parquet(f"{path}/codebooks")
    spark.createDataFrame(
        [(n, low, parts, _tuned(d, centres, rows, n, recall, seed))], "n long, dims int, parts int, n_probe int").write.parquet(f"{path}/meta")
    return Index(spark, path)


def _tuned(d: DataFrame, centres: np.ndarray, rows: DataFrame, n: int, recall: float, seed: int) -> int:
    """Fewest lists to open, so that they hold ``recall`` of the exact neighbours of sampled rows."""
    asked = d.orderBy(F.xxhash64("row", F.lit(seed))).limit(TUNE_QUERIES)
    asked = reliable_checkpoint(asked.select(F.col("row").cast("string").alias("query_id"), F.col("vector").alias("embedding")))
    keyed = d.select(F.col("row").cast("string").alias("id"), F.col("vector").alias("embedding"))
    true = nearest(asked, keyed, TUNE_K).select("query_id", "id")
    where = rows.select(F.col("row").cast("string").alias("id"), "list")
    near: dict[str, list[int]] = {}
    for r in true.join(where, "id").collect():  # TUNE_QUERIES * TUNE_K rows
        near.setdefault(r.query_id, []).append(r.list)
    place = []  # how many lists have to be opened for each true neighbour
    for q in asked.collect():
        order = np.argsort(_squared(np.array([q.embedding], float), centres)[0], kind="stable")
        rank = np.empty(len(order), int)
        rank[order] = np.arange(1, len(order) + 1)
        place += rank[near.get(q.query_id, [])].tolist()
    return int(np.quantile(place, min(recall, 1.0), method="higher")) if place else len(centres)


# --- searching -----------------------------------------------------------------------------


@dataclass
class Index:
    """A stored index; only the centroids and codebooks (bounded by ``MOST_LISTS``) are read when it is opened."""

    spark: SparkSession
    path: str

    def __post_init__(self):
        try:
            self.n, self.dims, self.parts, self.n_probe = self.spark.read.parquet(f"{self.path}/meta").first()
        except AnalysisException as e:
            raise ValueError(f"{self.path} holds no finished index") from e
        found = sorted((r.list, r.n, r.centre) for r in self.spark.read.parquet(f"{self.path}/lists").collect())
        self.lists = np.array([i for i, _, _ in found], np.int32)  # lists with rows
        self.sizes = np.array([m for _, m, _ in found], np.int64)
        self.centres = np.array([c for _, _, c in found])
        books = sorted((r.dim, r.centres) for r in self.spark.read.parquet(f"{self.path}/codebooks").collect())
        self.books = np.array([c for _, c in books])

    def probes(self, queries: DataFrame, n_probe: int) -> DataFrame:
        """``q, list``: the lists that are opened for each query."""
        opened = self._opener(n_probe)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, _SLICE):
                    part = b.slice(at, _SLICE)
                    near = opened(matrix(part.column("vector")))
                    each = pa.array(np.repeat(np.arange(part.num_rows), near.shape[1]))
                    yield pa.RecordBatch.from_arrays([part.column("q").take(each), pa.array(near.ravel())], names=["q", "list"])

        return queries.select("q", "vector").mapInArrow(run, "q long, list int")

    def _opener(self, n_probe: int):
        """Function from query vectors to the lists that are opened for them, one row each."""
        shared = self.spark.sparkContext.broadcast((self.lists, self.centres))
        m, dims = min(n_probe, len(self.lists)), self.dims

        def opened(x: np.ndarray) -> np.ndarray:
            lists, centres = shared.value
            if x.shape[1] != dims:
                raise ValueError(f"queries have {x.shape[1]} dimensions, the index {dims}")
            near = [np.argsort(_squared(x[at:at + _SLICE], centres), axis=1, kind="stable")[:, :m] for at in range(0, len(x), _SLICE)]
            return lists[np.concatenate(near)]

        return opened

    def rows_searched(self, queries: DataFrame, n_probe: int | None = None, vector: str = "embedding") -> DataFrame:
        """``q, searched``: how many rows a search looks at for each query."""
        opened, sizes = self._opener(n_probe or self.n_probe), self.spark.sparkContext.broadcast((self.lists, self.sizes))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists, n = sizes.value
            for b in batches:
                for at in range(0, b.num_rows, _SLICE):
                    part = b.slice(at, _SLICE)
                    rows = n[np.searchsorted(lists, opened(matrix(part.column("vector"))))].sum(axis=1)
                    yield pa.RecordBatch.from_arrays([part.column("q"), pa.array(rows, pa.int64())], names=["q", "searched"])

        return _asked(queries, vector=vector).select("q", "vector").mapInArrow(run, "q long, searched long")

    def _used(self, asked: DataFrame, n_probe: int) -> list[int]:
        """The lists that any query opens: at most MOST_LISTS, each once from a batch."""
        opened = self._opener(n_probe)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(opened(matrix(b.column("vector")))), pa.int32())], names=["list"])

        return [r.list for r in asked.select("vector").mapInArrow(run, "list int").distinct().collect()]

    def search(
        self, queries: DataFrame, k: int, *, n_probe: int | None = None, rerank: int = RERANK, query_key: str = "query_id",
        vector: str = "embedding",
    ) -> DataFrame:
        """``query_id, id, distance, rank`` of about the ``k`` nearest rows; distances are exact, rows may be missed.

        ``n_probe`` lists are opened for a query (default: what the index was tuned to) and ``rerank * k`` rows compared exactly. With all
        lists and a rerank that covers them the rows are those of the full search. Each query row is answered for itself.
        """
        asked = reliable_checkpoint(_asked(queries, query_key, vector))
        n_q, cores = asked.count(), self.spark.sparkContext.defaultParallelism
        used = self._used(asked, n_probe or self.n_probe)
        size = dict(zip(self.lists.tolist(), self.sizes.tolist(), strict=True))
        q_slices = max(1, math.ceil(n_q / max(SLICE_QUERIES, min(MOST_SLICE_QUERIES, n_q // (4 * cores)))))
        group_of = groups_of({i: size[i] for i in used}, GROUP_ROWS)
        plan = self.spark.createDataFrame([(i, at, n) for i, (at, n) in group_of.items()], "list int, at int, slices int")
        n_groups = max((at + n for at, n in group_of.values()), default=1)
        only = F.col("list").isin(used) if len(used) < len(size) else F.lit(True)  # a filter on folders
        codes = self.spark.read.schema("row long, code binary, list int").parquet(f"{self.path}/codes").where(only)
        # a query travels once to each group of lists and finds there which of them it opens
        left = asked.select(
            F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))).alias("grp"), F.pmod(F.xxhash64("q"), F.lit(q_slices)).cast("int").alias("qs"),
            "q", "query_id", "vector")
        right = codes.join(F.broadcast(plan), "list").select(
            (F.col("at") + F.pmod(F.xxhash64("row"), F.col("slices"))).cast("int").alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(q_slices - 1))).alias("qs"),
            "list", "row", "code")
        keys = ["grp", "qs"]
        most = max(k, rerank * k)
        # few bytes and much work: small partitions are not to be merged
        left, right = (x.repartition(2 * q_slices * n_groups, *keys) for x in (left, right))
        # a row for each query with the best of a group
        ranked = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
            self._cell(most, n_probe or self.n_probe), f"{_CHOSEN}, about array<float>")
        if n_groups > 1:
            each = F.flatten(F.collect_list(F.arrays_zip("about", "row")))
            ranked = ranked.groupBy("q").agg(
                F.first("query_id").alias("query_id"), F.first("vector").alias("vector"), F.slice(F.array_sort(each), 1, most)["row"].alias("row"))
        # the chosen rows meet their vectors in blocks of both, as lists of row numbers
        blocks = max(1, math.ceil(sum(size[i] for i in used) / BLOCK_VECTORS))
        x_slices = max(1, math.ceil(n_q / max(SLICE_QUERIES, min(MOST_CHOSEN // most, n_q // (2 * cores)))))
        wanted = ranked.select("q", "query_id", "vector", "row").mapInArrow(_by_block(blocks), f"{_CHOSEN}, blk int").withColumn(
            "xs", F.pmod(F.xxhash64("q"), F.lit(x_slices)).cast("int"))
        vectors = self.spark.read.schema("row long, id string, vector array<float>, list int").parquet(f"{self.path}/vectors").where(only).select(
            F.pmod("row", F.lit(blocks)).cast("int").alias("blk"), F.explode(F.sequence(F.lit(0), F.lit(x_slices - 1))).alias("xs"), "row", "id", "vector")
        keys = ["blk", "xs"]
        wanted, vectors = (x.repartition(2 * x_slices * blocks, *keys) for x in (wanted, vectors))
        final = Window.partitionBy("q").orderBy("distance", "id")
        return wanted.groupBy(*keys).cogroup(vectors.groupBy(*keys)).applyInArrow(
            lambda asked, there: _exact(asked, there, k), "q long, query_id string, id string, distance double").withColumn(
            "rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "id", "distance", "rank")

    def _cell(self, most: int, n_probe: int):
        shared = self.spark.sparkContext.broadcast((dict(zip(self.lists.tolist(), self.centres, strict=True)), self.books))
        parts, opened = self.parts, self._opener(n_probe)

        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return _chosen(left.slice(0, 0), np.zeros(1, np.int32), np.zeros(0, np.int64), about=np.zeros(0, np.float32))
            centres, books = shared.value
            cuts = _cuts(len(books), parts)
            codes = np.frombuffer(b"".join(right.column("code").to_pylist()), np.uint8).reshape(-1, parts)
            lists, row = right.column("list").to_numpy(), right.column("row").to_numpy()
            order = np.lexsort((row, lists))
            codes, lists, row = codes[order], lists[order], row[order]
            x = matrix(left.column("vector"))
            here, starts = np.unique(lists, return_index=True)
            near, best = opened(x), _Best(len(x), most, len(row))
            want = np.zeros((len(x), len(here)), bool)
            for at in range(0, len(x), _SLICE):
                part = near[at:at + _SLICE]
                place = np.minimum(np.searchsorted(here, part), len(here) - 1)
                r, c = np.nonzero(here[place] == part)
                want[at + r, place[r, c]] = True
            for i, (of_list, lo_row, hi_row) in enumerate(zip(here.tolist(), starts.tolist(), [*starts[1:].tolist(), len(row)], strict=True)):
                asked = np.flatnonzero(want[:, i])
                for lo in range(lo_row, hi_row if len(asked) else lo_row, _ROOM):
                    some_codes = codes[lo:min(lo + _ROOM, hi_row)]
                    there = np.hstack([books[a:b].T[some_codes[:, s]] for s, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))])
                    step = max(1, _CELLS // len(there))
                    for at in range(0, len(asked), step):
                        some = asked[at:at + step]
                        best.add(some, lo, _apart(x[some] - centres[of_list], there))
            n, place, value = best.found()
            return _chosen(left, np.concatenate([[0], np.cumsum(n)]), row[place], about=value)

        return run


_CHOSEN = "q long, query_id string, vector array<float>, row array<long>"


def _chosen(asked: pa.Table, ends: np.ndarray, row: np.ndarray, **more: np.ndarray) -> pa.Table:
    """The queries with their lists of rows; ``ends`` are the ends of the lists behind a 0."""
    lists = {name: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v)) for name, v in {"row": row, **more}.items()}
    return pa.table({c: asked.column(c) for c in ("q", "query_id", "vector")} | lists)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances in single precision by one matrix product; what it cannot hold is very far."""
    if np.abs(x).max(initial=0.0) < _HOLDS and np.abs(y).max(initial=0.0) < _HOLDS:  # also false for nan
        one = lambda v: np.ones((len(v), 1))
        a = np.hstack([-2.0 * x, one(x), (x * x).sum(axis=1)[:, None]]).astype(np.float32)
        return a @ np.hstack([y, (y * y).sum(axis=1)[:, None], one(y)]).astype(np.float32).T
    with np.errstate(all="ignore"):
        return np.nan_to_num(_squared(x, y).astype(np.float32), nan=_LAST, posinf=_LAST)


class _Best:
    """The ``most`` nearest places of each query, in lists of a bounded length that are cut to the best now and then."""

    def __init__(self, n: int, most: int, rows: int):
        self.most = most
        # distance (its bits order as a number does) above the place, so ties go to the earlier place
        self.keys = np.full((n, min(rows, 2 * most + _ROOM)), _NONE, np.uint64)
        self.n, self.limit = np.zeros(n, np.int64), np.full(n, np.inf, np.float32)

    def add(self, at: np.ndarray, first: int, about: np.ndarray) -> None:
        """Distances of the queries ``at`` to the places from ``first`` on: at most _ROOM places, later than all before."""
        found = np.flatnonzero(about < self.limit[at, None])
        if not len(found):
            return
        r, c = np.divmod(found, about.shape[1])
        bits = np.maximum(about.ravel()[found], np.float32(0)).view(np.uint32).astype(np.uint64)
        behind = np.arange(len(r)) - np.searchsorted(r, np.arange(len(at)), side="left")[r]
        self.keys[at[r], self.n[at[r]] + behind] = (bits << np.uint64(32)) | (c + first).astype(np.uint64)
        self.n[at] += np.bincount(r, minlength=len(at))
        self._cut(at[self.n[at] >= 2 * self.most])

    def _cut(self, at: np.ndarray) -> None:
        for lo in range(0, len(at), _SLICE):
            some = at[lo:lo + _SLICE]
            kept = np.partition(self.keys[some, :self.n[some].max()], self.most - 1, axis=1)[:, :self.most]
            self.keys[some] = _NONE
            self.keys[some, :self.most] = kept
            self.n[some] = self.most
            self.limit[some] = (kept.max(axis=1) >> np.uint64(32)).astype(np.uint32).view(np.float32)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(how many of each query, places, distances)."""
        self._cut(np.flatnonzero(self.n > self.most))
        keys = self.keys[self.keys != _NONE]
        return self.n, (keys & np.uint64(0xffffffff)).astype(np.int64), (keys >> np.uint64(32)).astype(np.uint32).view(np.float32)


def _by_block(blocks: int):
    """The chosen rows of each query by the block their vectors lie in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("row")
            row, q = lists.flatten().to_numpy(), np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
            blk = row % blocks
            order = np.lexsort((q, blk))
            row, q, blk = row[order], q[order], blk[order]
            first = np.flatnonzero(np.diff(q, prepend=-1) | np.diff(blk, prepend=-1))
            part = _chosen(pa.Table.from_batches([b]).take(pa.array(q[first])), np.append(first, len(row)), row)
            yield from part.append_column("blk", pa.array(blk[first].astype(np.int32))).combine_chunks().to_batches()

    return run


def _asked(queries: DataFrame, query_key: str = "query_id", vector: str = "embedding") -> DataFrame:
    key = F.col(query_key) if query_key in queries.columns else F.lit("")
    return queries.where(F.col(vector).isNotNull() & key.isNotNull()).select(
        F.monotonically_increasing_id().alias("q"), key.cast("string").alias("query_id"), F.col(vector).cast("array<float>").alias("vector"))


def _exact(asked: pa.Table, there: pa.Table, k: int) -> pa.Table:
    """The ``k`` nearest of the chosen rows of each query that lie in this block."""
    names = ["q", "query_id", "id", "distance"]
    found = [pa.table([pa.array([], pa.int64()), pa.array([], pa.string()), pa.array([], pa.string()), pa.array([], pa.float64())], names=names)]
    if asked.num_rows and there.num_rows:
        there = there.take(pa.array(np.argsort(there.column("row").to_numpy())))
        rows, docs, ids = there.column("row").to_numpy(), matrix(there.column("vector")), np.array(there.column("id").to_pylist(), dtype=object)
        alike = np.unique(ids, return_inverse=True)[1]  # ids in their order
        own = (docs * docs).sum(axis=1)
        for at in range(0, asked.num_rows, _SLICE):
            part = asked.slice(at, _SLICE).combine_chunks()
            lists, x = part.column("row").combine_chunks(), matrix(part.column("vector"))
            q, p = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy())), np.searchsorted(rows, lists.flatten().to_numpy())
            # the same rounding as the full search
            d = (x * x).sum(axis=1)[q] + own[p] - 2.0 * np.einsum("ij,ij->i", x[q], docs[p])
            d = np.round(np.maximum(d, 0.0), DIGITS)
            order = np.lexsort((alike[p], d, q))
            q, p, d = q[order], p[order], d[order]
            keep = np.arange(len(q)) - np.searchsorted(q, q, side="left") < k
            q, p, d = q[keep], p[keep], d[keep]
            found.append(pa.table([part.column("q").take(pa.array(q)), part.column("query_id").take(pa.array(q)), pa.array(ids[p], pa.string()), pa.array(d)], names=names))
    return pa.concat_tables(found)


def scratch_index(docs: DataFrame, **options) -> Index:
    """An index in the scratch area, for jobs that need it once."""
    return build_index(docs, scratch_path(docs.sparkSession, "index"), **options)
