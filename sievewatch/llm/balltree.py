"""Exact inner-product search: a ball tree per shard, branch and bound, shared kth scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded_batches, stored

LEAF = 128
SHARD_ROWS, QUERY_ROWS = 16_384, 16_384  # vectors of one shard, queries of one block
LEAST_SHARDS = 12
_NONE = np.iinfo(np.int64).min
_EXACT = float(1 << 53)


class Ball:
    """A node: centre, radius, and either two children or the rows of a leaf."""

    def __init__(self, points: np.ndarray, rows: np.ndarray):
        own = points[rows]
        self.centre = own.mean(axis=0)
        away = np.linalg.norm(own - self.centre, axis=1)
        self.radius = float(away.max())
        self.rows, self.children = rows, ()
        if len(rows) > LEAF and self.radius > 0:
            # split halfway along the line between two far points
            a = own[away.argmax()]
            b = own[np.linalg.norm(own - a, axis=1).argmax()]
            along = own @ (b - a)
            order = np.argsort(along, kind="stable")
            half = len(rows) // 2
            self.children = (Ball(points, rows[order[:half]]), Ball(points, rows[order[half:]]))


class Search:
    """The best ``k`` of one shard for a block of queries; starts from kth scores found elsewhere."""

    def __init__(self, points, ids, keys, queries, own, floor, k: int):
        big = max((float(np.abs(x).max()) for x in (points, queries) if x.size), default=0.0)
        exact = big * big * max(1, points.shape[1]) < _EXACT
        # whole numbers are exact in doubles up to 2**53, beyond that in 64-bit integers
        self.points, self.queries = (points.astype(float), queries.astype(float)) if exact else (points, queries)
        self.ids, self.keys, self.own, self.floor, self.k = ids, keys, own, floor, k
        self.norm = np.linalg.norm(queries.astype(float), axis=1)
        self.flat = queries.astype(float)
        n = len(queries)
        self.score = np.full((n, k), _NONE, np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max, np.int64)
        self.key = np.full((n, k), -1, np.int64)
        if len(points):
            tree = Ball(points.astype(float), np.arange(len(points)))
            everyone = np.arange(n)
            self.visit(tree, everyone, self.bound(tree, everyone))

    def bound(self, node: Ball, active: np.ndarray) -> np.ndarray:
        top = self.flat[active] @ node.centre + self.norm[active] * node.radius
        return top + 1e-9 * (np.abs(top) + self.norm[active] * (np.linalg.norm(node.centre) + node.radius)) + 1e-6

    def visit(self, node: Ball, active: np.ndarray, bound: np.ndarray) -> None:
        keep = bound >= np.maximum(self.floor[active], self.score[active, -1])
        active, bound = active[keep], bound[keep]
        if not len(active):
            return
        if node.children:
            bounds = [self.bound(c, active) for c in node.children]
            first = int(bounds[1].sum() > bounds[0].sum())  # the higher bound first
            for i in (first, 1 - first):
                self.visit(node.children[i], active, bounds[i])
            return
        for at in range(0, len(node.rows), LEAF):  # equal vectors make a leaf of any size
            self.scan(node.rows[at : at + LEAF], active)

    def scan(self, rows: np.ndarray, active: np.ndarray) -> None:
        got = (self.queries[active] @ self.points[rows].T).astype(np.int64)
        got[self.own[active][:, None] == self.keys[rows][None, :]] = _NONE
        better = got.max(axis=1) >= np.maximum(self.floor[active], self.score[active, -1])
        active, got = active[better], got[better]
        if not len(active):
            return
        shape = got.shape
        score = np.concatenate([self.score[active], got], axis=1)
        ids = np.concatenate([self.id[active], np.broadcast_to(self.ids[rows], shape)], axis=1)
        keys = np.concatenate([self.key[active], np.broadcast_to(self.keys[rows], shape)], axis=1)
        order = np.lexsort((keys, ids, ~score), axis=-1)[:, : self.k]
        for name, x in (("score", score), ("id", ids), ("key", keys)):
            getattr(self, name)[active] = np.take_along_axis(x, order, 1)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return np.asarray(flat.flatten(), np.int64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1), np.int64)


def _cell(k: int):
    def run(queries: pa.Table, shard: pa.Table) -> pa.Table:
        if not len(queries) or not len(shard):
            return pa.table({c: pa.array([], pa.int64()) for c in ("q_key", "query_id", "key", "vec_id", "score")})
        q_key, q_id = (np.asarray(queries[c], np.int64) for c in ("key", "id"))
        floor = np.asarray(queries["floor"], np.int64)
        s = Search(
            _matrix(shard["vector"]), np.asarray(shard["id"], np.int64), np.asarray(shard["key"], np.int64),
            _matrix(queries["vector"]), q_key, floor, k)
        at, place = np.nonzero(s.score > _NONE)
        good = s.score[at, place] >= floor[at]
        at, place = at[good], place[good]
        return pa.table({
            "q_key": q_key[at], "query_id": q_id[at], "key": s.key[at, place], "vec_id": s.id[at, place],
            "score": s.score[at, place]})

    return run


_HIT = "q_key long, query_id long, key long, vec_id long, score long"


def top_k(
    vectors: DataFrame, is_query, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding",
    least_shards: int = LEAST_SHARDS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query row its ``k`` best other rows.

    Components become ``floor(scale * x)``; the score is their integer inner product (64 bits, which
    wrap beyond that); ties go to the smaller id, then to the earlier row. Vectors that are null, hold a null or
    a non-finite component, or have a null id take no part, nor does an empty one. Vectors of another
    length are not candidates of a query. Rows that repeat an id are rows of their own: only the
    query's own row is left out. Other columns are not read. An empty table gives no rows.

    Vectors lie in shards by hash, queries in blocks; a cell is one shard and one block. The first
    round searches one shard for each block; its kth scores bound the search of the second round in
    all other shards.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    good = ~F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull() & (F.size(vector_col) > 0)).where(good)
    rows = stored(rows.select(
        F.col(id_col).cast("long").alias("id"), is_query.alias("is_query"),
        F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("vector"),
        F.monotonically_increasing_id().alias("key")), "vectors")
    sizes = rows.agg(F.count("*").alias("n"), F.sum(F.col("is_query").cast("int")).alias("q")).first()
    shards = max(least_shards, -(-sizes.n // SHARD_ROWS))
    blocks = max(1, -(-(sizes.q or 0) // QUERY_ROWS))
    rows = rows.withColumn("d", F.size("vector")).withColumn("s", F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int"))
    asked = rows.where("is_query").withColumn("b", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(blocks)).cast("int"))
    asked = asked.select("id", "key", "vector", "d", "b")
    home = F.pmod(F.col("b"), F.lit(shards))

    def cells(queries: DataFrame, candidates: DataFrame) -> DataFrame:
        # the query side alone decides which cells there are; its vectors come with their floor
        a = queries.select(*[F.col(x).alias(x) for x in ("d", "s", "b", "id", "key", "vector", "floor")])
        c = candidates.select(*[F.col(x).alias(x) for x in ("d", "s", "b", "id", "key", "vector")])
        return a.groupBy("d", "s", "b").cogroup(c.groupBy("d", "s", "b")).applyInArrow(_cell(k), _HIT)

    spread = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    first = cells(
        asked.withColumn("s", home).withColumn("floor", F.lit(_NONE)), spread.where(F.col("s") == home))
    first = stored(first, "firsthits")
    floors = first.groupBy("q_key").agg(F.min("score").alias("low"), F.count("*").alias("found"))
    floors = floors.where(F.col("found") >= k).select(F.col("q_key").alias("key"), "low")
    known = asked.join(floors, "key", "left").withColumn("floor", F.coalesce("low", F.lit(_NONE)))
    others = known.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).where(F.col("s") != home)
    rest = cells(others, spread.where(F.col("s") != home))
    order = Window.partitionBy("q_key").orderBy(F.desc("score"), "vec_id", "key")
    return (
        first.unionByName(rest).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score"))
