"""Nearest neighbours by clusters with an exact second pass, for large collections.

The collection is assigned to k-means centroids. Each query first looks into its nearest cluster;
the distance of its k-th hit then bounds the clusters that can still hold a better one
(``d(q, centroid) - radius``), and only those are searched. The answer equals the full search.

Clusters lie together in groups, and a query travels once to each group in which it opens a cluster: with vectors that have no
clusters this costs what the block grid of ``nearest`` costs, not a row for each query and cluster.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from ..session import reliable_checkpoint
from .nearest import (
    DIGITS, OUT, _as_pairs, _batch, _best, answers, block_of, block_rows_for, matrix, numbered, top_k, unnumbered,
)

MAX_CENTROIDS = 2048
_SLICE, _GROUPS = 1024, 64  # queries and groups looked at together


def _squared(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = (q * q).sum(axis=1)[:, None] + (c * c).sum(axis=1)[None, :] - 2.0 * (q @ c.T)
    return np.maximum(d, 0.0)


def centroids_of(points: DataFrame, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    """At most ``k`` k-means centroids of ``points (vector)``, different from one another."""
    k = min(k, points.limit(k).count())
    if k <= 1:
        rows = points.limit(1).collect()
        return np.array([r.vector for r in rows], float)
    model = KMeans(k=k, seed=seed, maxIter=rounds, initSteps=1).fit(points.select(array_to_vector("vector").alias("features")))
    return np.vstack(model.clusterCenters())


def _assign(df: DataFrame, centroids) -> DataFrame:
    """Nearest centroid of each row and the distance to it."""
    def run(batches):
        c = centroids.value
        for b in batches:
            if not b.num_rows:
                continue
            d = _squared(matrix(b.column("vector")), c)
            best = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("vector"), pa.array(best.astype(np.int32)),
                 pa.array(np.sqrt(d[np.arange(len(best)), best]))],
                names=["id", "vector", "cluster", "to_centroid"],
            )

    return df.mapInArrow(run, "id string, vector array<float>, cluster int, to_centroid double")


def groups_of(sizes: dict[int, int], rows: int) -> dict[int, tuple[int, int]]:
    """``cluster -> (first group, slices)``: neighbouring clusters share a group of about ``rows`` rows, a larger one is cut into several."""
    plan, group, filled = {}, 0, 0
    for cluster, n in sorted(sizes.items()):
        if filled and filled + n > rows:
            group, filled = group + 1, 0
        plan[cluster] = (group, max(1, math.ceil(n / rows)))
        group, filled = (group + plan[cluster][1], 0) if n > rows else (group, filled + n)
    return plan


def _search_cell(key, left: pa.Table, right: pa.Table, k: int, centroids, radii) -> pa.Table:
    """Best ``k`` of a block of queries in the clusters of a group: those of the own cluster, or of all others that a query opens.

    ``kth`` is null in the first pass and infinite or a bound in the second.
    """
    found: list[pa.RecordBatch] = [_batch(np.empty(0, object), np.empty(0, object), np.empty(0))]
    if left.num_rows and right.num_rows:
        ids, q = np.array(left.column("id").to_pylist(), dtype=object), matrix(left.column("vector"))
        own, kth = (left.column(c).to_numpy() for c in ("cluster", "kth"))
        second = left.column("kth").null_count == 0
        right = right.take(pa.array(np.argsort(np.array(right.column("id").to_pylist(), dtype=object), kind="stable")))
        doc_ids, docs, cluster = np.array(right.column("id").to_pylist(), dtype=object), matrix(right.column("vector")), right.column("cluster").to_numpy()
        here, n = np.unique(cluster, return_counts=True)
        if second:
            want = _opened(q, kth, own, centroids.value[here], radii.value[here], here)
            # a query that opens most of the group looks at all of it; none of its rows was seen in the first pass
            whole = np.flatnonzero((2 * (want @ n) >= len(docs)) & ~np.isin(own, here))
            want[whole] = False
            for r, i, d in answers(q[whole], docs, doc_ids, k):
                found.append(_batch(ids[whole[r]], i, d))
        else:
            want = own[:, None] == here[None, :]
        best = None  # the best k of the clusters so far
        for at, c in enumerate(here):
            asked, mine = np.flatnonzero(want[:, at]), cluster == c
            r, i, d = top_k(q[asked], docs[mine], doc_ids[mine], k)
            if not second:  # the only cluster of these queries
                found.append(_batch(ids[asked[r]], i, d))
                continue
            if best is not None:
                r, i, d = (np.concatenate(x) for x in zip(best, (asked[r], i, d), strict=True))
                order = np.lexsort((i, d, r))
                r, i, d = r[order], i[order], d[order]
                keep = np.arange(len(r)) - np.searchsorted(r, r, side="left") < k
                best = r[keep], i[keep], d[keep]
            else:
                best = asked[r], i, d
        if best is not None:
            found.append(_batch(ids[best[0]], best[1], best[2]))
    return pa.Table.from_batches(found)


def _opened(q: np.ndarray, kth: np.ndarray, own: np.ndarray, centres: np.ndarray, radius: np.ndarray, clusters: np.ndarray) -> np.ndarray:
    """Which of the clusters can hold a row that is as near as the k-th one found in the own cluster."""
    want = np.empty((len(q), len(clusters)), bool)
    # half a unit of rounding: a tie at the k-th place must still be seen
    limit = np.where(np.isnan(kth), np.inf, np.sqrt(kth + 10.0 ** -DIGITS) + 1e-9)
    for at in range(0, len(q), _SLICE):
        part = slice(at, at + _SLICE)
        want[part] = np.sqrt(_squared(q[part], centres)) - radius[None, :] <= limit[part, None]
    return want & (own[:, None] != clusters[None, :]) & np.isfinite(radius)[None, :]


def nearest_pruned(
    queries: DataFrame, docs: DataFrame, k: int, *, query_key: str = "query_id",
    doc_key: str = "id", vector: str = "embedding", n_clusters: int | None = None,
    block_rows: int | None = None, seed: int = 7,
) -> DataFrame:
    """Same rows as ``nearest``: ``query_id, id, distance, rank``."""
    q = reliable_checkpoint(numbered(_as_pairs(queries, query_key, vector)))
    d = _as_pairs(docs, doc_key, vector)
    if n_clusters is None:
        n_clusters = min(MAX_CENTROIDS, max(1, int(math.sqrt(d.count()))))
    sc = d.sparkSession.sparkContext
    centers = centroids_of(d.select("vector"), n_clusters, seed, rounds=5)
    centroids = sc.broadcast(centers)

    docs_c = reliable_checkpoint(_assign(d, centroids))
    stats = docs_c.groupBy("cluster").agg(
        F.count("*").alias("n_d"), F.max("to_centroid").alias("radius")
    ).collect()  # at most MAX_CENTROIDS rows
    radius = np.full(len(centers), -np.inf)
    for row in stats:
        radius[row.cluster] = row.radius
    radii = sc.broadcast(radius)
    queries_c = reliable_checkpoint(_assign(q, centroids).drop("to_centroid"))
    asked = {r.cluster: r["count"] for r in queries_c.groupBy("cluster").count().collect()}  # at most MAX_CENTROIDS rows
    n_q, n_d = sum(asked.values()), sum(r.n_d for r in stats)
    rows = block_rows or block_rows_for(n_q, n_d, k, sc.defaultParallelism)
    group_of = groups_of({r.cluster: r.n_d for r in stats}, rows)
    # queries of the first pass by group
    load: dict[int, int] = {}
    for c, (g, _) in group_of.items():
        load[g] = load.get(g, 0) + asked.get(c, 0)
    plan = F.broadcast(d.sparkSession.createDataFrame(
        [(c, g, s, max(1, math.ceil(load[g] / rows))) for c, (g, s) in group_of.items()], "cluster int, at int, slices int, q_blocks int"))

    def cells(left: DataFrame, right: DataFrame) -> DataFrame:
        keys = ["grp", "qb"]
        both = left.groupBy(*keys).cogroup(right.select("id", "vector", "cluster", *keys).groupBy(*keys))
        return both.applyInArrow(lambda key, a, b: _search_cell(key, a, b, k, centroids, radii), OUT)

    def over_blocks(blocks) -> DataFrame:
        """Documents with their group, once for each block of queries."""
        return docs_c.join(plan, "cluster").select(
            "id", "vector", "cluster", (F.col("at") + block_of(F.col("slices"))).cast("int").alias("grp"),
            F.explode(F.sequence(F.lit(0), blocks - 1)).alias("qb"))

    own = queries_c.join(plan, "cluster").select(
        "id", "vector", "cluster", F.lit(None).cast("double").alias("kth"),
        F.explode(F.sequence(F.col("at"), F.col("at") + F.col("slices") - 1)).alias("grp"), block_of(F.col("q_blocks")).cast("int").alias("qb"))
    first = reliable_checkpoint(_best(cells(own, over_blocks(F.col("q_blocks"))), k).drop("rank"))
    bound = first.groupBy("query_id").agg(
        F.count("*").alias("n"), F.max("distance").alias("kth")
    )
    q_blocks = max(1, math.ceil(n_q / rows))
    bounded = queries_c.join(bound, queries_c["id"] == bound["query_id"], "left").select(
        "id", "vector", "cluster",
        F.when(F.col("n") >= k, F.col("kth")).otherwise(F.lit(float("inf"))).alias("kth"),  # infinite: fewer than k so far
        block_of(q_blocks).cast("int").alias("qb"),
    )
    # at most MAX_CENTROIDS clusters; a group is opened with the first of its clusters
    known = np.array(sorted(group_of), np.int32)
    n_groups = max((g + s for g, s in group_of.values()), default=0)
    holds = np.zeros((len(known), n_groups), np.float32)
    for i, c in enumerate(known):
        g, s = group_of[int(c)]
        holds[i, g:g + s] = 1.0

    def open_groups(batches):
        for b in batches:
            for at in range(0, b.num_rows, _SLICE):
                part = b.slice(at, _SLICE)
                own_cluster, kth = (part.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "kth"))
                want = _opened(matrix(part.column("vector")), kth, own_cluster, centroids.value[known], radii.value[known], known)
                # in slices of groups as well, so that a batch stays small
                for lo in range(0, n_groups, _GROUPS):
                    r, g = np.nonzero(want.astype(np.float32) @ holds[:, lo:lo + _GROUPS] > 0)
                    out = part.take(pa.array(r))
                    yield out.append_column("grp", pa.array((g + lo).astype(np.int32)))

    more = bounded.mapInArrow(open_groups, "id string, vector array<float>, cluster int, kth double, qb int, grp int")
    second = cells(more, over_blocks(F.lit(q_blocks)))
    return unnumbered(_best(first.unionByName(second), k))
