"""Helpers of the operators: Arrow batches of bounded size, and connected components."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import reliable_checkpoint, scratch_path

#: Text bytes in one Arrow batch; one longer text makes a batch of its own.
BATCH_BYTES = 4 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bounded_batches(spark: SparkSession, rows: int = 4096) -> None:
    """Limit what one Arrow batch of this session may hold."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def release() -> None:
    """Give freed memory of a Python worker back, which otherwise stays with it for the tasks of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_memories: dict[str, dict] = {}


def memory(name: str) -> dict:
    """What this Python worker remembers from task to task under a name."""
    return _memories.setdefault(name, {})


def forget(but: str | None = None) -> None:
    """Drop what this Python worker remembers for other steps than ``but``; a session's workers serve one step after another."""
    old = [m for name, m in _memories.items() if name != but and m]
    for m in old:
        m.clear()
    if old:
        release()


def freed(rows, keeps: str | None = None):
    """``rows`` (batches to batches) that gives memory back when a task's batches are done, and before that what other steps left.

    ``keeps`` names the ``memory`` that ``rows`` uses itself.
    """

    def run(batches):
        forget(keeps)
        yield from rows(batches)
        release()

    return run


def private(columns: list[str], *names: str) -> list[str]:
    """The names, each lengthened until no column is called so (Spark does not tell cases apart)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``(v, root)`` for every vertex of the undirected ``links (a, b)``; root = smallest vertex.

    Large-star / small-star contraction: each round hangs the neighbours of a vertex under the
    smallest of them, with one shuffle per star and a min that combines on the map side, until the
    edges are stars. The number of rounds grows with the logarithm of the longest path. Self links
    and repeated links are allowed; an empty input gives no rows.
    """
    edges = reliable_checkpoint(
        links.where("a != b and a is not null and b is not null")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    for _ in range(rounds):
        # large star: larger neighbours of a vertex go under its smallest neighbour (or itself)
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"))
        low = low.select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # small star: smaller neighbours and the vertex itself go under the smallest one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = reliable_checkpoint(
            small.union(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()
        )
        # stars: no vertex has two parents, and no parent has one
        sides = edges.select(F.col("a").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            edges.select("b", F.lit(0), F.lit(1)))
        if sides.groupBy("v").agg((F.sum("up") + F.max("down")).alias("roles")).where("roles > 1").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("v")).distinct().select("v", F.col("v").alias("root"))
    return edges.select(F.col("a").alias("v"), F.col("b").alias("root")).union(roots)
