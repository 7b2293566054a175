"""Consecutive row numbers over a whole DataFrame without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..session import reliable_checkpoint

_LOCAL_BITS = 33  # monotonically_increasing_id: partition above, position in partition below


def with_row_ids(df: DataFrame, order: list, start: int = 0, name: str = "id") -> DataFrame:
    """Add ``name`` = start + 1, start + 2, ... in the given order; ties in any order.

    Rows are range-partitioned and sorted; the offset of a partition is the number of rows before
    it, from one count per partition. The first checkpoint fixes a tie number per row, so that a
    large group of equal rows can be split between partitions; the second fixes where each row lies.
    """
    tagged = reliable_checkpoint(df.withColumn("_tie", F.monotonically_increasing_id()))
    placed = reliable_checkpoint(
        tagged.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie")
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    part = F.shiftright("_mid", _LOCAL_BITS)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # one row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    position = F.col("_mid").bitwiseAND((1 << _LOCAL_BITS) - 1)
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.lit(start + 1) + F.col("_off") + position)
        .drop("_part", "_off", "_mid", "_tie")
    )
