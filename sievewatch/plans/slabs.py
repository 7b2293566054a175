"""Per-key time windows that survive a key which holds a large share of all rows.

Time is cut into slabs and the window functions run per (key, slab) instead of per key. What a
row needs from outside its slab is copied in, so the results equal the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def epoch_seconds(ts: Column | str) -> Column:
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_timestamp(c.cast("timestamp"))


def range_sums(
    per_second: DataFrame, keys: list[str], sums: dict[str, str], before: int, after: int = 0,
    first: str | None = None, second: str = "second", min_slab: int = 3600,
) -> DataFrame:
    """Sums over ``[second - before, second + after]`` of the same key.

    ``per_second`` has one row per key and second (aggregate first: that also merges copies), so a
    slab holds a bounded number of rows. ``sums`` maps a new column to the column it adds up;
    ``first`` (only without ``after``) names a column for the earliest second in the window.

    A row enters the running sum at ``second - after`` and leaves it at ``second + before + 1``, so
    the cost does not grow with the window length. It is copied to the neighbour slabs whose windows
    reach it.
    """
    size = max(min_slab, 8 * max(before, after))
    own = F.floor(F.col(second) / size)
    spread = F.array_compact(F.array(
        own,
        F.when(F.floor((F.col(second) + before) / size) > own, own + 1),
        F.when(F.floor((F.col(second) - after) / size) < own, own - 1),
    ))
    slabs = per_second.withColumn("_own", own).withColumn("_slab", F.explode(spread))
    group = Window.partitionBy(*keys, "_slab")
    none = F.lit(None).cast("bigint")
    leaves_to = none
    if first:
        slabs = slabs.withColumn("_next", F.lead(second).over(group.orderBy(second)))
        leaves_to = F.col("_next")

    def event(shift: int, sign: int, asks: bool, gone=none):
        return F.struct(
            (F.col(second) + shift).alias("_t"), F.lit(asks).alias("_asks"), gone.alias("_gone"),
            *[(F.col(c) * sign).alias(f"_d_{name}") for name, c in sums.items()],
        )

    events = [event(-after, 1, after == 0), event(before + 1, -1, False, leaves_to)]
    if after:
        events.append(event(0, 0, True))
    rows = slabs.withColumn("_e", F.explode(F.array(*events))).select("*", "_e.*")
    run = group.orderBy("_t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    out = {name: F.sum(f"_d_{name}").over(run) for name in sums}
    if first:
        # the row after the last one that left, else the first row of the slab
        out[first] = F.coalesce(F.max("_gone").over(run), F.min(second).over(run))
    return rows.withColumns(out).where("_asks AND _own = _slab").select(*per_second.columns, *out)


def previous_value(
    rows: DataFrame, keys: list[str], order: list[str], value: str, ts: str,
    name: str = "previous", slab_seconds: int = 3600,
) -> DataFrame:
    """Add ``name``: the value of the preceding row of the key, null for its first row.

    Each slab gets one extra row with the last value of the key's preceding non-empty slab; the
    last values come from an aggregate with map-side combine.
    """
    slab = F.floor(epoch_seconds(ts) / slab_seconds)
    rows = rows.withColumn("_slab", slab)
    last = rows.groupBy(*keys, "_slab").agg(
        F.max(F.struct(*order, value)).getField(value).alias("_last")
    )
    per_key = Window.partitionBy(*keys).orderBy("_slab")
    carry = (
        last.withColumn("_carry", F.lag(F.struct("_last")).over(per_key))
        .where("_carry IS NOT NULL")
        .select(*keys, "_slab", F.col("_carry._last").alias(value), F.lit(0).alias("_own"))
    )
    both = rows.withColumn("_own", F.lit(1)).unionByName(carry, allowMissingColumns=True)
    w = Window.partitionBy(*keys, "_slab").orderBy("_own", *order)
    return both.withColumn(name, F.lag(value).over(w)).where("_own = 1").drop("_own", "_slab")


def gaps(rows: DataFrame, keys: list[str], ts: str, longer_than: int) -> DataFrame:
    """Gaps of more than ``longer_than`` seconds between neighbouring events of a key.

    A slab is as long as the threshold, so no such gap lies inside one; the first and last time
    per (key, slab) decide, and these come from an aggregate with map-side combine.
    """
    second = epoch_seconds(ts)
    per_slab = rows.groupBy(*keys, F.floor(second / longer_than).alias("_slab")).agg(
        F.min(second).alias("_first"), F.max(second).alias("_last")
    )
    w = Window.partitionBy(*keys).orderBy("_slab")
    return (
        per_slab.withColumn("last_seen", F.lag("_last").over(w))
        .withColumn("gap_seconds", F.col("_first") - F.col("last_seen"))
        .where(F.col("gap_seconds") > longer_than)
        .select(*keys, "last_seen", F.col("_first").alias("next_seen"), "gap_seconds")
    )
