"""Shards of even size with few cut links: balanced label propagation, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.row_ids import with_row_ids
from ..session import reliable_checkpoint
from .common import stored

ROUNDS = 4  # at most
#: Nodes, or groups, of more than this share of all links or rows are met by a broadcast: there are at most so many.
HOT_NODES = 10_000
_GRAIN = 1 << 20


def _quotas(flows: list, sizes: dict[int, int], room: float, shards: int) -> dict[tuple[int, int], float]:
    """Share of the wish ``from -> to`` that may move: what comes back, and what the target has free."""
    wish = {(r.old, r.new): r.n for r in flows}
    free = {s: max(0.0, room - sizes.get(s, 0)) for s in range(shards)}
    extra = {k: max(0, n - wish.get((k[1], k[0]), 0)) for k, n in wish.items()}
    into: dict[int, int] = {}
    for (_, new), n in extra.items():
        into[new] = into.get(new, 0) + n
    return {
        k: (min(n, wish.get((k[1], k[0]), 0)) + (extra[k] * min(1.0, free[k[1]] / into[k[1]]) if into[k[1]] else 0)) / n
        for k, n in wish.items()
    }


def _neighbours(both: DataFrame, labels: DataFrame, hot: DataFrame) -> DataFrame:
    """``a, shard`` for each link ``(a, b)`` with the shard of ``b``; the nodes of ``hot`` meet their links by a broadcast, the others by hash."""
    known = F.broadcast(labels.join(F.broadcast(hot), labels["v"] == F.col("_hot")).select("_hot", F.col("shard").alias("_there")))
    met = both.join(known, both["b"] == F.col("_hot"), "left")
    rest = met.where("_hot is null").select("a", "b").join(labels, F.col("b") == labels["v"])
    return met.where("_hot is not null").select("a", F.col("_there").alias("shard")).unionByName(rest.select("a", "shard"))


def propagate(links: DataFrame, shards: int, room: int, rounds: int = ROUNDS) -> DataFrame:
    """``v, shard`` of all linked nodes after rounds in which they move to where most of their neighbours are.

    Undirected ``links (a, b)``; at first nodes lie where their hash puts them. In even rounds a node looks at those neighbours alone that
    have more links than itself (ties: the smaller id), so that no two linked nodes change places for ever; in odd rounds half of the nodes (by a
    hash) look at all. A node asks for the shard of most of them (ties: lower number). Wishes between two shards are
    granted as far as they are met by wishes the other way or by what ``room`` leaves free, each by its hash, so no
    window over a shard is needed. Only the shards x shards table of wishes reaches the driver. Rounds end when nobody asks twice in a row.
    """
    both = links.where("a != b").select("a", "b").union(links.where("a != b").select("b", "a")).distinct()
    both = reliable_checkpoint(both)
    degree = reliable_checkpoint(both.groupBy("a").agg(F.count("*").alias("k")).select(F.col("a").alias("v"), "k"))
    # at most HOT_NODES nodes
    hot = degree.where(F.col("k") > max(1, both.count() // HOT_NODES)).select(F.col("v").alias("_hot"), F.col("k").alias("_k"))
    labels = stored(degree.select("v", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int").alias("shard")), "labels")
    quiet = 0
    if rounds:
        for end in ("a", "b"):
            met = both.join(F.broadcast(hot), both[end] == F.col("_hot"), "left")
            rest = met.where("_hot is null").drop("_hot", "_k").join(degree, F.col(end) == F.col("v"))
            named = [c for c in both.columns]
            both = met.where("_hot is not null").select(*named, F.col("_k").alias(f"k{end}")).unionByName(rest.select(*named, F.col("k").alias(f"k{end}")))
        both = reliable_checkpoint(both.select("a", "b", F.expr("kb > ka or (kb = ka and b < a)").alias("strong")))
    hot = hot.select("_hot")
    for turn in range(rounds):
        seen = both.where("strong") if turn % 2 == 0 else both
        near = (
            _neighbours(seen.select("a", "b"), labels, hot).groupBy("a", "shard").agg(F.count("*").alias("w"))
            .groupBy("a").agg(F.max(F.struct("w", (-F.col("shard")).alias("s"))).alias("best"), F.collect_list(F.struct("shard", "w")).alias("all"))
        )
        wish = near.join(labels, near["a"] == labels["v"]).select(
            "v", F.col("shard").alias("old"), (-F.col("best.s")).alias("new"), F.col("best.w").alias("w"),
            F.expr("coalesce(get(filter(all, x -> x.shard = shard), 0).w, 0)").alias("now"))
        coin = F.lit(True) if turn % 2 == 0 else F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(2)) == 0
        wish = reliable_checkpoint(wish.where("new != old and w > now").where(coin).select("v", "old", "new"))
        flows = wish.groupBy("old", "new").agg(F.count("*").alias("n")).collect()  # at most shards^2 rows
        quiet = 0 if flows else quiet + 1
        if quiet == 2:
            break
        if quiet:
            continue
        sizes = {r.shard: r["count"] for r in labels.groupBy("shard").count().collect()}
        quota = _quotas(flows, sizes, room, shards)
        table = both.sparkSession.createDataFrame(
            [(o, t, int(q * _GRAIN)) for (o, t), q in quota.items()], "o int, t int, share long")
        drawn = F.pmod(F.xxhash64("v", F.lit(turn), F.lit("draw")), F.lit(_GRAIN))
        moves = wish.join(F.broadcast(table), (F.col("old") == F.col("o")) & (F.col("new") == F.col("t")))
        moves = moves.where(drawn < F.col("share")).select(F.col("v").alias("_v"), "new")
        # written and read again: a checkpoint would carry what the planner knows of the columns from round to round
        labels = stored(
            labels.join(moves, labels["v"] == moves["_v"], "left").select("v", F.coalesce("new", "shard").alias("shard")), "labels")
    return labels


def even_shards(nodes: DataFrame, links: DataFrame, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """``v, shard, slot``: shards whose counts differ by at most one, slots without gaps from 0.

    Linked nodes lie where label propagation puts them, the others by hash. Then each shard gives away what it has above its
    size: nodes without links first, so that no link is cut as long as there are any, then one group after the other. What is given
    away fills the shards that lack rows. Groups larger than a shard are parted. Positions come from range
    partitions, no shard is ever ordered in one task.
    """
    n = nodes.count()
    labels = propagate(links, shards, n // shards, rounds)
    both = links.where("a != b").select("a", "b").union(links.where("a != b").select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    placed = labels.join(least, labels["v"] == least["a"]).select(F.col("v").alias("_v"), "shard", F.least("v", "m").alias("anchor"))
    home = F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int")
    laid = nodes.select("v").join(placed, F.col("v") == F.col("_v"), "left").select(
        "v", F.coalesce("shard", home).alias("shard"), F.col("_v").isNotNull().alias("linked"), F.coalesce("anchor", F.lit(0)).alias("anchor"))
    numbered = with_row_ids(laid, ["shard", "linked", "anchor", "v"], start=-1, name="_at")
    sizes = {r.shard: r["count"] for r in laid.groupBy("shard").count().collect()}  # one row per shard
    goal = [n // shards + (s < n % shards) for s in range(shards)]
    have = [sizes.get(s, 0) for s in range(shards)]
    surplus = [max(0, h - g) for h, g in zip(have, goal, strict=True)]
    lack = [max(0, g - h) for h, g in zip(have, goal, strict=True)]
    spark = nodes.sparkSession
    # one row per shard: where its rows begin, how many it gives, how many are given before it
    givers = spark.createDataFrame(
        [(s, sum(have[:s]), surplus[s], sum(surplus[:s])) for s in range(shards)], "_s int, _first long, _gives long, _before long")
    at = F.col("_at") - F.col("_first")
    moved = numbered.join(F.broadcast(givers), F.col("shard") == F.col("_s")).select(
        "v", "shard", (at - F.col("_gives")).alias("slot"), F.when(at < F.col("_gives"), at + F.col("_before")).alias("gift"))
    stays = moved.where("gift is null").select("v", "shard", "slot")
    # the rows given away, in order, fill the shards that lack some
    takers = [s for s in range(shards) if lack[s]]
    if not takers:
        return stays
    target = F.lit(takers[-1])
    for s in reversed(takers):
        target = F.when(F.col("gift") < sum(lack[: s + 1]), s).otherwise(target)
    into = spark.createDataFrame([(s, sum(lack[:s]) - have[s]) for s in takers], "_t int, _shift long")
    goes = moved.where("gift is not null").select("v", "gift", target.cast("int").alias("shard")).join(F.broadcast(into), F.col("shard") == F.col("_t"))
    return stays.unionByName(goes.select("v", "shard", (F.col("gift") - F.col("_shift")).alias("slot")))


def shard_documents(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS,
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard``: one row per document, law ``rows``.

    Size is the UTF-8 length plus 8; a null text has no bytes and counts as an empty one. Documents
    with equal texts are linked, each with a head of its group, never pair by pair: a group larger than half a shard has several heads, which
    are linked with the first, so that its rows gather in as few shards as can hold them. Ids may be null or repeat; other columns
    are not read; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = stored(docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("_sha"), F.monotonically_increasing_id().alias("v")), "rows")
    n = rows.count()
    part = max(1, n // shards // 2)
    groups = rows.groupBy("_sha").agg(F.count("*").alias("k")).where("k > 1").select(
        F.col("_sha").alias("_s"), F.ceil(F.col("k") / part).cast("int").alias("parts"), (F.col("k") > max(1, n // HOT_NODES)).alias("big"))
    groups = stored(groups, "copies")
    same = F.col("_sha") == F.col("_s")
    # rows of big groups meet them by a broadcast (at most HOT_NODES groups), the others by hash
    met = rows.select("v", "_sha").join(F.broadcast(groups.where("big")), same, "left")
    rest = met.where("_s is null").select("v", "_sha").join(groups.where("not big"), same)
    member = met.where("_s is not null").unionByName(rest).select("v", "_sha", F.pmod(F.xxhash64("v"), F.col("parts")).cast("int").alias("part"))
    member = reliable_checkpoint(member)
    heads = member.groupBy("_sha", "part").agg(F.min("v").alias("head"))
    top = heads.groupBy("_sha").agg(F.min("head").alias("top"), F.count("*").alias("parts"))
    tops = heads.join(top.where("parts > 1"), "_sha").where("head != top").select(F.col("top").alias("a"), F.col("head").alias("b"))
    leaves = _with_head(member, heads, n).where("v != head").select(F.col("head").alias("a"), F.col("v").alias("b"))
    placed = even_shards(rows.select("v"), reliable_checkpoint(leaves.unionByName(tops)), shards, rounds)
    return rows.join(placed, "v").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _with_head(member: DataFrame, heads: DataFrame, n: int) -> DataFrame:
    """``v, head``: big parts of groups by a broadcast, the others by hash."""
    sizes = member.groupBy("_sha", "part").agg(F.count("*").alias("k"))
    named = heads.join(sizes, ["_sha", "part"]).select(F.col("_sha").alias("_s"), F.col("part").alias("_p"), "head", (F.col("k") > max(1, n // HOT_NODES)).alias("big"))
    named = stored(named, "heads")
    same = (F.col("_sha") == F.col("_s")) & (F.col("part") == F.col("_p"))
    met = member.join(F.broadcast(named.where("big")), same, "left")
    rest = met.where("_s is null").select("v", "_sha", "part").join(named.where("not big"), same)
    return met.where("_s is not null").select("v", "head").unionByName(rest.select("v", "head"))
