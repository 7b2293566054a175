"""Near-duplicate classes by a Jaccard join on word shingles with adaptive multi-match prefixes.

Sets are compared, not documents: equal sets share a digest and count as one vertex ``v``. All
tokens are ordered: those whose hash lies in the low range (``LOW_SHARE`` prefix lengths) come first,
rare before frequent (number of sets, capped at ``COMMON``), then the rest by hash. If two sets have
similarity ``t`` or more, the first ``n - ceil(t n) + l`` tokens of both share at least ``l`` tokens,
for each ``l``. Each set picks its own ``l`` by estimated cost, and a pair is verified when it shares as many prefix
tokens as the smaller ``l`` of the two asks for. Only the low range has to be counted for all sets;
those that may have a partner after that are counted again with all their tokens. Tokens of one set
alone never leave the counting stage, and shared tokens are enough for the verification.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import reliable_checkpoint
from .common import bounded_batches, components, freed, private, release, stored
from .shingles import digest, shingle_sets

LOW_SHARE = 1.75  # share of the tokens that is counted for all sets, in prefix lengths
COMMON = 256  # frequencies from here on count as equal
MOST_MATCHES = 4  # largest l
VERIFY_COST = 8  # a verification in list entries
PART_TOKENS = 1 << 19  # counted tokens of one partition, on average
LEAST_PARTS = 96  # enough for tasks to share; each part of a set carries the set's key, so more of them cost more
SPLIT = 1 << 12  # cells of the hash range that partitions are made of
BROADCAST_IDS = 2_000_000  # ids (with the hash of the text, 16 bytes) or hashes of digests that may be broadcast
GONE_IDS = 500_000  # dropped rows (id and hash) that may be broadcast
STAR_ROUNDS = 1  # most rounds of stars before pairs are made
PAIRS_AT_ONCE = 200_000  # pairs of list entries, beside twice their number, that need no stars first


def _need(n, percent: int):
    """Most tokens of ``n`` that a set may have outside a similar one, plus one."""
    return n - -(-n * percent // 100) + 1


def _limit(percent: int) -> int:
    """End of the low range of hashes."""
    return int((1 << 64) * min(1.0, LOW_SHARE * (100 - percent) / 100))


def _low(tokens: np.ndarray, limit: int) -> int:
    return len(tokens) if limit >= 1 << 64 else int(np.searchsorted(tokens, np.uint64(limit)))


def _sketch(percent: int, k: int):
    """Texts to sets: digest, size, number of low tokens, and the further tokens a prefix may need."""
    limit = _limit(percent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b["text"].to_pylist(), k)
            low = [_low(s, limit) for s in sets]
            ends = [max(m, min(len(s), _need(len(s), percent) + MOST_MATCHES - 1)) for s, m in zip(sets, low, strict=True)]
            yield pa.RecordBatch.from_pydict({
                "id": b["id"], "h": b["h"], "v": pa.array([digest(s) for s in sets], pa.binary()), "n": pa.array([len(s) for s in sets], pa.int64()),
                "n_low": pa.array(low, pa.int64()),
                "extra": pa.array([s[m:e].astype("<u8").tobytes() for s, m, e in zip(sets, low, ends, strict=True)], pa.binary()),
            })

    return rows


def _width(parts: int, limit: int) -> tuple[int, int]:
    """Width of a hash range, and the bytes that tell its tokens apart."""
    width = limit // parts + 1
    return width, -(-(width - 1).bit_length() // 8)


def _dealt(keys: list[bytes], sets: list[np.ndarray], parts: int, limit: int) -> pa.RecordBatch:
    """``(part, tokens, owner, keys)``: the tokens of a batch of sets, dealt by hash range, each as its distance from the start of the range."""
    if len(sets) > 1 << 16:
        raise ValueError("a batch of more than 65,536 sets")
    width, size = _width(parts, limit)
    width = np.uint64(width)
    tokens = np.concatenate([np.zeros(0, "<u8"), *sets])
    owner = np.repeat(np.arange(len(sets), dtype="<u4"), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    cuts = np.searchsorted(tokens, np.arange(1, parts, dtype=np.uint64) * width)
    out = {"part": [], "tokens": [], "owner": [], "keys": []}
    for p, (t, o) in enumerate(zip(np.split(tokens, cuts), np.split(owner, cuts), strict=True)):
        if len(t):
            seen, local = np.unique(o, return_inverse=True)
            out["part"].append(p)
            away = t - np.uint64(p) * width
            out["tokens"].append(away.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes())
            out["owner"].append(local.astype("<u2").tobytes())
            out["keys"].append(b"".join(keys[i] for i in seen))
    return pa.RecordBatch.from_pydict({
        "part": pa.array(out["part"], pa.int32()), **{c: pa.array(out[c], pa.binary()) for c in ("tokens", "owner", "keys")}})


_CELLS = "part int, tokens binary, owner binary, keys binary"


def _to_cells(parts: int, k: int, limit: int = 1 << 64):
    """Texts to the cells of their tokens below ``limit``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b["text"].to_pylist(), k)
            yield _dealt([digest(s) for s in sets], [s[: _low(s, limit)] for s in sets], parts, limit)

    return rows


def _count_in(parts: int, limit: int = 1 << 64):
    """The work on one hash range, see ``_count``."""
    width, size = _width(parts, limit)

    def run(table: pa.Table) -> pa.Table:
        found = _count(table, table["part"][0].as_py() * width, size)
        release()
        return found

    return run


def _whole(data: bytes, size: int, start: int) -> np.ndarray:
    """Tokens from their distances of ``size`` bytes."""
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(data, np.uint8).reshape(-1, size)
    return out.view("<u8").reshape(-1) + np.uint64(start)


def _count(table: pa.Table, start: int, size: int) -> pa.Table:
    """One cell range: tokens held by two sets or more, gathered again by set."""
    tokens, owner, keys, base = [], [], [], 0
    for t, o, k in zip(table["tokens"].to_pylist(), table["owner"].to_pylist(), table["keys"].to_pylist(), strict=True):
        tokens.append(_whole(t, size, start))
        owner.append(np.frombuffer(o, "<u2").astype(np.int64) + base)
        keys.append(np.frombuffer(k, "V16"))
        base += len(keys[-1])
    tokens, owner, keys = np.concatenate(tokens), np.concatenate(owner), np.concatenate(keys)
    _, first, same = np.unique(keys.view("<u8").reshape(-1, 2), axis=0, return_index=True, return_inverse=True)
    owner = same.reshape(-1)[owner]  # copies are one set
    order = np.lexsort((owner, tokens))
    tokens, owner = tokens[order], owner[order]
    fresh = np.r_[True, (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])]
    tokens, owner = tokens[fresh], owner[fresh]
    at = np.flatnonzero(np.r_[True, tokens[1:] != tokens[:-1]])
    held = np.diff(np.r_[at, len(tokens)])
    held = np.repeat(held, held)
    keep = held > 1
    tokens, owner, held = tokens[keep], owner[keep], np.minimum(held[keep], COMMON)
    order = np.argsort(owner, kind="stable")
    tokens, owner, held = tokens[order], owner[order], held[order]
    at = np.flatnonzero(np.r_[len(owner) > 0, owner[1:] != owner[:-1]])
    ends = np.r_[at[1:], len(owner)][: len(at)].astype(int)  # none if no token is shared
    return pa.table({
        "v": pa.array([keys[first[owner[i]]].tobytes() for i in at], pa.binary()),
        "tokens": pa.array([tokens[i:j].astype("<u8").tobytes() for i, j in zip(at, ends, strict=True)], pa.binary()),
        "held": pa.array([held[i:j].astype("<u2").tobytes() for i, j in zip(at, ends, strict=True)], pa.binary()),
    })


def _prefixes(percent: int):
    """Sets with their shared tokens to prefix rows ``(v, n, u, l, token)``.

    ``counted`` tokens of a set were counted; those that are not among ``tokens`` are held by it alone (``u``).
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"v": [], "n": [], "u": [], "l": [], "token": []}
            for v, n, counted, extra, tokens, held in zip(
                    *(b[c].to_pylist() for c in ("v", "n", "counted", "extra", "tokens", "held")), strict=True):
                t = np.frombuffer(b"".join(tokens or []), "<u8")
                h = np.frombuffer(b"".join(held or []), "<u2")
                more = np.frombuffer(extra, "<u8")
                alone = counted - len(t)
                room = _need(n, percent) - alone  # prefix tokens left for shared ones
                if room <= 0:
                    continue
                order = np.lexsort((t, h))
                t = np.r_[t[order], more][: room + MOST_MATCHES - 1]
                h = np.r_[h[order], np.full(len(more), COMMON)][: room + MOST_MATCHES - 1]
                if not len(t):
                    continue
                work = np.cumsum(h.astype(np.int64) - 1)
                best = min(
                    range(1, MOST_MATCHES + 1), key=lambda m: work[min(room + m - 1, len(t)) - 1] * (1 + VERIFY_COST / m))
                best = max(1, min(best, len(t) - room + 1))
                for x in t[: room + best - 1].view("<i8").tolist():
                    for c, y in (("v", v), ("n", n), ("u", alone), ("l", best), ("token", x)):
                        out[c].append(y)
            yield pa.RecordBatch.from_pydict({
                "v": pa.array(out["v"], pa.binary()), "n": pa.array(out["n"], pa.int64()), "u": pa.array(out["u"], pa.int64()),
                "l": pa.array(out["l"], pa.int32()), "token": pa.array(out["token"], pa.int64())})

    return rows


def _busy(index: DataFrame) -> DataFrame:
    """Prefix rows whose token is in two prefixes or more."""
    tokens = index.groupBy("token").agg(F.count("*").alias("c")).where("c > 1").select("token")
    return index.join(tokens, "token")


def _index(cells: DataFrame, sets: DataFrame, percent: int, count) -> tuple[DataFrame, DataFrame]:
    """Prefix rows of ``sets (v, n, counted, extra)``, and the shared tokens of each set.

    A cell range holds the tokens of one hash range; a set has at most one row per range afterwards.
    """
    shared = cells.groupBy("part").applyInArrow(count, "v binary, tokens binary, held binary")
    per_set = shared.groupBy("v").agg(F.collect_list("tokens").alias("tokens"), F.collect_list("held").alias("held"))
    both = sets.join(per_set, "v", "left")
    return both.mapInArrow(freed(_prefixes(percent)), "v binary, n long, u long, l int, token long"), both


def _linked(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y, n, m in zip(*(b[c].to_pylist() for c in ("x", "y", "n", "m")), strict=True):
                both = np.frombuffer(x + y, "<u8")
                both = np.sort(both)
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                good.append(100 * common >= percent * (n + m - common))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return rows


def _asked(sets: DataFrame, *ids: Column, of: DataFrame) -> DataFrame:
    """The sets whose digest is among ``ids`` of ``of`` (and the few that share its hash), or all if these are too many to be broadcast.

    Others need no shuffle.
    """
    few = of.select(F.explode(F.array(*ids)).alias("v")).select(F.xxhash64("v").alias("_v")).distinct()
    return sets.join(F.broadcast(few), F.xxhash64(sets["v"]) == F.col("_v"), "left_semi") if few.count() <= BROADCAST_IDS else sets


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` of sets whose similarity holds; tokens of one set alone cannot be common."""
    pairs = reliable_checkpoint(pairs)
    sets = _asked(sets, F.col("a"), F.col("b"), of=pairs)
    left = pairs.join(sets.select(F.col("v").alias("a"), F.col("n"), F.col("tokens").alias("x")), "a")
    both = left.join(sets.select(F.col("v").alias("b"), F.col("n").alias("m"), F.col("tokens").alias("y")), "b")
    return both.select("a", "b", "x", "y", "n", "m").mapInArrow(freed(_linked(percent)), "a binary, b binary")


def _may_link(percent: int, n: str, u: str, m: str, w: str) -> Column:
    """Sizes ``n, m`` with ``u, w`` tokens of their own leave room for the overlap that is needed."""
    most = F.least(F.col(n) - F.col(u), F.col(m) - F.col(w))
    return most * (100 + percent) >= (F.col(n) + F.col(m)) * percent


def _heads(lists: DataFrame, order: list[Column]) -> DataFrame:
    """``(token, head, m, w, hc)``: the first set of each list, its size, tokens of its own and component."""
    own = [F.col("v"), F.col("n").alias("m"), F.col("u").alias("w"), F.col("comp").alias("hc")]
    heads = lists.groupBy("token").agg(F.min(F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *own)).alias("h"))
    return heads.select("token", F.col("h.v").alias("head"), "h.m", "h.w", "h.hc")


def _outside(percent: int):
    """Sets beside a head: ``a`` common tokens, ``r`` other shared ones, and of these, rare first, as many as a partner must meet.

    A partner shares ``ceil(t n)`` tokens or more, at most ``a`` of them tokens of the head.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {"a": [], "r": [], "outside": []}
            for n, x, held, y in zip(*(b[c].to_pylist() for c in ("n", "x", "held", "y")), strict=True):
                t, h, y = np.frombuffer(x, "<u8"), np.frombuffer(held, "<u2"), np.sort(np.frombuffer(y, "<u8"))
                other = y[np.minimum(np.searchsorted(y, t), len(y) - 1)] != t
                a, r = len(t) - int(np.count_nonzero(other)), int(np.count_nonzero(other))
                t = t[other][np.lexsort((t[other], h[other]))]
                out["a"].append(a)
                out["r"].append(r)
                out["outside"].append(t[: max(0, r + 1 - max(1, -(-n * percent // 100) - a))].view("<i8").tolist())
            yield pa.RecordBatch.from_arrays(
                [*(b[c] for c in ("head", "v", "n", "u", "comp", "m", "hc")), pa.array(out["a"], pa.int64()), pa.array(out["r"], pa.int64()),
                 pa.array(out["outside"], pa.list_(pa.int64()))], names=["head", "v", "n", "u", "comp", "m", "hc", "a", "r", "outside"])

    return rows


def _enough(percent: int, common: Column, n: str, m: str) -> Column:
    """``common`` tokens are enough for a link of sets with ``n`` and ``m`` tokens."""
    return common * (100 + percent) >= (F.col(n) + F.col(m)) * percent


def _beside_heads(lists: DataFrame, shared: DataFrame, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` that hold every link between different components of a list, found by way of the list's head.

    All sets of a list are compared with its head. Two of them that link either have more tokens in common than both have with
    the head, so they meet at one of their tokens outside it, or both are so near to the head that one of them only does not
    link with it because it is the larger one: the other has fewer tokens than the head then. Copies with edits
    of their own share few tokens outside the head, so a list of any length gives few pairs.
    """
    lists = lists.join(_heads(lists, [F.col("u"), F.col("n")]), "token").select("v", "n", "u", "comp", "head", "m", "hc").distinct()
    lists = reliable_checkpoint(lists)
    shared = _asked(shared, F.col("v"), of=lists)  # a head is in its list
    lists = lists.join(shared.select("v", F.col("tokens").alias("x"), "held"), "v")
    lists = lists.join(shared.select(F.col("v").alias("head"), F.col("tokens").alias("y")), "head")
    near = reliable_checkpoint(lists.select("head", "v", "n", "u", "comp", "m", "hc", "x", "held", "y").mapInArrow(
        freed(_outside(percent)), "head binary, v binary, n long, u long, comp binary, m long, hc binary, a long, r long, outside array<long>"))
    linked = _enough(percent, F.col("a"), "n", "m")
    apart = F.col("x.comp") != F.col("y.comp")
    tokens = near.select("head", "v", "n", "u", "comp", "a", "r", F.explode("outside").alias("token"))
    x, y = tokens.alias("x"), tokens.alias("y")
    most = F.least("x.a", "y.a") + F.least("x.r", "y.r")
    far = x.join(y, (F.col("x.head") == F.col("y.head")) & (F.col("x.token") == F.col("y.token"))).where(
        (F.col("x.v") < F.col("y.v")) & apart & _may_link(percent, "x.n", "x.u", "y.n", "y.u") & _enough(percent, most, "x.n", "y.n"))
    close = near.where(F.col("a") * 100 >= F.col("n") * percent)
    x, y = close.where(~linked).alias("x"), close.where("n < m").alias("y")
    close = x.join(y, F.col("x.head") == F.col("y.head")).where(apart & _enough(percent, F.least("x.a", "y.a"), "x.n", "y.n"))
    pairs = far.select("x.v", F.col("y.v").alias("w")).union(close.select("x.v", "y.v")).union(
        near.where(linked & (F.col("comp") != F.col("hc"))).select("v", "head"))
    return pairs.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80,
) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    Two rows link when ``100 * intersection >= percent * union`` of their ``k``-word shingle sets;
    ``component_id`` is the smallest id reachable by links. Texts are lower-cased (A-Z); fewer than
    ``k`` words are one shingle; a null or wordless text has no shingles and links with nothing.
    Every set is a vertex whatever its ids, so repeated and null ids do no harm: a component takes its smallest
    non-null id, and a row without shingles keeps its own. No pair is lost: prefixes are complete,
    and where stars around one set per token do not join all sets of a token, the rest of them is
    compared pair by pair if few pairs are left, else where they meet outside that set (``_beside_heads``). Other columns are not read; an empty table gives no rows.
    """
    return _marks(docs, id_col, text_col, k, percent).select("doc_id", "n_shingles", "component_id")


def _marks(docs: DataFrame, id_col: str, text_col: str, k: int, percent: int) -> DataFrame:
    """``near_duplicates`` with a hash of the text, ``_h``, and ``_first``: id and hash of the one that stays of the component."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    hashed = rows.withColumn("h", F.xxhash64("text"))
    base = stored(hashed.mapInArrow(freed(_sketch(percent, k)), f"id {rows.schema['id'].dataType.simpleString()}, h long, v binary, n long, n_low long, extra binary"), "sets")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "h")).alias("first")
    classes = base.where("n > 0").groupBy("v").agg(F.min("id").alias("id"), F.min("n").alias("n"), first)
    links = set_links(rows, base, classes, k, percent)
    roots = components(links)
    named = classes.join(roots, "v", "left").select("v", "id", "first", F.coalesce("root", "v").alias("root"))
    smallest = named.groupBy("root").agg(F.min("id").alias("component_id"), F.min("first").alias("_first"))
    of_set = named.join(smallest, "root").select("v", "component_id", "_first")
    return base.select("id", "h", "v", "n").join(of_set, "v", "left").select(
        F.col("id").alias("doc_id"), F.col("h").alias("_h"), "_first", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _parts(tokens: int | None) -> int:
    return int(min(SPLIT, max(LEAST_PARTS, (tokens or 0) // PART_TOKENS)))


def set_links(rows: DataFrame, base: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between different sets that give the same components as all links."""
    spark = rows.sparkSession
    real = base.where("n > 0")
    low = real.agg(F.sum("n_low").alias("low")).first().low
    # first with the low tokens of all sets ...
    parts = _parts(low)
    cells = rows.select("text").mapInArrow(freed(_to_cells(parts, k, _limit(percent))), _CELLS)
    sets = real.groupBy("v").agg(F.min("n").alias("n"), F.min("n_low").alias("counted"), F.min("extra").alias("extra"))
    prefixes = stored(_index(cells, sets, percent, _count_in(parts, _limit(percent)))[0].select("v", "token"), "lowprefixes")
    members = stored(_busy(prefixes).select("v").distinct(), "members")
    # ... then with all tokens of the sets that may have a partner: one text each
    ids = stored(classes.join(members, "v").select(F.col("first.id").alias("_id"), F.col("first.h").alias("_h"), "n"), "memberids")
    asked = ids.agg(F.count("*").alias("c"), F.sum("n").alias("tokens")).first()
    ids = ids.select("_id", "_h")
    few = F.broadcast(ids) if asked.c <= BROADCAST_IDS else ids
    texts = rows.join(few, rows["id"].eqNullSafe(F.col("_id")) & (F.xxhash64(rows["text"]) == F.col("_h")), "left_semi")
    parts = _parts(asked.tokens)
    cells = texts.select("text").mapInArrow(freed(_to_cells(parts, k)), _CELLS)
    sets = classes.join(members, "v").select("v", "n", F.col("n").alias("counted"), F.lit(b"").alias("extra"))
    both = _index(cells, sets, percent, _count_in(parts))[1]
    sets = stored(both, "sharedtokens")
    index = stored(_busy(stored(sets.mapInArrow(freed(_prefixes(percent)), "v binary, n long, u long, l int, token long"), "prefixes")), "lists")
    joined = [F.expr(f"aggregate({c}, x'', (a, x) -> concat(a, x))").alias(c) for c in ("tokens", "held")]
    shared = sets.select("v", "n", *joined)  # only read by way of ``_asked``, so that few of them are shuffled
    sets = shared.drop("held")

    found = None
    comp = None  # at first every set is a component of its own
    members = index.select("v").distinct()
    lists = index.select("token", "v", "n", "u", "l")
    turn = 0
    while True:
        # used twice below, so the join is made once
        lists_now = lists.withColumn("comp", F.col("v")) if comp is None else reliable_checkpoint(lists.join(comp, "v"))
        open_tokens = lists_now.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        open_tokens = open_tokens.where("lo != hi").select("token")
        lists_now = reliable_checkpoint(lists_now.join(open_tokens, "token"))
        lists = lists_now.drop("comp")  # a token whose sets are joined stays so
        # pairs of different components, over all tokens
        cost = (
            lists_now.groupBy("token", "comp").agg(F.count("*").alias("c"))
            .groupBy("token").agg(F.sum("c").alias("c"), F.sum(F.col("c") * F.col("c")).alias("same"))
            .agg(F.sum("c").alias("rows"), F.sum((F.col("c") * F.col("c") - F.col("same")) / 2).alias("pairs")).first()
        )
        if not cost.rows:
            break
        many = cost.pairs > PAIRS_AT_ONCE + 2 * cost.rows
        stars = turn < STAR_ROUNDS and many
        if stars:
            # star: the set with the fewest tokens of its own, then others by a hash, is compared with all
            heads = _heads(lists_now, [F.col("u"), F.col("n")] if turn == 0 else [F.xxhash64("comp", F.lit(turn)), F.col("u")])
            pairs = lists_now.join(heads, "token").where(_may_link(percent, "n", "u", "m", "w") & (F.col("comp") != F.col("hc")))
            pairs = pairs.select(F.least("v", "head").alias("a"), F.greatest("v", "head").alias("b")).distinct()
        elif many:
            pairs = _beside_heads(lists_now, shared, percent)
        else:
            # few are left: pairs of different components with enough shared prefix tokens
            x, y = lists_now.alias("x"), lists_now.alias("y")
            pairs = (
                x.join(y, F.col("x.token") == F.col("y.token"))
                .where((F.col("x.v") < F.col("y.v")) & (F.col("x.comp") != F.col("y.comp")) & _may_link(percent, "x.n", "x.u", "y.n", "y.u"))
                .groupBy(F.col("x.v").alias("a"), F.col("y.v").alias("b"))
                .agg(F.count("*").alias("shared"), F.min(F.least("x.l", "y.l")).alias("asked"))
                .where("shared >= asked").select("a", "b")
            )
        good = reliable_checkpoint(_verify(pairs, sets, percent))
        found = good if found is None else found.union(good)
        if not stars:
            break
        turn += 1
        roots = components(found)
        comp = members.join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("comp"))
    if found is None:
        return spark.createDataFrame([], "a binary, b binary")
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when exactly one row of each component is kept. Columns are unchanged.

    The row with the smallest id stays (null is larger than any other), of equal ids the one with the smallest
    hash of its text, of rows that share id and text one. Rows are dropped by id and hash, so a repeated id with another
    text is judged for itself. Rows without shingles stay.
    """
    gone_id, gone_h = private(docs.columns, "_gone", "_gone_h")
    marks = _marks(docs, id_col, text_col, k, percent).where("n_shingles > 0").select(
        F.col("doc_id").alias(gone_id), F.col("_h").alias(gone_h), F.expr("doc_id <=> _first.id and _h = _first.h").alias("stays"))
    marks = stored(marks.groupBy(gone_id, gone_h, "stays").agg(F.count("*").alias("c")).where("not stays or c > 1"), "gone")
    gone, twins = (marks.where(x).select(gone_id, gone_h) for x in ("not stays", "stays"))
    h = F.xxhash64(docs[text_col])
    same = docs[id_col].eqNullSafe(F.col(gone_id)) & (h == F.col(gone_h))
    out = docs.join(F.broadcast(gone) if gone.count() <= GONE_IDS else gone, same, "left_anti")
    if twins.isEmpty():
        return out
    once = out.join(twins, same, "left_semi").withColumn(gone_h, h).dropDuplicates([id_col, gone_h]).drop(gone_h)
    return out.join(twins, same, "left_anti").unionByName(once)
