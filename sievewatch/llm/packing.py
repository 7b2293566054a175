"""Packing of token sequences by linear grouping, configurations and best fit.

Only the histogram of lengths (at most ``SIZE`` numbers) reaches the driver. There the plan is made
for lengths, not for documents: large lengths are rounded up within groups of equal cardinality, a
linear program over configurations (filled by column generation) packs the few rounded sizes, and the
actual lengths take their places, the last place of a bin the largest one that still fits. Part of the configurations are carried out so, then
what is left is grouped anew. The small lengths, and the last few large ones, go where they fit best. The plan is a table of
runs ``(length, first rank, bins, copies, first bin, offset)``; the documents find their place by
their rank among those of equal length.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .bpe import MEMORY, read_vocabulary, worker_coder
from .common import bounded_batches, freed, stored

SIZE = 2048
GROUPS = 32  # rounded sizes of the large lengths
SMALL = 4  # lengths up to SIZE / SMALL are small
TURNS, SHARE = 16, 4  # times that the lengths which are left are grouped, and the part (one in SHARE) of the configurations used in a turn
RANK_ROWS = 4096  # rows of one rank window, on average
_COLUMNS = 300  # most configurations that column generation adds


def _knapsack(sizes: np.ndarray, value: np.ndarray, size: int) -> np.ndarray:
    """Counts of the most valuable configuration (any number of each size)."""
    most = size // int(sizes.min())
    room = np.arange(size + 1)[:, None] - sizes[None, :]
    best, picks = np.zeros(size + 1), []
    for _ in range(most):  # one item more in each turn
        gain = np.where(room >= 0, best[np.maximum(room, 0)] + value[None, :], 0.0)
        pick = gain.argmax(axis=1)
        new = gain[np.arange(size + 1), pick]
        pick = np.where(new > best + 1e-12, pick, -1)
        picks.append(pick)
        best = np.maximum(best, new)
    counts, c = np.zeros(len(sizes), np.int64), size
    for pick in reversed(picks):
        if pick[c] >= 0:
            counts[pick[c]] += 1
            c -= int(sizes[pick[c]])
    return counts


def configurations(sizes: np.ndarray, demand: np.ndarray, size: int = SIZE) -> list[tuple[np.ndarray, int]]:
    """Configurations with whole multiplicities that hold at most the demand of each size.

    Cutting-stock program solved by the simplex method with knapsack pricing; its solution is
    rounded down, so that some items may be left for best fit.
    """
    k = len(sizes)
    basis = np.diag((size // sizes).astype(float))
    x = demand / np.diag(basis)
    for _ in range(_COLUMNS):
        dual = np.linalg.solve(basis.T, np.ones(k))
        column = _knapsack(sizes, dual, size).astype(float)
        if dual @ column <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, column)
        rising = step > 1e-9
        if not rising.any():
            break
        ratio = np.where(rising, x / np.where(rising, step, 1), np.inf)
        out = int(ratio.argmin())
        x = np.maximum(x - ratio[out] * step, 0)
        x[out] = ratio[out]
        basis[:, out] = column
    left = demand.copy()
    found = []
    for j in range(k):
        counts = basis[:, j].astype(np.int64)
        used = counts > 0
        times = int(min(np.floor(x[j] + 1e-7), (left[used] // counts[used]).min()))
        if times > 0:
            found.append((counts, times))
            left -= counts * times
    return found


def _rounded(lengths: np.ndarray, counts: np.ndarray) -> list[tuple[int, list[tuple[int, int]]]]:
    """Groups of equal cardinality from the largest length down: (rounded size, [(length, count)])."""
    total, groups = int(counts.sum()), []
    share = max(1, -(-total // GROUPS))
    part, room = [], share
    for n, c in zip(lengths[::-1].tolist(), counts[::-1].tolist(), strict=True):
        while c:
            take = min(c, room)
            part.append((n, take))
            c, room = c - take, room - take
            if not room:
                groups.append((part[0][0], part))
                part, room = [], share
    if part:
        groups.append((part[0][0], part))
    merged: dict[int, list[tuple[int, int]]] = {}
    for size, items in groups:  # one length can fill several groups
        merged.setdefault(size, []).extend(items)
    return list(merged.items())


class Plan:
    """Classes of equal bins: each holds ``count`` bins from ``first`` on with the same contents."""

    def __init__(self, size: int):
        self.size, self.bins, self.by_plan = size, 0, 0  # by_plan: items placed by configurations
        self.heap: dict[int, list[tuple[int, int, tuple]]] = defaultdict(list)  # slack: (first, count, runs)
        self.used: dict[int, int] = defaultdict(int)  # ranks given out for each length
        self.closed: list[tuple[int, int, tuple]] = []

    def add(self, first: int, count: int, runs: tuple) -> None:
        """``runs``: (length, rank of the first bin's first item, copies in each bin)."""
        slack = self.size - sum(n * q for n, _, q in runs)
        (self.heap[slack] if slack else self.closed).append((first, count, runs))

    def take(self, length: int, number: int) -> int:
        rank = self.used[length]
        self.used[length] += number
        return rank

    @staticmethod
    def cut(runs: tuple, at: int) -> tuple[tuple, tuple]:
        """The runs of the first ``at`` bins and those of the rest."""
        return runs, tuple((n, r + at * q, q) for n, r, q in runs)

    def fit(self, length: int, number: int) -> None:
        """Best fit of ``number`` items of one length: the smallest sufficient slack first."""
        open_slacks = [s for s in self.heap if s >= length and self.heap[s]]
        heapq.heapify(open_slacks)
        while number and open_slacks:
            slack = open_slacks[0]
            if not self.heap[slack]:
                heapq.heappop(open_slacks)
                continue
            first, count, runs = self.heap[slack].pop()
            each = slack // length
            full = min(count, number // each)
            if full:
                head, rest = self.cut(runs, full)
                self.add(first, full, (*head, (length, self.take(length, full * each), each)))
                number -= full * each
                if full < count:
                    self.heap[slack].append((first + full, count - full, rest))
            else:
                head, rest = self.cut(runs, 1)
                self.add(first, 1, (*head, (length, self.take(length, number), number)))
                if count > 1:
                    self.heap[slack].append((first + 1, count - 1, rest))
                number = 0
        if number:
            each = self.size // length
            full, last = divmod(number, each)
            if full:
                self.add(self.bins, full, ((length, self.take(length, full * each), each),))
            if last:
                self.add(self.bins + full, 1, ((length, self.take(length, last), last),))
            self.bins += full + (last > 0)

    def rows(self) -> list[tuple[int, int, int, int, int, int]]:
        """(length, first rank, bins, copies, first bin, offset of the first copy)."""
        out = []
        for first, count, runs in [*self.closed, *(c for classes in self.heap.values() for c in classes)]:
            at = 0
            for n, rank, q in runs:
                out.append((n, rank, count, q, first, at))
                at += n * q
        return out


def _filled(made: Plan, config: list[int], times: int, stock: dict[int, int], ready: list[int]) -> None:
    """``times`` bins of a configuration (rounded sizes, falling) with actual lengths; equal bins are made in one go.

    A place takes the largest length that is left of its size or less; the last place the largest one that still fits into the bin, so that what
    rounding up has cost is used. ``ready`` holds the lengths of ``stock`` in order.
    """
    while times and ready:
        rest, want = made.size, defaultdict(int)
        for i, size in enumerate(config):
            at = bisect.bisect_right(ready, rest if i == len(config) - 1 else min(size, rest)) - 1
            while at >= 0 and stock[ready[at]] <= want[ready[at]]:
                at -= 1
            if at >= 0:
                want[ready[at]] += 1
                rest -= ready[at]
        want = {n: q for n, q in want.items() if q}
        if not want:
            return
        bins = min(times, *(stock[n] // q for n, q in want.items()))
        made.add(made.bins, bins, tuple((n, made.take(n, q * bins), q) for n, q in want.items()))
        made.bins += bins
        made.by_plan += bins * sum(want.values())
        times -= bins
        for n, q in want.items():
            stock[n] -= q * bins
            if not stock[n]:
                ready.pop(bisect.bisect_left(ready, n))


def make_plan(histogram: dict[int, int], size: int = SIZE) -> Plan:
    """The plan for ``{length: count}`` with lengths from 1 to ``size``."""
    made = Plan(size)
    stock = {n: c for n, c in histogram.items() if n > size // SMALL and c}
    for _ in range(TURNS):
        if not stock:
            break
        lengths = np.array(sorted(stock), np.int64)
        groups = _rounded(lengths, np.array([stock[n] for n in lengths.tolist()], np.int64))
        sizes = np.array([s for s, _ in groups])
        found = configurations(sizes, np.array([sum(c for _, c in items) for _, items in groups]), size)
        ready = lengths.tolist()
        for config, times in sorted(found, key=lambda x: -int(x[0] @ sizes)):
            # part of the bins: what is left has other sizes, which are grouped anew
            _filled(made, sorted(np.repeat(sizes, config).tolist(), reverse=True), -(-times // SHARE), stock, ready)
        stock = {n: c for n, c in stock.items() if c}
    left = {n: c - made.used[n] for n, c in histogram.items()}
    for n in sorted(left, reverse=True):
        if left[n]:
            made.fit(n, left[n])
    return made


def plan(histogram: dict[int, int], size: int = SIZE) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs and number of bins of ``make_plan``."""
    made = make_plan(histogram, size)
    return made.rows(), made.bins


def _pieces_of(path_content, size: int, outputs: str):
    """Texts to pieces ``(doc_id, piece, start, length, ids_crc32[, ids])``; the first piece may be shorter."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(path_content.value, None)
        end = np.zeros(1, "<u4")
        for b in batches:
            index, out = [], {"piece": [], "start": [], "length": [], "ids_crc32": [], "ids": []}
            for i, text in enumerate(b["text"].to_pylist()):
                ids = np.r_[coder.encode(text), end]
                first = len(ids) % size or size
                cuts = [0, *range(first, len(ids) + 1, size)]
                for p, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[x:y].astype("<u4")
                    index.append(i)
                    out["piece"].append(p)
                    out["start"].append(x)
                    out["length"].append(y - x)
                    out["ids_crc32"].append(zlib.crc32(part.tobytes()))
                    if outputs:
                        out["ids"].append(part.astype("<i4"))
            arrays = {
                "piece": pa.array(out["piece"], pa.int32()),
                **{c: pa.array(out[c], pa.int64()) for c in ("start", "length", "ids_crc32")},
            }
            if outputs:
                arrays["ids"] = pa.array(out["ids"], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"].take(pa.array(index, pa.int64())), **arrays})

    return rows


def pack(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``).

    A document is its token ids followed by id 0, so an empty or null text is one piece of length 1.
    Documents longer than ``size`` are cut so that only the first piece may be shorter. Each
    input row is packed, whatever its id (ids may be null or repeat); other columns are not read. An
    empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(path))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    extra = ", ids array<int>" if with_ids else ""
    parts = stored(
        rows.mapInArrow(
            freed(_pieces_of(vocabulary, size, extra), MEMORY), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{extra}")
        .withColumn("_row", F.monotonically_increasing_id()), "pieces")
    return place(parts, size)


def place(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """Give stored pieces (with ``length`` and a unique ``_row``) their sequence and offset."""
    spark = parts.sparkSession
    histogram = {r.length: r.n for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `size` rows
    runs, _ = plan(histogram, size)
    table = spark.createDataFrame(runs, "n long, r0 long, bins long, q long, bin0 long, at long")
    # rank among equal lengths: by salted groups of bounded size, then offsets of the groups
    salts = max(1, sum(histogram.values()) // RANK_ROWS)
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(salts)))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        F.col("length").alias("_l"), F.col("_salt").alias("_s"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row")) - 1
    ranked = salted.withColumn("_own", own).join(
        starts, (F.col("length") == F.col("_l")) & (F.col("_salt") == F.col("_s"))).withColumn("_rank", F.col("_before") + F.col("_own"))
    k = F.col("_rank") - F.col("r0")
    # the plan has a few thousand rows: its size depends on `size` alone
    placed = ranked.join(
        F.broadcast(table), (F.col("length") == F.col("n")) & (k >= 0) & (k < F.col("bins") * F.col("q")))
    out = placed.withColumn("sequence_id", F.expr("bin0 + (_rank - r0) div q")).withColumn(
        "offset", F.col("at") + F.pmod(k, F.col("q")) * F.col("length"))
    drop = ["_row", "_salt", "_l", "_s", "_before", "_own", "_rank", "n", "r0", "bins", "q", "bin0", "at"]
    return out.drop(*drop)
