"""Streams that keep a state of their own for each agent or source: silence by the clock, trailing windows.

Both use ``transformWithStateInPandas``, so the state lies in RocksDB and survives with the query's checkpoint. Spark's default
state store cannot hold it: a session that names no RocksDB store is given one (``state_in_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import detections as dt
from ..session import DEFAULTS

LATENESS = "10 minutes"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def state_in_rocksdb(rows: DataFrame) -> DataFrame:
    """Streams that the session of ``rows`` starts from now on keep their state in RocksDB; those with a checkpoint keep what it names."""
    conf = rows.sparkSession.conf
    if "RocksDB" not in conf.get(PROVIDER):
        conf.set(PROVIDER, DEFAULTS[PROVIDER])
    return rows


class SilenceTimer(StatefulProcessor):
    """One timer for each agent, set anew by every batch that brings something of it."""

    def __init__(self, agent: str, silence_ms: int):
        self.agent, self.silence_ms = agent, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # latest event time, arrival of the latest batch, and how many events since the last report
        self.seen = handle.getValueState("seen", "last_ms long, arrived_ms long, events long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, _, events = (self.seen.get() if self.seen.exists() else None) or (None, None, 0)
        for part in rows:
            known = part["ms"].dropna()
            if len(known):
                last = int(known.max()) if last is None else max(last, int(known.max()))
            events += len(part)
        now = timerValues.getCurrentProcessingTimeInMs()
        for old in [int(t) for batch in self.handle.listTimers() for t in (batch if isinstance(batch, (list, tuple)) else [batch])]:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(now + self.silence_ms)
        self.seen.update((last, now, events))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, arrived, events = self.seen.get()
        self.seen.update((last, arrived, 0))
        out = {self.agent: [key[0]], "last_ms": [last], "arrived_ms": [arrived], "reported_ms": [timerValues.getCurrentProcessingTimeInMs()], "events": [events]}
        yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def silent_agents_by_clock(alerts: DataFrame, silence_seconds: float = dt.SILENT_SECONDS, agent: str = "agent_name") -> DataFrame:
    """An agent from which nothing has arrived for ``silence_seconds`` of wall-clock time: a row, once per silence.

    ``agent, last_seen`` (latest event time), ``silent_since`` (arrival of its last batch), ``reported_at`` and ``events`` (since the last
    report). Timers fire without input, so a fleet that falls silent as a whole is reported too; a watermark would stand still then.
    State: a row and a timer per agent.
    """
    rows = alerts.select(F.col(agent).cast("string").alias(agent), F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    timed = state_in_rocksdb(rows).groupBy(agent).transformWithStateInPandas(
        SilenceTimer(agent, int(silence_seconds * 1000)),
        f"`{agent}` string, last_ms long, arrived_ms long, reported_ms long, events long", "Append", "ProcessingTime")
    return timed.select(
        agent, F.timestamp_millis("last_ms").alias("last_seen"), F.timestamp_millis("arrived_ms").alias("silent_since"),
        F.timestamp_millis("reported_ms").alias("reported_at"), "events")


class TrailingSums(StatefulProcessor):
    """The last seconds of a source with their counts: a ring that forgets what no later moment can see."""

    def __init__(self, source: str, more_than: int, seconds: int):
        self.source, self.more_than, self.seconds = source, more_than, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getValueState("ring", "second array<long>, n array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        fresh = pd.concat([p[["second", "n"]] for p in rows]).groupby("second")["n"].sum()
        held = self.ring.get() if self.ring.exists() else None
        ring = pd.Series(dtype="int64") if held is None else pd.Series([int(x) for x in held[1]], index=[int(x) for x in held[0]], dtype="int64")
        merged = fresh if ring.empty else pd.concat([ring, fresh])
        both = merged.groupby(level=0).sum().sort_index()
        moments = both.index.to_numpy()
        total = both.cumsum().to_numpy()
        first = moments.searchsorted(moments - self.seconds, side="left")
        attempts = total - total[first] + both.to_numpy()[first]
        hot = (attempts > self.more_than) & pd.Index(moments).isin(fresh.index)
        if hot.any():
            yield pd.DataFrame({
                self.source: key[0], "second": moments[hot], "attempts": attempts[hot], "timespan_seconds": moments[hot] - moments[first][hot]})
        keep = moments > moments[-1] - self.seconds
        self.ring.update((moments[keep].tolist(), both.to_numpy()[keep].tolist()))

    def close(self) -> None:
        pass


def brute_force_trailing(
    failures: DataFrame, source: str = "src_ip", ts: str = "ts", more_than: int = dt.BRUTE_COUNT, seconds: int = dt.BRUTE_SECONDS,
    lateness: str = LATENESS,
) -> DataFrame:
    """``detections.brute_force`` over a stream: the same moments with the same numbers, as soon as no earlier failure can come.

    Failures are first counted per source and second (a window that the watermark closes; a busy source is merged in the
    map tasks), so that the seconds of a source reach its ring in order and for good. State: the open seconds, and per source at most
    ``seconds`` entries.
    """
    closed = (
        failures.withWatermark(ts, lateness).groupBy(source, F.window(ts, "1 second").alias("w")).agg(F.count("*").alias("n"))
        .select(F.col(source).cast("string").alias(source), F.unix_seconds(F.col("w.start").cast("timestamp")).alias("second"), "n")
    )
    return state_in_rocksdb(closed).groupBy(source).transformWithStateInPandas(
        TrailingSums(source, more_than, seconds), f"`{source}` string, second long, attempts long, timespan_seconds long", "Append", "None")
