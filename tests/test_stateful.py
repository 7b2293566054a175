"""Streams with a state of their own: the clock, the trailing window, sketches, outcomes of lines."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from fixtures import SIEM_ALERTS, write_lines
from sievewatch.operators import detections as dt
from sievewatch.sources import alerts as src
from sievewatch.streaming import live, stateful
from sievewatch.workloads import streams

start = live.start
ROW = "src_ip string, agent_name string, s long, port int"


def land(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(dict(zip(("src_ip", "agent_name", "s", "port"), r, strict=False))) + "\n" for r in rows), encoding="utf-8")


def followed(spark, folder, files=1):
    rows = spark.readStream.schema(ROW).option("maxFilesPerTrigger", files).json(str(folder))
    return rows.withColumn("ts", F.timestamp_seconds("s"))


def test_trailing_window_equals_batch(spark, tmp_path):
    """Out of order within the lateness, one source on a third of all rows, over two runs of the query."""
    rnd = random.Random(7)
    rows = []
    for i in range(900):
        rows.append(("hot" if i % 3 == 0 else f"ip{rnd.randint(0, 5)}", "a", i * 2 + rnd.randint(0, 200)))
    rows[250:250] = [(None, "a", 500 + i) for i in range(20)]
    folder, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    for run in range(2):
        for part in range(3):
            at = run * 3 + part
            land(folder, f"{at}.json", rows[at * 155:(at + 1) * 155])
            time.sleep(0.01)  # files are taken in the order of their time
        stream = stateful.brute_force_trailing(followed(spark, folder), more_than=6, seconds=40, lateness="300 seconds")
        query = live.start(stream, out, cp, once=True)
        query.awaitTermination()
        assert query.exception() is None
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    seen = spark.read.schema(ROW).json(str(folder)).withColumn("ts", F.timestamp_seconds("s"))
    last = seen.agg(F.max("s")).first()[0]
    want = {tuple(r) for r in dt.brute_force(seen, more_than=6, seconds=40).collect() if r.second + 1 <= last - 300}
    assert want and got == want and len({s for s, *_ in want}) > 2
    assert spark.read.parquet(out).count() == len(want)


def wait_for(path, spark, rows, query, seconds=120):
    for _ in range(seconds * 4):
        time.sleep(0.25)
        if query.exception() is not None:
            raise query.exception()
        if query.recentProgress:
            try:
                got = spark.read.parquet(path).collect()
            except Exception:  # nothing written yet
                continue
            if len(got) >= rows:
                return got
    raise AssertionError(f"fewer than {rows} rows in {seconds} s")


def test_sessions_with_the_default_state_store(spark, tmp_path):
    """A session that was not built here has Spark's default store, which cannot hold the state."""
    land(tmp_path / "in", "0.json", [("ip", "a", s) for s in range(10)] + [("late", "a", 2000)])
    given, default = spark.conf.get(stateful.PROVIDER), "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    try:
        spark.conf.set(stateful.PROVIDER, default)
        stateful.silent_agents_by_clock(followed(spark, tmp_path / "in"), 1)
        assert spark.conf.get(stateful.PROVIDER) == given
        spark.conf.set(stateful.PROVIDER, default)
        stream, out = stateful.brute_force_trailing(followed(spark, tmp_path / "in"), more_than=6, seconds=40), str(tmp_path / "out")
        live.start(stream, out, str(tmp_path / "cp"), once=True).awaitTermination()
        assert {tuple(r) for r in spark.read.parquet(out).collect()} == {("ip", s, s + 1, s) for s in range(6, 10)}
    finally:
        spark.conf.set(stateful.PROVIDER, given)


def test_a_whole_fleet_falls_silent(spark, tmp_path):
    folder, out, cp = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    land(folder, "0.json", [("x", f"agent{i % 4}", 1000 + i) for i in range(40)] + [("x", None, 5), ("x", "blank", None)])
    query = live.start(stateful.silent_agents_by_clock(followed(spark, folder), 1.5), out, cp, interval="300 milliseconds")
    try:
        first = wait_for(out, spark, 6, query)  # the source has stopped, no row comes any more
        assert {(r.agent_name, r.events) for r in first} == {("agent0", 10), ("agent1", 10), ("agent2", 10), ("agent3", 10), (None, 1), ("blank", 1)}
        last = {r.agent_name: r.last_seen for r in first}
        assert last["blank"] is None and last["agent3"].timestamp() == 1039
        assert all(r.reported_at >= r.silent_since for r in first)
        time.sleep(3)
        assert spark.read.parquet(out).count() == 6  # once per silence
        land(folder, "1.json", [("x", "agent1", 900), ("x", "agent1", 2000)])
        again = wait_for(out, spark, 7, query)
    finally:
        query.stop()
    assert sorted((r.events, r.last_seen.timestamp()) for r in again if r.agent_name == "agent1") == [(2, 2000.0), (10, 1037.0)]


def test_sketches_beside_exact_counts(spark, tmp_path):
    rnd = random.Random(9)
    rows = [("scan", "a", 100 + i % 50, rnd.randint(1, 60000)) for i in range(20000)] + [("few", "a", 110, i % 20) for i in range(300)]
    rows += [("mid", "a", 120, i) for i in range(104)] + [("end", "a", 5000, 1)]
    land(tmp_path / "in", "0.json", rows)
    results = {}
    for name, make in (("exact", live.port_scan_stream), ("sketch", live.port_scan_sketch_stream)):
        stream = make(followed(spark, tmp_path / "in"), "src_ip", "port")
        live.start(stream, str(tmp_path / name), str(tmp_path / f"cp-{name}"), once=True).awaitTermination()
        results[name] = {(r.src_ip, r.window_start): r for r in spark.read.parquet(str(tmp_path / name)).collect()}
    assert results["exact"].keys() <= results["sketch"].keys() and all(s != "few" for s, _ in results["sketch"])
    for key, r in results["exact"].items():
        assert abs(results["sketch"][key].ports / r.ports - 1) < 0.08
    assert {s: r.sure for (s, _), r in results["sketch"].items()} == {"scan": True, "mid": False}


def test_every_line_has_an_outcome(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_lines(folder / "1.json", SIEM_ALERTS)
    odd = ['{"id": "n1", "rule": {"id": "1", "level": "high"}}', '{"id": "n2"}', "broken {", "", "  ", "[1, 2]"]
    (folder / "2.json").write_text("\n".join(odd) + "\n", encoding="utf-8")
    paths = [str(tmp_path / n) for n in ("kept", "rejects", "counts")]
    for attempt in range(2):  # a batch that is run again replaces its rows
        lines = src.parse_lines(src.stream_lines(spark, str(folder)))
        live.each_batch(lines, live.live_store(*paths), str(tmp_path / f"cp{attempt}"), once=True).awaitTermination()
    counts = {r.outcome: r.n for r in spark.read.parquet(paths[2]).groupBy("outcome").agg(F.sum("n").alias("n")).collect()}
    read = spark.read.text(str(folder)).where("trim(value) <> ''").count()
    assert sum(counts.values()) == read and counts["kept"] == 3
    rejects = {r.line: r.errors for r in spark.read.parquet(paths[1]).collect()}
    assert rejects['{"id": "n1", "rule": {"id": "1", "level": "high"}}'] == ["rule.level"] and rejects["broken {"] == ["line"]
    kept = spark.read.parquet(paths[0])
    assert kept.count() == 3 and {"alert_id", "ts", "rule", "line"} <= set(kept.columns)


class Landed:
    """One folder of alert lines, as ``Tables`` leaves them."""

    def __init__(self, spark, folder):
        self.spark, self.folder = spark, folder

    def landed(self, name):
        return self.folder

    @property
    def alerts(self):
        return src.read_alerts(self.spark, self.folder).select("agent.name").toDF("agent_name")


def silent_lines(tmp_path, n=40):
    folder = tmp_path / "lines"
    folder.mkdir()
    base = next(a for a in SIEM_ALERTS if a.get("agent") and a.get("rule"))
    rows = [base | {"id": f"s{i}", "timestamp": f"2024-01-15T10:00:{i:02d}.000Z", "agent": {"id": "1", "name": f"agent{i % 4}", "ip": "10.0.0.1"}} for i in range(n)]
    write_lines(folder / "0.json", rows)
    return str(folder)


def test_missing_reports_are_an_error(spark, tmp_path, monkeypatch):
    """Agents that are not reported in time, or a stream that stops: no empty or partial answer."""
    t, make = Landed(spark, silent_lines(tmp_path)), stateful.silent_agents_by_clock
    with monkeypatch.context() as m:
        m.setattr(stateful, "silent_agents_by_clock", lambda alerts, _: make(alerts, 1000))
        with pytest.raises(TimeoutError, match="0 of 40"):
            streams.fallen_silent(t, wait_seconds=2)

    def ended(*args, **options):
        query = start(*args, **options)
        query.stop()
        return query

    monkeypatch.setattr(live, "start", ended)
    with pytest.raises(RuntimeError, match="0 of 40"):
        streams.fallen_silent(t, wait_seconds=2)


def test_every_alert_is_in_a_report(spark, tmp_path):
    found = streams.fallen_silent(Landed(spark, silent_lines(tmp_path)), wait_seconds=60)
    assert sorted((r.agent_name, r.events, r.last_seen.second) for r in found.collect()) == [(f"agent{i}", 10, 36 + i) for i in range(4)]
