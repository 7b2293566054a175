"""Stores and streams: repeated, late and growing input."""

import json

from pyspark.sql import functions as F

from fixtures import SIEM_ALERTS, write_lines
from sievewatch.operators import normalise as nz, snapshots, stores
from sievewatch.sources import alerts as src, tail
from sievewatch.streaming import live


def at(text):
    return F.lit(text).cast("timestamp")


def test_save_alerts_first_write_wins(spark, tmp_path):
    raw = src.read_alerts(spark, write_lines(tmp_path / "a.json", SIEM_ALERTS[:2]))
    more = src.read_alerts(spark, write_lines(tmp_path / "b.json", SIEM_ALERTS))
    path = str(tmp_path / "table")
    stores.save_alerts(spark, stores.alert_records(raw, at("2024-01-01")), path)
    for _ in range(2):
        stores.save_alerts(spark, stores.alert_records(more.unionByName(more), at("2024-01-02")), path)
    got = spark.read.parquet(path)
    assert got.count() == 5 and got.where("created_at < '2024-01-02'").count() == 2
    row = got.where("id = '7301'").first()
    assert (row.severity, row.rule_level, row.agent_name) == ("UNKNOWN", 11, "edge-gw")
    assert json.loads(row.raw_data)["rule"]["id"] == "40111"


def test_known_alerts_are_not_shuffled_whole(spark):
    """The fields of an alert whose id is stored are not looked at; null is never a known id."""
    looked = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        looked.add(1)
        return x

    ids = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "1"), (None, "3"), (None, "0"), ("n", "5"), ("n", "4")], "id string, v string")
    table = spark.createDataFrame([("a", "x"), ("b", "x"), (None, "x")], "id string, v string")
    records = ids.select("id", seen("v").alias("v"))
    assert sorted(stores.new_records(records, table).collect(), key=str) == [("n", "4"), (None, "0")]
    looked.value = 0
    assert stores.new_records(records.where("id in ('a', 'b')"), table).collect() == []
    assert looked.value == 0


def test_stored_range_prunes_days(spark, tmp_path, capsys):
    raw = src.read_alerts(spark, write_lines(tmp_path / "a.json", SIEM_ALERTS))
    path = str(tmp_path / "table")
    stores.save_alerts(spark, stores.alert_records(raw), path)
    df = stores.stored_between(spark.read.parquet(path), "2025-03-04T09:00", "2025-03-04T11:00")
    assert df.count() == 2
    df.explain("formatted")
    assert "PartitionFilters: [isnotnull(day" in capsys.readouterr().out


def test_first_arrival_is_kept(spark):
    rows = spark.createDataFrame([("x", 2, "b"), ("x", 1, "c"), ("y", 3, "d")], "id STRING, n INT, v STRING")
    assert {tuple(r) for r in stores.first_per_id(rows, "n").collect()} == {("x", "c"), ("y", "d")}


def test_running_ids(spark, tmp_path):
    path = str(tmp_path / "reports")
    rows = spark.createDataFrame([("b", "LOW", "h", "text")],
                                 "alert_id STRING, severity STRING, agent_name STRING, report_text STRING"
                                 ).withColumn("created_at", at("2024-01-01"))
    for _ in range(3):
        stores.save_reports(spark, rows, path)
    assert [r.id for r in stores.saved_reports(spark, path).orderBy("id").collect()] == [1, 2, 3]


def test_knowledge_modes(spark, tmp_path):
    path = str(tmp_path / "knowledge")
    a, b = spark.range(3), spark.range(5)
    assert stores.save_knowledge(spark, a, path) and not stores.save_knowledge(spark, b, path)
    assert spark.read.parquet(path).count() == 3
    assert stores.save_knowledge(spark, b, path, force=True) and spark.read.parquet(path).count() == 5
    empty = str(tmp_path / "empty")
    a.limit(0).write.parquet(empty)
    assert stores.save_knowledge(spark, a, empty)


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def test_stream_equals_batch_over_split_files(spark, tmp_path):
    """Files arrive one by one, out of order and with a repeated file."""
    folder = tmp_path / "in"
    folder.mkdir()
    late = [SIEM_ALERTS[4], SIEM_ALERTS[0], SIEM_ALERTS[3], SIEM_ALERTS[0], SIEM_ALERTS[2]]
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")
    for i, alert in enumerate(late):
        write_lines(folder / f"{i}.json", [alert])
        alerts = live.live_alerts(src.stream_alerts(spark, str(folder), max_files=1))
        run(live.start(live.without_repeats(alerts, "1 day").select("alert_id", "category"), out, cp, once=True))
    batch = src.read_alerts(spark, str(folder))
    want = {(r.alert_id, r.category) for r in nz.normalise(nz.forward(batch)).collect()}
    got = spark.read.parquet(out).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) == 3


def test_store_sink_is_repeatable(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_lines(folder / "1.json", SIEM_ALERTS)
    table = str(tmp_path / "table")
    for attempt in range(2):
        stream = live.live_alerts(src.stream_alerts(spark, str(folder)))
        run(live.each_batch(stream, live.alert_store(table), str(tmp_path / f"cp{attempt}"), once=True))
    assert spark.read.parquet(table).count() == 3


def test_rejects_and_counts(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_lines(folder / "1.json", SIEM_ALERTS)
    (folder / "2.json").write_text("broken {\n\n", encoding="utf-8")
    good, bad = str(tmp_path / "good"), str(tmp_path / "bad")
    parsed = src.parse_lines(src.stream_lines(spark, str(folder)))
    run(live.each_batch(parsed, live.lines_store(good, bad), str(tmp_path / "cp"), once=True))
    assert spark.read.parquet(good).count() == 5
    assert [r.line for r in spark.read.parquet(bad).collect()] == ["broken {"]
    counts = str(tmp_path / "counts")
    run(live.each_batch(live.running_counts(src.stream_alerts(spark, str(folder))),
                        live.latest_table(counts), str(tmp_path / "cp2"), mode="complete", once=True))
    found = snapshots.read(spark, counts, "forwarded BOOLEAN, n BIGINT")
    assert {r.forwarded: r.n for r in found.collect()} == {True: 3, False: 2}


def test_mail_queue_over_batches(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    table, cp = str(tmp_path / "mail"), str(tmp_path / "cp")
    schema = "alert_id STRING, rule_level INT, s LONG"
    for part in range(3):
        (folder / f"{part}.json").write_text("".join(
            json.dumps({"alert_id": f"{part}-{i}", "rule_level": 12, "s": part * 10 + i}) + "\n"
            for i in range(5)), encoding="utf-8")
        stream = spark.readStream.schema(schema).json(str(folder)).withColumn("ts", F.timestamp_seconds("s"))
        run(live.each_batch(stream, live.mail_store(table), cp, once=True))
    got = spark.read.parquet(table)
    assert sorted(r.position for r in got.collect()) == list(range(1, 13))


def test_tail_follows_one_growing_file(spark, tmp_path):
    log = tmp_path / "alerts.json"
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def read():
        stream = tail.stream_tail(spark, str(log), "start", range_bytes=40)
        run(live.start(stream, out, cp, once=True))
        return sorted(r.value for r in spark.read.parquet(out).collect())

    log.write_text("".join(f"line {i:03d} {'x' * (i % 37)}\n" for i in range(50)), encoding="utf-8")
    assert [v[:8] for v in read()] == [f"line {i:03d}" for i in range(50)]
    with log.open("a", encoding="utf-8") as f:
        f.write("line 050 ü\nline 051 unfinished")
    assert [v[:8] for v in read()][50:] == ["line 050"]
    with log.open("a", encoding="utf-8") as f:
        f.write(" now done\n")
    assert read()[51:] == ["line 051 unfinished now done"]
    log.write_text("new file\n", encoding="utf-8")  # rotated
    assert "new file" in read()


def test_tail_from_the_end(tmp_path):
    log = tmp_path / "a.log"
    log.write_text("old\npart", encoding="utf-8")
    reader = tail.TailReader(str(log), True, 1 << 20)
    assert reader.initialOffset()["byte"] == 4 == reader.latestOffset()["byte"]
    assert tail.TailReader(str(log), False, 1).initialOffset()["byte"] == 0
    assert tail.TailReader(str(tmp_path / "none"), True, 1).latestOffset() == {"byte": 0, "file": 0}
    start = reader.latestOffset()
    log.rename(tmp_path / "a.log.1")
    log.write_text("new 1\nnew 2\nnew 3\n", encoding="utf-8")  # already longer than the old offset
    parts = reader.partitions(start, reader.latestOffset())
    assert [v for p in parts for (v,) in reader.read(p)] == ["new 1", "new 2", "new 3"]


def test_whole_line_and_instants(spark, tmp_path):
    lines = ['{"timestamp": "2024-05-30T23:30:00-0500", "rule": {"id": "1", "firedtimes": 3}}',
             '{"timestamp": "2024-05-30T23:30:00-0500", "rule": {"id": "1", "firedtimes": 4}, "manager": {"name": "m"}}',
             '{"id": "x", "timestamp": "yesterday", "rule": {"level": "7.9"}}']
    (tmp_path / "a.json").write_text("\n".join(lines) + "\n", encoding="utf-8")
    raw = src.read_whole_alerts(spark, str(tmp_path / "a.json"))
    ids = [r.alert_id for r in nz.normalise(raw).collect()]
    assert len(set(ids)) == 3 and ids == [r.alert_id for r in nz.normalise(raw).collect()]
    named = raw.withColumn("id", F.coalesce("id", F.sha2("line", 256)))
    path = str(tmp_path / "table")
    stores.save_alerts(spark, stores.alert_records(named), path)
    table = spark.read.parquet(path)
    assert {r.raw_data for r in table.collect()} == set(lines)
    assert stores.stored_between(table, "2024-05-31T04:00", "2024-05-31T05:00").count() == 2
    assert stores.stored_between(table, "2024-05-30T23:00", "2024-05-31T00:00").count() == 0
    assert [(r.id, r.rule_level) for r in stores.stored_without_time(table).collect()] == [("x", 7)]
