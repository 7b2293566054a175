"""Plan helpers against brute force, with hot keys."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievewatch.operators import detections as dt
from sievewatch.plans import nearest as nn
from sievewatch.plans.pruned import nearest_pruned
from sievewatch.plans.row_ids import with_row_ids
from sievewatch.plans.slabs import gaps, previous_value, range_sums


@pytest.fixture(scope="module")
def vectors(spark):
    """Clustered vectors with a third of the collection being copies of one vector."""
    rng = np.random.default_rng(3)
    centers = rng.normal(size=(12, 16)) * 4
    docs = np.vstack([centers[i % 12] + rng.normal(size=16) * 0.3 for i in range(400)])
    docs = np.vstack([docs, np.repeat(docs[:1], 200, axis=0)]).astype(np.float32)
    queries = np.vstack([docs[0], *[centers[i % 12] + rng.normal(size=16) for i in range(90)]])
    queries = queries.astype(np.float32)
    to_df = lambda m, key: spark.createDataFrame(
        [(f"{i:04d}", [float(x) for x in v]) for i, v in enumerate(m)],
        f"{key} STRING, embedding ARRAY<FLOAT>",
    )
    q64, d64 = queries.astype(np.float64), docs.astype(np.float64)
    want = set()
    for i, q in enumerate(q64):
        dist = np.round(((d64 - q) ** 2).sum(axis=1), 6)
        for rank, j in enumerate(np.lexsort((np.arange(len(d64)), dist))[:5], start=1):
            want.add((f"{i:04d}", f"{j:04d}", float(dist[j]), rank))
    return to_df(queries, "query_id"), to_df(docs, "id"), want


def rows(df):
    return {(r.query_id, r.id, r.distance, r["rank"]) for r in df.collect()}


def test_search_layouts_agree_with_brute_force(vectors):
    q, d, want = vectors
    assert rows(nn.nearest(q, d, 5)) == want
    assert rows(nn.nearest(q, d, 5, broadcast_bytes=20000)) == want  # queries are broadcast
    assert rows(nn.nearest(q, d, 5, broadcast_bytes=0, block_rows=64)) == want  # block grid


def test_pruned_search_is_exact(vectors):
    q, d, want = vectors
    assert rows(nearest_pruned(q, d, 5, n_clusters=12, block_rows=50)) == want
    few = nearest_pruned(q, d, 1000, n_clusters=5)
    assert few.count() == q.count() * d.count()


def test_pruned_search_sends_queries_once_to_a_group(vectors, monkeypatch):
    """Vectors without clusters open nearly all of them: a query is sent to the groups, not to each cluster."""
    from sievewatch.plans import pruned

    q, d, want = vectors
    assert pruned.groups_of({0: 3, 1: 4, 2: 25, 3: 1, 5: 2}, 10) == {0: (0, 1), 1: (0, 1), 2: (1, 3), 3: (4, 1), 5: (4, 1)}
    seen = []
    kept = pruned._best
    monkeypatch.setattr(pruned, "_best", lambda rows, k: kept(seen.append(rows) or rows, k))
    assert rows(nearest_pruned(q, d, 5, n_clusters=40, block_rows=1000)) == want  # one group: at most k rows of each pass
    assert seen[0].count() <= 5 * q.count() and seen[1].count() <= 2 * 5 * q.count() + 40 * q.count()
    assert rows(nearest_pruned(q, d, 5, n_clusters=40, block_rows=20)) == want


@pytest.mark.parametrize("k", [3, 400, 100_000])
def test_answers_are_held_in_slices(monkeypatch, k):
    rng = np.random.default_rng(5)
    q, d = rng.normal(size=(90, 8)), np.repeat(rng.normal(size=(200, 8)), 2, axis=0)
    ids = np.array([f"{i:03d}" for i in range(400)], dtype=object)
    monkeypatch.setattr(nn, "_ROWS", 1000)
    parts = list(nn.answers(q, d, ids, k))
    assert max(len(r) for r, _, _ in parts) <= 1000
    exact = np.round(((q[:, None, :] - d[None, :, :]) ** 2).sum(axis=2), 6)
    want = [(i, f"{j:03d}", exact[i, j]) for i in range(90) for j in np.lexsort((np.arange(400), exact[i]))[:k]]
    got = [x for p in parts for x in zip(*(a.tolist() for a in p), strict=True)]
    assert [g[:2] for g in got] == [w[:2] for w in want] and np.allclose([g[2] for g in got], [w[2] for w in want], atol=2e-6)


def test_blocks_bound_copies_and_answers():
    assert nn.block_rows_for(600_000, 600_000, 5, 12) == nn.MOST_BLOCK_ROWS  # each side is sent 19 times, not 147
    assert nn.block_rows_for(100, 100, 5, 12) == nn.BLOCK_ROWS
    assert nn.block_rows_for(600_000, 600_000, 100_000, 12) ** 2 <= 1 << 22  # answers of one cell


def test_search_plan_stays_local(vectors, capsys):
    q, d, _ = vectors
    nn.nearest(q, d, 5).explain("formatted")
    plan = capsys.readouterr().out
    assert "Exchange" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def hot_events(n=3000):
    rng = np.random.default_rng(5)
    second = np.sort(rng.integers(0, 40000, n))
    key = np.where(rng.random(n) < 0.4, "hot", [f"k{i}" for i in rng.integers(0, 30, n)])
    return pd.DataFrame({"key": key, "second": second, "seq": np.arange(n),
                         "value": rng.integers(0, 3, n)})


@pytest.mark.parametrize("before,after,slab", [(700, 300, 100), (60, 0, 3600), (5000, 5000, 10)])
def test_range_sums_equal_plain_window(spark, before, after, slab):
    pdf = hot_events().groupby(["key", "second"]).size().rename("n").reset_index()
    first = None if after else "first"
    out = range_sums(
        spark.createDataFrame(pdf), ["key"], {"total": "n"}, before=before, after=after,
        first=first, min_slab=slab,
    ).toPandas()
    assert len(out) == len(pdf)
    for r in out.sample(400, random_state=1).itertuples():
        near = pdf[(pdf.key == r.key) & pdf.second.between(r.second - before, r.second + after)]
        assert near.n.sum() == r.total
        assert first is None or near.second.min() == r.first


def test_previous_value_equals_plain_lag(spark):
    pdf = hot_events()
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_seconds("second"))
    out = previous_value(df, ["key"], ["ts", "seq"], "value", "ts", "prev", 500).toPandas()
    want = pdf.sort_values(["second", "seq"]).groupby("key").value.shift()
    got = out.set_index("seq").prev.reindex(pdf.seq)
    assert len(out) == len(pdf)
    assert (got.fillna(-1).to_numpy() == want.reindex(pdf.index).fillna(-1).to_numpy()).all()


def test_gaps_equal_plain_lag(spark):
    pdf = hot_events()
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_seconds("second"))
    got = {(r.key, r.last_seen, r.next_seen) for r in gaps(df, ["key"], "ts", 900).collect()}
    want = set()
    for key, part in pdf.groupby("key"):
        s = part.second.sort_values().to_numpy()
        want |= {(key, int(a), int(b)) for a, b in zip(s, s[1:]) if b - a > 900}
    assert got == want and got


def test_row_ids_are_dense_and_ordered(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"))
    out = with_row_ids(df, ["v"], start=10).orderBy("id").collect()
    assert [r.id for r in out] == list(range(11, 5011))
    assert [r.v for r in out] == sorted(r.v for r in out)


def test_row_ids_with_many_equal_rows(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("v"))
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")  # small partitions would be put together again
    try:
        out = with_row_ids(df.repartition(6), ["v"])
        assert sorted(r.id for r in out.collect()) == list(range(1, 4001))
        sizes = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set(key, "true")
    assert max(r["count"] for r in sizes) < 2500


def failures(spark, seconds, source="1.2.3.4"):
    return spark.createDataFrame([(source, s) for s in seconds], "src_ip STRING, s LONG").withColumn(
        "ts", F.timestamp_seconds("s"))


def test_brute_force_defaults(spark):
    nine = failures(spark, [1000 + i for i in range(9)])
    got = dt.brute_force(nine).collect()
    assert [(r.attempts, r.timespan_seconds) for r in got] == [(9, 8)]
    assert dt.brute_force(failures(spark, [1000 + i for i in range(8)])).count() == 0
    assert dt.brute_force(failures(spark, [1000 + 8 * i for i in range(9)])).count() == 0
    assert dt.brute_force(failures(spark, [3595 + i for i in range(9)])).count() == 1  # slab border
    assert dt.brute_force(failures(spark, [77] * 9)).first().attempts == 9
    assert dt.brute_force_windows(nine).count() >= 1


def test_file_rules(spark):
    ev = spark.createDataFrame(
        [("h", "/etc/a", "x", 0, 1), ("h", "/etc/a", "x", 5000, 2), ("h", "/etc/a", "y", 9000, 3),
         ("h", "/etc/a", "y", 9000, 3), ("h", "/etc/b.log", "q", 9000, 4), ("g", "/etc/a", "z", 1, 5)],
        "host STRING, path STRING, hash STRING, s LONG, seq LONG",
    ).withColumn("ts", F.timestamp_seconds("s"))
    got = [(r.host, r.seq, r.old_hash, r.new_hash) for r in dt.file_changes(ev).collect()]
    assert got == [("h", 3, "x", "y")]
    assert {r.seq for r in dt.drop_ignored(ev).collect()} == {1, 2, 3, 5}
    busy = spark.range(11).select(
        F.lit("h").alias("host"), F.lit("/p").alias("path"), F.timestamp_seconds(F.col("id") * 300)
        .alias("ts"))
    assert dt.frequent_changes(busy).first().max_changes == 11
    assert dt.frequent_changes(busy.limit(10)).count() == 0
    assert dt.without_frequent(busy).count() == 0


def test_log_rules(spark):
    lines = spark.createDataFrame([
        ("Feb 03 04:05:06 relay sshd[211]: error: maximum authentication attempts exceeded for olga "
         "from 203.0.113.8 port 50022 ssh2",),
        ("ossec: output: 'df -P': /dev/vda2 40G 37G 3G 92% /",),
        ("ossec: output: 'df -P': /dev/vdb1 80G 69G 11G 86% /srv",),
        ("ossec: rootcheck: Hidden PID detected: 8806. Process not visible in /proc filesystem.",),
    ], "raw_log STRING")
    ssh = dt.decode_sshd(lines).where("ip IS NOT NULL").first()
    assert (ssh.user, ssh.ip, ssh.port, ssh.service, ssh.process) == (
        "olga", "203.0.113.8", 50022, "ssh2", "sshd")
    disks = {(r.mount, r.usage_percent, r.state) for r in dt.disk_alerts(lines).collect()}
    assert disks == {("/", 92, "full"), ("/srv", 86, "high")}
    assert [r.hidden_pid for r in dt.rootkit_signs(lines).collect()] == [8806]


def test_limits_per_period(spark):
    df = spark.range(60).select(
        F.format_string("%03d", "id").alias("alert_id"), F.lit(12).alias("rule_level"),
        F.timestamp_seconds(F.col("id") * 120).alias("ts"))
    assert dt.mail_queue(df).groupBy("period").count().collect()[0]["count"] == 12
    assert dt.silent_agents(
        df.select(F.lit("a").alias("agent_name"), "ts").where("extract(minute from ts) not between 10 and 25"),
    ).count() == 2
    scan = spark.range(101).select(F.lit("s").alias("src"), F.col("id").alias("port"),
                                   F.timestamp_seconds(F.lit(5)).alias("ts"))
    assert dt.port_scans(scan.unionByName(scan), "src", "port").first().ports == 101
    assert dt.port_scans(scan.limit(100), "src", "port").count() == 0


@pytest.mark.parametrize("layout", [{}, {"broadcast_bytes": 2000}, {"broadcast_bytes": 0, "block_rows": 5}])
def test_repeated_ids_in_every_layout(spark, layout):
    docs = [("d0", [0.0, 0.0]), ("d0", [1.0, 0.0]), ("d1", [5.0, 5.0])] + [(f"e{i}", [9.0 + i, 9.0]) for i in range(40)]
    asked = [("q", [0.0, 0.0]), ("q", [0.0, 0.0]), ("q", [5.0, 5.0]), (None, [1.0, 1.0]), ("n", None)]
    d = spark.createDataFrame(docs, "id STRING, embedding ARRAY<FLOAT>")
    q = spark.createDataFrame(asked, "query_id STRING, embedding ARRAY<FLOAT>")
    got = sorted((r.query_id, r.rank, r.id, r.distance) for r in nn.nearest(q, d, 2, **layout).collect())
    assert got == [("q", 1, "d0", 0.0), ("q", 1, "d0", 0.0), ("q", 1, "d1", 0.0),
                   ("q", 2, "d0", 1.0), ("q", 2, "d0", 1.0), ("q", 2, "e0", 32.0)]
    ragged = spark.createDataFrame([("a", [1.0]), ("b", [1.0, 2.0])], "id STRING, embedding ARRAY<FLOAT>")
    with pytest.raises(ValueError, match="different lengths"):
        nn.nearest(q, ragged, 2, **layout).collect()


def test_scan_holds_few_pairs(monkeypatch):
    import pyarrow as pa

    from sievewatch.plans import nearest as module

    rng = np.random.default_rng(4)
    queries, docs = rng.integers(0, 9, (30, 2)).astype(float), rng.integers(0, 9, (40, 2)).astype(float)
    names = np.array([f"q{i}" for i in range(30)], dtype=object)
    batches = [pa.RecordBatch.from_pydict({"id": [f"d{i}" for i in range(x, x + 20)], "vector": docs[x:x + 20].tolist()}) for x in (0, 20)]
    monkeypatch.setattr(module, "_CELLS", 100)
    out = list(module._scan(iter(batches), names, queries, 100_000))
    assert max(b.num_rows for b in out) <= 100
    rows = [(r["query_id"], r["id"], r["distance"]) for b in out for r in b.to_pylist()]
    assert sorted(rows) == sorted((f"q{i}", f"d{j}", float(((q - d) ** 2).sum())) for i, q in enumerate(queries) for j, d in enumerate(docs))


def test_large_k_does_not_shuffle_its_answers(spark, monkeypatch):
    """The vectors go to the queries: what is shuffled is the collection for each block, not a row for each pair."""
    rng = np.random.default_rng(8)
    docs = np.round(rng.normal(size=(90, 4)), 2).astype(np.float32)
    docs[40:60] = docs[3]  # ties
    asked = np.vstack([docs[:30], rng.normal(size=(11, 4))]).astype(np.float32)
    d = spark.createDataFrame([(f"d{i % 80:02d}", v.tolist()) for i, v in enumerate(docs)], "id STRING, embedding ARRAY<FLOAT>")  # ids that repeat
    q = spark.createDataFrame([(f"q{i % 35}", v.tolist()) for i, v in enumerate(asked)] + [(None, [0.0] * 4), ("n", None)], "query_id STRING, embedding ARRAY<FLOAT>")
    whole = rows_of(nn.nearest(q, d, 5000, broadcast_bytes=1 << 20))
    assert len(whole) == 41 * 90
    for blocks in (8192, 7):
        monkeypatch.setattr(nn, "WIDE_QUERIES", blocks)
        got = nn.nearest(q, d, 5000, broadcast_bytes=0)
        assert rows_of(got) == whole
        assert "Window" not in got._jdf.queryExecution().toString()
    # fewer than all, both ways to sort, beside the merge of blocks
    monkeypatch.setattr(nn, "BLOCK_ROWS", 20)
    monkeypatch.setattr(nn, "_ROWS", 64)
    for size in (1.0, 1e6):
        big_d, big_q = (x.withColumn("embedding", F.transform("embedding", lambda v: (v * size).cast("float"))) for x in (d, q))
        for k in (30, 70, 89):
            assert rows_of(nn.nearest(big_q, big_d, k, broadcast_bytes=0)) == rows_of(nn.nearest(big_q, big_d, k))
    few = nn.nearest(q, d.limit(0), 5000, broadcast_bytes=-1)
    assert few.count() == 0


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.id, r.distance) for r in df.collect())
