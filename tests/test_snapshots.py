"""Versioned tables: killed writers, repeated batches, two writers, old versions."""

import os
import threading

import pytest
from pyspark.sql import functions as F

from sievewatch.operators import snapshots, stores
from sievewatch.streaming import live

DDL = "k BIGINT"


def values(spark, path, version=None):
    return sorted(r.k for r in snapshots.read(spark, path, DDL, version).collect())


def put(spark, path, *ks, **how):
    return snapshots.commit(spark, path, lambda old: spark.createDataFrame([(k,) for k in ks], DDL), **how)


def test_versions_and_batches(spark, tmp_path):
    path = str(tmp_path / "t")
    assert values(spark, path) == [] and snapshots.versions(spark, path) == []
    assert put(spark, path, 1, 2, writer="a", batch=0)
    assert not put(spark, path, 1, 2, writer="a", batch=0)  # run again
    assert put(spark, path, 3, writer="b", batch=0)
    assert put(spark, path, 9, replace=True, writer="a", batch=1)
    assert [values(spark, path, v) for v in (1, 2, 3)] == [[1, 2], [1, 2, 3], [9]] and values(spark, path) == [9]
    assert not put(spark, path, 3, writer="b", batch=0)
    with pytest.raises(ValueError, match="no version"):
        snapshots.read(spark, path, DDL, 8)
    assert snapshots.vacuum(spark, path, keep=1) == 2 and values(spark, path) == [9]


def test_killed_writer(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    put(spark, path, 1)

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(snapshots, "_point", killed)  # after the data, before the pointer
        with pytest.raises(KeyboardInterrupt):
            put(spark, path, 2, writer="a", batch=5)
    assert values(spark, path) == [1]
    assert put(spark, path, 2, writer="a", batch=5) and values(spark, path) == [1, 2]
    # killed while the pointer was being written
    open(os.path.join(path, "_versions", "3"), "w").close()
    assert values(spark, path) == [1, 2]
    monkeypatch.setattr(snapshots, "GRACE_SECONDS", 0)
    assert put(spark, path, 3) and values(spark, path) == [1, 2, 3] and snapshots.versions(spark, path)[-1] == 4
    assert snapshots.vacuum(spark, path, keep=1) == 1 and values(spark, path) == [1, 2, 3]


def test_many_commits_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots, "MOST_FOLDERS", 3)
    path = str(tmp_path / "t")
    for k in range(8):
        put(spark, path, k, writer="w", batch=k)
    assert values(spark, path) == list(range(8)) and len(snapshots.state(spark, path)["folders"]) <= 3


def test_two_writers_never_share_an_id(spark, tmp_path):
    path = str(tmp_path / "reports")

    def save(name):
        rows = spark.range(7).select(
            F.concat(F.lit(name), F.col("id").cast("string")).alias("alert_id"), F.lit("LOW").alias("severity"), F.lit("h").alias("agent_name"),
            F.lit("text").alias("report_text"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
        for batch in (0, 1, 1):
            stores.save_reports(spark, rows, path, batch, name)

    threads = [threading.Thread(target=save, args=(n,)) for n in "ab"]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    got = stores.saved_reports(spark, path)
    assert sorted(r.id for r in got.collect()) == list(range(1, 29))
    assert got.groupBy("alert_id").count().where("count = 2").count() == 14


def test_latest_table_keeps_what_readers_use(spark, tmp_path):
    path = str(tmp_path / "t")
    write = live.latest_table(path)
    write(spark.createDataFrame([(1,)], DDL), 0)
    begun = snapshots.read(spark, path, DDL)
    write(spark.createDataFrame([(2,)], DDL), 1)
    write(spark.createDataFrame([(3,)], DDL), 1)  # the batch is there already
    assert [r.k for r in begun.collect()] == [1] and values(spark, path) == [2]
