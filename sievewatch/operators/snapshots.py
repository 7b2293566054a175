"""Tables whose versions appear at once: data is written beside the old one, then a pointer is created.

A table folder holds data folders (``data-...``, Parquet) and ``_versions``, one small JSON file for each version: the data folders that belong to
it, the largest running id, and which batches of which writer it contains. A version exists when its pointer exists. A writer that is
killed before leaves data that no version names, at worst with an empty pointer that readers pass over; a batch that is run again finds itself in the pointer and adds nothing; of two writers
that make the same version, one creates the pointer and the other starts over from it. Pointers go through Hadoop's file
system, so the folder may lie in any store that can create a file only if it is not there.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Data folders of one version; the next commit merges them. Batches that a pointer remembers for each writer.
MOST_FOLDERS, MOST_BATCHES = 40, 1000
GRACE_SECONDS = 30  # after which a pointer that is still empty counts as left behind
_TRIES = 200


class Conflict(Exception):
    """Another writer has made the version."""


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    at = hadoop(f"{path.rstrip('/')}/_versions")
    return hadoop, at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all versions, rising."""
    _, at, fs = _files(spark, path)
    if not fs.exists(at):
        return []
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(at) if s.getPath().getName().isdigit())


def _pointer(spark: SparkSession, path: str, version: int) -> dict | None:
    """What a pointer says; None while it is being written, or if its writer was killed then."""
    hadoop, at, fs = _files(spark, path)
    stream = fs.open(hadoop(at, str(version)))
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except json.JSONDecodeError:
        return None
    finally:
        stream.close()


def state(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """What the pointer of a version says; by default of the latest whole one, and that of an empty table if there is none."""
    for v in reversed([v for v in versions(spark, path) if version in (None, v)]):
        found = _pointer(spark, path, v)
        if found is not None:
            return found
    if version is not None:
        raise ValueError(f"{path} has no version {version}")
    return {"version": 0, "folders": [], "last_id": 0, "batches": {}}


def _next(spark: SparkSession, path: str) -> int:
    """The number of the next version. A pointer that is being written is waited for; one that stays empty was left by a killed writer."""
    hadoop, at, fs = _files(spark, path)
    known = versions(spark, path)
    if known and _pointer(spark, path, known[-1]) is None:
        age = time.time() - fs.getFileStatus(hadoop(at, str(known[-1]))).getModificationTime() / 1000
        if age < GRACE_SECONDS:
            time.sleep(0.2)
            raise Conflict(f"version {known[-1]} of {path} is being made")
    return known[-1] + 1 if known else 1


def _point(spark: SparkSession, path: str, new: dict) -> None:
    hadoop, at, fs = _files(spark, path)
    fs.mkdirs(at)
    try:
        stream = fs.create(hadoop(at, str(new["version"])), False)  # only one writer gets this file
    except Exception as e:
        raise Conflict(f"version {new['version']} of {path} is taken") from e
    try:
        stream.write(bytearray(json.dumps(new), "utf-8"))
    finally:
        stream.close()


def read(spark: SparkSession, path: str, ddl: str, version: int | None = None) -> DataFrame:
    """A version of the table (the latest one by default); no rows if there is none."""
    folders = state(spark, path, version)["folders"]
    if not folders:
        return spark.createDataFrame([], ddl)
    return spark.read.schema(ddl).parquet(*[f"{path.rstrip('/')}/{f}" for f in folders])


def commit(
    spark: SparkSession, path: str, make: Callable[[dict], tuple[DataFrame, int] | DataFrame], replace: bool = False,
    writer: str = "", batch: int | str | None = None,
) -> bool:
    """Add the rows of ``make(state)`` to the table, or put them in place of all others. False if the batch is there already.

    ``make`` gets the state the new version builds on and gives the rows, with the largest id if the table is numbered; it is called
    again when another writer was faster. ``batch`` names the input within its ``writer``.
    """
    for _ in range(_TRIES):
        try:
            version, old = _next(spark, path), state(spark, path)
            if batch is not None and str(batch) in old["batches"].get(writer, []):
                return False
            made = make(old)
            rows, last = made if isinstance(made, tuple) else (made, old["last_id"])
            folder = f"data-{uuid.uuid4().hex}"
            rows.write.parquet(f"{path.rstrip('/')}/{folder}")
            folders = [folder] if replace else [*old["folders"], folder]
            if len(folders) > MOST_FOLDERS:
                folder = f"data-{uuid.uuid4().hex}"
                spark.read.schema(rows.schema).parquet(*[f"{path.rstrip('/')}/{f}" for f in folders]).write.parquet(f"{path.rstrip('/')}/{folder}")
                folders = [folder]
            batches = {k: list(v) for k, v in old["batches"].items()}
            if batch is not None:
                batches[writer] = [*batches.get(writer, []), str(batch)][-MOST_BATCHES:]
            _point(spark, path, {"version": version, "folders": folders, "last_id": last, "batches": batches})
            return True
        except Conflict:
            continue
    raise Conflict(f"{path}: {_TRIES} versions were made by others")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Delete data that none of the ``keep`` latest versions names, and older pointers. Not while writers are at work. Folders deleted."""
    hadoop, at, fs = _files(spark, path)
    known = versions(spark, path)
    whole = [(v, p) for v in known if (p := _pointer(spark, path, v))][-keep:]
    used = {f for _, p in whole for f in p["folders"]}
    gone = 0
    for s in fs.listStatus(hadoop(path)):
        name = s.getPath().getName()
        if name.startswith("data-") and name not in used:
            gone += bool(fs.delete(s.getPath(), True))
    for v in known:
        if whole and v < whole[0][0]:
            fs.delete(hadoop(at, str(v)), False)
    return gone
