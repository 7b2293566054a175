"""Session settings the jobs rely on, and the shared scratch area."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# AQE sizes the shuffle partitions at run time and splits skewed join inputs, so the
# static partition number only has to be high enough for the largest stage.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # sessions of a busy agent are merged in the map tasks, before the shuffle
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "sievewatch", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session; without ``master`` the cluster manager's own setting is used."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per Spark context.

    Functions that run in Python workers refer to their modules by name, and executors do not see
    the driver's folders. The zip travels through Spark's own file server.
    """
    sc = spark.sparkContext
    if not getattr(sc, "_sievewatch_shipped", False):
        home = os.path.dirname(os.path.abspath(__file__))
        if os.path.isdir(home):  # else it already runs from a shipped zip
            folder = tempfile.mkdtemp(prefix="sievewatch-code-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            name = os.path.join(folder, "sievewatch.zip")
            with zipfile.ZipFile(name, "w") as out:
                for top, _, files in os.walk(home):
                    for f in sorted(files):
                        if f.endswith(".py"):
                            path = os.path.join(top, f)
                            out.write(path, os.path.relpath(path, os.path.dirname(home)))
            sc.addPyFile(name)
        sc._sievewatch_shipped = True
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local-mode session (tests) may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = getattr(sc, "_sievewatch_tmp", None)
    if folder is None:
        folder = tempfile.mkdtemp(prefix="sievewatch-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc._sievewatch_tmp = folder
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def reliable_checkpoint(df, eager: bool = True):
    """``DataFrame.checkpoint`` on the shared folder: survives the loss of executors."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=eager)
