"""``tail`` data source: follow one growing text file from any Spark streaming query.

The offset is a byte position that always lies at a line end, with the identity of the file (its
inode), so a restarted query goes on without loss or repeat and a rotated file is read from its
start however long it has grown. Lines added to the old file after the last batch and before the
rotation are not seen; land rotated files in a folder where that matters. Every executor must be
able to open the path. A batch is cut into byte ranges which the executors read; the driver
looks only at the file size and the last bytes.
"""

from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

_STEP = 1 << 16


class ByteRange(InputPartition):
    def __init__(self, start: int, end: int):
        self.start = start
        self.end = end


def _last_line_end(path: str) -> int:
    """Position after the last line feed of the file, 0 if there is none."""
    if not os.path.exists(path):
        return 0
    with open(path, "rb") as f:
        pos = f.seek(0, os.SEEK_END)
        while pos > 0:
            step = min(_STEP, pos)
            f.seek(pos - step)
            found = f.read(step).rfind(b"\n")
            if found >= 0:
                return pos - step + found + 1
            pos -= step
    return 0


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, from_end: bool, range_bytes: int):
        self.path = path
        self.from_end = from_end
        self.range_bytes = range_bytes

    def _file(self) -> int:
        return os.stat(self.path).st_ino if os.path.exists(self.path) else 0

    def initialOffset(self) -> dict:
        return {"byte": _last_line_end(self.path) if self.from_end else 0, "file": self._file()}

    def latestOffset(self) -> dict:
        return {"byte": _last_line_end(self.path), "file": self._file()}

    def partitions(self, start: dict, end: dict):
        first, last = start["byte"], end["byte"]
        # another file, or a cut one, took its place: begin with its first line
        other = start.get("file", 0) not in (0, end.get("file", 0))
        if last < first or other:
            first = 0
        return [
            ByteRange(pos, min(pos + self.range_bytes, last))
            for pos in range(first, last, self.range_bytes)
        ]

    def read(self, partition: ByteRange):
        # a line belongs to the range in which it starts
        with open(self.path, "rb") as f:
            if partition.start > 0:
                f.seek(partition.start - 1)
                if f.read(1) != b"\n":
                    f.readline()
            while f.tell() < partition.end:
                line = f.readline()
                if not line.endswith(b"\n"):
                    break
                yield (line.decode("utf-8", errors="replace").rstrip("\r\n"),)


class TailSource(DataSource):
    """Options: ``path``, ``from`` (``start`` or ``end``), ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "value STRING"

    def streamReader(self, schema: StructType) -> TailReader:
        return TailReader(
            self.options["path"],
            self.options.get("from", "end") == "end",
            int(self.options.get("rangeBytes", 64 << 20)),
        )


def stream_tail(spark, path: str, start: str = "end", range_bytes: int = 64 << 20):
    """Lines added to ``path``; ``start`` is where a new query begins."""
    spark.dataSource.register(TailSource)
    return (
        spark.readStream.format("tail")
        .option("path", path).option("from", start).option("rangeBytes", str(range_bytes))
        .load()
    )
