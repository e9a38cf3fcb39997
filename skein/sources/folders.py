"""A Python data source that lists folders which all machines mount, in parallel, with what goes wrong as rows.

    spark.dataSource.register(Folders)
    spark.read.format("skein_folders").option("path", "/shared/documents").load()

The driver opens folders breadth first until there are `tasks` of them; from there each is a task of its own, which walks all
below it. Links are rows, but never followed; hidden names are left out; folders named in `skip` (lower case, parted by
slashes) aren't entered. A folder or file that can't be looked at is a row of the kind `error`: a scan with such rows did not
see everything. A file whose contents lie elsewhere, as its flags or its blocks say, is a placeholder.
"""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "path string, kind string, inode string, links long, size long, modified_ms long, placeholder boolean, error string"
_ARROW = pa.schema({"path": pa.string(), "kind": pa.string(), "inode": pa.string(), "links": pa.int64(), "size": pa.int64(), "modified_ms": pa.int64(), "placeholder": pa.bool_(), "error": pa.string()})
DATALESS, SPARSE = 0x40000000, 4096  # a flag of files whose contents are elsewhere; without flags, the least size of one without blocks
ROWS = 1024


def look(path: str) -> tuple:
    """One path as a row."""
    try:
        s = os.lstat(path)
    except OSError as e:
        return (path, "error", None, None, None, None, None, e.strerror or str(e))
    kind = "link" if stat.S_ISLNK(s.st_mode) else "folder" if stat.S_ISDIR(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else "other"
    away = bool(getattr(s, "st_flags", 0) & DATALESS) or (kind == "file" and s.st_size >= SPARSE and getattr(s, "st_blocks", 1) == 0)
    return (path, kind, f"{s.st_dev}:{s.st_ino}", s.st_nlink, s.st_size, s.st_mtime_ns // 1_000_000, away, None)


def entries(folder: str, skip: frozenset[str]) -> tuple[list[tuple], list[str]]:
    """The rows of a folder's own names, and the folders among them to enter."""
    try:
        with os.scandir(folder) as found:
            names = sorted(e.name for e in found if not e.name.startswith("."))
    except OSError as e:
        return [(folder, "error", None, None, None, None, None, e.strerror or str(e))], []
    rows = [look(os.path.join(folder, n)) for n in names]
    return [r for r in rows if r[1] not in ("folder", "other")], [r[0] for r in rows if r[1] == "folder" and os.path.basename(r[0]).lower() not in skip]


@dataclass
class Part(InputPartition):
    folder: str
    below: bool


class _Reader(DataSourceReader):
    def __init__(self, root: str, tasks: int, skip: frozenset[str]):
        self.root, self.tasks, self.skip = root, tasks, skip

    def partitions(self) -> list[Part]:
        opened: list[str] = []
        waiting = [self.root]
        while waiting and len(waiting) < self.tasks and len(opened) < self.tasks:
            folder = waiting.pop(0)
            opened.append(folder)
            waiting += entries(folder, self.skip)[1]
        return [Part(f, False) for f in opened] + [Part(f, True) for f in waiting]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        rows, waiting = [], [partition.folder]
        while waiting:
            own, below = entries(waiting.pop(), self.skip)
            rows += own
            waiting += below if partition.below else []
            while len(rows) >= ROWS:
                yield self._batch(rows[:ROWS])
                rows = rows[ROWS:]
        yield self._batch(rows)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_ARROW)], schema=_ARROW)


class Folders(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skein_folders"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        skip = frozenset(s for s in self.options.get("skip", "").split("/") if s)
        return _Reader(self.options["path"], int(self.options.get("tasks", 64)), skip)


def listing(spark: SparkSession, root: str, skip: tuple[str, ...] = (), tasks: int = 64) -> DataFrame:
    """What is below a mounted folder."""
    spark.dataSource.register(Folders)
    return spark.read.format("skein_folders").option("path", root).option("skip", "/".join(skip)).option("tasks", tasks).load()
