"""A Python data source that streams file events from a log; its position is an event's id.

The log is a mounted folder of files of JSON lines, as a watcher writes them: `id`, `path`, `flags` (bits) and `at` (seconds),
by ascending id within a file and from file to file. A restarted stream goes on with the event after the last one that was
committed, whatever files there are by then; files that hold nothing later aren't opened again.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Bits of an event's flags. The first five say that events may be missing, so that what is below must be scanned.
SCAN_BELOW, USER_DROPPED, KERNEL_DROPPED, IDS_WRAPPED, ROOT_CHANGED, REMOVED = 0x1, 0x2, 0x4, 0x8, 0x20, 0x200
RECOVER = SCAN_BELOW | USER_DROPPED | KERNEL_DROPPED | IDS_WRAPPED | ROOT_CHANGED
SCHEMA = "path string, event_id long, kind string, ts timestamp"


def kind(flags: int) -> str:
    return "recover" if flags & RECOVER else "delete" if flags & REMOVED else "upsert"


def _ends(path: str) -> tuple[int, int] | None:
    """The first and the last whole event's id of a file."""
    with open(path, "rb") as f:
        first = f.readline()
        if not first.endswith(b"\n"):
            return None
        size, back = f.seek(0, os.SEEK_END), 4096
        while True:  # the last line that ends
            f.seek(max(0, size - back))
            lines = f.read(min(size, back)).split(b"\n")[:-1]
            if len(lines) > 1 or back >= size:
                return json.loads(first)["id"], json.loads(lines[-1])["id"]
            back *= 2


class Slice(InputPartition):
    def __init__(self, path: str, after: int, upto: int):
        self.path, self.after, self.upto = path, after, upto


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str, since: int):
        self.folder, self.since = folder, since
        self.done = since
        self.known: dict[str, tuple[int, int, int]] = {}  # size, first and last id

    def _files(self) -> list[tuple[str, int, int]]:
        """Files with anything after what is committed, by their ids."""
        out = []
        for name in sorted(os.listdir(self.folder)) if os.path.isdir(self.folder) else []:
            path = os.path.join(self.folder, name)
            if name.startswith((".", "_")) or not os.path.isfile(path):
                continue
            size, old = os.path.getsize(path), self.known.get(path)
            if old is None or old[0] != size:
                ends = _ends(path)
                if ends is None:
                    continue
                old = self.known[path] = (size, *ends)
            if old[2] > self.done:
                out.append((path, old[1], old[2]))
        return sorted(out, key=lambda f: f[1])

    def initialOffset(self) -> dict:
        return {"event_id": self.since}

    def latestOffset(self) -> dict:
        """The last event that is there; what is written meanwhile waits for the next batch, as the query's trigger says."""
        return {"event_id": max([self.done, *(last for _, _, last in self._files())])}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Slice(p, start["event_id"], end["event_id"]) for p, first, last in self._files() if last > start["event_id"] and first <= end["event_id"]]

    def read(self, partition: Slice) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            for line in f:
                if not line.endswith(b"\n"):
                    break  # still being written
                e = json.loads(line)
                if partition.after < e["id"] <= partition.upto:
                    yield e["path"], e["id"], kind(e["flags"]), datetime.fromtimestamp(e["at"], timezone.utc)

    def commit(self, end: dict) -> None:
        self.done = max(self.done, end["event_id"])


class ChangeLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "skein_changes"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options["path"], int(self.options.get("since", 0)))
