"""A folder as a stream: files that are created, changed and deleted, as rows."""

from __future__ import annotations

import fnmatch
import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "path string, event string, size long, modified_ns long"


def listing(root: str, pattern: str) -> dict[str, tuple[int, int]]:
    """{path below root: (size, time of the last change in ns)} of all files whose name matches; files that vanish meanwhile are left out."""
    out, todo = {}, [root]
    while todo:
        try:
            entries = list(os.scandir(todo.pop()))
        except FileNotFoundError:
            continue
        for e in entries:
            if e.is_dir(follow_symlinks=False):
                todo.append(e.path)
            elif fnmatch.fnmatch(e.name, pattern):
                try:
                    s = e.stat()
                except FileNotFoundError:
                    continue
                out[os.path.relpath(e.path, root)] = (s.st_size, s.st_mtime_ns)
    return out


def changes(before: dict, after: dict) -> Iterator[tuple[str, str, int, int]]:
    """(path, event, size, modified) between two listings, by path; of a deleted file as it was."""
    for path in sorted(before.keys() | after.keys()):
        old, new = before.get(path), after.get(path)
        if old is None or new is None or tuple(old) != tuple(new):
            event = "created" if old is None else "deleted" if new is None else "changed"
            yield (path, event, *(new or old))


class _Reader(SimpleDataSourceStreamReader):
    """Offsets are numbers of snapshots, which lie as files beside the checkpoint: a batch that is run again has the same rows."""

    def __init__(self, options: dict):
        self.root, self.kept, self.pattern = options["path"], options["snapshots"], options.get("pattern", "*")
        os.makedirs(self.kept, exist_ok=True)

    def _file(self, n: int) -> str:
        return os.path.join(self.kept, f"{n}.json")

    def _snapshot(self, n: int) -> dict:
        if n == 0:
            return {}
        with open(self._file(n), encoding="utf-8") as f:
            return json.load(f)

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        n = int(start["snapshot"])
        now = listing(self.root, self.pattern)
        found = list(changes(self._snapshot(n), now))
        if not found:
            return iter([]), start
        # Not planned yet, so a snapshot of this number that a crash left behind was never used.
        with open(self._file(n + 1) + ".new", "w", encoding="utf-8") as f:
            json.dump(now, f)
        os.replace(self._file(n + 1) + ".new", self._file(n + 1))
        return iter(found), {"snapshot": n + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        return changes(self._snapshot(int(start["snapshot"])), self._snapshot(int(end["snapshot"])))

    def commit(self, end: dict) -> None:
        for name in os.listdir(self.kept):
            number = name.removesuffix(".json")
            if number.isdigit() and int(number) < int(end["snapshot"]):
                os.remove(os.path.join(self.kept, name))


class FolderChanges(DataSource):
    """Options: path, the folder that is watched with all below it; snapshots, a folder of the query's own; pattern, of file names."""

    @classmethod
    def name(cls) -> str:
        return "folder_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def watch_folder(spark: SparkSession, path: str, snapshots: str, pattern: str = "*") -> DataFrame:
    """A streaming table (path, event, size, modified_ns): one row for each file that is created, changed or deleted between two looks.

    The first look finds all files created. What changes and changes back between two looks is not seen. The folder is
    listed by the driver, as a developer's workspace is; a listing is what the driver holds. snapshots belongs to one
    checkpoint: a query that starts again on both goes on where it was, without loss and without repeats.
    """
    spark.dataSource.register(FolderChanges)
    return spark.readStream.format("folder_changes").options(path=path, snapshots=snapshots, pattern=pattern).load()
