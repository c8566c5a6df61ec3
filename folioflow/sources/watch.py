"""A folder tree as a stream of changes: files added, changed and removed.

    spark.dataSource.register(WatchSource)
    spark.readStream.format("folder_watch").option("path", tree).option("journal", shared).load()

Each listing that differs from the one before is written to the journal as a numbered
snapshot, and an offset is a number: the events between two offsets are the differences
of the snapshots between them, whenever and wherever these are read, so a replay gives
the same events. Snapshots are written in as many slices, by path, as tasks read them.
Both folders must be ones that the driver and all executors mount.
"""

from __future__ import annotations

import datetime
import json
import os
import zlib

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..streaming.events import IGNORED, WATCHED

#: Slices of a snapshot where no option says otherwise.
SLICES = 8


def listed(root: str) -> dict[str, tuple[int, int]]:
    """Watched files below ``root`` by relative path: size and time of change in
    microseconds. Folders with ignored names, and links to folders, aren't entered."""
    out, todo = {}, [root]
    while todo:
        try:
            entries = list(os.scandir(todo.pop()))
        except (FileNotFoundError, NotADirectoryError):
            continue  # gone meanwhile
        for e in entries:
            try:
                if e.is_dir(follow_symlinks=False):
                    if e.name not in IGNORED:
                        todo.append(e.path)
                elif e.name not in IGNORED and os.path.splitext(e.name)[1].lower() in WATCHED:
                    s = e.stat()
                    out[os.path.relpath(e.path, root)] = (s.st_size, s.st_mtime_ns // 1000)
            except FileNotFoundError:
                continue
    return out


class _Journal:
    """Snapshots in a folder: <n>/<slice>.json, and <n>/done once whole."""

    def __init__(self, folder: str, slices: int):
        self.folder, self.slices = folder, slices

    def last(self) -> int:
        names = os.listdir(self.folder) if os.path.isdir(self.folder) else []
        return max([0, *(int(n) for n in names if n.isdigit() and os.path.exists(f"{self.folder}/{n}/done"))])

    def slice(self, n: int, k: int) -> dict:
        if n == 0:
            return {}
        with open(f"{self.folder}/{n}/{k}.json") as f:
            return {path: tuple(s) for path, s in json.load(f).items()}

    def taken(self, n: int) -> int:
        """When the snapshot was taken, in microseconds."""
        with open(f"{self.folder}/{n}/done") as f:
            return int(f.read())

    def write(self, n: int, files: dict, now: int) -> None:
        parts = [{} for _ in range(self.slices)]
        for path, said in files.items():
            parts[zlib.crc32(path.encode("utf-8", "surrogatepass")) % self.slices][path] = said
        os.makedirs(f"{self.folder}/{n}", exist_ok=True)
        for k, part in enumerate(parts):
            with open(f"{self.folder}/{n}/{k}.json", "w") as f:
                json.dump(part, f)
        with open(f"{self.folder}/{n}/done.part", "w") as f:
            f.write(str(now))
        os.replace(f"{self.folder}/{n}/done.part", f"{self.folder}/{n}/done")


class _Slice(InputPartition):
    def __init__(self, start: int, end: int, k: int):
        self.start, self.end, self.k = start, end, k


class _Reader(DataSourceStreamReader):
    def __init__(self, options):
        self.root = os.path.abspath(options["path"])
        self.slices = int(options.get("slices", SLICES))
        self.journal = _Journal(options["journal"], self.slices)
        self.initial = options.get("initial", "false").lower() == "true"

    def _look(self) -> int:
        last, files = self.journal.last(), listed(self.root)
        if last and files == {p: s for k in range(self.slices) for p, s in self.journal.slice(last, k).items()}:
            return last
        now = int(datetime.datetime.now(datetime.timezone.utc).timestamp() * 1e6)
        self.journal.write(last + 1, files, now)
        return last + 1

    def initialOffset(self) -> dict:
        # Files that are there at the start are no events, unless asked for.
        return {"snapshot": 0 if self.initial else self.journal.last() or self._look()}

    def latestOffset(self) -> dict:
        return {"snapshot": self._look()}

    def partitions(self, start: dict, end: dict):
        return [_Slice(start["snapshot"], end["snapshot"], k) for k in range(self.slices)]

    def read(self, part: _Slice):
        name, before = os.path.basename(self.root), self.journal.slice(part.start, part.k)
        for n in range(part.start + 1, part.end + 1):
            after, at = self.journal.slice(n, part.k), self.journal.taken(n)
            for path in sorted(before.keys() | after.keys()):
                old, new = before.get(path), after.get(path)
                if old == new:
                    continue
                kind = "unlink" if new is None else "add" if old is None else "change"
                when = datetime.datetime.fromtimestamp(at / 1e6, datetime.timezone.utc)
                yield (f"{n}:{path}", when, name, path, kind, None if new is None else new[0])
            before = after

    def commit(self, end: dict) -> None:
        """Snapshots stay: they are what a replay reads. ``pruned`` deletes old ones."""


class WatchSource(DataSource):
    """Options: path (the tree), journal (a folder for snapshots), slices, and initial
    (true: files that are there at the start are added ones)."""

    @classmethod
    def name(cls) -> str:
        return "folder_watch"

    def schema(self) -> str:
        return "event_id string, ts timestamp, folder string, path string, type string, size long"

    def streamReader(self, schema):
        return _Reader(self.options)


def pruned(journal: str, before: int) -> None:
    """Deletes snapshots with numbers under ``before``, which no checkpoint starts from."""
    for n in os.listdir(journal):
        if n.isdigit() and int(n) < before:
            for name in os.listdir(f"{journal}/{n}"):
                os.remove(f"{journal}/{n}/{name}")
            os.rmdir(f"{journal}/{n}")
