"""A directory as a stream of changes: created, modified and deleted files.

Spark's file source sees new files only; this source compares listings.  The
offset is the number of the listing, and the events of each are kept until they
are committed, so that a batch can be read again.
"""

from __future__ import annotations

import os

from pyspark.sql.datasource import DataSource, InputPartition, SimpleDataSourceStreamReader

from ..sources.files import DOCUMENTS, EXTENSIONS, MEDIA, SKIPPED

_CODE = {e for es in EXTENSIONS.values() for e in es}


def kind_of(path: str) -> str | None:
    ext = os.path.splitext(path)[1].lower()
    return "code" if ext in _CODE else "document" if ext in DOCUMENTS else "media" if ext in MEDIA else None


def listing(root: str) -> dict[str, tuple]:
    """Path to (size, mtime, device, inode, ctime) of the files that matter."""
    out = {}
    for top, dirs, names in os.walk(root):
        dirs[:] = [d for d in dirs if d not in SKIPPED]
        for n in names:
            path = os.path.join(top, n)
            if kind_of(path):
                try:
                    s = os.stat(path)
                except OSError:
                    continue
                out[os.path.relpath(path, root)] = (s.st_size, s.st_mtime_ns, s.st_dev, s.st_ino, s.st_ctime_ns)
    return out


def compare(old: dict[str, tuple], new: dict[str, tuple]) -> list[tuple[str, str, str]]:
    """(path, change, kind) in path order."""
    out = [(p, "Created" if p not in old else "Modified", kind_of(p)) for p in new if old.get(p) != new[p]]
    out += [(p, "Deleted", kind_of(p)) for p in old.keys() - new.keys()]
    return sorted(out)


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, root: str):
        self.root, self.seen, self.log = root, listing(root), {}

    def initialOffset(self):
        return {"listing": 0}

    def read(self, start):
        now = listing(self.root)
        rows = compare(self.seen, now)
        self.seen = now
        end = {"listing": start["listing"] + bool(rows)}
        if rows:
            self.log[start["listing"]] = rows
        return iter(rows), end

    def readBetweenOffsets(self, start, end):
        return iter([r for k in range(start["listing"], end["listing"]) for r in self.log.get(k, [])])

    def commit(self, end):
        for k in [k for k in self.log if k < end["listing"]]:
            del self.log[k]


class ChangesSource(DataSource):
    """``spark.readStream.format("weft_changes").load(root)``: path, change, kind; the first listing is silent."""

    @classmethod
    def name(cls):
        return "weft_changes"

    def schema(self):
        return "path string, change string, kind string"

    def simpleStreamReader(self, schema):
        return _Reader(self.options["path"])


__all__ = ["ChangesSource", "InputPartition", "compare", "kind_of", "listing"]
