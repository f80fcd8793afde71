"""Growing text files as a stream of records that end with CR LF.

A batch takes each file up to its last CR LF; what follows is not finished and waits for a later batch, so a
record, or the pair of CR and LF itself, is never cut where a write happened to end. Offsets are
bytes of each file, kept by the stream's checkpoint: a restart goes on where the last batch ended. A large
stretch is split at bytes; each part begins behind the first CR LF in it and ends behind the first one
after it, and is read in blocks.

Defined results: files are known by their names; one that shrinks or vanishes gives nothing more. Bytes that are no
UTF-8 are replaced. A bare LF or CR belongs to its record. Read as a table, the last record of a
file needs no CR LF. The folder must be mounted by driver and executors alike.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "file string, offset long, record string"
END = b"\r\n"
BLOCK = 1 << 20
PART = 64 << 20


@dataclass
class Stretch(InputPartition):
    """Records that start in bytes ``start`` to ``end`` of a file, of which ``upto`` bytes are finished."""

    path: str
    start: int
    end: int
    upto: int
    first: bool
    tail: bool = False


def last_end(path: str, start: int) -> int:
    """The byte behind the last CR LF of a file, ``start`` if there is none behind that; read from the end in blocks."""
    with open(path, "rb") as f:
        at = f.seek(0, os.SEEK_END)
        while at > start:
            low = max(start, at - BLOCK)
            f.seek(low)
            # One byte more, so that a pair on the bound of two blocks is seen.
            found = f.read(at - low + 1).rfind(END)
            if found >= 0:
                return low + found + len(END)
            at = low
    return start


def stretches(path: str, start: int, upto: int, part: int, tail: bool = False) -> list[Stretch]:
    return [Stretch(path, a, min(a + part, upto), upto, a == start, tail) for a in range(start, upto, part)]


def records(s: Stretch) -> Iterator[tuple[str, int, str]]:
    """The records of one stretch, as its file, its first byte and its text."""
    name = os.path.basename(s.path)
    with open(s.path, "rb") as f:
        # A part that isn't the first looks from one pair before its start, so that a record starting there is its own.
        at = s.start if s.first else max(s.start - len(END), 0)
        f.seek(at)
        held, begun = b"", s.first
        while True:
            block = f.read(min(BLOCK, s.upto - at - len(held)))
            held += block
            low = 0
            while (cut := held.find(END, low)) >= 0:
                if begun:
                    yield name, at + low, held[low:cut].decode("utf-8", "replace")
                begun, low = True, cut + len(END)
                if at + low >= s.end:
                    return
            at, held = at + low, held[low:]
            if not block:
                if held and begun and s.tail:
                    yield name, at, held.decode("utf-8", "replace")
                return


def files_of(path: str) -> list[str]:
    path = path.removeprefix("file://")
    return sorted(e.path for e in os.scandir(path) if e.is_file() and not e.name.startswith(("_", "."))) if os.path.isdir(path) else []


class RecordStream(DataSourceStreamReader):
    def __init__(self, path: str, part: int):
        self.path, self.part = path, part
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {"files": "{}"}

    def latestOffset(self) -> dict:
        for path in files_of(self.path):
            start = self.known.get(path, 0)
            if os.path.getsize(path) > start:
                self.known[path] = last_end(path, start)
        return {"files": json.dumps(self.known, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        before, after = json.loads(start["files"]), json.loads(end["files"])
        self.known = {**after, **self.known}
        return [x for path, upto in after.items() for x in stretches(path, before.get(path, 0), upto, self.part)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return records(partition)


class RecordTable(DataSourceReader):
    def __init__(self, path: str, part: int):
        self.path, self.part = path, part

    def partitions(self) -> list[Stretch]:
        return [x for path in files_of(self.path) for x in stretches(path, 0, os.path.getsize(path), self.part, tail=True)]

    def read(self, partition: Stretch) -> Iterator[tuple]:
        return records(partition)


class RecordFiles(DataSource):
    """``spark.readStream.format("crlf_records").option("path", folder)``, and ``spark.read`` likewise; ``part`` is the size of a stretch."""

    @classmethod
    def name(cls) -> str:
        return "crlf_records"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> RecordTable:
        return RecordTable(self.options["path"], int(self.options.get("part", PART)))

    def streamReader(self, schema: object) -> RecordStream:
        return RecordStream(self.options["path"], int(self.options.get("part", PART)))
