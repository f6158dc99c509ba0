"""A streaming source that follows growing, rotating text logs line by line.

Spark's own file source reads a file once, when it first sees it: lines that are appended later never
arrive.  This source keeps a byte offset per file as the stream's progress, so a checkpoint says exactly
which lines were read.
"""

from __future__ import annotations

import hashlib
import logging
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

log = logging.getLogger(__name__)

NAME = "log_tail"
#: Bytes before an offset that tell whether a file is still the one that was read.
MARK = 256
#: Bytes of the first line that name a file's content.
HEAD = 4096
BLOCK = 1 << 20
#: What rotation appends to a name: app.log becomes app.log.1 or app.log.2024-03-01.
ROTATED = re.compile(r"\.[0-9][0-9_.-]*$")


class Seen(NamedTuple):
    """How far a file was read: up to ``end``, the end of a line; digests of its first line and of what lies before ``end``."""

    end: int
    head: str
    mark: str


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:32]


def as_offset(files: dict[str, Seen]) -> dict:
    """Offsets as Spark keeps them; equal states give equal texts."""
    return {name: {"end": seen.end, "head": seen.head, "mark": seen.mark} for name, seen in sorted(files.items())}


def from_offset(offset: dict) -> dict[str, Seen]:
    return {name: Seen(int(seen["end"]), seen["head"], seen["mark"]) for name, seen in offset.items()}


def base_name(name: str) -> str:
    return ROTATED.sub("", name)


def at(file: BinaryIO, start: int, size: int) -> bytes:
    file.seek(start)
    return file.read(size)


def last_line_end(file: BinaryIO, size: int) -> int:
    """The end of the last whole line; 0 if there is none."""
    stop = size
    while stop > 0:
        start = max(0, stop - 65_536)
        found = at(file, start, stop - start).rfind(b"\n")
        if found >= 0:
            return start + found + 1
        stop = start
    return 0


def line_start(file: BinaryIO, place: int, first: int, last: int) -> int:
    """The first line that starts at ``place`` or later, where ``first`` and ``last`` are starts of lines."""
    if place <= first or place >= last:
        return min(max(place, first), last)
    start = place - 1
    while start < last:
        block = at(file, start, min(BLOCK, last - start))
        found = block.find(b"\n")
        if found >= 0:
            return start + found + 1
        if not block:
            break
        start += len(block)
    return last


class Folder:
    """A folder of logs, or one log with its rotated files, on any file system that all machines reach."""

    def __init__(self, path: str) -> None:
        if path.startswith("file:"):
            path = "/" + path[5:].lstrip("/")
        if "://" in path:
            self.files, self.path = fs.FileSystem.from_uri(path)
        else:
            self.files, self.path = fs.LocalFileSystem(), path
        self.path = self.path.rstrip("/")
        self.single = ""
        if self.files.get_file_info(self.path).type != fs.FileType.Directory:
            self.path, _, self.single = self.path.rpartition("/")

    def sizes(self) -> dict[str, int]:
        """Bytes of every log by name; hidden and compressed files are passed over."""
        found = {}
        for info in self.files.get_file_info(fs.FileSelector(self.path, recursive=not self.single, allow_not_found=True)):
            name = info.path[len(self.path) :].lstrip("/")
            hidden = any(part.startswith(("_", ".")) for part in name.split("/"))
            wanted = not self.single or base_name(name) == self.single or name == self.single
            if info.type == fs.FileType.File and wanted and not hidden and not name.endswith((".gz", ".zst", ".crc")):
                found[name] = info.size
        return found

    def open(self, name: str) -> BinaryIO:
        return self.files.open_input_file(f"{self.path}/{name}")

    def look(self, name: str, size: int) -> Seen | None:
        """A file up to its last whole line; None if it has none, or has just been cut or renamed."""
        try:
            with self.open(name) as file:
                end = last_line_end(file, size)
                if not end:
                    return None
                return Seen(end, self.head(file, end), digest(at(file, max(0, end - MARK), min(end, MARK))))
        except OSError:
            return None

    @staticmethod
    def head(file: BinaryIO, end: int) -> str:
        return digest(at(file, 0, min(end, HEAD)).partition(b"\n")[0])

    def holds(self, name: str, seen: Seen) -> bool:
        """Whether a file is the one that was read up to ``seen.end``."""
        try:
            with self.open(name) as file:
                if file.size() < seen.end or self.head(file, seen.end) != seen.head:
                    return False
                return digest(at(file, max(0, seen.end - MARK), min(seen.end, MARK))) == seen.mark
        except OSError:
            return False

    def find(self, name: str, seen: Seen) -> str | None:
        """The name that a file has now."""
        if self.holds(name, seen):
            return name
        others = sorted(self.sizes(), key=lambda other: (base_name(other) != base_name(name), other))
        return next((other for other in others if other != name and self.holds(other, seen)), None)


@dataclass
class Piece(InputPartition):
    """Whole lines of one file from byte ``first`` to ``last``; this task reads those that start in [start, stop)."""

    path: str
    name: str
    seen: Seen
    first: int
    last: int
    start: int
    stop: int


class TailReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.strict = options.get("failOnDataLoss", "true").lower() == "true"
        self.bytes = int(options.get("bytesPerTask", 64 << 20))
        self.known: dict[str, tuple[int, Seen | None]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """All files up to their last whole lines.

        A rotation during the listing could hide a file, so the folder is listed until two looks agree.
        """
        folder = Folder(self.path)
        names: set[str] | None = None
        sizes = folder.sizes()
        for _ in range(10):
            if names == set(sizes):
                break
            names, sizes = set(sizes), folder.sizes()
        now: dict[str, tuple[int, Seen | None]] = {}
        for name, size in sizes.items():
            before = self.known.get(name)
            unchanged = before is not None and before[0] == size and (before[1] is None or folder.holds(name, before[1]))
            now[name] = before if unchanged else (size, folder.look(name, size))
        self.known = now
        return as_offset({name: seen for name, (_, seen) in now.items() if seen is not None})

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        """New lines of every file, in pieces; a renamed file goes on where it was.

        A file is known by what lies before its offset.  Names are tried first; what is left is looked for among the
        offsets of files whose name now holds something else, and of copies that a rotation has just made.
        """
        folder, before, after = Folder(self.path), from_offset(start), from_offset(end)
        changed = {name: seen for name, seen in after.items() if before.get(name) != seen}
        starts: dict[str, int] = {}
        places: dict[str, str] = {}
        for name, seen in changed.items():
            place = folder.find(name, seen)
            if place is None:
                if self.strict:
                    raise FileNotFoundError(f"{name} of {self.path} went before its lines up to byte {seen.end} were read")
                log.warning("%s of %s went before its lines up to byte %d were read", name, self.path, seen.end)
                continue
            places[name] = place
        goes_on = {name: before[name] == seen for name, seen in after.items() if name in before}
        for name, place in places.items():
            own = before.get(name)
            if own is not None and own.end <= changed[name].end and own.head == changed[name].head and folder.holds(place, own):
                starts[name], goes_on[name] = own.end, True
        for name, place in places.items():
            if name in starts:
                continue
            former = [
                own.end
                for other, own in before.items()
                if other != name and own.head == changed[name].head and own.end <= changed[name].end
                and (not goes_on.get(other) or base_name(other) == base_name(name))
                and folder.holds(place, own)
            ]
            starts[name] = max(former, default=0)
        pieces = []
        for name, first in starts.items():
            last = changed[name].end
            for cut in range(first, last, self.bytes):
                pieces.append(Piece(self.path, places[name], changed[name], first, last, cut, min(cut + self.bytes, last)))
        return pieces

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        folder = Folder(partition.path)
        name = folder.find(partition.name, partition.seen)
        if name is None:
            if self.strict:
                raise FileNotFoundError(f"{partition.name} of {partition.path} went while it was read")
            return
        with folder.open(name) as file:
            place = line_start(file, partition.start, partition.first, partition.last)
            stop = line_start(file, partition.stop, partition.first, partition.last)
            rest = b""
            while place < stop:
                block = at(file, place, min(BLOCK, stop - place))
                if not block:
                    raise OSError(f"{name} of {partition.path} was cut while it was read")
                place += len(block)
                *whole, rest = (rest + block).split(b"\n")
                if whole:
                    lines = [line.removesuffix(b"\r").decode("utf-8", "replace") for line in whole]
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])


class LogTail(DataSource):
    """``value``: the lines of all logs under ``path``, each once, as files grow and are renamed."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "value string"

    def streamReader(self, schema) -> TailReader:
        return TailReader(dict(self.options))


def tail_lines(spark: SparkSession, path: str, bytes_per_task: int = 64 << 20, fail_on_loss: bool = True) -> DataFrame:
    """``value``: whole lines of a folder of logs, or of one log and its rotated files, as a stream.

    Lines that are appended arrive with the next batch, a line that is half written once its end is there.
    The stream's progress holds an offset per file, so a restart goes on where it was.  A file that is
    renamed goes on under its new name, a name that is written anew begins at its start, and so does one that
    was emptied.  A long stretch is read by many tasks.

    A file is known by its first line and the last 256 bytes that were read, so a log must not be written anew with the same
    bytes.  Lines that go before any batch saw them cannot be missed; lines of a batch that go before they
    are read fail the stream, or are left out with a warning if ``fail_on_loss`` is false.  Compressed and hidden files are passed over.
    """
    spark.dataSource.register(LogTail)
    reader = spark.readStream.format(NAME).option("bytesPerTask", bytes_per_task)
    return reader.option("failOnDataLoss", str(fail_on_loss).lower()).load(path)
