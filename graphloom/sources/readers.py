"""Sources by format name: `register(spark)`, then spark.read.format("notes" | "session_lines" | "chat_archive").load(folder), and
spark.readStream.format("session_lines").load(folder) for files that grow.

Files are listed once, where the scan is planned; a partition is about `bytes` of them (an option, 64 MB unless given), so many
small notes share a task and a long file of lines is many tasks. Filters on path and time are applied to the listing, so what they
exclude is never opened. Paths are relative to the folder.

Lines: a row is (path, at, value), where `at` is the byte at which the line begins, which names it for good. A line counts once
its end is written; a last line without one counts if it is a whole JSON object. The stream's offset is the number of bytes of each file that have
been read, so lines appended to a file come once, also over restarts. A file that became shorter is read anew.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringEndsWith, StringStartsWith

BYTES, BLOCK = 64 << 20, 1 << 20


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session; filters reach their readers from then on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Notes, SessionLines, ChatArchive):
        spark.dataSource.register(source)


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it; Hadoop's names for S3 mean the same store as s3."""
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), os.path.abspath(folder)
    return fs.FileSystem.from_uri(re.sub("^s3[an]://", "s3://", re.sub("^file:/+", "file:///", folder)))


@dataclass(frozen=True)
class Found:
    path: str
    mtime: datetime
    size: int


def listed(folder: str, ending: str) -> list[Found]:
    """The files below a folder (or the file itself) with an ending, by path."""
    store, base = store_of(folder)
    about = store.get_file_info(base)
    every = [about] if about.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    start = len(os.path.dirname(base) if about.type == fs.FileType.File else base.rstrip("/")) + 1
    return sorted((Found(f.path[start:], f.mtime.replace(tzinfo=timezone.utc) if f.mtime.tzinfo is None else f.mtime, f.size) for f in every if f.type == fs.FileType.File and f.path.endswith(ending)), key=lambda f: f.path)


def below(folder: str) -> str:
    """What relative paths are relative to."""
    store, base = store_of(folder)
    return os.path.dirname(base) if store.get_file_info(base).type == fs.FileType.File else base.rstrip("/")


@dataclass
class Part(InputPartition):
    """(path, first byte, byte after the last, mtime) of what one task reads."""

    pieces: list

    def __init__(self, pieces):
        super().__init__(0)
        self.pieces = pieces


def packed(files: list[Found], size: int) -> list[Part]:
    """Whole files, several to a partition; a file that is larger is alone."""
    out, now, total = [], [], 0
    for f in files:
        if now and total + f.size > size:
            out.append(Part(now))
            now, total = [], 0
        now.append((f.path, 0, f.size, f.mtime))
        total += f.size
    return out + [Part(now)] if now else out


def cut_up(ranges: list[tuple[str, int, int]], size: int) -> list[Part]:
    """Ranges of files, cut where they are longer than a partition and put together where they are shorter."""
    out, now, total = [], [], 0
    for path, start, end in ranges:
        while start < end:
            to = min(end, start + size - total)
            now.append((path, start, to, end))
            total, start = total + to - start, to
            if total >= size:
                out.append(Part(now))
                now, total = [], 0
    return out + [Part(now)] if now else out


def excludes(filter_, column: str, value) -> bool | None:
    """Whether a filter on this column excludes a value; None if it is about something else or not understood."""
    if tuple(filter_.attribute if hasattr(filter_, "attribute") else ()) != (column,):
        return None
    tests = {
        EqualTo: lambda v: value != v, GreaterThan: lambda v: not value > v, GreaterThanOrEqual: lambda v: not value >= v, LessThan: lambda v: not value < v,
        LessThanOrEqual: lambda v: not value <= v, In: lambda v: value not in v, StringStartsWith: lambda v: not value.startswith(v), StringEndsWith: lambda v: not value.endswith(v),
    }
    test = tests.get(type(filter_))
    return None if test is None else test(filter_.value)


class _Files(DataSourceReader):
    """Takes the filters on `path` and on the column that is a file's time; the rest is left to Spark."""

    ending, time = "", ""

    def __init__(self, options):
        self.folder, self.size = options["path"], int(options.get("bytes", BYTES))
        self.ignore = [p for p in options.get("ignore", "").split("\n") if p]
        self.filters: list[tuple[str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = ".".join(getattr(f, "attribute", ()))
            sample = datetime.now(timezone.utc) if column == self.time else ""
            if column in ("path", self.time) and column:
                try:
                    known = excludes(f, column, sample) is not None
                except TypeError:
                    known = False
                if known:
                    self.filters.append((column, f))
                    continue
            yield f

    def wanted(self) -> list[Found]:
        value = lambda f, column: f.path if column == "path" else f.mtime
        return [f for f in listed(self.folder, self.ending) if not ignored(f.path, self.ignore) and not any(excludes(x, c, value(f, c)) for c, x in self.filters)]

    def partitions(self):
        return packed(self.wanted(), self.size) or [Part([])]


def ignored(path: str, patterns: list[str]) -> bool:
    """Whether a relative path or its file name matches a glob; a pattern ending in / matches a folder."""
    for p in (p.strip() for p in patterns):
        if not p or p.startswith("#"):
            continue
        if p.endswith("/"):
            folders = path.split("/")[:-1]
            if any(fnmatch.fnmatchcase("/".join(folders[i:j]), p[:-1]) for i in range(len(folders)) for j in range(i + 1, len(folders) + 1)):
                return True
        elif any(fnmatch.fnmatchcase(path[i:], p) for i in [0, *[m.end() for m in re.finditer("/", path)]]):
            return True
    return False


class Notes(DataSource):
    """(path, mtime, domain, text) of Markdown notes; the domain is the first folder. Option `ignore`: globs, one a line."""

    @classmethod
    def name(cls):
        return "notes"

    def schema(self):
        return "path string, mtime timestamp, domain string, text string"

    def reader(self, schema):
        return NotesReader(self.options)


class NotesReader(_Files):
    ending, time = ".md", "mtime"

    def read(self, partition) -> Iterator[tuple]:
        base = below(self.folder)
        store, _ = store_of(self.folder)
        for path, _, _, mtime in partition.pieces:
            with store.open_input_file(f"{base}/{path}") as f:
                yield path, mtime, path.split("/")[0] if "/" in path else "default", f.read().decode("utf-8", "replace")


class ChatArchive(DataSource):
    """(path, modified, uuid, updated_at, conversation) of JSON archives, arrays of conversations; `conversation` is its JSON text.

    A file is read piece by piece and never held whole. Filters on path and on `modified`, the file's time, are pushed."""

    @classmethod
    def name(cls):
        return "chat_archive"

    def schema(self):
        return "path string, modified timestamp, uuid string, updated_at string, conversation string"

    def reader(self, schema):
        return ChatArchiveReader(self.options)


class ChatArchiveReader(_Files):
    ending, time = ".json", "modified"

    def read(self, partition) -> Iterator[tuple]:
        base = below(self.folder)
        store, _ = store_of(self.folder)
        for path, _, _, mtime in partition.pieces:
            with store.open_input_file(f"{base}/{path}") as f:
                for talk, raw in objects(f):
                    yield path, mtime, talk.get("uuid"), talk.get("updated_at"), raw


def objects(f, block: int = BLOCK) -> Iterator[tuple[dict, str]]:
    """The objects of a JSON array, or one after another, each with its text: their ends are found by counting brackets outside strings."""
    depth, inside, escaped, own = 0, False, False, bytearray()
    while raw := f.read(block):
        start = 0 if depth else None
        for at, c in enumerate(raw):
            if inside:
                if escaped:
                    escaped = False
                elif c == 0x5C:
                    escaped = True
                elif c == 0x22:
                    inside = False
            elif c == 0x22:
                inside = True
            elif c == 0x7B:
                if not depth:
                    start = at
                depth += 1
            elif c == 0x7D and depth:
                depth -= 1
                if not depth:
                    own += raw[start : at + 1]
                    text = own.decode("utf-8", "replace")
                    own, start = bytearray(), None
                    try:
                        yield json.loads(text), text
                    except ValueError:
                        pass
        if depth and start is not None:
            own += raw[start:]


class SessionLines(DataSource):
    """(path, at, value): the lines of .jsonl files, as a batch or as a stream."""

    @classmethod
    def name(cls):
        return "session_lines"

    def schema(self):
        return "path string, at long, value string"

    def reader(self, schema):
        return LinesReader(self.options)

    def streamReader(self, schema):
        return LinesStream(self.options)


def complete(store: fs.FileSystem, path: str, start: int, size: int) -> int:
    """The byte behind the last line that counts; only the end of the file is read, and no byte before `start`."""
    with store.open_input_file(path) as f:
        tail, at = b"", size
        while at > start:
            step = min(BLOCK, at - start)
            f.seek(at - step)
            tail, at = f.read(step) + tail, at - step
            if b"\n" in tail:
                break
    last = tail.rfind(b"\n") + 1
    rest = tail[last:]
    try:
        if rest.strip() and isinstance(json.loads(rest), dict):
            return at + len(tail)
    except ValueError:
        pass
    return at + last if last else start


def lines_of(store: fs.FileSystem, path: str, start: int, to: int, end: int, first: bool) -> Iterator[tuple[int, str]]:
    """(at, line) of the lines that begin in [start, to); the last of them may reach up to `end`. `first`: a line begins at start."""
    with store.open_input_file(path) as f:
        at = start if first else start - 1
        f.seek(at)
        held, searching = b"", not first
        while at + len(held) < end and (at < to or searching):
            raw = f.read(min(BLOCK, end - at - len(held)))
            if not raw:
                break
            held += raw
            while (stop := held.find(b"\n")) >= 0:
                if searching:
                    searching = False
                elif at < to:
                    yield at, held[:stop].decode("utf-8", "replace")
                at, held = at + stop + 1, held[stop + 1 :]
                if at >= to:
                    return
        if held and not searching and at < to:
            yield at, held.decode("utf-8", "replace")


class _Lines:
    def __init__(self, options):
        self.folder, self.size = options["path"], int(options.get("bytes", BYTES))

    def _read(self, partition, firsts):
        base = below(self.folder)
        store, _ = store_of(self.folder)
        for path, start, to, end in partition.pieces:
            rows = [(path, at, line) for at, line in lines_of(store, f"{base}/{path}", start, to, end, start in firsts.get(path, (0,))) if line.strip()]
            if rows:
                paths, ats, lines = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(ats, pa.int64()), pa.array(lines, pa.string())], names=["path", "at", "value"])


class LinesReader(_Lines, DataSourceReader):
    def partitions(self):
        store, base = store_of(self.folder)[0], below(self.folder)
        return cut_up([(f.path, 0, complete(store, f"{base}/{f.path}", 0, f.size)) for f in listed(self.folder, ".jsonl")], self.size) or [Part([])]

    def read(self, partition):
        return self._read(partition, {})


class LinesStream(_Lines, DataSourceStreamReader):
    """Offsets are {path: bytes read}."""

    def __init__(self, options):
        super().__init__(options)
        self.known: dict[str, int] = {}
        self.firsts: dict[str, tuple] = {}

    def initialOffset(self):
        return {}

    def latestOffset(self):
        store, base = store_of(self.folder)[0], below(self.folder)
        for f in listed(self.folder, ".jsonl"):
            before = self.known.get(f.path, 0)
            if f.size != before:
                self.known[f.path] = complete(store, f"{base}/{f.path}", before if f.size > before else 0, f.size)
        return dict(self.known)

    def partitions(self, start, end):
        ranges = []
        for path, to in sorted(end.items()):
            since = start.get(path, 0)
            since = since if since <= to else 0
            if since < to:
                ranges.append((path, since, to))
        self.known = {**self.known, **end}
        parts = cut_up(ranges, self.size)
        begins = {p: s for p, s, _ in ranges}
        for part in parts:
            part.pieces = [(p, s, to, e, s == begins[p]) for p, s, to, e in part.pieces]
        return parts or [Part([])]

    def read(self, partition):
        for path, start, to, end, first in partition.pieces:
            yield from self._read(Part([(path, start, to, end)]), {path: (start,) if first else ()})

    def commit(self, end):
        pass
