"""Local files behind references: scheme rules, byte ranges, verification."""

from __future__ import annotations

import hashlib
import mmap
import os
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemolake.functions.exprs import resolve_uri

#: Format by suffix.
FORMATS = {".csv": "csv", ".tsv": "csv", ".jsonl": "jsonl", ".ndjson": "jsonl", ".json": "json", ".parquet": "parquet", ".md": "markdown", ".txt": "txt", ".pdf": "pdf", ".html": "html", ".xml": "xml", ".png": "png", ".jpg": "jpeg", ".jpeg": "jpeg"}


class UnsupportedScheme(ValueError):
    pass


class ProvenanceError(Exception):
    def __init__(self, reason: str, uri: str):
        super().__init__(f"{reason}: {uri}")
        self.reason, self.uri = reason, uri


def local_path(uri: str, base: str | None = None) -> str:
    """Bare paths and file:// only; a relative path lies under base."""
    scheme, sep, rest = uri.partition("://")
    if sep and scheme != "file":
        raise UnsupportedScheme(uri)
    path = rest if sep else uri
    return path if os.path.isabs(path) or not base else os.path.join(base, path)


def confined(path: str, base: str) -> bool:
    """Whether path, symlinks followed, lies under base."""
    real, root = os.path.realpath(path), os.path.realpath(base)
    return real == root or real.startswith(root + os.sep)


def read_range(path: str, offset: int = 0, length: int | None = None) -> bytes:
    """Short at the end of the file."""
    if offset < 0 or length is not None and length < 0:
        raise ValueError("offset and length must not be negative")
    with open(path, "rb") as f:
        f.seek(offset)
        return f.read() if length is None else f.read(length)


def exists(uri: str, base: str | None = None) -> bool:
    return os.path.exists(local_path(uri, base))


def mapped(path: str, offset: int, length: int) -> bytes:
    """read_range() through a map of the file, for many ranges of one file; a range beyond its end is short."""
    if offset < 0 or length < 0:
        raise ValueError("offset and length must not be negative")
    if not os.path.getsize(path):
        return b""  # an empty file can't be mapped
    with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as m:
        return m[offset : offset + length]


def checksum(path: str) -> str:
    """Always of the file as it is now; nothing is cached."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def metadata(path: str) -> dict:
    return {"path": path, "size": os.path.getsize(path), "modified": os.path.getmtime(path), "format": FORMATS.get(os.path.splitext(path)[1].lower(), "unknown")}


_READ = "id string, content binary, verified boolean, reason string"
#: Ranges of a file that are at most so many bytes apart are read as one run; a run ends at so many bytes, so a task holds no more at once.
GAP, RUN = 1 << 16, 8 << 20


def runs(ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    """(first byte, end, how many) of the runs that ranges (offset, length), in order of offset, are read as; overlaps and small gaps merge."""
    start = end = n = 0
    for offset, length in ranges:
        if n and (offset > end + GAP or max(end, offset + length) - start > RUN):
            yield start, end, n
            n = 0
        start, end = (offset, offset + length) if not n else (start, max(end, offset + length))
        n += 1
    if n:
        yield start, end, n


#: How uris of further schemes are opened: scheme to a function of the uri that gives a binary file with seek and read.
ADAPTERS: dict[str, Callable[[str], BinaryIO]] = {}


def register(scheme: str, opener: Callable[[str], BinaryIO]) -> None:
    """From now on read_references() opens uris of a scheme so; the function goes to the tasks, so it has to be one that can travel."""
    ADAPTERS[scheme] = opener


class _Opened:
    """The file that was read last stays open until another is asked for; opened counts how many were."""

    def __init__(self, adapters: dict[str, Callable[[str], BinaryIO]] | None = None):
        self.uri, self.file, self.opened, self.adapters = None, None, 0, adapters or {}

    def at(self, uri: str, base: str | None) -> BinaryIO:
        if uri != self.uri:
            self.close()
            scheme, sep, _ = uri.partition("://")
            self.file = self.adapters[scheme](uri) if sep and scheme in self.adapters else open(local_path(uri, base), "rb")  # noqa: SIM115  closed by close()
            self.uri, self.opened = uri, self.opened + 1
        return self.file

    def close(self) -> None:
        if self.file:
            self.file.close()
        self.uri = self.file = None


def read_sorted(rows: list[dict], held: _Opened, base: str | None, verify: bool) -> Iterator[tuple]:
    """(id, content, verified, reason) of references in order of uri and offset: a file is opened once, neighbouring ranges are one read."""
    first = 0
    while first < len(rows):
        last = first
        while last < len(rows) and rows[last]["source_uri"] == rows[first]["source_uri"]:
            last += 1
        group, first = rows[first:last], last
        try:
            file = held.at(group[0]["source_uri"] or "", base)
        except UnsupportedScheme:
            yield from ((r["id"], None, False, "unsupported_scheme") for r in group)
            continue
        except OSError:
            yield from ((r["id"], None, False, "missing_file") for r in group)
            continue
        at = 0
        for start, end, n in runs([(max(0, r["byte_offset"] or 0), max(0, r["byte_length"] or 0)) for r in group]):
            file.seek(start)
            data = file.read(end - start)
            for r in group[at : at + n]:
                low, length = max(0, r["byte_offset"] or 0) - start, max(0, r["byte_length"] or 0)
                part = data[low : low + length]
                wanted = r["source_checksum"] if verify else None
                if len(part) < length:
                    yield r["id"], None, False, "truncated"
                elif wanted and hashlib.sha256(part).hexdigest() != wanted:
                    yield r["id"], None, False, "checksum_mismatch"
                else:
                    yield r["id"], part, bool(wanted), None
            at += n


def read_references(rows: DataFrame, base: str | None = None, verify: bool = True) -> DataFrame:
    """rows (id, source_uri, byte_offset, byte_length, source_checksum) to (id, content, verified, reason).

    Rows of one file go to one task, in order of offset, so that a task opens it once and reads runs of ranges; a file of
    many ranges spreads over as many tasks as its megabytes ask for. A short read is told before a wrong checksum.
    """

    adapters = dict(ADAPTERS)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Opened(adapters)
        try:
            for batch in batches:
                out, size = [], 0
                for r in read_sorted(batch.to_pylist(), held, base, verify):
                    out.append(r)
                    size += len(r[1] or b"")
                    if size >= RUN:
                        yield _answers(out)
                        out, size = [], 0
                yield _answers(out)
        finally:
            held.close()

    wanted = rows.select("id", "source_uri", "byte_offset", "byte_length", "source_checksum")
    return wanted.repartition("source_uri", (wanted["byte_offset"] / (1 << 26)).cast("long")).sortWithinPartitions("source_uri", "byte_offset").mapInArrow(read, _READ)


def _answers(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.binary(), pa.bool_(), pa.string()))], names=["id", "content", "verified", "reason"])


def present(paths: DataFrame) -> DataFrame:
    """(path, length) of those of a one-column frame that exist as local files or folders; uris of other schemes don't."""

    def stat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri in batch.column(0).to_pylist():
                try:
                    found.append((uri, os.path.getsize(local_path(uri or ""))))
                except (OSError, UnsupportedScheme):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int64())], names=["path", "length"])

    return paths.distinct().mapInArrow(stat, "path string, length long")


def listing(memories: DataFrame, base: str | None = None) -> DataFrame:
    """(path, length) of the files that file rows refer to, each looked up once."""
    return present(memories.where("memory_type = 'file'").select(resolve_uri(F.col("source_uri"), base or "").alias("path")))
