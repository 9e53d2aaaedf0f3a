"""Data sources that read bytes by place: images by address range, logs from a byte offset.

``register`` adds both to a session.  They open paths through pyarrow's file systems, so a
URI (s3, gs, hdfs, file) or a folder that the executors share will do.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

IMAGE = 0x10000
#: Bytes of images that one task reads, bytes of a log that one task reads, bytes at either end of a prefix that its fingerprint holds.
PACK, SLICE, EDGE = 64 << 20, 32 << 20, 4096


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or a plain path, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    """The file at a path, or the files below it by name."""
    system, at = _system(path)
    info = system.get_file_info(at)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    return system, sorted((x for x in found if x.type == fs.FileType.File), key=lambda x: x.path)


@dataclass
class Images(ds.InputPartition):
    """Files with the number of bytes to read of each, from address ``low`` on."""

    low: int
    files: list[tuple[str, int]]


class ImageReader(ds.DataSourceReader):
    """Reads only the bytes that filters on ``addr`` and ``dump_id`` leave."""

    def __init__(self, path: str) -> None:
        self.path, self.low, self.high, self.only = path, 0, IMAGE - 1, None

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        """Takes bounds on ``addr`` and values of ``dump_id``; gives back what Spark has to check itself."""
        for f in filters:
            column, value = (f.attribute, getattr(f, "value", None)) if hasattr(f, "attribute") else ((), None)
            if column == ("addr",) and isinstance(f, ds.EqualTo | ds.GreaterThanOrEqual | ds.GreaterThan):
                self.low = max(self.low, value + isinstance(f, ds.GreaterThan))
            if column == ("addr",) and isinstance(f, ds.EqualTo | ds.LessThanOrEqual | ds.LessThan):
                self.high = min(self.high, value - isinstance(f, ds.LessThan))
            taken = column == ("addr",) and isinstance(f, ds.EqualTo | ds.GreaterThanOrEqual | ds.GreaterThan | ds.LessThanOrEqual | ds.LessThan)
            if column == ("dump_id",) and isinstance(f, ds.EqualTo | ds.In):
                these = {value} if isinstance(f, ds.EqualTo) else set(value)
                self.only = these if self.only is None else self.only & these
                taken = True
            if not taken and not (column in (("addr",), ("dump_id",)) and isinstance(f, ds.IsNotNull)):
                yield f

    def partitions(self) -> Sequence[ds.InputPartition]:
        low, packs, held = max(0, self.low), [], 0
        for x in _files(self.path)[1]:
            n = min(self.high + 1, x.size, IMAGE) - low
            if n > 0 and (self.only is None or x.path in self.only):
                if not packs or held + n > PACK:
                    packs.append(Images(low, []))
                    held = 0
                packs[-1].files.append((x.path, n))
                held += n
        return packs or [Images(low, [])]

    def read(self, partition: Images) -> Iterator[pa.RecordBatch]:
        system = _system(self.path)[0]
        for path, n in partition.files:
            with system.open_input_file(path) as f:
                raw = np.frombuffer(f.read_at(n, partition.low), np.uint8)
            addr = np.arange(partition.low, partition.low + len(raw), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([path]).take(pa.array(np.zeros(len(raw), np.int32))), pa.array(addr), pa.array(raw.astype(np.int32))], ["dump_id", "addr", "b"])


class ImageSource(ds.DataSource):
    """``dump_id, addr, b`` of the images at ``path``: a row per byte, 65,536 per image at most."""

    @classmethod
    def name(cls) -> str:
        return "image_bytes"

    def schema(self) -> str:
        return "dump_id string, addr int, b int"

    def reader(self, schema: object) -> ImageReader:
        return ImageReader(self.options["path"])


def fingerprint(system: fs.FileSystem, path: str, size: int) -> str:
    """SHA-256 of a prefix's length, its first and its last bytes."""
    with system.open_input_file(path) as f:
        edges = f.read_at(min(EDGE, size), 0) + f.read_at(min(EDGE, size), max(0, size - EDGE))
    return hashlib.sha256(b"%d:" % size + edges).hexdigest()


@dataclass
class Slice(ds.InputPartition):
    """Bytes of a log; lines belong to the slice in which they begin."""

    path: str
    begin: int
    end: int
    stop: int
    replay: bool


class TailReader(ds.DataSourceStreamReader):
    """Whole lines of one growing file; an offset is the bytes seen and their fingerprint.

    If the bytes seen before are no longer the file's prefix (rewritten, truncated), the next
    batch has the whole file, its lines marked ``replay``, for views to be built anew.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def initialOffset(self) -> dict:
        return {"bytes": 0, "fingerprint": ""}

    def latestOffset(self) -> dict:
        system, found = _files(self.path)
        if not found:
            return self.initialOffset()
        size = self._whole_lines(system, found[0])
        return {"bytes": size, "fingerprint": fingerprint(system, found[0].path, size) if size else ""}

    @staticmethod
    def _whole_lines(system: fs.FileSystem, info: fs.FileInfo) -> int:
        """Bytes up to the last end of a line: a line that is being written waits."""
        with system.open_input_file(info.path) as f:
            end = info.size
            while end > 0:
                at = max(0, end - EDGE)
                if (i := f.read_at(end - at, at).rfind(b"\n")) >= 0:
                    return at + i + 1
                end = at
        return 0

    def partitions(self, start: dict, end: dict) -> Sequence[ds.InputPartition]:
        system, found = _files(self.path)
        if not found or not end["bytes"]:
            return [Slice(self.path, 0, 0, 0, False)]
        path, size = found[0].path, end["bytes"]
        same = not start["bytes"] or (start["bytes"] <= size and fingerprint(system, path, start["bytes"]) == start["fingerprint"])
        begin = start["bytes"] if same else 0
        return [Slice(path, at, min(at + SLICE, size), size, not same) for at in range(begin, size, SLICE)] or [Slice(path, size, size, size, False)]

    def read(self, partition: Slice) -> Iterator[tuple[int, str, bool]]:
        if partition.begin >= partition.end:
            return
        system = _system(self.path)[0]
        with io.BufferedReader(system.open_input_file(partition.path), 1 << 16) as f:
            at = partition.begin
            f.seek(max(0, at - 1))
            if at and f.read(1) != b"\n":  # a line that began before
                at += len(f.readline())
            while at < partition.end:
                line = f.readline()
                if line.strip():
                    yield at, line.rstrip(b"\r\n").decode("utf-8", "replace"), partition.replay
                at += len(line)


class TailSource(ds.DataSource):
    """``pos, line, replay`` of the lines of the file at ``path``, as a stream."""

    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return "pos long, line string, replay boolean"

    def streamReader(self, schema: object) -> TailReader:
        return TailReader(self.options["path"])


def register(spark: SparkSession) -> SparkSession:
    """The session, with both sources and with filters pushed into Python sources."""
    spark.dataSource.register(ImageSource)
    spark.dataSource.register(TailSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
