"""A sink for content that must never change under its name: files published whole or not at all.

``register`` adds the format ``frozen`` to a session.  Rows are ``name, content``; each becomes
the file ``path/name``.  Tasks stage their files below ``path/_staged``; the driver publishes
them when all tasks are done, each by a link that fails if the name is taken, so of concurrent
writers one wins and the other finds out.  The same name with the same bytes is fine, with other bytes
the whole write is refused: what it has published itself is taken back.  A failed or stopped task leaves nothing.
"""

from __future__ import annotations

import hashlib
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds

STAGED = "_staged"


class Refused(ValueError):
    """A name that is taken by other bytes, or is no plain name."""


def _digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


@dataclass
class Staged(ds.WriterCommitMessage):
    """Names with the digests of their staged files."""

    folder: str
    files: list[tuple[str, str]]


class FrozenWriter(ds.DataSourceWriter):
    def __init__(self, path: str, size: int | None) -> None:
        self.path, self.size, self.job = path, size, uuid.uuid4().hex
        os.makedirs(self._folder())

    def _folder(self, *parts: str) -> str:
        return os.path.join(self.path, STAGED, self.job, *parts)

    def write(self, rows: Iterator) -> Staged:
        """Stage one task's files in a folder of its own: a task that runs twice doesn't meet itself."""
        folder, files = self._folder(uuid.uuid4().hex), {}
        os.mkdir(folder)  # the job's folder is the driver's: once it has given up, a late task can't stage
        for row in rows:
            name, content = row["name"], bytes(row["content"])
            if not name or name != os.path.basename(name) or name.startswith((".", "_")):
                raise Refused(f"no plain name: {name!r}")
            if self.size is not None and len(content) != self.size:
                raise Refused(f"{name}: {len(content)} bytes, not {self.size}")
            sha = hashlib.sha256(content).hexdigest()
            if files.setdefault(name, sha) != sha:
                raise Refused(f"two contents for {name}")
            at = os.path.join(folder, sha)
            with open(at, "wb") as f:
                f.write(content)
                f.flush()
                os.fsync(f.fileno())
        return Staged(folder, list(files.items()))

    def commit(self, messages: list[Staged | None]) -> None:
        done: list[str] = []
        try:
            for m in messages:
                for name, sha in m.files if m else []:
                    target = os.path.join(self.path, name)
                    try:
                        os.link(os.path.join(m.folder, sha), target)
                        done.append(target)
                    except FileExistsError:
                        if _digest(target) != sha:
                            raise Refused(f"frozen with other bytes: {name}") from None
        except BaseException:
            for target in done:
                os.unlink(target)
            raise
        finally:
            self._clear()

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        shutil.rmtree(self._folder(), ignore_errors=True)
        try:
            os.rmdir(os.path.join(self.path, STAGED))
        except OSError:
            pass  # another writer is at work, or nothing was staged


class FrozenSink(ds.DataSource):
    """``name string, content binary`` to files at ``path``, a folder that the cluster shares; option ``size``: bytes that each must have."""

    @classmethod
    def name(cls) -> str:
        return "frozen"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: object, overwrite: bool) -> FrozenWriter:
        if overwrite:
            raise Refused("frozen content is never overwritten: use append")
        path = self.options["path"].removeprefix("file://")
        os.makedirs(path, exist_ok=True)
        return FrozenWriter(path, int(self.options["size"]) if "size" in self.options else None)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(FrozenSink)
    return spark
