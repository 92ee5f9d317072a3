"""A sink of single files, such as images, with commit: a Python data source that writes ``file_name, content`` rows.

Each attempt of a task writes into a folder of its own below ``<path>/_staged-<job>``, which readers skip, and tells the driver its name, files and
bytes. When all tasks are done the driver moves the files of the attempts that count to ``<path>/<file_name>``, and ends by ``_SUCCESS``;
those of failed or doubled attempts go with the staging folder. A job that fails leaves no file that readers see; tasks that outlive it find its
folder gone and clear their own, and what a killed one leaves is cleared by a later job after ``STALE_DAYS``. Names are keys: a later job's file
replaces an earlier one; with ``overwrite`` files of earlier jobs go first. The driver holds the names of one task at a time.

Edge cases. A null name is an error, a null content an empty file; of two rows with one name in a job one stays. An empty table gives
an empty folder with its mark. Names may have folders, but may not leave the path.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

NAME = "flowtab_files"
DONE = "_SUCCESS"
#: In the staging folder of a job that goes on; and days after which the folder of one that left it is cleared.
_OPEN, STALE_DAYS = ".open", 7


def _store(path: str):
    """The file system of a path or URI, and the path in it."""
    from pyarrow import fs

    found, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return found, base.rstrip("/")


def _inside(name: str | None) -> str:
    clean = posixpath.normpath((name or "").replace("\\", "/"))
    if not name or clean.startswith(("/", "..", "_")) or clean == ".":
        raise ValueError(f"no name for a file below the folder: {name!r}")
    return clean


@dataclass
class Written(WriterCommitMessage):
    folder: str
    files: int
    size: int


class FilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex
        store, base = _store(path)
        store.create_dir(self._staged(base), recursive=True)
        with store.open_output_stream(f"{self._staged(base)}/{_OPEN}") as out:
            out.write(b"")

    def _staged(self, base: str) -> str:
        return f"{base}/_staged-{self.job}"

    def write(self, iterator: Iterator) -> Written:
        """One attempt of a task."""
        from pyspark import TaskContext

        store, base = _store(self.path)
        task = TaskContext.get()
        folder = f"{task.partitionId()}-{task.attemptNumber()}-{uuid.uuid4().hex}"
        made, sizes = set(), {}
        for row in iterator:
            name = _inside(row["file_name"])
            target = f"{self._staged(base)}/{folder}/{name}"
            if (parent := posixpath.dirname(target)) not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            content = bytes(row["content"] or b"")
            with store.open_output_stream(target) as out:
                out.write(content)
            sizes[name] = len(content)
        if not self._is_file(store, f"{self._staged(base)}/{_OPEN}"):
            self._drop_staged(store, base)
            raise RuntimeError("the job was given up while its task went on")
        return Written(folder, len(sizes), sum(sizes.values()))

    def commit(self, messages: list[Written | None]) -> None:
        store, base = _store(self.path)
        store.create_dir(base, recursive=True)
        if self.overwrite:
            self._clear(store, base)
        self._drop(store, f"{base}/{DONE}")
        told = [m for m in messages if m is not None]
        made = {base}
        for m in told:
            if m.files:
                self._move(store, f"{self._staged(base)}/{m.folder}", base, made)
        self._drop_staged(store, base)
        self._clear_stale(store, base)
        with store.open_output_stream(f"{base}/{DONE}") as out:
            out.write(json.dumps({"job": self.job, "files": sum(m.files for m in told), "bytes": sum(m.size for m in told)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._drop_staged(*_store(self.path))

    def _drop_staged(self, store, base: str) -> None:
        from pyarrow import fs

        if store.get_file_info(self._staged(base)).type == fs.FileType.Directory:
            store.delete_dir(self._staged(base))

    @staticmethod
    def _is_file(store, path: str) -> bool:
        from pyarrow import fs

        return store.get_file_info(path).type == fs.FileType.File

    def _drop(self, store, path: str) -> None:
        if self._is_file(store, path):
            store.delete_file(path)

    @staticmethod
    def _clear_stale(store, base: str) -> None:
        from datetime import datetime, timedelta, timezone

        from pyarrow import fs

        before = datetime.now(timezone.utc) - timedelta(days=STALE_DAYS)
        for info in store.get_file_info(fs.FileSelector(base)):
            if info.base_name.startswith("_staged-") and info.mtime is not None and info.mtime < before:
                store.delete_dir(info.path)

    @staticmethod
    def _move(store, source: str, base: str, made: set[str]) -> None:
        from pyarrow import fs

        for info in store.get_file_info(fs.FileSelector(source, recursive=True)):
            if info.type == fs.FileType.File:
                target = f"{base}/{info.path[len(source) + 1 :]}"
                if (parent := posixpath.dirname(target)) not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                store.move(info.path, target)

    def _clear(self, store, base: str) -> None:
        """Remove what earlier jobs left; hidden entries, such as stages of other jobs, stay."""
        from pyarrow import fs

        for info in store.get_file_info(fs.FileSelector(base)):
            if not info.base_name.startswith(("_", ".")):
                (store.delete_dir if info.type == fs.FileType.Directory else store.delete_file)(info.path)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "file_name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        if "path" not in self.options:
            raise ValueError("files need a path")
        return FilesWriter(self.options["path"], overwrite)


def save_files(exported: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write ``file_name, content`` as single files below a path, all or none."""
    exported.sparkSession.dataSource.register(Files)
    exported.select("file_name", "content").write.format(NAME).mode("overwrite" if overwrite else "append").option("path", path).save()


def saved_files(spark: SparkSession, path: str) -> DataFrame:
    """``file_name, bytes, content`` of the files below a path; contents are read only where they are asked for. Spark lists no empty files."""
    from pyspark.sql import functions as F

    from .images import gathered, relative, single_files

    rows = single_files(spark, "binaryFile", path)
    return gathered(rows).select(relative("path", path).alias("file_name"), F.col("length").alias("bytes"), "content")
