"""A data source that writes one file for each row, under the row's own name.

    named_files(rows, path, ".md")

Tasks write their rows' files into a hidden folder beside their places; when all tasks have succeeded the files are moved, each whole, and a file of
the same name is replaced; when one has failed for good nothing is left. Attempts that were lost leave nothing either, as the hidden folder goes in both cases. Paths
may be local, shared by driver and executors, or in any store that Arrow's file systems open.

Defined results: two rows of one name, a null or empty name, or one with a slash fail the write as a whole; a null document is an empty file; without
rows the folder is made and stays as it was.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import suppress
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:") :]
    return fs.FileSystem.from_uri(path)


@dataclass
class _Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (hidden path, name)


class NamedFilesWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix = options["path"].rstrip("/"), options.get("suffix", "")
        self.staged = f"_staged-{uuid.uuid4().hex}"
        store, root = _open(self.path)
        # Made here, once: a task that outlives the job's failure finds it gone and writes nothing.
        store.create_dir(f"{root}/{self.staged}", recursive=True)

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        store, root = _open(self.path)
        own = f"{root}/{self.staged}/{uuid.uuid4().hex}"
        store.create_dir(own, recursive=False)
        files = []
        for row in iterator:
            name = row["name"]
            if not name or "/" in name or name.startswith((".", "_")):
                raise ValueError(f"not a file's name: {name!r}")
            at = f"{own}/{len(files)}"
            with store.open_output_stream(at) as out:
                out.write((row["document"] or "").encode())
            files.append((at, f"{name}{self.suffix}"))
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _open(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"rows share a name: {sorted({n for n in names if names.count(n) > 1})[:5]}")
        store.create_dir(root, recursive=True)
        for at, name in files:
            if store.get_file_info(f"{root}/{name}").type == fs.FileType.File:
                store.delete_file(f"{root}/{name}")
            store.move(at, f"{root}/{name}")
        self._sweep(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._sweep(*_open(self.path))

    def _sweep(self, store: fs.FileSystem, root: str) -> None:
        for _ in range(5):  # a task may add a file while its folder goes
            if store.get_file_info(f"{root}/{self.staged}").type != fs.FileType.Directory:
                break
            with suppress(OSError):
                store.delete_dir(f"{root}/{self.staged}")


class NamedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return "name string, document string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return NamedFilesWriter(self.options)


def named_files(rows: DataFrame, path: str, suffix: str = "") -> None:
    """Writes (name, document) of all rows as files of `path`."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select("name", "document").write.format("named_files").mode("append").option("suffix", suffix).save(path)
