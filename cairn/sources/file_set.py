"""Files written by tasks and committed together: a Python data source of rows ``(name, content)``.

A task writes each of its files under a temporary name beside the others and reports the names. Only when all tasks are done the driver
renames them, names alone passing through it, and puts a marker down last. A task that is lost, run twice or aborted leaves
nothing under a final name, and a folder without the marker is unfinished.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

MARKER = "_COMMITTED"
PENDING = "_pending"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder that all tasks reach, and its path there; one without a scheme is mounted."""
    url = urlparse(uri)
    return (pafs.LocalFileSystem(), url.path.rstrip("/")) if url.scheme in ("", "file") else pafs.FileSystem.from_uri(uri.rstrip("/"))


def checked(name: str) -> str:
    if not name or name in (".", "..") or "/" in name or "\\" in name or name.startswith("_"):
        raise ValueError(f"no name for a file of a set: {name!r}")
    return name


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # temporary and final path


class FileSetWriter(DataSourceArrowWriter):
    def __init__(self, root: str):
        self.root, self.run = root, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = file_system(self.root)
        made: list[tuple[str, str]] = []
        for batch in iterator:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                temporary = f"{root}/{PENDING}/{self.run}/{uuid.uuid4().hex}"
                store.create_dir(f"{root}/{PENDING}/{self.run}", recursive=True)
                with store.open_output_stream(temporary) as f:
                    f.write(content.as_buffer() or b"")
                made.append((temporary, f"{root}/{checked(name)}"))
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        store, root = file_system(self.root)
        store.create_dir(root, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        if len({final for _, final in files}) < len(files):
            self.abort(messages)
            raise ValueError("two files of a set have one name")
        for temporary, final in files:
            store.move(temporary, final)
        self.abort(messages)
        with store.open_output_stream(f"{root}/{MARKER}") as f:
            f.write(f"{len(files)}\n".encode())

    def abort(self, messages: list[Written | None]) -> None:
        store, root = file_system(self.root)
        at = f"{root}/{PENDING}/{self.run}"
        if store.get_file_info(at).type != pafs.FileType.NotFound:
            store.delete_dir(at)


class FileSet(DataSource):
    @classmethod
    def name(cls) -> str:
        return "cairn_file_set"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FileSetWriter:
        return FileSetWriter(self.options["path"])


def write_files(files: DataFrame, root: str) -> None:
    """Writes ``(name, content)`` rows as files below ``root``; files that are there already keep their place unless a new one has their name."""
    spark = files.sparkSession
    spark.dataSource.register(FileSet)
    files.select(files["name"].cast("string").alias("name"), files["content"].cast("binary").alias("content")).write.format(FileSet.name()).mode("append").save(root)


def committed(spark: SparkSession, root: str) -> int | None:
    """How many files the last committed run wrote there; None where none was."""
    store, path = file_system(root)
    if store.get_file_info(f"{path}/{MARKER}").type == pafs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{path}/{MARKER}") as f:
        return int(f.read())
