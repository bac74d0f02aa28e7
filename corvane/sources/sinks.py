"""A sink that writes files of given names: ``df.write.format("files").mode("append").save(folder)``.

Rows are (name, body): tasks write a file for each into a folder of their own beside the others, and the driver, to which
only names and numbers come, moves them to where they are to appear once all tasks have ended. A task that fails deletes
its folder, and a job that fails deletes all of them, so there is no file of either. With the option ``array`` rows are
(body) alone, and a task writes them as one JSON array under the name that the option gives.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

STAGING, NAMES = "_staging", "_names"
MOVERS = 32


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), os.path.abspath(path))


@dataclass
class Written(WriterCommitMessage):
    """The folder that a task wrote; the names are in it."""

    folder: str
    count: int


class FileWriter(DataSourceArrowWriter):
    def __init__(self, folder: str, array: str | None, overwrite: bool) -> None:
        self.folder, self.array, self.overwrite, self.job = folder, array, overwrite, uuid.uuid4().hex

    def _stage(self) -> tuple[fs.FileSystem, str, str]:
        files, folder = file_system(self.folder)
        return files, folder, f"{folder}/{STAGING}-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        files, _, stage = self._stage()
        own = f"{stage}/{uuid.uuid4().hex}"
        files.create_dir(own, recursive=True)
        try:
            names = self._write_array(files, own, batches) if self.array else self._write_each(files, own, batches)
            with files.open_output_stream(f"{own}/{NAMES}") as out:
                out.write(json.dumps(names).encode())
        except BaseException:
            files.delete_dir(own)
            raise
        return Written(own, len(names))

    @staticmethod
    def _write_each(files: fs.FileSystem, own: str, batches: Iterator[pa.RecordBatch]) -> list[str]:
        names = {}
        for b in batches:
            for name, body in zip(b["name"].to_pylist(), b["body"].cast(pa.large_binary()).to_pylist()):
                if not name or name in (".", "..") or "/" in name or name.startswith(STAGING):
                    raise ValueError(f"no file can have the name {name!r}")
                with files.open_output_stream(f"{own}/{name}") as out:
                    out.write(body or b"")
                names[name] = None
        return list(names)

    def _write_array(self, files: fs.FileSystem, own: str, batches: Iterator[pa.RecordBatch]) -> list[str]:
        first = True
        with files.open_output_stream(f"{own}/{self.array}") as out:
            out.write(b"[")
            for b in batches:
                for body in b["body"].cast(pa.large_binary()).to_pylist():
                    out.write((b"\n" if first else b",\n") + body)
                    first = False
            out.write(b"\n]\n")
        return [self.array]

    def commit(self, messages: list[Written | None]) -> None:
        files, folder, stage = self._stage()
        if self.overwrite:
            for old in files.get_file_info(fs.FileSelector(folder)):
                if old.path != stage and not old.path.startswith(f"{folder}/{STAGING}"):
                    (files.delete_dir if old.type == fs.FileType.Directory else files.delete_file)(old.path)
        with ThreadPoolExecutor(MOVERS) as pool:
            for m in sorted((m for m in messages if m is not None), key=lambda m: m.folder):
                with files.open_input_stream(f"{m.folder}/{NAMES}") as there:
                    names = json.loads(there.read())
                list(pool.map(lambda name: files.move(f"{m.folder}/{name}", f"{folder}/{name}"), names))
        files.delete_dir(stage)

    def abort(self, messages: list[Written | None]) -> None:
        files, _, stage = self._stage()
        if files.get_file_info(stage).type == fs.FileType.Directory:
            files.delete_dir(stage)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files"

    def writer(self, schema, overwrite: bool) -> FileWriter:
        array = self.options.get("array")
        wanted = {"body"} if array else {"name", "body"}
        if set(schema.fieldNames()) != wanted:
            raise ValueError(f"the columns must be {sorted(wanted)}")
        folder = self.options["path"]
        files, path = file_system(folder)
        files.create_dir(path, recursive=True)
        return FileWriter(folder, array, overwrite)


def _save(df: DataFrame, folder: str, mode: str, **options: str) -> None:
    df.sparkSession.dataSource.register(FileSink)
    df.write.format("files").options(**options).mode(mode).save(folder)


def _name(key: str, ending: str) -> Column:
    """The key with what a file name can't have percent-encoded."""
    return F.concat(F.replace(F.url_encode(F.col(key).cast("string")), F.lit("+"), F.lit("%20")), F.lit(ending))


def write_files(df: DataFrame, folder: str, key: str, body: str, ending: str = "", mode: str = "append") -> None:
    """A file for each row, named by ``key`` and holding ``body``, text or bytes. A null key fails; of rows with one key one stays."""
    _save(df.select(_name(key, ending).alias("name"), F.col(body).cast("binary").alias("body")), folder, mode)


def write_json_documents(df: DataFrame, folder: str, key: str = "arxiv_id", mode: str = "append") -> None:
    """A JSON file for each row, named by ``key``; ``read_json_documents`` reads the folder."""
    body = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    _save(df.select(_name(key, ".json").alias("name"), body.cast("binary").alias("body")), folder, mode)


def write_json_array(df: DataFrame, path: str) -> None:
    """One JSON file that holds an array of all rows in their order, streamed by one task."""
    folder, _, name = path.rpartition("/")
    body = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    _save(df.select(body.cast("binary").alias("body")).coalesce(1), folder or ".", "append", array=name)

