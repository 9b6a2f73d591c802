"""Named collections of rows that are replaced or extended at once, as a data source for ``DataFrame.write``.

A collection is a folder of Parquet files and of lists of files. The newest list says what the collection holds; a load writes its
files next to the others and, when all tasks are done, one new list. Readers of the old list aren't disturbed, and a load that
fails leaves the collection as it was: its files are deleted, and no list names them.

    spark.dataSource.register(CollectionSource)
    rows.write.format("collection").mode("append").save(path)
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlparse

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

ROWS_PER_FILE = 1_000_000


def _store(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), unquote(urlparse(path).path) if path.startswith("file:") else path
    return fs.FileSystem.from_uri(path)


def _lists(path: str) -> list[str]:
    """Names of the lists, oldest first."""
    store, root = _store(path)
    found = store.get_file_info(fs.FileSelector(f"{root}/lists", allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.endswith(".json"))


def collection_files(path: str) -> list[str]:
    """The files that the collection holds now, relative to it."""
    names = _lists(path)
    if not names:
        return []
    store, root = _store(path)
    with store.open_input_stream(f"{root}/lists/{names[-1]}") as file:
        return json.loads(file.read())["files"]


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class CollectionWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.load = path.rstrip("/"), overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _store(self.path)
        store.create_dir(f"{root}/files", recursive=True)
        files, writer, rows = [], None, 0
        for batch in iterator:
            if writer is None or rows >= ROWS_PER_FILE:
                if writer:
                    writer.close()
                files.append(f"files/{self.load}-{uuid.uuid4().hex}.parquet")
                writer, rows = pq.ParquetWriter(f"{root}/{files[-1]}", batch.schema, filesystem=store), 0
            writer.write_batch(batch)
            rows += batch.num_rows
        if writer:
            writer.close()
        return _Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        """One new list; the name of the next number can be taken only once, so of two loads at a time one fails."""
        store, root = _store(self.path)
        own = [name for m in messages if m for name in m.files]
        names = _lists(self.path)
        target = f"{root}/lists/{len(names):012d}.json"
        held = [] if self.overwrite else collection_files(self.path)
        store.create_dir(f"{root}/lists", recursive=True)
        if store.get_file_info(target).type != fs.FileType.NotFound:
            raise RuntimeError(f"another load has changed {self.path}")
        with store.open_output_stream(f"{target}.{self.load}") as out:
            out.write(json.dumps({"files": held + own}).encode())
        store.move(f"{target}.{self.load}", target)
        self._sweep(own)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._sweep([])

    def _sweep(self, keep: list[str]) -> None:
        """Delete what tasks of this load wrote that failed or ran twice."""
        store, root = _store(self.path)
        for file in store.get_file_info(fs.FileSelector(f"{root}/files", allow_not_found=True)):
            if file.base_name.startswith(self.load) and f"files/{file.base_name}" not in keep:
                store.delete_file(file.path)


class CollectionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "collection"

    def writer(self, schema: StructType, overwrite: bool) -> CollectionWriter:
        return CollectionWriter(self.options["path"], overwrite)


def write_collection(rows: DataFrame, path: str, replace: bool = False) -> None:
    rows.sparkSession.dataSource.register(CollectionSource)
    rows.write.format("collection").mode("overwrite" if replace else "append").save(path)


def read_collection(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """The rows that the collection holds; without any files an empty table, for which ``schema`` is needed."""
    files = collection_files(path)
    if not files:
        return spark.createDataFrame([], schema or StructType())
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*[f"{path.rstrip('/')}/{name}" for name in files])


def drop_old(path: str) -> int:
    """Delete files that the newest list doesn't name; returns how many went. Not while a load or a reader of an older list runs."""
    store, root = _store(path)
    held, gone = set(collection_files(path)), 0
    for file in store.get_file_info(fs.FileSelector(f"{root}/files", allow_not_found=True)):
        if f"files/{file.base_name}" not in held:
            store.delete_file(file.path)
            gone += 1
    return gone
