"""Token ids as flat files: unsigned integers of all documents in order, plus 64-bit document offsets.

A folder holds, for each part ``k``: ``k.ids`` (little-endian unsigned integers, no header), ``k.offsets`` (unsigned 64-bit:
where each document of the part begins among the ids of *all* parts, and one more for the part's end) and ``k.docs`` (signed
64-bit document ids, then one byte per document, 0 where the id is null). Parts follow each other in ascending document id;
``index`` is a Parquet table (part, n_docs, n_tokens, base) whose bases are prefix sums over the parts. A reader maps the
files into memory, so a document's tokens are a slice, whatever the size of the part.

Writing is one range exchange on the document id. A part file is written under the attempt's name and renamed, so a task
that runs twice, or again after an executor was lost, leaves one whole file. Parts are files of one folder that all machines
share; other stores are reached through ``pyarrow.fs``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.llm.segments import text_encoder
from leafgraph.llm.texts import blocks

BLOCK = 4 << 20  # bytes of text encoded at once


def _open_store(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), unquote(urlparse(folder).path)
    return fs.FileSystem.from_uri(folder)


def map_file(folder: str, name: str, kind: str) -> np.ndarray:
    """The integers of a file; mapped into memory where the store is a mounted folder."""
    store, path = _open_store(folder)
    path = f"{path}/{name}"
    if store.get_file_info(path).size == 0:
        return np.zeros(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r")
    with store.open_input_file(path) as file:
        return np.frombuffer(file.read(), kind)


def write_token_files(documents: DataFrame, folder: str, vocabulary: str | None = None, end_id: int = 0,
                      width: int = 4, parts: int | None = None, special_as_text: bool = False) -> DataFrame:
    """Encode ``documents`` (doc_id, text), append ``end_id`` to each and write the files; returns the index.

    A null text is empty and leaves its end id alone; a null ``doc_id`` comes first; rows with the same ``doc_id`` all stay,
    ordered by text; texts may be of any length, and other columns are ignored. ``width`` is the bytes per id (2 or 4): a
    vocabulary or ``end_id`` that doesn't fit raises. ``parts`` is the number of files, by default the
    session's number of shuffle partitions. The string of a special token in a text becomes its id, unless
    ``special_as_text``. An empty table gives an empty index and no files.
    """
    spark = documents.sparkSession
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    store, root = _open_store(folder)
    store.create_dir(root, recursive=True)
    kind = {2: "<u2", 4: "<u4"}[width]
    if max(text_encoder(vocabulary, special_as_text).size, end_id + 1) > 1 << (8 * width):
        raise ValueError(f"ids up to {max(text_encoder(vocabulary, special_as_text).size - 1, end_id)} don't fit {width} bytes")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, own = TaskContext.get().partitionId(), text_encoder(vocabulary, special_as_text)
        store, root = _open_store(folder)
        store.create_dir(root, recursive=True)
        attempt = uuid.uuid4().hex
        lengths, docs, known = ([np.zeros(0, t)] for t in ("<u8", "<i8", bool))
        with store.open_output_stream(f"{root}/{part}.ids.{attempt}") as out:
            for batch in batches:
                for row, end, offsets, data in blocks(batch.column("text"), BLOCK):
                    ids, at = own.encode(offsets, data)
                    out.write(np.insert(ids, at[1:], end_id).astype(kind).tobytes())
                    lengths.append((np.diff(at) + 1).astype("<u8"))
                docs.append(batch.column("doc_id").fill_null(0).to_numpy().astype("<i8"))
                known.append(batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
        lengths, docs, known = map(np.concatenate, (lengths, docs, known))
        with store.open_output_stream(f"{root}/{part}.docs.{attempt}") as out:
            out.write(docs.tobytes())
            out.write(known.astype(np.uint8).tobytes())
        with store.open_output_stream(f"{root}/{part}.lengths.{attempt}") as out:
            out.write(lengths.tobytes())
        for name in ("ids", "docs", "lengths"):
            store.move(f"{root}/{part}.{name}.{attempt}", f"{root}/{part}.{name}")
        if len(docs):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([len(docs)], pa.int64()),
                                              pa.array([int(lengths.sum())], pa.int64())], ["part", "n_docs", "n_tokens"])

    written = (documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")
               .mapInArrow(write, "part int, n_docs long, n_tokens long"))
    written.write.mode("overwrite").parquet(f"{folder}/counts")
    counts = spark.read.parquet(f"{folder}/counts").toPandas().sort_values("part")  # a row per part
    counts["base"] = counts["n_tokens"].cumsum() - counts["n_tokens"]
    spark.createDataFrame(counts, "part int, n_docs long, n_tokens long, base long").coalesce(1) \
        .write.mode("overwrite").parquet(f"{folder}/index")
    index = spark.read.parquet(f"{folder}/index")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _open_store(folder)
        for batch in batches:
            for part, base in zip(batch.column("part").to_pylist(), batch.column("base").to_pylist()):
                ends = np.cumsum(map_file(folder, f"{part}.lengths", "<u8"), dtype=np.uint64) + np.uint64(base)
                attempt = f"{root}/{part}.offsets.{uuid.uuid4().hex}"
                with store.open_output_stream(attempt) as out:
                    out.write(np.concatenate([[np.uint64(base)], ends]).astype("<u8").tobytes())
                store.move(attempt, f"{root}/{part}.offsets")
            yield batch.select(["part"])

    _spread(index).select("part", "base").mapInArrow(place, "part int").write.format("noop").mode("overwrite").save()
    return index


def _spread(index: DataFrame) -> DataFrame:
    return index.repartition(max(1, index.sparkSession.sparkContext.defaultParallelism), "part")


def read_token_files(spark: SparkSession, folder: str, width: int = 4, widen: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids (binary, as in the file) of every document.

    With ``widen`` ids are 32-bit ones, whatever the file's width.
    """
    kind = {2: "<u2", 4: "<u4"}[width]
    index = spark.read.parquet(f"{folder}/index")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, n_docs in zip(batch.column("part").to_pylist(), batch.column("n_docs").to_pylist()):
                ids = map_file(folder, f"{part}.ids", kind)
                starts = map_file(folder, f"{part}.offsets", "<u8").astype(np.int64)
                raw = map_file(folder, f"{part}.docs", "u1")
                docs, known = raw[:8 * n_docs].view("<i8"), raw[8 * n_docs:].astype(bool)
                for a in range(0, n_docs, 500):
                    b = min(a + 500, n_docs)
                    at = starts[a:b + 1] - starts[0]
                    some = ids[at[0]:at[-1]].astype("<u4" if widen else kind)
                    places = (at - at[0]) * some.itemsize
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[a:b], pa.int64(), mask=~known[a:b]), pa.array(starts[a:b]),
                         pa.array(np.diff(starts[a:b + 1])),
                         pa.Array.from_buffers(pa.large_binary(), b - a, [
                             None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(some))]).cast(pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"])

    return _spread(index).select("part", "n_docs").mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids binary")
