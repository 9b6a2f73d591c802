"""Stored tables: extracts, edges, vectors, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph import schemas as S
from leafgraph.functions.vectors import pad_vector
from leafgraph.operators.interactions import export_rows
from leafgraph.session import materialize
from leafgraph.sources.collections import collection_files, read_collection, write_collection


def write_extracts(extracts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Extracts by site. Rows are gathered by site to keep files large; adaptive execution splits a site that holds
    much of the table over several tasks."""
    extracts.hint("rebalance", "site").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("site").parquet(path)


def read_extracts(spark: SparkSession, path: str, fill: str | None = None) -> DataFrame:
    """Stored extracts; ``fill`` replaces missing faculty and program (``''`` or ``'None'``)."""
    rows = spark.read.schema(S.EXTRACTS).parquet(path)
    return rows if fill is None else rows.fillna(fill, ["faculty", "program"])


def export_extracts(extracts: DataFrame, path: str) -> None:
    """CSV copy with nested columns as JSON."""
    nested = {"array", "map", "struct"}
    cols = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in nested else F.col(f.name)
            for f in extracts.schema.fields]
    extracts.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_edges(edges: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Edges by kind, gathered so that a kind is few files however many tasks made it."""
    edges.hint("rebalance", "type").write.mode(mode).partitionBy("type").parquet(path)


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.EDGES).parquet(path)


def write_vectors(vectors: DataFrame, path: str, dim: int = 1024,
                  columns: tuple[str, ...] = ("text_embedding", "title_embedding")) -> None:
    """Full refresh of the vector table, every vector padded to ``dim``."""
    padded = vectors.withColumns({c: pad_vector(F.col(c).cast("array<double>"), dim).cast("array<float>")
                                  for c in columns})
    padded.write.mode("overwrite").parquet(path)


def write_vectors_jdbc(vectors: DataFrame, url: str, table: str, batch_size: int = 500, **options: str) -> None:
    """The same load into a database table, vectors in list notation."""
    flat = vectors.select(*[F.to_json(f.name).alias(f.name) if f.dataType.typeName() == "array" else F.col(f.name)
                            for f in vectors.schema.fields])
    (flat.write.format("jdbc").mode("overwrite").option("url", url).option("dbtable", table)
     .option("batchsize", batch_size).options(**options).save())


def upsert_collection(rows: DataFrame, path: str, collection: str, clear: bool = False, id: str = "doc_id") -> None:
    """Load rows into a named collection: replace it, or add the ids it does not have yet. Either happens at once or not at all."""
    target = f"{path}/{collection}"
    if not clear and collection_files(target):
        rows = rows.join(read_collection(rows.sparkSession, target).select(id), id, "left_anti").select(rows.columns)
    write_collection(rows, target, replace=clear)


def reuse_vectors(texts: DataFrame, cache: DataFrame, text: str = "text", key: Column | None = None
                  ) -> tuple[DataFrame, DataFrame]:
    """``(known, missing)``: texts with their stored vector, and the distinct texts still to embed.

    ``cache(key, embedding)`` is keyed by a 128-bit digest of the text and holds a key once. One join serves both results:
    what it gives is written, as the rows without a vector go on to a model.
    """
    keyed = texts.withColumn("key", F.md5(F.col(text)) if key is None else key)
    joined = materialize(keyed.join(cache.select("key", "embedding"), "key", "left"), "reuse")
    return joined.where("embedding is not null"), joined.where("embedding is null").drop("embedding").dropDuplicates(["key"])


def missing_texts(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """The distinct texts of ``texts(key, ...)`` that ``cache(key, embedding)`` has no vector of.

    Both steps go by key, so a text is moved once; where only what is missing counts, nothing has to be written as in
    :func:`reuse_vectors`.
    """
    return texts.join(cache.select("key").hint("merge"), "key", "left_anti").dropDuplicates(["key"])


def append_update(spark: SparkSession, path: str, id: int, at: Column | None = None) -> None:
    """Record a finished load; a load that is recorded again under its id replaces its entry."""
    row = spark.range(1).select(F.lit(id).cast("long").alias("id"), (F.current_timestamp() if at is None else at)
                                .alias("datetime"))
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("id").parquet(path)


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.UPDATE_LOG).parquet(path)


def export_interactions(log: DataFrame, feedback: DataFrame, path: str, stamp: str) -> None:
    """Question log and feedback as CSV without header, under names that carry the time of the export."""
    for rows, name in ((log, "question-log"), (feedback, "feedback-log")):
        export_rows(rows).write.mode("overwrite").option("escape", '"').csv(f"{path}/logs/{name}-{stamp}")
