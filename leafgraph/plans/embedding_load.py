"""Extracts to the vector table."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.functions.models import embed
from leafgraph.functions.text import combine_titles, title_text
from leafgraph.functions.vectors import pad_vector
from leafgraph.operators.interactions import observed
from leafgraph.schemas import VECTOR_CACHE
from leafgraph.session import materialize
from leafgraph.sources.store import append_update, missing_texts, write_vectors


def select_text_rows(extracts: DataFrame) -> DataFrame:
    """The six columns of the vector table, rows without text left out."""
    return extracts.select("doc_id", "url", "parent_titles", "titles", "text", "links").where(F.col("text").isNotNull())


def link_urls(links):
    """URLs of a link list; a missing list gives none."""
    return F.coalesce(F.transform(links, lambda l: l["url"]), F.array().cast("array<string>"))


def vector_rows(extracts: DataFrame, model_factory=None, dim: int = 1024, model_dim: int | None = None) -> DataFrame:
    """Select, combine titles, embed text and joined titles, pad: one lazy plan. A title path is embedded once, however many
    extracts stand below it."""
    rows = select_text_rows(extracts).withColumn("titles", combine_titles(F.col("parent_titles"), F.col("titles")))
    rows = rows.withColumns({"links": link_urls(F.col("links")), "_title": title_text(F.col("titles"))})
    size = model_dim or dim
    rows = embed(rows, model_factory, "text", "text_embedding", size)
    titles = embed(rows.select("_title").distinct(), model_factory, "_title", "title_embedding", size)
    rows = rows.join(titles, "_title")
    pads = {c: pad_vector(F.col(c), dim).cast("array<float>") for c in ("text_embedding", "title_embedding")}
    return rows.withColumns(pads).select("doc_id", "url", "titles", "text", "links", *pads)


def load_vectors(extracts: DataFrame, path: str, load: int, model_factory=None, dim: int = 1024,
                 model_dim: int | None = None) -> DataFrame:
    """Bring the vector table at ``path`` up to date with ``extracts``; returns the audit of what was written.

    Only texts and title paths that no earlier load has embedded reach the model, each once. Their vectors are kept by
    digest in ``cache``, a folder per load number, so a load that runs again replaces what it added. Then the table
    ``vectors`` is written anew, audited, and the load recorded in ``updates``.
    """
    spark = extracts.sparkSession
    rows = select_text_rows(extracts).withColumn("titles", combine_titles(F.col("parent_titles"), F.col("titles")))
    rows = rows.withColumns({"links": link_urls(F.col("links")), "_title": title_text(F.col("titles"))})
    rows = materialize(rows.withColumns({"_text_key": F.md5("text"), "_title_key": F.md5("_title")}), "load-rows")
    try:
        cache = spark.read.schema(VECTOR_CACHE).parquet(f"{path}/cache").where(F.col("load") < load)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        cache = spark.createDataFrame([], VECTOR_CACHE)
    titles = rows.select(F.col("_title_key").alias("key"), F.col("_title").alias("text")).dropDuplicates(["key"])
    wanted = rows.select(F.col("_text_key").alias("key"), "text").union(titles)
    fresh = embed(missing_texts(wanted, cache), model_factory, "text", "embedding", model_dim or dim).select("key", "embedding")
    (fresh.withColumn("embedding", F.col("embedding").cast("array<float>")).withColumn("load", F.lit(load))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load").parquet(f"{path}/cache"))
    vectors = spark.read.schema(VECTOR_CACHE).parquet(f"{path}/cache").where(F.col("load") <= load).select("key", "embedding")
    named = titles.select("key").join(vectors, "key").select(F.col("key").alias("_title_key"), F.col("embedding").alias("title_embedding"))
    own = vectors.select(F.col("key").alias("_text_key"), F.col("embedding").alias("text_embedding"))
    # title paths are few beside extracts: written, their size is known, and where it is small the extracts are not moved for them
    rows = rows.join(own, "_text_key").join(materialize(named, "title-vectors"), "_title_key")
    audit = observed(rows.select("doc_id", "url", "titles", "text", "links", "text_embedding", "title_embedding"),
                     lambda df: write_vectors(df, f"{path}/vectors", dim))
    append_update(spark, f"{path}/updates", load)
    return audit
