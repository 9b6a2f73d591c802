"""Documents to tokens in five stages: quality, near duplicates, repeated passages, benchmark leaks, byte-level BPE.

A stage takes (spark, docs, sf_dir) and returns a table that is written as Parquet and reread as the next stage's ``docs``;
all but the last return the columns of ``docs``. The stages cover all rows: none samples, caps or skips any. They bound the
bytes of the batches that the session hands to Python, since all of them send whole texts there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.llm import byte_bpe, paragraphs, phrase_index, set_join, weak_labels
from leafgraph.session import bound_batches, discard, materialize


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_row``, a number of its own for every row; the same in every scan of the written table."""
    return docs.withColumn("_row", F.monotonically_increasing_id())


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier keeps.

    Rows are judged one by one by their text; a null text is judged as an empty one.
    """
    bound_batches(spark)
    return weak_labels.judge_quality(docs).filter("keep").select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the document with the smallest id.

    Rows are told apart by their place, not by ``doc_id``: of a row that stands twice one stays, and texts that share an id are
    judged each by itself. A null id comes last; rows without words have no partners and stay, in an empty table as well.
    """
    bound_batches(spark)
    rows = _numbered(docs)
    groups = set_join.join_similar(rows.select(F.col("_row").alias("doc_id"), "text"), n=5, share=(80, 100)).filter("n_shingles > 0")
    own = groups.select(F.col("doc_id").alias("_row"), "component_id").join(
        rows.select("_row", F.struct(F.col("doc_id").isNull(), "doc_id", "_row").alias("order")), "_row")
    own = materialize(own, "grouped")
    first = own.groupBy("component_id").agg(F.min("order").alias("first"), F.count("*").alias("n")).filter("n > 1")
    gone = materialize(own.join(first, "component_id").filter("order <> first").select("_row"), "gone")
    discard(own)
    return rows.join(gone, "_row", "left_anti").select(docs.columns)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document holds; those with nothing left go.

    Rows without an id are neither cut nor looked up; null and empty texts stay; rows that stand twice are cut alike.
    """
    bound_batches(spark)
    return paragraphs.remove_repeats(docs).select(docs.columns)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten consecutive words of a benchmark item.

    Rows are told apart by their place; null and empty texts hold nothing; without items all stay.
    """
    bound_batches(spark)
    rows = _numbered(docs)
    found = phrase_index.contamination(rows.select(F.col("_row").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = materialize(found.filter("contaminated").select(F.col("doc_id").alias("_row")), "leaks")
    return rows.join(leaks, "_row", "left_anti").select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (binary, little-endian 32-bit) and the digest of what they decode to, for every row as it stands."""
    bound_batches(spark)
    return byte_bpe.encode_documents(docs).select(
        "doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each_group), ("repeated_passages", without_repeats),
          ("benchmark_leaks", without_leaks), ("byte_bpe", tokens)]

#: SQL can express neither the classifier nor the encoder; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
