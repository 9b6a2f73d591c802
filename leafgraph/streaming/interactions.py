"""Question log and feedback as incremental file streams.

Every payload is kept, however late. Of payloads with one ``event_id`` the first is kept, in a batch the smallest as text;
payloads without an id are never repeats of each other. Lines that can't be read go to the rejects one by one, and an id that
only a rejected line has is not taken. Which ids are taken is keyed state of the query, kept on disk by its state store and
with its checkpoint: a batch reads its own files and the state of its own ids, never the log. Each batch writes a folder of
its own, so a batch that runs again after a failure replaces what it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.operators.interactions import parse_feedback, parse_questions

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def told_and_new(lines: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``(event_id, value, new)``: every line of a stream, and a new row without a line for every event not seen before.

    The state holds ids only and is asked inside the engine; lines that have no id to go by carry a null one.
    """
    told = parse(lines).select("event_id", F.col("payload").alias("value"), "valid")
    event = F.when(F.col("valid"), F.col("event_id"))
    told = told.select(event.alias("event_id"), "value", F.lit(False).alias("new"))
    once = told.where("event_id IS NOT NULL").select("event_id").dropDuplicates(["event_id"])
    return told.union(once.select("event_id", F.lit(None).cast("string").alias("value"), F.lit(True).alias("new")))


def first_payloads(batch: DataFrame) -> DataFrame:
    """``value``: of one batch of :func:`told_and_new` the smallest line of every new event, and all lines without an id."""
    named = F.col("event_id").isNotNull()
    firsts = batch.where(named).groupBy("event_id").agg(F.min("value").alias("value"), F.max("new").alias("new"))
    return firsts.where("new").select("value").union(batch.where(~named).select("value"))


def _write(rows: DataFrame, path: str, batch_id: int) -> None:
    (rows.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def _log(spark: SparkSession, source: str, sink: str, rejects: str, checkpoint: str,
         parse: Callable[[DataFrame], DataFrame]) -> None:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()  # the state must be asked once; what is lost with an executor comes back from the state's last version
        firsts = first_payloads(batch).persist()
        parsed = parse(firsts)
        _write(parsed.where("valid").drop("valid", "payload"), sink, batch_id)
        _write(parsed.where("not valid").select("event_id", "payload"), rejects, batch_id)
        firsts.unpersist()
        batch.unpersist()

    own = spark.newSession()  # the state store is a setting of this query, not of the caller's session
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(key, spark.conf.get(key))
    own.conf.set(STATE_STORE, ON_DISK)
    stream = told_and_new(own.readStream.format("text").load(source), parse)
    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def log_questions(spark: SparkSession, source: str, sink: str, checkpoint: str, rejects: str | None = None) -> None:
    """Append new JSON question payloads, each event once, then stop. Restarts continue from the checkpoint."""
    _log(spark, source, sink, rejects or f"{sink.rstrip('/')}-rejects", checkpoint, parse_questions)


def log_feedback(spark: SparkSession, source: str, sink: str, rejects: str, checkpoint: str) -> None:
    """Append new feedback payloads; unusable ones go to ``rejects``."""
    _log(spark, source, sink, rejects, checkpoint, parse_feedback)
