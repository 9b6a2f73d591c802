"""Session settings and the shared work folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
PARTITIONS_SETTING = "spark.leafgraph.partitions"
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def build_session(app: str = "leafgraph", master: str | None = None, **settings: str) -> SparkSession:
    """A session with the settings the operators assume; on a cluster ``master`` comes from spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for a written table, below the shared folder named by ``spark.checkpoint.dir``.

    Where none is named, it lies below the session's warehouse; one that is a folder of this machine does for a local master
    only, as other machines don't see it.
    """
    base = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/leafgraph-work"
        if base.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that all machines share")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where several consumers read the result of an expensive Python step: the table survives the loss of
    executors and cuts the lineage, which an in-memory cache does not.
    """
    spark = df.sparkSession
    path = work_dir(spark, label)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._work_path = path
    return follow(table, df)


def discard(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialize` wrote, after their last reader has run."""
    for table in tables:
        jvm = table.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._work_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on the session hands rows to Python in Arrow batches of about ``most`` bytes, or as few as it did before.

    Batches are bounded by rows otherwise, and a task's texts are one batch: it is held by the task and its Python worker at
    once, and both keep what they have grown to. Narrow rows still go in batches as long as before.
    """
    had = re.fullmatch(r"(\d+)([bkmgtp]?)b?", spark.conf.get(BATCH_SETTING).strip().lower())
    if had is None or int(had[1]) << 10 * "bkmgtp".index(had[2] or "b") > most:
        spark.conf.set(BATCH_SETTING, str(most))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal ``df`` out over as many partitions as the setting ``spark.leafgraph.partitions`` says, ahead of a CPU-heavy step.

    Meant for inputs with fewer splits than the cluster has cores. Without the setting nothing is moved. ``keys`` should
    identify rows, so that they spread evenly.
    """
    partitions = df.sparkSession.conf.get(PARTITIONS_SETTING, None)
    return df.repartition(int(partitions), *keys) if partitions else df


def deal_out(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in tasks of about ``rows`` rows, ahead of a step that makes much more of a row than it holds.

    A compact table comes as one split however many rows it has, so its bytes say nothing about the work on them. The rows
    are counted, which Parquet answers from its footers, and dealt out in turn, so that no key matters. Steps that derive
    tables hand the number of tasks on with :func:`follow`.
    """
    tasks = max(1, -(-df.count() // rows))
    dealt = df.repartition(tasks)
    dealt._tasks = tasks
    return dealt


def follow(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df``, known to hold what the tasks made that ``source`` was dealt out to, if it was."""
    tasks = getattr(source, "_tasks", None)
    if tasks:
        df._tasks = tasks
    return df


def by_page(df: DataFrame, source: DataFrame) -> DataFrame:
    """``df`` by ``page_id``, over as many partitions as a shuffle has, or as ``source`` was dealt out to, if those are more.

    The number is named, because adaptive execution would merge partitions by the bytes they have in the exchange, and the
    windows behind it hold rows many times as wide. With a fixed number of them the memory of a task would grow with the pages.
    """
    spark = df.sparkSession
    setting = spark.conf.get(PARTITIONS_SETTING, None)
    partitions = int(setting) if setting else max(int(spark.conf.get("spark.sql.shuffle.partitions")), getattr(source, "_tasks", 1))
    return df.repartition(partitions, "page_id")
