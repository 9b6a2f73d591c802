"""Snapshots of a table that tell where they differ without being read whole.

Rows are stored by the bucket of their key. Of every bucket a digest is kept that does not depend on the order of rows: how many
there are, and two sums of hashes of whole rows. Buckets are grouped, and a group's digest is the sum of its buckets'. Two
snapshots are compared by groups, then by the buckets of groups that differ, and only the buckets that differ are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.operators.links import snapshot_changed

BUCKETS, GROUPS = 1024, 32
_SUMS = ("n", "a", "b")


def write_snapshot(rows: DataFrame, path: str, *keys: str, buckets: int = BUCKETS) -> None:
    """Store ``rows`` below ``path`` with the digests of their buckets. Equal snapshots need equal numbers of buckets."""
    line = F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"})
    own = rows.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    own.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/rows")
    stored = rows.sparkSession.read.schema(own.schema).parquet(f"{path}/rows")
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), line).cast("decimal(38,0)"))
    digests = stored.groupBy("bucket").agg(F.count("*").alias("n"), wide(1).alias("a"), wide(2).alias("b"))
    digests.withColumn("part", F.col("bucket") % GROUPS).coalesce(1).write.mode("overwrite").partitionBy("part").parquet(f"{path}/buckets")
    lower = rows.sparkSession.read.schema("bucket int, n long, a decimal(38,0), b decimal(38,0), part int").parquet(f"{path}/buckets")
    lower.groupBy("part").agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in _SUMS]).coalesce(1).write.mode("overwrite").parquet(
        f"{path}/parts")


def _unequal(old: DataFrame, new: DataFrame, key: str) -> list[int]:
    """Keys whose digests differ, or that one side lacks; there are at most ``BUCKETS``."""
    both = old.select(key, F.struct(*_SUMS).alias("_old")).join(new.select(key, F.struct(*_SUMS).alias("_new")), key, "full")
    return sorted(r[key] for r in both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(key).collect())


def changed_buckets(spark: SparkSession, old: str, new: str) -> list[int]:
    """The buckets in which two snapshots differ."""
    read = lambda path, name: spark.read.parquet(f"{path}/{name}")
    parts = _unequal(read(old, "parts"), read(new, "parts"), "part")
    if not parts:
        return []
    lower = [read(path, "buckets").where(F.col("part").isin(parts)) for path in (old, new)]
    return _unequal(*lower, "bucket")


def snapshot_difference(spark: SparkSession, old: str, new: str) -> DataFrame:
    """Rows that differ and the side they are on, as :func:`leafgraph.operators.links.snapshot_changed` gives them."""
    found = changed_buckets(spark, old, new)
    sides = [spark.read.parquet(f"{path}/rows").where(F.col("bucket").isin(found) if found else F.lit(False)).drop("bucket")
             for path in (old, new)]
    return snapshot_changed(*sides)
