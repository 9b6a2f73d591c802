"""Dense numbers for the rows of a table, without sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.session import materialize

_PLACE = (1 << 33) - 1  # a row's place in its partition, in the lower bits of monotonically_increasing_id


def number_rows(rows: DataFrame, *keys: str, name: str = "number") -> DataFrame:
    """``rows`` with a number from 0 in the order of ``keys``: sorted by ranges, which a prefix sum over them puts together.

    The sorted rows are written once, so that a lost task can't renumber them.
    """
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered = materialize(ordered.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", 33)
    counts = ordered.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row per range
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    return (ordered.withColumn("_part", part).join(bases, "_part")
            .withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(_PLACE)).drop("_part", "_base", "_at"))
