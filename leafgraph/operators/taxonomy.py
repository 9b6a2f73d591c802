"""The faculty / program / specialization taxonomy as flat rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ("faculty", "program", "specialization")


def program_options(extracts: DataFrame) -> DataFrame:
    """Distinct ``(faculty, program, specialization)``; a program without any keeps one row with null.

    The set per program is built in the map-side combine, so a faculty that holds most extracts still shuffles little;
    its size is that of the taxonomy, not of the corpus.
    """
    rows = (extracts.where(F.col("faculty").isNotNull() & F.col("program").isNotNull())
            .select("faculty", "program", F.explode_outer("specialization").alias("s")))
    return rows.groupBy("faculty", "program").agg(F.collect_set("s").alias("s")).select(
        "faculty", "program", F.explode_outer("s").alias("specialization"))


def nested_taxonomy(flat: DataFrame) -> DataFrame:
    """``(faculty, programs)`` with the nested JSON shape of the taxonomy file; one row per faculty."""
    empty = F.create_map().cast("map<string,string>")
    programs = flat.groupBy("faculty", "program").agg(F.array_sort(F.collect_set("specialization")).alias("specs"))
    body = lambda p: F.struct(F.map_from_entries(F.transform(
        p["specs"], lambda s: F.struct(s, empty))).alias("specializations"))
    entries = F.transform(F.array_sort(F.collect_list(F.struct("program", "specs"))),
                          lambda p: F.struct(p["program"], body(p)))
    return programs.groupBy("faculty").agg(F.map_from_entries(entries).alias("programs"))


def taxonomy_json(flat: DataFrame) -> DataFrame:
    return nested_taxonomy(flat).select("faculty", F.to_json(F.struct("programs")).alias("json"))


def read_taxonomy(flat_json: DataFrame) -> DataFrame:
    """Flat rows of ``(faculty, json)``, the inverse of :func:`taxonomy_json`."""
    shape = "programs map<string, struct<specializations: map<string, map<string,string>>>>"
    return (flat_json.select("faculty", F.from_json("json", shape)["programs"].alias("p"))
            .select("faculty", F.explode("p").alias("program", "body"))
            .select("faculty", "program", F.explode_outer(F.map_keys("body.specializations")).alias("specialization")))


def taxonomy_patch(new: DataFrame, old: DataFrame | None, edited: DataFrame | None) -> DataFrame:
    """Apply to ``new`` what an administrator removed from and added to ``old``; no old files, no edits.

    One aggregation over the three tables instead of set operations that would each shuffle.
    """
    if old is None or edited is None:
        return new.select(*KEYS).distinct()
    marked = (new.select(*KEYS, F.lit(1).alias("n"), F.lit(0).alias("o"), F.lit(0).alias("e"))
              .unionByName(old.select(*KEYS, F.lit(0).alias("n"), F.lit(1).alias("o"), F.lit(0).alias("e")))
              .unionByName(edited.select(*KEYS, F.lit(0).alias("n"), F.lit(0).alias("o"), F.lit(1).alias("e"))))
    seen = marked.groupBy(*KEYS).agg(F.max("n").alias("n"), F.max("o").alias("o"), F.max("e").alias("e"))
    removed = (F.col("o") == 1) & (F.col("e") == 0)
    added = (F.col("o") == 0) & (F.col("e") == 1)
    return seen.where(((F.col("n") == 1) & ~removed) | added).select(*KEYS)
