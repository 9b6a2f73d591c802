"""Site configurations from a JSON file with comments."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import leafgraph.operators.extracts  # noqa: F401 - registers the default metadata and context functions
from leafgraph.functions.registry import resolve
from leafgraph.operators.parse import DEFAULT_SPLITS, SiteConfig

REQUIRED = ("base_url", "main_content_attrs")
EXAMPLE = "example_config"
_ATTRS = "map<string,string>"
_SITE = (
    f"struct<base_url: string, main_content_attrs: {_ATTRS}, title_attrs: {_ATTRS}, "
    f"remove_tag_attrs: array<{_ATTRS}>, replacements: array<struct<attrs: {_ATTRS}, `function`: string>>, "
    f"split_attrs: array<{_ATTRS}>, mandatory_splits: int, ignore_empty_split_tags: boolean, "
    f"allow_link_splits: boolean, no_title_splits: array<int>, metadata: {_ATTRS}, metadata_extractor: string, "
    "parent_context_extractor: string>")
SCHEMA = (f"general_config struct<max_extract_len: int, encoding: string, link_ignore_regex: string>, "
          f"dump_configs map<string, {_SITE}>")


def read_site_table(spark: SparkSession, path: str) -> DataFrame:
    """One row per configured site; the example entry is skipped and a missing required key raises."""
    raw = (spark.read.schema(SCHEMA).option("multiLine", True).option("allowComments", True)
           .option("allowUnquotedFieldNames", True).option("allowSingleQuotes", True).json(path))
    rows = (raw.select("general_config", F.explode("dump_configs").alias("name", "site"))
            .where(F.col("name") != EXAMPLE))
    bad = F.filter(F.array(*[F.when(F.col(f"site.{k}").isNull(), F.lit(k)) for k in REQUIRED]),
                   lambda k: k.isNotNull())
    checked = F.when(F.size(bad) > 0, F.raise_error(F.concat(
        F.lit("Missing required key in the dump config for "), F.col("name"), F.lit(": "), F.array_join(bad, ", ")))
        .cast("string")).otherwise(F.col("name"))
    segments = F.filter(F.split("site.base_url", "/"), lambda s: (s != "") & ~s.startswith("http"))
    return rows.select(checked.alias("name"), F.array_join(segments, "/").alias("dump_path"), "site.*",
                       "general_config")


def site_configs(table: DataFrame) -> dict[str, SiteConfig]:
    """The configurations as objects for the parse step. Sites are configured by hand, so there are few."""
    configs = {}
    for row in table.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias("j")).collect():
        site = json.loads(row["j"])
        for rule in site.get("replacements", []):
            resolve("replacement", rule["function"])
        for kind, key in (("metadata", "metadata_extractor"), ("context", "parent_context_extractor")):
            if key in site:
                resolve(kind, site[key])
        known = {k: v for k, v in site.items() if k in SiteConfig.__dataclass_fields__}
        for key in ("remove_tag_attrs", "replacements", "split_attrs", "no_title_splits"):
            if key in known:
                known[key] = tuple(known[key])
        known.setdefault("split_attrs", DEFAULT_SPLITS)
        general = site.get("general_config") or {}
        known |= {k: general[k] for k in ("max_extract_len", "encoding", "link_ignore_regex") if general.get(k) is not None}
        configs[site["name"]] = SiteConfig(**known)
    return configs
