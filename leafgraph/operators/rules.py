"""Settings of one or many sites, as columns.

Operators ask :class:`Rules` for a setting and get a constant where there is one site, and else a field of the row's
``rules``: one row of settings per site, joined to the pages by ``site``. So all sites are one plan, however many there are,
and settings are interpreted row by row.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.functions.registry import resolve
from leafgraph.operators.parse import SiteConfig

CONSTANTS = ("faculty", "program", "specialization")  # settings under ``metadata`` that override what was extracted
SCHEMA = (
    "site_no int, name string, base_url string, mandatory_splits int, ignore_empty_split_tags boolean, "
    "allow_link_splits boolean, no_title_splits array<int>, split_functions array<string>, max_extract_len int, "
    "metadata_extractor string, parent_context_extractor string, link_ignore_regex string, faculty string, program string, "
    "specialization array<string>, meta map<string,string>")


def _row(config: SiteConfig, site_no: int) -> dict:
    metadata = config.metadata
    specs = metadata.get("specialization")
    return {
        "site_no": site_no, "no_title_splits": list(config.no_title_splits),
        "split_functions": [rule.get("function") for rule in config.split_attrs],
        "faculty": metadata.get("faculty"), "program": metadata.get("program"),
        "specialization": [specs] if isinstance(specs, str) else specs and list(specs),
        "meta": {k: str(v) for k, v in metadata.items() if k not in CONSTANTS},
        **{c: getattr(config, c) for c in (
            "name", "base_url", "mandatory_splits", "ignore_empty_split_tags", "allow_link_splits", "max_extract_len",
            "metadata_extractor", "parent_context_extractor", "link_ignore_regex")}}


class Rules:
    """Settings by name. ``configs`` is one configuration, or one per value of the ``site`` column, in order."""

    def __init__(self, configs: SiteConfig | Mapping[str, SiteConfig] | Rules, site_no: int = 0):
        if isinstance(configs, Rules):
            self.__dict__.update(configs.__dict__)
            return
        self.single = isinstance(configs, SiteConfig)
        self.configs = {"": configs} if self.single else dict(configs)
        self.rows = {site: _row(c, site_no + n) | ({} if self.single else {"name": site})
                     for n, (site, c) in enumerate(self.configs.items())}
        self.levels = max((len(c.split_attrs) for c in self.configs.values()), default=0)

    @property
    def carried(self) -> list[str]:
        """What rows have to keep so that settings can be read from them."""
        return [] if self.single else ["rules"]

    def value(self, name: str) -> Column:
        if not self.single:
            return F.col("rules")[name]
        kind = dict(part.split(" ", 1) for part in SCHEMA.split(", "))[name]
        value = self.rows[""][name]
        if isinstance(value, list):
            return F.array(*map(F.lit, value)).cast(kind)
        if isinstance(value, dict):
            return F.create_map(*[F.lit(x) for pair in value.items() for x in pair]).cast(kind)
        return F.lit(value).cast(kind)

    def every(self, name: str) -> list:
        """All values of a setting."""
        return [row[name] for row in self.rows.values()]

    def chosen(self, kind: str, name: str, apply: Callable[[Callable], Column], otherwise: Column) -> Column:
        """``apply`` of the registered function that the setting ``name`` names, where it names one."""
        out = otherwise
        for function in sorted({f for f in self.every(name) if f}):
            found = apply(resolve(kind, function))
            out = found if self.single else F.when(self.value(name) == function, found).otherwise(out)
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """``(site, rules)``, a row per site. Sites are configured by hand."""
        rows = [(site, row) for site, row in self.rows.items()]
        return spark.createDataFrame(rows, f"site string, rules struct<{_struct(SCHEMA)}>")

    def attach(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with ``site``) and their settings; rows of a site that isn't configured go."""
        if self.single or "rules" in rows.columns:
            return rows
        return rows.join(self.table(rows.sparkSession), "site")


def _struct(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in (part.split(" ", 1) for part in schema.split(", ")))
