"""Corpus build: pages of all sites to extracts and relation graph, as one plan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.functions.urls import clean_url
from leafgraph.operators.extracts import ID_SPACE, build_extracts, relations
from leafgraph.operators.links import extract_links, link_edges, links_per_doc, page_hierarchy, redirect_links, link_targets
from leafgraph.operators.parse import SiteConfig, page_titles, parse_pages
from leafgraph.operators.rules import Rules
from leafgraph.operators.sections import build_sections
from leafgraph.operators.tables import replace_tables
from leafgraph.session import materialize
from leafgraph.sources.pages import number_pages

Configs = SiteConfig | Mapping[str, SiteConfig]


@dataclass
class Corpus:
    extracts: DataFrame
    edges: DataFrame


def _facts(pages: DataFrame) -> list[str]:
    return [c for c in ("site", "path", "last_modified", "page_no") if c in pages.columns]


def base_rows(spark: SparkSession, configs: Configs | Rules) -> DataFrame:
    """The root row of every site; roots have negative ids in configuration order."""
    rules = Rules(configs)
    empty = F.array().cast("array<string>")
    return rules.table(spark).select("rules.*").select(
        (F.lit(-1) - F.col("site_no")).cast("long").alias("doc_id"), clean_url(F.col("base_url")).alias("url"),
        empty.alias("titles"), empty.alias("parent_titles"), F.lit("").alias("text"), F.lit(0).alias("split_idx"),
        F.col("name").alias("site"))


def read_sections(pages: DataFrame, configs: Configs) -> tuple[DataFrame, DataFrame]:
    """``(sections, pages)``: what the pages hold by themselves, and the pages with their titles, without html.

    The parsed rows feed page titles, tables and sections, so they are written once and read back pruned instead of
    parsing every page again for each use.
    """
    parsed = materialize(parse_pages(pages, configs), "parsed")
    titled = pages.select("page_id", "url", *_facts(pages)).join(page_titles(parsed), "page_id", "left")
    sites = [configs] if isinstance(configs, SiteConfig) else configs.values()
    if any(rule["function"] == "convert_table" for site in sites for rule in site.replacements):
        parsed = replace_tables(parsed)
    return build_sections(parsed, configs), titled


def place_sections(sections: DataFrame, pages: DataFrame, configs: Configs | Rules, among: DataFrame | None = None) -> DataFrame:
    """Extracts of ``pages(page_id, url, page_title[, page_no, site, path, last_modified])`` from their sections, below the
    parent pages that the URLs name, one of ``among`` (by default of ``pages``). Links are still as written in the page."""
    rules = Rules(configs)
    ruled = rules.attach(pages)
    tree = page_hierarchy(ruled, rules.value("base_url"), among, "page_no" if "page_no" in pages.columns else "page_id")
    root = F.lit(-1) - rules.value("site_no")
    facts = ruled.select("page_id", "url", root.cast("long").alias("_root"), *[c for c in _facts(pages) if c != "site"]).join(
        tree, "page_id").withColumn("parent_page_doc", F.coalesce(F.col("parent_page_id") * ID_SPACE, "_root")).drop(
        "parent_page_id", "_root")
    return build_extracts(sections, facts, rules)


def redirected(extracts: DataFrame, configs: Configs | Rules, redirects: DataFrame | None = None) -> DataFrame:
    """The links of extracts that their site doesn't ignore, with the key of their target."""
    rules = Rules(configs)
    links = extract_links(extracts.where(F.col("links").isNotNull()))
    return redirect_links(rules.attach(links), redirects, rules.value("link_ignore_regex")).drop(*rules.carried)


def build_corpus(pages: DataFrame, configs: Configs, redirects: DataFrame | None = None) -> Corpus:
    """Extracts with resolved links, and the graph of structural and link edges.

    ``configs`` is one configuration, or one per value of the pages' ``site`` column: all sites are one parse and one plan.
    Pages without a ``page_no`` are numbered in URL order.
    """
    sections, titled = read_sections(pages, configs)
    body = place_sections(sections, titled if "page_no" in titled.columns else number_pages(titled), configs)
    extracts = materialize(body.unionByName(base_rows(pages.sparkSession, configs), allowMissingColumns=True), "extracts")
    body = extracts.where(F.col("page_id").isNotNull())
    resolved = link_targets(redirected(body, configs, redirects), extracts)
    edges = relations(body).unionByName(link_edges(resolved))
    return Corpus(extracts.drop("links").join(links_per_doc(resolved), "doc_id", "left"), edges)
