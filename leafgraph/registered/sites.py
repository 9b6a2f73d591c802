"""Site configurations: read from files that Spark writes, and many sites as one plan.

Every source of ``documents`` is a site of its own. ``pages`` are two sites with different rules.
"""

from __future__ import annotations

import html as markup

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.functions.registry import register
from leafgraph.operators.parse import SiteConfig
from leafgraph.operators.rules import Rules
from leafgraph.plans.corpus import build_corpus
from leafgraph.registered.base import Tables, query, sql_squeeze, squeeze
from leafgraph.registered.pages import _H1, _REST, sql_text
from leafgraph.session import work_dir
from leafgraph.sources.config import read_site_table, site_configs


def site_file(t: Tables) -> str:
    """The folder of a configuration file with a site per source, an example and some settings of each kind."""
    site = F.struct(
        F.concat(F.lit("https://"), "source", F.lit(".example/"), F.min("lang"), F.lit("/docs/")).alias("base_url"),
        F.create_map(F.lit("id"), F.min("lang")).alias("main_content_attrs"),
        F.array(F.create_map(F.lit("name"), F.lit("nav")), F.create_map(F.lit("class"), F.max("lang"))).alias("remove_tag_attrs"),
        F.when(F.count("*") % 2 == 0, F.array(F.struct(F.create_map(F.lit("name"), F.lit("table")).alias("attrs"), F.lit("convert_table")
                                                       .alias("function")))).alias("replacements"),
        F.when(F.count("*") % 3 == 0, F.lit(1)).alias("mandatory_splits"),
        F.create_map(F.lit("faculty"), F.max("source")).alias("metadata"),
        F.lit("default_extract_metadata").alias("metadata_extractor"))
    sites = t.documents.groupBy("source").agg(F.to_json(site).alias("site"))
    entries = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "source", F.lit('": '), "site"))), ", ")
    text = sites.agg(F.concat(  # a hand-written file would have a site per line as well
        F.lit("{ /* all sites */ general_config: {max_extract_len: 700, encoding: 'latin-1', link_ignore_regex: 'tel:.*'}, "
              "dump_configs: {example_config: {base_url: 'unused'}, "), entries, F.lit("}}")).alias("value"))
    folder = work_dir(t.spark, "config")
    text.coalesce(1).write.text(folder)
    return folder


@query("s9_read_site_config", """SELECT source AS name, source || '.example/' || min(lang) || '/docs' AS dump_path,
      'https://' || source || '.example/' || min(lang) || '/docs/' AS base_url, 'id=' || min(lang) AS main_content,
      'name=nav,class=' || max(lang) AS removed, (count(*) % 2 = 0) AS converts,
      CASE WHEN count(*) % 3 = 0 THEN 1 ELSE 3 END::INTEGER AS mandatory_splits, source AS faculty, 700::INTEGER AS max_extract_len,
      'latin-1' AS encoding, 'tel:.*' AS link_ignore_regex, 5::INTEGER AS n_levels
    FROM documents GROUP BY source""")
def s9(t: Tables) -> DataFrame:
    """The file as a table, and what the configurations made of it say."""
    table = read_site_table(t.spark, site_file(t))
    configs = site_configs(table)
    pairs = lambda rules: ",".join(f"{k}={v}" for rule in rules for k, v in rule.items())
    read = t.spark.createDataFrame(
        [(name, pairs([c.main_content_attrs]), pairs(c.remove_tag_attrs), any(r["function"] == "convert_table" for r in c.replacements),
          c.encoding) for name, c in configs.items()],
        "name string, main_content string, removed string, converts boolean, encoding string")
    rules = Rules(configs).table(t.spark).select("rules.*").select(
        "name", "mandatory_splits", "faculty", "max_extract_len", "link_ignore_regex", F.size("split_functions").alias("n_levels"))
    return table.select("name", "dump_path", "base_url").join(read, "name").join(rules, "name")


def announce(element, url: str) -> str:
    """A replacement function of our own: the heading tells where it stands."""
    return f"<h1>{markup.escape(element.text())} ({url.rpartition('=')[2]})</h1>"


def two_sites(t: Tables) -> tuple[DataFrame, dict[str, SiteConfig]]:
    register("replacement", "announce", announce)
    odd = F.col("page_id") % 2 == 1
    links = F.concat(F.lit('<p><a href="tel:12">call</a> <a href="/x/y.html">see</a></p></article>'))
    pages = t.pages.select(
        "page_id", F.when(odd, "odd").otherwise("even").alias("site"),
        F.concat(F.when(odd, "https://odd.example/?p=").otherwise("https://even.example/?p="), F.col("page_id").cast("string")).alias("url"),
        F.replace("html", F.lit("</article>"), links).alias("html"))
    return pages, {
        "even": SiteConfig(base_url="https://even.example", main_content_attrs={"name": "article"}, max_extract_len=1 << 20,
                           link_ignore_regex="tel:.*", metadata={"faculty": "Even", "campus": "north"}),
        "odd": SiteConfig(base_url="https://odd.example", main_content_attrs={"name": "article"}, max_extract_len=1 << 20,
                          replacements=({"attrs": {"name": "h1"}, "function": "announce"},), split_attrs=({"name": "h1"},),
                          mandatory_splits=0, link_ignore_regex="/x.*", no_title_splits=())}


_BODY = sql_squeeze(f"regexp_replace({sql_text(_REST)}, '#+', '', 'g')") + " || ' call see'"


@query("e15_combine_sites", f"""SELECT page_id, CASE WHEN page_id % 2 = 1 THEN 'odd' ELSE 'even' END AS site,
      CASE WHEN page_id % 2 = 1 THEN {sql_text(_H1)} || ' (' || page_id || ')' ELSE {sql_text(_H1)} END AS path, {_BODY} AS body,
      CASE WHEN page_id % 2 = 0 THEN 'Even' END AS faculty, CASE WHEN page_id % 2 = 0 THEN 'north' END AS campus,
      CASE WHEN page_id % 2 = 1 THEN 'call tel:12' ELSE 'see https://even.example/x/y' END AS links,
      CASE WHEN page_id % 2 = 1 THEN -2 ELSE -1 END::BIGINT AS parent
    FROM pages""")
def e15(t: Tables) -> DataFrame:
    """Both sites in one parse and one plan: their own replacement, split rules, constants, roots and ignored links."""
    rows = build_corpus(*two_sites(t)).extracts.where("page_id IS NOT NULL")
    links = F.array_join(F.transform("links", lambda l: F.concat(l["title"], F.lit(" "), F.regexp_replace(
        l["url"], "^.*(tel:)", "$1"))), ", ")
    return rows.select("page_id", "site", squeeze(F.array_join("titles", " / ")).alias("path"), squeeze(F.col("text")).alias("body"),
                       "faculty", F.col("meta")["campus"].alias("campus"), links.alias("links"), "parent")
