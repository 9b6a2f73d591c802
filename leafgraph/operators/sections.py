"""Parsed rows to a section tree.

Everything works on one hash partitioning by ``page_id``: the windows, the aggregations and the joins below name
``page_id`` among their keys, so Spark plans a single exchange after the parse. A page is one html string and thus
bounded; no key that spans pages is ever grouped here.

A section is named by ``sec_no`` = 16 * position of its heading (+ j for the j-th made-up intro below that heading);
``sec_no`` order is reading order and the text before the first heading is section 0.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.functions.registry import resolve
from leafgraph.functions.text import clean_text, strip
from leafgraph.operators.parse import SiteConfig
from leafgraph.operators.rules import Rules
from leafgraph.session import by_page

STEP = 1024  # section numbers between two positions; more split rules than this are refused
_EMPTY_LINKS = "array<struct<pos:int,title:string,href:string>>"


def _last(condition: Column, value: Column) -> Column:
    """Last ``value`` up to this row of the page among rows with ``condition``."""
    return F.last(F.when(condition, value), ignorenulls=True).over(Window.partitionBy("page_id").orderBy("pos"))


def acceptable_heads(config: SiteConfig | Rules) -> Column:
    """Which candidate heads may split: not blank, not one single link, and passing a named predicate if there is one."""
    rules = Rules(config)
    only_link = F.coalesce(F.replace(F.col("link_text"), F.lit("\n"), F.lit("")) == F.col("text"), F.lit(False))
    ok = ((F.col("kind") == "head") & (~rules.value("ignore_empty_split_tags") | (strip(F.col("text")) != ""))
          & (rules.value("allow_link_splits") | ~only_link))
    for name in sorted({f for own in rules.every("split_functions") for f in own if f}):
        here = F.try_element_at(rules.value("split_functions"), F.col("level") + 1) == name
        ok &= ~F.coalesce(here, F.lit(False)) | resolve("split", name)()
    return ok


def mark_splits(rows: DataFrame, config: SiteConfig | Rules) -> DataFrame:
    """Add ``split``: mandatory levels always split, deeper ones only inside a section over the length limit."""
    rules = Rules(config)
    ok, mandatory = acceptable_heads(rules), rules.value("mandatory_splits")
    rows = rows.withColumn("_ok", ok).withColumn("split", F.col("_ok") & (F.col("level") <= mandatory))
    for level in range(min(rules.every("mandatory_splits")) + 1, rules.levels):
        section = Window.partitionBy("page_id", "_sec")
        rows = (
            rows.withColumn("_sec", F.coalesce(_last(F.col("split"), F.col("pos")), F.lit(0)))
            .withColumn("_size", F.sum(F.when(~F.col("split"), F.length("body")).otherwise(0)).over(section))
            .withColumn("split", F.col("split") | (
                F.col("_ok") & (F.col("level") == level) & (F.lit(level) > mandatory)
                & (F.col("_size") > rules.value("max_extract_len"))))
            .drop("_sec", "_size"))
    return rows.drop("_ok")


def place_rows(rows: DataFrame, config: SiteConfig | Rules) -> DataFrame:
    """Add the section position and, on splitting heads, the parent position and the anchor."""
    n = Rules(config).levels
    if n >= STEP:
        raise ValueError(f"at most {STEP - 1} split rules")
    split, level, pos = F.col("split"), F.col("level"), F.col("pos")
    before = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    # the walk at level i started at the last head of that level or above, before this one
    since = {f"_s{i}": F.max(F.when(split & (level <= i), pos)).over(before) for i in range(n)}
    rows = rows.withColumns({f"_h{i}": _last(split & (level == i), pos) for i in range(n)}).withColumns(since)
    rows = rows.withColumn("sec_pos", F.coalesce(_greatest([F.col(f"_h{i}") for i in range(n)]), F.lit(0)))
    # an anchor inside a heading that splits belongs to the removed heading text
    loose = (F.col("kind") == "anchor") & (F.coalesce(F.col("in_head"), F.lit(-1)) != F.col("sec_pos"))
    rows = rows.withColumns({"_apos": _last(loose, pos), "_aname": _last(loose, F.col("text"))})
    parent = _by_level(level, [F.lit(None).cast("int")] + [
        _greatest([F.col(f"_h{j}") for j in range(i)]) for i in range(1, n)])
    start = _by_level(level, [F.col(f"_s{i}") for i in range(n)])
    rows = rows.withColumns({
        "parent_pos": F.when(split, parent),
        "anchor": F.when(split & (F.col("_apos") > F.coalesce(start, F.lit(0))), F.col("_aname"))})
    return rows.drop("_apos", "_aname", *since)


def _by_level(level: Column, values: list[Column]) -> Column:
    return reduce(lambda e, iv: e.when(level == iv[0], iv[1]), list(enumerate(values))[1:],
                  F.when(level == 0, values[0]))


def _greatest(cols: list[Column]) -> Column:
    """``greatest`` of any number of integer columns, nulls ignored."""
    return F.greatest(*cols, *[F.lit(None).cast("int")] * (2 - min(len(cols), 2)))


def section_contents(rows: DataFrame) -> DataFrame:
    """One row per section: heading facts, serialised text, and the last link per link text."""
    split, kind = F.col("split"), F.col("kind")
    body = F.when(split, F.lit(None)).when(
        (kind == "head") & F.col("tag").rlike("^h[1-6]$"), F.concat(F.lit("\n\n# "), F.col("body"), F.lit("\n\n"))
    ).otherwise(F.col("body"))
    in_removed_head = F.coalesce(F.col("in_head") == F.col("sec_pos"), F.lit(False))
    link = (kind == "link") & ~in_removed_head
    newest = F.row_number().over(Window.partitionBy("page_id", "sec_pos", "kind", "text").orderBy(F.desc("pos")))
    heading = {c: F.first(F.when(split, F.col(c)), ignorenulls=True).alias(c)
               for c in ("level", "parent_pos", "text", "anchor", *[c for c in rows.columns if c.startswith("_h")])}
    heading["text"] = heading["text"].alias("title")
    carried = [F.first(c).alias(c) for c in rows.columns if c == "rules"]
    return (
        rows.withColumns({"_body": body, "_link": F.coalesce(link, F.lit(False))})
        .where(split | F.col("_link") | F.col("_body").isNotNull())
        .withColumn("_newest", F.when(F.col("_link"), newest))
        .groupBy("page_id", F.col("sec_pos").alias("pos"))
        .agg(F.array_sort(F.collect_list(F.when(F.col("_body").isNotNull(), F.struct("pos", "_body")))).alias("parts"),
             F.array_sort(F.collect_list(F.when(F.col("_newest") == 1, F.struct(
                 "pos", F.col("text").alias("title"), "href")))).alias("links"),
             *heading.values(), *carried)
        .withColumn("text", clean_text(F.array_join(F.col("parts")["_body"], "")))
        .withColumn("level", F.coalesce("level", F.lit(-1)))
        .drop("parts"))


def title_paths(sections: DataFrame, config: SiteConfig | Rules) -> DataFrame:
    """Add ``parent_sec``, the title path and the anchor in force.

    A heading that is deeper than its later siblings hangs below a made-up section titled ``Intro`` (the leading
    untitled section at the top of a page): ``_rank`` counts the levels among siblings, 1 being the highest.
    """
    rules = Rules(config)
    n = rules.levels
    level, lead = F.col("level"), F.col("level") < 0
    siblings = Window.partitionBy("page_id", F.coalesce("parent_pos", F.lit(0)), lead)
    number = F.row_number().over(
        Window.partitionBy("page_id", F.coalesce("parent_pos", F.lit(0)), "level").orderBy("pos"))
    title = F.when(lead, F.lit("")).otherwise(F.col("title"))
    if any(rules.every("no_title_splits")):
        title = F.when(F.array_contains(rules.value("no_title_splits"), level), number.cast("string")).otherwise(title)
    rows = sections.withColumns({"title": title, "_rank": F.when(~lead, F.dense_rank().over(siblings.orderBy("level")))})
    top, rank = F.col("parent_pos").isNull(), F.col("_rank")
    base = F.coalesce(F.col("parent_pos"), F.lit(0)).cast("long") * STEP
    none = F.array().cast("array<string>")
    own = F.when(lead, F.array(F.lit(""))).otherwise(F.concat(
        F.when(top & (rank > 1), F.array(F.lit(""))).otherwise(none),
        F.array_repeat(F.lit("Intro"), F.greatest(rank - F.when(top, 2).otherwise(1), F.lit(0))), F.array("title")))
    rows = rows.withColumns({
        "parent_sec": F.when(lead | (top & (rank == 1)), F.lit(None)).when(top, base + rank - 2)
        .otherwise(base + rank - 1).cast("long"),
        "_own": own})
    marked = F.struct(F.col("pos").alias("p"), F.col("anchor").alias("a"))
    rows = rows.withColumns({
        **{f"_t{i}": _last(level == i, F.col("_own")) for i in range(n)},
        **{f"_a{i}": _last((level == i) & F.col("anchor").isNotNull(), marked) for i in range(n)}})
    paths, anchors = [F.when(lead, F.col("_own")).otherwise(none)], []
    for i in range(n):
        # the last heading of level i is an ancestor (or the heading itself) when no higher one came after it
        above = F.coalesce(_greatest([F.col(f"_h{j}") for j in range(i)]), F.lit(0)) if i else F.lit(0)
        paths.append(F.when((level >= i) & (F.col(f"_h{i}") > above), F.col(f"_t{i}")).otherwise(none))
        anchors.insert(0, F.when((level >= i) & (F.col(f"_a{i}")["p"] > above), F.col(f"_a{i}")["a"]))
    return rows.withColumns({"titles": F.concat(*paths), "anchor": F.coalesce(*anchors)}).select(
        "page_id", "pos", "level", "parent_pos", "parent_sec", "title", "titles", "anchor", "text", "links", "_rank",
        *rules.carried)


def count_children(rows: DataFrame) -> DataFrame:
    """Add ``n_children`` and ``depth`` (levels among the children) to every section.

    Each section appears once as itself and once, without its text, under its parent's key; a window over the key
    brings both together without leaving the page.
    """
    me = F.struct(F.lit(True).alias("own"), F.col("pos").alias("key"), F.lit(None).cast("int").alias("rank"))
    as_child = F.struct(F.lit(False).alias("own"), F.coalesce("parent_pos", F.lit(0)).alias("key"),
                        F.col("_rank").alias("rank"))
    roles = F.when(F.col("level") < 0, F.array(me)).otherwise(F.array(me, as_child))
    under = Window.partitionBy("page_id", "key")
    light = {c: F.when(F.col("own"), F.col(c)).alias(c) for c in ("text", "links", "titles")}
    return (
        rows.select("*", F.inline(roles))
        .select(*[light.get(c, F.col(c)) for c in rows.columns], "own", "key", "rank")
        .withColumns({"n_children": F.count(F.when(~F.col("own"), 1)).over(under), "depth": F.max("rank").over(under)})
        .where("own").drop("own", "key", "rank"))


def with_intros(rows: DataFrame) -> DataFrame:
    """Add the made-up sections; the text under the heading moves to the innermost of them."""
    lead = F.col("level") < 0
    first = F.when(lead, 2).otherwise(1)  # at the top of a page the leading section itself is the first intro
    n_new = F.greatest(F.coalesce(F.col("depth"), F.lit(1)) - first, F.lit(0))
    sec = F.col("pos").cast("long") * STEP
    j = F.col("_j")
    none = F.array().cast(_EMPTY_LINKS)
    made_up, holds_text = j > 0, j == n_new
    n_children = (F.when(~lead & (n_new == 0), F.col("n_children"))
                  .when(lead & (n_new == 0), F.when(F.coalesce(F.col("depth"), F.lit(1)) > 1, 1).otherwise(0))
                  .otherwise(1))
    return rows.withColumn("_j", F.explode(F.sequence(F.lit(0), n_new))).select(
        "page_id", (sec + j).alias("sec_no"),
        F.when(made_up, sec + j - 1).otherwise(F.col("parent_sec")).alias("parent_sec"),
        F.when(made_up, F.lit(-1)).otherwise(F.col("level")).alias("level"),
        F.when(made_up, F.lit("Intro")).otherwise(F.col("title")).alias("title"),
        F.concat("titles", F.array_repeat(F.lit("Intro"), j)).alias("titles"), "anchor",
        F.when(holds_text, F.coalesce("text", F.lit(""))).otherwise(F.lit("")).alias("text"),
        F.when(holds_text, F.coalesce("links", none)).otherwise(none).alias("links"),
        n_children.cast("long").alias("n_children"), *[c for c in rows.columns if c == "rules"])


def build_sections(parsed: DataFrame, config: SiteConfig | Mapping[str, SiteConfig] | Rules) -> DataFrame:
    """``(page_id, sec_no, parent_sec, level, title, titles, anchor, text, links, n_children)``, blank leaves dropped.

    One pass over the parsed rows: a single exchange by page, then windows, one aggregation and row expansion. With one
    configuration per site, sections carry the ``rules`` of theirs.
    """
    rules = Rules(config)
    rows = place_rows(mark_splits(rules.attach(by_page(parsed, parsed)), rules), rules)
    sections = with_intros(count_children(title_paths(section_contents(rows), rules)))
    return sections.where((strip(F.col("text")) != "") | (F.col("n_children") > 0))
