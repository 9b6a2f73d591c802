"""Sections to extracts: ids, chunks, links per chunk, metadata, context, relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgraph import schemas as S
from leafgraph.functions.registry import register, resolve
from leafgraph.operators.chunking import MAX_LEN, split_long_texts
from leafgraph.operators.parse import SiteConfig
from leafgraph.operators.rules import CONSTANTS, Rules

# An extract id is the page's number * ID_SPACE + place within the page: unique, in reading order, and the same for as long as
# the page keeps its number. The number is the page's id where pages have no ``page_no``.
ID_SPACE = 1 << 20


def assign_doc_ids(rows: DataFrame, *order: str, page: str = "page_id") -> DataFrame:
    """Add ``doc_id`` by reading order inside the page."""
    place = F.row_number().over(Window.partitionBy(page).orderBy(*order)) - 1
    checked = F.when(place < ID_SPACE, place).otherwise(
        F.raise_error(F.lit(f"a page has more than {ID_SPACE} extracts")).cast("int"))
    number = "page_no" if "page_no" in rows.columns else page
    return rows.withColumn("doc_id", F.col(number) * F.lit(ID_SPACE) + checked)


def anchor_url(url: Column, anchor: Column) -> Column:
    """The page URL with the fragment replaced by the anchor in force, if there is one."""
    return F.when(anchor.isNotNull(), F.concat(F.regexp_replace(url, r"(?s)#.+\z", ""), F.lit("#"), anchor)
                  ).otherwise(url)


def chunk_links(links: Column, text: Column, n_chunks: Column) -> Column:
    """Links of a chunk: all of them in an undivided section, else those whose text occurs in the chunk."""
    return F.when(n_chunks > 1, F.filter(links, lambda l: F.contains(text, l["title"]))).otherwise(links)


@dataclass(frozen=True)
class TitleRules:
    """Patterns that tell which titles name a faculty, a program or a specialization."""

    faculty: str
    program: str
    specialization: str


# Beginnings and endings of titles.
FACULTY_BEGINS = ("The Faculty of", "The School of")
FACULTY_ENDS = ("College(s)?", r"School of \w+")
PROGRAM_BEGINS = ("Bachelor of", "Master of", "Doctor of", "Diploma in", "Certificate in", "(Dual Degree )?Program in",
                  r"B.[\w\.]+ in")
PROGRAM_ENDS = ("Program", "Programs")
SPECIALIZATION_BEGINS = ("Combined Major", "Major", "Minor", "Combined Honours", "Honours")
SPECIALIZATION_ENDS = ("Major", "Minor")


def title_pattern(begins: tuple[str, ...], ends: tuple[str, ...], before: str = "") -> str:
    """A whole title that starts with one of ``begins`` or stops with one of ``ends``."""
    return f"^({before}({'|'.join(begins)}).+|.+({'|'.join(ends)}))$"


DEFAULT_RULES = TitleRules(
    faculty=title_pattern(FACULTY_BEGINS, FACULTY_ENDS),
    program=title_pattern(PROGRAM_BEGINS, PROGRAM_ENDS, before=r"(\w+\s)?"),
    specialization=title_pattern(SPECIALIZATION_BEGINS, SPECIALIZATION_ENDS))


def title_metadata(parent_titles: Column, titles: Column, rules: TitleRules = DEFAULT_RULES) -> dict[str, Column]:
    """First title that matches the faculty and the program rule, all that match the specialization rule."""
    empty = F.array().cast("array<string>")
    path = F.concat(F.coalesce(parent_titles, empty), F.coalesce(titles, empty))

    def matching(pattern: str) -> Column:
        return F.filter(path, lambda t: t.rlike(pattern))

    specs = matching(rules.specialization)
    return {
        "faculty": F.try_element_at(matching(rules.faculty), F.lit(1)),
        "program": F.try_element_at(matching(rules.program), F.lit(1)),
        "specialization": F.when(F.size(specs) > 0, specs),
    }


# Fixed values of the context rule.
CONTEXT_WORDS = ("below", "as follows")
CONTEXT_MAX = 400


def parent_context(text: Column, words: tuple[str, ...] = CONTEXT_WORDS, max_len: int = CONTEXT_MAX) -> Column:
    """A short text that points at what follows is context for the child extracts; null otherwise."""
    points = F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    return F.when((F.length(text) < max_len) & points, text)


register("metadata", "default_extract_metadata", title_metadata)
register("context", "parent_context_extractor", parent_context)


def site_constants(rows: DataFrame, metadata: dict, columns: tuple[str, ...] = CONSTANTS) -> DataFrame:
    """Constants of a site override what was extracted; other keys go into the ``meta`` map."""
    return _constants(rows, Rules(SiteConfig(metadata={k: v for k, v in metadata.items()})), columns)


def _constants(rows: DataFrame, rules: Rules, columns: tuple[str, ...] = CONSTANTS) -> DataFrame:
    rows = rows.withColumns({c: F.coalesce(rules.value(c), F.col(c)) if c in rows.columns else rules.value(c)
                             for c in columns})
    own = rules.value("meta")
    if "meta" in rows.columns:
        had = F.coalesce("meta", F.create_map().cast("map<string,string>"))
        own = F.map_concat(F.map_filter(had, lambda k, v: ~F.map_contains_key(own, k)), own)
    return rows.withColumn("meta", own)


def build_extracts(sections: DataFrame, pages: DataFrame, config: SiteConfig | Rules) -> DataFrame:
    """Chunked extracts of the sections of a site, or of all sites whose settings the sections carry.

    ``pages`` brings ``page_id, url, parent_titles, parent_page_doc`` (the first extract of the parent page, or the
    base row) and optionally ``page_no``, ``path`` and ``last_modified``. All joins and windows keep the partitioning by page.
    """
    rules = Rules(config)
    none = F.lit(None).cast("string")
    numbered = [c for c in ("page_no",) if c in pages.columns]
    if numbered:
        sections = sections.join(pages.select("page_id", "page_no"), "page_id")
        pages = pages.drop("page_no")
    context = rules.chosen("context", "parent_context_extractor", lambda f: f(F.col("text")), none)
    chunks = split_long_texts(
        sections.select("page_id", "sec_no", "parent_sec", "titles", "anchor", "links", "text",
                        context.alias("gives_context"), *numbered, *rules.carried), max_len=rules.value("max_extract_len"))
    n_chunks = F.count("*").over(Window.partitionBy("page_id", "sec_no"))
    rows = with_parent_doc(assign_doc_ids(chunks.withColumn("n_chunks", n_chunks), "sec_no", "split_idx"))
    own = rows.join(pages, "page_id").select(
        "doc_id", "page_id", "sec_no", "parent_sec",
        anchor_url(F.col("url"), F.col("anchor")).alias("url"),
        F.coalesce("parent_doc", "parent_page_doc").alias("parent"),
        "titles", "parent_titles", "text",
        chunk_links(F.col("links"), F.col("text"), F.col("n_chunks")).alias("links"),
        "context", "split_idx", "n_chunks",
        *[F.col(c).alias(name) for c, name in (("path", "orig_doc"), ("last_modified", "last_modified")) if c in pages.columns],
        *rules.carried)
    found = {"faculty": none, "program": none, "specialization": F.lit(None).cast("array<string>")}
    functions = sorted({f for f in rules.every("metadata_extractor") if f})
    for name in functions:
        for column, value in resolve("metadata", name)(F.col("parent_titles"), F.col("titles")).items():
            before = found.get(column, F.lit(None))
            found[column] = value if rules.single else F.when(
                rules.value("metadata_extractor") == name, value).otherwise(before)
    site = rules.value("name")
    return _constants(own.withColumns(found), rules).withColumn("site", site).drop(*rules.carried)


def with_parent_doc(rows: DataFrame) -> DataFrame:
    """Add ``parent_doc`` and ``context``: id and context of the first chunk of the parent section.

    First chunks appear a second time under their own section's key, and a window over the key hands their id and
    context to the children: no join, and no second run of the plan that made ``rows``.
    """
    child = F.struct(F.lit(True).alias("child"), F.coalesce("parent_sec", F.lit(-1).cast("long")).alias("key"))
    giver = F.struct(F.lit(False).alias("child"), F.col("sec_no").alias("key"))
    roles = F.when(F.col("split_idx") == 0, F.array(child, giver)).otherwise(F.array(child))
    under = Window.partitionBy("page_id", "key")
    given = ~F.col("child")
    light = {c: F.when(F.col("child"), F.col(c)).alias(c) for c in ("text", "links", "titles")}
    return (
        rows.select("*", F.inline(roles))
        .select(*[light.get(c, F.col(c)) for c in rows.columns], "child", "key")
        .withColumns({"parent_doc": F.max(F.when(given, F.col("doc_id"))).over(under),
                      "context": F.max(F.when(given, F.col("gives_context"))).over(under)})
        .where("child").drop("child", "key", "gives_context"))


def relations(extracts: DataFrame) -> DataFrame:
    """Structural edges: page to root extract (1), extract to child (2), previous sibling to extract (4, 5 if split)."""
    order = Window.partitionBy("page_id", F.coalesce("parent_sec", F.lit(-1))).orderBy("sec_no", "split_idx")
    rows = extracts.withColumn("_prev", F.lag("doc_id").over(order))
    kind = F.when(F.col("parent_sec").isNull(), S.PARENT_PAGE).otherwise(S.PARENT_EXTRACT)
    sib = F.when(F.col("split_idx") > 0, S.SPLIT_SIBLING).otherwise(S.SIBLING)
    # both edges of a row leave in one pass over the extracts
    pairs = F.array(
        F.struct(F.col("parent").alias("src"), F.col("doc_id").alias("dst"), kind.alias("type")),
        F.struct(F.col("_prev").alias("src"), F.col("doc_id").alias("dst"), sib.alias("type")))
    return rows.select(F.inline(F.filter(pairs, lambda e: e["src"].isNotNull())))


def previous_sibling(extracts: DataFrame) -> DataFrame:
    """``(doc_id, previous_id)`` among extracts of the same parent."""
    order = Window.partitionBy("page_id", F.coalesce("parent_sec", F.lit(-1))).orderBy("sec_no", "split_idx")
    return extracts.select("doc_id", F.lag("doc_id").over(order).alias("previous_id"))


def combine_sites(*sites: DataFrame) -> DataFrame:
    """One table with the union of the columns of all sites."""
    first, *rest = sites
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def default_chunks(documents: DataFrame, max_len: int = MAX_LEN) -> DataFrame:
    """Documents ``(doc_id, text)`` as undivided pages of one section: the chunk table of a plain text corpus."""
    return split_long_texts(documents.select("doc_id", "text"), max_len=max_len)
