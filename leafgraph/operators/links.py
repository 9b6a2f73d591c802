"""Links between pages and extracts, page hierarchy, redirects, source notes.

The lookups below join a long side (links) with a side that has one row per URL. Many links may point at one URL; the
sort-merge joins are left to adaptive execution, which broadcasts the URL side when its measured size is small and
otherwise splits the partitions of hot URLs on the link side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph import schemas as S
from leafgraph.functions.urls import absolute_url, clean_url, url_host
from leafgraph.operators.parse import LINK_IGNORE

def page_links(parsed: DataFrame) -> DataFrame:
    """All links of the parsed pages: ``(page_id, pos, title, href)``."""
    return parsed.where(F.col("kind") == "link").select("page_id", "pos", F.col("text").alias("title"), "href")


def extract_links(extracts: DataFrame) -> DataFrame:
    """Links of extracts as rows ``(doc_id, url[, page_id, site], pos, title, href)``."""
    return extracts.select("doc_id", "url", *[c for c in ("page_id", "site") if c in extracts.columns], F.inline("links"))


def first_doc_per_url(docs: DataFrame, url: str = "url", doc_id: str = "doc_id") -> DataFrame:
    """``(clean_url, doc_id)``: the lowest id per cleaned URL, pre-aggregated before the shuffle."""
    return docs.groupBy(clean_url(F.col(url)).alias("clean_url")).agg(F.min(doc_id).alias("doc_id"))


def redirect_map(hops: DataFrame) -> DataFrame:
    """The final URL that was recorded last per redirected URL, from ``(original, final, seq)``."""
    return hops.groupBy("original").agg(F.max_by("final", "seq").alias("final"))


def redirect_links(links: DataFrame, redirects: DataFrame | None = None, ignore: str | Column = LINK_IGNORE) -> DataFrame:
    """``links`` (with ``url`` and ``href``) that are not ignored, with ``page_url`` (absolute, before ``#``), ``target_url``
    (after redirects) and ``target_key``, the cleaned URL by which a document is looked up.

    ``ignore`` is a pattern that ignored hrefs begin with, or a column of such patterns.
    """
    ignore = F.lit(ignore) if isinstance(ignore, str) else ignore
    rows = links.where(~F.rlike(F.col("href"), F.concat(F.lit("^(?:"), ignore, F.lit(")")))).withColumn(
        "_abs", absolute_url(F.col("url"), F.col("href")))
    page = F.substring_index("_abs", "#", 1)
    rows = rows.withColumns({"page_url": page, "_frag": F.substring(F.col("_abs"), F.length(page) + 1, F.length("_abs"))})
    if redirects is not None:
        moved = redirects.select(F.col("original").alias("page_url"), F.col("final").alias("_final"))
        rows = rows.join(moved, "page_url", "left")
    else:
        rows = rows.withColumn("_final", F.lit(None).cast("string"))
    rows = rows.withColumn("target_url", F.concat(F.coalesce("_final", "page_url"), "_frag"))
    return rows.withColumn("target_key", clean_url(F.col("target_url"))).drop("_abs", "_frag", "_final")


def link_targets(links: DataFrame, docs: DataFrame) -> DataFrame:
    """Redirected ``links`` with ``target_doc_id``: the first of ``docs(url, doc_id)`` at the cleaned URL, else null."""
    targets = first_doc_per_url(docs).select(
        F.col("clean_url").alias("target_key"), F.col("doc_id").alias("target_doc_id"))
    return links.join(targets, "target_key", "left")


def resolve_links(links: DataFrame, docs: DataFrame, redirects: DataFrame | None = None,
                  ignore: str | Column = LINK_IGNORE) -> DataFrame:
    """``links`` with ``target_url`` and ``target_doc_id`` (null for links that lead outside).

    ``links`` brings ``url`` and ``href``. Ignored hrefs go; the part before ``#`` is replaced by its redirect; the
    target is the first document at the cleaned URL.
    """
    return link_targets(redirect_links(links, redirects, ignore), docs).drop("target_key", "page_url")


def links_per_doc(resolved: DataFrame) -> DataFrame:
    """``(doc_id, links)``: the resolved links of every document in their order, as the extract table has them."""
    return resolved.groupBy("doc_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "title", F.col("target_url").alias("url"),
                                             F.col("target_doc_id").alias("doc_id")))),
        lambda l: F.struct(l["title"].alias("title"), l["url"].alias("url"), l["doc_id"].alias("doc_id"))).alias("links"))


def link_edges(resolved: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """One edge of type 3 per linked pair."""
    return (resolved.where(F.col("target_doc_id").isNotNull())
            .select(F.col(doc_id).alias("src"), F.col("target_doc_id").alias("dst"))
            .distinct().withColumn("type", F.lit(S.LINK_TO)))


def last_edge_wins(edges: DataFrame) -> DataFrame:
    """One edge per pair, a link replacing a structural edge: the older single-edge graph."""
    order = F.when(F.col("type") == S.LINK_TO, 100).otherwise(F.col("type"))
    return edges.groupBy("src", "dst").agg(F.max_by("type", order).alias("type"))


def page_folders(pages: DataFrame, base_url: Column | None = None) -> DataFrame:
    """``(page_id[, site], up, clean_url)``: every folder of a page's URL below the base, ``up`` levels above the page."""
    base = F.lit("") if base_url is None else base_url
    rest = F.filter(F.split(F.regexp_replace(clean_url(F.col("url")), r"^[A-Za-z]+://", ""), "/"), lambda s: s != "")
    scheme = F.regexp_extract(clean_url(F.col("url")), r"^([A-Za-z]+://)", 1)
    own = ["page_id", *_site(pages)]
    ups = pages.select(*own, scheme.alias("_scheme"), rest.alias("_seg"), base.alias("_base")).select(
        *own, "_base", F.explode(F.sequence(F.lit(0), F.size("_seg") - 1)).alias("up"), "_scheme", "_seg").select(
        *own, "_base", "up", F.concat("_scheme", F.array_join(
            F.slice("_seg", 1, F.size("_seg") - F.col("up")), "/")).alias("clean_url"))
    return ups.where((F.length("clean_url") > F.length("_base")) & (F.col("up") > 0)).drop("_base")


def page_hierarchy(pages: DataFrame, base_url: Column | None = None, among: DataFrame | None = None,
                   number: str = "page_id") -> DataFrame:
    """``(page_id, parent_page_id, parent_titles)`` from ``pages(page_id, url, page_title[, site])``.

    ``parent_page_id`` is the parent's ``number``.

    A page's parent is the page of its site at its folder, one of ``among`` (by default of ``pages``). Every page is joined
    with all its folders at once (as many as its URL is deep), so no recursion is needed; the chain counts up to the first
    folder without a page.
    """
    place = [*_site(pages), "clean_url"]
    at = (pages if among is None else among).withColumn("clean_url", clean_url(F.col("url"))).groupBy(*place).agg(
        F.min(F.struct("page_id", "page_title", F.col(number).alias("number"))).alias("at")).select(
        *place, F.col("at.number").alias("up_id"), F.col("at.page_title").alias("up_title"))
    # the page itself is its own step 0
    own = pages.select("page_id", F.lit(0).alias("up"), F.col(number).alias("up_id"),
                       F.col("page_title").alias("up_title"))
    steps = page_folders(pages, base_url).join(at, place).select("page_id", "up", "up_id", "up_title").unionByName(own)
    chain = F.array_sort(F.collect_list(F.struct("up", "up_id", "up_title")))
    unbroken = F.filter("chain", lambda s, i: s["up"] == i)
    return steps.groupBy("page_id").agg(chain.alias("chain")).select(
        "page_id", F.try_element_at(unbroken, F.lit(2))["up_id"].alias("parent_page_id"),
        F.filter(F.transform(F.reverse(unbroken), lambda s: s["up_title"]), lambda t: t.isNotNull())
        .alias("parent_titles"))


def _site(pages: DataFrame) -> list[str]:
    return [c for c in ("site",) if c in pages.columns]


def source_annotation(docs: DataFrame, notes: DataFrame, url: str = "url", id: str = "doc_id",
                      min_key: int = 4) -> DataFrame:
    """``(id, source)``: ``name: annotation`` of the last configured key that the URL contains.

    ``notes(key_order, key, name, annotation)`` is a hand-written configuration of a few rows. It is folded into one
    array that rides along as a scalar subquery, so URLs are matched in one narrow pass.
    """
    packed = notes.where(F.length("key") >= min_key).agg(F.array_sort(F.collect_list(
        F.struct("key_order", "key", F.concat("name", F.lit(": "), "annotation").alias("note")))).alias("notes"))
    rows = docs.withColumn("_notes", packed.scalar())
    hit = F.filter("_notes", lambda n: F.contains(F.col(url), n["key"]))
    return rows.select(id, F.try_element_at(hit, F.lit(-1))["note"].alias("source")).where("source IS NOT NULL")


DENIED_EXTENSIONS = ("css", "png", "jpg", "xml", "gif", "ico", "pdf")  # fixed values


def allowed_domains(start_urls: DataFrame, url: str = "url") -> DataFrame:
    return start_urls.select(url_host(F.col(url)).alias("host")).distinct()


def recrawl_select(found: DataFrame, starts: DataFrame, stored: DataFrame) -> DataFrame:
    """URLs of ``found(url, site_modified)`` to load again.

    Kept: hosts of the start URLs, URLs below a start URL, no denied extension, and not older than the stored copy
    ``stored(url, file_modified)``. The prefix test is an equi-join: a URL below a start URL shares its host.
    """
    denied = rf"\.(?:{'|'.join(DENIED_EXTENSIONS)})$"
    rows = found.withColumn("_host", url_host(F.col("url"))).where(
        ~F.lower(F.regexp_replace("url", r"[?#].*$", "")).rlike(denied))
    begin = starts.select(F.col("url").alias("start_url"), url_host(F.col("url")).alias("_host"))
    below = rows.join(begin, (rows["_host"] == begin["_host"]) & F.startswith(F.col("url"), F.col("start_url")),
                      "left_semi")
    return (below.join(stored.select("url", "file_modified"), "url", "left")
            .where(F.coalesce(F.col("site_modified") >= F.col("file_modified"), F.lit(True)))
            .select("url", "site_modified"))


def snapshot_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows that differ between two snapshots, with the side they are on; no rows means unchanged."""
    columns = old.columns
    counted = (old.select(*columns, F.lit(1).alias("_w")).unionByName(new.select(*columns, F.lit(-1).alias("_w")))
               .groupBy(*columns).agg(F.sum("_w").alias("_w")).where(F.col("_w") != 0))
    return counted.withColumn("side", F.when(F.col("_w") > 0, "removed").otherwise("added")).drop("_w")
