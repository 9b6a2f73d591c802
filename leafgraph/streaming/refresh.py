"""Incremental refresh: new or newer pages change the stored corpus, and what depends on them, as a rebuild would.

The state below one folder is four tables, written by batch; a page's rows in its newest batch are in force.

* ``pages``     what a page is by itself: URL, title, number, date
* ``sections``  its sections, the outcome of the parse
* ``extracts``  its extracts, which also depend on the titles and numbers of the pages at its folders
* ``links``     its links with their targets, which also depend on the extracts that stand at those URLs, and on redirects

A batch parses only new and newer pages. What changed then spreads along the stored relations: pages below a page that is
new, or has a new title, get their extracts again from the stored sections; pages that link to a URL at which another extract
stands now, or that another redirect leads from, get their links again. All other rows stay where they are. Each batch
replaces its own folders and reads earlier ones only, so one that runs again after a failure leaves no trace of the first run.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.functions.urls import clean_url
from leafgraph.operators.extracts import relations
from leafgraph.operators.links import first_doc_per_url, link_edges, link_targets, links_per_doc, page_folders
from leafgraph.operators.rules import Rules
from leafgraph.plans.corpus import Configs, Corpus, base_rows, place_sections, read_sections, redirected
from leafgraph.session import materialize
from leafgraph.sources.pages import number_pages
from leafgraph.sources.store import append_update

PAGES = "page_id long, url string, html string, last_modified timestamp"
TABLES = ("pages", "sections", "extracts", "links")


def changed_pages(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Pages that are new, or newer than their stored copy ``(page_id, last_modified)``."""
    have = stored.groupBy("page_id").agg(F.max("last_modified").alias("_have"))
    return (found.join(have, "page_id", "left")
            .where(F.coalesce(F.col("last_modified") > F.col("_have"), F.lit(True))).drop("_have"))


def newest_pages(pages: DataFrame) -> DataFrame:
    """One whole row per page, the newest; the html of older copies is dropped in the map-side combine.

    Of copies with one date the one with the greatest html counts.
    """
    rest = [c for c in pages.columns if c != "page_id"]
    newest = pages.groupBy("page_id").agg(F.max_by(F.struct(*rest), F.struct("last_modified", "url", "html")).alias("p"))
    return newest.select("page_id", "p.*")


class _State:
    """The stored tables up to a batch."""

    def __init__(self, spark: SparkSession, path: str, batch_id: int):
        self.spark, self.path, self.batch_id = spark, path.rstrip("/"), batch_id

    def write(self, rows: DataFrame, name: str) -> None:
        rows.withColumn("batch_id", F.lit(self.batch_id).cast("long")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{self.path}/{name}")

    def versions(self, name: str, before: bool = False) -> DataFrame | None:
        """All rows of a table that batches up to this one (or before it) wrote; None if none did."""
        try:
            rows = self.spark.read.parquet(f"{self.path}/{name}")
        except AnalysisException as error:
            if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise
        return rows.where(F.col("batch_id") < self.batch_id + (0 if before else 1))

    def current(self, name: str, before: bool = False) -> DataFrame | None:
        """The rows in force: of every page those of its newest batch, as the table ``written`` of the same name says.

        A batch that wrote a page without rows (no links, say) is known from ``written`` alone.
        """
        rows, written = self.versions(name, before), self.versions(f"{name}-written", before)
        if rows is None or written is None:
            return None
        newest = written.groupBy("page_id").agg(F.max("batch_id").alias("batch_id"))
        return rows.join(newest, ["page_id", "batch_id"], "left_semi").drop("batch_id")

    def put(self, rows: DataFrame, pages: DataFrame, name: str) -> None:
        """Store the ``rows`` that ``pages(page_id)`` have from now on."""
        self.write(rows, name)
        self.write(pages.select("page_id"), f"{name}-written")


def _differ(old: DataFrame | None, new: DataFrame, key: str, value: str) -> DataFrame:
    """The keys whose value is not the same on both sides."""
    if old is None:
        return new.select(key).distinct()
    both = old.select(key, F.col(value).alias("_old")).join(new.select(key, F.col(value).alias("_new")), key, "full")
    return both.where(~F.col("_old").eqNullSafe(F.col("_new"))).select(key).distinct()


def apply_batch(spark: SparkSession, pages: DataFrame, path: str, batch_id: int, configs: Configs,
                redirects: DataFrame | None = None) -> None:
    """Bring the stored corpus up to date with ``pages`` (rows of ``PAGES``, with ``site`` for many sites)."""
    state, rules = _State(spark, path, batch_id), Rules(configs)
    keep = ["page_id", "url", "html", "last_modified", *[c for c in ("site", "path") if c in pages.columns]]
    had = state.current("pages", before=True)
    fresh = newest_pages(pages.select(*keep))
    fresh = materialize(fresh if had is None else changed_pages(fresh, had), "fresh-pages")
    sections, titled = read_sections(fresh, configs)
    state.put(number_pages(titled, had), fresh, "pages")
    if not rules.single:
        sections = sections.drop("rules").join(fresh.select("page_id", "site"), "page_id")
    state.put(sections, fresh, "sections")

    # extracts: of the new pages, and of those below a page that is new or has another title
    now = materialize(state.current("pages"), "pages-now")
    named = lambda rows: rows.select("page_id", F.struct("page_title").alias("title"))
    other = _differ(None if had is None else named(had.join(fresh, "page_id", "left_semi")),
                    named(now.join(fresh, "page_id", "left_semi")), "page_id", "title")
    tops = now.join(other, "page_id", "left_semi").select(*_site(now), clean_url(F.col("url")).alias("clean_url")).distinct()
    below = page_folders(rules.attach(now), rules.value("base_url")).join(tops, tops.columns, "left_semi")
    moved = materialize(below.select("page_id").union(fresh.select("page_id")).distinct(), "moved")
    stored = rules.attach(state.current("sections").join(moved, "page_id", "left_semi"))
    extracts = place_sections(stored, now.join(moved, "page_id", "left_semi"), configs, among=now)
    state.put(extracts, moved, "extracts")

    # links: of the new pages, and of those that lead to a URL where another extract stands, or from a moved URL
    whole = state.current("extracts")
    at = lambda rows: first_doc_per_url(rows.join(fresh, "page_id", "left_semi"))
    before = state.current("extracts", before=True)
    keys = _differ(None if before is None else at(before), at(whole), "clean_url", "doc_id")
    linking = fresh.select("page_id")
    links = state.current("links", before=True)
    if links is not None:
        linking = linking.union(links.join(keys.withColumnRenamed("clean_url", "target_key"), "target_key", "left_semi").select("page_id"))
    if redirects is not None:
        redirects = materialize(redirects.select("original", "final"), "redirects")
        old = state.versions("redirects", before=True)
        if old is not None:
            newest = old.agg(F.max("batch_id").alias("b")).scalar()
            old = old.where(F.col("batch_id") == newest)
        leads = _differ(old, redirects, "original", "final").withColumnRenamed("original", "page_url")
        if links is not None:
            linking = linking.union(links.join(leads, "page_url", "left_semi").select("page_id"))
        state.write(redirects, "redirects")
    linking = materialize(linking.distinct(), "linking")
    asked = redirected(whole.join(linking, "page_id", "left_semi"), configs, redirects)
    docs = whole.select("url", "doc_id").unionByName(base_rows(spark, configs).select("url", "doc_id"))
    state.put(link_targets(asked, docs), linking, "links")


def _site(rows: DataFrame) -> list[str]:
    return [c for c in ("site",) if c in rows.columns]


def refresh_pages(spark: SparkSession, source: str, path: str, checkpoint: str, configs: Configs,
                  update_log: str | None = None, redirects: DataFrame | None = None, schema: str = PAGES) -> None:
    """Run until all files in ``source`` (parquet rows of ``schema``) are in the corpus below ``path``, then stop."""
    stream = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        apply_batch(spark, batch, path, batch_id, configs, redirects)
        if update_log:
            append_update(spark, update_log, batch_id)

    query = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()


def current_extracts(spark: SparkSession, path: str) -> DataFrame:
    """The extracts in force, links as written in the pages."""
    return _State(spark, path, 1 << 60).current("extracts")


def current_corpus(spark: SparkSession, path: str, configs: Configs) -> Corpus:
    """What :func:`leafgraph.plans.corpus.build_corpus` would give for the newest version of every page.

    Only page numbers may differ, and with them ids: a page keeps the number it got when it first came.
    """
    state = _State(spark, path, 1 << 60)
    body, resolved = state.current("extracts"), state.current("links")
    extracts = body.drop("links").join(links_per_doc(resolved), "doc_id", "left").unionByName(
        base_rows(spark, configs), allowMissingColumns=True)
    return Corpus(extracts, relations(body).unionByName(link_edges(resolved)))
