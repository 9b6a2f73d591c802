"""Sinks and sources: what was written is read back and compared with what went in.

``documents`` is the extract table (``lang`` is the site), its lines the graph, ``embeddings`` the vector table.
"""

from __future__ import annotations

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph import schemas as S
from leafgraph.operators.extracts import relations
from leafgraph.operators.links import snapshot_changed
from leafgraph.operators.taxonomy import program_options, read_taxonomy, taxonomy_json
from leafgraph.plans.corpus import build_corpus
from leafgraph.plans.embedding_load import load_vectors
from leafgraph.registered.base import ORACLES, Tables, query
from leafgraph.registered.chunks import LINES, line_extracts, taxonomy_rows
from leafgraph.registered.sites import two_sites
from leafgraph.session import materialize, work_dir
from leafgraph.sources import store
from leafgraph.sources.collections import read_collection, write_collection


@query("s4_write_extracts", """SELECT doc_id, lang AS site, CASE WHEN n_chars < 500 THEN 'None' ELSE source END AS program,
    length(text) AS n, 1::INTEGER AS n_links FROM documents""")
def s4(t: Tables) -> DataFrame:
    base = work_dir(t.spark, "extracts")
    rows = t.documents.select(
        "doc_id", F.concat(F.lit("https://d.example/"), F.col("doc_id").cast("string")).alias("url"),
        F.lit(None).cast("long").alias("parent"), F.array("source").alias("titles"), F.array("lang").alias("parent_titles"),
        "text", F.array(F.struct(F.lit("t").alias("title"), F.lit("u").alias("url"), F.col("doc_id").alias("doc_id")))
        .alias("links"), F.lit(None).cast("string").alias("context"), F.lit(0).alias("split_idx"),
        F.col("lang").alias("faculty"), F.when(F.col("n_chars") >= 500, F.col("source")).alias("program"),
        F.lit(None).cast("array<string>").alias("specialization"), F.lit("f.html").alias("orig_doc"),
        F.lit("2024-01-01").cast("timestamp").alias("last_modified"), F.col("lang").alias("site"))
    store.write_extracts(rows, base)
    store.export_extracts(rows, f"{base}-csv")
    back = store.read_extracts(t.spark, base, fill="None")
    return back.select("doc_id", "site", "program", F.length("text").cast("long").alias("n"),
                       F.size("links").alias("n_links"))


@query("s4_corpus_round_trip", "SELECT page_id, 1::BIGINT AS n_rows, 0::BIGINT AS n_lost, 0::BIGINT AS n_new FROM pages")
def s4_corpus(t: Tables) -> DataFrame:
    """Every column of the extracts of a corpus is read back as it was, orig_doc and meta included."""
    pages, sites = two_sites(t)
    pages = pages.withColumns({"path": F.concat(F.lit("/dump/"), F.col("page_id").cast("string")),
                               "last_modified": F.lit("2024-01-01").cast("timestamp")})
    base = work_dir(t.spark, "extracts")
    rows = materialize(build_corpus(pages, sites).extracts, "corpus")
    store.write_extracts(rows, base)
    back = store.read_extracts(t.spark, base)
    line = lambda df: df.where("page_id IS NOT NULL").select(
        "page_id", F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}).alias("line"))
    changed = snapshot_changed(line(rows), line(back)).groupBy("page_id").pivot("side", ["removed", "added"]).count()
    return line(back).groupBy("page_id").agg(F.count("*").alias("n_rows")).join(changed, "page_id", "left").select(
        "page_id", "n_rows", F.coalesce("removed", F.lit(0)).alias("n_lost"), F.coalesce("added", F.lit(0)).alias("n_new"))


@query("s5_write_edges", f"WITH RECURSIVE {LINES} SELECT src, dst, type FROM edges WHERE type = 5")
def s5(t: Tables) -> DataFrame:
    """The folder per edge type prunes the read."""
    base = work_dir(t.spark, "graph")
    store.write_edges(relations(line_extracts(t)), base)
    return store.read_edges(t.spark, base).where(F.col("type") == S.SPLIT_SIBLING)


@query("s6_write_vectors", """SELECT vec_id AS doc_id, 96::INTEGER AS dim, round(list_sum(embedding::DOUBLE[]), 4) AS total
    FROM embeddings""")
def s6(t: Tables) -> DataFrame:
    base = work_dir(t.spark, "vectors")
    rows = t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("text_embedding"),
                               F.reverse("embedding").alias("title_embedding"))
    store.write_vectors(rows, base, dim=96)
    back = t.spark.read.parquet(base)
    return back.select("doc_id", F.size("text_embedding").alias("dim"), F.round(F.aggregate(
        F.col("title_embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("s7_upsert_collection", """SELECT doc_id, CASE WHEN lang = 'en' THEN 'first' ELSE 'second' END AS load FROM documents""")
def s7(t: Tables) -> DataFrame:
    """A first load of the English documents, then all: known ids keep their first row."""
    base = work_dir(t.spark, "collections")
    first = t.documents.where(F.col("lang") == "en").select("doc_id", F.lit("first").alias("load"))
    every = t.documents.select("doc_id", F.lit("second").alias("load"))
    store.upsert_collection(first, base, "c", clear=True)
    store.upsert_collection(every, base, "c")
    return read_collection(t.spark, f"{base}/c")


@query("s7_aborted_load", """SELECT doc_id, lang FROM documents WHERE lang <> 'de'""")
def s7_aborted(t: Tables) -> DataFrame:
    """A load that fails at a German document replaces nothing; then the other documents are added."""
    base = f"{work_dir(t.spark, 'collections')}/c"
    rows = t.documents.select("doc_id", "lang")
    write_collection(rows.where("lang = 'en'"), base)
    broken = F.when(F.col("lang") == "de", F.raise_error(F.lit("not to be loaded"))).otherwise(F.col("lang")).cast("string")
    try:
        write_collection(rows.withColumn("lang", broken), base, replace=True)
    except PySparkException:
        write_collection(rows.where("lang NOT IN ('en', 'de')"), base)
    return read_collection(t.spark, base)


@query("s8_reuse_vectors", """WITH c AS (SELECT DISTINCT text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))
    SELECT 'known' AS state, md5(text) AS key, count(*) AS n FROM documents WHERE text IN (SELECT text FROM c) GROUP BY text
    UNION ALL SELECT 'missing', md5(text), 1 FROM documents WHERE text NOT IN (SELECT text FROM c) GROUP BY text""")
def s8(t: Tables) -> DataFrame:
    """The cache holds the texts of labelled documents."""
    cached = t.documents.join(t.labels, "doc_id", "left_semi").select(F.md5("text").alias("key")).distinct()
    known, missing = store.reuse_vectors(t.documents.select("doc_id", "text"),
                                         cached.withColumn("embedding", F.array(F.lit(0.0))))
    return known.groupBy(F.lit("known").alias("state"), "key").agg(F.count("*").alias("n")).unionByName(
        missing.select(F.lit("missing").alias("state"), "key", F.lit(1).cast("long").alias("n")))


@query("s8_load_twice", """WITH a AS (SELECT DISTINCT text AS x FROM documents WHERE lang = 'en' UNION
      SELECT DISTINCT source FROM documents WHERE lang = 'en'),
    b AS (SELECT DISTINCT CASE WHEN doc_id % 4 = 0 THEN text || '!' ELSE text END AS x FROM documents UNION
      SELECT DISTINCT source FROM documents)
    SELECT 1 AS load, (SELECT count(*) FROM a)::BIGINT AS embedded, count(*)::BIGINT AS n_rows FROM documents WHERE lang = 'en'
    UNION ALL SELECT 2, (SELECT count(*) FROM b WHERE x NOT IN (SELECT x FROM a))::BIGINT, (SELECT count(*) FROM documents)""")
def s8_twice(t: Tables) -> DataFrame:
    """English documents are loaded, then all of them with every fourth text changed: only new texts and titles are embedded."""
    base = work_dir(t.spark, "vectors")
    rows = t.documents.select("doc_id", "lang", F.lit("u").alias("url"), F.array("source").alias("titles"),
                              F.array().cast("array<string>").alias("parent_titles"), "text",
                              F.array().cast("array<struct<url:string>>").alias("links"))
    changed = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    audits = [load_vectors(rows.where("lang = 'en'"), base, 1, dim=16).withColumn("load", F.lit(1))]
    audits[0] = materialize(audits[0], "audit")  # the second load replaces the table
    audits.append(load_vectors(rows.withColumn("text", changed), base, 2, dim=16).withColumn("load", F.lit(2)))
    embedded = t.spark.read.schema(S.VECTOR_CACHE).parquet(f"{base}/cache").groupBy("load").agg(F.count("*").alias("embedded"))
    return audits[0].union(audits[1]).join(embedded, "load").select("load", "embedded", "n_rows")


@query("s10_write_taxonomy", ORACLES["a1_program_options"])
def s10(t: Tables) -> DataFrame:
    """The nested JSON holds exactly the flat rows."""
    base = work_dir(t.spark, "taxonomy")
    taxonomy_json(program_options(taxonomy_rows(t))).write.parquet(base)
    return read_taxonomy(t.spark.read.parquet(base))
