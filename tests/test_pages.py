"""Parser, sections, tables and the corpus build on hand-written pages."""

import pytest
from pyspark.sql import functions as F

from leafgraph.functions.registry import resolve
from leafgraph.operators.extracts import ID_SPACE
from leafgraph.operators.links import last_edge_wins
from leafgraph.operators.parse import SiteConfig, matches, page_rows, parse_errors, parse_pages
from leafgraph.operators.sections import build_sections
from leafgraph.operators.tables import convert_tables
from leafgraph.plans.corpus import build_corpus


def kinds(html, **config):
    return [(r["kind"], r.get("text") or r.get("body")) for r in page_rows(1, html, SiteConfig(**config), {})]


def sections(spark, html, config=SiteConfig()):
    pages = spark.createDataFrame([(1, html)], "page_id long, html string")
    rows = build_sections(parse_pages(pages, config), config).orderBy("sec_no").collect()
    return [("/".join(r["titles"]), " ".join(r["text"].split()), r["anchor"]) for r in rows]


def test_unclosed_tags_and_stray_ends():
    rows = kinds("<p>one<p>two</b></i><ul><li>a<li>b</ul>")
    assert rows[-1] == ("text", "one\n\ntwo\n\n  - a\n  - b")


def test_cells_end_at_the_next_cell():
    rows = page_rows(1, "<table><tr><td>1<td>2<tr><td>3</table>",
                     SiteConfig(replacements=({"attrs": {"name": "table"}, "function": "convert_table"},)), {})
    assert [(r["row_no"], r["text"]) for r in rows if r["kind"] == "cell"] == [(0, "1"), (0, "2"), (1, "3")]


def test_script_and_style_are_silent():
    assert kinds("<script>var t='</p>';</script><style>p{}</style>x") == [("page", ""), ("text", "x")]


def test_ordered_list_and_superscript():
    assert kinds("<ol><li>a<li>b</ol>c<sup>2</sup>")[-1] == ("text", "  1. a\n  2. b\n\nc\n\n[2]")


def test_byte_order_mark_is_dropped():
    assert kinds("﻿x")[-1] == ("text", "x")


def test_whole_page_when_main_content_is_missing():
    assert kinds("<p>x</p>", main_content_attrs={"id": "none"})[-1] == ("text", "x")


def test_attribute_groups():
    class Node:
        tag, attrs = "div", {"class": "a b", "id": "i"}
    assert matches(Node, {"name": "div", "class": "b"})
    assert matches(Node, {"class": "a b", "id": "i"})
    assert not matches(Node, {"class": "c"})
    assert not matches(Node, {"name": "p", "id": "i"})


def test_missing_html_gives_a_page_without_rows(spark):
    pages = spark.createDataFrame([(1, None), (2, "<h1>a</h1>b")], "page_id long, html string")
    parsed = parse_pages(pages, SiteConfig())
    assert parse_errors(parsed).count() == 0
    assert [r["page_id"] for r in build_sections(parsed, SiteConfig()).collect()] == [2]


def test_page_without_headings_is_one_untitled_section(spark):
    assert sections(spark, "<p>only text</p>") == [("", "only text", None)]


def test_levels_before_their_parents(spark):
    got = sections(spark, "<h3>c</h3>three<h2>b</h2>two<h1>a</h1>one<h4>d</h4>four<h3>e</h3>five<h2>f</h2>six")
    assert [(p, t) for p, t, _ in got] == [
        ("", ""), ("/Intro", ""), ("/Intro/c", "three"), ("/b", "two"), ("a", ""), ("a/Intro", ""),
        ("a/Intro/Intro", "one"), ("a/Intro/Intro/d", "four"), ("a/Intro/e", "five"), ("a/f", "six")]


def test_anchor_waits_for_the_next_heading_of_every_level(spark):
    got = sections(spark, "<h1>a</h1>x<a id=one></a><h2>b</h2>y<h1>c</h1>z<h1>d</h1>w")
    # the anchor before b also is the last one before c at the first level; d inherits it
    assert [(p, a) for p, _, a in got] == [("a", None), ("a/b", "one"), ("c", "one"), ("d", "one")]


def test_later_link_with_the_same_text_wins(spark):
    pages = spark.createDataFrame([(1, "<h1>t</h1><a href=/1>x</a><a href=/2>x</a>")], "page_id long, html string")
    row = build_sections(parse_pages(pages, SiteConfig()), SiteConfig()).first()
    assert [(l["title"], l["href"]) for l in row["links"]] == [("x", "/2")]


def test_unknown_function_name_raises():
    with pytest.raises(ValueError, match="Invalid function name"):
        resolve("context", "nobody")


def test_data_row_longer_than_its_header(spark):
    config = SiteConfig(replacements=({"attrs": {"name": "table"}, "function": "convert_table"},))
    pages = spark.createDataFrame([(1, "<table><tr><th>A<tr><th>H<th>I<tr><td>1<td>2<td>3</table>")],
                                  "page_id long, html string")
    items = [r["item"] for r in convert_tables(parse_pages(pages, config)).orderBy("pos").collect()]
    assert items == ["A", "H: 1; I: 2; 3; "]


@pytest.fixture(scope="module")
def corpus(spark):
    home = '<h1>Home</h1>welcome <a href="a.html">A</a> <a href="mailto:x@y">mail</a> <a href="/gone">gone</a>'
    a = '<h1>A</h1>see below<h2>Part</h2>text <a href="../index.html#top">home</a><a href="http://other.example/">o</a>'
    b = "<h1>B</h1>" + "word " * 30 + "end. Next one here."
    pages = spark.createDataFrame([
        (1, "https://s.example/index.html", home), (2, "https://s.example/index/a.html", a),
        (3, "https://s.example/index/a/b.html", b)], "page_id long, url string, html string")
    config = SiteConfig(name="s", base_url="https://s.example", max_extract_len=60, metadata={"faculty": "X"},
                        metadata_extractor="default_extract_metadata",
                        parent_context_extractor="parent_context_extractor")
    redirects = spark.createDataFrame([("https://s.example/gone", "https://s.example/index/a")],
                                      "original string, final string")
    return build_corpus(pages, config, redirects)


def test_corpus_extracts(corpus):
    rows = {r["doc_id"]: r for r in corpus.extracts.collect()}
    base, home, a, part, b = -1, ID_SPACE, 2 * ID_SPACE, 2 * ID_SPACE + 1, 3 * ID_SPACE
    assert rows[base]["url"] == "https://s.example"
    assert rows[home]["parent"] == base
    assert rows[a]["parent"] == home and rows[a]["parent_titles"] == ["Home", "A"]
    assert rows[part]["parent"] == a and rows[part]["context"].strip() == "see below"
    assert rows[b]["parent"] == a and rows[b]["parent_titles"] == ["Home", "A", "B"]
    assert {r["faculty"] for r in rows.values() if r["doc_id"] != base} == {"X"}
    links = {l["title"]: (l["url"], l["doc_id"]) for l in rows[home]["links"]}
    assert links == {"A": ("https://s.example/a", None), "gone": ("https://s.example/index/a", a)}
    links = {l["title"]: (l["url"], l["doc_id"]) for l in rows[part]["links"]}
    assert links == {"home": ("https://s.example/index", home), "o": ("http://other.example/", None)}


def test_corpus_chunks_keep_all_words(corpus):
    rows = corpus.extracts.where(F.col("doc_id") >= 3 * ID_SPACE).orderBy("doc_id").collect()
    assert all(len(r["text"]) <= 60 for r in rows)
    assert " ".join(r["text"] for r in rows).split() == ("word " * 30 + "end. Next one here.").split()
    assert [r["split_idx"] for r in rows] == list(range(len(rows)))


def test_corpus_edges(corpus):
    edges = {(r["src"], r["dst"], r["type"]) for r in corpus.edges.collect()}
    home, a, part, b = ID_SPACE, 2 * ID_SPACE, 2 * ID_SPACE + 1, 3 * ID_SPACE
    assert {(-1, home, 1), (home, a, 1), (a, part, 2), (a, b, 1), (b, b + 1, 5), (part, home, 3), (home, a, 3)} <= edges
    assert all(s < d for s, d, t in edges if t != 3)  # structural edges run forward: no cycles


def test_last_edge_wins_keeps_one_edge(corpus):
    one = last_edge_wins(corpus.edges)
    assert one.where(f"src = {ID_SPACE} AND dst = {2 * ID_SPACE}").first()["type"] == 3
    assert one.count() == corpus.edges.select("src", "dst").distinct().count()


def _parts(spark, folder, n):
    rows = spark.range(n).select(
        (F.col("id") + 1).alias("p_partkey"), F.concat(F.lit("part "), F.col("id").cast("string")).alias("p_name"),
        F.lit("Brand#1").alias("p_brand"), F.lit("STEEL").alias("p_type"), (F.col("id") % 50).cast("int").alias("p_size"),
        F.lit(900.0).alias("p_retailprice"))
    rows.coalesce(1).write.parquet(f"{folder}/part.parquet")


def test_pages_of_one_split_are_parsed_in_many_tasks(spark, tmp_path):
    from leafgraph.registered.base import Tables
    from leafgraph.registered.pages import PAGES_PER_TASK, part_pages

    n = 2 * PAGES_PER_TASK + 1
    _parts(spark, tmp_path, n)
    sizes = part_pages(Tables(spark, str(tmp_path))).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == n
    assert len(sizes) == 3 and max(r["count"] for r in sizes) <= PAGES_PER_TASK


def test_sections_and_tables_keep_all_partitions_of_a_shuffle(spark, tmp_path):
    """Adaptive execution would merge partitions this small into one task."""
    from leafgraph.operators.tables import trim_cells
    from leafgraph.registered.base import Tables
    from leafgraph.registered.pages import part_sections
    from leafgraph.registered.tables import parsed

    _parts(spark, tmp_path, 100)
    t = Tables(spark, str(tmp_path))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for rows in (part_sections(t), trim_cells(parsed(t))):
        assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == n


def test_partitions_by_page_grow_with_the_pages(spark):
    from leafgraph.operators.sections import build_sections
    from leafgraph.operators.tables import classify_rows, replace_tables
    from leafgraph.registered.pages import html_of
    from leafgraph.session import deal_out, follow, materialize

    many = int(spark.conf.get("spark.sql.shuffle.partitions")) + 3
    config = SiteConfig(replacements=({"attrs": {"name": "table"}, "function": "convert_table"},))
    dealt = deal_out(spark.range(2 * many), 2)
    html = F.lit("<h1>t</h1><table><tr><td>a<td>b</table>")
    parsed = parse_pages(follow(dealt.select(F.col("id").alias("page_id"), html.alias("html")), dealt), config)
    assert classify_rows(parsed).rdd.getNumPartitions() == many
    replaced = replace_tables(materialize(parsed, "tables"))
    assert build_sections(replaced, config).rdd.getNumPartitions() == many
    assert build_sections(parsed, config).count() == 2 * many

    class Parts:
        part = spark.range(20_000).select(
            F.col("id").alias("p_partkey"), *[F.lit(x).alias(f"p_{x}") for x in ("name", "brand", "type")],
            F.lit(1).alias("p_size"), F.lit(1.5).alias("p_retailprice"))

    assert parse_pages(html_of(Parts, "{name}"), config)._tasks == 4


@pytest.mark.parametrize("cell", ["a", "a<sup>1</sup>b", "<sup>x</sup>", "<p>a</p><table><tr><td>i<sup>2</sup></table><sup>3</sup>", ""])
def test_cells_read_alike_with_and_without_elements(spark, cell):
    from leafgraph.operators.parse import page_rows

    config = SiteConfig(replacements=({"attrs": {"name": "table"}, "function": "convert_table"},))
    rows = [r for r in page_rows(1, f"<table><tr><th>h<td>{cell}</td></tr></table>", config, {}) if r["kind"] == "cell"]
    expected = {"a": ("a", "a", None, False), "a<sup>1</sup>b": ("ab", "a[1]b", "1", False), "<sup>x</sup>": ("", "x", "x", False),
                "": ("", "", None, False)}.get(cell, ("a[3]", "a[3]", "2", True))
    assert [(r["text"], r["body"], r["note_keys"], r["nested"]) for r in rows if r["col_no"] == 1][:1] == [expected]


def test_batches_walk_only_the_fields_of_a_row():
    """A row has some of the twenty fields; the others are not asked for one by one."""
    from leafgraph.operators.parse import _FIELDS, _batch

    class Row(dict):
        def get(self, *args):
            raise AssertionError("a field was asked for")
    rows = [Row(page_id=1, pos=1, kind="page", body=""), Row(page_id=1, pos=2, kind="cell", table_no=0, nested=False)]
    got = _batch(rows, _FIELDS).to_pylist()
    assert [{k: v for k, v in r.items() if v is not None} for r in got] == [dict(r) for r in rows]
    assert list(got[0]) == [name for name, _ in _FIELDS]
    assert _batch([], _FIELDS).num_rows == 0
