"""Table conversion on pages with tables that Spark derives from ``part``, one page per row.

Table 0 is general (header row, notes in cell and header, title row, single header cell, nested table, trailing
blanks), table 1 the nested one, table 2 double-indexed, table 3 holds only footnotes, table 4 is empty and table 5
has no header.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.operators import tables as T
from leafgraph.operators.parse import SiteConfig, parse_pages
from leafgraph.operators.sections import build_sections
from leafgraph.registered.base import Tables, query, squeeze
from leafgraph.registered.pages import PARTS, html_of
from leafgraph.session import materialize

CONFIG = SiteConfig(replacements=({"attrs": {"name": "table"}, "function": "convert_table"},))

_GENERAL = (
    "<table><tr><th>Brand</th><th>Kind<sup>1</sup></th><th>Size</th></tr>"
    "<tr><td>{brand}</td><td>{type}<sup>2,9,1</sup></td><td> </td></tr>"
    "<tr><td>{name}</td><td></td><td>{size}<sup>9</sup></td></tr>"
    "<tr><td><h3>More {name}</h3></td></tr>"
    "<tr><td>only {size}</td><td> </td></tr>"
    "<tr><th>List<sup>2</sup></th></tr>"
    "<tr><td>a</td><td>b</td><td>c</td></tr>"
    "<tr><td><table><tr><td>in</td><td>{size}</td></tr></table></td></tr>"
    "<tr><td></td><td></td></tr>"
    "<tr><td><sup>1</sup> as of {price}</td></tr><tr><td><p><sup>2</sup>by {brand}</p></td></tr></table>")
_DOUBLE = ("<table><tr><th></th><th>Spring</th><th>Fall<sup>1</sup></th></tr>"
           "<tr><td>{name}</td><td>{size}</td><td>{price}</td></tr><tr><td><sup>1</sup>late</td></tr></table>")
_NOTES = '<table><tr><td><sup>7</sup>seven {size}</td></tr><tr><td class="footnote"><sup>8</sup>eight</td></tr></table>'
_PLAIN = "<table><tr><td>k{size}</td><td>v<sup>1</sup></td></tr><tr><td>x</td><td>y</td><td>z<sup>3</sup></td></tr></table>"


def parsed(t: Tables) -> DataFrame:
    pages = html_of(t, "<h1>{name}</h1>start", _GENERAL, _DOUBLE, _NOTES, "<table></table>", _PLAIN, "end")
    return parse_pages(pages, CONFIG)


def _items(rows: list[tuple], columns: list[str]) -> str:
    """SQL rows ``page_id`` x the given literal expressions."""
    parts = [f"SELECT page_id, {', '.join(f'{e} AS {c}' for e, c in zip(row, columns))} FROM p" for row in rows]
    return f"WITH {PARTS} " + " UNION ALL ".join(parts)


@query("t1_classify_table", _items([("0", "'general'"), ("1", "'general'"), ("2", "'double'"), ("3", "'general'"),
                                    ("4", "'empty'"), ("5", "'general'")], ["table_no", "table_kind"]))
def t1(t: Tables) -> DataFrame:
    return T.classify_tables(parsed(t)).select("page_id", "table_no", "table_kind")


@query("t2_trim_cells", _items([
    ("0", "0", "3"), ("0", "1", "2"), ("0", "2", "3"), ("0", "3", "1"), ("0", "4", "1"), ("0", "5", "1"), ("0", "6", "3"),
    ("0", "7", "1"), ("1", "0", "2"), ("2", "0", "3"), ("2", "1", "3"), ("5", "0", "2"), ("5", "1", "3")],
    ["table_no", "row_no", "n_cells"]))
def t2(t: Tables) -> DataFrame:
    return T.trim_cells(parsed(t)).groupBy("page_id", "table_no", "row_no").agg(F.count("*").alias("n_cells"))


@query("t3_classify_rows", _items([
    ("0", "0", "'header'", "0"), ("0", "1", "'data'", "0"), ("0", "2", "'data'", "0"), ("0", "3", "'title'", "1"),
    ("0", "4", "'data'", "1"), ("0", "5", "'list'", "2"), ("0", "6", "'data'", "2"), ("0", "7", "'nested'", "2"),
    ("0", "8", "'empty'", "2"), ("1", "0", "'data'", "0"), ("2", "0", "'header'", "0"), ("2", "1", "'data'", "0"),
    ("5", "0", "'data'", "0"), ("5", "1", "'data'", "0")], ["table_no", "row_no", "row_kind", "list_no"]))
def t3(t: Tables) -> DataFrame:
    rows = T.classify_rows(parsed(t)).where(F.col("row_kind") != "note")
    return rows.select("page_id", "table_no", "row_no", "row_kind", "list_no")


@query("t4_attach_headers", _items([
    ("0", "1", "'Brand|Kind|Size'"), ("0", "2", "'Brand|Kind|Size'"), ("0", "4", "'Brand|Kind|Size'"),
    ("0", "6", "'Brand|Kind|Size'"), ("1", "0", "NULL"), ("2", "1", "'|Spring|Fall'"), ("5", "0", "NULL"),
    ("5", "1", "NULL")], ["table_no", "row_no", "headers"]))
def t4(t: Tables) -> DataFrame:
    rows = T.attach_headers(T.classify_rows(parsed(t))).where(F.col("row_kind") == "data")
    return rows.select("page_id", "table_no", "row_no", F.array_join(F.col("headers")["text"], "|").alias("headers"))


@query("t5_collect_footnotes", _items([
    ("0", "'1'", "'as of ' || price"), ("0", "'2'", "'by ' || brand"), ("2", "'1'", "'late'"),
    ("3", "'7'", "'seven ' || size"), ("3", "'8'", "'eight'")], ["table_no", "note_key", "note"]))
def t5(t: Tables) -> DataFrame:
    return T.collect_footnotes(parsed(t)).select("page_id", "table_no", "note_key", "note")


@query("t6_resolve_footnotes", _items([
    ("0", "0", "1", "'Kind'", "'as of ' || price || ' '"),
    ("0", "1", "1", "type", "'by ' || brand || ' as of ' || price || ' '"),
    ("0", "5", "0", "'List'", "'by ' || brand || ' '"), ("2", "0", "2", "'Fall'", "'late '")],
    ["table_no", "row_no", "col_no", "text", "note"]))
def t6(t: Tables) -> DataFrame:
    """Key 9 is unknown; the markers are gone from the cell texts."""
    return T.resolve_footnotes(parsed(t)).where(F.col("note").isNotNull()).select("page_id", "table_no", "row_no", "col_no", "text", "note")


CONVERTED = [
    ("0", "'data'", "'Brand: ' || brand || '; Kind: ' || type || ' (by ' || brand || ' as of ' || price || ' ) (as of ' "
                    "|| price || ' ); '"),
    ("0", "'data'", "'Brand: ' || name || '; Kind:  (as of ' || price || ' ); Size: ' || size || '; '"),
    ("0", "'title'", "'More ' || name"), ("0", "'data'", "'only ' || size"), ("0", "'list'", "'List'"),
    ("0", "'data'", "'Brand: a; Kind: b (as of ' || price || ' ); Size: c; '"),
    ("1", "'data'", "'in: ' || size"),
    ("2", "'data'", "name || E'\\n    - Spring: ' || size || E'\\n    - Fall: ' || price || ' (late )'"),
    ("3", "'data'", "'[7] seven ' || size"), ("3", "'data'", "'[8] eight'"),
    ("5", "'data'", "'k' || size || ': v'"), ("5", "'data'", "'x; y; z[3]; '")]


def converted(t: Tables) -> DataFrame:
    return T.convert_tables(parsed(t)).select("page_id", "table_no", "row_kind", "item")


def _of(*tables: str) -> str:
    return _items([r for r in CONVERTED if r[0] in tables], ["table_no", "row_kind", "item"])


@query("t7_render_general_row", _of("0", "1", "5"))
def t7(t: Tables) -> DataFrame:
    return converted(t).where(F.col("table_no").isin(0, 1, 5))


@query("t8_render_double_indexed_row", _of("2"))
def t8(t: Tables) -> DataFrame:
    return converted(t).where(F.col("table_no") == 2)


@query("t9_render_cell", """SELECT p_partkey AS page_id, p_type || ' (' || p_name || ')' AS cell, 'Size: ' || p_size ||
    CASE WHEN p_size > 25 THEN ' (big)' ELSE '' END || ' (note)' AS headed FROM part""")
def t9(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("page_id"), T.render_cell(F.col("p_type"), F.col("p_name")).alias("cell"),
        T.render_cell_and_header(F.col("p_size").cast("string"), F.when(F.col("p_size") > 25, "big"), F.lit("Size"),
                                 F.lit("note")).alias("headed"))


@query("t10_footnote_only_table", _of("3"))
def t10(t: Tables) -> DataFrame:
    return T.footnote_only_tables(T.classify_rows(parsed(t))).select(
        "page_id", "table_no", F.lit("data").alias("row_kind"), "item")


@query("h3_replace_elements", f"""WITH {PARTS}
    SELECT page_id, name AS path, 'start - Brand: ' || brand || '; Kind: ' || type || ' (by ' || brand || ' as of ' ||
      price || ' ) (as of ' || price || ' ); - Brand: ' || name || '; Kind: (as of ' || price || ' ); Size: ' || size || ';'
      AS body FROM p UNION ALL
    SELECT page_id, name || ' / More ' || name, '- only ' || size FROM p UNION ALL
    SELECT page_id, name || ' / List', '(by ' || brand || ' ) - Brand: a; Kind: b (as of ' || price || ' ); Size: c; - in: ' ||
      size || ' - ' || name || ' - Spring: ' || size || ' - Fall: ' || price || ' (late ) - [7] seven ' || size ||
      ' - [8] eight - k' || size || ': v - x; y; z[3]; end' FROM p""")
def h3(t: Tables) -> DataFrame:
    """Tables are replaced in place; their titles split the page although the section is short enough."""
    config = SiteConfig(replacements=CONFIG.replacements, mandatory_splits=4)
    rows = build_sections(T.replace_tables(materialize(parsed(t), "tables")), config)
    return rows.select("page_id", F.array_join("titles", " / ").alias("path"), squeeze(F.col("text")).alias("body"))
