"""Table conversion as joins and windows over the parser's table rows.

A table lies inside one page, so every window and aggregation below has ``page_id`` among its keys and shares the
partitioning of the section operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.functions.text import strip
from leafgraph.operators.parse import SPLIT_CLASS
from leafgraph.session import by_page, follow

_TABLE = ["page_id", "table_no"]
_ROW = [*_TABLE, "row_no"]


def _blank(c: Column) -> Column:
    return strip(F.coalesce(c, F.lit(""))) == ""


def _table_kind() -> Column:
    return F.when(F.col("tag") == "empty", "empty").when(
        F.col("text").isNotNull() & _blank(F.col("text")), "double").otherwise("general")


def classify_tables(parsed: DataFrame) -> DataFrame:
    """``table_kind``: ``empty`` (nothing inside, dropped), ``double`` (first header cell blank) or ``general``."""
    return parsed.where(F.col("kind") == "table").select(*_TABLE, F.col("pos").alias("table_pos"),
                                                         _table_kind().alias("table_kind"))


def collect_footnotes(parsed: DataFrame) -> DataFrame:
    """``(page_id, table_no, note_key, note, pos)``; of two notes with one key the later wins."""
    return parsed.where(F.col("kind") == "note").groupBy(*_TABLE, F.col("note_keys").alias("note_key")).agg(
        F.max_by("text", "pos").alias("note"), F.max("pos").alias("pos"))


def _kept(parsed: DataFrame) -> DataFrame:
    """Table rows without the rows that hold a footnote and without the trailing blank cells of a row."""
    row = Window.partitionBy(*_ROW)
    kind = F.col("kind")
    full = (kind == "cell") & (~_blank(F.col("body")) | F.col("nested"))
    # one exchange by page serves every window and aggregation of the conversion
    rows = by_page(parsed.where(kind.isin("table", "row", "cell", "note")), parsed)
    marked = rows.withColumns({
        "_has_note": F.max(kind == "note").over(row), "_last": F.max(F.when(full, F.col("col_no"))).over(row)})
    stays = kind.isin("table", "note") | (~F.col("_has_note") & (
        (kind == "row") | ((kind == "cell") & (F.col("col_no") <= F.col("_last")))))
    return marked.where(stays).drop("_has_note", "_last")


def trim_cells(parsed: DataFrame) -> DataFrame:
    return _kept(parsed).where(F.col("kind") == "cell")


def _with_notes(parsed: DataFrame) -> DataFrame:
    """The kept rows; cells with ``note``, notes with ``wins`` (no later note has their key).

    Cells are expanded by key and meet the notes in a window over (table, key), then fold back into one row each: the
    data stays partitioned by page throughout.
    """
    cell, note = F.col("kind") == "cell", F.col("kind") == "note"
    keys = F.when(cell, F.split("note_keys", ",")).when(note, F.array("note_keys"))
    given = F.max(F.when(note, F.struct("pos", "text"))).over(Window.partitionBy(*_TABLE, "_key"))
    keyed = _kept(parsed).select("*", F.posexplode_outer(keys).alias("_i", "_key")).withColumn("_given", given)
    found = F.when(cell & F.col("_given").isNotNull(), F.struct("_i", F.col("_given.text").alias("t")))
    other = ("tag", "text", "body", "nested", "title_row", "note_keys", "level", *_site(parsed))
    notes = F.array_join(F.transform(F.array_sort(F.collect_list(found)),
                                     lambda x: F.concat(strip(x["t"]), F.lit(" "))), "")
    folded = keyed.groupBy(*_ROW, "kind", "pos", "col_no").agg(
        *[F.first(c).alias(c) for c in other], notes.alias("note"), F.max(F.col("_given.pos")).alias("_pos"))
    return folded.withColumns({"note": F.when(F.col("note") != "", F.col("note")),
                               "wins": note & (F.col("_pos") == F.col("pos"))}).drop("_pos")


def resolve_footnotes(parsed: DataFrame) -> DataFrame:
    """Trimmed cells with ``note``: the texts of their comma-separated keys in key order, each followed by a blank.

    Unknown keys are ignored; a cell without a known key has no note.
    """
    return _with_notes(parsed).where(F.col("kind") == "cell").drop("wins")


def render_cell(text: Column, note: Column) -> Column:
    """``text (note)``."""
    return F.when(note.isNotNull(), F.concat(text, F.lit(" ("), note, F.lit(")"))).otherwise(text)


def render_cell_and_header(text: Column, note: Column, header: Column, header_note: Column) -> Column:
    """``header: text (cell note) (header note)``; a cell beyond the header row stands alone."""
    shown = F.when(header.isNotNull(), F.concat(header, F.lit(": "), text)).otherwise(text)
    return render_cell(render_cell(shown, note), header_note)


def classify_rows(parsed: DataFrame) -> DataFrame:
    """One row per table row with its cells as an array.

    ``row_kind`` is title, list (single header cell), nested, header, data or empty for rows of the table, and note for
    what only carries footnotes (``notes``). ``table_kind``, ``table_cells`` and ``title_level`` (the split level of table
    titles at the site, null if they don't split) describe the whole table.
    """
    kind = F.col("kind")
    rows = _with_notes(parsed).groupBy(*_ROW).agg(
        F.max(F.when(kind == "row", F.col("pos"))).alias("pos"),
        F.max(F.when(kind == "row", F.col("title_row"))).alias("title_row"),
        F.max(F.when(kind == "row", F.col("text"))).alias("row_title"),
        F.array_sort(F.collect_list(F.when(kind == "cell", F.struct(
            "col_no", "tag", "text", "body", "note", "nested")))).alias("cells"),
        F.array_sort(F.collect_list(F.when(F.col("wins"), F.struct("pos", "note_keys", "text")))).alias("notes"),
        F.max(F.when(kind == "table", _table_kind())).alias("_kind"),
        F.max(F.when(kind == "table", F.col("level"))).alias("_level"), *[F.first(c).alias(c) for c in _site(parsed)])
    table = Window.partitionBy(*_TABLE)
    first, n = F.try_element_at(F.col("cells"), F.lit(1)), F.size("cells")
    row_kind = (F.when(F.col("pos").isNull(), "note")
                .when(F.col("title_row"), "title")
                .when(n == 0, "empty")
                .when((n == 1) & (first["tag"] == "th"), "list")
                .when(first["nested"], "nested")
                .when(first["tag"] == "th", "header")
                .otherwise("data"))
    starts = F.col("row_kind").isin("title", "list").cast("int")
    return rows.withColumn("row_kind", row_kind).withColumns({
        "table_kind": F.max("_kind").over(table), "table_cells": F.sum(F.size("cells")).over(table),
        "title_level": F.max("_level").over(table),
        "list_no": F.sum(starts).over(table.orderBy("row_no"))}).drop("_kind", "_level", "title_row")


def attach_headers(rows: DataFrame) -> DataFrame:
    """Add ``headers``: the cells of the most recent header row of the table."""
    order = Window.partitionBy(*_TABLE).orderBy("row_no")
    return rows.withColumn("headers", F.last(F.when(F.col("row_kind") == "header", F.col("cells")),
                                             ignorenulls=True).over(order))


def _item(cell: Column, i: Column) -> Column:
    header = F.try_element_at(F.col("headers"), i + 1)
    return render_cell_and_header(cell["text"], cell["note"], strip(header["text"]), header["note"])


def _labelled(label: Column, cells: Column) -> Column:
    """A row label with its ``header: cell`` items below."""
    items = F.transform(F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))),
                        lambda c, i: F.concat(F.lit("\n    - "), _item(c, i + 1)))
    return F.concat(label, F.array_join(items, ""))


def render_general_row(cells: Column, headers: Column) -> Column:
    first = F.element_at(cells, 1)
    n = F.size(cells)
    cell = lambda i: render_cell(F.element_at(cells, i)["text"], F.element_at(cells, i)["note"])
    return (F.when(headers.isNull() & (n == 2), F.concat(cell(1), F.lit(": "), F.concat(
                F.try_element_at(cells, F.lit(2))["text"],
                F.coalesce(F.concat(F.lit(" ("), F.try_element_at(cells, F.lit(2))["note"], F.lit(")")), F.lit("")))))
            .when(n == 1, cell(1))
            .when(headers.isNull(), F.array_join(F.transform(
                cells, lambda c: F.concat(c["body"], F.lit("; "))), ""))
            .when(_blank(F.element_at(headers, 1)["text"]), _labelled(first["body"], cells))
            .otherwise(F.array_join(F.transform(cells, lambda c, i: F.concat(_item(c, i), F.lit("; "))), "")))


def render_double_indexed_row(cells: Column) -> Column:
    return _labelled(F.element_at(cells, 1)["body"], cells)


def footnote_only_tables(rows: DataFrame) -> DataFrame:
    """Items ``[key] note`` of tables in which nothing but footnotes is left, from classified rows."""
    only = rows.where((F.col("table_cells") == 0) & (F.size("notes") > 0))
    return only.select(*_TABLE, F.explode("notes").alias("n")).select(
        *_TABLE, F.col("n.pos").alias("pos"), _note_item(F.col("n")).alias("item"))


def _note_item(note: Column) -> Column:
    return F.concat(F.lit("["), note["note_keys"], F.lit("] "), note["text"])


def _site(parsed: DataFrame) -> list[str]:
    return [c for c in ("site",) if c in parsed.columns]


def convert_tables(parsed: DataFrame) -> DataFrame:
    """``(page_id, table_no, pos, row_kind, item, note, title_level)``: the list items and titles that stand for the tables.

    One pass over the table rows of the parse, with a single exchange by page.
    """
    rows = attach_headers(classify_rows(parsed))
    first = F.try_element_at(F.col("cells"), F.lit(1))
    kind = F.col("row_kind")
    text = (F.when(kind == "title", F.col("row_title"))
            .when(kind == "list", strip(first["text"]))
            .when((kind == "data") & (F.col("table_kind") == "double"), render_double_indexed_row(F.col("cells")))
            .when(kind == "data", render_general_row(F.col("cells"), F.col("headers"))))
    item = lambda pos, kind, text, note: F.struct(
        pos.cast("int").alias("pos"), kind.alias("row_kind"), text.alias("item"), note.cast("string").alias("note"))
    own = F.array(item(F.col("pos"), kind, text, F.when(kind == "list", first["note"])))
    notes = F.transform("notes", lambda n: item(n["pos"], F.lit("data"), _note_item(n), F.lit(None)))
    items = F.when(kind.isin("title", "list", "data") & (F.col("table_kind") != "empty"), own).when(
        (kind == "note") & (F.col("table_cells") == 0), notes)
    return rows.select(*_TABLE, *_site(parsed), "title_level", F.inline(items))


def replace_tables(parsed: DataFrame) -> DataFrame:
    """Parsed rows with every converted table spliced in as text and candidate heads, in place.

    The parse emits table rows only where a replacement rule sends the table to conversion. A list heading and its note
    leave in one pass; the note follows as text, and the row's first cell has the next position.
    """
    item, note = F.col("item"), F.col("note")
    is_head = F.col("row_kind").isin("title", "list") & F.col("title_level").isNotNull()
    body = F.when(is_head, item).when(F.col("row_kind") == "data", F.concat(
        F.lit("\n  - "), item, F.lit("\n"))).otherwise(F.concat(F.lit("\n\n"), item, F.lit("\n\n")))
    nothing = F.lit(None).cast("string")
    line = F.struct(
        F.col("pos").alias("pos"), F.when(is_head, "head").otherwise("text").alias("kind"), F.lit("div").alias("tag"),
        F.when(is_head, F.col("title_level")).alias("level"), F.when(is_head, item).alias("text"), body.alias("body"),
        F.when(is_head, F.lit(SPLIT_CLASS)).otherwise(F.lit("")).alias("classes"), F.lit("").alias("ancestors"))
    below = F.struct(
        (F.col("pos") + 1).alias("pos"), F.lit("text").alias("kind"), nothing.alias("tag"),
        F.lit(None).cast("int").alias("level"), nothing.alias("text"),
        F.concat(F.lit("("), note, F.lit(")\n\n")).alias("body"), nothing.alias("classes"), nothing.alias("ancestors"))
    lines = convert_tables(parsed).select("page_id", *_site(parsed), F.inline(
        F.when(note.isNotNull(), F.array(line, below)).otherwise(F.array(line))))
    table_kinds = ("table", "row", "cell", "note")
    return follow(parsed.where(~F.col("kind").isin(*table_kinds)).unionByName(lines, allowMissingColumns=True), parsed)
