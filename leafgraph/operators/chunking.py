"""Splitting over-long texts into chunks, inside the JVM.

Packing is a left fold over sentence lengths. The accumulator holds the running length and the start index of every
chunk, never the text, so a document of n sentences and c chunks costs n steps and c small arrays; the text is cut
once, by ``slice``, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.functions.text import split_sentences

MAX_LEN = 1000


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once; a lambda body evaluates an outer expression once per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _fold_starts(units: Column, max_len: int | Column) -> Column:
    """Start index (0-based) of every chunk when ``units(len, force)`` are packed greedily."""
    zero = F.struct(F.lit(0).alias("size"), F.lit(0).alias("i"), F.array(F.lit(0)).alias("starts"))

    def step(acc: Column, unit: Column) -> Column:
        fits = (acc["size"] + F.lit(1) + unit["len"] <= max_len) & ~unit["force"]
        first = acc["i"] == 0
        stay = fits | first
        return F.struct(
            F.when(first, unit["len"]).when(fits, acc["size"] + F.lit(1) + unit["len"]).otherwise(unit["len"])
            .alias("size"),
            (acc["i"] + 1).alias("i"),
            F.when(stay, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["i"]))).alias("starts"))

    return F.aggregate(units, zero, step, lambda acc: acc["starts"])


def _cut(parts: Column, starts: Column) -> Column:
    """Join ``parts`` between neighbouring start indices with a blank."""
    def piece(start: Column, n: Column) -> Column:
        end = F.coalesce(F.try_element_at(starts, n + 2), F.size(parts))
        return F.array_join(F.slice(parts, start + 1, end - start), " ")
    return F.when(F.size(parts) > 0, F.transform(starts, piece)).otherwise(F.array().cast("array<string>"))


def _units(parts: Column, force: Column | None = None) -> Column:
    return F.transform(parts, lambda p: F.struct(
        F.length(p).alias("len"), (F.lit(False) if force is None else force).alias("force")))


def pack(parts: Column, max_len: int | Column = MAX_LEN) -> Column:
    """Greedy packing of strings into chunks of at most ``max_len``; a longer string stays whole."""
    return let(parts, lambda p: let(_fold_starts(_units(p), max_len), lambda starts: _cut(p, starts)))


def pack_words(sentence: Column, max_len: int | Column = MAX_LEN) -> Column:
    """Chunks of an over-long sentence, cut at white space; a longer word stays whole."""
    words = F.filter(F.split(sentence, r"\s+"), lambda w: w != "")
    return pack(words, max_len)


def _pieces(sentences: Column, max_len: int | Column) -> Column:
    """Sentences as ``(text, force)``; an over-long one gives word-packed pieces that each open a chunk."""
    return F.flatten(F.transform(sentences, lambda s: F.when(
        F.length(s) > max_len,
        F.transform(pack_words(s, max_len), lambda p: F.struct(p.alias("text"), F.lit(True).alias("force")))
    ).otherwise(F.array(F.struct(s.alias("text"), F.lit(False).alias("force"))))))


def chunk_array(text: Column, max_len: int | Column = MAX_LEN) -> Column:
    """Chunks of a text that is longer than ``max_len``; the sentence after an over-long one may join its last piece."""
    def cut(pieces: Column) -> Column:
        units = F.transform(pieces, lambda p: F.struct(F.length(p["text"]).alias("len"), p["force"].alias("force")))
        return let(_fold_starts(units, max_len), lambda starts: let(pieces["text"], lambda t: _cut(t, starts)))
    return let(_pieces(split_sentences(text), max_len), cut)


def split_long_texts(df: DataFrame, text: str = "text", max_len: int | Column = MAX_LEN, index: str = "split_idx") -> DataFrame:
    """One row per chunk. Short texts pass through as chunk 0; only long ones are cut. ``max_len`` may be a column.

    Narrow: no shuffle and no Python.
    """
    chunks = F.when(F.length(F.col(text)) > max_len, chunk_array(F.col(text), max_len)).otherwise(F.array(F.col(text)))
    return df.select(*[c for c in df.columns if c != text], F.posexplode(chunks).alias(index, text))


def recursive_chunks(text: Column, size: int = 2000, overlap: int = 100,
                     separators: tuple[str, ...] = ("\n\n", "\n", " ")) -> Column:
    """Fixed-size chunks with overlap; split at blank lines, then lines, then blanks, then anywhere.

    Pieces keep their separator. A chunk holds at most ``size`` characters and starts with as many whole pieces from
    the end of the chunk before it as fit into ``overlap`` (always leaving room for the next piece).
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    def cut_at(sep: str):
        return lambda p: F.when(F.length(p) > size, _keep_separator(p, sep)).otherwise(F.array(p))

    parts = F.array(text)
    for sep in separators:
        parts = F.flatten(F.transform(parts, cut_at(sep)))
    parts = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) > size, F.transform(
        F.sequence(F.lit(0), F.floor((F.length(p) - 1) / size).cast("int")),
        lambda i: F.substring(p, i * size + 1, F.lit(size)))).otherwise(F.array(p))))
    return let(F.filter(parts, lambda p: p != ""), lambda p: _window_pieces(p, size, overlap))


def _keep_separator(part: Column, sep: str) -> Column:
    return let(F.split(part, sep, -1), lambda cut: let(F.size(cut) - 1, lambda last: F.transform(
        cut, lambda p, i: F.when(i < last, F.concat(p, F.lit(sep))).otherwise(p))))


def _window_pieces(parts: Column, size: int, overlap: int) -> Column:
    """Chunks as ``[from, to)`` piece ranges: a range grows until the next piece does not fit, then restarts with the
    trailing pieces that fit into the overlap."""
    zero = F.struct(F.lit(0).alias("i"), F.lit(0).alias("start"), F.lit(0).alias("size"),
                    F.array().cast("array<int>").alias("tail"),
                    F.array().cast("array<struct<a:int,b:int>>").alias("done"))

    def step(acc: Column, part: Column) -> Column:
        n = F.length(part)
        full = (acc["size"] + n > size) & (acc["size"] > 0)
        room = F.least(F.lit(overlap), F.lit(size) - n)
        # lengths of trailing pieces, longest suffix whose sum fits into the room
        keep = F.aggregate(
            F.reverse(acc["tail"]),
            F.struct(F.lit(0).alias("sum"), F.lit(0).alias("n"), F.lit(True).alias("open")),
            lambda k, x: F.when(k["open"] & (k["sum"] + x <= room), F.struct(
                (k["sum"] + x).alias("sum"), (k["n"] + 1).alias("n"), F.lit(True).alias("open"))
            ).otherwise(F.struct(k["sum"].alias("sum"), k["n"].alias("n"), F.lit(False).alias("open"))))
        # only pieces that could ever fit into the overlap are remembered
        tail = F.slice(F.concat(acc["tail"], F.array(n)), -F.least(F.size(acc["tail"]) + 1, F.lit(overlap)),
                       F.lit(overlap))
        return F.when(full, F.struct(
            (acc["i"] + 1).alias("i"), (acc["i"] - keep["n"]).alias("start"), (keep["sum"] + n).alias("size"),
            tail.alias("tail"),
            F.concat(acc["done"], F.array(F.struct(acc["start"].alias("a"), acc["i"].alias("b")))).alias("done"))
        ).otherwise(F.struct(
            (acc["i"] + 1).alias("i"), acc["start"].alias("start"), (acc["size"] + n).alias("size"),
            tail.alias("tail"), acc["done"].alias("done")))

    ranges = F.aggregate(parts, zero, step, lambda acc: F.when(acc["i"] > acc["start"], F.concat(
        acc["done"], F.array(F.struct(acc["start"].alias("a"), acc["i"].alias("b"))))).otherwise(acc["done"]))
    return F.transform(ranges, lambda r: F.array_join(F.slice(parts, r["a"] + 1, r["b"] - r["a"]), ""))
