"""Sentence boundaries learned from a corpus, without labels.

What follows is counted in one aggregation over all words: how often a word stands with and without a full stop, and what
follows it where it has one. Log-likelihood ratios (Kiss and Strunk, 2006) then tell abbreviations (short words that keep to
their full stop), words that start sentences, and pairs that belong together over a full stop. A full stop behind an
abbreviation, or inside such a pair, ends nothing, unless a capitalised sentence starter follows. Item numbers, bullets, blank
lines and ``!`` and ``?`` always end a sentence, as in :func:`leafgraph.functions.text.split_sentences`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.functions.text import strip
from leafgraph.operators.chunking import let
from leafgraph.session import materialize

# A word with what may stand inside it, and the full stop behind it.
CORE = r"^[^\p{L}\p{N}]*([\p{L}\p{N}](?:[\p{L}\p{N}.'-]*[\p{L}\p{N}])?)(\.?)"
# Thresholds of the published method (fixed values).
ABBREVIATION, STARTER, PAIR = 0.3, 30.0, 7.88
_HARD, _SOFT, _DOT = "\u0001", "\u0003", "\u0002"


@dataclass
class BoundaryModel:
    """``abbreviations(w)``, ``starters(n)`` and ``pairs(w, n)``; all words in lower case."""

    abbreviations: DataFrame
    starters: DataFrame
    pairs: DataFrame


def _core(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, CORE, 1))


def word_counts(documents: DataFrame, text: str = "text") -> DataFrame:
    """``(w, dot, n, c)``: occurrences of word ``w`` with or without a full stop, and with one by the word that follows."""
    # a token is taken apart once, whatever asks for its word
    parts = F.transform(F.split(F.col(text), r"\s+"), lambda x: F.struct(
        _core(x).alias("w"), (F.regexp_extract(x, CORE, 2) != "").alias("dot")))
    rows = documents.select(F.explode(let(F.filter(parts, lambda p: p["w"] != ""), lambda ts: F.transform(ts, lambda x, i: F.struct(
        x["w"].alias("w"), x["dot"].alias("dot"), F.try_element_at(ts, i + 2)["w"].alias("after"))))).alias("t"))
    follows = F.when(F.col("t.dot"), F.coalesce("t.after", F.lit("")))
    return rows.select("t.w", "t.dot", follows.alias("n")).groupBy("w", "dot", "n").agg(F.count("*").alias("c"))


def _xlogy(x: Column, p: Column) -> Column:
    return F.when((x > 0) & (p > 0), x * F.ln(p)).otherwise(F.lit(0.0))


def _likelihood(k: Column, n: Column, p: Column) -> Column:
    return _xlogy(k, p) + _xlogy(n - k, F.lit(1.0) - p)


def dunning(first: Column, second: Column, both: Column, total: Column) -> Column:
    """Log-likelihood ratio of ``second`` occurring ``both`` times among ``first``, against its share of ``total``."""
    rest, other = total - first, second - both
    p, p1, p2 = second / total, both / first, other / rest
    return -2 * (_likelihood(both, first, p) + _likelihood(other, rest, p) - _likelihood(both, first, p1) - _likelihood(other, rest, p2))


def train(documents: DataFrame, text: str = "text") -> BoundaryModel:
    counts = materialize(word_counts(documents, text), "word-counts")
    words = counts.groupBy("w").agg(F.sum("c").cast("double").alias("n_w"),
                                    F.coalesce(F.sum(F.when(F.col("dot"), F.col("c"))), F.lit(0)).cast("double").alias("n_dot"))
    words = materialize(words, "words")
    total = words.agg(F.coalesce(F.sum("n_w"), F.lit(0.0)).alias("x")).scalar()
    stops = words.agg(F.coalesce(F.sum("n_dot"), F.lit(0.0)).alias("x")).scalar()
    facts = words.withColumns({"total": total, "stops": stops})
    p, plain = F.col("stops") / F.col("total"), F.col("n_w") - F.col("n_dot")
    ratio = -2 * (_likelihood(F.col("n_dot"), F.col("n_w"), p) - _likelihood(F.col("n_dot"), F.col("n_w"), F.lit(0.99)))
    inner = F.length("w") - F.length(F.replace("w", F.lit("."), F.lit("")))
    size = (F.length("w") - inner).cast("double")
    score = ratio * F.exp(-size) * (inner + 1) * F.pow(size, -plain)
    abbreviations = facts.where((F.col("n_dot") > 0) & F.rlike("w", F.lit(r"\p{L}")) & (p > 0) & (p < 1)).where(
        score >= ABBREVIATION).select("w")
    abbreviations = materialize(abbreviations, "abbreviations")

    follows = counts.where(F.col("dot") & (F.col("n") != "")).select("w", "n", F.col("c").cast("double").alias("c"))
    ends = follows.join(abbreviations, "w", "left_anti")
    breaks = ends.agg(F.coalesce(F.sum("c"), F.lit(0.0)).alias("x")).scalar()
    known = words.select(F.col("w").alias("n"), F.col("n_w").alias("n_n"))
    first = ends.groupBy("n").agg(F.sum("c").alias("at")).join(known, "n").withColumns({"total": total, "breaks": breaks})
    starters = first.where((F.col("at") * F.col("total") > F.col("n_n") * F.col("breaks")) & (
        dunning(F.col("breaks"), F.col("n_n"), F.col("at"), F.col("total")) >= STARTER)).select("n")
    starters = materialize(starters, "starters")

    both = follows.join(words.select("w", "n_dot"), "w").join(known, "n").join(starters, "n", "left_anti").withColumn("total", total)
    pairs = both.where((F.col("c") > 1) & (F.col("c") * F.col("total") > F.col("n_dot") * F.col("n_n")) & (
        dunning(F.col("n_dot"), F.col("n_n"), F.col("c"), F.col("total")) >= PAIR)).select("w", "n")
    return BoundaryModel(abbreviations, starters, materialize(pairs, "pairs"))


def candidate_pieces(text: Column) -> Column:
    """Pieces between all possible boundaries; one behind a full stop begins with a mark, the others begin in any case."""
    text = F.regexp_replace(text, r"(^|\n)\s*(\d+)\.\s", f"{_HARD}$2{_DOT}")
    text = F.regexp_replace(text, r"(^|\n)\s*(\*+)", f"{_HARD}$2")
    text = F.regexp_replace(text, r"\n\n", _HARD)
    text = F.regexp_replace(text, r"([!?])\s+", f"$1{_HARD}")
    text = F.regexp_replace(text, r"(\.)\s+", f"$1{_HARD}{_SOFT}")
    parts = F.transform(F.split(F.replace(text, F.lit(_DOT), F.lit(". ")), _HARD), lambda p: F.struct(
        F.startswith(p, F.lit(_SOFT)).alias("soft"), strip(F.replace(p, F.lit(_SOFT), F.lit(""))).alias("text")))
    return F.filter(parts, lambda p: p["text"] != "")


def trained_sentences(documents: DataFrame, model: BoundaryModel, text: str = "text", id: str = "doc_id") -> DataFrame:
    """``(id, i, sentence)`` of documents with distinct ids.

    Only the places where a full stop might end a sentence are looked up in the model; texts stay whole.
    """
    rows = documents.select(id, candidate_pieces(F.col(text)).alias("pieces"))
    last = lambda p: F.regexp_extract(p["text"], r"(\S+)$", 1)
    head = lambda p: F.regexp_extract(p["text"], r"^(\S+)", 1)
    joints = F.filter(F.transform("pieces", lambda p, i: F.when((i > 0) & p["soft"], F.struct(
        i.alias("i"), _core(last(F.try_element_at(F.col("pieces"), i))).alias("w"), _core(head(p)).alias("n"),
        F.rlike(F.regexp_extract(head(p), CORE, 1), F.lit(r"^\p{Lu}")).alias("capital")))), lambda j: j.isNotNull())
    told = rows.select(id, F.inline(joints)).join(model.abbreviations.withColumn("short", F.lit(True)), "w", "left").join(
        model.starters.withColumn("starts", F.lit(True)), "n", "left").join(
        model.pairs.withColumn("pair", F.lit(True)), ["w", "n"], "left")
    starts = F.col("capital") & F.coalesce("starts", F.lit(False))
    inside = F.coalesce("pair", F.lit(False)) | (F.coalesce("short", F.lit(False)) & ~starts)
    merged = told.where(inside).groupBy(id).agg(F.collect_set("i").alias("_inside"))
    none = F.array().cast("array<int>")

    def put(done: Column, piece: Column) -> Column:
        whole = F.concat(F.element_at(done, -1), F.lit(" "), piece["text"])
        return F.when(piece["glued"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(whole))).otherwise(
            F.concat(done, F.array(piece["text"])))

    flagged = F.transform("pieces", lambda p, i: F.struct(p["text"].alias("text"), F.array_contains("_inside", i).alias("glued")))
    sentences = F.aggregate(flagged, F.array().cast("array<string>"), put)
    return rows.join(merged, id, "left").withColumn("_inside", F.coalesce("_inside", none)).select(
        id, F.posexplode(F.when(F.size("_inside") > 0, sentences).otherwise(F.col("pieces")["text"])).alias("i", "sentence"))
