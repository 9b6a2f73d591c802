"""Exact and near phrase search with a distributed positional index; columns and SQL functions only.

The words of every text and their positions are postings. The index stores the postings of the *key terms* of a set of
phrases: each phrase's two rarest terms by their count in the whole corpus, so common words are never stored. Searching a
phrase starts from the postings of its rarest term, each shifted back by the term's offset in the phrase: where the phrase
would begin. These are intersected with the shifted postings of the second rarest term, and what is left with those of all
other terms, which are taken from the few documents that remain.

Every list is a table keyed by (document, beginning), so a frequent term or a long document spreads over many keys. No
document text moves unless it holds a candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.session import materialize

#: What lies between words before A-Z are lower-cased: ASCII other than digits and letters.
SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 10


def cut(text: Column) -> Column:
    """The text split at separators; an empty string can stand at either end only."""
    return F.split(F.coalesce(text, F.lit("")), SEPARATOR)


def trimmed(parts: Column) -> Column:
    """``parts`` without empty ends."""
    first = F.when(parts[0] == "", 2).otherwise(1)
    last = F.when(F.element_at(parts, -1) == "", 1).otherwise(0)
    return F.slice(parts, first, F.greatest(F.size(parts) - first + 1 - last, F.lit(0)))


def words(text: Column) -> Column:
    """Words of a text in order, as they are written; empty for null."""
    return trimmed(cut(text))


def lowered(word: Column) -> Column:
    """A-Z lower-cased; other letters stay."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(
        F.translate(word, CAPITALS, CAPITALS.lower()))


def postings(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, term) of every word."""
    rows = documents.select("doc_id", cut(F.col("text")).alias("parts"))  # once; a generator would split for each use
    rows = rows.select("doc_id", F.posexplode(trimmed(F.col("parts"))).alias("pos", "term"))
    return rows.select("doc_id", "pos", lowered(F.col("term")).alias("term"))


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, phrase, terms): every ``window`` consecutive words of an item's text; all of them if there are fewer.

    ``phrase`` identifies the sequence of words: equal sequences of different items share it.
    """
    own = items.select("item_id", F.transform(words(F.col("text")), lowered).alias("w")).filter(F.size("w") > 0)
    begin = F.explode(F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1))))
    rows = own.select("item_id", "w", begin.alias("begin"))
    rows = rows.select("item_id", F.slice("w", F.col("begin"), window).alias("terms"))
    return rows.select("item_id", F.sha2(F.array_join("terms", " "), 256).alias("phrase"), "terms").distinct()


def build_index(documents: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Postings of the key terms, and each phrase's terms as (phrase, term, offset, rank); rank 0 is the rarest.

    Both are written tables. ``wanted`` has (phrase, terms). Ties in rarity are broken by the term, then by the offset.
    """
    terms = materialize(wanted.select("phrase", "terms").distinct().select(
        "phrase", F.posexplode("terms").alias("offset", "term")), "terms")
    vocabulary = materialize(terms.select("term").distinct(), "vocabulary")  # its size is known when the join is planned
    counts = postings(documents).join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("phrase").orderBy(F.coalesce("n", F.lit(0)), "term", "offset")
    ranked = terms.join(counts, "term", "left").withColumn("rank", F.row_number().over(order) - 1)
    ranked = materialize(ranked.select("phrase", "term", "offset", "rank"), "ranked")
    keys = materialize(ranked.filter("rank < 2").select("term").distinct(), "keys")
    return materialize(postings(documents).join(keys, "term").select("term", "doc_id", "pos"), "postings"), ranked


def search(documents: DataFrame, wanted: DataFrame, slop: int = 0) -> DataFrame:
    """(doc_id, begin, phrase) of every occurrence of a phrase.

    With ``slop`` 0 the words follow each other exactly. With a positive ``slop`` each term may stand up to so many places
    from where the rarest term puts it: a proximity match, reported where the rarest term puts its beginning. Rows
    without ``doc_id`` are never found; of texts that share a ``doc_id``, the occurrences are given together.
    """
    index, ranked = build_index(documents, wanted)
    shifted = index.join(ranked, "term").select("phrase", "doc_id", "rank", (F.col("pos") - F.col("offset")).alias("begin"))
    rarest = shifted.filter("rank = 0").select("phrase", "doc_id", "begin")
    lone = ranked.groupBy("phrase").agg(F.max("rank").alias("last"))
    second = _near(shifted.filter("rank = 1").select("phrase", "doc_id", "begin"), slop)
    left = rarest.join(lone, "phrase")
    left = left.join(second.withColumn("both", F.lit(True)), ["phrase", "doc_id", "begin"], "left")
    left = materialize(left.filter("both or last = 0").select("phrase", "doc_id", "begin", "last").distinct(), "candidates")

    # the other terms, from documents that hold a candidate
    rest = left.filter("last > 1").join(ranked.filter("rank > 1"), "phrase")
    near = F.explode(F.sequence(F.lit(-slop), F.lit(slop))).alias("shift")
    rest = rest.select("phrase", "doc_id", "begin", "rank", "term", "offset", near).select(
        "phrase", "doc_id", "begin", "rank", "term", (F.col("begin") + F.col("offset") + F.col("shift")).alias("pos"))
    holders = materialize(left.filter("last > 1").select("doc_id").distinct(), "holders")
    there = postings(documents.join(holders, "doc_id", "left_semi"))
    found = rest.join(there, ["doc_id", "pos", "term"]).groupBy("phrase", "doc_id", "begin").agg(
        F.countDistinct("rank").alias("n"))
    found = found.join(lone, "phrase").filter(F.col("n") == F.col("last") - 1).select("doc_id", "begin", "phrase")
    return found.union(left.filter("last <= 1").select("doc_id", "begin", "phrase"))


def _near(rows: DataFrame, slop: int) -> DataFrame:
    if not slop:
        return rows.distinct()
    shift = F.explode(F.sequence(F.lit(-slop), F.lit(slop)))
    return rows.withColumn("shift", shift).select(
        "phrase", "doc_id", (F.col("begin") + F.col("shift")).alias("begin")).distinct()


def contamination(documents: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted item ids as strings), contaminated, of every document.

    A word is hit if it lies in an occurrence of a window of an item. Null and blank texts have no words, on either side;
    an item without words matches nothing. A row without ``doc_id`` is kept and never hit. Rows that share a ``doc_id`` each
    keep their row and their own number of words, with the hits of all of them. Other columns are ignored.
    """
    texts = documents.select("doc_id", "text")
    wanted = materialize(phrases(items, window), "phrases")
    hits = materialize(search(texts, wanted.select("phrase", "terms")), "hits")
    lengths = wanted.select("phrase", F.size("terms").alias("length")).distinct()
    spans = hits.join(lengths, "phrase").select(
        "doc_id", F.explode(F.sequence("begin", F.col("begin") + F.col("length") - 1)).alias("pos")).distinct()
    covered = spans.groupBy("doc_id").agg(F.count("*").alias("n_hit"))
    owners = hits.select("doc_id", "phrase").distinct().join(wanted.select("phrase", "item_id"), "phrase")
    owners = owners.select("doc_id", F.col("item_id").cast("string").alias("item")).distinct().groupBy("doc_id").agg(
        F.count("*").alias("n_items"), F.array_sort(F.collect_list("item")).alias("items"))
    found = covered.join(owners, "doc_id")
    parts = texts.select("doc_id", cut(F.col("text")).alias("parts"))
    sizes = parts.select("doc_id", F.size(trimmed(F.col("parts"))).cast("long").alias("n_words"))
    return sizes.join(found, "doc_id", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))
