"""Spelling correction against the vocabulary of a corpus.

Two words within an edit distance have a word in common that both become by deleting as many letters, so an index of the
vocabulary by its deletions finds all candidates of a word by equality. They are verified by edit distance, and the best one is
what a noisy channel says: frequent words first, an edit costing a factor of ``EDIT``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgraph.operators.context import spell_alert
from leafgraph.session import materialize

EDIT = 1000  # an edit is this many times less likely than none
LONGEST = 24  # letters of a word that is looked up or offered
_EDGE = r"(?<=[A-Za-z])(?=[^A-Za-z])|(?<=[^A-Za-z])(?=[A-Za-z])"


def vocabulary(documents: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """``(word, n)``: runs of ASCII letters in lower case that occur at least ``least`` times; one aggregation."""
    words = documents.select(F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z]+"), 0)).alias("word"))
    return words.where(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def reach(word: Column) -> Column:
    """Edits that are looked for: one in words of up to four letters, else two."""
    return F.when(F.length(word) > 4, 2).otherwise(1)


def deletions(word: Column) -> Column:
    """The word and what becomes of it when up to two letters go."""
    def one(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(
            F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    first = one(word)
    return F.array_distinct(F.concat(F.array(word), first, F.flatten(F.transform(first, one))))


def best_words(unknown: DataFrame, words: DataFrame) -> DataFrame:
    """``(word, best)``: for words that the vocabulary ``words(word, n)`` lacks the likeliest one within reach, if there is any."""
    asked = unknown.select("word").distinct().where(F.length("word") <= LONGEST)
    index = words.select(F.explode(deletions(F.col("word"))).alias("rest"), F.col("word").alias("offer"), "n")
    found = asked.select("word", F.explode(deletions(F.col("word"))).alias("rest")).join(index, "rest").select("word", "offer", "n").distinct()
    edits = F.levenshtein("word", "offer")
    near = found.withColumn("edits", edits).where(F.col("edits") <= reach(F.col("word")))
    score = F.col("n") * F.pow(F.lit(float(EDIT)), 2 - F.col("edits"))
    return near.groupBy("word").agg(F.min(F.struct((-score).alias("score"), "offer")).alias("b")).select("word", F.col("b.offer").alias("best"))


def correct_questions(questions: DataFrame, words: DataFrame, question: str = "question", id: str = "question_id") -> DataFrame:
    """``(id, corrected, alert)``: words of two letters and more that the vocabulary lacks are replaced by their best offer.

    What is not a word stays as it is, and so do words without an offer; a capital first letter is kept. ``alert`` is the note
    that the answer shows, null where nothing but case changed.
    """
    pieces = materialize(questions.select(id, F.posexplode(F.split(F.col(question), _EDGE)).alias("i", "piece")).withColumn(
        "word", F.lower("piece")), "pieces")
    open_ = pieces.where(F.rlike("word", F.lit("^[a-z]{2,}$"))).join(words.select("word"), "word", "left_anti")
    fixed = pieces.join(best_words(open_, words), "word", "left")
    capital = F.rlike("piece", F.lit("^[A-Z]"))
    shown = F.coalesce(F.when(capital, F.initcap("best")).otherwise(F.col("best")), "piece")
    whole = fixed.groupBy(id).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", shown.alias("p")))),
                                                           lambda x: x["p"]), "").alias("corrected"))
    return questions.select(id, question).join(whole, id).select(id, "corrected", spell_alert(F.col(question), F.col("corrected")).alias("alert"))
