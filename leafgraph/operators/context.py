"""From hits to answer contexts: budgets, formatting, relevance, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.functions.text import is_empty_answer, parse_verdict

_LABEL = "Document "


def format_context(hits: DataFrame, text: str = "text", **more: Column) -> DataFrame:
    """``(question_id, context)``: numbered texts in rank order. A question has a handful of hits, k at most.

    ``more`` are further aggregates over the hits of a question.
    """
    numbered = F.transform(
        F.array_sort(F.collect_list(F.struct("rank", F.col(text).alias("t")))),
        lambda x, i: F.concat(F.lit(_LABEL), (i + 1).cast("string"), F.lit(":\n"), x["t"]))
    return hits.groupBy("question_id").agg(
        F.array_join(numbered, "\n").alias("context"), *[agg.alias(name) for name, agg in more.items()])


def context_budget(hits: DataFrame, max_chars: int = 25_000, text: str = "text") -> DataFrame:
    """Add ``kept`` (longest ranked prefix whose formatted context fits) and ``removed_order`` (last rank first)."""
    order = Window.partitionBy("question_id").orderBy("rank")
    place = F.row_number().over(order)
    size = F.length(text) + len(_LABEL) + F.length(F.col("_place").cast("string")) + 2
    rows = hits.withColumn("_place", place).withColumn(
        "used_chars", F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_place") - 1)
    rows = rows.withColumn("kept", F.col("used_chars") <= max_chars)
    back = F.row_number().over(Window.partitionBy("question_id", "kept").orderBy(F.desc("rank")))
    return rows.withColumn("removed_order", F.when(~F.col("kept"), back)).drop("_place")


def word_count(text: Column) -> Column:
    """Default token measure: blank-separated words."""
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def token_buckets(hits: DataFrame, max_tokens: int = 750, tokens: Column | None = None, overhead: Column | int = 0
                  ) -> DataFrame:
    """Add ``bucket_no``: ranked hits packed in order into prompts of at most ``max_tokens``.

    ``overhead`` is what question and instructions take in every prompt. A hit that alone is too long is a bucket.
    """
    tokens = word_count(F.col("text")) if tokens is None else tokens
    fixed = F.lit(overhead) if isinstance(overhead, int) else overhead
    packed = hits.groupBy("question_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", tokens.alias("n"), fixed.cast("int").alias("fixed")))).alias("items"))
    zero = F.struct(F.lit(0).alias("used"), F.lit(0).alias("no"),
                    F.array().cast("array<struct<rank:int,bucket_no:int>>").alias("out"))

    def step(acc: Column, it: Column) -> Column:
        opens = (F.size(acc["out"]) > 0) & (acc["used"] + it["n"] > max_tokens)
        no = acc["no"] + F.when(opens, 1).otherwise(0)
        used = F.when(opens | (F.size(acc["out"]) == 0), it["fixed"] + it["n"]).otherwise(acc["used"] + it["n"])
        return F.struct(used.alias("used"), no.alias("no"), F.concat(acc["out"], F.array(F.struct(
            it["rank"].cast("int").alias("rank"), no.alias("bucket_no")))).alias("out"))

    places = packed.select("question_id", F.inline(F.aggregate("items", zero, step, lambda a: a["out"])))
    return hits.join(places, ["question_id", "rank"])


def first_answer(answers: DataFrame) -> DataFrame:
    """Per question the answer of the first bucket that has one; null when none has."""
    usable = F.when(~is_empty_answer(F.col("answer")), F.col("bucket_no"))
    return answers.groupBy("question_id").agg(
        F.min_by("answer", usable).alias("answer"), F.min(usable).alias("bucket_no"))


def overflow(hits: DataFrame, k: int) -> DataFrame:
    """Add ``overflow``: hits beyond the k best, which go to the front of the removed ones."""
    order = Window.partitionBy("question_id").orderBy("rank")
    return hits.withColumn("overflow", F.row_number().over(order) > k)


def relevance_partition(judged: DataFrame, reply: str = "reply", default: bool | None = False) -> DataFrame:
    """Add ``keep`` and ``keep_reason`` from the judge's reply, evaluated once."""
    return judged.withColumns({"keep": parse_verdict(F.col(reply), default), "keep_reason": F.col(reply)})


def related_links(links: Column, compressed: Column) -> Column:
    """Links whose text occurs in the compressed text."""
    return F.filter(links, lambda l: F.contains(compressed, l["title"]))


def spell_alert(query: Column, corrected: Column) -> Column:
    """The note shown when the corrected query differs in more than case; null otherwise."""
    return F.when(F.lower(query) != F.lower(corrected),
                  F.concat(F.lit("Used spell/grammar corrected query: "), corrected))


def ignored_alert(values: Column) -> Column:
    """The note that lists profile values that had to be given up; null when there are none."""
    return F.when(F.size(values) > 0, F.concat(
        F.lit("Did not find answer specific to "), F.array_join(values, ", ")))
