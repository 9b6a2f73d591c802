"""Question log, feedback and update log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from leafgraph import schemas as S


def qa_pairs(conversations: DataFrame, block: int = 1000) -> DataFrame:
    """Each user turn whose next turn is an assistant's: ``(conv_id, turn, question, answer)``.

    Turns may have gaps. A conversation is cut into blocks of ``block`` turn numbers, so that a long one is no hot key; the
    first turn of each block also ends the block before it that has any turn.
    """
    rows = conversations.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / block).alias("block"))
    firsts = rows.groupBy("conv_id", "block").agg(F.min_by(F.struct("turn", "role", "text"), "turn").alias("head"))
    after = firsts.select("conv_id", "block", F.lead("head").over(
        Window.partitionBy("conv_id").orderBy("block")).alias("after"))  # a row per block
    order = Window.partitionBy("conv_id", "block").orderBy("turn")
    rows = rows.withColumn("follows", F.lead(F.struct("turn", "role", "text")).over(order))
    rows = rows.where("role = 'user'").join(after, ["conv_id", "block"])
    rows = rows.withColumn("follows", F.coalesce("follows", "after"))
    return rows.where("follows.role = 'assistant'").select("conv_id", "turn", F.col("text").alias("question"),
                                                           F.col("follows.text").alias("answer"))


def parse_question_log(raw: DataFrame, value: str = "value") -> DataFrame:
    """Question log rows from JSON payloads, bound by field name."""
    return raw.select(F.from_json(F.col(value), S.QUESTION_LOG).alias("r")).select("r.*")


def parse_questions(raw: DataFrame, value: str = "value") -> DataFrame:
    """Question log rows with ``payload`` and ``valid``, which is false where there is no question to be read."""
    rows = raw.select(F.col(value).alias("payload"), F.from_json(F.col(value), S.QUESTION_LOG).alias("r"))
    return rows.select("r.*", F.col("r.question").isNotNull().alias("valid"), "payload")


def parse_id_list(text: Column) -> Column:
    """``"1,2,3,"`` as an array of ids; blanks and junk are left out."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x).try_cast("long")),
                    lambda x: x.isNotNull())


def parse_feedback(raw: DataFrame, value: str = "value") -> DataFrame:
    """Feedback rows from JSON payloads; ``valid`` is false where the reference number or the question is unusable.

    Exactly ``yes`` counts as helpful.
    """
    p = F.from_json(F.col(value), S.FEEDBACK_PAYLOAD)
    rows = raw.select(F.col(value).alias("payload"), p.alias("p"))
    field = lambda name: F.col("p").getField(name)
    best = F.trim(field("feedback-reference-select")).try_cast("int")
    return rows.select(
        field("event_id").alias("event_id"),
        F.coalesce(field("feedback-hidden-helpful") == "yes", F.lit(False)).alias("helpful_response"),
        field("feedback-hidden-question").alias("question"),
        field("feedback-hidden-context").alias("context"),
        parse_id_list(field("feedback-hidden-reference-ids")).alias("retrieved_doc_ids"),
        field("feedback-hidden-response").alias("response"),
        best.alias("most_relevant_doc"),
        field("feedback-comments").alias("comment"),
        field("logged_at").alias("logged_at"),
        F.coalesce(best.isNotNull() & field("feedback-hidden-question").isNotNull(), F.lit(False)).alias("valid"),
        "payload")


def split_feedback(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted rows and rejected payloads."""
    return parsed.where("valid").drop("valid", "payload"), parsed.where("NOT valid").select("event_id", "payload")


def last_update(log: DataFrame, id: str = "id", at: str = "datetime") -> DataFrame:
    """The newest entry of the update log as ``%m/%d/%Y, %H:%M:%S (UTC)``."""
    newest = log.agg(F.max_by(at, id).alias("at"))
    return newest.select(F.concat(F.date_format("at", "MM/dd/yyyy, HH:mm:ss"), F.lit(" (UTC)")).alias("last_updated"))


def _audit(required: str) -> list[Column]:
    text = F.col(required)
    return [F.count("*").alias("n_rows"), F.count_if(text.isNull()).alias("n_null"),
            F.count_if(F.trim(text) == "").alias("n_blank"),
            F.coalesce(F.sum(F.length(text).cast("long")), F.lit(0).cast("long")).alias("n_chars")]


def load_audit(df: DataFrame, required: str = "text") -> DataFrame:
    """Row count, null and blank counts of the loaded text column, in one pass."""
    return df.agg(*_audit(required))


def observed(df: DataFrame, write: Callable[[DataFrame], None], required: str = "text") -> DataFrame:
    """What :func:`load_audit` says of the rows that ``write`` gets, counted while it writes them: the rows are read once."""
    found = Observation("load")
    write(df.observe(found, *_audit(required)))
    names = ("n_rows", "n_null", "n_blank", "n_chars")
    return df.sparkSession.createDataFrame([tuple(found.get[c] for c in names)], ", ".join(f"{c} long" for c in names))


def export_rows(rows: DataFrame) -> DataFrame:
    """Rows as a CSV file can hold them: arrays joined by commas."""
    out = []
    for f in rows.schema.fields:
        if f.dataType.typeName() == "array":
            out.append(F.array_join(F.transform(F.col(f.name), lambda x: x.cast("string")), ",").alias(f.name))
        else:
            out.append(F.col(f.name))
    return rows.select(*out)
