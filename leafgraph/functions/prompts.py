"""Question sentences, context strings and prompt rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Prompt wording per model family and kind. ``{name}`` marks a placeholder column.
PROMPT_TEMPLATES = {
    ("header_tokens", "answer"):
        "<|begin_of_text|>\n<|start_header_id|>system<|end_header_id|>\n{system}\n<|eot_id|>\n"
        "<|start_header_id|>user<|end_header_id|>\n{question}\n<|eot_id|>\n"
        "<|start_header_id|>documents<|end_header_id|>\n{context}\n<|eot_id|>\n"
        "<|start_header_id|>assistant<|end_header_id|>\n",
    ("header_tokens", "relevance"):
        "<|begin_of_text|>\n<|start_header_id|>system<|end_header_id|>\n{system}\n<|eot_id|>\n"
        "<|start_header_id|>question<|end_header_id|>\n{question}\n<|eot_id|>\n"
        "<|start_header_id|>document<|end_header_id|>\n{context}\n<|eot_id|>\n"
        "<|start_header_id|>assistant<|end_header_id|>\n",
    ("plain", "answer"):
        "{system}.\nHere is the question: {question}.\nHere are the source documents: {context}\n",
    ("plain", "relevance"):
        "Here is a question that a user asked: {question}.\nHere is the text from a document: {context}.\n{system}\n",
    ("default", "answer"):
        "Please answer the question based on the context below.\n"
        "Use only the context provided to answer the question, and no other information.\n"
        "If the context doesn't have enough information to answer, explain what information is missing.\n\n"
        "Context:\n{context}\n\nQuestion:\n{question}",
    ("default", "relevance"):
        "\nGiven the following question and document, return YES if the document contains the answer to the question, "
        "and NO otherwise.\nIf the document is not about {profile}, answer NO.\n"
        "> Question: {question}\n> Document: {context}\n",
    ("default", "spelling"):
        "\nPlease correct the grammar and spelling errors in the user's text. \n"
        "Return only the corrected version of the text, do not respond to the question and do not include any "
        "annotation.\nUSER:\n>>> begin input\nths is a sentince i wrote\n>>> end input\nASSISTANT:\n"
        ">>> begin correction\nThis is a sentence I have written.\n>>> end correction\nUSER:\n"
        ">>> begin input\n{question}\n>>> end input\nASSISTANT:\n>>> begin correction\n",
    ("vicuna", "answer"):
        "A chat between a student and an academic advising assistant.\n"
        "The assistant gives detailed and polite responses.\n"
        "The assistant knows only the following information, and never uses any other knowledge.\n"
        "If the assistant does not know the necessary information to answer, then the assistant says "
        "\"I do not have the information to answer\".\n"
        "If none of the references that the assistant has are relevant, then the assistant says "
        "\"I do not have the information to answer\".\n\n"
        "Here is the information that the assistant knows:\n\n{context}\n\nUSER:\n{question}\n\nASSISTANT:\n",
    ("vicuna", "relevance"):
        "\nA chat between a student and an artificial intelligence assistant.\n"
        "The user wants to answer the question: For {profile},  {question}\n\n"
        "The user doesn't want any information that is not specifically about {profile}.\n"
        "Note that combined majors, honours, and majors are all different programs.\n\n\nUSER:\n"
        "Is the text below about {profile} and contain information relevant to answer the question?\n"
        "Say 'yes, because...' or 'no, because...', then explain why you answered yes or no.\n"
        "If the text is not about {profile}, say no because it is not relevant.\n\n> Text: \n{context}\n\nASSISTANT:\n",
    ("vicuna", "relevance_no_profile"):
        "\nA chat between a student and an artificial intelligence assistant.\n"
        "The user wants to answer the question:  {question}\n\n\nUSER:\n"
        "Does the text below contain information relevant to answer the question?\n"
        "Say 'yes, because...' or 'no, because...', then explain why you answered yes or no.\n"
        "> Text: \n{context}\n\nASSISTANT:\n",
    ("span", "answer"): "{question}{separator}{context}",
}

# What the system part of a prompt says by default; callers can pass their own.
ANSWER_SYSTEM = "You are a helpful student advising assistant who answers with kindness while being concise."
RELEVANCE_SYSTEM = "Provide a short explaination if the document is relevant to the question or not."


def _has(value: Column) -> Column:
    return F.length(F.coalesce(value, F.lit(""))) > 0


def _part(value: Column, before: str, after: str = "") -> Column:
    return F.when(_has(value), F.concat(F.lit(before), value, F.lit(after))).otherwise(F.lit(""))


def question_sentence(faculty: Column, program: Column, specialization: Column, year: Column, topic: Column,
                      question: Column) -> Column:
    """The profile spelled out as sentences in front of the question; unset fields add nothing."""
    return F.concat(
        _part(faculty, "I am in ", ". "),
        _part(program, "I am in the ", " program. "),
        _part(specialization, "I am in the ", " specialization. "),
        _part(year, "I am in my ", ". "),
        _part(topic, "The topic of the question is ", ". "),
        question)


def program_sentence(faculty: Column, program: Column, specialization: Column, year: Column) -> Column:
    said = F.concat(_part(faculty, "I am in "), _part(program, ", "), _part(specialization, ", "), _part(year, " in "))
    return F.when(said == "", said).otherwise(F.concat(said, F.lit(".")))


def filter_context(specialization: Column, year: Column, topic: Column | None = None) -> Column:
    """What an answer has to be about; null when nothing narrows it."""
    said = _part(topic, "the topic ") if topic is not None else F.lit("")
    said = F.concat(said, F.when(_has(specialization) & (said != ""), F.lit(" for ")).otherwise(F.lit("")),
                    _part(specialization, ""))
    said = F.concat(said, F.when(_has(year) & (said != ""), F.lit(" in ")).otherwise(F.lit("")), _part(year, ""))
    return F.when(said != "", said)


def full_question(faculty: Column, program: Column, specialization: Column, year: Column, topic: Column,
                  question: Column) -> Column:
    """Question with profile and topic, and the request to decline when a profile narrows it."""
    asked = F.when(_has(topic), F.concat(F.lit("On the topic of "), topic, F.lit(": "), question)).otherwise(question)
    about = filter_context(specialization, year)
    decline = F.when(about.isNotNull(), F.concat(
        F.lit(" If none of the references are about "), about,
        F.lit(", say \"I do not have the information to answer\"."))).otherwise(F.lit(""))
    return F.concat(program_sentence(faculty, program, specialization, year), F.lit(" "), asked, decline)


def context_string(*values: Column) -> Column:
    """Non-empty values joined by ``' : '``."""
    return F.array_join(F.filter(F.array(*[F.coalesce(v, F.lit("")) for v in values]), lambda v: v != ""), " : ")


def template_table(spark: SparkSession) -> DataFrame:
    """Templates as rows ``(family, kind, template)``; their number is fixed by ``PROMPT_TEMPLATES``."""
    rows = [(family, kind, text) for (family, kind), text in PROMPT_TEMPLATES.items()]
    return spark.createDataFrame(rows, "family string, kind string, template string")


def chosen_kind(family: Column, kind: Column, profile: Column) -> Column:
    """The kind of prompt that is rendered: without a profile the family's template for that, where it has one."""
    bare = [f for f, k in PROMPT_TEMPLATES if k == "relevance_no_profile"]
    return F.when((kind == "relevance") & family.isin(*bare) & ~_has(profile), "relevance_no_profile").otherwise(kind)


def render_prompts(rows: DataFrame, values: dict[str, Column], family: str = "family", kind: str = "kind",
                   output: str = "prompt") -> DataFrame:
    """Fill the template named by the row's family and kind. The template table is a fixed dozen of rows.

    A relevance prompt whose ``profile`` is empty or not given is one that doesn't speak of a profile, if the family has one.
    """
    rows = rows.withColumn("_chosen", chosen_kind(F.col(family), F.col(kind), values.get("profile", F.lit(None))))
    templates = F.broadcast(template_table(rows.sparkSession)).select(
        F.col("family").alias("_family"), F.col("kind").alias("_kind"), F.col("template").alias("_template"))
    joined = rows.join(templates, (rows[family] == F.col("_family")) & (rows["_chosen"] == F.col("_kind")), "left")
    pieces = F.split(F.col("_template"), r"\{|\}")
    # odd pieces are placeholder names: filled in one pass, so braces inside the values stay as they are
    lookup = F.create_map(*[x for name, col in values.items() for x in (F.lit(name), F.coalesce(col, F.lit("")))])
    filled = F.array_join(F.transform(
        pieces, lambda p, i: F.when(i % 2 == 1, F.coalesce(F.try_element_at(lookup, p), F.lit(""))).otherwise(p)), "")
    return joined.withColumn(output, filled).drop("_family", "_kind", "_template", "_chosen")
