"""Questions to answers, for a whole batch of questions in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.functions import prompts as P
from leafgraph.functions.models import check_question, generate_answers, judge_relevance
from leafgraph.operators.context import context_budget, format_context
from leafgraph.operators.retrieval import nearest_two_columns


def answer_questions(questions: DataFrame, vectors: DataFrame, k: int = 3, max_chars: int = 25_000,
                     answer_model=None, judge_model=None, family: str = "plain") -> tuple[DataFrame, DataFrame]:
    """``(answers, documents)``.

    ``questions`` brings ``question_id, question, vector`` and the profile columns; ``vectors`` is the vector table.
    Answers carry what the question log records; documents carry the relevance reply of every kept and removed hit.
    """
    asked, _ = check_question(F.col("question"), F.lit(k))
    profile = [F.col(c) for c in ("faculty", "program", "specialization", "year", "topic")]
    qs = questions.withColumns({"sentence": P.question_sentence(*profile, asked),
                                "profile": P.context_string(*profile)})
    texts = vectors.select("doc_id", "url", "titles", "text", "links")
    hits = nearest_two_columns(qs, vectors, k, texts=texts, key="text")
    hits = context_budget(hits, max_chars)
    contexts = format_context(
        hits.where("kept"), best_text=F.min_by("text", "rank"),
        reference_ids=F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id"))), lambda x: x["doc_id"]))
    rows = qs.select("question_id", "question", "sentence", "profile").join(contexts, "question_id", "left")
    rows = rows.withColumns({"family": F.lit(family), "kind": F.lit("answer")})
    rows = P.render_prompts(rows, {"system": F.lit(P.ANSWER_SYSTEM), "question": F.col("sentence"),
                                   "context": F.col("context"), "profile": F.col("profile")})
    answers = generate_answers(rows, model_factory=answer_model).select(
        "question_id", "question", F.col("profile").alias("context"), "answer", "reference_ids")
    judged = hits.join(qs.select("question_id", "sentence", "profile"), "question_id")
    judged = judged.withColumns({"family": F.lit(family), "kind": F.lit("relevance")})
    judged = P.render_prompts(judged, {"system": F.lit(P.RELEVANCE_SYSTEM), "question": F.col("sentence"),
                                       "context": F.col("text"), "profile": F.col("profile")})
    documents = judge_relevance(judged, "sentence", "text", "relate", judge_model, "prompt")
    return answers, documents.select("question_id", "rank", "doc_id", "url", "titles", "text", "links", "kept",
                                     "removed_order", "relate")
