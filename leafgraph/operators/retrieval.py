"""Nearest-neighbour search for batches of questions, and what is built on it.

``questions`` has one row per question, ``vectors`` one row per document. Exact search is one path for any number of both
(:mod:`leafgraph.operators.nearest`): it compares blocks of questions with blocks of vectors where those lie, and only the k
best rows per question leave a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.functions import vectors as V
from leafgraph.functions.prompts import context_string
from leafgraph.functions.text import strip
from leafgraph.operators.nearest import DIGITS, search_blocks
from leafgraph.session import materialize


def nearest_lists(questions: DataFrame, vectors: DataFrame, lists: Sequence[Sequence[tuple[str, str]]],
                  k: int | Column = 5, metric: str = "cosine", question_id: str = "question_id",
                  doc_id: str = "doc_id", on: Sequence[tuple[str, str]] = (), keep: Sequence[str] = ()) -> DataFrame:
    """Several searches in one scan of the vectors: ``(list, question_id, *keep, rank, doc_id, distance)``.

    Each list names pairs of a question vector and a document vector whose distances are added. ``k`` may be a column
    of ``questions``. ``on`` pairs a question column with a document column that must be equal; null on the question's side
    asks for nothing. A question is told by its id and the columns in ``keep``.
    """
    if metric not in V.METRICS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(V.METRICS)}")
    pairs = list(dict.fromkeys(tuple(p) for one in lists for p in one))
    places = [[pairs.index(tuple(p)) for p in one] for one in lists]
    limit = F.lit(k) if isinstance(k, int) else k
    asked = questions.withColumns({"question_id": F.col(question_id).cast("long"), "_limit": limit.cast("int")})
    keys = ["question_id", *[c for c in keep if c != "question_id"]]
    found = search_blocks(asked, vectors, pairs, places, F.col("_limit"), metric, [*keys, "_limit"], doc_id, on)
    order = Window.partitionBy("list", *keys).orderBy(F.asc_nulls_last("distance"), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    # a constant lets Spark keep that many rows per question in each task
    return ranked.where(F.col("rank") <= (F.lit(k) if isinstance(k, int) else F.col("_limit"))).select(
        "list", *keys, "rank", "doc_id", "distance")


def nearest(questions: DataFrame, vectors: DataFrame, k: int | Column = 5, metric: str = "cosine",
            pairs: Sequence[tuple[str, str]] = (("vector", "embedding"),), question_id: str = "question_id",
            doc_id: str = "doc_id") -> DataFrame:
    """``(question_id, rank, doc_id, distance)``: the k nearest documents of every question, exactly."""
    return nearest_lists(questions, vectors, [pairs], k, metric, question_id, doc_id).drop("list")


def nearest_filtered(questions: DataFrame, vectors: DataFrame, on: Sequence[tuple[str, str]], k: int | Column = 5,
                     metric: str = "cosine", pair: tuple[str, str] = ("vector", "embedding"),
                     question_id: str = "question_id", doc_id: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    """The k nearest documents among those whose metadata equal the question's, where it asks for any."""
    return nearest_lists(questions, vectors, [[pair]], k, metric, question_id, doc_id, on, keep).drop("list")


def above_threshold(hits: DataFrame, threshold: float, metric: str = "cosine") -> DataFrame:
    """Hits with their relevance, those below ``threshold`` left out."""
    scored = hits.withColumn("relevance", V.relevance(F.col("distance"), metric))
    return scored.where(F.col("relevance") >= threshold) if threshold > 0 else scored


def long_enough(hits: DataFrame, min_chars: int = 100) -> DataFrame:
    """Hits whose text is long enough to answer from."""
    return hits.where(F.length("text") >= min_chars)


def fuse_min_score(*lists: DataFrame, key: str = "text", limit: int | None = None) -> DataFrame:
    """Merge hit lists: one hit per question and key with the fields of the first seen and the lowest distance.

    The merged list is not cut to k unless ``limit`` is given. A group holds at most one row per list and rank.
    """
    rows = lists[0].withColumn("list", F.lit(0))
    for n, df in enumerate(lists[1:], 1):
        rows = rows.unionByName(df.withColumn("list", F.lit(n)))
    return fuse_listed(rows, key, limit)


def fuse_listed(rows: DataFrame, key: str = "text", limit: int | None = None) -> DataFrame:
    """:func:`fuse_min_score` for hits that carry the number of their ``list``."""
    other = [c for c in rows.columns if c not in ("question_id", "distance", "rank", "list", key)]
    first = F.struct("list", "rank")
    merged = rows.groupBy("question_id", key).agg(
        F.min("distance").alias("distance"), F.min(first).alias("_first"),
        *[F.min_by(c, first).alias(c) for c in other])
    order = Window.partitionBy("question_id").orderBy(F.asc_nulls_last("distance"), "_first")
    ranked = merged.withColumn("rank", F.row_number().over(order)).drop("_first")
    return ranked.where(F.col("rank") <= limit) if limit else ranked


def nearest_two_columns(questions: DataFrame, vectors: DataFrame, k: int = 3, text: str = "text_embedding",
                        title: str = "title_embedding", vector: str = "vector", texts: DataFrame | None = None,
                        doc_id: str = "doc_id", key: str = "doc_id") -> DataFrame:
    """Search on the text and on the title vector in one scan, then fuse; up to 2k hits per question."""
    hits = nearest_lists(questions, vectors, [[(vector, text)], [(vector, title)]], k, doc_id=doc_id)
    return fuse_listed(hits if texts is None else hits.join(texts, "doc_id"), key)


def query_vectors(questions: DataFrame, d: int, embed, text: str = "query") -> DataFrame:
    """Query vectors for ``d`` concatenated embeddings: exactly d parts split at ``|``, else the whole text d times.

    ``embed`` maps a string Column to a vector Column.
    """
    parts = F.split(F.col(text), r"\|")
    texts = F.when(F.size(parts) == d, parts).otherwise(F.array_repeat(F.col(text), d))
    return questions.withColumn("vector", F.concat(*[embed(F.element_at(texts, n + 1)) for n in range(d)]))


# Order in which profile fields are given up (fixed values).
BACKOFF = (("specialization", "year"), ("program", "faculty"))
PROFILE = ("faculty", "program", "specialization", "year")


def backoff_levels(questions: DataFrame) -> DataFrame:
    """One row per question and level with the profile in force and the fields given up so far.

    A level that has nothing left to give up is skipped. An empty program, faculty or specialization filters for
    empty, so only a named specialization and the year leave the filter and join the query text.
    """
    none = F.array().cast("array<string>")
    profile = {c: F.coalesce(F.col(c), F.lit("")) for c in PROFILE}
    levels, dropped = [], none
    current = dict(profile)
    levels.append(F.struct(F.lit(0).alias("level"), none.alias("removed_keys"), F.lit(True).alias("runs"),
                           *[current[c].alias(c) for c in PROFILE]))
    for n, names in enumerate(BACKOFF, 1):
        gone = F.filter(F.array(*[F.when(profile[c] != "", F.lit(c)) for c in names]), lambda x: x.isNotNull())
        current = {c: F.lit("") if c in names else current[c] for c in PROFILE}
        dropped = F.concat(dropped, gone)
        levels.append(F.struct(F.lit(n).alias("level"), dropped.alias("removed_keys"), (F.size(gone) > 0).alias("runs"),
                               *[current[c].alias(c) for c in PROFILE]))
    rest = [c for c in questions.columns if c not in PROFILE]
    return questions.select(*rest, F.inline(F.array(*levels))).where("runs").drop("runs")


def level_texts(levels: DataFrame) -> DataFrame:
    """Add ``query``: what a level searches for. Profile fields that filter stay out of the text.

    An unset program, faculty or specialization filters for unset, so of the profile only a named specialization and the year
    are in the text, with topic and question.
    """
    extra = [F.col(c) if c in levels.columns else F.lit("") for c in ("topic", "question")]
    return levels.withColumn("query", context_string(F.col("specialization"), F.col("year"), *extra))


def search_levels(levels: DataFrame, docs: DataFrame, k: int | Column = 5, threshold: float = 0.0, min_chars: int = 100,
                  metric: str = "cosine", vector: str = "vector", embedding: str = "embedding") -> DataFrame:
    """Hits of every question and level whose metadata fit, that are relevant and long enough.

    Program and faculty have to be equal; documents of a specialization are left out where the question names none.
    """
    names = ("faculty", "program", "specialization")
    asked = levels.withColumn("_spec", F.when(F.col("specialization") == "", ""))
    filled = docs.withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in names})
    hits = nearest_filtered(asked, filled, on=(("program", "program"), ("faculty", "faculty"), ("_spec", "specialization")),
                            k=k, metric=metric, pair=(vector, embedding), keep=("level", "removed_keys"))
    hits = above_threshold(hits, threshold, metric).join(docs.select("doc_id", "text"), "doc_id")
    return long_enough(hits, min_chars)


def backoff_search(questions: DataFrame, docs: DataFrame, k: int = 5, threshold: float = 0.0, min_chars: int = 100,
                   metric: str = "cosine", answered: Callable[[DataFrame], DataFrame] | None = None,
                   embed: Callable[[DataFrame], DataFrame] | None = None, vector: str = "vector", embedding: str = "embedding",
                   stages: list[DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Search with the whole profile first, then with less of it; per question the first level that answers is kept.

    A stage evaluates one level, for the questions that no earlier one answered: ``embed`` adds the vector of the level's
    ``query`` (by default the question keeps its vector), the search filters by what is left of the profile, and ``answered``
    adds a boolean ``answered`` to the hits, whether the answer that they give is usable (by default any hit is). So models
    see only what is still open. Stages are written, so each runs once.

    ``docs`` brings ``doc_id, text, faculty, program, specialization`` and the vector. Returns the kept hits (with ``level``
    and ``removed_keys``) and the removed ones: hits of earlier levels that are not among the kept. ``stages``, if given,
    receives what each stage was asked: ``question_id, level, query, n_hits, answered``.
    """
    levels = materialize(level_texts(backoff_levels(questions)), "levels")
    found, closed = None, None
    for level in range(len(BACKOFF) + 1):
        frontier = levels.where(F.col("level") == level)
        if closed is not None:
            frontier = frontier.join(closed, "question_id", "left_anti")
        frontier = materialize(frontier if embed is None else embed(frontier), f"level-{level}")
        hits = search_levels(frontier, docs, k, threshold, min_chars, metric, vector, embedding)
        hits = materialize(hits.withColumn("answered", F.lit(True)) if answered is None else answered(hits), "level-hits")
        done = hits.where("answered").select("question_id").distinct()
        closed = done if closed is None else closed.union(done)
        found = hits if found is None else found.unionByName(hits)
        if stages is not None:
            counts = hits.groupBy("question_id").agg(F.count("*").alias("n_hits"), F.max("answered").alias("answered"))
            stages.append(frontier.select("question_id", "level", "query").join(counts, "question_id", "left").fillna(
                {"n_hits": 0, "answered": False}))
    # a question has at most k hits on each level
    chosen = F.min(F.when(F.col("answered"), F.col("level"))).over(Window.partitionBy("question_id"))
    flagged = found.withColumn("_chosen", chosen).withColumn(
        "_kept", F.coalesce(F.col("level") == F.col("_chosen"), F.lit(False)))
    flagged = flagged.withColumn("_again", F.max("_kept").over(Window.partitionBy("question_id", "doc_id")))
    extra = ("_chosen", "_kept", "_again", "answered")
    return flagged.where("_kept").drop(*extra), flagged.where("NOT _kept AND NOT _again").drop(*extra)


def exclude_kept(removed: DataFrame, kept: DataFrame) -> DataFrame:
    return removed.join(kept.select("question_id", "doc_id"), ["question_id", "doc_id"], "left_anti")


def start_docs(questions: DataFrame, docs: DataFrame, searched: DataFrame) -> DataFrame:
    """Questions that name a start document get that document; the others keep their search result."""
    direct = (questions.where(F.col("start_doc").isNotNull())
              .select("question_id", F.col("start_doc").alias("doc_id")).join(docs.select("doc_id"), "doc_id")
              .select("question_id", F.lit(1).alias("rank"), "doc_id", F.lit(None).cast("double").alias("distance")))
    search = searched.join(questions.where(F.col("start_doc").isNotNull()).select("question_id"), "question_id",
                           "left_anti").select("question_id", "rank", "doc_id", "distance")
    return direct.unionByName(search)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that were found, per question."""
    hit = found.select("question_id", "doc_id", F.lit(1).alias("_hit"))
    return (exact.join(hit, ["question_id", "doc_id"], "left").groupBy("question_id")
            .agg((F.count("_hit") / F.count("*")).alias("recall")))


def blank_to_zero(text: Column, vec: Column, dim: int) -> Column:
    """Zero vector for a blank text; it stays in the table and sorts last."""
    return F.when(F.coalesce(strip(text), F.lit("")) == "", F.array_repeat(F.lit(0.0), dim)).otherwise(vec)
