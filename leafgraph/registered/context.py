"""Context assembly, relevance and answers.

The hits of the label questions (see ``search``) carry the text of their document. Where a question has words, it is the first
user turn of a conversation, and its vector the one with the conversation's number. ``labels.quality`` plays the relevance
verdict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.functions import models as M
from leafgraph.functions import prompts as P
from leafgraph.functions import text as X
from leafgraph.operators import context as K
from leafgraph.operators import retrieval as R
from leafgraph.plans.answering import answer_questions
from leafgraph.registered.base import Tables, query, sql_strip
from leafgraph.registered.chunks import documents, sql_sentences
from leafgraph.registered.search import E, Q, both_vectors, cos, questions, ranked, vectors


def hits(t: Tables, k: int = 40) -> DataFrame:
    found = R.nearest(questions(t), vectors(t), k)
    return found.join(t.documents.select("doc_id", "text"), "doc_id")


def _hits(k: int = 40) -> str:
    return f"""{Q}, {E}, h AS (SELECT question_id, rank, doc_id, distance, text
    FROM ({ranked(cos('vector', 'v'), str(k))}) JOIN documents USING (doc_id))"""


HITS = _hits()


def asked(t: Tables) -> DataFrame:
    """``(question_id, question)``: the first user turn of every conversation."""
    return t.conversations.where(F.col("role") == "user").groupBy(F.col("conv_id").alias("question_id")).agg(
        F.min_by("text", "turn").alias("question"))


ASKED = """a AS (SELECT conv_id AS question_id, arg_min(text, turn) AS question FROM conversations WHERE role = 'user'
    GROUP BY conv_id)"""


def turns(t: Tables) -> DataFrame:
    """The first user turns with their vectors."""
    own = t.embeddings.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    return asked(t).join(own, "question_id")


def turn_hits(t: Tables, k: int = 5) -> DataFrame:
    qs = turns(t)
    found = R.nearest(qs, vectors(t), k).join(t.documents.select("doc_id", "text"), "doc_id")
    return found.join(qs.select("question_id", "question"), "question_id")


TURNS = f"""{ASKED}, q AS (SELECT conv_id AS question_id, embedding::DOUBLE[] AS vector FROM (SELECT DISTINCT conv_id FROM conversations
      WHERE role = 'user') JOIN embeddings ON vec_id = conv_id)"""
TURN_HITS = f"""{TURNS}, {E}, h AS (SELECT question_id, rank, doc_id, text, question
    FROM ({ranked(cos('vector', 'v'), '5')}) JOIN documents USING (doc_id) JOIN a USING (question_id))"""


@query("a3_format_context", f"""WITH {HITS} SELECT question_id, string_agg('Document ' || i || E':\\n' || text, E'\\n'
    ORDER BY i) AS context FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS i FROM h)
    GROUP BY question_id""")
def a3(t: Tables) -> DataFrame:
    return K.format_context(hits(t))


@query("w1_context_budget", f"""WITH {HITS}, i AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank)
      AS n FROM h),
    u AS (SELECT *, (sum(length('Document ' || n || E':\\n' || text)) OVER (PARTITION BY question_id ORDER BY n) + n - 1)
      ::BIGINT AS used_chars FROM i), k AS (SELECT *, used_chars <= 25000 AS kept FROM u)
    SELECT question_id, rank, doc_id, used_chars, kept, CASE WHEN NOT kept THEN row_number() OVER (
      PARTITION BY question_id, kept ORDER BY rank DESC) END::INTEGER AS removed_order FROM k""")
def w1(t: Tables) -> DataFrame:
    return K.context_budget(hits(t)).select("question_id", "rank", "doc_id", "used_chars", "kept", "removed_order")


@query("w2_token_budget_retry", rf"""WITH RECURSIVE {HITS}, i AS (SELECT question_id, rank, doc_id, len(list_filter(
      regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n, row_number() OVER (PARTITION BY question_id
      ORDER BY rank) AS o FROM h),
    f AS (SELECT question_id, o, 50 + n AS used, 0 AS b FROM i WHERE o = 1 UNION ALL
      SELECT i.question_id, i.o, CASE WHEN f.used + i.n > 750 THEN 50 + i.n ELSE f.used + i.n END,
        f.b + CASE WHEN f.used + i.n > 750 THEN 1 ELSE 0 END
      FROM f JOIN i ON i.question_id = f.question_id AND i.o = f.o + 1)
    SELECT question_id, rank, doc_id, b::INTEGER AS bucket_no FROM f JOIN i USING (question_id, o)""")
def w2(t: Tables) -> DataFrame:
    return K.token_buckets(hits(t), 750, overhead=50).select("question_id", "rank", "doc_id", "bucket_no")


@query("w2_first_answer", rf"""WITH RECURSIVE {HITS}, i AS (SELECT question_id, rank, text, len(list_filter(
      regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n, row_number() OVER (PARTITION BY question_id
      ORDER BY rank) AS o FROM h),
    f AS (SELECT question_id, o, 50 + n AS used, 0 AS b FROM i WHERE o = 1 UNION ALL
      SELECT i.question_id, i.o, CASE WHEN f.used + i.n > 750 THEN 50 + i.n ELSE f.used + i.n END,
        f.b + CASE WHEN f.used + i.n > 750 THEN 1 ELSE 0 END
      FROM f JOIN i ON i.question_id = f.question_id AND i.o = f.o + 1),
    best AS (SELECT question_id, b, arg_min(text, rank) AS best FROM f JOIN i USING (question_id, o) GROUP BY question_id, b),
    said AS (SELECT question_id, b, ({sql_sentences('best')})[1] AS answer, length(best) >= 1500 AS long FROM best),
    usable AS (SELECT question_id, b, CASE WHEN long AND answer IS NOT NULL AND answer <> '' AND NOT contains(answer,
      '{X.NO_ANSWER}') THEN answer END AS answer FROM said)
    SELECT question_id, arg_min(answer, b) FILTER (answer IS NOT NULL) AS answer, min(b) FILTER (answer IS NOT NULL)::INTEGER
      AS bucket_no FROM usable GROUP BY question_id""")
def w2_answer(t: Tables) -> DataFrame:
    """The retry over buckets: a bucket answers when its first text is long; the first that does wins."""
    buckets = K.token_buckets(hits(t), 750, overhead=50).groupBy("question_id", "bucket_no").agg(
        F.min_by("text", "rank").alias("best"))
    replies = buckets.withColumn("answer", F.when(F.length("best") >= 1500, M.first_sentence(F.col("best")))
                                 .otherwise(X.NO_ANSWER))
    return K.first_answer(replies)


@query("f2_min_length", f"WITH {HITS} SELECT question_id, doc_id FROM h WHERE length(text) >= 500")
def f2(t: Tables) -> DataFrame:
    return R.long_enough(hits(t), 500).select("question_id", "doc_id")


VERDICT = """CASE quality WHEN 1 THEN 'Yes, because it is good' WHEN 0 THEN 'no, because it is not a yes' ELSE 'maybe' END"""


@query("f3_relevance_partition", f"""WITH {HITS} SELECT question_id, doc_id, coalesce(quality, 0) = 1 AS keep,
    {VERDICT} AS keep_reason FROM h LEFT JOIN labels USING (doc_id)""")
def f3(t: Tables) -> DataFrame:
    reply = F.when(F.col("quality") == 1, "Yes, because it is good").when(
        F.col("quality") == 0, "no, because it is not a yes").otherwise("maybe")
    judged = hits(t).join(t.labels, "doc_id", "left").withColumn("reply", reply)
    return K.relevance_partition(judged).select("question_id", "doc_id", "keep", "keep_reason")


FAMILIES = ("header_tokens", "plain", "default", "vicuna", "span")
KINDS = ("answer", "relevance", "spelling")


def _render_sql() -> str:
    """The templates as SQL literals; values are put in with a single pass each, in an order free of clashes."""
    cases = []
    for (family, kind), template in P.PROMPT_TEMPLATES.items():
        text = "'" + template.replace("'", "''") + "'"
        for name, value in (("{system}", f"'{P.RELEVANCE_SYSTEM.replace(chr(39), chr(39) * 2)}'"), ("{separator}", "''"),
                            ("{profile}", "profile")):
            text = f"replace({text}, '{name}', {value})"
        when = f"family = '{family}' AND kind = '{kind}'"
        if kind == "relevance_no_profile":
            when = f"family = '{family}' AND kind = 'relevance' AND profile = ''"
        elif (family, "relevance_no_profile") in P.PROMPT_TEMPLATES and kind == "relevance":
            when += " AND profile <> ''"
        cases.append(f"WHEN {when} THEN replace(replace({text}, '{{question}}', chr(3)), '{{context}}', chr(4))")
    return ("replace(replace(CASE " + " ".join(cases) + " END, chr(3), coalesce(question, '')), chr(4), text)")


@query("f19_render_prompt", f"""WITH {TURN_HITS}, r AS (SELECT h.*, family, kind,
      CASE WHEN question_id % 2 = 0 THEN 'all programs' ELSE '' END AS profile FROM h,
      (SELECT unnest({list(FAMILIES)}) AS family), (SELECT unnest({list(KINDS)}) AS kind)),
    p AS (SELECT question_id, doc_id, family, kind, {_render_sql()} AS prompt FROM r)
    SELECT question_id, doc_id, family, kind, md5(prompt) AS prompt FROM p WHERE prompt IS NOT NULL""")
def f19(t: Tables) -> DataFrame:
    """Every family and kind for every hit of every question; every second question has no profile."""
    rows = turn_hits(t).withColumns({"family": F.explode(F.array(*map(F.lit, FAMILIES)))}).withColumn(
        "kind", F.explode(F.array(*map(F.lit, KINDS))))
    profile = F.when(F.col("question_id") % 2 == 0, "all programs").otherwise("")
    done = P.render_prompts(rows, {"system": F.lit(P.RELEVANCE_SYSTEM), "question": F.col("question"),
                                   "context": F.col("text"), "profile": profile})
    return done.where("prompt <> ''").select("question_id", "doc_id", "family", "kind", F.md5("prompt").alias("prompt"))


def sql_words(e: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower({e}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> ''))"


def sql_overlap(q: str, e: str) -> str:
    return (f"CASE WHEN len({sql_words(q)}) = 0 THEN 0.0 ELSE len(list_intersect({sql_words(q)}, {sql_words(e)}))"
            f"::DOUBLE / len({sql_words(q)}) END")


@query("u3_judge_relevance", f"""WITH {TURN_HITS}, o AS (SELECT question_id, doc_id, {sql_overlap('question', 'text')}
      AS share FROM h)
    SELECT question_id, doc_id, CASE WHEN share >= 0.3 THEN 'YES' ELSE 'NO' END || ', because ' ||
      floor(share * 100 + 1e-9)::INTEGER || '% of the question''s words occur.' AS reply FROM o""")
def u3(t: Tables) -> DataFrame:
    return M.judge_relevance(turn_hits(t), threshold=0.3).select("question_id", "doc_id", "reply")


@query("u5_compress_docs", f"""WITH {TURN_HITS}, s AS (SELECT question_id, doc_id, question,
      {sql_sentences('text')} AS a FROM h)
    SELECT question_id, doc_id, coalesce(array_to_string(list_filter(a, lambda x: {sql_overlap('question', 'x')
      .replace('lambda w', 'lambda w')} >= 0.2), E'\\n'), '') AS compressed FROM s""")
def u5(t: Tables) -> DataFrame:
    return turn_hits(t).select("question_id", "doc_id", M.compress(F.col("question"), F.col("text"), 0.2).alias("compressed"))


@query("u2_embed", f"""SELECT doc_id, 256::INTEGER AS dim, CASE WHEN {sql_strip('text')} = '' THEN 0.0 ELSE 1.0 END::DOUBLE
    AS norm FROM documents""")
def u2(t: Tables) -> DataFrame:
    """The contract of the default embedding: dimension and unit norm."""
    rows = M.embed(documents(t), dim=256)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("doc_id", F.size("embedding").alias("dim"), F.round(norm, 6).alias("norm"))


def sql_embedded(name: str, source: str, id: str, dim: int) -> str:
    """CTEs ``name`` (id, b, x): the non-zero components of the default embedding of ``source(id, text)``."""
    word = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda w: w <> '')"
    return f"""{name}_n AS (SELECT id, ('0x' || substr(md5(w), 1, 8))::BIGINT % {dim} AS b, count(*)::DOUBLE AS n
      FROM (SELECT {id} AS id, unnest({word}) AS w FROM {source}) GROUP BY 1, 2),
    {name} AS (SELECT id, b, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS x FROM {name}_n)"""


@query("u2_embed_search", f"""WITH {ASKED}, {sql_embedded('d', 'documents', 'doc_id', 128)},
    {sql_embedded('e', '(SELECT question_id, question AS text FROM a)', 'question_id', 128)},
    s AS (SELECT e.id AS question_id, d.id AS doc_id, sum(e.x * d.x) AS c FROM e JOIN d USING (b) GROUP BY ALL),
    z AS (SELECT x.id AS question_id, y.id AS doc_id, round(1 - coalesce(c, 0), 9) AS distance
      FROM (SELECT DISTINCT id FROM e) x CROSS JOIN (SELECT DISTINCT id FROM d) y
      LEFT JOIN s ON s.question_id = x.id AND s.doc_id = y.id)
    SELECT question_id, rank, doc_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (
      PARTITION BY question_id ORDER BY distance, doc_id)::INTEGER AS rank FROM z) WHERE rank <= 3""")
def u2_search(t: Tables) -> DataFrame:
    """Embedded first user turns search the embedded documents."""
    docs = M.embed(documents(t), dim=128)
    qs = M.embed(asked(t), text="question", output="vector", dim=128)
    return R.nearest(qs, docs, 3).select("question_id", "rank", "doc_id", F.round("distance", 6).alias("distance"))


def answered(t: Tables) -> tuple[DataFrame, DataFrame]:
    qs = turns(t).withColumns({
        "faculty": F.lit("Science"), "program": F.lit(""), "specialization": F.lit(""), "year": F.lit("second year"),
        "topic": F.lit("courses")})
    texts = t.documents.select("doc_id", "text", F.concat(F.lit("https://d.example/"), F.col("doc_id").cast("string"))
                               .alias("url"), F.array("source").alias("titles"),
                               F.array().cast("array<string>").alias("links"))
    return answer_questions(qs, both_vectors(t).join(texts, "doc_id"), k=3)


ANSWERED = f"""{TURNS}, e AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v,
      list_reverse(embedding::DOUBLE[]) AS w, text FROM embeddings JOIN documents ON vec_id = doc_id),
    both_lists AS (SELECT 0 AS src, * FROM ({ranked(cos('vector', 'v'), '3')}) UNION ALL
      SELECT 1, * FROM ({ranked(cos('vector', 'w'), '3')})),
    fu AS (SELECT question_id, text, min(distance) AS distance, arg_min(doc_id, src * 1000000 + rank) AS doc_id,
      min(src * 1000000 + rank) AS seen FROM both_lists JOIN documents USING (doc_id) GROUP BY question_id, text),
    ra AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, seen)::INTEGER AS rank FROM fu),
    us AS (SELECT *, sum(length('Document ' || rank || E':\\n' || text)) OVER (PARTITION BY question_id ORDER BY rank)
      + rank - 1 AS used FROM ra)"""


@query("u4_generate_answer", f"""WITH {ANSWERED}
    SELECT question_id, question, 'Science : second year : courses' AS context,
      ({sql_sentences('arg_min(text, rank) FILTER (used <= 25000)')})[1] AS answer,
      string_agg(doc_id::VARCHAR, ',' ORDER BY rank) FILTER (used <= 25000) AS reference_ids
    FROM us JOIN a USING (question_id) GROUP BY question_id, question""")
def u4(t: Tables) -> DataFrame:
    """The whole answer flow: two searches, fusion, budget, prompt, answer, question log row."""
    answers, _ = answered(t)
    return answers.withColumn("reference_ids", F.array_join(F.col("reference_ids").cast("array<string>"), ","))


@query("u4_answer_documents", f"""WITH {ANSWERED}, o AS (SELECT question_id, rank, doc_id, used <= 25000 AS kept,
      {sql_overlap("('I am in Science. I am in my second year. The topic of the question is courses. ' || question)", 'text')} AS share
      FROM us JOIN a USING (question_id))
    SELECT question_id, rank, doc_id, kept, CASE WHEN share >= 0.5 THEN 'YES' ELSE 'NO' END || ', because ' ||
      floor(share * 100 + 1e-9)::INTEGER || '% of the question''s words occur.' AS relate FROM o""")
def u4_documents(t: Tables) -> DataFrame:
    """The documents behind the answers with their relevance replies."""
    _, documents = answered(t)
    return documents.select("question_id", "rank", "doc_id", "kept", "relate")
