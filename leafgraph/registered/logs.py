"""Question log, feedback, update log and refresh, as batch and as stream.

``conversations`` gives questions with answers, ``events`` gives feedback payloads and updates, ``pages`` the page
files of the refresh. Streams read JSON or parquet files that Spark writes from those tables into the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.functions.registry import register
from leafgraph.operators import interactions as I
from leafgraph.operators.parse import SiteConfig
from leafgraph.registered.base import Tables, query, sql_squeeze, squeeze
from leafgraph.registered.pages import _H1, _REST, sql_text
from leafgraph.session import work_dir
from leafgraph.sources.store import append_update, export_interactions, read_updates
from leafgraph.streaming.interactions import log_feedback, log_questions
from leafgraph.streaming.refresh import apply_batch, current_corpus, refresh_pages

PAIRS = """p AS (SELECT conv_id, turn, role, text AS question, lead(role) OVER w AS next_role, lead(text) OVER w AS answer
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  qa AS (SELECT conv_id, turn, question, answer FROM p WHERE role = 'user' AND next_role = 'assistant')"""


@query("w6_qa_pairs", f"WITH {PAIRS} SELECT * FROM qa")
def w6(t: Tables) -> DataFrame:
    return I.qa_pairs(t.conversations)


def question_payloads(t: Tables) -> list[DataFrame]:
    """JSON lines in three batches.

    First every event of an even conversation, twice, as a restarted sender would leave them, and broken lines; then all events
    with another answer, those of odd conversations late; then events without an id, twice.
    """
    def lines(answer, at: str, event_id=F.format_string("%d-%d", "conv_id", "turn")):
        row = F.struct(event_id.alias("event_id"), "question", F.lit("Science").alias("context"), answer.alias("answer"),
                       F.array(F.col("conv_id"), F.col("turn")).alias("reference_ids"), F.lit(at).alias("logged_at"))
        return I.qa_pairs(t.conversations).select("conv_id", F.to_json(row).alias("value"))
    twice = F.explode(F.array("value", "value"))
    first = lines(F.col("answer"), "2024-01-01T00:00:00Z").where("conv_id % 2 = 0").select(twice.alias("value"))
    broken = t.conversations.where("conv_id % 5 = 0").groupBy("conv_id").agg(
        F.concat(F.lit('{"event_id": "'), F.col("conv_id").cast("string"), F.lit('", "ques')).alias("value"))
    late = lines(F.concat("answer", F.lit(" (again)")), "2020-02-02T00:00:00Z")
    nameless = lines(F.col("answer"), "2024-01-03T00:00:00Z", F.lit(None).cast("string")).where("conv_id % 3 = 0")
    return [first.union(broken.select("value")), late.select("value"), nameless.select(twice.alias("value"))]


@query("r1_log_questions", f"""WITH {PAIRS},
    e AS (SELECT *, conv_id || '-' || turn AS id, conv_id || ',' || turn AS refs FROM qa)
    SELECT 'logged' AS kind, id AS event_id, question, CASE WHEN conv_id % 2 = 0 THEN answer ELSE answer || ' (again)' END AS answer,
      refs AS reference_ids, CASE WHEN conv_id % 2 = 0 THEN '2024-01-01' ELSE '2020-02-02' END AS day FROM e UNION ALL
    SELECT 'logged', NULL, question, answer, refs, '2024-01-03' FROM e, range(2) WHERE conv_id % 3 = 0 UNION ALL
    SELECT DISTINCT 'rejected', NULL, NULL, '{{"event_id": "' || conv_id || '", "ques', NULL, NULL FROM conversations
      WHERE conv_id % 5 = 0""")
def r1(t: Tables) -> DataFrame:
    """Runs the stream after each batch of lines, and once more without any, and reads log and rejects."""
    base = work_dir(t.spark, "question-log")
    for lines in question_payloads(t):
        lines.write.mode("append").text(f"{base}/in")
        log_questions(t.spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", f"{base}/rejects")
    log_questions(t.spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", f"{base}/rejects")
    logged = t.spark.read.parquet(f"{base}/out").select(
        F.lit("logged").alias("kind"), "event_id", "question", "answer",
        F.array_join(F.col("reference_ids").cast("array<string>"), ",").alias("reference_ids"),
        F.date_format("logged_at", "yyyy-MM-dd").alias("day"))
    return logged.unionByName(t.spark.read.parquet(f"{base}/rejects").select(
        F.lit("rejected").alias("kind"), "event_id", F.col("payload").alias("answer")), allowMissingColumns=True)


def feedback_payloads(t: Tables) -> DataFrame:
    """``props`` carries the reference number; error events send an unusable one."""
    row = F.struct(
        F.col("event_id").cast("string").alias("event_id"),
        F.when(F.col("event_type").isin("purchase", "signup"), "yes").otherwise("Yes!").alias("feedback-hidden-helpful"),
        F.concat(F.lit("about "), "event_type").alias("feedback-hidden-question"),
        F.lit("").alias("feedback-hidden-context"),
        F.concat(F.col("user_id").cast("string"), F.lit(","), F.col("event_id").cast("string"), F.lit(","))
        .alias("feedback-hidden-reference-ids"),
        F.lit("an answer").alias("feedback-hidden-response"),
        F.when(F.col("event_type") == "error", "n/a").otherwise(F.get_json_object("props", "$.k"))
        .alias("feedback-reference-select"),
        F.lit("").alias("feedback-comments"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("logged_at"))
    return t.events.select(F.to_json(row).alias("value"))


FEEDBACK = """SELECT event_id::VARCHAR AS event_id, event_type IN ('purchase', 'signup') AS helpful_response,
    'about ' || event_type AS question, user_id || ',' || event_id AS doc_ids,
    json_extract_string(props, '$.k')::INTEGER AS most_relevant_doc FROM events WHERE event_type <> 'error'"""


def _feedback(rows: DataFrame) -> DataFrame:
    return rows.select("event_id", "helpful_response", "question", F.array_join(
        F.col("retrieved_doc_ids").cast("array<string>"), ",").alias("doc_ids"), "most_relevant_doc")


@query("r2_log_feedback", FEEDBACK)
def r2(t: Tables) -> DataFrame:
    accepted, _ = I.split_feedback(I.parse_feedback(feedback_payloads(t)))
    return _feedback(accepted)


@query("r2_feedback_rejects", "SELECT event_id::VARCHAR AS event_id FROM events WHERE event_type = 'error'")
def r2_rejects(t: Tables) -> DataFrame:
    _, rejected = I.split_feedback(I.parse_feedback(feedback_payloads(t)))
    return rejected.select("event_id")


@query("r2_log_feedback_stream", FEEDBACK)
def r2_stream(t: Tables) -> DataFrame:
    """All events come again in a second batch, under another question."""
    base = work_dir(t.spark, "feedback")
    again = feedback_payloads(t).select(F.replace("value", F.lit("about "), F.lit("again about ")).alias("value"))
    for lines in (feedback_payloads(t), again):
        lines.write.mode("append").text(f"{base}/in")
        log_feedback(t.spark, f"{base}/in", f"{base}/out", f"{base}/rejects", f"{base}/checkpoint")
    return _feedback(t.spark.read.parquet(f"{base}/out"))


def tree_path(number):
    """Page 123 lies at 1/12/123, so that folders have pages."""
    digits = number.cast("string")
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(digits)), lambda n: F.substring(digits, F.lit(1), n)), "/")


def first_title(parent_titles, titles) -> dict:
    """A metadata rule of our own: the page at the top is the faculty."""
    return {"faculty": F.try_element_at(parent_titles, F.lit(1))}


TREE = SiteConfig(name="tree", base_url="https://tree.example", main_content_attrs={"name": "article"},
                  metadata_extractor="first_title", max_extract_len=1 << 20)


def tree_pages(t: Tables) -> list[DataFrame]:
    """Three batches. First four of five pages; then every third of these with a new title, and all others unchanged; then
    the fifth pages, and old versions of the third ones, which are too late."""
    register("metadata", "first_title", first_title)
    link = F.concat(F.lit('<p><a href="/'), tree_path(F.col("page_id") + 1), F.lit('.html">next</a></p></article>'))
    pages = t.pages.select(
        "page_id", F.concat(F.lit("https://tree.example/"), tree_path(F.col("page_id"))).alias("url"),
        F.replace("html", F.lit("</article>"), link).alias("html"))
    dated = lambda rows, day: rows.withColumn("last_modified", F.lit(day).cast("timestamp"))
    titled = lambda rows, word: rows.withColumn("html", F.replace("html", F.lit("<h1>"), F.lit(f"<h1>{word} ")))
    early, third = pages.where("page_id % 5 <> 4"), pages.where("page_id % 3 = 0 AND page_id % 5 <> 4")
    return [dated(early, "2024-01-02"),
            dated(titled(third, "New"), "2024-01-03").union(dated(early.where("page_id % 3 <> 0"), "2024-01-02")),
            dated(pages.where("page_id % 5 = 4"), "2024-01-02").union(dated(titled(third, "Old"), "2024-01-01"))]


TREE_SQL = f"""x AS (SELECT page_id, page_id::VARCHAR AS s, CASE WHEN page_id % 3 = 0 AND page_id % 5 <> 4 THEN 'New ' ELSE '' END
      || {sql_text(_H1)} AS title, {sql_squeeze(f"regexp_replace({sql_text(_REST)}, '#+', '', 'g')")} || ' next' AS body FROM pages),
    up AS (SELECT page_id, unnest(range(1, length(s) + 1)) AS n, s FROM x),
    chain AS (SELECT up.page_id, string_agg(a.title, ' > ' ORDER BY n) AS parent_titles, arg_min(a.title, n) AS faculty
      FROM up JOIN x a ON a.s = substring(up.s, 1, n) GROUP BY up.page_id)"""


@query("r3_refresh_pages", f"""WITH {TREE_SQL}
    SELECT x.page_id, CASE WHEN x.page_id >= 10 THEN x.page_id // 10 END AS parent_page, parent_titles, faculty,
      x.title AS path, x.body, y.page_id AS linked_page
    FROM x JOIN chain ON chain.page_id = x.page_id LEFT JOIN x y ON y.page_id = x.page_id + 1""")
def r3(t: Tables) -> DataFrame:
    """Extracts, their place in the tree and their links after three batches."""
    base, batches = work_dir(t.spark, "refresh"), tree_pages(t)
    for batch in batches:
        batch.write.mode("append").parquet(f"{base}/in")
        refresh_pages(t.spark, f"{base}/in", f"{base}/corpus", f"{base}/checkpoint", TREE, f"{base}/updates")
    rows = current_corpus(t.spark, f"{base}/corpus", TREE).extracts.where("page_id IS NOT NULL")
    at = rows.select("doc_id", F.col("page_id").alias("at"))
    up = at.select(F.col("doc_id").alias("parent"), F.col("at").alias("parent_page"))
    out = at.select(F.col("doc_id").alias("linked"), F.col("at").alias("linked_page"))
    return (rows.withColumn("linked", F.try_element_at("links", F.lit(1))["doc_id"]).join(up, "parent", "left")
            .join(out, "linked", "left").select(
                "page_id", "parent_page", F.array_join(F.transform("parent_titles", squeeze), " > ").alias("parent_titles"),
                squeeze(F.col("faculty")).alias("faculty"), squeeze(F.array_join("titles", " / ")).alias("path"),
                squeeze(F.col("text")).alias("body"), "linked_page"))


@query("r3_refresh_edges", """SELECT CASE WHEN page_id >= 10 THEN page_id // 10 END AS src, page_id AS dst, 1::INTEGER AS type
      FROM pages UNION ALL
    SELECT a.page_id, b.page_id, 3 FROM pages a JOIN pages b ON b.page_id = a.page_id + 1""")
def r3_edges(t: Tables) -> DataFrame:
    """The graph after the same batches, by page."""
    base = work_dir(t.spark, "refresh")
    for n, batch in enumerate(tree_pages(t)):
        apply_batch(t.spark, batch, f"{base}/corpus", n, TREE)
    corpus = current_corpus(t.spark, f"{base}/corpus", TREE)
    at = corpus.extracts.select("doc_id", "page_id")
    src, dst = (at.select(F.col("doc_id").alias(c), F.col("page_id").alias(f"{c}_page")) for c in ("src", "dst"))
    return corpus.edges.join(src, "src").join(dst, "dst").select(F.col("src_page").alias("src"), F.col("dst_page").alias("dst"), "type")


@query("r4_record_update", """SELECT event_type, strftime(max(ts), '%m/%d/%Y, %H:%M:%S (UTC)') AS last_updated FROM events
    GROUP BY event_type""")
def r4(t: Tables) -> DataFrame:
    """One load per kind of event is recorded, at the time of its last event; what the log holds is read back."""
    base = work_dir(t.spark, "updates")
    kinds = t.events.groupBy("event_type").agg(F.max("ts").alias("at"), F.max("event_id").alias("id"))
    for row in kinds.select("id", F.col("at").cast("string").alias("at")).collect():  # one row per kind of event
        append_update(t.spark, base, row["id"], F.lit(row["at"]).cast("timestamp"))
    log = read_updates(t.spark, base).join(kinds.select("id", "event_type"), "id")
    return log.select("event_type", F.concat(F.date_format("datetime", "MM/dd/yyyy, HH:mm:ss"), F.lit(" (UTC)"))
                      .alias("last_updated"))


@query("w5_last_update", """SELECT strftime(arg_max(ts, event_id), '%m/%d/%Y, %H:%M:%S (UTC)') AS last_updated FROM events""")
def w5(t: Tables) -> DataFrame:
    return I.last_update(t.events, id="event_id", at="ts")


@query("a5_load_audit", """SELECT count(*) AS n_rows, count(*) FILTER (text IS NULL) AS n_null,
    count(*) FILTER (trim(text) = '') AS n_blank, coalesce(sum(length(text)), 0)::BIGINT AS n_chars
    FROM (SELECT CASE WHEN lang <> 'de' THEN text END AS text FROM documents)""")
def a5(t: Tables) -> DataFrame:
    """German texts count as missing."""
    return I.load_audit(t.documents.select(F.when(F.col("lang") != "de", F.col("text")).alias("text")))


@query("a5_observed_load", """SELECT count(*) AS n_rows, count(*) FILTER (text IS NULL) AS n_null,
    count(*) FILTER (trim(text) = '') AS n_blank, coalesce(sum(length(text)), 0)::BIGINT AS n_chars, count(*) AS n_stored
    FROM (SELECT CASE WHEN lang <> 'de' THEN text END AS text FROM documents)""")
def a5_observed(t: Tables) -> DataFrame:
    """The same counts, taken while the rows are written."""
    base = work_dir(t.spark, "load")
    rows = t.documents.select("doc_id", F.when(F.col("lang") != "de", F.col("text")).alias("text"))
    audit = I.observed(rows, lambda df: df.write.parquet(base))
    return audit.withColumn("n_stored", t.spark.read.parquet(base).agg(F.count("*").alias("n")).scalar())


@query("s11_export_interactions", f"""WITH {PAIRS} SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, question,
    conv_id || ',' || turn AS reference_ids FROM qa""")
def s11(t: Tables) -> DataFrame:
    """The export is read back; it has no header."""
    base = work_dir(t.spark, "export")
    log = I.qa_pairs(t.conversations).select("conv_id", "turn", "question", F.array("conv_id", "turn").alias("reference_ids"))
    accepted, _ = I.split_feedback(I.parse_feedback(feedback_payloads(t)))
    export_interactions(log, accepted, base, "01-01-2024-00-00-00")
    return (t.spark.read.schema("conv_id string, turn string, question string, reference_ids string")
            .option("multiLine", True).option("escape", '"').csv(f"{base}/logs/question-log-01-01-2024-00-00-00"))
