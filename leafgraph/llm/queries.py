"""The operators as queries over the driver tables, with an SQL twin where SQL can say the same.

Each query applies its operator with production parameters to the whole table and derives the digest columns from its output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.llm import (byte_bpe, fingerprints, hard_negatives, host_reputation, packing, page_templates, paragraphs,
                           phrase_index, resampling, set_join, suffix_repeats, token_files, weak_labels)
from leafgraph.session import work_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

HOSTS_SQL = rf"""
WITH own AS (
  SELECT page_id, coalesce(url, '') AS url,
         {_LOWER.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1)")} AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*(/[^?#]*)', 1) AS path
  FROM pages),
labelled AS (
  SELECT page_id, count(*) AS n, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS k
  FROM own JOIN labels ON try_cast(regexp_extract(path, '^/[^/]*/([0-9]{{1,18}})', 1) AS BIGINT) = doc_id
  GROUP BY page_id),
hosts AS (
  SELECT host,
         CASE WHEN array_to_string(p[-2:], '.') IN ('ac.uk','co.jp','co.uk','com.au','com.br','org.uk')
              THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain,
         CASE WHEN array_to_string(p[-2:], '.') IN ('ac.uk','co.jp','co.uk','com.au','com.br','org.uk') AND len(p) > 2
              THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix,
         coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(k), 0)::DOUBLE AS k
  FROM (SELECT own.*, string_split(host, '.') AS p FROM own) LEFT JOIN labelled USING (page_id) GROUP BY ALL),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
corpus AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS m FROM suffixes),
s0 AS (SELECT suffix, n, k, m FROM suffixes, corpus),
s1 AS (SELECT suffix, (m * s + k) / (s + n) AS m FROM s0, ({{strength_s0}})),
d0 AS (SELECT domain, suffix, n, k, m FROM domains JOIN s1 USING (suffix)),
d1 AS (SELECT domain, (m * s + k) / (s + n) AS m FROM d0, ({{strength_d0}})),
h0 AS (SELECT host, n, k, m FROM hosts JOIN d1 USING (domain)),
h1 AS (SELECT host, m * s + k AS a, (1 - m) * s + n - k AS b FROM h0, ({{strength_h0}})),
judged AS (SELECT host, a / (a + b) AS mean, a / (a + b) + 1.645 * sqrt(a * b / ((a + b) ^ 2 * (a + b + 1))) AS upper FROM h1),
rules AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) AS r(v, h, p)),
ruled AS (
  SELECT page_id, url, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
  FROM (SELECT DISTINCT page_id, url, host, path FROM own)
  JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY page_id, url)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN upper < 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
       round(mean, 6) AS mean, round(upper, 6) AS upper
FROM own JOIN judged USING (host) LEFT JOIN ruled USING (page_id, url)"""
for _level in ("s0", "d0", "h0"):
    HOSTS_SQL = HOSTS_SQL.replace("{strength_" + _level + "}", f"""
  SELECT CASE WHEN coalesce(e, 0) > 0 AND b > 0 THEN greatest(2.0, least(200.0, b / e - 1)) ELSE 200.0 END AS s
  FROM (SELECT sum(n * (k / n - m) ^ 2 - m * (1 - m)) AS e, sum((n - 1) * m * (1 - m)) AS b FROM {_level} WHERE n > 0)""")

_SPLIT = r"regexp_extract_all(coalesce({}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

PHRASES_SQL = rf"""
WITH d AS (SELECT doc_id, {_SPLIT.format(_LOWER.format("text"))} AS w FROM documents),
i AS (SELECT item_id, {_SPLIT.format(_LOWER.format("text"))} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 10) AS l, array_to_string(w[b:b + 9], ' ') AS p
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS b FROM i WHERE len(w) > 0)),
l AS (SELECT DISTINCT l FROM iw),
dw AS (SELECT doc_id, b, l, array_to_string(w[b:b + l - 1], ' ') AS p
       FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS b FROM d, l WHERE len(w) >= l)),
hit AS (SELECT doc_id, b, l, item_id FROM dw JOIN iw USING (l, p)),
words AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(b, b + l)) AS q FROM hit) GROUP BY doc_id),
owners AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s
           FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN owners USING (doc_id)"""

NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::INTEGER AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_dot_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM (
        SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE alike)
      WHERE r <= 5)
SELECT * FROM (
  SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER
           AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score)
WHERE rank <= 5"""


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, folder)`` under ``name``, with its SQL twin."""
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query("op1_paragraph_dedup")
def op1_paragraph_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """The units of text that go because the component they belong to keeps another."""
    units = paragraphs.repeated_units(table(spark, folder, "documents"))
    return units.filter("removed").select("doc_id", "text_key", "unit", "start", "end", "words", "first_doc_id")


@query("op2_host_reputation", HOSTS_SQL)
def op2_host_reputation(spark: SparkSession, folder: str) -> DataFrame:
    """Every page judged by rules or by its host; outcomes are the quality labels of the documents behind the pages."""
    pages = table(spark, folder, "pages")
    outcomes = host_reputation.outcomes_by_document(pages, table(spark, folder, "labels"))
    return host_reputation.judge_urls(pages, outcomes).select(
        "page_id", "host", "path", "rule", "verdict", F.round("mean", 6).alias("mean"), F.round("upper", 6).alias("upper"))


@query("op3_suffix_repeats")
def op3_suffix_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Documents without the 200-byte strings that occur elsewhere."""
    rows = suffix_repeats.remove_repeats(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_multiset_fingerprint")
def op4_multiset_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints of documents and of their edited texts."""
    rows = fingerprints.edited_fingerprints(table(spark, folder, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       *(fingerprints.as_text(F.col(c)).alias(c) for c in ("fingerprint", "edited_fingerprint")),
                       "near_edited", "near_next")


@query("op5_token_files")
def op5_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents encoded into files of 16-bit ids, read back from them."""
    target = work_dir(spark, "tokens")
    token_files.write_token_files(table(spark, folder, "documents"), target, width=2)

    return token_files.read_token_files(spark, target, width=2, widen=True).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op6_quality_model")
def op6_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    """Posterior, score and verdict of every document."""
    return weak_labels.judge_quality(table(spark, folder, "documents")).select("doc_id", "posterior", "score", "keep")


@query("op7_ngram_join")
def op7_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose 4-word shingles are 85 % alike, as components."""
    return set_join.join_similar(table(spark, folder, "documents"))


@query("op8_phrase_index", PHRASES_SQL)
def op8_phrase_index(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark windows in documents."""
    rows = phrase_index.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
                       "contaminated")


@query("op9_byte_bpe")
def op9_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """Documents encoded by byte-level BPE and decoded again."""
    return byte_bpe.digest_documents(table(spark, folder, "documents"))


@query("op10_page_templates")
def op10_page_templates(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return page_templates.extract_text(table(spark, folder, "pages"))


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Negatives in the score windows of each anchor's positives; every seventh vector has another label."""
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved), lambda vec_id: vec_id % 100 == 0)


@query("op12_best_fit_packing")
def op12_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packing.pack_documents(table(spark, folder, "documents"), capacity=1024, end_id=2)


@query("op13_target_resampling")
def op13_target_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """A quarter of the documents, drawn towards the distribution of the benchmark."""
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
