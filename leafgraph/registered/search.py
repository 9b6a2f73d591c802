"""Vector search.

``embeddings`` is the vector table: its vector is the text vector and the reversed vector the title vector. There is
one question per label: the mean vector of the label. ``documents`` (doc_id = vec_id) brings texts; ``lang`` is the
faculty and ``source`` the program.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.functions import vectors as V
from leafgraph.operators import retrieval as R
from leafgraph.operators.context import overflow
from leafgraph.operators.ivf import IvfIndex
from leafgraph.registered.base import Tables, query
from leafgraph.session import materialize


def questions(t: Tables) -> DataFrame:
    """``(question_id, vector)``: one per label, averaged with a map-side combine."""
    cells = t.embeddings.select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.groupBy(F.col("label").cast("long").alias("question_id")).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("i", "m"))), lambda c: c["m"]).alias("vector"))


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("doc_id"), "embedding", "label")


def both_vectors(t: Tables) -> DataFrame:
    return vectors(t).select("doc_id", "label", F.col("embedding").alias("text_embedding"),
                             F.reverse("embedding").alias("title_embedding"))


Q = """q AS (SELECT label::BIGINT AS question_id, list(m ORDER BY i) AS vector FROM (
    SELECT label, i, avg(x) AS m FROM (
        SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)
    GROUP BY label, i) GROUP BY label)"""
E = """e AS (SELECT vec_id AS doc_id, label, embedding::DOUBLE[] AS v, list_reverse(embedding::DOUBLE[]) AS w
    FROM embeddings)"""


def cos(a: str, b: str) -> str:
    return (f"(1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) "
            f"* sqrt(list_dot_product({b}, {b}))))")


def l2(a: str, b: str) -> str:
    return (f"sqrt(greatest(list_dot_product({a}, {a}) + list_dot_product({b}, {b}) "
            f"- 2 * list_dot_product({a}, {b}), 0))")


def inner(a: str, b: str) -> str:
    return f"(-list_dot_product({a}, {b}))"


def ranked(dist: str, k: str, where: str = "", on: str = "TRUE") -> str:
    """Hits ``(question_id, rank, doc_id, distance)`` of q x e."""
    return f"""SELECT question_id, rank, doc_id, distance FROM (
        SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, doc_id)::INTEGER AS rank FROM (
            SELECT question_id, doc_id, round({dist}, 9) AS distance FROM q JOIN e ON {on} {where}))
        WHERE rank <= {k}"""


HITS = "SELECT question_id, rank, doc_id, round(distance, 6) AS distance FROM"


def shown(hits: DataFrame) -> DataFrame:
    return hits.select("question_id", "rank", "doc_id", F.round("distance", 6).alias("distance"))


@query("k1_knn", f"WITH {Q}, {E} {HITS} ({ranked(cos('vector', 'v'), '5')})")
def k1(t: Tables) -> DataFrame:
    return shown(R.nearest(questions(t), vectors(t), 5))


@query("k2_knn_sum", f"WITH {Q}, {E} {HITS} ({ranked(cos('vector', 'v') + ' + ' + cos('vector', 'w'), '5')})")
def k2(t: Tables) -> DataFrame:
    pairs = (("vector", "text_embedding"), ("vector", "title_embedding"))
    return shown(R.nearest(questions(t), both_vectors(t), 5, pairs=pairs))


FUSED = f"""fused AS (
    SELECT question_id, text, min(distance) AS distance, arg_min(doc_id, src * 1000000 + rank) AS doc_id,
        min(src * 1000000 + rank) AS seen
    FROM (SELECT 0 AS src, * FROM ({ranked(cos('vector', 'v'), '5')}) UNION ALL
          SELECT 1 AS src, * FROM ({ranked(cos('vector', 'w'), '5')})) JOIN documents USING (doc_id)
    GROUP BY question_id, text),
  fused_ranked AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, seen)::INTEGER AS rank
    FROM fused)"""


def fused(t: Tables, k: int = 5) -> DataFrame:
    texts = t.documents.select("doc_id", "text")
    return R.nearest_two_columns(questions(t), both_vectors(t), k, texts=texts, key="text")


@query("k3_knn_two_columns", f"WITH {Q}, {E}, {FUSED} {HITS} fused_ranked")
def k3(t: Tables) -> DataFrame:
    return shown(fused(t))


@query("a2_fuse_min_score", f"""WITH {Q}, {E} {HITS} (
    SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY distance, seen)::INTEGER AS rank FROM (
        SELECT question_id, doc_id, min(distance) AS distance, min(src * 1000000 + rank) AS seen FROM (
            SELECT 0 AS src, * FROM ({ranked(cos('vector', 'v'), '8')}) UNION ALL
            SELECT 1 AS src, * FROM ({ranked(l2('vector', 'w'), '8')})) GROUP BY question_id, doc_id))
    WHERE rank <= 8""")
def a2(t: Tables) -> DataFrame:
    """The variant keyed by document id and cut to k, over lists of two metrics."""
    a = R.nearest(questions(t), both_vectors(t), 8, pairs=(("vector", "text_embedding"),))
    b = R.nearest(questions(t), both_vectors(t), 8, metric="l2", pairs=(("vector", "title_embedding"),))
    return shown(R.fuse_min_score(a, b, key="doc_id", limit=8))


@query("k4_knn_concat", f"""WITH {Q}, {E} {HITS} ({ranked(cos('list_concat(vector, vector)', 'list_concat(v, w)'),
                                                           '5')})""")
def k4(t: Tables) -> DataFrame:
    qs = questions(t).withColumn("vector", V.repeat_vector(F.col("vector"), 2))
    vs = both_vectors(t).select("doc_id", V.concat_vectors(F.col("text_embedding"), F.col("title_embedding"))
                                .alias("embedding"))
    return shown(R.nearest(qs, vs, 5))


@query("k5_knn_filtered", f"WITH {Q}, {E} {HITS} ({ranked(cos('vector', 'v'), '5', on='e.label = q.question_id')})")
def k5(t: Tables) -> DataFrame:
    qs = questions(t).withColumn("want", F.col("question_id").cast("int"))
    return shown(R.nearest_filtered(qs, vectors(t), on=(("want", "label"),), k=5))


@query("k6_knn_threshold", f"""WITH {Q}, {E} SELECT question_id, rank, doc_id, round(1 - distance, 6) AS relevance
    FROM ({ranked(cos('vector', 'v'), '50')}) WHERE 1 - distance >= 0.3""")
def k6(t: Tables) -> DataFrame:
    hits = R.above_threshold(R.nearest(questions(t), vectors(t), 50), 0.3)
    return hits.select("question_id", "rank", "doc_id", F.round("relevance", 6).alias("relevance"))


def _metric_sql(metric: str, dist: str, relevance: str) -> str:
    return (f"SELECT '{metric}' AS metric, question_id, rank, doc_id, round(distance, 6) AS distance, "
            f"round({relevance}, 6) AS relevance FROM ({ranked(dist, '5')})")


@query("k7_knn_metrics", f"WITH {Q}, {E} " + " UNION ALL ".join([
    _metric_sql("cosine", cos("vector", "v"), "1 - distance"),
    _metric_sql("l2", l2("vector", "v"), "1 - distance / sqrt(2)"),
    _metric_sql("inner", inner("vector", "v"), "CASE WHEN distance > 0 THEN 1 - distance ELSE -distance END")]))
def k7(t: Tables) -> DataFrame:
    parts = [R.above_threshold(R.nearest(questions(t), vectors(t), 5, metric), 0, metric).select(
        F.lit(metric).alias("metric"), "question_id", "rank", "doc_id", F.round("distance", 6).alias("distance"),
        F.round("relevance", 6).alias("relevance")) for metric in V.METRICS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("k8_knn_approx", """SELECT 'labels' AS questions, count(DISTINCT label) AS n, true AS recalled, true AS in_probed_lists,
      true AS true_distances FROM embeddings UNION ALL
    SELECT 'vectors', count(*), true, true, true FROM embeddings WHERE vec_id % 50 = 0""")
def k8(t: Tables) -> DataFrame:
    """Two sets of questions: nine tenths of the exact hits are found, every hit lies in a list that its question read, and has
    the distance that the exact search gives it."""
    index = IvfIndex.build(vectors(t))
    every = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").cast("long").alias("question_id"), F.col("embedding").alias("vector"))
    out = None
    for name, qs in (("labels", questions(t)), ("vectors", every)):
        exact = materialize(R.nearest(qs, vectors(t), 5), "exact")
        probes = index.tune(qs, exact)
        found = materialize(index.search(qs, 5, probes, with_lists=True), "found")
        stray = found.join(index.probes(qs, probes), ["question_id", "list_id"], "left_anti")
        other = exact.select("question_id", "doc_id", F.col("distance").alias("d")).join(found, ["question_id", "doc_id"]).where(
            F.abs(F.col("d") - F.col("distance")) > 1e-6)
        row = (R.recall(found, exact).agg(F.count("*").alias("n"), (F.avg("recall") >= 0.9).alias("recalled"))
               .withColumns({"in_probed_lists": stray.agg(F.count("*") == 0).scalar(), "true_distances": other.agg(F.count("*") == 0).scalar()})
               .select(F.lit(name).alias("questions"), "n", "recalled", "in_probed_lists", "true_distances"))
        out = row if out is None else out.union(row)
    return out


@query("k1_every_document", f"""WITH {E}, q AS (SELECT doc_id AS question_id, v AS vector FROM e) {HITS} ({ranked(cos('vector', 'v'), '3')})""")
def k1_every(t: Tables) -> DataFrame:
    """Every document asks for its nearest ones; itself comes first."""
    qs = vectors(t).select(F.col("doc_id").alias("question_id"), F.col("embedding").alias("vector"))
    return shown(R.nearest(qs, vectors(t), 3))


@query("k8_ivf_lists", """SELECT label, count(*) AS n, CASE WHEN count(*) * 100000 > 1000000
    THEN floor(sqrt(count(*) * 100000)) ELSE greatest(10, floor(count(*) * 100000 / 1000)) END::BIGINT AS lists
    FROM embeddings GROUP BY label""")
def k8_lists(t: Tables) -> DataFrame:
    n = F.col("n") * 100_000
    return t.embeddings.groupBy("label").agg(F.count("*").alias("n")).withColumn("lists", V.ivf_lists(n))


@query("k9_top_k_setting", f"WITH {Q}, {E} {HITS} ({ranked(cos('vector', 'v'), '3 + question_id % 3')})")
def k9(t: Tables) -> DataFrame:
    qs = questions(t).withColumn("k", 3 + F.col("question_id") % 3)
    return shown(R.nearest(qs, vectors(t), F.col("k")))


def profiled(t: Tables) -> DataFrame:
    """Questions with a profile: faculty of the first and program of the last vector of the label."""
    docs = t.embeddings.join(t.documents, F.col("vec_id") == F.col("doc_id"))
    profile = docs.groupBy(F.col("label").cast("long").alias("question_id")).agg(
        F.min_by("lang", "vec_id").alias("faculty"), F.max_by("source", "vec_id").alias("program"))
    return questions(t).join(profile, "question_id").withColumns({
        "specialization": F.when(F.col("question_id") % 2 == 0, "q1").otherwise(""), "year": F.lit("first year")})


def profiled_docs(t: Tables) -> DataFrame:
    docs = vectors(t).join(t.documents, "doc_id").join(t.labels, "doc_id", "left")
    return docs.select(
        "doc_id", "text", "embedding",
        F.when(F.col("n_chars") >= 300, F.col("lang")).otherwise("").alias("faculty"),
        F.when(F.col("n_chars") >= 600, F.col("source")).otherwise("").alias("program"),
        F.when(F.col("quality") == 1, "q1").otherwise("").alias("specialization"))


BACKOFF = f"""{Q},
  prof AS (SELECT label::BIGINT AS question_id, arg_min(lang, vec_id) AS f, arg_max(source, vec_id) AS p,
      CASE WHEN label % 2 = 0 THEN 'q1' ELSE '' END AS s, 'first year' AS y
      FROM embeddings JOIN documents ON vec_id = doc_id GROUP BY label),
  lv AS (SELECT question_id, 0 AS level, f, p, s FROM prof UNION ALL
      SELECT question_id, 1, f, p, '' FROM prof WHERE s <> '' OR y <> '' UNION ALL
      SELECT question_id, 2, '', '', '' FROM prof WHERE f <> '' OR p <> ''),
  d AS (SELECT doc_id, text, embedding::DOUBLE[] AS v, CASE WHEN n_chars >= 300 THEN lang ELSE '' END AS f,
      CASE WHEN n_chars >= 600 THEN source ELSE '' END AS p, CASE WHEN quality = 1 THEN 'q1' ELSE '' END AS s
      FROM embeddings JOIN documents ON vec_id = doc_id LEFT JOIN labels USING (doc_id)),
  sc AS (SELECT question_id, level, doc_id, text, round({cos('vector', 'd.v')}, 9) AS distance
      FROM lv JOIN q USING (question_id) JOIN d ON d.f = lv.f AND d.p = lv.p AND (lv.s <> '' OR d.s = '')),
  hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, level ORDER BY distance, doc_id)
      ::INTEGER AS rank FROM sc) WHERE rank <= 5 AND 1 - distance >= 0.05 AND length(text) >= 100),
  ch AS (SELECT question_id, min(level) AS chosen FROM hits GROUP BY question_id),
  kept AS (SELECT hits.* FROM hits JOIN ch USING (question_id) WHERE level = chosen)"""


def texted(levels: DataFrame) -> DataFrame:
    """A stand-in for the embedding model: what is asked of first-year students lies elsewhere than the rest."""
    first = F.contains("query", F.lit("first year"))
    return levels.withColumn("vector", F.when(first, F.reverse("vector")).otherwise(F.col("vector")))


STAGED = BACKOFF.replace("sc AS (SELECT question_id, level, doc_id, text, round(" + cos("vector", "d.v"),
    "sc AS (SELECT question_id, level, doc_id, text, round(" + cos("(CASE WHEN lv.level = 0 THEN list_reverse(vector) ELSE vector END)", "d.v"))


@query("k10_staged_models", f"""WITH {STAGED}, late AS (SELECT question_id, min(level) AS chosen FROM hits WHERE level > 0 GROUP BY question_id)
    SELECT lv.level, count(*) AS n_asked, count_if(chosen = lv.level) AS n_answered, count(DISTINCT CASE WHEN lv.level = 0
      THEN coalesce(nullif(s, '') || ' : ', '') || 'first year : where?' ELSE 'where?' END) AS n_texts
    FROM lv LEFT JOIN late ON late.question_id = lv.question_id WHERE coalesce(lv.level <= chosen, true) GROUP BY lv.level""")
def k10_stages(t: Tables) -> DataFrame:
    """Of each level: how many questions the models were asked, and how many were answered, when the first level fails."""
    stages: list[DataFrame] = []
    qs = profiled(t).withColumn("question", F.lit("where?"))
    R.backoff_search(qs, profiled_docs(t), k=5, threshold=0.05, answered=_second_half_answers, embed=texted, stages=stages)
    rows = stages[0]
    for stage in stages[1:]:
        rows = rows.unionByName(stage)
    return rows.groupBy("level").agg(F.count("*").alias("n_asked"), F.count_if("answered").alias("n_answered"),
                                     F.countDistinct("query").alias("n_texts"))


@query("k10_level_vectors", f"""WITH {STAGED} SELECT question_id, level, rank, doc_id, round(distance, 6) AS distance FROM kept""")
def k10_vectors(t: Tables) -> DataFrame:
    """Each level searches with the vector of its own text."""
    kept, _ = R.backoff_search(profiled(t).withColumn("question", F.lit("where?")), profiled_docs(t), k=5, threshold=0.05, embed=texted)
    return kept.select("question_id", "level", "rank", "doc_id", F.round("distance", 6).alias("distance"))


@query("k10_backoff_search", f"""WITH {BACKOFF}
    SELECT question_id, level, rank, doc_id, round(distance, 6) AS distance FROM kept""")
def k10(t: Tables) -> DataFrame:
    kept, _ = R.backoff_search(profiled(t), profiled_docs(t), k=5, threshold=0.05)
    return kept.select("question_id", "level", "rank", "doc_id", F.round("distance", 6).alias("distance"))


def _second_half_answers(hits: DataFrame) -> DataFrame:
    """A stand-in for the model: the first level has no answer."""
    return hits.withColumn("answered", F.col("level") > 0)


@query("j9_exclude_kept", f"""WITH {BACKOFF}, ch2 AS (SELECT question_id, min(level) AS chosen FROM hits WHERE level > 0
      GROUP BY question_id),
    kept2 AS (SELECT hits.* FROM hits JOIN ch2 USING (question_id) WHERE level = chosen)
    SELECT question_id, level, rank, doc_id FROM hits LEFT JOIN ch2 USING (question_id)
    WHERE coalesce(level < chosen, true)
      AND NOT EXISTS (SELECT 1 FROM kept2 WHERE kept2.question_id = hits.question_id AND kept2.doc_id = hits.doc_id)""")
def j9(t: Tables) -> DataFrame:
    _, removed = R.backoff_search(profiled(t), profiled_docs(t), k=5, threshold=0.05, answered=_second_half_answers)
    return removed.select("question_id", "level", "rank", "doc_id")


@query("k11_start_doc", f"""WITH {Q}, {E},
    s AS (SELECT question_id, CASE WHEN question_id % 2 = 0 THEN question_id * 3 END AS start_doc FROM q)
    SELECT question_id, 1::INTEGER AS rank, start_doc AS doc_id FROM s JOIN documents ON doc_id = start_doc UNION ALL
    SELECT question_id, rank, doc_id FROM ({ranked(cos('vector', 'v'), '4')}) JOIN s USING (question_id)
    WHERE start_doc IS NULL""")
def k11(t: Tables) -> DataFrame:
    qs = questions(t).withColumn("start_doc", F.when(F.col("question_id") % 2 == 0, F.col("question_id") * 3))
    return R.start_docs(qs, t.documents, R.nearest(qs, vectors(t), 4)).select("question_id", "rank", "doc_id")


@query("w4_overflow_to_removed", f"WITH {Q}, {E} SELECT question_id, rank, doc_id, rank > 3 AS overflow "
                                 f"FROM ({ranked(cos('vector', 'v'), '8')})")
def w4(t: Tables) -> DataFrame:
    return overflow(R.nearest(questions(t), vectors(t), 8), 3).select("question_id", "rank", "doc_id", "overflow")


@query("f12_pad_vector", """SELECT vec_id, len(p)::INTEGER AS dim, round(list_sum(p), 6) AS total,
      round(p[96], 6) AS last_value FROM (
    SELECT vec_id, list_concat(CASE WHEN label = 0 THEN [] ELSE embedding::DOUBLE[] END,
      list_transform(range(0, 96 - CASE WHEN label = 0 THEN 0 ELSE len(embedding) END), lambda x: 0.0::DOUBLE)) AS p
    FROM embeddings)""")
def f12(t: Tables) -> DataFrame:
    """Vectors in list notation; those of one label are missing."""
    text = F.when(F.col("label") != 0, F.to_json(F.col("embedding").cast("array<double>")))
    p = V.pad_vector(V.parse_vector(text), 96)
    return t.embeddings.select("vec_id", p.alias("p")).select(
        "vec_id", F.size("p").alias("dim"),
        F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
        F.round(F.element_at("p", 96), 6).alias("last_value"))


@query("f13_concat_vectors", """SELECT vec_id, len(c)::INTEGER AS dim, round(c[1], 6) AS a, round(c[65], 6) AS b,
      round(c[192], 6) AS z FROM (SELECT vec_id, list_concat(list_concat(embedding, list_reverse(embedding)),
      embedding)::DOUBLE[] AS c FROM embeddings)""")
def f13(t: Tables) -> DataFrame:
    c = V.as_double(V.concat_vectors(F.col("embedding"), F.reverse("embedding"), F.col("embedding")))
    return t.embeddings.select("vec_id", c.alias("c")).select(
        "vec_id", F.size("c").alias("dim"), F.round(F.element_at("c", 1), 6).alias("a"),
        F.round(F.element_at("c", 65), 6).alias("b"), F.round(F.element_at("c", 192), 6).alias("z"))
