"""Sentences, chunks and the relation graph over ``documents``.

A document is a page. For chunking it is one section; for the relation graph each of its lines is a section, so that
sections have siblings and long lines have split siblings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgraph import schemas as S
from leafgraph.functions.text import split_sentences, strip
from leafgraph.operators import chunking as C
from leafgraph.operators import extracts as X
from leafgraph.operators import graph as G
from leafgraph.operators.sentences import CORE, train, trained_sentences
from leafgraph.registered.base import Tables, query, sql_strip
from leafgraph.session import materialize, spread


def sql_sentences(e: str) -> str:
    """Array of sentences, in the same rule order as the engine."""
    e = rf"regexp_replace({e}, '(^|\n)\s*(\d+)\.\s', chr(1) || '\2' || chr(2), 'g')"
    e = rf"regexp_replace({e}, '(^|\n)\s*(\*+)', chr(1) || '\2', 'g')"
    e = rf"regexp_replace({e}, '\n\n', chr(1), 'g')"
    e = rf"regexp_replace({e}, '([.!?])\s+', '\1' || chr(1), 'g')"
    return (f"list_filter(list_transform(string_split(replace({e}, chr(2), '. '), chr(1)), "
            f"lambda s: {sql_strip('s')}), lambda s: s <> '')")


def documents(t: Tables) -> DataFrame:
    return spread(t.documents.select("doc_id", "text"), "doc_id")


@query("e6_split_sentences", f"""WITH s AS (SELECT doc_id, {sql_sentences('text')} AS a FROM documents)
    SELECT doc_id, (generate_subscripts(a, 1) - 1)::INTEGER AS i, unnest(a) AS sentence FROM s""")
def e6(t: Tables) -> DataFrame:
    return documents(t).select("doc_id", F.posexplode(split_sentences(F.col("text"))).alias("i", "sentence"))


_BARE = "replace(s, chr(3), '')"
_LAST, _HEAD = r"regexp_extract(lag(s) OVER o, '(\S+)$', 1)", r"regexp_extract(s, '^(\S+)', 1)"
_CORE = CORE.replace("'", "''")


def _sql_core(e: str, group: int = 1) -> str:
    return f"regexp_extract({e}, '{_CORE}', {group})"


def _sql_likelihood(k: str, n: str, p: str) -> str:
    return (f"(CASE WHEN {k} > 0 AND {p} > 0 THEN ({k}) * ln({p}) ELSE 0 END + "
            f"CASE WHEN {n} - ({k}) > 0 AND 1 - ({p}) > 0 THEN ({n} - ({k})) * ln(1 - ({p})) ELSE 0 END)")


def _sql_dunning(first: str, second: str, both: str, total: str) -> str:
    rest, other = f"({total} - {first})", f"({second} - {both})"
    p, p1, p2 = f"{second} / {total}", f"{both} / {first}", f"{other} / {rest}"
    return (f"-2 * ({_sql_likelihood(both, first, p)} + {_sql_likelihood(other, rest, p)} - {_sql_likelihood(both, first, p1)} "
            f"- {_sql_likelihood(other, rest, p2)})")


def _sql_pieces(e: str) -> str:
    e = rf"regexp_replace({e}, '(^|\n)\s*(\d+)\.\s', chr(1) || '\2' || chr(2), 'g')"
    e = rf"regexp_replace({e}, '(^|\n)\s*(\*+)', chr(1) || '\2', 'g')"
    e = rf"regexp_replace({e}, '\n\n', chr(1), 'g')"
    e = rf"regexp_replace({e}, '([!?])\s+', '\1' || chr(1), 'g')"
    e = rf"regexp_replace({e}, '(\.)\s+', '\1' || chr(1) || chr(3), 'g')"
    return (f"list_filter(list_transform(string_split(replace({e}, chr(2), '. '), chr(1)), lambda s: "
            f"{{'soft': starts_with(s, chr(3)), 'text': {sql_strip(_BARE)}}}), lambda s: s.text <> '')")


@query("e6_trained_sentences", rf"""WITH t AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT doc_id,
      list_filter(regexp_split_to_array(text, '\s+'), lambda x: {_sql_core('x')} <> '') AS l FROM documents)),
    u AS (SELECT doc_id, i, lower({_sql_core('x')}) AS w, {_sql_core('x', 2)} <> '' AS dot FROM t),
    v AS (SELECT w, dot, CASE WHEN dot THEN coalesce(lead(w) OVER (PARTITION BY doc_id ORDER BY i), '') END AS n FROM u),
    words AS (SELECT w, count(*)::DOUBLE AS n_w, count_if(dot)::DOUBLE AS n_dot FROM v GROUP BY w),
    g AS (SELECT sum(n_w) AS total, sum(n_dot) AS stops FROM words),
    sized AS (SELECT *, stops / total AS p, length(w) - length(replace(w, '.', '')) AS inner_dots,
      (length(replace(w, '.', '')))::DOUBLE AS size FROM words, g),
    short AS (SELECT w FROM sized WHERE n_dot > 0 AND regexp_matches(w, '\p{{L}}') AND
      -2 * ({_sql_likelihood('n_dot', 'n_w', 'p')} - {_sql_likelihood('n_dot', 'n_w', '0.99::DOUBLE')}) * exp(-size) * (inner_dots + 1)
      * pow(size, -(n_w - n_dot)) >= 0.3),
    fol AS (SELECT w, n, count(*)::DOUBLE AS c FROM v WHERE dot AND n <> '' GROUP BY w, n),
    ends AS (SELECT * FROM fol WHERE w NOT IN (SELECT w FROM short)),
    b AS (SELECT coalesce(sum(c), 0) AS breaks FROM ends),
    first AS (SELECT n, sum(c) AS at_, any_value(n_w) AS n_n FROM ends JOIN words ON words.w = ends.n GROUP BY n),
    starters AS (SELECT n FROM first, g, b WHERE at_ * total > n_n * breaks AND {_sql_dunning('breaks', 'n_n', 'at_', 'total')} >= 30),
    pairs AS (SELECT fol.w, fol.n FROM fol JOIN words x ON x.w = fol.w JOIN words y ON y.w = fol.n, g WHERE c > 1
      AND fol.n NOT IN (SELECT n FROM starters) AND c * total > x.n_dot * y.n_w AND {_sql_dunning('x.n_dot', 'y.n_w', 'c', 'total')} >= 7.88),
    pc AS (SELECT doc_id, unnest(a).text AS s, unnest(a).soft AS soft, generate_subscripts(a, 1) AS i FROM (SELECT doc_id,
      {_sql_pieces('text')} AS a FROM documents)),
    j AS (SELECT doc_id, i, s, soft, lower({_sql_core(_LAST)}) AS w,
      {_sql_core(_HEAD)} AS h FROM pc WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
    k AS (SELECT doc_id, i, s, soft AND i > 1 AND ((w, lower(h)) IN (SELECT (w, n) FROM pairs) OR (w IN (SELECT w FROM short)
      AND NOT (regexp_matches(h, '^\p{{Lu}}') AND lower(h) IN (SELECT n FROM starters)))) AS glued FROM j),
    m AS (SELECT *, sum(CASE WHEN glued THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM k)
    SELECT doc_id, (no - 1)::INTEGER AS i, string_agg(s, ' ' ORDER BY m.i) AS sentence FROM m GROUP BY doc_id, no""")
def e6_trained(t: Tables) -> DataFrame:
    """Boundaries by a model of the documents themselves."""
    return trained_sentences(documents(t), train(documents(t)))


def sql_chunks(source: str, key: str, max_len: int = 1000) -> str:
    """CTEs that end in ``chunks(key, split_idx, text)`` for ``source(key, text)``, packing by a recursive walk."""
    w = r"list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '')"
    return f"""
    src AS ({source}),
    sent AS (SELECT {key}, generate_subscripts(a, 1) AS i, unnest(a) AS s FROM (
      SELECT {key}, {sql_sentences('text')} AS a FROM src WHERE length(text) > {max_len})),
    words AS (SELECT {key}, i, generate_subscripts(a, 1) AS j, unnest(a) AS w FROM (
      SELECT {key}, i, {w} AS a FROM sent WHERE length(s) > {max_len})),
    wfold AS (SELECT {key}, i, j, length(w) AS size, 0 AS c FROM words WHERE j = 1 UNION ALL
      SELECT n.{key}, n.i, n.j, CASE WHEN f.size + 1 + length(n.w) <= {max_len} THEN f.size + 1 + length(n.w)
        ELSE length(n.w) END, f.c + CASE WHEN f.size + 1 + length(n.w) <= {max_len} THEN 0 ELSE 1 END
      FROM wfold f JOIN words n ON n.{key} = f.{key} AND n.i = f.i AND n.j = f.j + 1),
    pieces AS (SELECT {key}, i, c, string_agg(w, ' ' ORDER BY j) AS s, true AS force
      FROM wfold JOIN words USING ({key}, i, j) GROUP BY {key}, i, c UNION ALL
      SELECT {key}, i, 0, s, false FROM sent WHERE length(s) <= {max_len}),
    units AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY i, c) AS u FROM pieces),
    fold AS (SELECT {key}, u, length(s) AS size, 0 AS c FROM units WHERE u = 1 UNION ALL
      SELECT n.{key}, n.u, CASE WHEN f.size + 1 + length(n.s) <= {max_len} AND NOT n.force
          THEN f.size + 1 + length(n.s) ELSE length(n.s) END,
        f.c + CASE WHEN f.size + 1 + length(n.s) <= {max_len} AND NOT n.force THEN 0 ELSE 1 END
      FROM fold f JOIN units n ON n.{key} = f.{key} AND n.u = f.u + 1),
    chunks AS (SELECT {key}, fold.c::INTEGER AS split_idx, string_agg(s, ' ' ORDER BY u) AS text
      FROM fold JOIN units USING ({key}, u) GROUP BY {key}, fold.c UNION ALL
      SELECT {key}, 0, text FROM src WHERE length(text) <= {max_len})"""


@query("e7_pack_sentences", f"""WITH RECURSIVE {sql_chunks('SELECT doc_id, text FROM documents', 'doc_id')}
    SELECT doc_id, split_idx, text FROM chunks""")
def e7(t: Tables) -> DataFrame:
    return C.split_long_texts(documents(t))


@query("e8_pack_words", r"""WITH RECURSIVE words AS (SELECT doc_id, generate_subscripts(a, 1) AS j, unnest(a) AS w FROM (
      SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS a FROM documents)),
    fold AS (SELECT doc_id, j, length(w) AS size, 0 AS c FROM words WHERE j = 1 UNION ALL
      SELECT n.doc_id, n.j, CASE WHEN f.size + 1 + length(n.w) <= 300 THEN f.size + 1 + length(n.w) ELSE length(n.w) END,
        f.c + CASE WHEN f.size + 1 + length(n.w) <= 300 THEN 0 ELSE 1 END
      FROM fold f JOIN words n ON n.doc_id = f.doc_id AND n.j = f.j + 1)
    SELECT doc_id, c::INTEGER AS piece, string_agg(w, ' ' ORDER BY j) AS text FROM fold JOIN words USING (doc_id, j)
    GROUP BY doc_id, c""")
def e8(t: Tables) -> DataFrame:
    """Whole documents as one over-long sentence, cut at 300 characters."""
    return documents(t).select("doc_id", F.posexplode(C.pack_words(F.col("text"), 300)).alias("piece", "text"))


def _kept(e: str, sep: str) -> str:
    """Pieces of ``e`` cut behind every separator, if it is over the limit."""
    return (f"CASE WHEN length({e}) > 2000 THEN list_transform(string_split({e}, {sep}), lambda p, i: CASE WHEN i < "
            f"len(string_split({e}, {sep})) THEN p || {sep} ELSE p END) ELSE [{e}] END")


@query("e9_recursive_chunk", f"""WITH RECURSIVE a AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (
      SELECT doc_id, {_kept('text', "E'\n\n'")} AS l FROM documents)),
    b AS (SELECT doc_id, i, unnest(l) AS t, generate_subscripts(l, 1) AS j FROM (SELECT doc_id, i, {_kept('t', "E'\n'")} AS l FROM a)),
    c AS (SELECT doc_id, i, j, unnest(l) AS t, generate_subscripts(l, 1) AS k FROM (SELECT doc_id, i, j, {_kept('t', "' '")} AS l FROM b)),
    d AS (SELECT doc_id, i, j, k, unnest(l) AS t, generate_subscripts(l, 1) AS m FROM (SELECT doc_id, i, j, k,
      CASE WHEN length(t) > 2000 THEN list_transform(range(0, (length(t) - 1) // 2000 + 1), lambda x: substr(t, x * 2000 + 1, 2000))
      ELSE [t] END AS l FROM c)),
    p AS (SELECT doc_id, list(t ORDER BY i, j, k, m) AS ts, list(length(t) ORDER BY i, j, k, m) AS ns FROM d WHERE t <> '' GROUP BY doc_id),
    s AS (SELECT *, list_prepend(0, list_transform(ns, lambda x, i: list_sum(ns[1:i])))::BIGINT[] AS sums FROM p),
    w AS (SELECT doc_id, 1::BIGINT AS i, 0::BIGINT AS first, ns[1]::BIGINT AS size, NULL::BIGINT AS was, ns, sums FROM s UNION ALL
      SELECT doc_id, i + 1, CASE WHEN full_ THEN back ELSE first END,
        CASE WHEN full_ THEN sums[i + 1] - sums[back + 1] ELSE size END + ns[i + 1], CASE WHEN full_ THEN first END, ns, sums
      FROM (SELECT *, size + ns[i + 1] > 2000 AND size > 0 AS full_, list_filter(range(greatest(0, i - 100), i + 1),
        lambda x: sums[i + 1] - sums[x + 1] <= least(100, 2000 - ns[i + 1]))[1] AS back FROM w WHERE i < len(ns))),
    r AS (SELECT doc_id, was AS first, i - 1 AS last FROM w WHERE was IS NOT NULL UNION ALL
      SELECT doc_id, first, i FROM w WHERE i = len(ns))
    SELECT r.doc_id, (row_number() OVER (PARTITION BY r.doc_id ORDER BY last) - 1)::INTEGER AS i,
      array_to_string(ts[first + 1:last], '') AS chunk FROM r JOIN s USING (doc_id)""")
def e9(t: Tables) -> DataFrame:
    return documents(t).select("doc_id", F.posexplode(C.recursive_chunks(F.col("text"), 2000, 100)).alias("i", "chunk"))


@query("e1_assign_doc_ids", f"""WITH RECURSIVE {sql_chunks('SELECT doc_id, text FROM documents', 'doc_id')}
    SELECT doc_id AS page_id, split_idx, doc_id * 1048576 + split_idx AS doc_id FROM chunks""")
def e1(t: Tables) -> DataFrame:
    chunks = C.split_long_texts(documents(t)).withColumnRenamed("doc_id", "page_id")
    return X.assign_doc_ids(chunks, "split_idx").select("page_id", "split_idx", "doc_id")


MAX_LINE = 200


def line_extracts(t: Tables) -> DataFrame:
    """Lines as root sections, cut at 200 characters, with ids."""
    lines = documents(t).select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n"))
                                .alias("sec_no", "text"))
    chunks = C.split_long_texts(lines.where(strip(F.col("text")) != ""), max_len=MAX_LINE)
    rows = X.assign_doc_ids(chunks, "sec_no", "split_idx")
    return rows.withColumns({"parent_sec": F.lit(None).cast("long"), "parent": -1 - F.col("page_id")})


LINES = sql_chunks(f"""SELECT doc_id * 100000 + i - 1 AS line, s AS text FROM (
      SELECT doc_id, generate_subscripts(a, 1) AS i, unnest(a) AS s FROM (
        SELECT doc_id, string_split(text, E'\\n') AS a FROM documents)) WHERE {sql_strip('s')} <> ''""", "line", MAX_LINE) + """,
    ex AS (SELECT line // 100000 AS page_id, line, split_idx, text, (line // 100000) * 1048576 - 1 + row_number() OVER (
      PARTITION BY line // 100000 ORDER BY line, split_idx) AS id FROM chunks),
    sib AS (SELECT *, lag(id) OVER (PARTITION BY page_id ORDER BY line, split_idx) AS prev FROM ex),
    edges AS (SELECT -1 - page_id AS src, id AS dst, 1 AS type FROM sib UNION ALL
      SELECT prev, id, CASE WHEN split_idx > 0 THEN 5 ELSE 4 END FROM sib WHERE prev IS NOT NULL)"""


def line_edges(t: Tables) -> DataFrame:
    return materialize(X.relations(line_extracts(t)), "edges")


@query("e11_relations", f"WITH RECURSIVE {LINES} SELECT src, dst, type FROM edges")
def e11(t: Tables) -> DataFrame:
    return X.relations(line_extracts(t))


@query("j3_related_docs", f"""WITH RECURSIVE {LINES}
    SELECT 'both' AS way, dst AS doc_id, src AS related_id FROM edges WHERE type = 4 UNION ALL
    SELECT 'both', src, dst FROM edges WHERE type = 4 UNION ALL
    SELECT 'in', dst, src FROM edges WHERE type = 5 UNION ALL
    SELECT 'only', id, n.related_id FROM ex LEFT JOIN (SELECT src, CASE WHEN count(*) = 1 THEN max(dst) END AS related_id
      FROM edges WHERE type = 5 GROUP BY src) n ON n.src = id""")
def j3(t: Tables) -> DataFrame:
    edges = line_edges(t)
    ids = edges.where("type = 1").select(F.col("dst").alias("doc_id"))
    parts = [G.sibling_ids(edges, ids).withColumn("way", F.lit("both")),
             G.related_docs(edges, ids, S.SPLIT_SIBLING, in_only=True).withColumn("way", F.lit("in")),
             G.related_docs(edges, ids, S.SPLIT_SIBLING, out_only=True, only_one=True).withColumn("way", F.lit("only"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("j4_split_siblings", f"""WITH RECURSIVE {LINES} SELECT a.id AS doc_id, (b.split_idx + 1)::INTEGER AS position,
    b.id AS member_id FROM ex a JOIN ex b ON a.line = b.line""")
def j4(t: Tables) -> DataFrame:
    edges = line_edges(t)
    return G.split_siblings(edges, edges.where("type = 1").select(F.col("dst").alias("doc_id")))


@query("j4_chains_over_pages", """WITH o AS (SELECT doc_id, source, (row_number() OVER (PARTITION BY source ORDER BY md5(text), doc_id))
      ::INTEGER AS position FROM documents)
    SELECT min(doc_id) OVER (PARTITION BY source) AS doc_id, position, doc_id AS member_id FROM o""")
def j4_over_pages(t: Tables) -> DataFrame:
    """The documents of a source continue each other in the order of a hash; each source's first document asks for its chain."""
    order = Window.partitionBy("source").orderBy(F.md5("text"), "doc_id")
    links = t.documents.select(F.lag("doc_id").over(order).alias("src"), F.col("doc_id").alias("dst"), F.lit(S.SPLIT_SIBLING).alias("type"))
    ids = t.documents.groupBy("source").agg(F.min("doc_id").alias("doc_id"))
    return G.split_siblings(materialize(links.where("src IS NOT NULL"), "edges"), ids)


@query("j5_combine_siblings", f"""WITH RECURSIVE {LINES} SELECT a.id AS doc_id, string_agg(b.text, ' ' ORDER BY b.split_idx)
    AS text, 'x' AS titles FROM ex a JOIN ex b ON a.line = b.line GROUP BY a.id""")
def j5(t: Tables) -> DataFrame:
    rows = materialize(line_extracts(t).select("page_id", "sec_no", "parent_sec", "split_idx", "doc_id", "parent", "text"),
                       "lines")
    hits = rows.select("doc_id", "text", F.array(F.lit("x"), F.lit("y")).alias("titles"))
    out = G.combine_siblings(hits, X.relations(rows), rows.select("doc_id", "text"))
    return out.select("doc_id", "text", F.array_join("titles", "|").alias("titles"))


@query("j6_docs_by_ids", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def j6(t: Tables) -> DataFrame:
    return G.docs_by_ids(t.documents, t.labels).select("doc_id", "lang")


@query("a1_program_options", """WITH x AS (SELECT DISTINCT d.lang AS faculty, d.source AS program,
      CASE WHEN quality = 1 THEN CASE WHEN toxic = 1 THEN 'good toxic' ELSE 'good clean' END END AS specialization
      FROM documents d LEFT JOIN labels USING (doc_id))
    SELECT * FROM x WHERE specialization IS NOT NULL OR NOT EXISTS (SELECT 1 FROM x y WHERE y.faculty = x.faculty
      AND y.program = x.program AND y.specialization IS NOT NULL)""")
def a1(t: Tables) -> DataFrame:
    from leafgraph.operators.taxonomy import program_options

    return program_options(taxonomy_rows(t))


def taxonomy_rows(t: Tables) -> DataFrame:
    """``lang`` is the faculty, ``source`` the program; labels make the specialization list."""
    spec = F.when(F.col("quality") == 1, F.array(F.when(F.col("toxic") == 1, "good toxic").otherwise("good clean")))
    return t.documents.join(t.labels, "doc_id", "left").select(
        F.col("lang").alias("faculty"), F.col("source").alias("program"), spec.alias("specialization"))


_TAX = """x AS (SELECT DISTINCT lang AS faculty, source AS program, substring(md5(source || lang), 1, 1) AS specialization
    FROM documents)"""


@query("f6_taxonomy_patch", f"""WITH {_TAX}, old AS (SELECT * FROM x WHERE specialization < 'c'),
    edited AS (SELECT * FROM x WHERE specialization >= '4' AND specialization < 'd'),
    new AS (SELECT * FROM x WHERE specialization > '1')
    (SELECT * FROM new EXCEPT (SELECT * FROM old EXCEPT SELECT * FROM edited))
    UNION (SELECT * FROM edited EXCEPT SELECT * FROM old)""")
def f6(t: Tables) -> DataFrame:
    """Three overlapping slices of one taxonomy are the old, the edited and the new one."""
    from leafgraph.operators.taxonomy import taxonomy_patch

    spec = F.substring(F.md5(F.concat("source", "lang")), 1, 1)
    x = t.documents.select(F.col("lang").alias("faculty"), F.col("source").alias("program"),
                           spec.alias("specialization")).distinct()
    s = F.col("specialization")
    return taxonomy_patch(x.where(s > "1"), x.where(s < "c"), x.where((s >= "4") & (s < "d")))
