"""Title, text and prompt expressions.

``documents`` is the extract table: the lines of the text are titles, ``lang`` is the faculty and ``source`` the program. ``conversations`` brings questions and model output, ``part`` small text fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.functions import prompts as P
from leafgraph.functions import text as X
from leafgraph.operators import context as K
from leafgraph.operators.spelling import correct_questions, vocabulary
from leafgraph.plans.embedding_load import link_urls, select_text_rows
from leafgraph.registered.base import Tables, query, sql_strip

L = r"string_split(text, E'\n')"


def titles(t: Tables) -> DataFrame:
    """``p``: all lines but the last; ``t``: the last two, or a blank and the last for odd ids."""
    lines = F.split("text", "\n")
    own = F.when(F.col("doc_id") % 2 == 1, F.array(F.lit(""), F.element_at(lines, -1))).otherwise(
        F.slice(lines, F.greatest(F.size(lines) - 1, F.lit(1)), 2))
    return t.documents.select("doc_id", "lang", "source", "text", F.slice(lines, 1, F.size(lines) - 1).alias("p"),
                              own.alias("t"))


TITLES = f"""x AS (SELECT doc_id, lang, source, text, {L}[1:len({L}) - 1] AS p, CASE WHEN doc_id % 2 = 1
    THEN ['', {L}[-1]] ELSE {L}[greatest(len({L}) - 1, 1):] END AS t FROM documents)"""
COMBINED = """y AS (SELECT *, CASE WHEN len(t) > 0 AND t[1] = '' THEN t[2:] ELSE t END AS u FROM x),
    z AS (SELECT *, list_concat(p, CASE WHEN len(p) > 0 AND len(u) > 0 AND p[len(p)] = u[1] THEN u[2:] ELSE u END) AS c
    FROM y)"""


@query("f9_combine_titles", f"WITH {TITLES}, {COMBINED} SELECT doc_id, array_to_string(c, '|') AS titles FROM z")
def f9(t: Tables) -> DataFrame:
    return titles(t).select("doc_id", F.array_join(X.combine_titles(F.col("p"), F.col("t")), "|").alias("titles"))


@query("f11_title_text", f"""WITH {TITLES}, {COMBINED} SELECT doc_id, array_to_string(c, ' ') AS joined,
    array_to_string(c, ' : ') AS old_form FROM z""")
def f11(t: Tables) -> DataFrame:
    c = X.combine_titles(F.col("p"), F.col("t"))
    return titles(t).select("doc_id", X.title_text(c).alias("joined"), X.title_text(c, " : ").alias("old_form"))


SHOWN = "array_to_string(list_concat(p[1:greatest(len(p) - 1, 0)], t), ' -> ')"


@query("f14_display_title", f"WITH {TITLES} SELECT doc_id, {SHOWN} AS title FROM x")
def f14(t: Tables) -> DataFrame:
    return titles(t).select("doc_id", X.display_title(F.col("p"), F.col("t")).alias("title"))


@query("f15_doc_preamble", f"""WITH {TITLES}, a AS (SELECT *, {SHOWN} AS d FROM x),
    b AS (SELECT *, CASE WHEN contains(d, source) THEN d ELSE source || ' -> ' || d END AS e FROM a)
    SELECT doc_id, 'The following reference is about ' || CASE WHEN contains(e, lang) THEN e ELSE lang || ' -> ' || e END
      || E'\\n\\n' || {sql_strip('text')} AS content, text AS original_text FROM b""")
def f15(t: Tables) -> DataFrame:
    title = X.titled_path(X.display_title(F.col("p"), F.col("t")), F.col("source"), F.col("lang"))
    return titles(t).select("doc_id", X.doc_preamble(title, F.col("text")).alias("content"),
                            F.col("text").alias("original_text"))


def link_rows(t: Tables) -> DataFrame:
    """Extracts with links: every third document has none at all."""
    link = F.array(*[F.struct(F.lit(n).alias("title"), F.concat(F.lit(f"https://{n}.example/"), "source").alias("url"),
                              F.col("doc_id").alias("doc_id")) for n in ("one", "two")])
    return t.documents.withColumns({
        "url": F.concat(F.lit("https://d.example/"), F.col("doc_id").cast("string")),
        "parent_titles": F.array("lang"), "titles": F.array("source"),
        "text": F.when(F.col("n_chars") >= 500, F.col("text")),
        "links": F.when(F.col("doc_id") % 3 != 0, link)})


@query("f1_select_text_rows", """SELECT doc_id, 'https://d.example/' || doc_id AS url, lang AS parent_titles,
    source AS titles, text, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 2 END AS n_links FROM documents WHERE n_chars >= 500""")
def f1(t: Tables) -> DataFrame:
    """Short texts count as missing."""
    rows = select_text_rows(link_rows(t))
    return rows.select("doc_id", "url", F.array_join("parent_titles", "|").alias("parent_titles"),
                       F.array_join("titles", "|").alias("titles"), "text",
                       F.when(F.col("links").isNotNull(), F.size("links")).alias("n_links"))


@query("f10_link_urls", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'https://one.example/' || source ||
    '|https://two.example/' || source END AS urls FROM documents""")
def f10(t: Tables) -> DataFrame:
    return link_rows(t).select("doc_id", F.array_join(link_urls(F.col("links")), "|").alias("urls"))


@query("f4_parse_verdict", """WITH x AS (SELECT conv_id, turn, upper(text) AS u FROM conversations),
    y AS (SELECT *, strpos(u, 'EN') AS a, strpos(u, 'IN') AS b FROM x)
    SELECT conv_id, turn, CASE WHEN a > 0 AND b > 0 THEN a < b WHEN a > 0 THEN true ELSE false END AS verdict,
      CASE WHEN a > 0 AND b > 0 THEN a < b WHEN a > 0 THEN true WHEN b > 0 THEN false ELSE true END AS lenient FROM y""")
def f4(t: Tables) -> DataFrame:
    """``EN`` plays yes and ``IN`` plays no: both words are common in the texts, in either order."""
    return t.conversations.select(
        "conv_id", "turn", X.parse_verdict(F.col("text"), False, "EN", "IN").alias("verdict"),
        X.parse_verdict(F.col("text"), True, "EN", "IN").alias("lenient"))


ANSWERS = """x AS (SELECT conv_id, turn, role, CASE WHEN role = 'system' THEN NULL WHEN turn = 3 THEN ''
    WHEN turn = 5 THEN text || ' I do not have the information to answer.' ELSE text END AS answer FROM conversations)"""


def answers(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", "role", F.when(F.col("role") == "system", F.lit(None))
                                  .when(F.col("turn") == 3, "")
                                  .when(F.col("turn") == 5, F.concat("text", F.lit(" " + X.NO_ANSWER + ".")))
                                  .otherwise(F.col("text")).alias("answer"))


@query("f5_empty_answer", f"""WITH {ANSWERS} SELECT conv_id, turn, (answer IS NULL OR answer = '' OR
    contains(answer, 'I do not have the information to answer')) AS is_empty FROM x""")
def f5(t: Tables) -> DataFrame:
    return answers(t).select("conv_id", "turn", X.is_empty_answer(F.col("answer")).alias("is_empty"))


PROFILE = """x AS (SELECT doc_id, CASE WHEN n_chars > 400 THEN lang ELSE '' END AS f, CASE WHEN n_chars > 800 THEN source
    ELSE '' END AS p, CASE WHEN doc_id % 2 = 0 THEN 'Major ' || lang END AS s, CASE WHEN doc_id % 3 = 0 THEN 'year ' || lang
    ELSE '' END AS y, CASE WHEN doc_id % 5 = 0 THEN source ELSE '' END AS topic, text AS q FROM documents)"""


def profiles(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    return t.documents.select(
        "doc_id", F.when(n > 400, F.col("lang")).otherwise("").alias("f"),
        F.when(n > 800, F.col("source")).otherwise("").alias("p"),
        F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("Major "), "lang")).alias("s"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("year "), "lang")).otherwise("").alias("y"),
        F.when(F.col("doc_id") % 5 == 0, F.col("source")).otherwise("").alias("topic"), F.col("text").alias("q"))


COLS = ("f", "p", "s", "y", "topic")


def _if(c: str, said: str, other: str = "''") -> str:
    return f"CASE WHEN coalesce({c}, '') <> '' THEN {said} ELSE {other} END"


@query("f16_question_sentence", f"""WITH {PROFILE} SELECT doc_id, {_if('f', "'I am in ' || f || '. '")} ||
    {_if('p', "'I am in the ' || p || ' program. '")} || {_if('s', "'I am in the ' || s || ' specialization. '")} ||
    {_if('y', "'I am in my ' || y || '. '")} || {_if('topic', "'The topic of the question is ' || topic || '. '")} || q
    AS sentence FROM x""")
def f16(t: Tables) -> DataFrame:
    return profiles(t).select("doc_id", P.question_sentence(*map(F.col, COLS), F.col("q")).alias("sentence"))


SAID = (f"({_if('f', chr(39) + 'I am in ' + chr(39) + ' || f')} || {_if('p', chr(39) + ', ' + chr(39) + ' || p')} || "
        f"{_if('s', chr(39) + ', ' + chr(39) + ' || s')} || {_if('y', chr(39) + ' in ' + chr(39) + ' || y')})")
ABOUT = (f"({_if('s', 's')} || CASE WHEN coalesce(s, '') <> '' AND y <> '' THEN ' in ' ELSE '' END || {_if('y', 'y')})")


@query("f17_program_sentence", f"""WITH {PROFILE}, a AS (SELECT *, CASE WHEN {SAID} = '' THEN '' ELSE {SAID} || '.' END
      AS said, nullif({ABOUT}, '') AS about FROM x)
    SELECT doc_id, said, CASE WHEN topic = '' THEN about ELSE 'the topic ' || topic || CASE WHEN coalesce(s, '') <> ''
      THEN ' for ' || s ELSE '' END || CASE WHEN y <> '' THEN ' in ' || y ELSE '' END END AS context,
      said || ' ' || CASE WHEN topic <> '' THEN 'On the topic of ' || topic || ': ' || q ELSE q END || CASE WHEN about
      IS NULL THEN '' ELSE ' If none of the references are about ' || about ||
      ', say "I do not have the information to answer".' END AS full_question FROM a""")
def f17(t: Tables) -> DataFrame:
    f, p, s, y, topic = map(F.col, COLS)
    return profiles(t).select("doc_id", P.program_sentence(f, p, s, y).alias("said"),
                              P.filter_context(s, y, topic).alias("context"),
                              P.full_question(f, p, s, y, topic, F.col("q")).alias("full_question"))


@query("f18_context_string", f"""WITH {PROFILE} SELECT doc_id, array_to_string(list_filter([f, p, s, y, topic],
    lambda v: coalesce(v, '') <> ''), ' : ') AS context, array_to_string(list_filter([f, p, s, y, topic, q],
    lambda v: coalesce(v, '') <> ''), ' : ') AS search FROM x""")
def f18(t: Tables) -> DataFrame:
    cols = [F.col(c) for c in COLS]
    return profiles(t).select("doc_id", P.context_string(*cols).alias("context"),
                              P.context_string(*cols, F.col("q")).alias("search"))


@query("f20_strip_prompt_echo", """SELECT doc_id, CASE WHEN lang = 'en' THEN substring(text, 21) ELSE
    ' and then ' || text END AS output FROM documents""")
def f20(t: Tables) -> DataFrame:
    """English output repeats its prompt, the first 20 characters; other output does not."""
    prompt = F.substring("text", 1, 20)
    output = F.when(F.col("lang") == "en", F.col("text")).otherwise(F.concat(F.lit(" and then "), "text"))
    return t.documents.select("doc_id", X.strip_prompt_echo(output, prompt).alias("output"))


@query("f21_extract_fields", r"""SELECT doc_id, 'https://d.example/' || doc_id AS url, nullif(regexp_extract(
    'text: ' || text || E'\nlinks: none', 'text:\s*((?:.|\n)*?)(?:\n\w+:\s|$)', 1), '') AS text FROM documents""")
def f21(t: Tables) -> DataFrame:
    row = F.concat(F.lit("url: https://d.example/"), F.col("doc_id").cast("string"), F.lit("\ntext: "), F.col("text"),
                   F.lit("\nlinks: none"))
    return t.documents.select("doc_id", X.extract_field(row, "url").alias("url"), X.extract_field(row, "text").alias("text"))


_MISSPELT = "regexp_replace(question, '([A-Za-z]{3})[A-Za-z]([A-Za-z]{3})', '\\1\\2')"


@query("f22_corrected_query", rf"""WITH v AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w
      FROM documents) WHERE length(w) <= 24 GROUP BY w HAVING count(*) >= 5),
    q AS (SELECT conv_id AS question_id, {_MISSPELT} AS question FROM (SELECT conv_id, arg_min(text, turn) AS question FROM conversations
      WHERE role = 'user' GROUP BY conv_id)),
    l AS (SELECT question_id, question, regexp_extract_all(question, '[A-Za-z]+|[^A-Za-z]+') AS ps FROM q),
    p AS (SELECT question_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM l),
    u AS (SELECT DISTINCT lower(piece) AS word FROM p WHERE regexp_matches(piece, '^[A-Za-z]{{2,24}}$') AND lower(piece) NOT IN (SELECT word FROM v)),
    c AS (SELECT u.word, v.word AS offer, n, levenshtein(u.word, v.word) AS d FROM u JOIN v ON abs(length(u.word) - length(v.word)) <= 2),
    b AS (SELECT word, arg_min(offer, (-n * pow(1000, 2 - d), offer)) AS best FROM c WHERE d <= CASE WHEN length(word) > 4 THEN 2 ELSE 1 END GROUP BY word),
    f AS (SELECT question_id, string_agg(coalesce(CASE WHEN regexp_matches(piece, '^[A-Z]') THEN upper(best[1]) || best[2:] ELSE best END, piece), ''
      ORDER BY i) AS corrected FROM p LEFT JOIN b ON b.word = lower(piece) GROUP BY question_id)
    SELECT question_id, corrected, CASE WHEN lower(question) <> lower(corrected) THEN 'Used spell/grammar corrected query: ' || corrected END AS alert
    FROM f JOIN q USING (question_id)""")
def f22_corrected(t: Tables) -> DataFrame:
    """First user turns with a letter missing in their long words, corrected by the vocabulary of the documents."""
    qs = t.conversations.where("role = 'user'").groupBy(F.col("conv_id").alias("question_id")).agg(F.min_by("text", "turn").alias("question"))
    once = F.regexp_replace("question", "^(?s)(.*?[A-Za-z]{3})[A-Za-z]([A-Za-z]{3})", "$1$2")
    return correct_questions(qs.withColumn("question", once), vocabulary(t.documents, least=5))


@query("f22_spell_changed", """SELECT doc_id, CASE WHEN lang = 'en' OR NOT contains(text, ' ') THEN NULL ELSE
      'Used spell/grammar corrected query: ' || replace(text, ' ', '_') END AS alert,
      CASE WHEN n_chars > 800 THEN 'Did not find answer specific to ' || lang || ', ' || source
        WHEN n_chars > 400 THEN 'Did not find answer specific to ' || lang END AS ignored FROM documents""")
def f22(t: Tables) -> DataFrame:
    """English queries change in the case of their first letter only."""
    corrected = F.when(F.col("lang") == "en", F.concat(F.lower(F.substring("text", 1, 1)), F.expr("substring(text, 2)"))).otherwise(F.replace("text", F.lit(" "), F.lit("_")))
    values = F.filter(F.array(F.when(F.col("n_chars") > 400, F.col("lang")), F.when(F.col("n_chars") > 800, F.col("source"))),
                      lambda v: v.isNotNull())
    return t.documents.select("doc_id", K.spell_alert(F.col("text"), corrected).alias("alert"),
                       K.ignored_alert(values).alias("ignored"))


@query("f23_highlight", r"""SELECT p_partkey, '*' || p_name || '*, ' || p_type || E' and\n*' || p_brand || '*; ' || p_name
    || '?' AS marked FROM part""")
def f23(t: Tables) -> DataFrame:
    """Numbered, quoted and unmatched lines; the brand carries a sign that a pattern would read differently."""
    original = F.concat("p_name", F.lit(", "), "p_type", F.lit(" and\n"), "p_brand", F.lit("; "), "p_name", F.lit("?"))
    compressed = F.concat(F.lit('1. "'), "p_name", F.lit(', "\n\n2. '), "p_brand", F.lit("\nnot there"))
    marked = X.highlight(original, compressed)
    return t.part.select("p_partkey", marked.alias("marked"))


@query("f24_display_text", f"""SELECT doc_id, replace(CASE WHEN starts_with(s, '*') THEN '  ' || s ELSE s END, '    ', E'\\t')
    AS shown FROM (SELECT doc_id, {sql_strip("CASE WHEN doc_id % 2 = 0 THEN ' * ' || lang || '    ' || text ELSE text END")}
    AS s FROM documents)""")
def f24(t: Tables) -> DataFrame:
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" * "), "lang", F.lit("    "), "text")).otherwise(F.col("text"))
    return t.documents.select("doc_id", X.display_text(text).alias("shown"))


@query("f24_display_links", """SELECT p_partkey, 'see [' || p_name || '](https://p.example/' || p_partkey || ') or red, ' ||
    p_type AS shown FROM part""")
def f24_links(t: Tables) -> DataFrame:
    """A link text below four characters stays plain."""
    link = lambda title, url: F.struct(title.alias("title"), url.alias("url"), F.lit(None).cast("long").alias("doc_id"))
    links = F.array(link(F.col("p_name"), F.concat(F.lit("https://p.example/"), F.col("p_partkey").cast("string"))),
                    link(F.lit("red"), F.lit("https://short.example")))
    text = F.concat(F.lit(" see "), "p_name", F.lit(" or red, "), "p_type")
    return t.part.select("p_partkey", X.display_text(text, links).alias("shown"))


@query("j7_related_links", """SELECT p_partkey, array_to_string(list_filter([p_name, p_brand, p_type],
    lambda x: contains('about ' || p_name || ' by ' || p_type, x)), '|') AS related FROM part""")
def j7(t: Tables) -> DataFrame:
    links = F.array(*[F.struct(F.col(c).alias("title"), F.lit("u").alias("url")) for c in ("p_name", "p_brand", "p_type")])
    related = K.related_links(links, F.concat(F.lit("about "), "p_name", F.lit(" by "), "p_type"))
    return t.part.select("p_partkey", F.array_join(related["title"], "|").alias("related"))
