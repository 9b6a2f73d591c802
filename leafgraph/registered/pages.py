"""Page parsing and the section tree.

``pages`` are the raw pages (one ``article`` and one ``h1`` each). Headings below h1, anchors, links in text and
conditional splits do not occur there, so those operators run on pages that Spark derives from ``part``, one small
html page per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.functions.registry import register
from leafgraph.functions.text import clean_text
from leafgraph.operators import extracts as X
from leafgraph.operators.parse import SiteConfig, page_titles, parse_pages
from leafgraph.operators.sections import acceptable_heads, build_sections
from leafgraph.registered.base import Tables, query, sql_squeeze, squeeze
from leafgraph.session import deal_out, follow

ARTICLE = SiteConfig(name="pages", main_content_attrs={"name": "article"})


def sql_text(e: str) -> str:
    """Text of a piece of page html: inline tags go, others part words, entities are decoded.

    Some headings are cut inside an entity; html reads ``&amp`` and ``&quot`` without their semicolon too.
    """
    e = f"regexp_replace({e}, '</?b>', '', 'g')"
    e = f"regexp_replace({e}, '<[^>]*>', ' ', 'g')"
    return sql_squeeze(f"regexp_replace(regexp_replace({e}, '&quot;?', '\"', 'g'), '&amp;?', '&', 'g')")


_ARTICLE = "regexp_extract(html, '<article>(.*)</article>', 1, 's')"
_H1 = "regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')"
_REST = "regexp_extract(html, '</h1>(.*)</article>', 1, 's')"


def main_text(t: Tables, config: SiteConfig) -> DataFrame:
    rows = parse_pages(t.pages, config).where(F.col("body").isNotNull())
    return rows.groupBy("page_id").agg(squeeze(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), " ")).alias("body"))


@query("h1_main_content", f"SELECT page_id, {sql_text(_ARTICLE)} AS body FROM pages")
def h1(t: Tables) -> DataFrame:
    return main_text(t, ARTICLE)


@query("h2_drop_elements", f"SELECT page_id, {sql_text(_ARTICLE)} AS body FROM pages")
def h2(t: Tables) -> DataFrame:
    """The whole page without navigation, ads and footer is the article."""
    return main_text(t, SiteConfig(remove_tag_attrs=({"name": "nav"}, {"class": "ad"}, {"name": "footer"})))


@query("h4_page_title", f"SELECT page_id, {sql_text(_H1)} AS page_title FROM pages")
def h4(t: Tables) -> DataFrame:
    return page_titles(parse_pages(t.pages, SiteConfig())).select("page_id", squeeze(F.col("page_title"))
                                                                  .alias("page_title"))


def shown(sections: DataFrame) -> DataFrame:
    return sections.select("page_id", F.array_join("titles", " / ").alias("path"), squeeze(F.col("text")).alias("body"),
                           F.col("anchor"))


@query("h5_split_by_heading", f"""SELECT page_id, {sql_text(_H1)} AS path,
    {sql_squeeze(f"regexp_replace({sql_text(_REST)}, '#+', '', 'g')")} AS body, NULL::VARCHAR AS anchor FROM pages""")
def h5(t: Tables) -> DataFrame:
    rows = shown(build_sections(parse_pages(t.pages, ARTICLE), ARTICLE))
    return rows.withColumn("path", squeeze(F.col("path")))


@query("e3_drop_empty", """SELECT page_id, (len(string_split(html, '<h1>')) - 1)::BIGINT AS n_sections FROM pages""")
def e3(t: Tables) -> DataFrame:
    """The blank section before the first heading is dropped."""
    return build_sections(parse_pages(t.pages, ARTICLE), ARTICLE).groupBy("page_id").agg(
        F.count("*").alias("n_sections"))


PAGES_PER_TASK = 5000  # some seconds of parsing
MAIN = SiteConfig(name="parts", base_url="https://parts.example", main_content_attrs={"id": "main"})
_BRAND = "replace(p_brand, '#', '-')"


def html_of(t: Tables, *pieces: str) -> DataFrame:
    """One page per part from html text with ``{name}``, ``{brand}``, ``{type}``, ``{size}`` and ``{price}``."""
    names = {"name": F.col("p_name"), "brand": F.replace("p_brand", F.lit("#"), F.lit("-")), "type": F.col("p_type"),
             "size": F.col("p_size").cast("string"), "price": F.col("p_retailprice").cast("long").cast("string")}
    html = F.lit("".join(pieces))
    for name, value in names.items():
        html = F.replace(html, F.lit("{" + name + "}"), value)
    parts = deal_out(t.part, PAGES_PER_TASK)
    return follow(parts.select(F.col("p_partkey").alias("page_id"), html.alias("html")), parts)


PART_PAGE = (
    '<html><head><title>x</title></head><body><div id="main">lead {type}<h1>{name}</h1>\n',
    'intro below {brand} <a href="/b/{brand}">{brand}</a><a id="s{size}"></a>',
    "<h2>Type</h2>type {type}<h3>Size</h3>size {size}<h3> </h3>",
    '<h2><a href="/x">Linked</a></h2> more <a name="price"></a>',
    "<h2>Price</h2><p>cost {price}</p><h2>Last</h2><div>fin</div></div><footer>foot</footer></body></html>")


def part_pages(t: Tables) -> DataFrame:
    return html_of(t, *PART_PAGE)


def part_sections(t: Tables) -> DataFrame:
    return build_sections(parse_pages(part_pages(t), MAIN), MAIN)


PARTS = f"""p AS (SELECT p_partkey AS page_id, p_name AS name, {_BRAND} AS brand, p_type AS type,
    p_size::VARCHAR AS size, p_retailprice::BIGINT::VARCHAR AS price, p_size FROM (SELECT * REPLACE (
    floor(p_retailprice) AS p_retailprice) FROM part)),
  s AS (SELECT page_id, '' AS path, 'lead ' || type AS body, NULL::VARCHAR AS anchor, 0 AS n, NULL::BIGINT AS up FROM p UNION ALL
    SELECT page_id, name, 'intro below ' || brand || ' ' || brand, NULL, 1, NULL FROM p UNION ALL
    SELECT page_id, name || ' / Type', 'type ' || type, 's' || size, 2, 1 FROM p UNION ALL
    SELECT page_id, name || ' / Type / Size', 'size ' || size || ' Linked more', 's' || size, 3, 2 FROM p UNION ALL
    SELECT page_id, name || ' / Price', 'cost ' || price, 'price', 4, 1 FROM p UNION ALL
    SELECT page_id, name || ' / Last', 'fin', 'price', 5, 1 FROM p)"""


@query("h5_split_nested", f"WITH {PARTS} SELECT page_id, path, body, anchor FROM s")
def h5_nested(t: Tables) -> DataFrame:
    return shown(part_sections(t))


@query("e4_section_titles", f"WITH {PARTS} SELECT page_id, path, len(string_split(path, ' / '))::INTEGER AS depth FROM s")
def e4(t: Tables) -> DataFrame:
    return part_sections(t).select("page_id", F.array_join("titles", " / ").alias("path"),
                                   F.size("titles").alias("depth"))


@query("h6_conditional_split", f"""WITH {PARTS}
    SELECT page_id, name AS path, CASE WHEN 5 * p_size + 8 > 100 THEN trim(repeat('word ', p_size))
      ELSE trim(repeat('word ', p_size)) || ' Part tail' END AS body, NULL::VARCHAR AS anchor FROM p UNION ALL
    SELECT page_id, name || ' / Part', 'tail', NULL FROM p WHERE 5 * p_size + 8 > 100""")
def h6(t: Tables) -> DataFrame:
    """The second level splits only where the first-level section is longer than 100 characters."""
    config = SiteConfig(split_attrs=({"name": "h1"}, {"name": "h2"}), mandatory_splits=0, max_extract_len=100)
    base = html_of(t, "<h1>{name}</h1>@@<h2>Part</h2>tail")
    sized = base.join(t.part.select(F.col("p_partkey").alias("page_id"), "p_size"), "page_id")
    pages = sized.select("page_id", F.replace("html", F.lit("@@"), F.repeat(F.lit("word "), F.col("p_size")))
                         .alias("html"))
    return shown(build_sections(parse_pages(follow(pages, base), config), config))


@query("h7_split_tag_predicate", f"""WITH {PARTS} SELECT page_id, h.t AS heading, h.ok AS accepted FROM (
    SELECT page_id, unnest([{{t: name, ok: true}}, {{t: 'Type', ok: true}}, {{t: 'Size', ok: true}}, {{t: '', ok: false}},
      {{t: 'Linked', ok: false}}, {{t: 'Price', ok: true}}, {{t: 'Last', ok: true}}]) AS h FROM p)""")
def h7(t: Tables) -> DataFrame:
    rows = parse_pages(part_pages(t), MAIN).where(F.col("kind") == "head")
    return rows.select("page_id", F.col("text").alias("heading"), acceptable_heads(MAIN).alias("accepted"))


@query("h8_named_split_predicates", f"""WITH {PARTS} SELECT page_id, h.t AS heading, h.ok AS accepted FROM (
    SELECT page_id, unnest([{{t: name, ok: true}}, {{t: brand, ok: false}}, {{t: 'In ' || size, ok: false}},
      {{t: 'H ' || type, ok: true}}, {{t: size, ok: true}}]) AS h FROM p)""")
def h8(t: Tables) -> DataFrame:
    config = SiteConfig(split_attrs=({"function": "is_h3_or_split_class"}, {"function": "strong_tag_title"}))
    pages = html_of(t, "<p><strong>{name}</strong></p><ul><li><strong>{brand}</strong></li></ul>",
                    "<p><strong>In {size}</strong> tail</p><h3>H {type}</h3>",
                    '<div class="note extractor-split">{size}</div>')
    rows = parse_pages(pages, config).where(F.col("kind") == "head")
    return rows.select("page_id", F.col("text").alias("heading"), acceptable_heads(config).alias("accepted"))


@query("h9_untitled_split", f"""WITH {PARTS} SELECT page_id, replace(replace(replace(path, 'Type', '1'), 'Price', '2'),
    'Last', '3') AS path, body, anchor FROM s""")
def h9(t: Tables) -> DataFrame:
    """Second-level headings are numbered instead of titled."""
    config = SiteConfig(main_content_attrs={"id": "main"}, no_title_splits=(1,))
    return shown(build_sections(parse_pages(part_pages(t), config), config))


@query("h10_html_to_text", r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text,
    '\n{2,}', E'\n\n', 'g'), '([\p{L}\p{N}_])\n([\p{L}\p{N}_])', '\1 \2', 'g'), '([\p{L}\p{N}_])\n([\p{L}\p{N}_])',
    '\1 \2', 'g'), '#+', '', 'g') AS text FROM documents""")
def h10(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", clean_text(F.col("text")).alias("text"))


@query("h11_section_links", f"""WITH {PARTS} SELECT page_id, name AS path, brand AS title, '/b/' || brand AS href FROM p
    UNION ALL SELECT page_id, name || ' / Type / Size', 'Linked', '/x' FROM p""")
def h11(t: Tables) -> DataFrame:
    return part_sections(t).select("page_id", F.array_join("titles", " / ").alias("path"), F.inline("links")).drop("pos")


@query("h11_page_links", """SELECT page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS title,
    unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href FROM pages""")
def h11_pages(t: Tables) -> DataFrame:
    rows = parse_pages(t.pages, SiteConfig()).where(F.col("kind") == "link")
    return rows.select("page_id", F.col("text").alias("title"), "href")


@query("e2_merge_intro", f"""WITH {PARTS} SELECT page_id, name AS path, '' AS body, NULL::VARCHAR AS anchor FROM p UNION ALL
    SELECT page_id, name || ' / Intro', brand, NULL FROM p UNION ALL
    SELECT page_id, name || ' / Intro / deep', 'dd ' || size, NULL FROM p UNION ALL
    SELECT page_id, name || ' / mid', 'mm', NULL FROM p""")
def e2(t: Tables) -> DataFrame:
    """A third-level heading before the first second-level one hangs below an ``Intro``."""
    pages = html_of(t, "<h1>{name}</h1>{brand}<h3>deep</h3>dd {size}<h2>mid</h2>mm")
    return shown(build_sections(parse_pages(pages, SiteConfig()), SiteConfig()))


def part_extracts(t: Tables, config: SiteConfig = MAIN) -> DataFrame:
    facts = t.part.select(
        F.col("p_partkey").alias("page_id"),
        F.concat(F.lit("https://parts.example/p/"), F.col("p_partkey").cast("string"), F.lit("#top")).alias("url"),
        F.array("p_name").alias("parent_titles"), F.lit(-1).cast("long").alias("parent_page_doc"))
    return X.build_extracts(part_sections(t), facts, config)


@query("e5_anchor_url", f"""WITH {PARTS} SELECT page_id, path, 'https://parts.example/p/' || page_id || '#' ||
    coalesce(anchor, 'top') AS url FROM s""")
def e5(t: Tables) -> DataFrame:
    return part_extracts(t).select("page_id", F.array_join("titles", " / ").alias("path"), "url")


@query("e10_chunk_links", f"""WITH {PARTS} SELECT page_id, 0::INTEGER AS split_idx, 'First' || size AS title, '/a' AS href
    FROM p UNION ALL SELECT page_id, 1, 'Second' || size, '/b' FROM p""")
def e10(t: Tables) -> DataFrame:
    config = SiteConfig(name="parts", max_extract_len=40)
    pages = html_of(t, '<h1>t</h1><a href="/a">First{size}</a>. ' + "x" * 30 + '. <a href="/b">Second{size}</a>.')
    facts = pages.select("page_id", F.lit("https://parts.example").alias("url"), F.array().cast("array<string>")
                         .alias("parent_titles"), F.lit(-1).cast("long").alias("parent_page_doc"))
    rows = X.build_extracts(build_sections(parse_pages(pages, config), config), facts, config)
    return rows.select("page_id", "split_idx", F.inline("links")).drop("pos")


@query("e12_parent_context", f"""WITH {PARTS} SELECT page_id, path, CASE WHEN up = 1 THEN 'intro below ' || brand || ' '
    || brand END AS context FROM s JOIN p USING (page_id)""")
def e12(t: Tables) -> DataFrame:
    config = SiteConfig(name="parts", main_content_attrs={"id": "main"},
                        parent_context_extractor="parent_context_extractor")
    return part_extracts(t, config).select("page_id", F.array_join("titles", " / ").alias("path"),
                                           squeeze(F.col("context")).alias("context"))


def price_context(text):
    """A context rule of our own, to be named in a configuration."""
    return F.when(F.contains(text, F.lit("type")), F.upper(squeeze(text)))


@query("u1_function_registry", f"""WITH {PARTS} SELECT page_id, path, CASE WHEN up = 2 THEN upper('type ' || type) END
    AS context FROM s JOIN p USING (page_id)""")
def u1(t: Tables) -> DataFrame:
    """A registered function is found by the name in the configuration."""
    register("context", "price_context", price_context)
    config = SiteConfig(name="parts", main_content_attrs={"id": "main"}, parent_context_extractor="price_context")
    return part_extracts(t, config).select("page_id", F.array_join("titles", " / ").alias("path"), "context")


@query("e14_site_constants", f"""WITH {PARTS} SELECT page_id, path, 'Faculty of Parts' AS faculty, NULL::VARCHAR AS program,
    'north' AS campus FROM s""")
def e14(t: Tables) -> DataFrame:
    config = SiteConfig(name="parts", metadata={"faculty": "Faculty of Parts", "campus": "north"},
                        metadata_extractor="default_extract_metadata")
    return part_extracts(t, config).select("page_id", F.array_join("titles", " / ").alias("path"), "faculty", "program",
                                           F.col("meta")["campus"].alias("campus"))


@query("e11_relations_nested", f"""WITH {PARTS}, d AS (SELECT s.*, page_id * 1048576 + n AS id,
      lag(page_id * 1048576 + n) OVER (PARTITION BY page_id, coalesce(up, -1) ORDER BY n) AS prev FROM s)
    SELECT coalesce(page_id * 1048576 + up, -1) AS src, id AS dst, CASE WHEN up IS NULL THEN 1 ELSE 2 END AS type FROM d
    UNION ALL SELECT prev, id, 4 FROM d WHERE prev IS NOT NULL""")
def e11_nested(t: Tables) -> DataFrame:
    return X.relations(part_extracts(t))


@query("w3_previous_sibling", f"""WITH {PARTS} SELECT page_id * 1048576 + n AS doc_id, lag(page_id * 1048576 + n) OVER (
    PARTITION BY page_id, coalesce(up, -1) ORDER BY n) AS previous_id FROM s""")
def w3(t: Tables) -> DataFrame:
    return X.previous_sibling(part_extracts(t))


@query("e13_extract_metadata", r"""WITH d AS (SELECT doc_id, list_concat([lang || ' Program'], string_split(text, E'\n')) AS t
      FROM documents),
    m AS (SELECT doc_id, list_filter(t, lambda x: regexp_matches(x, '^((The|Of).+|.+(ing\.))$')) AS f,
      list_filter(t, lambda x: regexp_matches(x, '^((\w+\s)?(Master of).+|.+(Program))$')) AS p,
      list_filter(t, lambda x: regexp_matches(x, '^((Major|In).+|.+(Minor|es\.))$')) AS s FROM d)
    SELECT doc_id, f[1] AS faculty, p[1] AS program, CASE WHEN len(s) > 0 THEN array_to_string(s, '|') END AS specialization
    FROM m""")
def e13(t: Tables) -> DataFrame:
    """The lines of a document are its titles; the rules are written for its vocabulary."""
    rules = X.TitleRules(X.title_pattern(("The", "Of"), (r"ing\.",)),
                         X.title_pattern(("Master of",), ("Program",), before=r"(\w+\s)?"),
                         X.title_pattern(("Major", "In"), ("Minor", r"es\.")))
    found = X.title_metadata(F.array(F.concat("lang", F.lit(" Program"))), F.split("text", "\n"), rules)
    return t.documents.select("doc_id", found["faculty"].alias("faculty"), found["program"].alias("program"),
                              F.array_join(found["specialization"], "|").alias("specialization"))


@query("e13_shipped_patterns", """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'The Faculty of ' || lang WHEN 1 THEN lang || ' Colleges'
      ELSE 'The School of ' || source END AS faculty,
    CASE WHEN doc_id % 2 = 0 THEN 'Dual Bachelor of ' || lang ELSE source || ' Programs' END AS program,
    CASE WHEN doc_id % 4 < 2 THEN 'Combined Major: ' || lang || '|' || source || ' Minor' ELSE 'Honours ' || lang END AS specialization
    FROM documents""")
def e13_shipped(t: Tables) -> DataFrame:
    """Titles of the kind that the default patterns are made for, among others that none of them matches."""
    n = F.col("doc_id")
    lit = lambda a, c, b="": F.concat(F.lit(a), F.col(c), F.lit(b))
    faculty = F.when(n % 3 == 0, lit("The Faculty of ", "lang")).when(n % 3 == 1, lit("", "lang", " Colleges")).otherwise(
        lit("The School of ", "source"))
    program = F.when(n % 2 == 0, lit("Dual Bachelor of ", "lang")).otherwise(lit("", "source", " Programs"))
    specs = F.when(n % 4 < 2, F.array(lit("Combined Major: ", "lang"), F.lit("Overview"), lit("", "source", " Minor"))).otherwise(
        F.array(lit("Honours ", "lang")))
    found = X.title_metadata(F.array(F.lit("Home"), faculty), F.concat(F.array(program), specs, F.array(F.lit("Courses in brief"))))
    return t.documents.select("doc_id", found["faculty"].alias("faculty"), found["program"].alias("program"),
                              F.array_join(found["specialization"], "|").alias("specialization"))
