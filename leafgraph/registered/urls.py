"""URLs, links and page hierarchy over ``pages``.

Links are all hrefs of a page. Redirects are derived from the data: an absolute link target redirects to the lowest
page URL on which it occurs, so that links lead to documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.functions import urls as U
from leafgraph.operators import links as L
from leafgraph.operators.parse import SiteConfig, parse_pages
from leafgraph.operators.snapshots import snapshot_difference, write_snapshot
from leafgraph.registered.base import Tables, query, sql_clean_url
from leafgraph.session import materialize, work_dir
from leafgraph.sources.pages import number_pages, scan_sites, write_pages

HOST = "regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)"
HREFS = """hrefs AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href,
    unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS title FROM pages)"""


def hrefs(t: Tables) -> DataFrame:
    return L.page_links(parse_pages(t.pages, SiteConfig())).join(t.pages.select("page_id", "url"), "page_id")


@query("f7_clean_url", f"SELECT page_id, {sql_clean_url('url')} AS clean FROM pages")
def f7(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.clean_url(F.col("url")).alias("clean"))


_DIR = r"regexp_replace(regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1), '[^/]*$', '')"
_ROOT = r"regexp_extract(url, '^(https?://[^/?#]+)', 1)"


@query("f8_absolute_url", f"""WITH {HREFS}, x AS (SELECT DISTINCT page_id, url, href,
      {_ROOT} AS root, {_DIR} AS dir, regexp_replace(url, '[?#].*$', '') AS bare,
      regexp_extract(url, '^([^#]*)', 1) AS page FROM hrefs)
    SELECT page_id, href AS link, {sql_clean_url('root || href')} AS abs FROM x UNION ALL
    SELECT page_id, substring(href, 2), {sql_clean_url('root || dir || substring(href, 2)')} FROM x UNION ALL
    SELECT page_id, '..' || href,
      {sql_clean_url("root || regexp_replace(dir, '[^/]*/$', '') || substring(href, 2)")} FROM x UNION ALL
    SELECT page_id, '#' || substring(href, 2), {sql_clean_url("page || '#' || substring(href, 2)")} FROM x UNION ALL
    SELECT page_id, '?' || substring(href, 2), {sql_clean_url("bare || '?' || substring(href, 2)")} FROM x UNION ALL
    SELECT page_id, '//cdn' || href, '//cdn' || href FROM x""")
def f8(t: Tables) -> DataFrame:
    """Every link in its root-relative, folder-relative, parent-relative, fragment, query and host form."""
    name = F.substring(F.col("href"), 2, F.length("href"))
    forms = F.array(F.col("href"), name, F.concat(F.lit(".."), "href"), F.concat(F.lit("#"), name),
                    F.concat(F.lit("?"), name), F.concat(F.lit("//cdn"), "href"))
    rows = hrefs(t).select("page_id", "url", "href").distinct().select("page_id", "url", F.explode(forms).alias("link"))
    return rows.select("page_id", "link", U.absolute_url(F.col("url"), F.col("link")).alias("abs"))


_BARE = "regexp_replace(url, '^https?://', '')"


@query("s3_path_from_url", rf"""SELECT page_id, replace('/data/dump/' || {_BARE} || '.html', '?', '-') AS path
    FROM pages""")
def s3(t: Tables) -> DataFrame:
    return t.pages.select("page_id", U.path_from_url(F.col("url"), F.lit("/data/dump")).alias("path"))


@query("s2_url_from_path", rf"""SELECT page_id, 'https://root.example/' ||
    replace(replace({_BARE} || '.html', '?', '-'), '.html', '') AS url FROM pages""")
def s2(t: Tables) -> DataFrame:
    path = U.path_from_url(F.col("url"), F.lit("/data/dump"))
    return t.pages.select("page_id", U.url_from_path(path, F.lit("/data/dump"), F.lit("https://root.example"))
                          .alias("url"))


@query("a4_first_doc_per_url", f"SELECT {sql_clean_url('url')} AS clean_url, min(page_id) AS doc_id FROM pages "
                               "GROUP BY 1")
def a4(t: Tables) -> DataFrame:
    return L.first_doc_per_url(t.pages, doc_id="page_id")


@query("a6_allowed_domains", f"SELECT DISTINCT {HOST} AS host FROM pages")
def a6(t: Tables) -> DataFrame:
    return L.allowed_domains(t.pages)


@query("s13_redirect_map", f"SELECT {HOST} AS original, arg_max(url, page_id) AS final FROM pages GROUP BY 1")
def s13(t: Tables) -> DataFrame:
    """Every page of a host is one hop recorded for it; the last one wins."""
    return L.redirect_map(t.pages.select(U.url_host(F.col("url")).alias("original"), F.col("url").alias("final"),
                                         F.col("page_id").alias("seq")))


RESOLVED = f"""{HREFS}, abs AS (SELECT page_id, title, href, {sql_clean_url(_ROOT + " || href")} AS a FROM hrefs),
  redir AS (SELECT a AS original, min({sql_clean_url('url')}) AS final FROM abs JOIN pages USING (page_id) GROUP BY a),
  firsts AS (SELECT {sql_clean_url('url')} AS u, min(page_id) AS doc FROM pages GROUP BY 1),
  res AS (SELECT page_id, title, href, coalesce(final, a) AS target_url FROM abs LEFT JOIN redir ON a = original
      WHERE title NOT LIKE 'a%')"""


def resolved(t: Tables) -> DataFrame:
    links = materialize(hrefs(t), "links")
    absolute = links.select("url", U.absolute_url(F.col("url"), F.col("href")).alias("original"))
    redirects = absolute.groupBy("original").agg(F.min(U.clean_url(F.col("url"))).alias("final"))
    docs = t.pages.select("url", F.col("page_id").alias("doc_id"))
    # links whose text starts with "a" play the ignored ones
    marked = links.withColumn("href", F.when(F.col("title").startswith("a"), F.concat(F.lit("mailto:"), "href"))
                              .otherwise(F.col("href")))
    return L.resolve_links(marked, docs, redirects)


@query("j1_resolve_links", f"""WITH {RESOLVED} SELECT page_id, title, href, target_url, doc AS target_doc_id
    FROM res LEFT JOIN firsts ON u = {sql_clean_url('target_url')}""")
def j1(t: Tables) -> DataFrame:
    return resolved(t).select("page_id", "title", "href", "target_url", "target_doc_id")


@query("j2_link_edges", f"""WITH {RESOLVED} SELECT DISTINCT page_id AS src, doc AS dst, 3::INTEGER AS type
    FROM res JOIN firsts ON u = {sql_clean_url('target_url')}""")
def j2(t: Tables) -> DataFrame:
    return L.link_edges(resolved(t), doc_id="page_id")


NOTES = [(0, "blog.", "Blog", "a personal page"), (1, ".example.org", "Organisation", "run by volunteers"),
         (2, "cheap-pills", "Shop", "an advertiser"), (3, "/en", "xx", "English pages"), (4, "/fr/", "French", "in French")]


@query("j8_source_annotation", """SELECT page_id, CASE WHEN contains(url, '/fr/') THEN 'French: in French'
      WHEN contains(url, 'cheap-pills') THEN 'Shop: an advertiser'
      WHEN contains(url, '.example.org') THEN 'Organisation: run by volunteers'
      WHEN contains(url, 'blog.') THEN 'Blog: a personal page' END AS source
    FROM pages WHERE contains(url, '/fr/') OR contains(url, 'cheap-pills') OR contains(url, '.example.org')
      OR contains(url, 'blog.')""")
def j8(t: Tables) -> DataFrame:
    """The key ``/en`` is too short and ignored."""
    notes = t.spark.createDataFrame(NOTES, "key_order int, key string, name string, annotation string")
    return L.source_annotation(t.pages, notes, id="page_id")


TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"


@query("j10_page_hierarchy", f"""WITH x AS (SELECT page_id, page_id::VARCHAR AS s, {TITLE} AS title FROM pages),
    up AS (SELECT page_id, s, unnest(range(1, length(s) + 1)) AS n FROM x)
    SELECT up.page_id, CASE WHEN up.page_id >= 10 THEN up.page_id // 10 END AS parent_page_id,
      string_agg(a.title, ' > ' ORDER BY n) AS parent_titles
    FROM up JOIN x a ON a.s = substring(up.s, 1, n) GROUP BY up.page_id""")
def j10(t: Tables) -> DataFrame:
    """Page 123 lies at /1/12/123, so that folders have pages."""
    s = F.col("page_id").cast("string")
    path = F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), lambda n: F.substring(s, F.lit(1), n)), "/")
    rows = t.pages.select("page_id", F.concat(F.lit("https://site.example/"), path).alias("url"),
                          F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("page_title"))
    return L.page_hierarchy(rows).select("page_id", "parent_page_id",
                                         F.array_join("parent_titles", " > ").alias("parent_titles"))


@query("s12_recrawl_select", rf"""WITH f AS (SELECT url, page_id, {HOST} AS h,
      TIMESTAMP '2024-01-01' + to_minutes(page_id) AS m FROM pages),
    st AS (SELECT DISTINCT regexp_extract(url, '^(https?://(?:www|blog)\.[^/]+/e)', 1) AS s,
      regexp_extract(url, '^https?://((?:www|blog)\.[^/]+)/e', 1) AS h FROM pages),
    old AS (SELECT url, max(TIMESTAMP '2024-01-01' + to_minutes((page_id * 7) % 1440)) AS fm FROM pages
      WHERE contains(url, '?') GROUP BY url)
    SELECT f.page_id, f.url FROM f LEFT JOIN old ON old.url = f.url
    WHERE EXISTS (SELECT 1 FROM st WHERE s <> '' AND st.h = f.h AND starts_with(f.url, s))
      AND coalesce(m >= fm, true) AND NOT regexp_matches(lower(regexp_replace(f.url, '[?#].*$', '')),
      '\.(css|png|jpg|xml|gif|ico|pdf)$')""")
def s12(t: Tables) -> DataFrame:
    """Start URLs are the e... folders of www and blog hosts; pages with a query string are stored already."""
    day = F.lit("2024-01-01").cast("timestamp")
    minutes = lambda n: F.make_dt_interval(mins=n.cast("int"))
    start = F.regexp_extract("url", r"^(https?://(?:www|blog)\.[^/]+/e)", 1)
    starts = t.pages.select(start.alias("url")).where("url <> ''").distinct()
    stored = t.pages.where(F.contains("url", F.lit("?"))).groupBy("url").agg(
        F.max(day + minutes((F.col("page_id") * 7) % 1440)).alias("file_modified"))
    found = t.pages.select("page_id", "url", (day + minutes(F.col("page_id"))).alias("site_modified"))
    kept = L.recrawl_select(found.select("url", "site_modified"), starts, stored)
    return found.join(kept, ["url", "site_modified"], "left_semi").select("page_id", "url")


@query("s14_snapshot_changed", """SELECT doc_id, 'removed' AS side FROM documents WHERE lang = 'fr' UNION ALL
    SELECT doc_id, 'added' FROM documents WHERE lang = 'fr'""")
def s14(t: Tables) -> DataFrame:
    """The new snapshot differs in every French text."""
    old = t.documents.select("doc_id", F.md5("text").alias("digest"))
    new = t.documents.select("doc_id", F.md5(F.when(F.col("lang") == "fr", F.concat("text", F.lit("!")))
                                             .otherwise(F.col("text"))).alias("digest"))
    return L.snapshot_changed(old, new).select("doc_id", "side")


@query("s14_bucket_digests", """SELECT doc_id, 'removed' AS side FROM documents WHERE doc_id % 97 = 5 UNION ALL
    SELECT doc_id, 'added' FROM documents WHERE doc_id % 97 = 5 UNION ALL SELECT doc_id, 'removed' FROM documents WHERE doc_id % 97 = 6""")
def s14_buckets(t: Tables) -> DataFrame:
    """Two stored snapshots: some texts are new, some documents gone; only the buckets of these are read."""
    base = work_dir(t.spark, "snapshots")
    n = F.col("doc_id") % 97
    new = t.documents.where(n != 6).withColumn("text", F.when(n == 5, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    for name, rows in (("old", t.documents), ("new", new)):
        write_snapshot(rows, f"{base}/{name}", "doc_id", buckets=128)
    return snapshot_difference(t.spark, f"{base}/old", f"{base}/new").select("doc_id", "side")


@query("s1_scan_pages", """SELECT page_id AS page, CASE WHEN page_id % 3 = 0 THEN 'notes' ELSE 'docs' END AS site,
      'https://s.example/' || CASE WHEN page_id % 3 = 0 THEN 'docs/notes/' ELSE 'docs/' END || page_id AS url, md5(html) AS digest,
      length(html) AS n, true AS named, row_number() OVER (ORDER BY 'https://s.example/' ||
      CASE WHEN page_id % 3 = 0 THEN 'docs/notes/' ELSE 'docs/' END || page_id) AS page_no
    FROM pages""")
def s1(t: Tables) -> DataFrame:
    """Every page is stored as a file of one of two sites, one inside the other; both are scanned at once and numbered."""
    base = work_dir(t.spark, "dump")
    folder = F.when(F.col("page_id") % 3 == 0, "docs/notes/").otherwise("docs/")
    url = F.concat(F.lit("https://s.example/"), folder, F.col("page_id").cast("string"))
    files = t.pages.select(U.path_from_url(url, F.lit(base)).alias("path"), "html")
    materialize(write_pages(files), "written")
    sites = {"docs": SiteConfig(base_url="https://s.example/docs"), "notes": SiteConfig(base_url="https://s.example/docs/notes/")}
    rows = number_pages(materialize(scan_sites(t.spark, base, sites), "scanned"))
    own = F.xxhash64("url", "site")
    return rows.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("page"), "site", "url", F.md5("html").alias("digest"),
                       F.length("html").cast("long").alias("n"), (F.col("page_id") == own).alias("named"), "page_no")
