"""Main text of pages by template deduction over equivalence classes of tokens.

Tokens are the tags of a page, told apart by name, attributes that name a role (class, id, role) and the path of enclosing
tags, and its runs of text. Over the pages of a host, tokens with the same occurrence vector (as often on each page) form an
equivalence class. A class is valid if it occurs on enough pages, and is made by the template rather than by chance if it has
enough members. Valid classes nest: the tags of one lie between those of another. Together they are the host's template, and
what the template doesn't hold are the slots.

The slot that carries the article is inside the template's ``article`` or ``main`` elements (all of the same path) or, on
hosts without one, inside the template element, once on a page, that holds the most text, boilerplate aside. Within it, what
belongs to boilerplate elements is left out, and so are runs of text that belong to the template, but not headings, and only
if a good part (``OWN``) of the page's slot and of the host's text is not on most pages: else this is an article that many
pages hold copies of. Hosts with too few pages for
a template are read with the tags' own meaning alone.

An occurrence vector isn't collected: a token is represented by the sum of (hash of the page x number of occurrences) over
the host's pages, which equal vectors share, summed in the map tasks before the shuffle. So a host with a third of all pages
is as many rows as it has distinct tokens. A host's template is no larger than a few of its pages, as each token of it
stands on a good part of them.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.llm.host_reputation import host_of
from leafgraph.session import materialize

LEAST_PAGES = 3
SUPPORT = 0.6        # of a host's pages that have a tag of the template
LEAST_PAGES_TEXT, SUPPORT_TEXT = 10, 0.9  # the same for runs of text, which copies of an article share as well
OWN = 0.25           # of a page's and of a host's text that is its own, or else repeated runs are an article's copies
LEAST_MEMBERS = 2    # tokens of a class

#: text, or a tag's slash, name and attributes, or a lone sign; comments and declarations leave all empty
_TOKEN = re.compile(r"""([^<]+)|<(?:(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:(?:"[^"]*+"|'[^']*+')[^>"']*+)*+)>|!--.*?(?:-->|\Z)|[!?][^>]*+>)"""
                    r"""|(<)""", re.S)
#: The same for pages with stray quotes, where a tag ends at its first closing sign.
_LOOSE = re.compile(r"""([^<]+)|<(?:(/?)([a-zA-Z][^\s/>]*)([^>]*+)>|!--.*?(?:-->|\Z)|[!?][^>]*+>)|(<)""", re.S)
FAILED = 20  # tags of a page that don't close with their quotes, after which quotes are ignored
_ROLE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
#: Where the content of an element ends that is text, whatever signs are in it.
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I)
            for name in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}
DEPTH = 12  # levels of the path that tells tags apart
OUTER = {"article", "main", "table", "body", "html", "div", "section"}
HOLDING = {"article", "main", "table"}  # not closed by the end of another element, unless it is one of OUTER
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
            "form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th "
            "thead tr ul".split())
DROPPED = set("nav footer aside form script style noscript template iframe svg button select textarea input label "
              "option dialog object embed canvas audio video title head menu xmp".split())
#: Ids that mark boilerplate inside an article, as a whole; their words don't, as ids of headings are made of what they say.
IDS = set("comments comment-list comments-list commentlist disqus_thread respond sidebar newsletter cookie-notice breadcrumbs "
          "share sharing social related-posts related-links toolbar pagination".split())
#: Words in a class or role that mark boilerplate, and outside an article in an id.
MARKS = set("ad ads adv advert advertisement advertising adverts adbox adslot banner sponsor sponsored promo promotion "
            "sidebar sidebars rail widget menu nav navbar navigation breadcrumb breadcrumbs header masthead footer cookie "
            "cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup login form "
            "search share sharing social related recommended comment comments reply replies discussion disqus respond "
            "skip toolbar pagination pager complementary contentinfo".split())


class Page:
    """Elements of a page in document order, and its runs of text.

    Of each element: ``label`` (name and roles), ``path`` (labels of the first ``DEPTH`` levels), ``parent`` (number, -1 for
    none), ``level``. A run has its text, the number of its innermost element and the number of its block.
    """

    def __init__(self, source: str):
        self.label: list[str] = []
        self.path: list[str] = []
        self.parent: list[int] = []
        self.level: list[int] = []
        self.runs: list[tuple[str, int, int]] = []
        self._parse(source)

    def _open(self, label: str, parent: int) -> int:
        level = self.level[parent] + 1 if parent >= 0 else 0
        above = self.path[parent] if parent >= 0 else ""
        self.label.append(label)
        self.parent.append(parent)
        self.level.append(level)
        self.path.append(above if level >= DEPTH else f"{above}/{label}" if above else label)
        return len(self.label) - 1

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int]] = []
        at, block, skip = -1, 0, ""
        for text, slash, name, attributes, sign in _tokens(source):
            if skip:
                if slash and name.lower() == skip:
                    skip = ""
                continue
            if text or sign:
                self.runs.append((text or sign, at, block))
                continue
            if not name:
                continue
            name = name.lower()
            if name in BLOCK:
                block += 1
            elif name == "br":
                self.runs.append((" ", at, block))
            if slash:
                depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
                if depth is not None and (name in OUTER or not any(n in HOLDING for n, _ in stack[depth + 1:])):
                    del stack[depth:]
                    at = stack[-1][1] if stack else -1
                continue
            whole = attributes.endswith("/")
            if name in _RAW_END:  # what follows is its end tag
                continue
            if name in RAW:
                skip = "" if whole and name == "svg" else name
                continue
            if name in BLOCK:  # an open paragraph ends where a block begins
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] in BLOCK:
                        break
            if name == "li" and stack and stack[-1][0] == "li":
                stack.pop()
            at = stack[-1][1] if stack else -1
            if name in VOID or whole:
                continue
            label = name
            if attributes:
                roles = sorted(f"{k.lower()}={v.strip(chr(34) + chr(39)).lower()}" for k, v in _ROLE.findall(attributes))
                label = " ".join([name, *roles])
            at = self._open(label, at)
            stack.append((name, at))

    def marked(self) -> list[bool]:
        """Of each element: whether it or one around it is boilerplate."""
        out: list[bool] = []
        for label, parent in zip(self.label, self.parent):
            out.append(parent >= 0 and out[parent] or boilerplate(label, False))
        return out

    def tokens(self) -> Counter:
        """Template token -> occurrences: tags by path, text runs by a hash of content and innermost element."""
        found = Counter(self.path)
        for text, at, _ in self.runs:
            text = " ".join(text.split())
            if text:
                found[self._run_token(text, at)] += 1
        return found

    def _run_token(self, text: str, at: int) -> str:
        return "=" + token_hash((self.path[at] if at >= 0 else "") + "=" + text)

    def sizes(self) -> Counter:
        """Token -> characters of text in it or below it, outside boilerplate."""
        own = [0] * len(self.label)
        marked = self.marked()
        found: Counter = Counter()
        for text, at, _ in self.runs:
            if at >= 0 and not marked[at]:
                own[at] += len(text)
                if not text.isspace():
                    found[self._run_token(" ".join(text.split()), at)] += len(text)
        for n in range(len(own) - 1, -1, -1):
            if self.parent[n] >= 0:
                own[self.parent[n]] += own[n]
        for path, size in zip(self.path, own):
            found[path] += size
        return found

    def extract(self, template: set[str], main: str | None, common: set[str]) -> str:
        """The article's blocks joined by line ends; ``common`` are runs of text of most pages."""
        mains = self._mains(main)
        inside, dropped = [], []
        for n, (label, parent) in enumerate(zip(self.label, self.parent)):
            within = parent >= 0 and inside[parent]
            inside.append(within or n in mains)
            if n in mains and not within:
                dropped.append(False)
            elif not mains:
                dropped.append(parent >= 0 and dropped[parent] or boilerplate(label, False))
            else:
                dropped.append(within and (dropped[parent] or boilerplate(label, True)))
        runs, fixed, own, whole = [], [], 0, 0
        heading = self._headings()
        for text, at, block in self.runs:
            if mains and (at < 0 or not inside[at]) or at >= 0 and dropped[at]:
                continue
            plain = " ".join(text.split())
            runs.append((text, block))
            token = self._run_token(plain, at) if common and plain else ""
            fixed.append(token in template and not (at >= 0 and heading[at]))
            whole += len(plain)
            own += 0 if token in common else len(plain)
        if own < OWN * whole:  # a copy of what other pages hold
            fixed = [False] * len(runs)
        blocks: dict[int, list[str]] = {}
        for (text, block), gone in zip(runs, fixed):
            if not gone:
                blocks.setdefault(block, []).append(text)
        lines = (" ".join(html.unescape("".join(parts)).split()) for _, parts in sorted(blocks.items()))
        return "\n".join(line for line in lines if line)

    def _headings(self) -> list[bool]:
        """Of each element: whether it is a heading or in one."""
        out: list[bool] = []
        for label, parent in zip(self.label, self.parent):
            out.append(parent >= 0 and out[parent] or label.partition(" ")[0] in HEADINGS)
        return out

    def _mains(self, main: str | None) -> set[int]:
        """Numbers of the elements that hold the article: the template's, else article or main elements."""
        if main is not None:
            found = {n for n, path in enumerate(self.path) if path == main}
            if found:
                return found
        marked = self.marked()
        for name in ("article", "main"):
            found = {n for n, label in enumerate(self.label) if label.partition(" ")[0] == name and not marked[n]}
            if found:
                return found
        return set()


def _tokens(source: str) -> Iterator[tuple[str, ...]]:
    """What ``_TOKEN`` finds; the content of raw elements is passed over, up to their end tag or the end of the page.

    A tag that never closes is read up to the end of the page before it is taken for a lone sign, so after ``FAILED`` of them
    ``_LOOSE`` goes on, and behind the last closing sign all is text: the work stays in proportion to the page.
    """
    at: int | None = 0
    last, failed = source.rfind(">"), 0
    while at is not None and at <= last:
        begin, at = at, None
        for found in (_TOKEN if failed < FAILED else _LOOSE).finditer(source, begin):
            if found.start() > last:
                at = found.start()
                break
            token = found.groups("")
            yield token
            if token[4] and source[found.end():found.end() + 1].isalpha():
                failed += 1
                if failed == FAILED:
                    at = found.end()
                    break
            if token[2] and not token[1] and (end := _RAW_END.get(token[2].lower())):
                close = end.search(source, found.end())
                at = close and close.start()
                break
    if at is not None and at < len(source):
        rest = source[at:].partition("<!--")[0]
        if rest:
            yield rest, "", "", "", ""


@lru_cache(maxsize=100_000)
def boilerplate(tag: str, within: bool) -> bool:
    """Whether an element is a menu, header, footer, sidebar, notice, advert, form or the like, by name or role.

    A ``header`` element within the article holds its title and counts as text, and so do headings, whatever their roles.
    """
    name, _, roles = tag.partition(" ")
    if name in DROPPED or name == "header" and not within:
        return True
    if within:
        if name in HEADINGS:
            return False
        parts = re.split(r" (?=(?:class|id|role)=)", roles)
        if any(part[3:] in IDS for part in parts if part.startswith("id=")):
            return True
        roles = " ".join(part for part in parts if not part.startswith("id="))
    return bool(roles) and name not in ("body", "html", "article", "main") and not MARKS.isdisjoint(
        _WORD.findall(roles.replace("class=", "").replace("id=", "").replace("role=", "")))


def token_hash(token: str) -> str:
    return hashlib.blake2b(token.encode("utf-8", "surrogatepass"), digest_size=8).hexdigest()


def deduce_templates(pages: DataFrame) -> DataFrame:
    """host, tokens (the template's tags by path, and hashes of its runs of text), common (hashes of the runs of text on most
    pages, whether of the template or not) and main (the path of the main element).

    ``pages`` has (page_id, host, html).
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], list[int]] = {}
            for page_id, host, source in zip(*(batch.column(c).to_pylist() for c in ("page_id", "host", "html"))):
                page = Page(source or "")
                mark = int.from_bytes(hashlib.blake2b(repr(page_id).encode(), digest_size=4).digest(), "big")
                size = page.sizes()
                for token, times in page.tokens().items():
                    row = found.setdefault((host, token), [0, 0, 0, 0])
                    row[0] += 1
                    row[1] += times
                    row[2] += mark * times
                    row[3] += size.get(token, 0)
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()),
                 pa.array([k[1] for k in keys], pa.string()), pa.array([k[1][:1] != "=" for k in keys], pa.bool_()),
                 pa.array([_rank(k[1]) for k in keys], pa.int32()), pa.array([k[1].count("/") for k in keys], pa.int32()),
                 *(pa.array([found[k][i] for k in keys], pa.int64()) for i in range(4))],
                ["host", "token", "is_tag", "rank", "depth", "pages", "times", "vector", "size"])

    rows = pages.mapInArrow(count, "host string, token string, is_tag boolean, rank int, depth int, pages long, "
                                   "times long, vector long, size long")
    tokens = rows.groupBy("host", "token", "is_tag", "rank", "depth").agg(
        *(F.sum(c).alias(c) for c in ("pages", "times", "vector", "size"))).filter(f"pages >= {LEAST_PAGES}")
    hosts = pages.groupBy("host").agg(F.count("*").alias("n"))
    frequent = tokens.join(hosts, "host").filter(
        F.when(F.col("is_tag"), F.col("pages") >= SUPPORT * F.col("n"))
        .otherwise((F.col("pages") >= LEAST_PAGES_TEXT) & (F.col("pages") >= SUPPORT * F.col("n"))))
    frequent = frequent.withColumn("firm", F.col("is_tag") | (F.col("pages") >= SUPPORT_TEXT * F.col("n")))
    classes = frequent.groupBy("host", "pages", "times", "vector").agg(
        F.collect_list(F.struct("token", "is_tag", "rank", "depth", "size", "firm")).alias("members"))
    members = classes.select("host", "pages", "times", (F.size("members") >= LEAST_MEMBERS).alias("valid"),
                             F.explode("members").alias("m"))
    # article or main elements, else of those that stand once on a page and hold more than half of the largest one's text the
    # deepest: of elements that stand several times, as paragraphs do, a page's text may have parts outside
    is_tag = F.col("valid") & F.col("m.is_tag")
    tag = F.when(is_tag, F.struct("m.rank", "m.depth", "m.size", "m.token", (F.col("times") == F.col("pages")).alias("once")))
    named = members.groupBy("host").agg(
        F.collect_list(F.when(is_tag, F.col("m.token"))).alias("paths"), F.collect_list(tag).alias("tags"),
        F.collect_list(F.when(F.col("valid") & F.col("m.firm") & ~F.col("m.is_tag"), F.col("m.token"))).alias("runs"),
        F.collect_list(F.when(~F.col("m.is_tag"), F.col("m.token"))).alias("common"),
        F.sum(F.when(~F.col("m.is_tag"), F.col("m.size")).otherwise(0)).alias("fixed"))
    most = F.array_max(F.transform("tags", lambda t: t["size"]))
    # where nearly all text is repeated, it is an article that many pages copy
    copied = F.coalesce(F.col("fixed") > (1 - OWN) * most, F.lit(False))
    tokens = F.concat("paths", F.when(copied, F.array().cast("array<string>")).otherwise(F.col("runs")))
    best = F.array_max(F.filter("tags", lambda t: (t["rank"] > 0) | ((t["rank"] == 0) & t["once"] & (t["size"] * 2 > most))))
    return named.select("host", tokens.alias("tokens"), "common", F.when(F.size("tags") > 0, best["token"]).alias("main"))


def _rank(token: str) -> int:
    """Of tags: 2 for an article, 1 for a main element, -1 for boilerplate and for the page as a whole, 0 for other elements."""
    path = token.split("/")
    name = path[-1].split(" ")[0]
    if any(boilerplate(t, False) for t in path) or name in ("html", "head", "body"):
        return -1
    return {"article": 2, "main": 1}.get(name, 0)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    A null html is empty, a page without text has an empty one. A null url counts to the empty host. Repeated rows are kept.
    Other columns are ignored. Broken markup never fails: elements are closed where their parents are. Pages may be of any length;
    an empty table gives no rows.
    """
    own = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    templates = materialize(deduce_templates(own.select("page_id", "host", "html")), "templates")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                texts = [Page(source or "").extract(set(tokens or ()), main, set(common or ()))
                         for source, tokens, main, common in zip(
                             *(part.column(c).to_pylist() for c in ("html", "tokens", "main", "common")))]
                yield pa.RecordBatch.from_arrays(
                    [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    joined = own.join(templates, "host", "left").select("page_id", "url", "html", "tokens", "main", "common")
    return joined.mapInArrow(extract, f"page_id {kinds['page_id']}, url string, text string, n_chars long")
