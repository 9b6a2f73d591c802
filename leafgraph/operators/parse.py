"""The one Python step over raw pages: HTML to flat, typed rows.

A page becomes rows of these kinds, ordered by ``pos``:

* ``page``    opens every page
* ``title``   text of the first element that matches the title rule
* ``head``    an element that may start a section; ``level`` is its place in the split rules
* ``text``    a run of serialised text between two candidate heads
* ``link``    an ``<a href>``; ``in_head`` is the position of the candidate head around it
* ``anchor``  an ``<a id>`` or ``<a name>`` without href
* ``table`` / ``row`` / ``cell`` / ``note``  parts of a table that a replacement rule sends to table conversion
* ``error``   the page could not be read

Which heads split, what a section holds and how a table reads is decided relationally in later operators.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.session import follow, spread

ROW_SCHEMA = (
    "page_id long, pos int, kind string, tag string, level int, text string, body string, href string, "
    "link_text string, classes string, ancestors string, string_len int, last_child boolean, in_head int, "
    "table_no int, row_no int, col_no int, note_keys string, title_row boolean, nested boolean"
)
_FIELDS = [tuple(part.split()) for part in ROW_SCHEMA.split(",")]
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}

HEADINGS = ("h1", "h2", "h3", "h4")
SPLIT_CLASS = "extractor-split"
LINK_IGNORE = "mailto:.*"  # fixed value: hrefs that are no links to pages
MAX_REPLACEMENTS = 100_000  # of one page; a function whose results match again and again would never end
DEFAULT_SPLITS = tuple({"name": h} for h in HEADINGS) + ({"class": SPLIT_CLASS},)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SILENT = frozenset(("script", "style", "head"))
_BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table".split())
# start tag -> (open elements it ends, elements that shield them)
_CELL = (("td", "th"), ("tr", "table"))
_IMPLIED_END = {
    "td": _CELL, "th": _CELL, "tr": (("tr",), ("table",)), "li": (("li",), ("ul", "ol")),
    "p": (("p",), ("div", "td", "th", "li", "table", "article", "section", "main", "body")),
}


@dataclass(frozen=True)
class SiteConfig:
    """How the pages of one site are read."""

    name: str = ""
    base_url: str = ""
    main_content_attrs: dict | None = None
    title_attrs: dict = field(default_factory=lambda: {"name": "h1"})
    remove_tag_attrs: tuple = ()
    replacements: tuple = ()
    split_attrs: tuple = DEFAULT_SPLITS
    mandatory_splits: int = 3
    ignore_empty_split_tags: bool = True
    allow_link_splits: bool = False
    no_title_splits: tuple = ()
    metadata: dict = field(default_factory=dict)
    metadata_extractor: str | None = None
    parent_context_extractor: str | None = None
    max_extract_len: int = 1000
    encoding: str = "utf-8-sig"
    link_ignore_regex: str = LINK_IGNORE


class _Node:
    __slots__ = ("tag", "attrs", "kids", "parent")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.kids, self.parent = tag, attrs, [], parent

    def walk(self) -> Iterator[_Node]:
        """All elements below this one in document order; no recursion, as pages nest without bound."""
        open_ = [iter(self.kids)]
        while open_:
            for kid in open_[-1]:
                if isinstance(kid, _Node):
                    yield kid
                    if kid.kids:
                        open_.append(iter(kid.kids))
                        break
            else:
                open_.pop()

    def text(self) -> str:
        out, left = [], list(reversed(self.kids))
        while left:
            kid = left.pop()
            if isinstance(kid, str):
                out.append(kid)
            else:
                left.extend(reversed(kid.kids))
        return "".join(out)

    def string(self) -> str | None:
        """The only string below this node, or None."""
        node = self
        while len(node.kids) == 1:
            if isinstance(node.kids[0], str):
                return node.kids[0]
            node = node.kids[0]
        return None


def _unwind(steps: Iterator) -> None:
    """Run steps that yield inner steps, depth first, on a stack of our own."""
    stack = [steps]
    while stack:
        inner = next(stack[-1], None)
        if inner is None:
            stack.pop()
        else:
            stack.append(inner)


# One alternative per token; possessive repeats keep the scan linear on broken markup.
_TOKEN = re.compile(
    r"""<(?:(?P<close>/)?(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|!--.*?(?:-->|\Z)|[!?][^>]*+>|/[^>]*+>)""", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_RAW_END = {tag: re.compile(rf"</{tag}[^>]*+>", re.I) for tag in ("script", "style")}


def _attributes(text: str) -> dict:
    found = {}
    for name, double, single, bare in _ATTR.findall(text):
        found.setdefault(name.lower(), unescape(double or single or bare))
    return found


def parse_tree(html: str) -> _Node:
    """Tolerant tree: void tags close at once, an end tag closes up to its start tag, others are ignored."""
    root = at = _Node("", {}, None)
    pos = 0
    search = _TOKEN.search
    while (match := search(html, pos)) is not None:
        start = match.start()
        if start > pos:
            at.kids.append(unescape(html[pos:start]))
        pos = match.end()
        close, tag, attrs = match.groups()
        if not tag:
            continue
        tag = tag.lower()
        if close:
            node = at
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                at = node.parent
            continue
        if tag in _IMPLIED_END:
            ends, shields = _IMPLIED_END[tag]
            node = at
            while node is not None and node.tag not in shields:
                if node.tag in ends:
                    at = node.parent
                    break
                node = node.parent
        node = _Node(tag, _attributes(attrs) if attrs and not attrs.isspace() else {}, at)
        at.kids.append(node)
        if tag in _RAW_END:
            end = _RAW_END[tag].search(html, pos)
            pos = end.end() if end else len(html)
        elif tag not in _VOID and not attrs.endswith("/"):
            at = node
    if pos < len(html):
        at.kids.append(unescape(html[pos:]))
    return root


def matches(node: _Node, rule: dict) -> bool:
    """An attribute group: ``name`` is the tag, ``class`` one class or the whole value, others must be equal."""
    for key, want in rule.items():
        if key == "name":
            if node.tag not in (want if isinstance(want, (list, tuple)) else (want,)):
                return False
        elif key == "class":
            have = node.attrs.get("class", "")
            if want != have and want not in have.split():
                return False
        elif node.attrs.get(key) != want:
            return False
    return True


def _find(node: _Node, rule: dict) -> _Node | None:
    return next((n for n in node.walk() if matches(n, rule)), None)


def replace_nodes(main: _Node, rule: dict, function: Callable, url: str | None) -> int:
    """Put ``function(element, url)`` in the place of every element that matches, scanning forward; returns how many.

    The function gives html text, an element or None. The scan goes on behind the start of what was put in, so elements
    inside it are replaced as well, but what the function returned is not.
    """
    done, left = 0, [iter(list(main.kids))]
    while left:
        node = next(left[-1], None)
        if node is None:
            left.pop()
        elif isinstance(node, str):
            continue
        elif matches(node, rule):
            done += 1
            if done > MAX_REPLACEMENTS:
                raise ValueError(f"more than {MAX_REPLACEMENTS} replacements")
            new = function(node, url)
            fresh = [] if new is None else parse_tree(new).kids if isinstance(new, str) else [new]
            at = next(i for i, kid in enumerate(node.parent.kids) if kid is node)
            node.parent.kids[at:at + 1] = fresh
            for kid in fresh:
                if not isinstance(kid, str):
                    kid.parent = node.parent
            left.extend(iter(list(kid.kids)) for kid in reversed(fresh) if not isinstance(kid, str))
        else:
            left.append(iter(list(node.kids)))
    return done


class _PageRows:
    """Emits the rows of one page while walking its main content."""

    def __init__(self, page_id: int, config: SiteConfig, prefilters: dict):
        self.page_id, self.config, self.prefilters = page_id, config, prefilters
        self.rows: list[dict] = []
        self.buffer: list[str] = []
        self.pos = self.breaks = self.tables = 0
        self.lists: list = []
        self.fresh = True
        self.main: _Node | None = None
        # most rules name a tag and nothing else
        self.split_rules = [(r["name"] if list(r) == ["name"] and isinstance(r["name"], str) else None, r) for r in config.split_attrs]
        # where the titles of converted tables stand among the split rules
        self.table_level = next((i for i, r in enumerate(config.split_attrs)
                                 if r.get("class") == SPLIT_CLASS or r.get("function") == "is_h3_or_split_class"), None)

    def emit(self, kind: str, **values) -> int:
        self.pos += 1
        self.rows.append({"page_id": self.page_id, "pos": self.pos, "kind": kind, **values})
        return self.pos

    def flush(self) -> None:
        body = "".join(self.buffer)
        if body:
            self.emit("text", body=body)
        self.buffer, self.breaks, self.fresh = [], 0, True

    def say(self, text: str) -> None:
        words = " ".join(text.split())
        if not words:
            if text and not self.breaks and self.buffer and not self.buffer[-1].endswith((" ", "\n")):
                self.buffer.append(" ")
            return
        lead = text[0].isspace() and not self.breaks and not self.fresh
        if self.breaks and not self.fresh:
            self.buffer.append("\n" * self.breaks)
        if lead and not (self.buffer and self.buffer[-1].endswith((" ", "\n"))):
            self.buffer.append(" ")
        self.buffer.append(words + (" " if text[-1].isspace() else ""))
        self.breaks, self.fresh = 0, False

    def brk(self, n: int) -> None:
        self.breaks = max(self.breaks, n)

    def split_level(self, node: _Node) -> int | None:
        for level, (tag, rule) in enumerate(self.split_rules):
            if tag is not None:
                if node.tag == tag:
                    return level
            elif "function" in rule:
                if self.prefilters[rule["function"]](node):
                    return level
            elif matches(node, rule):
                return level
        return None

    def read(self, main: _Node) -> None:
        """Emit the rows of the main content."""
        self.main = main
        _unwind(self.walk(main))
        self.flush()

    def ancestors(self, node: _Node) -> str:
        names = []
        while node.parent is not None and node.parent is not self.main:
            node = node.parent
            names.append(node.tag)
        return " ".join(n for n in reversed(names) if n)

    def walk(self, node: _Node, in_head: int | None = None) -> Iterator:
        """Steps for :func:`_unwind`; so are those of ``element`` and ``table``."""
        for kid in node.kids:
            if isinstance(kid, str):
                self.say(kid)
            elif kid.tag not in _SILENT:
                yield self.element(kid, in_head)

    def element(self, node: _Node, in_head: int | None) -> Iterator:
        tag, attrs = node.tag, node.attrs
        if tag == "a":
            if "href" in attrs:
                self.emit("link", text=node.text().strip(), href=attrs["href"], in_head=in_head)
            elif attrs.get("id") or attrs.get("name"):
                self.emit("anchor", text=attrs.get("id") or attrs["name"], in_head=in_head)
        level = self.split_level(node) if in_head is None else None
        if level is not None:
            self.flush()
            at = len(self.rows)
            head = self.emit("head", tag=tag, level=level)
            yield self.walk(node, head)
            body, self.buffer, self.breaks, self.fresh = "".join(self.buffer), [], 0, True
            full, link = node.text(), _find(node, {"name": "a"})
            string, kids = node.string(), node.parent.kids
            self.rows[at].update(
                text=full.strip().replace("\n", ""), body=body,
                link_text=link.text().strip() if link else None, classes=attrs.get("class", ""),
                ancestors=self.ancestors(node), string_len=None if string is None else len(string),
                last_child=kids[-1] is node)
            return
        rule = next((r for r in self.config.replacements if matches(node, r["attrs"])), None)
        if rule is not None and tag == "table" and rule["function"] == "convert_table":
            self.flush()
            yield self.table(node)
            self.brk(2)
        elif tag == "br":
            self.buffer.append("  \n")
        elif tag == "sup" and (node.string() or "").isdigit():
            self.brk(2)
            self.say(f"[{node.string()}]")
            self.brk(2)
        elif tag in ("ul", "ol"):
            self.brk(1 if self.lists else 2)
            self.lists.append(0 if tag == "ol" else None)
            yield self.walk(node, in_head)
            self.lists.pop()
            self.brk(1 if self.lists else 2)
        elif tag == "li":
            self.brk(1)
            mark = "- "
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
                mark = f"{self.lists[-1]}. "
            if self.breaks and not self.fresh:
                self.buffer.append("\n" * self.breaks)
            self.buffer.append("  " * max(len(self.lists), 1) + mark)
            self.breaks, self.fresh = 0, False
            yield self.walk(node, in_head)
            self.brk(1)
        elif tag in ("td", "th"):
            yield self.walk(node, in_head)
            if node.parent.kids and any(isinstance(k, _Node) for k in node.parent.kids[node.parent.kids.index(node) + 1:]):
                self.say("| ")
        elif tag == "tr":
            self.brk(1)
            yield self.walk(node, in_head)
            self.brk(1)
        elif tag in _BLOCK:
            self.brk(2)
            if tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                self.say("#" * int(tag[1]) + " ")
            yield self.walk(node, in_head)
            self.brk(2)
        else:
            yield self.walk(node, in_head)

    def table(self, table: _Node) -> Iterator:
        """Rows, cells and notes of one table; a nested table gets a number of its own, in place."""
        number, self.tables = self.tables, self.tables + 1
        nodes = list(table.walk())  # document order
        owner = {id(n): _owner(n, "tr") for n in nodes if n.tag in ("td", "th", "p")}
        by_row: dict = {}
        for n in nodes:
            if n.tag in HEADINGS and _owner(n, "table") is table:
                by_row.setdefault((id(_owner(n, "tr")), "title"), []).append(n)
            elif id(n) in owner:
                by_row.setdefault((id(owner[id(n)]), "p" if n.tag == "p" else "cell"), []).append(n)
        first_th = next((n for n in nodes if n.tag == "th"), None)
        self.emit("table", table_no=number, tag="empty" if not nodes else "table", level=self.table_level,
                  text=None if first_th is None else first_th.text().strip())
        row_no, sups = -1, {}
        for row in (n for n in nodes if n.tag == "tr" and _owner(n, "table") is table):
            row_no += 1
            titles = by_row.get((id(row), "title"), [])
            cells = by_row.get((id(row), "cell"), [])
            self.emit("row", table_no=number, row_no=row_no, title_row=bool(titles),
                      text=titles[0].text().strip() if titles else None)
            for col_no, cell in enumerate(cells):
                inner = sup = None
                for n in cell.walk():
                    if inner is None and n.tag == "table":
                        inner = n
                    elif sup is None and n.tag == "sup":
                        sup = n
                sups[id(cell)] = sup
                body = _inline(cell, skip=(inner,))
                self.emit("cell", table_no=number, row_no=row_no, col_no=col_no, tag=cell.tag,
                          text=_inline(cell, skip=(sup, inner)) if sup else body, body=body,
                          note_keys=sup.text() if sup else None, nested=inner is not None)
                if inner is not None and col_no == 0 and not titles:
                    yield self.table(inner)
            for cell in [n for n in cells if n.tag == "td"] + by_row.get((id(row), "p"), []):
                sup = sups[id(cell)] if id(cell) in sups else _find(cell, {"name": "sup"})
                if sup is not None and _is_note(cell):
                    self.emit("note", table_no=number, row_no=row_no, note_keys=sup.text(),
                              text=_inline(cell, skip=(sup,)))


def _owner(node: _Node, tag: str) -> _Node | None:
    node = node.parent
    while node is not None and node.tag != tag:
        node = node.parent
    return node


def _is_note(cell: _Node) -> bool:
    if "footnote" in cell.attrs.get("class", "").split():
        return True
    for kid in cell.kids:
        if isinstance(kid, _Node) and kid.tag == "sup":
            return True
        if (kid if isinstance(kid, str) else kid.text()).strip():
            return False
    return False


def _inline(node: _Node, skip: Iterable = ()) -> str:
    """Text of a cell on one line; digit superscripts read ``[n]``."""
    out, left = [], list(reversed(node.kids))
    while left:
        kid = left.pop()
        if isinstance(kid, str):
            out.append(kid)
        elif kid in skip or kid.tag in _SILENT:
            continue
        elif kid.tag == "sup" and (kid.string() or "").isdigit():
            out.append(f"[{kid.string()}]")
        else:
            if kid.tag in _BLOCK or kid.tag in ("li", "br"):
                out.append(" ")
            left.extend(reversed(kid.kids))
    return " ".join("".join(out).split())


def page_rows(page_id: int, html: str, config: SiteConfig, prefilters: dict, functions: dict | None = None,
              url: str | None = None) -> list[dict]:
    """Rows of one page. A page that cannot be read gives one ``error`` row, never a failed task."""
    rows = _PageRows(page_id, config, prefilters)
    try:
        root = parse_tree((html or "").lstrip("\ufeff"))
        rows.emit("page", body="")
        title = _find(root, config.title_attrs)
        if title is not None:
            rows.emit("title", text=title.text().strip())
        main = _find(root, config.main_content_attrs) if config.main_content_attrs else None
        main = root if main is None else main
        rules = config.remove_tag_attrs
        doomed = {id(n) for n in main.walk() for rule in rules if matches(n, rule)} if rules else None
        if doomed:
            for node in [main, *main.walk()]:
                node.kids = [k for k in node.kids if id(k) not in doomed]
        for rule in config.replacements:
            if rule["function"] != "convert_table":
                replace_nodes(main, rule["attrs"], functions[rule["function"]], url)
        rows.read(main)
        return rows.rows
    except Exception as error:  # noqa: BLE001 - the row carries the reason
        return [{"page_id": page_id, "pos": 0, "kind": "error", "text": f"{type(error).__name__}: {error}"}]


def _batch(rows: list[dict], fields: list) -> pa.RecordBatch:
    """Columns of the rows; a row has few of the fields, so only those it has are walked."""
    columns: dict[str, list] = {name: [None] * len(rows) for name, _ in fields}
    for i, row in enumerate(rows):
        for name, value in row.items():
            columns[name][i] = value
    return pa.RecordBatch.from_arrays([pa.array(columns[name], _ARROW[kind]) for name, kind in fields],
                                      names=[name for name, _ in fields])


def parse_pages(pages: DataFrame, configs: SiteConfig | Mapping[str, SiteConfig]) -> DataFrame:
    """Parse ``pages(page_id, html[, url, site])`` into rows of ``ROW_SCHEMA``.

    ``configs`` is one configuration, or one per value of the ``site`` column, which the rows then carry; pages of other
    sites are left out. Replacement functions get the page's ``url``.
    """
    from leafgraph.functions.registry import replacement_functions, split_prefilters

    single = configs if isinstance(configs, SiteConfig) else None
    by_site = {} if single else dict(configs)
    used = split_prefilters([single] if single else by_site.values())
    functions = replacement_functions([single] if single else by_site.values())
    fields = _FIELDS if single else [*_FIELDS, ("site", "string")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, pages_html = batch.column("page_id").to_pylist(), batch.column("html").to_pylist()
            nothing = [None] * len(ids)
            sites = nothing if single else batch.column("site").to_pylist()
            urls = batch.column("url").to_pylist() if "url" in batch.schema.names else nothing
            out: list[dict] = []
            for page_id, html, site, url in zip(ids, pages_html, sites, urls):
                config = single or by_site.get(site)
                if config is None:
                    continue
                rows = page_rows(page_id, html, config, used, functions, url)
                if not single:
                    for row in rows:
                        row["site"] = site
                out.extend(rows)
                if len(out) >= 20_000:  # keep the batches of long pages small
                    yield _batch(out, fields)
                    out = []
            if out:
                yield _batch(out, fields)

    columns = ["page_id", "html", *[c for c in ("url",) if c in pages.columns], *([] if single else ["site"])]
    parsed = spread(pages.select(*columns), "page_id").mapInArrow(
        run, ROW_SCHEMA if single else f"{ROW_SCHEMA}, site string")
    return follow(parsed, pages)


def page_titles(parsed: DataFrame) -> DataFrame:
    """``(page_id, page_title)`` of the pages that have one."""
    return parsed.where(F.col("kind") == "title").select("page_id", F.col("text").alias("page_title"))


def parse_errors(parsed: DataFrame) -> DataFrame:
    return parsed.where(F.col("kind") == "error").select("page_id", F.col("text").alias("error"))
