"""Functions that a site configuration refers to by name, resolved when the plan is built."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# A split predicate is a cheap test in the parser (which elements are candidates) and a Column over candidate rows.
_SPLIT_PREFILTERS: dict[str, Callable] = {
    "is_h3_or_split_class": lambda node: node.tag == "h3" or "extractor-split" in node.attrs.get("class", "").split(),
    "strong_tag_title": lambda node: node.tag == "strong",
}


def is_h3_or_split_class() -> Column:
    return (F.col("tag") == "h3") | F.array_contains(F.split(F.col("classes"), r"\s+"), "extractor-split")


def strong_tag_title(min_len: int = 1, max_len: int = 80) -> Column:
    """A bold line that reads as a title: one short string, last in its parent, outside headings, tables and lists."""
    inside = F.arrays_overlap(F.split(F.col("ancestors"), " "),
                              F.array(*[F.lit(t) for t in ("h1", "h2", "h3", "h4", "table", "ul")]))
    return F.coalesce((F.col("tag") == "strong") & F.col("string_len").between(min_len, max_len)
                      & F.col("last_child") & ~inside, F.lit(False))


_REGISTRY: dict[str, dict[str, Callable]] = {
    "split": {"is_h3_or_split_class": is_h3_or_split_class, "strong_tag_title": strong_tag_title},
    "replacement": {"convert_table": lambda element, url: None},  # a mark: tables are converted relationally
    "metadata": {},
    "context": {},
}


def register(kind: str, name: str, function: Callable, prefilter: Callable | None = None) -> None:
    """Add a function under a name.

    A split predicate gives a Column over candidate rows and brings its candidate test; a metadata function takes the
    parent titles and the titles and gives a Column by name; a context function takes the text. A replacement function
    takes an element (``tag``, ``attrs``, ``kids``, ``text()``, ``walk()``) and the page's URL and gives the html that
    stands in its place, or None.
    """
    _REGISTRY[kind][name] = function
    if kind == "split":
        _SPLIT_PREFILTERS[name] = prefilter or (lambda node: True)


def resolve(kind: str, name: str) -> Callable:
    try:
        return _REGISTRY[kind][name]
    except KeyError:
        raise ValueError(f'Invalid function name "{name}" specified in the config.') from None


def replacement_functions(configs: Iterable) -> dict[str, Callable]:
    """Replacement functions that the configurations name; unknown names raise."""
    return {rule["function"]: resolve("replacement", rule["function"]) for c in configs for rule in c.replacements}


def known_names() -> list[tuple[str, str]]:
    return sorted((kind, name) for kind, names in _REGISTRY.items() for name in names)


def split_prefilters(configs: Iterable) -> dict[str, Callable]:
    """Candidate tests of the split predicates that the configurations name; unknown names raise."""
    used = {}
    for config in configs:
        for rule in config.split_attrs:
            if "function" in rule:
                resolve("split", rule["function"])
                used[rule["function"]] = _SPLIT_PREFILTERS[rule["function"]]
    return used
