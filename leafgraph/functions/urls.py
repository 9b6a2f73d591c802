"""URL and path expressions, all as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*"
_ROOT = rf"^({_SCHEME}://[^/?#]*)"
_BARE_ROOT = rf"^({_SCHEME}://[^/?#]*)\z"
_FOLDER = rf"^({_SCHEME}://[^/?#]*(?:/[^?#]*/|/)?)"


def clean_url(url: Column) -> Column:
    """One spelling per page: https, no ``.html``, no ``#top``, no single trailing slash."""
    plain = F.replace(F.replace(F.replace(url, F.lit("http://"), F.lit("https://")), F.lit(".html"), F.lit("")),
                      F.lit("#top"), F.lit(""))
    return F.regexp_replace(plain, r"/\z", "")


def _without_dots(path: Column) -> Column:
    """A rooted path with its dot segments resolved and empty inner segments removed."""
    segments = F.split(path, "/")
    last = F.element_at(segments, -1)
    inner = F.filter(segments, lambda s, i: (s != "") | (i == 0) | (i == F.size(segments) - 1))
    walked = F.aggregate(
        inner,
        F.array().cast("array<string>"),
        lambda acc, seg: F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(seg == ".", acc)
        .otherwise(F.concat(acc, F.array(seg))),
    )
    closed = F.concat(F.array_join(walked, "/"), F.when(last.isin(".", ".."), F.lit("/")).otherwise(F.lit("")))
    return F.regexp_replace(closed, "^/?", "/")


def absolute_url(base: Column, href: Column) -> Column:
    """``href`` as an absolute URL: kept as is when it holds ``//``, else resolved against ``base`` and cleaned.

    Each form of href takes its own short branch; the walk over path segments runs only where the href has dot
    segments or the base has empty ones.
    """
    root = F.regexp_extract(base, _ROOT, 1)
    folder = F.regexp_replace(F.regexp_extract(base, _FOLDER, 1), _BARE_ROOT, "$1/")
    h_path = F.regexp_extract(href, r"^([^?#]*)", 1)
    folder_path = F.regexp_replace(folder, _ROOT, "")
    dotted = F.concat(root, _without_dots(F.when(href.startswith("/"), h_path).otherwise(F.concat(folder_path, h_path))),
                      F.regexp_replace(href, r"^[^?#]*", ""))
    resolved = (
        F.when(href == "", base)
        .when(href.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(base, "[?#].*$", ""), href))
        .when(href.rlike(rf"^{_SCHEME}:"), href)
        .when(href.rlike(r"^(?:[^?#]*/)?\.\.?(?:[/?#]|$)"), dotted)
        .when(href.startswith("/"), F.concat(root, href))
        .when(base.rlike(rf"^{_SCHEME}://[^?#]*//"), dotted)
        .otherwise(F.concat(folder, href))
    )
    return F.when(href.contains("//"), href).otherwise(clean_url(resolved))


def url_host(url: Column) -> Column:
    """Network location of a URL, port included."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def url_from_path(path: Column, base_path: Column, base_url: Column) -> Column:
    """Page URL of a stored file: the storage root becomes the site root and ``.html`` goes."""
    return F.replace(F.replace(path, base_path, base_url), F.lit(".html"), F.lit(""))


def path_from_url(url: Column, out_dir: Column) -> Column:
    """Storage path of a page: without scheme, ``.html`` appended, ``?`` written as ``-``."""
    bare = F.replace(F.replace(url, F.lit("http://"), F.lit("")), F.lit("https://"), F.lit(""))
    segments = F.filter(F.split(bare, "/"), lambda s: s != "")
    # a trailing slash leaves an empty last path element, which joins as a closing slash
    closing = F.when(bare.endswith("/"), F.lit("/")).otherwise(F.lit(""))
    full = F.concat(out_dir, F.lit("/"), F.array_join(segments, "/"), closing, F.lit(".html"))
    return F.translate(full, "?", "-")


def parent_url(url: Column) -> Column:
    """The page one folder up: the last path segment removed; null at the site root."""
    up = F.regexp_replace(url, r"/[^/]*$", "")
    return F.when(up.rlike(r"^[A-Za-z]+://[^/]+"), up)
