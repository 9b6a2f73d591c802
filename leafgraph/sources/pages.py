"""Raw page files and their storage paths."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgraph.functions.urls import clean_url, url_from_path
from leafgraph.operators.numbering import number_rows
from leafgraph.operators.parse import SiteConfig

# Names of encodings as configurations give them, and as Spark's decode does (fixed values).
ENCODINGS = {"utf-8-sig": "UTF-8", "utf-8": "UTF-8", "utf8": "UTF-8", "ascii": "US-ASCII", "us-ascii": "US-ASCII",
             "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1", "iso-8859-1": "ISO-8859-1", "utf-16": "UTF-16",
             "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE", "utf-32": "UTF-32"}


def charset(encoding: str) -> str:
    try:
        return ENCODINGS[encoding.lower().replace("_", "-")]
    except KeyError:
        raise ValueError(f'Unknown encoding "{encoding}"; known: {", ".join(sorted(ENCODINGS))}') from None


def page_key(url: Column) -> Column:
    """The id of a page: all 64 bits of a hash of its cleaned URL. Extract ids are built from dense numbers instead."""
    return F.xxhash64(clean_url(url))


def _files(spark: SparkSession, roots: list[str], newer_than: str | None) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.html")
    if newer_than:
        files = files.option("modifiedAfter", newer_than)
    return files.load(roots)


def _prefix(root: str) -> str:
    return re.sub(r"^file:/+", "/", root).rstrip("/")


def _plain(path: Column, prefix: str) -> Column:
    return F.regexp_replace(path, r"^file:/+", "/") if prefix.startswith("/") else path


def _text(encoding: str) -> Column:
    return F.regexp_replace(F.decode("content", charset(encoding)), "^﻿", "")


def scan_pages(spark: SparkSession, root: str, base_url: str, base_path: str | None = None,
               newer_than: str | None = None, encoding: str = "utf-8-sig") -> DataFrame:
    """``(page_id, url, html, path, last_modified)`` of all ``*.html`` files below ``root``, byte order mark removed.

    ``base_path`` is the storage root as it shows in file URIs. Narrow: a file is read where its split lies.
    """
    prefix = _prefix(base_path or root)
    path = _plain(F.col("path"), prefix)
    url = url_from_path(path, F.lit(prefix), F.lit(base_url.rstrip("/")))
    return _files(spark, [root], newer_than).select(
        page_key(url).alias("page_id"), url.alias("url"), _text(encoding).alias("html"), path.alias("path"),
        F.col("modificationTime").alias("last_modified"))


def dump_path(base_url: str) -> str:
    """The folder of a site below the dump: the parts of its base URL but the scheme."""
    return "/".join(part for part in base_url.split("/") if part and not part.startswith("http"))


def scan_sites(spark: SparkSession, root: str, configs: Mapping[str, SiteConfig], base_path: str | None = None,
               newer_than: str | None = None) -> DataFrame:
    """``(page_id, site, url, html, path, last_modified)`` of all sites below ``root`` in one scan.

    A file belongs to the site with the longest folder above it, and is read in that site's encoding. A page's id also
    depends on its site, as sites may share URLs.
    """
    top, prefix = root.rstrip("/"), _prefix(base_path or root)
    folders = {site: f"{prefix}/{dump_path(c.base_url)}" for site, c in configs.items()}
    path = _plain(F.col("path"), prefix)
    nested = sorted(folders, key=lambda site: -len(folders[site]))
    site, folder, base, html = (F.lit(None).cast("string") for _ in range(4))
    for name in reversed(nested):  # longest first, so it is asked last to be put outermost
        inside = F.startswith(path, F.lit(folders[name] + "/"))
        site, folder = F.when(inside, name).otherwise(site), F.when(inside, folders[name]).otherwise(folder)
        base = F.when(inside, configs[name].base_url.rstrip("/")).otherwise(base)
        html = F.when(inside, _text(configs[name].encoding)).otherwise(html)
    outer = [f for f in folders.values() if not any(f != g and f.startswith(g + "/") for g in folders.values())]
    files = _files(spark, sorted({f.replace(prefix, top, 1) for f in outer}), newer_than)
    rows = files.select(site.alias("site"), url_from_path(path, folder, base).alias("url"), html.alias("html"),
                        path.alias("path"), F.col("modificationTime").alias("last_modified"))
    return rows.select(F.xxhash64(clean_url(F.col("url")), "site").alias("page_id"), *rows.columns)


def number_pages(pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``pages(page_id, url, ...)`` with ``page_no``: those of ``known(page_id, page_no)`` stay, new pages follow in URL order
    from 1 on. Dense numbers leave room for the extracts of a page in a 64-bit id."""
    first = F.lit(1).cast("long")
    new = pages
    if known is not None:
        new = pages.join(known.select("page_id"), "page_id", "left_anti").select(pages.columns)
        first = known.agg((F.coalesce(F.max("page_no"), F.lit(0)) + 1).alias("n")).scalar()
    numbers = number_rows(new.select("page_id", clean_url(F.col("url")).alias("_url")), "_url", "page_id", name="_n").select(
        "page_id", (F.col("_n") + first).alias("page_no"))
    return pages.join(numbers if known is None else known.select("page_id", "page_no").unionByName(numbers), "page_id")


def write_pages(pages: DataFrame, path: str = "path", html: str = "html") -> DataFrame:
    """Store every page as a file of its own, at ``path``; returns the number of files and bytes.

    A file is written under another name and then moved, so a task that runs twice leaves it whole.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = 0
            for target, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if target.startswith("file:") or "://" not in target:
                    store, place = fs.LocalFileSystem(), unquote(urlparse(target).path) if target.startswith("file:") else target
                else:
                    store, place = fs.FileSystem.from_uri(target)
                data = (text or "").encode()
                store.create_dir(place.rpartition("/")[0], recursive=True)
                with store.open_output_stream(f"{place}.part") as out:
                    out.write(data)
                store.move(f"{place}.part", place)
                n += len(data)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64()), pa.array([n], pa.int64())], ["n", "size"])

    counts = pages.select(F.col(path), F.col(html)).mapInArrow(write, "n long, size long")
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"))
