"""Jaccard join of documents on word n-grams by PartEnum signatures.

A document is the set of its distinct ``n``-word shingles. Sizes are cut into bands such that similar sets lie in the same or
in neighbouring bands; each pair of neighbouring bands has a largest distance ``k`` (size of the symmetric difference) that
similar sets of those bands can have. The domain of shingle hashes is cut at random into ``n1`` parts, each part into ``n2``
smaller ones, and a set signs each subset of ``n2 - k2`` small parts of each part. Two sets at distance ``k`` at most have a part
with at most ``k2`` differences if ``n1 * (k2 + 1) > k``; all but ``k2`` of its small parts agree, and the hash of what the sets have
in those is a shared signature. Signatures never miss a pair; what they propose is verified on the whole texts.

From a distance of ``ENUMERATED`` on, parts have three small ones, of which all subsets of two are signed (``k2`` = 1); each then
stands for a third more of the set than one of as many parts as differences would. Below, and where that would be more than
``MOST`` signatures per shingle (at similarities under about 0.83), parts are their own only small part.

Subsets that are empty agree without meaning anything. A set signs them only if more than ``slack`` of its parts have one; there are
so many more parts that otherwise at least one that agrees has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.llm import similar
from leafgraph.llm.texts import BLANKS, blocks, distinct, grams, mix, span_hashes, word_spans
from leafgraph.session import materialize

N_WORDS = 4
SHARE = (85, 100)
BINS = 512
ENUMERATED = 8  # the distance from which subsets of small parts are enumerated
MOST = 0.6  # signatures per element of a set, for both of its bands
_SUBSETS = ((0, 1), (0, 2), (1, 2))


def shingle_sets(texts: pa.Array, n: int = N_WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, rows): the distinct shingles of consecutive texts, sorted by row and hash."""
    for first, end, offsets, data in blocks(texts):
        starts, ends, rows = word_spans(data, offsets, BLANKS)
        yield first, end, *distinct(*grams(span_hashes(data, starts, ends), rows, n, end - first))


def bands(largest: int, share: tuple[int, int]) -> list[tuple[int, int]]:
    """Closed size bands; the partners of a set are in its band or the next to it."""
    p, q = share
    out, low = [], 1
    while low <= largest:
        high = low * q // p
        out.append((low, high))
        low = high + 1
    return out


def scheme(limit: int, share: tuple[int, int]) -> tuple[int, int, int]:
    """Parts, small ones of each, and slack for sets of at most ``limit`` elements."""
    p, q = share
    k = 2 * limit * (q - p) // (p + q)
    slack = 1 + (k + 1) // 32
    parts = k // 2 + 1 + slack  # k2 = 1: at most k // 2 parts have two differences and more
    if k >= ENUMERATED and 2 * len(_SUBSETS) * parts <= MOST * limit:
        return parts, 3, slack
    slack = (k + 1) // 6
    return k + 1 + slack, 1, slack


def signatures(hashes: np.ndarray, rows: np.ndarray, n_rows: int, share: tuple[int, int]) -> list[np.ndarray]:
    """The signatures of each row's set."""
    sizes = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
    firsts = np.concatenate([[0], np.cumsum(sizes)])
    limits = bands(int(sizes.max(initial=1)) * 2, share)
    highs = np.array([b[1] for b in limits])
    band = np.searchsorted(highs, sizes)
    signed: list[list[np.ndarray]] = [[] for _ in range(n_rows)]
    place = mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(33)
    code = mix(hashes)
    for up in (0, 1):  # with the band below, and with the band above
        for b in np.unique(band[sizes > 0]):
            mine = np.flatnonzero((band == b) & (sizes > 0))
            top = b + up
            n1, n2, slack = scheme(int(highs[top]), share)
            take = np.concatenate([np.arange(firsts[r], firsts[r + 1]) for r in mine])
            own = np.repeat(np.arange(len(mine)), sizes[mine])
            small = (place[take] * np.uint64(n1 * n2) >> np.uint64(31)).astype(np.int64)
            key = own * (n1 * n2) + small
            order = np.argsort(key, kind="stable")
            key = key[order]
            at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            total = np.zeros(len(mine) * n1 * n2, np.uint64)
            total[key[at]] = np.add.reduceat(code[take][order], at)
            filled = np.zeros(len(total), bool)
            filled[key[at]] = True
            total, filled = total.reshape(-1, n1, n2), filled.reshape(-1, n1, n2)
            if n2 > 1:
                total = np.stack([total[:, :, i] + total[:, :, j] for i, j in _SUBSETS], axis=2)
                filled = np.stack([filled[:, :, i] | filled[:, :, j] for i, j in _SUBSETS], axis=2)
            numbers = np.arange(total[0].size, dtype=np.uint64).reshape(total[0].shape) + np.uint64(top << 32)
            sig = mix(total + mix(numbers)[None])
            poor = (~filled).any(axis=2).sum(axis=1) > slack
            keep = filled | poor[:, None, None]
            for i, r in enumerate(mine):
                signed[r].append(sig[i][keep[i]])
    return [np.concatenate(s).view(np.int64) if s else np.zeros(0, np.int64) for s in signed]


def sign_documents(documents: DataFrame, n: int = N_WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """id, size, a, b, hist, sigs of every document (see :mod:`leafgraph.llm.similar`)."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            known = ids.is_valid().to_pylist()
            seen: set[tuple[int, int]] = set()
            for first, end, hashes, rows in shingle_sets(batch.column("text"), n):
                count = end - first
                a, b = similar.set_digests(hashes, rows, count)
                sigs = signatures(hashes, rows, count, share)
                for i, digest in enumerate(zip(a.tolist(), b.tolist())):
                    if not known[first + i] or digest in seen:  # links with nothing, or its set's signatures are there already
                        sigs[i] = sigs[i][:0]
                    else:
                        seen.add(digest)
                hist = similar.histograms(hashes, rows, count, BINS)
                lengths = np.concatenate([[0], np.cumsum([len(s) for s in sigs])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(first, count), pa.array(np.bincount(rows, minlength=count).astype(np.int64)), pa.array(a),
                     pa.array(b), pa.array([h.tobytes() for h in hist], pa.binary()),
                     pa.ListArray.from_arrays(lengths, np.concatenate(sigs))],
                    ["id", "size", "a", "b", "hist", "sigs"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        sign, "id long, size long, a long, b long, hist binary, sigs array<long>")


def verified(documents: DataFrame, pairs: DataFrame, n: int = N_WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """The ``pairs`` (x, y) of document ids whose whole texts are as similar as ``share``."""
    p, q = share
    needed = materialize(pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")).distinct(), "needed")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(needed, "doc_id", "left_semi")
    x, y = texts.select(F.col("doc_id").alias("x"), F.col("text").alias("tx")), texts.select(
        F.col("doc_id").alias("y"), F.col("text").alias("ty"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                both = pa.chunked_array([part.column("tx"), part.column("ty")]).combine_chunks()
                sets: list[np.ndarray] = []
                for first, end, hashes, rows in shingle_sets(both, n):
                    cuts = np.searchsorted(rows, np.arange(end - first + 1))
                    sets += [hashes[c:d] for c, d in zip(cuts[:-1], cuts[1:])]
                m, ok = part.num_rows, []
                for a, b in zip(sets[:m], sets[m:]):
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    ok.append(q * common >= p * (len(a) + len(b) - common) and common > 0)
                yield part.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(y, "y").join(x, "x").select("x", "y", "tx", "ty").mapInArrow(check, "x long, y long")


def join_similar(documents: DataFrame, n: int = N_WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable over links) of every document.

    Words are what lies between ASCII white space, A-Z lower-cased. A null or blank text has no shingles and no links; a
    row without ``doc_id`` is kept with a null component and linked with nothing; rows with the same ``doc_id`` are judged
    each by its text and share their component. Other columns are ignored; an empty table gives an empty result.
    """
    items = materialize(sign_documents(documents, n, share), "sets")
    groups = similar.components(items.filter("id is not null"), lambda pairs: verified(documents, pairs, n, share), share)
    return items.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles")).join(
        groups.withColumnRenamed("id", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
