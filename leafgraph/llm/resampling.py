"""Importance resampling towards a target distribution: hashed n-gram weights, and a draw without replacement.

Two passes over the texts, neither of which shuffles them. The first counts the features of all documents and of all target
texts per bucket (an array of ``buckets`` counts per task). The gains of the buckets are then one array that every task
holds, and the second pass scores a document by looking its features up in it.

The best ``share`` of the documents is found without a global sort: a cutoff key is selected exactly by medians. Each part of
the key table gives the median of the keys that are still in question; the median of these, weighted by how many keys each
part has left, has at least a quarter of all remaining keys on either side, so each round discards that much at least, until
the pivot is the cutoff itself. Only a median and three counts per part reach the driver. Winners alone are sorted, by range,
and ranked by prefix sums over the ranges.

CRCs are computed for many words at once. A CRC register is linear in what went in, so that of two words with a blank is the
first word's, carried over as many zero bytes as the second has (a table per length), plus the second's.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.llm.texts import blocks, separators, word_spans
from leafgraph.session import materialize

#: Words are runs of anything but ASCII characters other than letters and digits.
SEPARATORS = separators([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])
LONG = 48  # bytes; longer words go through zlib one by one
_ALL = np.uint32(0xFFFFFFFF)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The register after one byte, and what each of its four bytes becomes over 0 to LONG zero bytes."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1).astype(np.uint32)
    carry = np.empty((LONG + 1, 4, 256), np.uint32)
    for k in range(4):
        carry[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(LONG):
        carry[n + 1] = one[carry[n] & 255] ^ (carry[n] >> np.uint32(8))
    return one, carry


_ONE, _CARRY = _tables()


def _carried(register: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (_CARRY[n, 0, register & 255] ^ _CARRY[n, 1, (register >> 8) & 255]
            ^ _CARRY[n, 2, (register >> 16) & 255] ^ _CARRY[n, 3, register >> 24])


def word_crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of bytes."""
    length = ends - starts
    order = np.argsort(np.where(length > LONG, 0, -length), kind="stable")
    left, at = length[order], starts[order]
    register = np.full(len(order), _ALL)
    short = int(np.count_nonzero(length <= LONG))
    left[short:] = 0
    descending = -left
    for k in range(int(left.max(initial=0))):
        n = int(np.searchsorted(descending, -k))  # spans of more than k bytes
        some = register[:n]
        register[:n] = _ONE[(some ^ data[at[:n] + k]) & 255] ^ (some >> np.uint32(8))
    out = np.empty_like(register)
    out[order] = register ^ _ALL
    for i in np.flatnonzero(length > LONG):
        out[i] = zlib.crc32(data[starts[i]:ends[i]].tobytes())
    return out


def feature_buckets(offsets: np.ndarray, data: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every word and of every two consecutive words of each text, the text's row, and the words per row."""
    data = _LOWER[data]
    starts, ends, rows = word_spans(data, offsets, SEPARATORS)
    one = word_crcs(data, starts, ends)
    pairs = np.flatnonzero(rows[1:] == rows[:-1]) if len(rows) else np.zeros(0, np.int64)
    register = one[pairs] ^ _ALL
    register = _ONE[(register ^ np.uint32(32)) & 255] ^ (register >> np.uint32(8))
    length = (ends - starts)[pairs + 1]
    two = _carried(register ^ _ALL, np.minimum(length, LONG)) ^ one[pairs + 1]
    for i in np.flatnonzero(length > LONG):
        a, b = starts[pairs[i] + 1], ends[pairs[i] + 1]
        two[i] = zlib.crc32(b" " + data[a:b].tobytes(), int(one[pairs[i]]))
    crc = np.concatenate([one, two])
    return ((crc % np.uint32(buckets)).astype(np.int64), np.concatenate([rows, rows[pairs]]),
            np.bincount(rows, minlength=len(offsets) - 1))


def bucket_counts(texts: DataFrame, buckets: int) -> DataFrame:
    """bucket, n: features of all texts per bucket; a task sends one row per bucket that it has seen."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, offsets, data in blocks(batch.column("text")):
                seen += np.bincount(feature_buckets(offsets, data, buckets)[0], minlength=buckets)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(seen[some])], ["bucket", "n"])

    return (texts.select("text").mapInArrow(count, "bucket int, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")))


def bucket_gains(documents: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of every bucket: floor(1000 ln of the smoothed ratio of its share in the target and in the documents)."""
    sums = []
    for texts in (target, documents):
        n = [0] * buckets
        for row in bucket_counts(texts, buckets).collect():  # at most ``buckets`` rows
            n[row["bucket"]] = row["n"]
        sums.append(n)
    t, s = sums
    total_t, total_s = sum(t) + buckets, sum(s) + buckets
    return np.array([math.floor(1000 * math.log((t[b] + 1) * total_s / ((s[b] + 1) * total_t))) for b in range(buckets)],
                    np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """floor(1000 g) of a standard Gumbel value g that depends on the seed and the id alone."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score_documents(documents: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight (floored mean gain of the features) and score (weight plus noise)."""
    shared = documents.sparkSession.sparkContext.broadcast(gains)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = shared.value
        for batch in batches:
            for row, end, offsets, data in blocks(batch.column("text")):
                bucket, at, words = feature_buckets(offsets, data, len(gains))
                n = np.bincount(at, minlength=end - row)
                # sums of whole numbers far below 2**53, so doubles hold them exactly
                total = np.bincount(at, weights=gains[bucket], minlength=end - row).astype(np.int64)
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                ids = batch.column("doc_id").slice(row, end - row)
                extra = np.array([noise(i, seed) for i in ids.to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([ids, *map(pa.array, (words, n, weight, weight + extra))],
                                                 ["doc_id", "n_words", "n_features", "weight", "score"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        score, "doc_id long, n_words long, n_features long, weight long, score long")


def _less(columns: list[np.ndarray], pivot: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Which rows come before ``pivot`` in lexicographic order, and which equal it."""
    less, equal = np.zeros(len(columns[0]), bool), np.ones(len(columns[0]), bool)
    for column, value in zip(columns, pivot):
        less |= equal & (column < value)
        equal &= column == value
    return less, equal


def _median(columns: list[np.ndarray]) -> list[int] | None:
    if not len(columns[0]):
        return None
    middle = np.lexsort(columns[::-1])[(len(columns[0]) - 1) // 2]
    return [int(c[middle]) for c in columns]


def select_key(keys: DataFrame, n: int) -> tuple[int, ...] | None:
    """The ``n``-th smallest row of ``keys`` (non-null long columns, in lexicographic order), n from 1; None without one.

    A job per round, a number of rounds in the logarithm of the rows. A round reads the keys between the bounds found so far
    (the first column's are pushed down to the scan), and a task holds those of its part, which is a split of the table.
    """
    names = keys.columns
    out = "below long, equal long, above long, low array<long>, high array<long>"

    def look(low: tuple | None, high: tuple | None, pivot: tuple | None) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kept = [[] for _ in names]
            for batch in batches:
                columns = [batch.column(c).to_numpy() for c in names]
                keep = np.ones(batch.num_rows, bool)
                if low is not None:
                    less, equal = _less(columns, low)
                    keep &= ~less & ~equal
                if high is not None:
                    keep &= _less(columns, high)[0]
                for own, column in zip(kept, columns):
                    own.append(column[keep])
            columns = [np.concatenate(own) if own else np.zeros(0, np.int64) for own in kept]
            if len(columns[0]):
                if pivot is None:
                    less, equal = np.ones(len(columns[0]), bool), np.zeros(len(columns[0]), bool)
                else:
                    less, equal = _less(columns, pivot)
                more = ~less & ~equal
                medians = [_median([c[side] for c in columns]) for side in (less, more)]
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([int(x.sum())]) for x in (less, equal, more)),
                     *(pa.array([m], pa.list_(pa.int64())) for m in medians)],
                    ["below", "equal", "above", "low", "high"])

        first, rows = F.col(names[0]), keys
        if low is not None:
            rows = rows.where(first >= low[0])
        if high is not None:
            rows = rows.where(first <= high[0])
        return rows.mapInArrow(run, out).collect()  # a row per part

    def weighted(found: list, count: str, median: str) -> tuple[int, ...]:
        some = sorted((tuple(r[median]), r[count]) for r in found if r[count])
        half, seen = sum(c for _, c in some) / 2, 0
        for key, c in some:
            seen += c
            if seen >= half:
                return key
        raise AssertionError("no keys left")

    low = high = pivot = None
    passed = 0  # keys known to come before the bounds
    found = look(low, high, pivot)
    if not 1 <= n <= sum(r["below"] for r in found):
        return None
    pivot = weighted(found, "below", "low")
    while True:
        found = look(low, high, pivot)
        below, equal = (sum(r[c] for r in found) for c in ("below", "equal"))
        if n <= passed + below:
            high, pivot = pivot, weighted(found, "below", "low")
        elif n <= passed + below + equal:
            return pivot
        else:
            passed += below + equal
            low, pivot = pivot, weighted(found, "above", "high")


def _up_to(names: list[str], key: tuple[int, ...]) -> Column:
    """Whether a row comes before ``key`` or equals it."""
    out = F.lit(True)
    for name, value in reversed(list(zip(names, key))):
        out = (F.col(name) < value) | ((F.col(name) == value) & out)
    return out


def rank_rows(rows: DataFrame, keys: list[str], label: str = "ranked") -> DataFrame:
    """``rows`` with ``rank`` from 1 in the order of ``keys``, by ranges and prefix sums instead of one sorted task.

    A last key that tells rows apart lets a range end between rows with equal other keys.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    sort = materialize(sort.withColumn("_at", F.monotonically_increasing_id()), label)
    own = F.shiftright("_at", 33)
    counts = sort.groupBy(own.alias("_part")).agg(F.count("*").alias("n"))  # a row per range
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    bases = counts.select("_part", F.coalesce(before, F.lit(0)).alias("_base"))
    place = F.col("_at").bitwiseAND((1 << 33) - 1)
    return (sort.withColumn("_part", own).join(F.broadcast(bases), "_part")
            .withColumn("rank", F.col("_base") + place + 1).drop("_part", "_base", "_at"))


def resample(documents: DataFrame, target: DataFrame, share: tuple[int, int] = (25, 100), min_words: int = 20,
             buckets: int = 10_000, seed: int = 7) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null where not drawn) of every row of ``documents`` (doc_id, text).

    Of the documents with at least ``min_words`` words, the ``share`` of highest score is drawn, ties to the smaller
    ``doc_id``, then to fewer features; a null ``doc_id`` comes last. ``target`` has a column text. A null or empty text has
    no features, weight 0, and is never drawn; texts may be of any length; repeated rows count, and are drawn, one by one;
    other columns are ignored. An empty table gives no rows, an empty target leaves smoothed gains.
    """
    gains = bucket_gains(documents, target, buckets)
    scored = materialize(score_documents(documents, gains, seed).select(
        "*", (-F.col("score")).alias("_score"), F.col("doc_id").isNull().cast("long").alias("_none"),
        F.coalesce("doc_id", F.lit(0)).alias("_id")), "scored")
    keys = ["_score", "_none", "_id", "n_features"]
    able = scored.where(F.col("n_words") >= min_words)
    n = able.count() * share[0] // share[1]
    columns = ("doc_id", "n_features", "weight", "score")
    no_rank = F.lit(None).cast("long").alias("rank")
    key = select_key(able.select(*keys), n)
    if key is None:
        return scored.select(*columns, no_rank)
    wins = (F.col("n_words") >= min_words) & _up_to(keys, key)
    # rows with equal keys are equal in all columns, so it makes no difference which of them are drawn
    ranked = rank_rows(scored.where(wins).withColumn("_row", F.monotonically_increasing_id()), [*keys, "_row"])
    drawn = ranked.select(*columns, F.when(F.col("rank") <= n, F.col("rank")).alias("rank"))
    return drawn.unionByName(scored.where(~wins).select(*columns, no_rank))
