"""Documents packed into sequences of bounded length: best fit, then a local search that exchanges pieces between bins.

What a packing can do depends on the lengths of the pieces alone, and pieces of one length can stand for each other. So the
search runs over the distribution of lengths: at most ``capacity`` counts, however many documents there are. Bins that hold
the same lengths are one *pattern* with a number of bins, and a step moves as many of its bins as have a partner. Everything
that grows with the corpus stays in Spark: encoding, the count per length, each piece's rank among those of its length (a
rank within its part, from the writing task, plus a prefix sum over the parts), and the look-up of its place. No key of the
data is grouped into a task: a length that a third of all pieces have is a number per part.

The local search takes pieces out of an underfull bin into a fuller one: one piece moves, or one goes for a smaller one,
two for one, or one for two. Each step makes the sum of squared fills larger, so the search ends; bins that lose their last
piece go. It also ends when there are as few bins as the tokens need at least.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.llm.segments import text_encoder
from leafgraph.llm.texts import blocks
from leafgraph.session import materialize

BLOCK = 8 << 20  # bytes of text encoded at once
MAX_STEPS = 20_000  # of the local search; each moves pieces in all bins of two patterns

Pattern = tuple[tuple[int, int], ...]  # (length, pieces of it), longest first


def fill_of(pattern: Pattern) -> int:
    return sum(length * n for length, n in pattern)


def best_fit(counts: dict[int, int], capacity: int) -> Counter:
    """Longest pieces first, each into the fullest bin that has room: bins per pattern.

    Pieces of one length are placed together: a bin that takes one is the fullest one for the next as well, until no more
    go in.
    """
    rooms: dict[int, Counter] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in rooms if r >= length):
            per = room // length
            for pattern in list(rooms[room]):
                while left and rooms[room][pattern]:
                    n = min(rooms[room][pattern], left // per) or 1
                    put = min(per, left)
                    rooms[room][pattern] -= n
                    rooms.setdefault(room - put * length, Counter())[pattern + ((length, put),)] += n
                    left -= n * put
                if not rooms[room][pattern]:
                    del rooms[room][pattern]
            if not rooms[room]:
                del rooms[room]
            if not left:
                break
        per = capacity // length
        full, rest = divmod(left, per)
        if full:
            rooms.setdefault(capacity - per * length, Counter())[((length, per),)] += full
        if rest:
            rooms.setdefault(capacity - rest * length, Counter())[((length, rest),)] += 1
    bins: Counter = Counter()
    for group in rooms.values():
        bins.update(group)
    return bins


def _change(pattern: Pattern, out: tuple[int, ...], into: tuple[int, ...]) -> Pattern:
    pieces = Counter(dict(pattern))
    pieces.subtract(out)
    pieces.update(into)
    return tuple(sorted(((length, n) for length, n in pieces.items() if n), reverse=True))


@dataclass
class _Parts:
    """The pieces of a pattern that an exchange can take: none, one or two of them, by their sum."""

    fill: int
    sums: list[int] = field(default_factory=list)
    parts: list[tuple[int, ...]] = field(default_factory=list)

    @staticmethod
    def of(pattern: Pattern) -> _Parts:
        found: dict[int, tuple[int, ...]] = {0: ()}
        lengths = [length for length, _ in pattern]
        for length in lengths:
            found[length] = (length,)
        for i, (length, n) in enumerate(pattern):
            for other in ([length] if n > 1 else []) + lengths[i + 1:]:
                found.setdefault(length + other, (length, other))
        sums = sorted(found)
        return _Parts(fill_of(pattern), sums, [found[s] for s in sums])


def _exchange(giver: _Parts, taker: _Parts, capacity: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
    """(gain of the taker, pieces it gets, pieces it gives back) of the largest gain that raises the squared fills."""
    room, best = capacity - taker.fill, None
    back = np.array(taker.sums)
    for total, out in zip(giver.sums, giver.parts):
        if not out:
            continue
        for k in range(int(np.searchsorted(back, total - room)), len(back)):
            gain = total - taker.sums[k]
            if gain <= 0 or taker.fill + gain <= giver.fill:
                break
            if len(out) + len(taker.parts[k]) <= 3 and not (len(out) == 2 and not taker.parts[k]):
                if best is None or gain > best[0]:
                    best = (gain, out, taker.parts[k])
                break
        if best and best[0] == room:
            break
    return best


def improve(bins: Counter, capacity: int, max_steps: int = MAX_STEPS) -> Counter:
    """The local search over underfull bins; the emptiest bin gives first, the fullest takes first."""
    bins = Counter({p: n for p, n in bins.items() if n})
    least = -(-sum(fill_of(p) * n for p, n in bins.items()) // capacity)
    total = sum(bins.values())
    parts: dict[Pattern, _Parts] = {p: _Parts.of(p) for p in bins if fill_of(p) < capacity}
    useless: set[tuple[Pattern, Pattern]] = set()
    order = sorted((own.fill, p) for p, own in parts.items())
    for _ in range(max_steps):
        if total <= least:
            break
        step = None
        for _, giver in order:
            for _, taker in reversed(order):
                if giver == taker and bins[giver] < 2 or (giver, taker) in useless:
                    continue
                step = _exchange(parts[giver], parts[taker], capacity)
                if step:
                    break
                useless.add((giver, taker))
            if step:
                break
        if not step:
            break
        _, out, back = step
        n = bins[giver] // 2 if giver == taker else min(bins[giver], bins[taker])
        for old, new in ((giver, _change(giver, out, back)), (taker, _change(taker, back, out))):
            bins[old] -= n
            if not bins[old]:
                del bins[old], order[bisect_left(order, (parts[old].fill, old))]
            if new:
                if not bins[new] and fill_of(new) < capacity:
                    parts.setdefault(new, _Parts.of(new))
                    insort(order, (parts[new].fill, new))
                bins[new] += n
            else:
                total -= n
    return bins


def plan(counts: dict[int, int], capacity: int, max_steps: int = MAX_STEPS) -> np.ndarray:
    """Rows (length, first rank, pieces per bin, first bin, offset of the first one), sorted by length and rank.

    The pieces of a length with ranks from one row's first rank up to the next row's stand in that row's bins.
    """
    bins = improve(best_fit(counts, capacity), capacity, max_steps)
    rows, rank, first = [], Counter(), 0
    for pattern in sorted(bins):
        at = 0
        for length, n in pattern:
            rows.append((length, rank[length], n, first, at))
            rank[length] += n * bins[pattern]
            at += length * n
        first += bins[pattern]
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def cut_pieces(n_tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents with that many tokens (one at least): the document, number, start and length of each piece.

    Only longer documents are cut, and only their first piece is shorter than the capacity.
    """
    pieces = -(-n_tokens // capacity)
    doc = np.repeat(np.arange(len(n_tokens)), pieces)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = n_tokens - (pieces - 1) * capacity
    start = np.where(number > 0, first[doc] + (number - 1) * capacity, 0)
    return doc, number, start, np.where(number > 0, capacity, first[doc])


def encode_pieces(documents: DataFrame, vocabulary: str, end_id: int, capacity: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, part (of the writing task) and rank of its length within the part."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = text_encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for row, end, offsets, data in blocks(batch.column("text"), BLOCK):
                ids, at = own.encode(offsets, data)
                ids = np.insert(ids, at[1:], end_id).astype("<u4")
                first = at[:-1] + np.arange(end - row)
                doc, number, start, length = cut_pieces(np.diff(at) + 1, capacity)
                raw, place = memoryview(ids.tobytes()), 4 * (first[doc] + start)
                crc = [zlib.crc32(raw[a:b]) for a, b in zip(place.tolist(), (place + 4 * length).tolist())]
                order = np.argsort(length, kind="stable")
                many = np.bincount(length, minlength=capacity + 1)
                rank = np.empty(len(length), np.int64)
                rank[order] = np.arange(len(length)) - np.repeat((np.cumsum(many) - many), many)
                rank += seen[length]
                seen += many
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(row, end - row).take(pa.array(doc)), pa.array(number.astype(np.int32)),
                     pa.array(start), pa.array(length), pa.array(crc, pa.int64()),
                     pa.array(np.full(len(doc), part, np.int32)), pa.array(rank)],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(
        encode, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long")


def pack_documents(documents: DataFrame, capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None,
                   max_steps: int = MAX_STEPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: where each piece of ``documents`` (doc_id, text) stands.

    A document is its ids by the ``tokenizers`` file ``vocabulary`` and ``end_id``; one of more than ``capacity`` ids is cut.
    A null text is empty and so the end id alone; rows are packed one by one, so repeated rows and rows with equal or null
    ``doc_id`` each have their own pieces; other columns are ignored; texts may be of any length; an empty table gives no
    rows. The plan that tasks receive has a row per length and pattern, at most some thousands whatever the corpus, since
    best fit makes few patterns per length and each step of the search at most two more.
    """
    vocabulary = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    pieces = materialize(encode_pieces(documents, vocabulary, end_id, capacity), "pieces")
    parts = materialize(pieces.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= capacity rows
    rows = plan(counts, capacity, max_steps)

    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    bases = parts.select("length", "part", F.coalesce(before, F.lit(0)).alias("base"))  # a row per part and length
    ranked = pieces.join(bases, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("base"))
    shared = documents.sparkSession.sparkContext.broadcast(rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = shared.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.empty(len(length), np.int64)
            for own in np.unique(length):
                low, high = np.searchsorted(rows[:, 0], [own, own + 1])
                mine = length == own
                at[mine] = low + np.searchsorted(rows[low:high, 1], rank[mine], "right") - 1
            _, from_rank, per, first, offset = rows[at].T
            turn, slot = np.divmod(rank - from_rank, np.maximum(per, 1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                 pa.array(first + turn), pa.array(offset + slot * length)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
