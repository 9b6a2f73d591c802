"""Removal of byte strings that occur more than once, by maximal repeats of a sparse enhanced suffix array.

Only suffixes at *anchors* are kept: of the ``GRAM``-byte grams that start in any stretch of ``LENGTH`` bytes, the one with
the smallest hash (the first, if several are equal). Which gram that is depends on the stretch alone, so two equal strings of
``LENGTH`` bytes hold the same anchor at the same place, and comparing suffixes that begin with the same gram finds every
repeat. About one byte in 85 is an anchor.

An anchor's *context* is what a stretch around it can reach: ``REACH`` bytes before it and ``LENGTH`` from it on. Equal
contexts are counted by hash (with partial counts before the shuffle) and stand for all their occurrences, so copies cost
one row. Where one gram has several contexts, their suffixes are sorted, and the common-prefix intervals of the sorted array
are enumerated by one scan with a stack. The members of an interval agree for its depth to the right; a second scan, over
their common lengths to the left, splits them into groups that agree to the left as well, as long as both lengths add up to
``LENGTH``. A group is a maximal repeat if its members don't all continue alike: to the right this is tested against the
interval's children, to the left it holds as the scan takes the longest common length. Every group carries all occurrences.

A gram with more than ``CAP`` contexts isn't handled in one task. Its stretches are split by where they begin, into two
halves that share a longer common core each; the core takes the gram's place and contexts shrink, until groups are small. At
the last level a context is one stretch of ``LENGTH`` bytes, and counting equal ones decides.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.llm.texts import BYTE_CODES, blocks, mix, powers
from leafgraph.session import materialize

LENGTH = 200
GRAM = 32
REACH = LENGTH - GRAM
CAP = 4096
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_inverses = np.ones(1, dtype=np.uint64)


def _inverse_powers(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        _inverses = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, _INVERSE))])
    return _inverses[:n]


def _prefix_sums(data: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_CODES[data] * powers(len(data) + 1)[:len(data)])])


def _hash_between(sums: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return mix((sums[high] - sums[low]) * _inverse_powers(len(sums))[low])


def find_anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of a block of texts: row, place in the text, hash of the gram, of the context, bytes before and from there."""
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < LENGTH:
        return none, none, none, none, none, none
    sums = _prefix_sums(data)
    at = np.arange(n - GRAM + 1)
    grams = _hash_between(sums, at, at + GRAM)
    bits = max(20, int(n).bit_length())
    low = (grams >> np.uint64(bits) << np.uint64(bits)) | at.astype(np.uint64)  # ties: the first
    width = 1
    count = REACH + 1  # grams that start in a stretch of LENGTH bytes and end in it
    while width * 2 <= count:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[:len(low) - (count - width)], low[count - width:])
    lengths = np.diff(offsets)
    begins = np.repeat(offsets[:-1], np.maximum(lengths - LENGTH + 1, 0))
    first = np.cumsum(np.maximum(lengths - LENGTH + 1, 0)) - np.maximum(lengths - LENGTH + 1, 0)
    begins = begins + np.arange(len(begins)) - np.repeat(first, np.maximum(lengths - LENGTH + 1, 0))
    chosen = np.unique((low[begins] & np.uint64((1 << bits) - 1)).astype(np.int64))
    rows = np.searchsorted(offsets, chosen, "right") - 1
    before = np.minimum(chosen - offsets[rows], REACH)
    after = np.minimum(offsets[rows + 1] - chosen, LENGTH)
    context = _hash_between(sums, chosen - before, chosen + after)
    context = mix(context ^ mix((before * 1024 + after).astype(np.uint64)))
    return rows, chosen - offsets[rows], grams[chosen].view(np.int64), context.view(np.int64), before, after


def common_prefix(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    high = min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    low = 0
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(depth, first, last) of the common-prefix intervals of depth ``least`` and more, children before parents.

    ``lcp[i]`` is the common prefix of the entries ``i - 1`` and ``i`` of a sorted array; ``lcp[0]`` isn't read. One scan with
    a stack of open intervals.
    """
    stack: list[tuple[int, int]] = []
    for i in range(1, len(lcp) + 1):
        depth = lcp[i] if i < len(lcp) else -1
        first = i - 1
        while stack and stack[-1][0] > depth:
            top, first = stack.pop()
            if top >= least:
                yield top, first, i - 1
        if not stack or stack[-1][0] < depth:
            stack.append((depth, first))


def maximal_repeats(lefts: list[bytes], rights: list[bytes], length: int = LENGTH
                    ) -> Iterator[tuple[int, int, list[int]]]:
    """(bytes to the left, bytes to the right, members) of the maximal repeats of at least ``length`` bytes.

    Member ``i`` is the text ``lefts[i]`` + ``rights[i]`` around a common point; texts are distinct.
    """
    array = sorted(range(len(rights)), key=rights.__getitem__)
    lcp = [0] + [common_prefix(rights[a], rights[b]) for a, b in zip(array, array[1:])]
    backward = [t[::-1] for t in lefts]
    for depth, first, last in intervals(lcp, 1):
        longest = max(len(lefts[i]) for i in array[first:last + 1])
        if depth + longest < length:
            continue
        place = {i: p for p, i in enumerate(array[first:last + 1], first)}
        members = sorted(place, key=backward.__getitem__)
        left = [0] + [common_prefix(backward[a], backward[b]) for a, b in zip(members, members[1:])]
        for reach, low, high in intervals(left, max(length - depth, 0)):
            group = members[low:high + 1]
            places = [place[i] for i in group]
            if min(lcp[min(places) + 1:max(places) + 1]) == depth:  # else all of them lie in one child, and agree further
                yield reach, depth, group


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of equal key, which follow each other, over the borders of batches."""
    group: list[dict] = []
    for batch in batches:
        for row in batch.to_pylist():
            if group and row[key] != group[0][key]:
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def anchors_of(documents: DataFrame) -> DataFrame:
    """(key, pos, gram, context, before, after) of every anchor; ``documents`` has (key, text)."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("key")
            for first, _, offsets, data in blocks(batch.column("text")):
                rows, pos, gram, context, before, after = find_anchors(data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(pa.array(rows + first)), pa.array(pos.astype(np.int32)), pa.array(gram), pa.array(context),
                     pa.array(before.astype(np.int16)), pa.array(after.astype(np.int16))],
                    ["key", "pos", "gram", "context", "before", "after"])

    kind = documents.schema["key"].dataType.simpleString()
    return documents.mapInArrow(find, f"key {kind}, pos int, gram long, context long, before short, after short")


def _contexts(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (key, pos, gram, context) with the bytes before (``l``) and from the anchor (``r``)."""
    places = wanted.groupBy("key").agg(F.collect_list(F.struct("pos", "gram", "context")).alias("places"))  # of one text
    places = materialize(places, "places")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                raw = (batch.column("text")[i].as_py() or "").encode()
                at = batch.column("places")[i].as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p["gram"] for p in at], pa.int64()), pa.array([p["context"] for p in at], pa.int64()),
                     pa.array([raw[max(0, p["pos"] - REACH):p["pos"]] for p in at], pa.binary()),
                     pa.array([raw[p["pos"]:p["pos"] + LENGTH] for p in at], pa.binary())], ["gram", "context", "l", "r"])

    joined = documents.join(places, "key").select("text", "places")
    # repeated rows give a context twice
    return joined.mapInArrow(cut, "gram long, context long, l binary, r binary").dropDuplicates(["gram", "context"])


def _covered(contexts: DataFrame) -> DataFrame:
    """(id, low, high) of the contexts (core, id, l, r) that lie in maximal repeats: what these cover, from the core.

    All repeats of a context hold its core, so what they cover is one stretch.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int]] = []
        for group in _groups(batches, "core"):
            reach = [(0, 0)] * len(group)
            for left, right, members in maximal_repeats([g["l"] for g in group], [g["r"] for g in group]):
                for i in members:
                    reach[i] = max(reach[i][0], left), max(reach[i][1], right)
            out += [(g["id"], -left, right) for g, (left, right) in zip(group, reach) if left + right]
            if len(out) > 50_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return contexts.select("core", "id", "l", "r").repartition("core").sortWithinPartitions("core").mapInArrow(
        scan, "id long, low int, high int")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
         pa.array([r[2] for r in rows], pa.int32())], ["id", "low", "high"])


def _digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(len(p).to_bytes(4, "little") + p for p in parts), digest_size=8).digest(),
                          "little", signed=True)


def _halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Split rows (gram, context, core, id, l, r, shift, span) by where a stretch begins.

    A stretch begins ``shift`` to ``shift + span`` bytes before the anchor. ``l`` and ``r`` meet ``shift`` bytes before it.
    """
    names = ["gram", "context", "core", "id", "l", "r", "shift", "span"]
    for batch in batches:
        for start in range(0, batch.num_rows, 1000):
            out: list[tuple] = []
            for x in batch.slice(start, 1000).to_pylist():
                span, left, right = x["span"], x["l"], x["r"]
                near = span // 2
                own = x["core"].to_bytes(8, "little", signed=True)
                if len(right) >= LENGTH - near:
                    new = left[max(0, len(left) - near):]
                    core = _digest(own, b"near", right[:LENGTH - near])
                    out.append((x["gram"], x["context"], core, _digest(core.to_bytes(8, "little", signed=True), new, right),
                                new, right, x["shift"], near))
                if len(left) > near and span > 0:
                    cut = len(left) - near - 1
                    new, far = (left[cut:] + right)[:LENGTH], span - near - 1
                    if len(new) >= LENGTH - far:
                        core = _digest(own, b"far", new[:LENGTH - far])
                        out.append((x["gram"], x["context"], core,
                                    _digest(core.to_bytes(8, "little", signed=True), left[max(0, cut - far):cut], new),
                                    left[max(0, cut - far):cut], new, x["shift"] + near + 1, far))
            columns = list(zip(*out)) if out else [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def repeat_coverage(contexts: DataFrame, cap: int = CAP) -> DataFrame:
    """(gram, context, low, high): which bytes around the anchor also occur around another context of the gram.

    ``contexts`` has (gram, context, l, r), each context of a gram once, and is a written table.
    """
    level = contexts.select("gram", "context", F.col("gram").alias("core"), F.xxhash64("gram", "context").alias("id"), "l", "r",
                            F.lit(0).alias("shift"), F.lit(REACH).alias("span"))
    found = None
    while True:
        unique = level.dropDuplicates(["core", "id"])
        many = materialize(unique.groupBy("core").agg(F.count("*").alias("n")), "cores")
        small = unique.join(many.filter(f"n between 2 and {cap}").select("core"), "core", "left_semi")
        part = _covered(small)
        owners = level.select("id", "gram", "context", "shift")
        # the same part around several contexts is a repeat as a whole
        again = level.groupBy("id").agg(F.count("*").alias("n"), F.first("l").alias("l"), F.first("r").alias("r")).filter(
            f"n > 1 and octet_length(l) + octet_length(r) >= {LENGTH}").select(
            "id", (-F.octet_length("l")).alias("low"), F.octet_length("r").alias("high"))
        spans = part.unionByName(again).join(owners, "id").select(
            "gram", "context", (F.col("low") - F.col("shift")).alias("low"), (F.col("high") - F.col("shift")).alias("high"))
        spans = materialize(spans, "repeats")
        found = spans if found is None else found.unionByName(spans)
        large = materialize(many.filter(f"n > {cap}").select("core"), "large")
        if large.isEmpty():
            return found
        level = materialize(level.join(large, "core", "left_semi").select(
            "gram", "context", "core", "id", "l", "r", "shift", "span").mapInArrow(
            _halves, "gram long, context long, core long, id long, l binary, r binary, shift int, span int"), "halves")


def repeated_spans(documents: DataFrame) -> DataFrame:
    """key and spans (array of (start, end) in bytes): what strings of ``LENGTH`` bytes that occur again cover.

    ``documents`` has (key, text), a null text being empty; only texts with a repeat have a row. Spans may overlap.
    """
    anchors = materialize(anchors_of(documents), "anchors")
    contexts = anchors.groupBy("gram", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("key", "pos")).alias("at"), F.first("before").alias("before"),
        F.first("after").alias("after"))
    contexts = materialize(contexts, "contexts")
    several = contexts.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    wanted = contexts.join(several, "gram", "left_semi").select("at.key", "at.pos", "gram", "context")
    around = materialize(_contexts(documents, wanted), "around")
    partly = repeat_coverage(around)
    whole = contexts.filter(f"n > 1 and before + after >= {LENGTH}").select(
        "gram", "context", (-F.col("before")).cast("int").alias("low"), F.col("after").cast("int").alias("high"))
    # all of these stretches hold the anchor, so together they are one
    covered = whole.unionByName(partly).groupBy("gram", "context").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    spans = anchors.select("key", "pos", "gram", "context").join(covered, ["gram", "context"])
    return spans.groupBy("key").agg(F.collect_list(
        F.struct((F.col("pos") + F.col("low")).alias("start"), (F.col("pos") + F.col("high")).alias("end"))).alias("spans"))


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (binary) of every document.

    Matches lie within documents and are judged on the input; occurrences of one document count, and so do repeated rows,
    which are different documents. A null text is empty; ``doc_id`` may be null or stand twice. Other columns are ignored.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()
    keyed = documents.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text")
    spans = repeated_spans(keyed)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                sizes, removed, counts, kept = [], [], [], []
                for text, found in zip(part.column("text").to_pylist(), part.column("spans").to_pylist()):
                    raw = (text or "").encode()
                    runs = merged([(s["start"], s["end"]) for s in found or ()])
                    rest, at = [], 0
                    for a, b in runs:
                        rest.append(raw[at:a])
                        at = b
                    rest.append(raw[at:])
                    sizes.append(len(raw))
                    removed.append(sum(b - a for a, b in runs))
                    counts.append(len(runs))
                    kept.append(b"".join(rest))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(v, pa.int64()) for v in (sizes, removed, counts)),
                     pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = keyed.join(spans.withColumnRenamed("key", "other"), keyed.key.eqNullSafe(F.col("other")), "left")
    return joined.select(F.col("key.doc_id").alias("doc_id"), "text", "spans").mapInArrow(
        cut, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint, maximal runs that the spans cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
