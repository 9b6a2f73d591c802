"""Removal of passages that repeat across documents, by paragraphs.

Units are the paragraphs (lines) of a text and, since passages also stand inside longer paragraphs, runs of words and the
sentences of a paragraph. They go in three steps, and each step sees only what the steps before it left, so a unit goes only
for a copy of it that stays:

1. Paragraphs of ``LONG`` words and more are matched by MinHash banding over five-word shingles: ``BANDS`` bands of ``ROWS``
   hashes find a pair of similarity 0.8 with probability 1 - (1 - 0.8^ROWS)^BANDS (0.994 for 5 x 2) and equal ones always; what
   a band proposes is verified by the exact Jaccard similarity of the paragraphs' shingles. Each connected component keeps its
   first paragraph, by document id, text and place; all others of it go.
2. Every run of ``STRETCH`` words and more that is left and that an earlier document holds as well goes whole, wherever lines and
   sentences begin and end. Of the ``ANCHOR``-word grams of each stretch of ``STRETCH`` words, the one with the smallest hash (the
   first, if several are equal) is its anchor; which one depends on the stretch alone, so equal stretches share their anchor.
   The stretches of one anchor follow each other, and together are its extent. Where all extents of a gram are equal and
   nothing of them went before, they are repeated as a whole; only elsewhere are the single stretches compared.
3. Sentences of ``SHORT`` words and more that are left whole can only be near-equal if they are equal, as one changed word costs
   up to five shingles, so they are matched by their words. All but the first copy are repeated, and go where repeated units
   make a run of ``sentence_run`` words, so common phrases inside paragraphs stay.

What a run of step 2 is held by can itself be cut by an overlapping run of a still earlier document; then each part of it stands
in a kept text, though not in one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.llm import similar
from leafgraph.llm.suffix_repeats import _hash_between
from leafgraph.llm.texts import BLANKS, blocks, distinct, grams, mix, powers, span_hashes, word_spans
from leafgraph.session import discard, materialize

N_WORDS = 5
SHARE = (80, 100)
BANDS, ROWS = 5, 2
LONG, SHORT = 13, 6
SENTENCE_RUN = 25
BINS = 64
GAP = 6  # words of units too short to be matched that a run may span
STRETCH, ANCHOR = 50, 8  # words
BITMAP = 1 << 23  # bits
_SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64))
_TEXT = "doc_id bigint, text_key bigint"  # a row of documents; the key tells texts apart that share an id
_ID = "struct<doc_id:bigint,text_key:bigint,unit:int>"


class Units:
    """Paragraphs and sentences of a block of texts; spans are byte offsets in their text."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        starts, ends, rows = word_spans(data, offsets, BLANKS)
        self.words = span_hashes(data, starts, ends)
        self.first_word = np.searchsorted(rows, np.arange(len(offsets) - 1))
        lines = np.cumsum(data == 10)[starts] if len(starts) else starts
        new_line = np.ones(len(starts), bool)
        new_line[1:] = (lines[1:] != lines[:-1]) | (rows[1:] != rows[:-1])
        closes = np.isin(data[ends - 1], np.frombuffer(b".!?", np.uint8)) if len(ends) else np.zeros(0, bool)
        new_sentence = new_line.copy()
        new_sentence[1:] |= closes[:-1]
        self.lines = self._spans(new_line, starts, ends, rows, offsets)
        self.sentences = self._spans(new_sentence, starts, ends, rows, offsets)
        line_of = np.cumsum(new_line) - 1
        self.line_of_word = line_of
        self.exact = self.sentences["words"] >= SHORT  # a long line of one sentence is both a paragraph and a sentence
        self.long = self.lines["words"] >= LONG

    def _spans(self, new, starts, ends, rows, offsets) -> dict[str, np.ndarray]:
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(starts)) - 1 if len(first) else first
        row = rows[first]
        begins = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
        number = np.arange(len(first)) - np.maximum.accumulate(np.where(begins, np.arange(len(first)), 0))
        return {"first": first, "words": last - first + 1, "row": row, "number": number, "low": first - self.first_word[row],
                "start": starts[first] - offsets[row], "end": ends[last] - offsets[row]}

    def long_shingles(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Shingle hashes of the long lines in order, the place of each line's first, and the lines."""
        hashes, line = grams(self.words, self.line_of_word, N_WORDS, len(self.long))
        keep = self.long[line]
        hashes, line = hashes[keep], line[keep]
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]])) if len(line) else line
        return hashes, first, line


class Stretches:
    """Stretches of ``STRETCH`` words of a block of texts, by their anchors.

    Of each anchor: its gram, the words from ``low`` to before ``high`` that its stretches cover, and a hash of these.
    """

    def __init__(self, offsets: np.ndarray, data: np.ndarray):
        self.starts, self.ends, self.rows = word_spans(data, offsets, BLANKS)
        self.offsets = offsets
        words = span_hashes(data, self.starts, self.ends)
        n = len(words)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * powers(n + 1)[:n])])
        self.first_word = np.searchsorted(self.rows, np.arange(len(offsets) - 1))
        begins = np.flatnonzero(self.rows[:n - STRETCH + 1] == self.rows[STRETCH - 1:]) if n >= STRETCH else np.zeros(0, np.int64)
        if not len(begins):
            self.gram = self.extent = np.zeros(0, np.uint64)
            self.low = self.high = begins
            return
        at = np.arange(n - ANCHOR + 1)
        hashes = _hash_between(self.sums, at, at + ANCHOR)
        bits = np.uint64(max(20, n.bit_length()))
        least = (hashes >> bits << bits) | at.astype(np.uint64)  # ties: the first
        width, count = 1, STRETCH - ANCHOR + 1
        while width * 2 <= count:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        least = np.minimum(least[:len(least) - (count - width)], least[count - width:])
        anchor = (least[begins] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.append(new[1:], len(begins)) - 1
        self.gram, self.low, self.high = hashes[anchor[new]], begins[new], begins[last] + STRETCH
        place = ((anchor[new] - self.low) * 4096 + self.high - self.low).astype(np.uint64)
        self.extent = mix(_hash_between(self.sums, self.low, self.high) ^ mix(place))

    def spans(self, low: np.ndarray, high: np.ndarray) -> list[pa.Array]:
        """Of the words from ``low`` to before ``high``: these numbers in their text, and its bytes."""
        row = self.rows[low]
        return [pa.array(x.astype(np.int32)) for x in (
            low - self.first_word[row], high - self.first_word[row], self.starts[low] - self.offsets[row],
            self.ends[high - 1] - self.offsets[row])]


def _texts(batch: pa.RecordBatch, rows: np.ndarray) -> list[pa.Array]:
    """Id and key of the texts in ``rows`` of a batch."""
    return [batch.column(c).take(pa.array(rows)) for c in ("doc_id", "text_key")]


def _ids(batch: pa.RecordBatch, rows: np.ndarray, unit: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([*_texts(batch, rows), pa.array(unit.astype(np.int32))], ["doc_id", "text_key", "unit"])


def _documents(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text").filter(
        "doc_id is not null")


def _among(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of :func:`_documents` that can be among the texts ``wanted`` (doc_id, text_key), before any text is shuffled.

    The wanted texts set bits of one bitmap of ``BITMAP`` bits, a megabyte at any size of the corpus, which all tasks hold.
    """
    bit = F.pmod(F.xxhash64("doc_id", "text_key"), F.lit(BITMAP))
    part, place = F.shiftright(bit, 15), bit % 32768
    bits = wanted.select("doc_id", "text_key").groupBy(part.alias("_part")).agg(F.bitmap_construct_agg(place).alias("_bits"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = byte.bitwiseAND(F.expr("shiftleft(1, cast(_place % 8 as int))")) != 0
    rows = _documents(documents).withColumns({"_part": part, "_place": place}).join(F.broadcast(bits), "_part")
    return rows.where(found).select("doc_id", "text_key", "text")


def long_paragraphs(documents: DataFrame) -> DataFrame:
    """One row per paragraph of ``LONG`` words and more, with what :mod:`similar` needs, and its span.

    Unit numbers are even for paragraphs and odd for sentences, each in reading order.
    """
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[tuple[int, int]] = set()
            for first, _, offsets, data in blocks(batch.column("text")):
                own = Units(offsets, data)
                hashes, at, line = own.long_shingles()
                if not len(at):
                    continue
                which = np.flatnonzero(own.long)
                mins = [np.minimum.reduceat(mix(hashes ^ seed), at) for seed in _SEEDS]
                sigs = np.stack([mix(sum(mins[b * ROWS + r] * np.uint64(2 * r + 3) for r in range(ROWS)) + np.uint64(b))
                                 for b in range(BANDS)], axis=1)
                unique, owner = distinct(hashes, np.searchsorted(which, line))
                a, b = similar.set_digests(unique, owner, len(which))
                hist = similar.histograms(unique, owner, len(which), BINS)
                some = {k: v[which] for k, v in own.lines.items()}
                fresh = np.zeros(len(which), bool)  # equal sets are one class, so one of a batch signs for all of it
                for i, digest in enumerate(zip(a.tolist(), b.tolist())):
                    if digest not in seen:
                        seen.add(digest)
                        fresh[i] = True
                ends = np.concatenate([[0], np.cumsum(np.where(fresh, BANDS, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [_ids(batch, some["row"] + first, some["number"] * 2), pa.array(np.bincount(owner, minlength=len(which))),
                     pa.array(a), pa.array(b), pa.array([h.tobytes() for h in hist], pa.binary()),
                     pa.ListArray.from_arrays(ends, sigs[fresh].reshape(-1).view(np.int64)),
                     *(pa.array(some[k].astype(np.int32)) for k in ("start", "end", "low", "words"))],
                    ["id", "size", "a", "b", "hist", "sigs", "start", "end", "low", "words"])

    return _documents(documents).mapInArrow(
        units, f"id {_ID}, size long, a long, b long, hist binary, sigs array<long>, start int, end int, low int, words int")


def short_units(documents: DataFrame) -> DataFrame:
    """One row per sentence of ``SHORT`` words and more: id, key of its words, span."""
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, offsets, data in blocks(batch.column("text")):
                own = Units(offsets, data)
                which = np.flatnonzero(own.exact)
                if not len(which):
                    continue
                begins, words = own.sentences["first"], own.sentences["words"]
                place = np.arange(len(own.words)) - np.repeat(begins, words)
                key = mix(np.add.reduceat(own.words * powers(int(words.max()))[place], begins) + words.astype(np.uint64))
                some = {k: v[which] for k, v in own.sentences.items()}
                yield pa.RecordBatch.from_arrays(
                    [_ids(batch, some["row"] + first, some["number"] * 2 + 1), pa.array(key[which].view(np.int64)),
                     *(pa.array(some[k].astype(np.int32)) for k in ("start", "end", "low", "words"))],
                    ["id", "key", "start", "end", "low", "words"])

    return _documents(documents).mapInArrow(units, f"id {_ID}, key long, start int, end int, low int, words int")


def verified(documents: DataFrame, spans: DataFrame, pairs: DataFrame) -> DataFrame:
    """The ``pairs`` (x, y) of paragraphs whose shingle sets have a Jaccard similarity of ``SHARE`` or more."""
    needed = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()
    needed = materialize(needed.join(spans, "id").select("id", "start", "end", "id.doc_id", "id.text_key"), "needed")
    raw = F.to_binary("text", F.lit("utf-8"))
    texts = _among(documents, needed).join(needed.hint("merge"), ["doc_id", "text_key"]).select(  # one plan at every size
        "id", F.substring(raw, F.col("start") + 1, F.col("end") - F.col("start")).cast("string").alias("text")
    ).dropDuplicates(["id"])
    texts = materialize(texts, "paragraphs")
    discard(needed)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, q = SHARE
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                both = pa.chunked_array([part.column("tx"), part.column("ty")]).combine_chunks()
                sets: list[np.ndarray] = []
                for first, end, offsets, data in blocks(both):
                    starts, ends, rows = word_spans(data, offsets, BLANKS)
                    hashes, owner = distinct(*grams(span_hashes(data, starts, ends), rows, N_WORDS, end - first))
                    cuts = np.searchsorted(owner, np.arange(end - first + 1))
                    sets += [hashes[c:d] for c, d in zip(cuts[:-1], cuts[1:])]
                m, ok = part.num_rows, []
                for a, b in zip(sets[:m], sets[m:]):
                    common = len(np.intersect1d(a, b, assume_unique=True))
                    ok.append(q * common >= p * (len(a) + len(b) - common))
                yield part.select(["x", "y"]).filter(pa.array(ok, pa.bool_()))

    x, y = (texts.select(F.col("id").alias(k), F.col("text").alias(f"t{k}")) for k in "xy")
    found = materialize(pairs.join(y, "y").join(x, "x").select("x", "y", "tx", "ty").mapInArrow(check, f"x {_ID}, y {_ID}"), "verified")
    discard(texts)
    return found


_SPAN = "low int, high int, start int, end int"


def _anchors(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, gram, extent and span of every anchor."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, _, offsets, data in blocks(batch.column("text")):
                own = Stretches(offsets, data)
                if len(own.low):
                    yield pa.RecordBatch.from_arrays(
                        [*_texts(batch, own.rows[own.low] + first), pa.array(own.gram.view(np.int64)),
                         pa.array(own.extent.view(np.int64)), *own.spans(own.low, own.high)],
                        ["doc_id", "text_key", "gram", "extent", "low", "high", "start", "end"])

    return _documents(documents).mapInArrow(find, f"{_TEXT}, gram long, extent long, {_SPAN}")


def _single(documents: DataFrame, wanted: DataFrame, gone: DataFrame | None) -> DataFrame:
    """Text, key, anchor and span of every stretch whose anchor has one of the grams ``wanted`` (doc_id, text_key, gram).

    Stretches with words in the spans ``gone`` are left out before the table is written, as it has two readers.
    """
    lists = materialize(wanted.groupBy("doc_id", "text_key").agg(F.collect_set("gram").alias("grams")), "grams")  # of one text
    joined = _among(documents, lists).join(lists.hint("merge"), ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "grams")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("grams")
            for first, end, offsets, data in blocks(batch.column("text")):
                own = Stretches(offsets, data)
                rows = own.rows[own.low]
                cuts = np.searchsorted(rows, np.arange(end - first + 1))
                found = np.zeros(len(rows), bool)
                for i in range(end - first):
                    grams_ = lists[first + i].values.to_numpy()
                    found[cuts[i]:cuts[i + 1]] = np.isin(own.gram[cuts[i]:cuts[i + 1]].view(np.int64), grams_)
                which = np.flatnonzero(found)
                if not len(which):
                    continue
                many = own.high[which] - own.low[which] - STRETCH + 1
                before = np.cumsum(many) - many
                low = np.arange(int(many.sum())) - np.repeat(before, many) + np.repeat(own.low[which], many)
                key = _hash_between(own.sums, low, low + STRETCH)
                anchor = np.repeat(own.low[which] - own.first_word[rows[which]], many)
                yield pa.RecordBatch.from_arrays(
                    [*_texts(batch, own.rows[low] + first), pa.array(key.view(np.int64)), pa.array(anchor.astype(np.int32)),
                     *own.spans(low, low + STRETCH)], ["doc_id", "text_key", "key", "anchor", "low", "high", "start", "end"])

    stretches = joined.mapInArrow(find, f"{_TEXT}, key long, anchor int, {_SPAN}")
    if gone is not None:
        cuts = F.exists("_cuts", lambda c: (c["low"] < F.col("high")) & (c["high"] > F.col("low")))
        stretches = stretches.join(_cut_lists(gone), ["doc_id", "text_key"], "left").filter(~F.coalesce(cuts, F.lit(False))).drop("_cuts")
    found = materialize(stretches, "stretches")
    discard(lists)
    return found


def _cut_lists(cuts: DataFrame) -> DataFrame:
    """One row per text with its ``cuts`` (doc_id, text_key, low, high) as an array, each once."""
    return cuts.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("low", "high")).alias("_cuts"))


def with_covered(spans: DataFrame, cuts: DataFrame) -> DataFrame:
    """``spans`` (doc_id, text_key, low, high, ...) with ``covered``: how many of their words lie in cuts of the same text.

    ``cuts`` don't overlap each other, but may stand twice. A text's cuts are one array, so only narrow rows meet.
    """
    covered = F.aggregate("_cuts", F.lit(0), lambda n, c: n + F.greatest(
        F.lit(0), F.least(c["high"], F.col("high")) - F.greatest(c["low"], F.col("low"))))
    return spans.join(_cut_lists(cuts), ["doc_id", "text_key"], "left").withColumn("covered", F.coalesce(covered, F.lit(0))).drop("_cuts")


def repeated_stretches(documents: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """doc_id, text_key, low, high, start, end, first_doc_id: the longest runs of which an earlier document holds every stretch.

    ``low`` and ``high`` number words, ``start`` and ``end`` bytes. A run that meets several earlier documents names the first.
    Stretches with words in the spans ``gone`` (doc_id, text_key, low, high) take no part: anchors of which nothing else is left
    are dropped at once, and those that a cut divides are compared stretch by stretch.
    """
    text = ["doc_id", "text_key"]
    anchors = materialize(_anchors(documents), "anchors")
    held = anchors.groupBy("gram").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
                                       (F.min("extent") < F.max("extent")).alias("several")).filter("first < last").drop("last")
    shared = anchors.join(held.hint("merge"), "gram").drop("extent")
    if gone is not None:
        left = with_covered(shared.drop("first"), gone).filter("covered < high - low").withColumn("cut", F.col("covered") > 0)
        left = materialize(left.drop("covered"), "left")
        discard(anchors)
        anchors = left
        held = left.groupBy("gram").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
                                        F.max("cut").alias("divided")).filter("first < last").drop("last")
        shared = left.join(held.hint("merge"), "gram").withColumn("several", F.col("several") | F.col("divided"))
    shared = materialize(shared.filter("several or doc_id > first").select(
        *text, "gram", "several", "low", "high", "start", "end", "first"), "shared")
    discard(anchors)

    single = _single(documents, shared.filter("several").select(*text, "gram"), gone)
    firsts = single.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter(
        "first < last").drop("last")
    # stretches of one anchor all hold it, so together they are one run
    runs = single.join(firsts.hint("merge"), "key").filter("doc_id > first").groupBy(*text, "anchor").agg(
        *(F.min(c).alias(c) for c in ("low", "start", "first")), *(F.max(c).alias(c) for c in ("high", "end")))

    columns = [*text, "low", "high", "start", "end", "first"]
    rows = shared.filter("not several").select(columns).unionByName(runs.select(columns))
    order = Window.partitionBy(*text).orderBy("low", "high")
    rows = rows.withColumn("reach", F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("run", F.sum(F.when(F.col("low") <= F.col("reach"), 0).otherwise(1)).over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    found = materialize(rows.groupBy(*text, "run").agg(
        *(F.min(c).alias(c) for c in ("low", "start")), *(F.max(c).alias(c) for c in ("high", "end")),
        F.min("first").alias("first_doc_id")).drop("run"), "runs")
    discard(shared, single)
    return found


def repeated_units(documents: DataFrame, sentence_run: int = SENTENCE_RUN) -> DataFrame:
    """doc_id, text_key, unit, start, end, words, first_doc_id, removed: every unit that stands elsewhere as well.

    Unit numbers are even for paragraphs and odd for sentences, each in reading order; that of a run of repeated stretches is
    negative: its first word's number in the text, as -1, -2, ... ``start`` and ``end`` are byte offsets in the text that
    ``text_key`` (a hash) tells among those with one ``doc_id``; ``first_doc_id`` is the document that keeps the unit; ``removed``
    tells whether this one goes. Null and blank texts have no units; rows without ``doc_id`` are left out, as nothing could
    point to them; a row that stands several times is one text; other columns are ignored; texts may be of any length; an
    empty table gives no rows.
    """
    text, facts = ["doc_id", "text_key"], ["start", "end", "low", "words"]
    long = materialize(long_paragraphs(documents), "long")
    spans = long.select("id", "start", "end")
    groups = similar.components(long, lambda pairs: verified(documents, spans, pairs), SHARE)
    near = materialize(_columns(long.select("id", *facts).join(
        groups.select("id", F.col("component").alias("first")), "id")), "near")
    discard(long, groups)

    high = (F.col("low") + F.col("words")).alias("high")
    stretches = repeated_stretches(documents, near.filter("repeated").select(*text, "low", high))
    runs = stretches.select(*text, (-F.col("low") - 1).cast("int").alias("unit"), "start", "end", "low",
                            (F.col("high") - F.col("low")).cast("int").alias("words"), "first_doc_id", F.lit(True).alias("repeated"))
    gone = materialize(near.filter("repeated").unionByName(runs), "gone")
    discard(stretches)

    short = materialize(short_units(documents), "sentences")
    shared = short.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = short.join(shared, "key").select("key", "id", *facts, high, "id.doc_id", "id.text_key")
    whole = with_covered(shared, gone.select(*text, "low", high)).filter("covered = 0").drop("covered", "high", *text)
    whole = materialize(whole, "whole")
    discard(short)
    firsts = whole.groupBy("key").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    equal = _columns(whole.join(firsts, "key"))
    units = gone.unionByName(near.filter("not repeated")).unionByName(equal).drop("low").dropDuplicates([*text, "unit"])
    units = materialize(units, "units")  # of rows that stand twice, their units once
    discard(near, gone, whole)
    return _removed(units, sentence_run)


def _columns(units: DataFrame) -> DataFrame:
    return units.select("id.doc_id", "id.text_key", "id.unit", "start", "end", "low", "words", F.col("first.doc_id").alias("first_doc_id"),
                        (F.col("id") != F.col("first")).alias("repeated"))


def _removed(units: DataFrame, sentence_run: int) -> DataFrame:
    """Mark what goes: repeated paragraphs and runs, and the repeated sentences in a run of ``sentence_run`` repeated words.

    Words are counted by bytes covered once. A run may span a few short words between units.
    """
    order = Window.partitionBy("doc_id", "text_key").orderBy("start", F.desc("end"), "unit")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = units.filter("repeated").withColumn("reach", F.max("end").over(before))
    rows = rows.withColumn("new", F.when(F.col("start") > F.coalesce("reach", F.lit(-10**9)) + 8 * GAP, 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("own", F.when(F.col("end") <= F.coalesce("reach", F.lit(-1)), 0).otherwise(F.col("words")))
    total = Window.partitionBy("doc_id", "text_key", "run")
    sentence = (F.col("unit") > 0) & (F.col("unit") % 2 == 1)  # paragraphs are even, runs negative
    rows = rows.withColumn("removed", ~sentence | (F.sum("own").over(total) >= sentence_run))
    columns = ["doc_id", "text_key", "unit", "start", "end", "words", "first_doc_id", "removed"]
    return rows.select(columns).unionByName(units.filter("not repeated").withColumn("removed", F.lit(False)).select(columns))


def remove_repeats(documents: DataFrame, sentence_run: int = SENTENCE_RUN) -> DataFrame:
    """``documents`` with the repeated passages cut out of ``text`` (and their ``n_chars``, if there is one, set anew).

    Line ends and blanks around a cut stay as they are; a text that is repeated as a whole becomes empty and its row is
    dropped. All other rows and columns stay, those without an id or a text and repeated ones included.
    """
    cuts = (repeated_units(documents, sentence_run).filter("removed").groupBy("doc_id", "text_key")
            .agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("_cuts")))
    cuts = cuts.select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), "_cuts")
    joined = documents.join(cuts, (documents.doc_id == F.col("_doc")) & (F.xxhash64(documents.text) == F.col("_key")), "left").drop("_doc", "_key")
    schema = documents.schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts, keep = [], []
                for text, spans in zip(part.column("text").to_pylist(), part.column("_cuts").to_pylist()):
                    if spans:
                        text = without(text.encode(), [(s["start"], s["end"]) for s in spans]).decode()
                    keep.append(not spans or bool(text.strip()))
                    texts.append(text)
                columns = [part.column(f.name) for f in schema]
                columns[schema.names.index("text")] = pa.array(texts, pa.string())
                if "n_chars" in schema.names:
                    at = schema.names.index("n_chars")
                    counts = [len(t) if spans else n for t, spans, n in zip(
                        texts, part.column("_cuts").to_pylist(), columns[at].to_pylist())]
                    columns[at] = pa.array(counts, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, names=schema.names).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(cut, schema)


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``raw`` without the bytes that the sorted ``spans`` cover."""
    kept, at = [], 0
    for start, end in spans:
        kept.append(raw[at:start])
        at = max(at, end)
    kept.append(raw[at:])
    return b"".join(kept)
