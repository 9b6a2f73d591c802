"""Groups of similar sets: candidate pairs from shared signatures, exact similarity, connected components.

Used by operators whose items are sets of hashed features. An item is one row: ``id``, ``size``, a digest ``a``, ``b`` of the
set, ``hist`` (counts of the features by hash, clipped to a byte) and ``sigs`` (signatures; similar sets share one).

No step forms all pairs of a group. Items with the same set are one class, found by grouping. Within a group of items that
share a signature, each is first compared with the group's smallest item only; what that links is merged. Only groups that
still hold several components go on, and there pairs are formed between components, kept only if the distance of their
histograms (never more than the distance of the sets) allows the similarity. In large groups, a few partners of each item are
tried and merged first, round by round while that links many, so that near copies are one component before all pairs between
components are formed. Groups larger than a block are cut into pairs of blocks, so a task holds two blocks at most.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.llm.texts import mix
from leafgraph.session import discard, materialize

BLOCK_ITEMS = 2048
LARGE = 64  # items of a group of which a few pairs are tried before all
FEW = 3  # partners tried of an item in a round


def histograms(hashes: np.ndarray, rows: np.ndarray, n_rows: int, bins: int) -> np.ndarray:
    """Counts of a row's hashes by their low bits (``bins`` is a power of two), clipped to 255."""
    flat = np.bincount(rows * bins + (hashes & np.uint64(bins - 1)).astype(np.int64), minlength=n_rows * bins)
    return np.minimum(flat, 255).astype(np.uint8).reshape(n_rows, bins)


def set_digests(hashes: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over a row's distinct hashes: equal sets have equal sums."""
    a, b = np.zeros(n_rows, np.uint64), np.zeros(n_rows, np.uint64)
    if len(rows):
        firsts = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        a[rows[firsts]] = np.add.reduceat(mix(hashes), firsts)
        b[rows[firsts]] = np.add.reduceat(mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5)), firsts)
    return a.view(np.int64), b.view(np.int64)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (x, y); the component is its smallest id.

    Each round points every node to its smallest neighbour, follows the pointers to their end by doubling, and contracts the
    edges; nodes that have neighbours at least halve in number each round. Tables are written between rounds.
    """
    edges = materialize(edges.select("x", "y").filter("x <> y").distinct(), "edges")
    labels = edges.select(F.col("x").alias("id")).union(edges.select("y")).distinct().withColumn("component", F.col("id"))
    labels = materialize(labels, "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("y", "x"))
        parent = materialize(both.groupBy(F.col("x").alias("id")).agg(F.min("y").alias("m"))
                             .select("id", F.least("id", "m").alias("p")), "parents")
        moved = True
        while moved:  # every node of this round has a row, so the parent of a parent is found
            up, before = parent.select(F.col("id").alias("p"), F.col("p").alias("q")), parent
            parent = materialize(parent.select("id", "p").join(up, "p").select(
                "id", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")), "parents")
            discard(before)
            moved = not parent.filter("moved").isEmpty()
        before = labels, edges, parent
        labels = materialize(labels.join(parent.select(F.col("id").alias("component"), "p"), "component", "left").select(
            "id", F.coalesce("p", "component").alias("component")), "labels")
        x, y = (parent.select(F.col("id").alias(k), F.col("p").alias(f"p{k}")) for k in "xy")
        edges = materialize(edges.join(x, "x").join(y, "y").filter("px <> py")
                            .select(F.least("px", "py").alias("x"), F.greatest("px", "py").alias("y")).distinct(), "edges")
        discard(*before)
    discard(edges)
    return labels


def may_match(pairs: DataFrame, items: DataFrame, share: tuple[int, int]) -> DataFrame:
    """``pairs`` (x, y) that sizes and histograms don't rule out; ``share`` is the least similarity as a fraction."""
    facts = items.select("id", "size", "hist")
    x, y = (facts.select(*(F.col(c).alias(c + k) for c in facts.columns)) for k in "xy")
    kept = pairs.join(x, pairs.x == F.col("idx")).join(y, pairs.y == F.col("idy"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                hx, hy = (_hist(batch.column(c)) for c in ("histx", "histy"))
                sx, sy = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("sizex", "sizey"))
                ok = possible(hx, hy, sx, sy, share)
                yield batch.select(["x", "y"]).filter(pa.array(ok))

    kind = pairs.schema["x"].dataType.simpleString()
    return kept.select("x", "y", "sizex", "sizey", "histx", "histy").mapInArrow(keep, f"x {kind}, y {kind}")


def possible(hx: np.ndarray, hy: np.ndarray, sx: np.ndarray, sy: np.ndarray, share: tuple[int, int]) -> np.ndarray:
    """Whether sets of these sizes and histograms can have a similarity of ``share``.

    Intersection / union >= p / q means distance * (p + q) <= (q - p) * (sum of sizes).
    """
    p, q = share
    gap = np.abs(hx.astype(np.int16) - hy).sum(axis=-1, dtype=np.int64)
    return (np.minimum(sx, sy) * q >= np.maximum(sx, sy) * p) & (gap * (p + q) <= (q - p) * (sx + sy))


def _hist(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def components(items: DataFrame, verify: Callable[[DataFrame], DataFrame], share: tuple[int, int]) -> DataFrame:
    """(id, component) of the items that have a partner: components of the links that ``verify`` confirms.

    ``verify`` takes pairs (x, y) of ids and returns those that are similar. ``items`` must be a written table. The result is
    one, too; all tables in between are deleted.
    """
    # counted first: the smallest of ids that are structs is found by sorting, which only sets with copies need
    digest = ["a", "b", "size"]
    sets = items.filter("size > 0").select("id", *digest)
    copies = materialize(sets.join(sets.groupBy(digest).agg(F.count("*").alias("n")).filter("n > 1").drop("n"), digest), "copies")
    classes = materialize(copies.join(copies.groupBy(digest).agg(F.min("id").alias("class")), digest).select("id", "class"), "classes")
    discard(copies)
    same = classes.select(F.col("class").alias("x"), F.col("id").alias("y")).filter("x <> y")

    # One exchange by signature: rows of groups of two and more, each with the smallest item of its group.
    rows = items.select(F.explode("sigs").alias("sig"), "id")
    order = Window.partitionBy("sig").orderBy("id")
    shared = (rows.withColumn("pivot", F.first("id").over(order)).withColumn("next", F.lead("id").over(order))
              .filter("pivot <> id or next is not null").select("sig", "id", "pivot"))
    of = classes.filter("id <> class")
    shared = (shared.join(of, "id", "left").select("sig", F.coalesce("class", "id").alias("id"), "pivot")
              .join(of.select(F.col("id").alias("pivot"), F.col("class").alias("pivot_class")), "pivot", "left")
              .select("sig", "id", F.coalesce("pivot_class", "pivot").alias("pivot")))
    shared = materialize(shared, "shared")
    stars = shared.filter("pivot <> id").select(
        F.least("pivot", "id").alias("x"), F.greatest("pivot", "id").alias("y")).distinct()
    stars = materialize(may_match(stars, items, share), "stars")
    links = materialize(verify(stars), "links")
    labels = connected_components(links)

    left = materialize(_open(shared, labels), "open")
    discard(shared, labels)
    tried, links, left = _merge_large(left, stars, links, items, verify, share)
    rest = materialize(_across(left, items, share).join(tried, ["x", "y"], "left_anti"), "rest")
    discard(tried, left)
    if not rest.isEmpty():
        before, links = links, materialize(links.union(verify(rest)), "links")
        discard(before)
    found = connected_components(links.union(same))
    discard(rest, links, classes)
    return found


def _open(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(sig, id, component) of the groups (sig, id) that hold several components."""
    own = rows.join(labels, "id", "left").select("sig", "id", F.coalesce("component", "id").alias("component"))
    open_ = own.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high")
    return own.join(open_.select("sig"), "sig").distinct()


def _merge_large(left: DataFrame, tried: DataFrame, links: DataFrame, items: DataFrame, verify: Callable[[DataFrame], DataFrame],
                 share: tuple[int, int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pairs tried, the links found and the rows of groups still open after rounds over large groups.

    A round tries at most ``FEW`` possible partners of an item in a group, others than the round before; rounds end when less
    than a tenth of what they tried are links. They only save pairs: what they don't link is left to the caller.
    """
    for turn in itertools.count():
        large = left.groupBy("sig").count().filter(F.col("count") >= LARGE).select("sig")
        some = materialize(_across(left.join(large, "sig"), items, share, turn).join(tried, ["x", "y"], "left_anti"), "some")
        n = some.count()
        if not n:
            discard(some)
            return tried, links, left
        new = materialize(verify(some), "new")
        before = tried, links, left, some, new
        tried, links = materialize(tried.union(some), "tried"), materialize(links.union(new), "links")
        labels = connected_components(links)
        left = materialize(_open(left.select("sig", "id"), labels), "open")
        enough = 10 * new.count() < n
        discard(labels, *before)
        if enough:
            return tried, links, left


def _across(rows: DataFrame, items: DataFrame, share: tuple[int, int], turn: int | None = None) -> DataFrame:
    """Possible pairs between different components of a group; at most ``FEW`` partners of an item, if a ``turn`` is given."""
    order = Window.partitionBy("sig").orderBy("id")
    rows = rows.withColumn("block", F.floor((F.row_number().over(order) - 1) / BLOCK_ITEMS).cast("int"))
    counts = rows.groupBy("sig").agg(F.max("block").alias("last"))
    rows = rows.join(counts, "sig").join(items.select("id", "size", "hist"), "id")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    rows = rows.select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "id",
                       F.xxhash64("id", F.lit(turn)).alias("key"), F.xxhash64("component").alias("part"), "size", "hist")
    # groups follow each other in sorted partitions, so that many small ones are one batch
    rows = rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "size")

    few = None if turn is None else FEW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None  # the last group, which the next batch may go on with
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own])
            ends = _group_ends(held)
            if len(ends) > 1:
                yield from _pairs(held.slice(0, int(ends[-2])).combine_chunks(), share, few)
                held = held.slice(int(ends[-2]))
        if held is not None:
            yield from _pairs(held.combine_chunks(), share, few)

    kind = items.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(run, f"x {kind}, y {kind}")
    return found.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _group_ends(rows: pa.Table) -> np.ndarray:
    """Where the groups (sig, i, j) of sorted rows end."""
    new = np.zeros(rows.num_rows - 1, bool)
    for name in ("sig", "i", "j"):
        column = rows.column(name).to_numpy()
        new |= column[1:] != column[:-1]
    return np.append(np.flatnonzero(new) + 1, rows.num_rows)


def _pairs(rows: pa.Table, share: tuple[int, int], few: int | None = None) -> Iterator[pa.RecordBatch]:
    """Possible pairs of each group, of its first block with its second, or within its only one.

    Of each left item at most ``few``, if given: the same in all groups, as far as they hold the same items.
    """
    ids = rows.column("id").combine_chunks()
    ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
    part, block, size, i, j = (rows.column(c).to_numpy().astype(np.int64) for c in ("part", "block", "size", "i", "j"))
    key = rows.column("key").to_numpy().view(np.uint64)
    hist = _hist(rows.column("hist").combine_chunks())
    # sums over more and more bins: the first bounds rule out most pairs
    bounds = [hist.reshape(len(hist), n, -1).sum(axis=2, dtype=np.int16) for n in (8, 64) if n < hist.shape[1]] + [hist]
    p, q = share
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []

    def keep(x: np.ndarray, y: np.ndarray) -> None:
        for counts in bounds:
            if len(x):
                ok = possible(counts[x], counts[y], size[x], size[y], share)
                x, y = x[ok], y[ok]
        if few is not None and len(x):
            order = np.lexsort((mix(mix(key[x]) ^ key[y]), x))
            x, y = x[order], y[order]
            ok = np.arange(len(x)) - np.searchsorted(x, x) < few
            x, y = x[ok], y[ok]
        left.append(x)
        right.append(y)

    begin = 0
    for end in _group_ends(rows):
        group, begin = np.arange(begin, end), end  # by size, so what can match stands together
        same = i[group[0]] == j[group[0]]
        first = group if same else group[block[group] == i[group[0]]]
        second = group if same else group[block[group] == j[group[0]]]
        low = np.searchsorted(size[second], -(-size[first] * p // q))
        high = np.searchsorted(size[second], size[first] * q // p, "right")
        if same:
            low = np.maximum(low, np.arange(len(group)) + 1)
        many = np.maximum(high - low, 0)
        for a in range(0, len(first), 64):  # bounds what is compared at once
            n = many[a:a + 64]
            x = np.repeat(first[a:a + 64], n)
            y = second[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[a:a + 64], n)] if n.sum() else x
            other = part[x] != part[y]
            keep(x[other], y[other])
    x, y = (np.concatenate(side) if side else np.zeros(0, np.int64) for side in (left, right))
    for a in range(0, len(x), 10_000):
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(x[a:a + 10_000])), ids.take(pa.array(y[a:a + 10_000]))], ["x", "y"])
