"""Hard negatives by the threshold algorithm over sorted lists per dimension.

Vectors become whole numbers, so scores are exact. Anchors and candidates are dealt into blocks of bounded size by row, not
by a key, and a task sees one block of each; no label, however common, gathers in a task. In a block of candidates every
dimension has its rows in order. An anchor reads each list from the end that its sign makes the high one, in steps that
double; rows that it meets for the first time are fetched and scored in full. What it has not met cannot score more than the
sum over the dimensions of the anchor's component times the value reached there: once that threshold is strictly below the
lowest score that still matters, nothing is missed, ties included.

Two rounds use it. The first finds an anchor's best rows of its own label, the positives. Each positive opens a window of
scores, up to its own and down to a share of it, and the second round finds the best rows of other labels in each window.
Blocks send their k best per anchor (or window), and a window function keeps the k best of those.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafgraph.session import materialize

ANCHORS = 4096  # rows of a block of anchors
CANDIDATES = 32_768  # rows of a block of candidates
FIRST_DEPTH = 32  # places of each list that the first step reads


def quantise(rows: DataFrame, scale: int, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
             ) -> DataFrame:
    """vec_id, label, q: components as floor(scale * x), of the rows that have an id, a label and only finite components."""
    x = F.col(vector).cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    # scores are sums of products: components of up to 2**26 keep those of some thousand dimensions within a long
    q = F.transform(x, lambda c: F.when(F.abs(c) * scale < 2**26, F.floor(c * scale)).otherwise(
        F.raise_error(F.lit("a component is too large for whole-number scores")).cast("long")))
    return rows.where(F.col(vec_id).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull()).where(whole).select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), q.alias("q"))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of whole numbers, held as doubles where products are exact, followed by zeros up to ``width``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), width))
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    top = np.abs(out).max(initial=0)
    return out if width * top * top < 2**50 else out.astype(np.int64)


class SortedLists:
    """A block of vectors with its rows in ascending order of every dimension."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(vectors, axis=0, kind="stable").T  # dimension x place
        self.steps = [0]
        while self.steps[-1] < len(vectors):
            self.steps.append(min(len(vectors), max(FIRST_DEPTH, 2 * self.steps[-1])))
        n, dims = vectors.shape
        depths = np.array(self.steps[:-1], np.int64)
        across = np.arange(dims)[:, None]
        self.low = vectors[self.order[:, depths], across]  # dimension x step: the value that a step begins with
        self.high = vectors[self.order[:, n - 1 - depths], across]

    def thresholds(self, anchors: np.ndarray) -> np.ndarray:
        """Anchor x step: the most that a row first met in this step or later can score."""
        return np.maximum(anchors, 0) @ self.high + np.minimum(anchors, 0) @ self.low

    def met(self, anchor: np.ndarray, step: int, seen: np.ndarray) -> np.ndarray:
        """Rows that the anchor meets for the first time in a step; marks them as seen."""
        a, b, n = self.steps[step], self.steps[step + 1], len(self.vectors)
        fresh = np.zeros(n, bool)
        fresh[self.order[anchor > 0, n - b:n - a]] = True
        fresh[self.order[anchor < 0, a:b]] = True
        fresh &= ~seen
        seen |= fresh
        return np.flatnonzero(fresh)

    def search(self, anchor: np.ndarray, thresholds: np.ndarray, ids: np.ndarray, allowed: np.ndarray, tops: np.ndarray,
               floors: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per window (floors <= score <= tops) the k best allowed rows, as (rows, scores); ties to the smaller id."""
        if not anchor.any():  # every row scores nothing; no list has an end to begin with
            rows, scores = np.flatnonzero(allowed), np.zeros(int(allowed.sum()), np.int64)
            return [self._best(rows, scores, ids, top, floor, k) for top, floor in zip(tops, floors)]
        seen = np.zeros(len(self.vectors), bool)
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in tops]
        for step in range(len(self.steps) - 1):
            needed = [max(floor, scores[k - 1]) if len(scores) == k else floor for floor, (_, scores) in zip(floors, best)]
            if not needed or thresholds[step] < min(needed):
                break
            rows = self.met(anchor, step, seen)
            rows = rows[allowed[rows]]
            scores = (self.vectors[rows] @ anchor).astype(np.int64)
            for w, (top, floor) in enumerate(zip(tops, floors)):
                best[w] = self._best(np.concatenate([best[w][0], rows]), np.concatenate([best[w][1], scores]), ids, top,
                                     floor, k)
            if seen.all():
                break
        return best

    @staticmethod
    def _best(rows, scores, ids, top, floor, k):
        keep = (scores <= top) & (scores >= floor)
        rows, scores = rows[keep], scores[keep]
        if len(scores) > k:
            keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[keep], scores[keep]
        order = np.lexsort((ids[rows], -scores))[:k]
        return rows[order], scores[order]


def _dealt(rows: DataFrame, own: str, n: int, other: str, n_other: int) -> DataFrame:
    """The rows of a written table with a block each, by their place in it, and once per block of the other side."""
    place = F.monotonically_increasing_id()
    return rows.withColumn(own, F.pmod(place + F.shiftright(place, 33), F.lit(n))).withColumn(
        other, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long"))))


_ALL = np.iinfo(np.int64)


def _meet(anchors: DataFrame, candidates: DataFrame, n_a: int, n_c: int, width: int, k: int, windows: bool) -> DataFrame:
    """Every block of anchors searches every block of candidates: anchor_no, window, vec_id, score.

    Without ``windows`` an anchor looks for rows of its label, in one window of all scores; with them, for rows of other
    labels in the windows that its ``tops`` and ``floors`` name.
    """
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], [], []]
        if left.num_rows and right.num_rows:
            ids = right.column("vec_id").to_numpy()
            labels, own = right.column("label").to_numpy(), left.column("label").to_numpy()
            numbers, anchor_ids = left.column("anchor_no").to_numpy(), left.column("vec_id").to_numpy()
            mat = _matrix(left.column("q"), width)
            vectors = _matrix(right.column("q"), width)
            if windows:
                groups = [(SortedLists(vectors), np.arange(len(ids)), np.arange(len(own)))]
                tops, floors = left.column("tops").to_pylist(), left.column("floors").to_pylist()
            else:
                groups = []
                for label in np.unique(own):
                    rows = np.flatnonzero(labels == label)
                    if len(rows):
                        groups.append((SortedLists(vectors[rows]), rows, np.flatnonzero(own == label)))
            for lists, rows, mine in groups:
                limits = lists.thresholds(mat[mine])
                for a, limit in zip(mine, limits):
                    if windows:
                        allowed, top, floor = labels[rows] != own[a], np.array(tops[a]), np.array(floors[a])
                    else:
                        allowed, top, floor = ids[rows] != anchor_ids[a], np.array([_ALL.max]), np.array([_ALL.min])
                    for w, (found, scores) in enumerate(lists.search(mat[a], limit, ids[rows], allowed, top, floor, k)):
                        for column, values in zip(out, (np.full(len(found), numbers[a]), np.full(len(found), w),
                                                        ids[rows][found], scores)):
                            column.append(values)
        columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], ["anchor_no", "window", "vec_id", "score"])

    left, right = _dealt(anchors, "_a", n_a, "_c", n_c), _dealt(candidates, "_c", n_c, "_a", n_a)
    found = left.groupBy("_a", "_c").cogroup(right.groupBy("_a", "_c")).applyInArrow(
        run, "anchor_no long, window long, vec_id long, score long")
    order = Window.partitionBy("anchor_no", "window").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor, scale: int = 256, n_positives: int = 5, n_negatives: int = 5,
                   share: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, embedding and label; ``is_anchor`` is a condition on vec_id. Rows with a null id, label or vector,
    or a component that is null or not finite, take no part; a component over 2**26 after scaling raises. A shorter vector
    counts as followed by zeros. An anchor's positives are the ``n_positives`` best other rows of its label; of the rows of
    other labels that score from ``share`` of a positive up to the positive, the ``n_negatives`` best are returned, ties by
    smaller id. Rows with the anchor's own id are never its positives. Repeated rows are positives and negatives one by one,
    but an anchor that stands several times in equal rows is asked once. Other columns are ignored; an empty table gives no
    rows.
    """
    spark = rows.sparkSession
    rows = materialize(quantise(rows, scale), "vectors")
    anchors = rows.where(is_anchor(F.col("vec_id"))).dropDuplicates(["vec_id", "label", "q"])
    anchors = materialize(anchors.withColumn("anchor_no", F.monotonically_increasing_id()), "anchors")
    facts = rows.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("width")).first()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_c = max(-(-facts["n"] // CANDIDATES), min(parts, -(-facts["n"] // 1024)), 1)
    n_a = max(-(-anchors.count() // ANCHORS), 1)
    width = max(facts["width"] or 0, 1)

    best = materialize(_meet(anchors, rows, n_a, n_c, width, n_positives, False), "positives")
    floor = F.expr(f"(cast(score as decimal(20, 0)) * {share[0]} + {share[1] - 1}) div {share[1]}")
    of_anchor = best.where("score >= 0").groupBy("anchor_no").agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.col("vec_id").alias("id"), "score", floor.alias("floor")))).alias("p"))  # n_positives at most
    asked = materialize(anchors.join(of_anchor, "anchor_no").select(
        "*", F.col("p.score").alias("tops"), F.col("p.floor").alias("floors")), "windows")
    found = _meet(asked, rows, n_a, n_c, width, n_negatives, True)
    names = asked.select("anchor_no", F.col("vec_id").alias("anchor_id"), F.posexplode("p").alias("window", "p"))
    return found.join(names.withColumn("window", F.col("window").cast("long")), ["anchor_no", "window"]).select(
        "anchor_id", F.col("p.id").alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("score").alias("negative_score"))
