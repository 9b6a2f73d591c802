"""The kernel of exact nearest-neighbour search: blocks of questions meet blocks of vectors, for any number of either.

Both sides are packed into rows that hold a block each. Blocks of either are written once, so the plans that make questions and
vectors run once, however many pairs of blocks there are; vectors are packed where they lie and never shuffled. A product of
block rows (not of questions and vectors) brings every pair of blocks into a task, which keeps the k best per question over
all blocks that it sees; only those leave it.

Within a block, vectors are ordered into small groups of near ones. A group whose centroid and radius say, by the triangle
inequality, that nothing in it can be among a question's k best is skipped for that question. The others are multiplied in
single precision; only pairs that may be among the k best, given what rounding can do to a product, get their true distance.
Filters are masks inside the kernel, so a filter value that most vectors have is no hot key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafgraph.functions import vectors as V
from leafgraph.session import materialize, spread

BLOCK_BYTES = 4 << 20  # of one pair's vectors in a block row
QUESTION_BYTES = 4 << 20
GROUP_ROWS = 512  # vectors of a group with a centroid of its own
PAIRS = 1 << 14  # whose true distance is computed at once
# Distances are compared and reported to this many digits, so that the order does not depend on how rows were blocked.
DIGITS = 9
_SLACK = 1e-7  # what rounding can do to a bound


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _near_groups(matrix: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows in groups of at most ``size``, cut at the median of the widest dimension again and again."""
    done, left = [], [rows]
    while left:
        some = left.pop()
        if len(some) <= size:
            done.append(some)
            continue
        part = matrix[some]
        order = some[np.argsort(part[:, np.argmax(part.max(0) - part.min(0))], kind="stable")]
        left += [order[len(order) // 2:], order[:len(order) // 2]]
    return done


def _rows_of(batches: Iterable[pa.RecordBatch], size: Callable[[pa.RecordBatch], int], limit: int) -> Iterator[pa.RecordBatch]:
    """Batches put together or cut so that each is close to ``limit`` bytes of vectors."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        per = max(1, limit // max(1, size(batch)))
        for at in range(0, batch.num_rows, per):
            part = batch.slice(at, per)
            if held and n + part.num_rows > per:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _filters(batch: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Filter codes (row x filter), and where they are given."""
    columns = [batch.column(f"_on{i}") for i in range(n)]
    given = np.array([c.is_valid().to_numpy(zero_copy_only=False) for c in columns], bool).reshape(n, batch.num_rows)
    codes = np.array([c.fill_null(0).to_numpy() for c in columns], np.int64).reshape(n, batch.num_rows)
    return np.ascontiguousarray(codes.T), np.ascontiguousarray(given.T)


def _one_row(values: dict[str, pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(values.values()), names=list(values))


def _complete(batches: Iterable[pa.RecordBatch], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Rows that have all their vectors. Left out here, as a condition of the plan would make a vector twice to ask for it."""
    for batch in batches:
        there = np.ones(batch.num_rows, bool)
        for name in names:
            there &= batch.column(name).is_valid().to_numpy(zero_copy_only=False)
        yield batch if there.all() else batch.filter(pa.array(there))


def _pack_questions(questions: DataFrame, n_pairs: int, keys: list[str], n_on: int) -> DataFrame:
    key_type = questions.select(*keys).schema
    names = [f"_q{i}" for i in range(n_pairs)]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rows_of(_complete(batches, names), lambda b: 8 * (len(b.column("_q0").flatten()) // b.num_rows), QUESTION_BYTES):
            own = pa.StructArray.from_arrays([batch.column(c) for c in keys], names=keys)
            codes, given = _filters(batch, n_on)
            yield _one_row({
                "keys": pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), own),
                "ks": pa.array([batch.column("_k").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                "wanted": pa.array([codes.tobytes()], pa.binary()), "wants": pa.array([given.tobytes()], pa.binary()),
                **{f"q{i}": pa.array([_matrix(batch.column(f"_q{i}")).astype(np.float64).tobytes()], pa.binary())
                   for i in range(n_pairs)}})

    schema = T.StructType([T.StructField("keys", T.ArrayType(key_type)), *[T.StructField(c, T.BinaryType()) for c in (
        "ks", "wanted", "wants", *[f"q{i}" for i in range(n_pairs)])]])
    packed = questions.hint("rebalance").mapInArrow(pack, schema)
    return materialize(packed, "questions").withColumn("block_no", F.monotonically_increasing_id())


def _pack_vectors(vectors: DataFrame, n_pairs: int, n_on: int) -> DataFrame:
    own = [f"_v{i}" for i in range(n_pairs)]

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _rows_of(_complete(batches, own), lambda b: 4 * (len(b.column("_v0").flatten()) // b.num_rows), BLOCK_BYTES):
            mats = [_matrix(batch.column(f"_v{i}")) for i in range(n_pairs)]
            groups = _near_groups(mats[0], np.arange(batch.num_rows), GROUP_ROWS)
            order = np.concatenate(groups)
            codes, given = _filters(batch, n_on)
            yield _one_row({
                "ids": pa.array([batch.column("doc_id").to_numpy()[order].tobytes()], pa.binary()),
                "ends": pa.array([np.cumsum([len(g) for g in groups]).astype(np.int64).tobytes()], pa.binary()),
                "codes": pa.array([codes[order].tobytes()], pa.binary()), "given": pa.array([given[order].tobytes()], pa.binary()),
                **{f"v{i}": pa.array([m[order].tobytes()], pa.binary()) for i, m in enumerate(mats)}})

    names = ("ids", "ends", "codes", "given", *[f"v{i}" for i in range(n_pairs)])
    packed = spread(vectors, "doc_id").mapInArrow(pack, ", ".join(f"{c} binary" for c in names))
    return materialize(packed, "vectors").withColumn("vectors_no", F.monotonically_increasing_id())


def _distances(products: np.ndarray, squares: np.ndarray, others: np.ndarray, metric: str) -> np.ndarray:
    """Distances, infinite where undefined (an all-zero vector under cosine), from inner products and squared norms."""
    if metric == "inner":
        out = -products
    elif metric == "l2":
        out = np.sqrt(np.maximum(squares + others - 2 * products, 0.0))
    else:
        norms = np.sqrt(squares) * np.sqrt(others)
        with np.errstate(divide="ignore", invalid="ignore"):
            out = np.where(norms > 0, 1.0 - products / norms, np.inf)
    return np.round(out, DIGITS)


def _square(rows: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", rows, rows)


def _ball(block: np.ndarray, metric: str) -> tuple[np.ndarray, float] | None:
    """Centroid and radius of vectors, of unit length under cosine; None where there are none."""
    if metric == "cosine":
        norms = np.sqrt(_square(block))
        some = norms > 0
        block = block[some] / norms[some, None]
    if not len(block):
        return None
    centre = block.mean(0)
    return centre, float(np.sqrt(_square(block - centre).max()))


def _over(norms: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows over their norms, zeros where those are zero or not finite."""
    some = np.isfinite(norms) & (norms > 0)
    return np.where(some[:, None], rows, 0.0) / np.where(some, norms, 1.0)[:, None]


class _Group:
    """Near vectors, with what any question asks of them.

    ``rows`` has per list what the single-precision product takes of a vector: its parts of unit length side by side under
    cosine; else over ``scale``, the largest norm, and for l2 with half the squared norm in a further place.
    """

    def __init__(self, ids: np.ndarray, mats: list[np.ndarray], codes: np.ndarray, given: np.ndarray,
                 lists: Sequence[Sequence[int]], metric: str):
        self.ids, self.mats, self.codes, self.given = ids, mats, codes, given
        wide = {i: mats[i].astype(np.float64) for i in sorted({i for pairs in lists for i in pairs})}
        with np.errstate(invalid="ignore", over="ignore"):
            self.squares = {i: _square(m) for i, m in wide.items()}
            self.balls = {i: _ball(m, metric) for i, m in wide.items()}
            self.rows, self.scale, self.odd, self.zero = [], [], [], []
            for pairs in lists:
                norms = {i: np.sqrt(self.squares[i]) for i in pairs}
                self.odd.append(~np.isfinite(sum(norms.values())))
                self.zero.append(np.any([norms[i] == 0 for i in pairs], axis=0) & (metric == "cosine"))
                scale = 1.0
                if metric == "cosine":
                    rows = np.concatenate([_over(norms[i], wide[i]) for i in pairs], axis=1)
                elif metric == "inner":
                    rows = np.concatenate([wide[i] for i in pairs], axis=1)
                else:
                    rows = np.concatenate([wide[pairs[0]], -self.squares[pairs[0]][:, None] / 2], axis=1)
                if metric != "cosine":
                    rows = np.where(self.odd[-1][:, None], 0.0, rows)
                    scale = max(float(np.sqrt(_square(rows).max(initial=0.0))), 1e-300)
                    rows = rows / scale
                self.rows.append(rows.astype(np.float32))
                self.scale.append(scale)


class _Block:
    """Questions of one block and their best hits, per list."""

    def __init__(self, row: dict, lists: Sequence[Sequence[int]], n_pairs: int, n_on: int, metric: str):
        self.keys, self.metric, self.lists = row["keys"], metric, lists
        # a view would hold the whole batch that brought the row
        self.ks = np.frombuffer(row["ks"], np.int64).copy()
        self.n = len(self.ks)
        self.mats = [np.frombuffer(row[f"q{i}"], np.float64).reshape(self.n, -1).copy() for i in range(n_pairs)]
        self.wanted = np.frombuffer(row["wanted"], np.int64).reshape(self.n, n_on).copy()
        self.wants = np.frombuffer(row["wants"], bool).reshape(self.n, n_on).copy()
        none = np.zeros(0, np.int64)
        self.best = [(none, np.zeros(0), none) for _ in lists]  # question, distance, id, in this order
        self.found = [[] for _ in lists]  # hits that are not yet among the best
        self.worst = [np.full(self.n, np.inf) for _ in lists]  # of the k best; infinite while there are fewer
        self.last = [np.full(self.n, np.iinfo(np.int64).max) for _ in lists]  # id of the worst
        self.full = [np.zeros(self.n, bool) for _ in lists]
        self.compared = 0
        with np.errstate(invalid="ignore", over="ignore"):
            self.squares = [_square(m) for m in self.mats]
            self.rows, self.norms, self.blank, self.odd, self.error = [], [], [], [], []
            for pairs in lists:
                norms = [np.sqrt(self.squares[i]) for i in pairs]
                blank = np.any([~(x > 0) for x in norms], axis=0) & (metric == "cosine")
                if metric == "cosine":
                    rows, own = np.concatenate([_over(x, self.mats[i]) for x, i in zip(norms, pairs)], axis=1), np.ones(self.n)
                else:
                    rows = [self.mats[i] for i in pairs] if metric == "inner" else [self.mats[pairs[0]], np.ones((self.n, 1))]
                    rows = np.concatenate(rows, axis=1)
                    own = np.sqrt(_square(rows))
                    rows = _over(own, rows)
                self.odd.append(~np.isfinite(sum(norms)) & ~blank)
                self.blank.append(blank)
                self.norms.append(np.where(np.isfinite(own), np.maximum(own, 1e-300), 1.0))
                self.rows.append(rows.astype(np.float32))
                # twice what rounding does to a product in single precision
                self.error.append((rows.shape[1] + 8) * 2.0 ** -23 * (len(pairs) if metric == "cosine" else 1))

    def add(self, ids: np.ndarray, mats: list[np.ndarray], codes: np.ndarray, given: np.ndarray) -> None:
        self.meet([_Group(ids, mats, codes, given, self.lists, self.metric)])

    def meet(self, groups: list[_Group], buffer: np.ndarray | None = None) -> None:
        least = {i: self._least(i, [g.balls[i] for g in groups]) for i in sorted({i for pairs in self.lists for i in pairs})}
        for n, pairs in enumerate(self.lists):
            bound = sum(least[i] for i in pairs)
            for at, group in enumerate(groups):
                near = np.flatnonzero(~self.full[n] | ~(bound[:, at] > self.worst[n]))
                if not len(near) or not len(group.ids):
                    continue
                if len(near) > 0.9 * self.n:
                    near = np.arange(self.n)
                self.compared += len(near) * len(group.ids)
                self._search(n, near, group, buffer)
                if sum(len(x[0]) for x in self.found[n]) >= self.n:
                    self._keep(n)
            self._keep(n)

    def _least(self, pair: int, balls: list[tuple[np.ndarray, float] | None]) -> np.ndarray:
        """Per question and group a distance that no vector of the group undercuts, from its centroid and radius."""
        some = [i for i, ball in enumerate(balls) if ball is not None]
        out = np.full((self.n, len(balls)), np.inf)
        if not some:
            return out
        centres, radius = np.array([balls[i][0] for i in some]), np.array([balls[i][1] for i in some])
        with np.errstate(all="ignore"):
            products, squares, mine = self.mats[pair] @ centres.T, _square(centres), self.squares[pair][:, None]
            norms = np.sqrt(mine)
            if self.metric == "inner":
                found = -(products + norms * radius) - _SLACK * (1 + norms * (radius + np.sqrt(squares)))
            elif self.metric == "l2":
                apart = np.sqrt(np.maximum(mine + squares - 2 * products, 0.0))
                found = np.maximum(apart - radius - _SLACK * (1 + norms + np.sqrt(squares)), 0.0) - _SLACK
            else:  # half the squared distance of unit vectors
                apart = np.sqrt(np.maximum(1 + squares - 2 * products / norms, 0.0))
                found = np.maximum(apart - radius - _SLACK, 0.0) ** 2 / 2 - _SLACK
        out[:, some] = np.where(np.isnan(found), -np.inf, found)
        return out

    def _least_product(self, n: int, rows: np.ndarray, worst: np.ndarray, scale: float) -> np.ndarray:
        """What the product of a vector is at least if its distance is not beyond ``worst``."""
        worst = worst + 2e-9 + 1e-12 * np.abs(worst)
        if self.metric == "cosine":
            return len(self.lists[n]) - worst - self.error[n]
        size = self.norms[n][rows] * scale
        if self.metric == "inner":
            return -worst / size - self.error[n]
        mine = self.squares[self.lists[n][0]][rows]
        return ((1 - 1e-14) * mine - worst ** 2) / 2 / size - self.error[n]

    def _most_distance(self, n: int, rows: np.ndarray, products: np.ndarray, scale: float) -> np.ndarray:
        """The distance that a vector with such a product is at most away."""
        products = products.astype(np.float64) - self.error[n]
        if self.metric == "cosine":
            return len(self.lists[n]) - products
        products = products * self.norms[n][rows] * scale
        return -products if self.metric == "inner" else np.sqrt(np.maximum(self.squares[self.lists[n][0]][rows] - 2 * products, 0.0))

    def _allowed(self, q: np.ndarray, v: np.ndarray, group: _Group) -> np.ndarray:
        """Whether pairs of a question and a vector agree where the question asks; for indexes that broadcast."""
        out = np.ones(np.broadcast_shapes(q.shape, v.shape), bool)
        for f in range(self.wants.shape[1]):
            out &= ~self.wants[q, f] | (group.given[v, f] & (self.wanted[q, f] == group.codes[v, f]))
        return out

    def _search(self, n: int, near: np.ndarray, group: _Group, buffer: np.ndarray | None) -> None:
        blank = self.blank[n][near]
        if blank.any():  # equally far from all, so the smallest ids count
            self._take(n, *self._smallest(n, near[blank], group), group)
            near = near[~blank]
        if not len(near):
            return
        rows, size = self.rows[n] if len(near) == self.n else self.rows[n][near], len(near) * len(group.ids)
        out = None if buffer is None or len(buffer) < size else buffer[:size].reshape(len(near), -1)
        products = np.matmul(rows, group.rows[n].T, out=out)
        worst, most = self.worst[n][near], int(self.ks[near].max())
        some = np.flatnonzero(~self.full[n][near])
        if len(some) and most <= len(group.ids) and (self.metric != "l2" or len(self.lists[n]) == 1):
            own = products[some]
            own[:, group.zero[n] | group.odd[n]] = -np.inf
            if self.wants.shape[1]:
                own[~self._allowed(near[some][:, None], np.arange(len(group.ids))[None, :], group)] = -np.inf
            place = len(group.ids) - most
            reached = np.partition(own, place, axis=1)[:, place]
            with np.errstate(invalid="ignore"):
                worst[some] = np.where(np.isfinite(reached), self._most_distance(n, near[some], reached, group.scale[n]), np.inf)
        with np.errstate(over="ignore"):
            least = self._least_product(n, near, worst, group.scale[n])
            least[self.odd[n][near] | ~np.isfinite(worst)] = -np.inf
            hit = products >= least.astype(np.float32)[:, None]
        if group.odd[n].any():
            hit[:, group.odd[n]] = True
        at = np.flatnonzero(hit)
        if len(at):
            q, v = np.divmod(at, len(group.ids))
            self._take(n, near[q], v, group)

    def _smallest(self, n: int, rows: np.ndarray, group: _Group) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of these questions with the vectors of the smallest ids, as far as they may count."""
        v = np.arange(len(group.ids))
        most = int(self.ks[rows].max())
        if not self.wants.shape[1] and most < len(v):
            v = np.argpartition(group.ids, most - 1)[:most]
        q, at = np.nonzero(group.ids[v][None, :] < self.last[n][rows][:, None])
        return rows[q], v[at]

    def _take(self, n: int, q: np.ndarray, v: np.ndarray, group: _Group) -> None:
        """Of these pairs those that are allowed and better than the k-th best so far, with their true distance."""
        if self.wants.shape[1]:
            keep = self._allowed(q, v, group)
            q, v = q[keep], v[keep]
        if not len(q):
            return
        asked = np.unique(q)
        if 8 * len(q) > len(asked) * len(group.ids):
            with np.errstate(invalid="ignore", over="ignore"):
                own = {i: _distances(self.mats[i][asked] @ group.mats[i].astype(np.float64).T, self.squares[i][asked][:, None],
                                     group.squares[i][None, :], self.metric) for i in self.lists[n]}
            d = np.round(sum(own[i] for i in self.lists[n]), DIGITS)[np.searchsorted(asked, q), v]
        else:
            d = np.empty(len(q))
            for begin in range(0, len(q), PAIRS):
                x, y = q[begin:begin + PAIRS], v[begin:begin + PAIRS]
                with np.errstate(invalid="ignore", over="ignore"):
                    own = [_distances(np.einsum("ij,ij->i", self.mats[i][x], group.mats[i][y].astype(np.float64)),
                                      self.squares[i][x], group.squares[i][y], self.metric) for i in self.lists[n]]
                d[begin:begin + PAIRS] = np.round(sum(own), DIGITS)
        ids, worst = group.ids[v], self.worst[n][q]
        keep = (d < worst) | ((d == worst) & (ids < self.last[n][q]))
        if keep.any():
            self.found[n].append((q[keep], d[keep], ids[keep]))

    def _keep(self, n: int) -> None:
        if not self.found[n]:
            return
        q, d, i = (np.concatenate(parts) for parts in zip(self.best[n], *self.found[n]))
        self.found[n] = []
        order = np.lexsort((i, d, q))
        q, d, i = q[order], d[order], i[order]
        first = np.searchsorted(q, np.arange(self.n))
        keep = np.arange(len(q)) - first[q] < self.ks[q]
        self.best[n] = q, d, i = q[keep], d[keep], i[keep]
        count = np.bincount(q, minlength=self.n)
        self.full[n] = count >= self.ks
        last = np.maximum(np.cumsum(count) - 1, 0)
        whole = self.full[n] & (count > 0)
        self.worst[n] = np.where(whole, d[last], np.inf)
        self.last[n] = np.where(whole, i[last], np.iinfo(np.int64).max)

    def hits(self) -> Iterator[pa.RecordBatch]:
        for n, (q, d, i) in enumerate(self.best):
            keys = self.keys.take(pa.array(q))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(q), n, np.int32)), *keys.flatten(), pa.array(i),
                 pa.array(d, pa.float64(), mask=~np.isfinite(d))],
                names=["list", *[f.name for f in keys.type], "doc_id", "distance"])


def search_blocks(questions: DataFrame, vectors: DataFrame, pairs: Sequence[tuple[str, str]], lists: Sequence[Sequence[int]],
                  k: Column, metric: str, keys: list[str], doc_id: str, on: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """``(list, *keys, doc_id, distance)``: of every task the k best vectors per question and list.

    A list adds the distances of its ``pairs`` (places in it). ``on`` pairs a question column with a column of the vectors that
    must be equal (told by a 64-bit hash of the value as text); a null on the question's side asks for nothing. Rows without
    a vector take no part; an all-zero one has no cosine distance and comes last.
    """
    def coded(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.xxhash64(F.col(name).cast("string")))

    qs = questions.select(*keys, k.cast("int").alias("_k"), *[V.as_double(F.col(q)).alias(f"_q{n}") for n, (q, _) in enumerate(pairs)],
                          *[coded(q).alias(f"_on{n}") for n, (q, _) in enumerate(on)])
    vs = vectors.select(F.col(doc_id).cast("long").alias("doc_id"), *[F.col(v).alias(f"_v{n}") for n, (_, v) in enumerate(pairs)],
                        *[coded(v).alias(f"_on{n}") for n, (_, v) in enumerate(on)])
    qs = qs.where("_k > 0")
    kinds = [np.dtype(np.float32 if isinstance(vs.schema[f"_v{n}"].dataType.elementType, T.FloatType) else np.float64)
             for n in range(len(pairs))]
    vs = vs.withColumns({f"_v{n}": F.col(f"_v{n}").cast("array<float>" if kind.itemsize == 4 else "array<double>")
                         for n, kind in enumerate(kinds)})
    n_pairs, n_on = len(pairs), len(on)
    blocks = _pack_questions(qs, n_pairs, keys, n_on)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: dict[int, _Block] = {}
        held, groups, buffer = None, [], np.empty(0, np.float32)
        for batch in batches:
            for i, (no, vectors_no) in enumerate(zip(batch.column("block_no").to_pylist(), batch.column("vectors_no").to_pylist())):
                row = lambda name: batch.column(name)[i].as_buffer()  # noqa: E731, B023
                if no not in asked:
                    own = {c: row(c) for c in ("ks", "wanted", "wants", *[f"q{n}" for n in range(n_pairs)])}
                    mine = batch.column("keys")[i].values
                    asked[no] = _Block(own | {"keys": mine.take(pa.array(range(len(mine))))}, lists, n_pairs, n_on, metric)
                if vectors_no != held:  # a block of vectors meets the task's question blocks one after another
                    held, groups, begin = vectors_no, [], 0
                    ids = np.frombuffer(row("ids"), np.int64).copy()
                    mats = [np.frombuffer(row(f"v{n}"), kind).reshape(len(ids), -1).copy() for n, kind in enumerate(kinds)]
                    codes = np.frombuffer(row("codes"), np.int64).reshape(len(ids), n_on).copy()
                    given = np.frombuffer(row("given"), bool).reshape(len(ids), n_on).copy()
                    for end in np.frombuffer(row("ends"), np.int64):
                        part = slice(begin, end)
                        groups.append(_Group(ids[part], [m[part] for m in mats], codes[part], given[part], lists, metric))
                        begin = end
                size = asked[no].n * max((len(g.ids) for g in groups), default=0)
                buffer = buffer if len(buffer) >= size else np.empty(size, np.float32)
                asked[no].meet(groups, buffer)
        for block in asked.values():
            yield from block.hits()

    schema = T.StructType([T.StructField("list", T.IntegerType()), *questions.select(*keys).schema.fields,
                           T.StructField("doc_id", T.LongType()), T.StructField("distance", T.DoubleType())])
    met = _pack_vectors(vs, n_pairs, n_on).crossJoin(blocks.hint("shuffle_replicate_nl"))
    return met.mapInArrow(run, schema)
