"""Quality without hand-made labels: heuristic labellers, a label model, and a classifier trained on its posteriors.

Each labeller votes good, bad or abstains. The vote patterns of all documents are counted in one aggregation (there are at
most 3^labellers of them, whatever the corpus), and expectation-maximisation on the counts estimates how each labeller votes
on good and on bad documents, and with that a posterior for every pattern. A logistic scorer over hashed word shapes is then
trained on the posteriors of ``TRAIN_DOCS`` documents (the ones with the smallest hashes of id and text), and scores every
document. Narrow but for the two small aggregations; texts aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgraph.llm.texts import BLANKS, BYTE_CODES, blocks, mix, span_hashes, word_spans

TRAIN_DOCS = 4000
FEATURES = 2048
ROUNDS = 60
EPOCHS = 200
PRIOR_WEIGHT, FALSE_ALARM, FOUND = 0.1, 0.01, 0.3

#: Labellers as (name, share of a document, bad from, good up to); a low share is good, or a high one if "good up to" is more.
LABELLERS = (
    ("symbols", 0.10, 0.02),      # words that end in two or more equal signs
    ("capitals", 0.30, 0.10),     # words in capitals
    ("repeats", 0.12, 0.03),      # words equal to the one before
    ("bars", 0.08, 0.005),        # words that are a bar
    ("variety", 0.25, 0.45),      # distinct words, of texts of 50 words and more
    ("short_words", 0.05, 0.15),  # words of up to three letters
    ("length", 0, 12),            # words
)

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[97:123] = ord("a")
_CLASS[65:91] = ord("A")
_CLASS[48:58] = ord("0")
_CLASS[128:] = ord("a")
_SIGNS = np.zeros(256, bool)
_SIGNS[[c for c in range(33, 127) if not chr(c).isalnum()]] = True


def _per_row(values: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    return np.bincount(rows, weights=values, minlength=n_rows)


def votes_and_shares(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of each text: the labellers' votes (-1 bad, 0 none, 1 good), and what they judge by."""
    n_rows = len(offsets) - 1
    starts, ends, rows = word_spans(data, offsets, BLANKS)
    n = np.bincount(rows, minlength=n_rows)
    some = np.maximum(n, 1)
    words = span_hashes(data, starts, ends)
    last, lengths = data[ends - 1], ends - starts
    doubled = (lengths > 2) & _SIGNS[last] & (data[np.maximum(ends - 2, 0)] == last)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    lower = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    capitals = (upper[ends] - upper[starts] >= 1) & (lower[ends] == lower[starts]) & (lengths > 1)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (rows[1:] == rows[:-1])
    order = np.lexsort((words, rows))
    fresh = np.ones(len(words), bool)
    fresh[1:] = (words[order][1:] != words[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    variety = np.bincount(rows[order][fresh], minlength=n_rows) / some
    shares = [_per_row(doubled, rows, n_rows) / some, _per_row(capitals, rows, n_rows) / some,
              _per_row(again, rows, n_rows) / some,
              _per_row((lengths == 1) & (last == ord("|")), rows, n_rows) / some,
              variety, _per_row((lengths <= 3) & ~_SIGNS[last], rows, n_rows) / some, n]
    votes = np.zeros((n_rows, len(LABELLERS)), np.int8)
    for k, ((_, bad, good), share) in enumerate(zip(LABELLERS, shares)):
        votes[:, k] = (np.where(share >= bad, -1, np.where(share <= good, 1, 0)) if bad > good else
                       np.where(share <= bad, -1, np.where(share >= good, 1, 0)))
    votes[n < 50, 4] = 0
    votes[n < 20, 5] = 0
    return votes, shares


def measure(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text: the labellers' votes, and its hashed features."""
    votes, shares = votes_and_shares(offsets, data)
    n_rows = len(offsets) - 1
    repeats, variety, n = shares[2], shares[4], shares[6]
    some = np.maximum(n, 1)
    kinds = _CLASS[data]
    equal = np.zeros(len(kinds), bool)
    equal[1:] = kinds[1:] == kinds[:-1]
    keep = np.ones(len(kinds), bool)
    keep[2:] = ~(equal[2:] & equal[1:-1])
    for cut in offsets[1:-1]:
        keep[cut:cut + 2] = True
    places = np.concatenate([[0], np.cumsum(keep)])
    starts, ends, rows = word_spans(kinds[keep], places[offsets], BLANKS)
    shape = span_hashes(kinds[keep], starts, ends, BYTE_CODES)
    pair = mix(shape[1:] + shape[:-1] * np.uint64(3))[rows[1:] == rows[:-1]] if len(shape) else shape
    size = np.uint64(FEATURES - 32)
    features = np.zeros((n_rows, FEATURES), np.float32)
    for values, at in ((shape, rows), (pair, rows[1:][rows[1:] == rows[:-1]] if len(rows) else rows)):
        flat = at * FEATURES + (values % size).astype(np.int64)
        features += np.bincount(flat, minlength=n_rows * FEATURES).reshape(n_rows, FEATURES)
    features = np.sqrt(features / np.maximum(2 * n, 1)[:, None])
    every = np.arange(n_rows)
    features[every, FEATURES - 32 + np.minimum(np.log2(some).astype(np.int64), 15)] = 0.5
    features[every, FEATURES - 16 + np.minimum((variety * 8).astype(np.int64), 7)] = 0.5
    features[every, FEATURES - 8 + np.minimum((repeats * 8).astype(np.int64), 7)] = 0.5
    return votes, features


def pattern_of(votes: np.ndarray) -> np.ndarray:
    """Votes of a row as one number in base three."""
    return (votes.astype(np.int64) + 1) @ (3 ** np.arange(votes.shape[1], dtype=np.int64))


def vote_patterns(documents: DataFrame) -> DataFrame:
    """pattern and number of documents."""
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, offsets, data in blocks(batch.column("text")):
                votes, _ = votes_and_shares(offsets, data)
                pattern, count = np.unique(pattern_of(votes), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pattern), pa.array(count)], ["pattern", "n"])

    return documents.select("text").mapInArrow(vote, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n"))


@dataclass
class LabelModel:
    """What expectation-maximisation found."""

    prior: float               # share of good documents
    votes: np.ndarray          # labeller x class (bad, good) x vote (bad, none, good): probabilities, given that it votes
    posterior: dict[int, float]

    def accuracy(self) -> dict[str, float]:
        """Of each labeller, when it votes."""
        joint = self.votes * np.array([1 - self.prior, self.prior])[None, :, None]
        right = joint[:, 0, 0] + joint[:, 1, 2]
        return dict(zip((x[0] for x in LABELLERS), right / np.maximum(right + joint[:, 0, 2] + joint[:, 1, 0], 1e-12)))


def fit_label_model(counts: dict[int, int], rounds: int = ROUNDS) -> LabelModel:
    """Expectation-maximisation over vote patterns, labellers independent given the class.

    An abstention says nothing. As each labeller looks for one kind of junk, one bad vote outweighs good ones at the start,
    and a prior worth ``PRIOR_WEIGHT`` of the corpus holds that a labeller gives a false alarm on ``FALSE_ALARM`` of the good
    documents and finds ``FOUND`` of the bad ones.
    """
    m = len(LABELLERS)
    patterns = np.array(sorted(counts), np.int64)
    n = np.array([counts[p] for p in patterns.tolist()], float)
    votes = patterns[:, None] // 3 ** np.arange(m) % 3
    if not len(n):
        return LabelModel(0.5, np.full((m, 2, 3), 1 / 3), {})
    bad = (votes == 0).sum(axis=1)
    good = np.where(bad == 0, 0.97, np.where(bad == 1, 0.15, 0.02))
    weight = max(1.0, PRIOR_WEIGHT * n.sum())
    belief = np.array([FOUND, 0, 1 - FOUND]), np.array([FALSE_ALARM, 0, 1 - FALSE_ALARM])
    for _ in range(rounds):
        prior = (good @ n + weight / 2) / (n.sum() + weight)
        table = np.ones((m, 2, 3))
        for c, share in enumerate((1 - good, good)):
            for v in (0, 2):
                table[:, c, v] = (votes == v).T @ (share * n) + weight * belief[c][v]
        table[:, :, ::2] /= table[:, :, ::2].sum(axis=2, keepdims=True)
        log = np.log(table)
        ratio = sum(log[k, 1, votes[:, k]] - log[k, 0, votes[:, k]] for k in range(m)) + np.log(prior / (1 - prior))
        good = 1 / (1 + np.exp(-np.clip(ratio, -30, 30)))
    return LabelModel(float(prior), table, dict(zip(patterns.tolist(), good.tolist())))


def training_sample(documents: DataFrame, n: int, limit: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray]:
    """Vote patterns and features of the ``limit`` documents with the smallest hashes, of ``n``.

    A bound on the hash leaves about twice as many as are wanted, so that few rows meet where they are ordered.
    """
    below = min((1 << 63) - 1, -(1 << 63) + int(2 * limit / max(n, 1) * 2.0 ** 64))
    chosen = documents.select("text", F.xxhash64("doc_id", "text").alias("h")).filter(F.col("h") <= below)
    chosen = chosen.orderBy("h").limit(limit).select("text")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, offsets, data in blocks(batch.column("text")):
                votes, x = measure(offsets, data)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pattern_of(votes)), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())],
                    ["pattern", "x"])

    rows = chosen.mapInArrow(features, "pattern long, x binary").toPandas()
    if rows.empty:
        return np.zeros(0, np.int64), np.zeros((0, FEATURES), np.float32)
    return rows["pattern"].to_numpy(), np.frombuffer(b"".join(rows["x"]), np.float16).reshape(-1, FEATURES).astype(np.float32)


def fit_scorer(x: np.ndarray, target: np.ndarray, epochs: int = EPOCHS, penalty: float = 1e-4) -> np.ndarray:
    """Logistic weights (the last is the bias) for soft targets; both classes weigh alike at most tenfold."""
    weights = np.zeros(FEATURES + 1)
    if not len(x):
        return weights
    share = float(np.clip(target.mean(), 0.05, 0.95))
    each = target * (0.5 / share) + (1 - target) * (0.5 / (1 - share))
    step, velocity = 4.0, np.zeros_like(weights)
    for _ in range(epochs):
        score = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
        error = (score - target) * each / len(x)
        gradient = np.append(x.T @ error, error.sum())
        gradient[:-1] += penalty * weights[:-1]
        velocity = 0.9 * velocity - step * gradient
        weights += velocity
    return weights


def judge_quality(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``documents`` with ``posterior`` (label model), ``score`` (classifier, 0 to 1) and ``keep`` (score >= threshold).

    Columns of these names in the input are replaced; all other columns and all rows stay. A null text is a blank one, which
    the labellers call bad by its length. Repeated rows get the same scores. An empty table gives an empty result; a corpus
    without variety gives scores near its prior.
    """
    source = documents.drop("posterior", "score", "keep")
    counts = {r["pattern"]: r["n"] for r in vote_patterns(source).collect()}  # at most 3 ** 7 rows
    model = fit_label_model(counts)
    patterns, x = training_sample(source, sum(counts.values()))
    weights = fit_scorer(x, np.array([model.posterior[p] for p in patterns.tolist()]))
    known = model.posterior

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, offsets, data in blocks(batch.column("text")):
                votes, features = measure(offsets, data)
                score = 1 / (1 + np.exp(-np.clip(features @ weights[:-1] + weights[-1], -30, 30)))
                posterior = [known[p] for p in pattern_of(votes).tolist()]
                part = batch.slice(first, end - first)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(posterior, pa.float64()), pa.array(score, pa.float64()),
                     pa.array(score >= threshold)], [*batch.schema.names, "posterior", "score", "keep"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    return source.mapInArrow(score, f"{fields}, posterior double, score double, keep boolean")
