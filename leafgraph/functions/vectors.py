"""Vector expressions: distances, relevance, padding, concatenation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "inner")


def as_double(vec: Column) -> Column:
    return vec.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cos(a, b); null when either vector is all zeros (0/0)."""
    return F.lit(1.0) - F.try_divide(dot(a, b), norm(a) * norm(b))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def inner_distance(a: Column, b: Column) -> Column:
    """Negative inner product, so that smaller is nearer."""
    return -dot(a, b)


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    if metric == "cosine":
        return cosine_distance(a, b)
    if metric == "l2":
        return l2_distance(a, b)
    if metric == "inner":
        return inner_distance(a, b)
    raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")


def relevance(dist: Column, metric: str = "cosine") -> Column:
    """Relevance (larger is better) of a distance under the given metric."""
    if metric == "cosine":
        return F.lit(1.0) - dist
    if metric == "l2":
        return F.lit(1.0) - dist / F.sqrt(F.lit(2.0))
    if metric == "inner":
        return F.when(dist > 0, F.lit(1.0) - dist).otherwise(-dist)
    raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")


def pad_vector(vec: Column, dim: int) -> Column:
    """Zero-fill a missing or empty vector and right-pad a short one to ``dim``."""
    vec = F.coalesce(vec, F.array().cast("array<double>"))
    return F.concat(vec, F.array_repeat(F.lit(0.0), F.greatest(F.lit(dim) - F.size(vec), F.lit(0))))


def parse_vector(text: Column) -> Column:
    """Vector from its list notation ``[0.1, ...]``."""
    return F.from_json(text, "array<double>")


def concat_vectors(*vecs: Column) -> Column:
    return F.concat(*vecs)


def repeat_vector(vec: Column, d: int) -> Column:
    """A query vector repeated ``d`` times, to search a table of ``d`` concatenated vectors."""
    return F.flatten(F.array_repeat(vec, d))


def ivf_lists(n_rows: Column) -> Column:
    """Number of inverted lists: a tenth of a percent of the rows, at least 10; the root above a million rows."""
    return F.when(n_rows > 1_000_000, F.floor(F.sqrt(n_rows))).otherwise(
        F.greatest(F.lit(10), F.floor(n_rows / F.lit(1000)))).cast("long")
