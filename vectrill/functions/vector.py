"""Vector functions as Columns over arrays of floats; everything is computed in DOUBLE, left to right."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _same(a: Column, b: Column, value: Column, otherwise: float) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(F.lit(otherwise))


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    """Dot product; 0 for different lengths."""
    return _same(a, b, _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)), 0.0)


def norm(v: Column) -> Column:
    return F.sqrt(_sum(F.transform(_doubles(v), lambda x: x * x)))


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance; 0 for different lengths."""
    return _same(a, b, _sum(F.zip_with(_doubles(a), _doubles(b), lambda x, y: (x - y) * (x - y))), 0.0)


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if either norm is 0 or the lengths differ."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale).otherwise(F.lit(0.0))


def cosine_similarity_eps(a: Column, b: Column) -> Column:
    """With 1e-8 added below the line."""
    return dot(a, b) / (norm(a) * norm(b) + 1e-8)


def cosine(a: Column, b: Column, zero_norm: float = 1.0) -> Column:
    """Cosine distance; zero_norm is the distance of vectors without a direction or of different lengths."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), 1 - dot(a, b) / scale).otherwise(F.lit(zero_norm))


def inner_product(a: Column, b: Column) -> Column:
    return -dot(a, b)


def normalized_inner_product(a: Column, b: Column) -> Column:
    """For vectors of length 1."""
    return 1 - dot(a, b)


METRICS = {"cosine": cosine, "": cosine, "l2": l2, "ip": inner_product, "normalized_ip": normalized_inner_product}


def distance(metric: str, a: Column, b: Column) -> Column:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {sorted(METRICS)}")
    return METRICS[metric](a, b)


def normalize(v: Column) -> Column:
    """Length 1; the zero vector stays."""
    length = norm(v)
    return F.when(length > 0, F.transform(_doubles(v), lambda x: x / length)).otherwise(_doubles(v))


def add(a: Column, b: Column) -> Column:
    """Null for different lengths, as are the other element-wise functions."""
    return F.when(F.size(a) == F.size(b), F.zip_with(_doubles(a), _doubles(b), lambda x, y: x + y))


def subtract(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(_doubles(a), _doubles(b), lambda x, y: x - y))


def multiply(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y))


def divide(a: Column, b: Column) -> Column:
    return F.when(F.size(a) == F.size(b), F.zip_with(_doubles(a), _doubles(b), lambda x, y: F.try_divide(x, y)))


def scale(v: Column, factor: Column | float) -> Column:
    factor = factor if isinstance(factor, Column) else F.lit(float(factor))
    return F.transform(_doubles(v), lambda x: x * factor)


def unrolled_dot(a: Column, b: list[float]) -> Column:
    """Dot product with a constant vector as one arithmetic expression, which compiles into whole-stage code."""
    return reduce(lambda x, y: x + y, [a[i].cast("double") * float(x) for i, x in enumerate(b)])


def sparse_to_dense(indices: Column, values: Column, size: int) -> Column:
    """Indices outside 0..size-1 are ignored."""
    entries = F.map_from_arrays(indices.cast("array<int>"), _doubles(values))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(entries, i), F.lit(0.0)))


def sparse_dot(a_indices: Column, a_values: Column, b_indices: Column, b_values: Column) -> Column:
    """Sum over common indices."""
    other = F.map_from_arrays(b_indices.cast("array<int>"), _doubles(b_values))
    return _sum(F.zip_with(a_indices.cast("array<int>"), _doubles(a_values), lambda i, x: x * F.coalesce(F.try_element_at(other, i), F.lit(0.0))))


def hamming(a: Column, b: Column) -> Column:
    """Different bits of two codes (arrays of bytes as small integers); -1 for different lengths."""
    bits = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return F.when(F.size(a) == F.size(b), bits).otherwise(F.lit(-1)).cast("bigint")


def popcount(code: Column) -> Column:
    return F.aggregate(F.transform(code, lambda x: F.bit_count(x)), F.lit(0), lambda acc, x: acc + x).cast("bigint")


def binary_cosine(a: Column, b: Column) -> Column:
    """Common bits over the root of the product of both counts; 0 for different lengths or no bits."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda acc, x: acc + x)
    scale = F.sqrt(popcount(a).cast("double")) * F.sqrt(popcount(b).cast("double"))
    return F.when((F.size(a) == F.size(b)) & (scale > 0), both / scale).otherwise(F.lit(0.0))


def parse_literal(text: Column) -> Column:
    """A vector written as "[1, 2.5]"; what is no number counts as 0."""
    parts = F.split(F.regexp_replace(text, r"[\[\]\s]", ""), ",")
    return F.when(F.length(F.regexp_replace(text, r"[\[\]\s]", "")) == 0, F.array().cast("array<float>")).otherwise(F.transform(parts, lambda x: F.coalesce(x.try_cast("float"), F.lit(0.0).cast("float"))))
