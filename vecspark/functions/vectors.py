"""Vector arithmetic as Column expressions: JVM-side, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(a), lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """1 - cos; null where a norm is zero."""
    return 1 - F.try_divide(dot(a, b), norm(a) * norm(b))


def cosine_eps(a: Column, b: Column) -> Column:
    """1 - a.b / (|a||b| + eps): the inverted-file scalar form."""
    return 1 - dot(a, b) / (norm(a) * norm(b) + EPSILON)


def cosine_batch(a: Column, b: Column) -> Column:
    """1 - (a / (|a| + eps)).(b / (|b| + eps)): the inverted-file batch form."""
    return 1 - dot(a, b) / ((norm(a) + EPSILON) * (norm(b) + EPSILON))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def dot_distance(a: Column, b: Column) -> Column:
    """-a.b: smaller is closer."""
    return -dot(a, b)


METRICS = {"cosine": cosine, "cosine_eps": cosine_eps, "cosine_batch": cosine_batch, "l2": euclidean, "euclidean": euclidean, "dot": dot_distance}


def distance(metric: str):
    """The distance function of a metric; an unknown one fails before any plan is built."""
    if metric not in METRICS:
        raise ValueError(f"unknown distance metric {metric!r}; known: {', '.join(METRICS)}")
    return METRICS[metric]


def _bound(value: Column, body) -> Column:
    """body(value) with the value computed once, however often the body's lambdas use it."""
    return F.transform(F.array(value), body)[0]


def normalize(v: Column, eps: float = 0.0) -> Column:
    """v / (|v| + eps); null elements where the divisor is zero."""
    return _bound(doubles(v), lambda a: _bound(norm(a) + F.lit(eps), lambda n: F.transform(a, lambda x: F.try_divide(x, n))))


def similarity(d: Column) -> Column:
    """1 / (1 + d); null where that is singular or negative."""
    return F.when(1 + d > 0, 1 / (1 + d))


def subvector(v: Column, m: int, width: int) -> Column:
    """The m-th slice of `width` elements, from 0."""
    return F.slice(v, m * width + 1, width)
