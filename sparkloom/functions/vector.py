"""Vector functions over array columns; sums run in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)


def _double(v: Column | str) -> Column:
    return F.transform(_c(v), lambda x: x.cast("double"))


def literal(values: list[float]) -> Column:
    """A constant vector."""
    return F.array(*(F.lit(float(x)) for x in values))


def inner_product(a: Column | str, b: Column | str) -> Column:
    return _total(F.zip_with(_double(a), _double(b), lambda x, y: x * y))


def norm(a: Column | str) -> Column:
    return F.sqrt(_total(F.transform(_double(a), lambda x: x * x)))


# What distances of vectors of unequal length are, so that they come last.
FAR, FAR_COSINE = 1e9, 1.0


def _alike(a: Column | str, b: Column | str) -> Column:
    return F.size(_c(a)) == F.size(_c(b))


def l2_distance(a: Column | str, b: Column | str) -> Column:
    near = F.sqrt(_total(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))
    return F.when(_alike(a, b), near).when(_c(a).isNotNull() & _c(b).isNotNull(), FAR)


def inner_product_distance(a: Column | str, b: Column | str) -> Column:
    return F.when(_alike(a, b), -inner_product(a, b)).when(_c(a).isNotNull() & _c(b).isNotNull(), FAR)


def cosine_similarity(a: Column | str, b: Column | str) -> Column:
    """0 where a vector has no length."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, 0.0).otherwise(inner_product(a, b) / lengths)


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    return F.when(_alike(a, b), 1.0 - cosine_similarity(a, b)).when(_c(a).isNotNull() & _c(b).isNotNull(), FAR_COSINE)


def add(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_double(a), _double(b), lambda x, y: x + y)


def subtract(a: Column | str, b: Column | str) -> Column:
    return F.zip_with(_double(a), _double(b), lambda x, y: x - y)


def scale(a: Column | str, by: float) -> Column:
    return F.transform(_double(a), lambda x: x * F.lit(float(by)))


def dims(a: Column | str) -> Column:
    return F.size(_c(a))
