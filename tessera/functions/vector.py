"""Vector expressions: sums are taken in doubles over floats."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_floats(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)).cast("float") for v in values])


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def magnitude(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")))


def cosine(v: Column, query: list[float]) -> Column:
    """Cosine similarity with a query vector; null where it is not defined (no vector, length 0, another size)."""
    q = as_floats(query)
    product = magnitude(v) * magnitude(q)
    return F.when((F.size(v) == len(query)) & (product > 0), dot(v, q) / product)


def l2_normalised(values: list[float]) -> list[float]:
    size = math.sqrt(sum(v * v for v in values))
    return [v / size for v in values] if size else list(values)
