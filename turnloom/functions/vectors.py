"""Vector arithmetic on array columns, in doubles: single precision differs between engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    """As doubles, with NaN and infinity as 0."""
    return F.transform(v, lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalized(v: Column) -> Column:
    """Unit vector; null for a zero vector."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0; null where the lengths differ."""
    n = norm(a) * norm(b)
    return F.when(F.size(a) == F.size(b), F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0)))


def scaled(v: Column, by: Column | float) -> Column:
    factor = by if isinstance(by, Column) else F.lit(by)
    return F.transform(v, lambda x: x.cast("double") * factor)


def blended(short: Column, long: Column, long_weight: float) -> Column:
    """(1 - w) short + w long, as a unit vector."""
    return normalized(F.zip_with(short, long, lambda x, y: x.cast("double") * (1 - long_weight) + y.cast("double") * long_weight))


def stacked(vectors: list[Column], weights: list[float]) -> Column:
    """Weighted unit vectors one after another, as a unit vector."""
    return normalized(F.concat(*(scaled(normalized(v), w) for v, w in zip(vectors, weights))))


def softmax(values: Column, temperature: float = 1.0) -> Column:
    top = F.array_max(values)
    e = F.transform(values, lambda x: F.exp((x - top) / temperature))
    total = F.aggregate(e, F.lit(0.0), lambda s, x: s + x)
    return F.transform(e, lambda x: x / total)


def cosine_margin(v: Column, a: Column, b: Column) -> Column:
    return cosine(v, b) - cosine(v, a)


def rounded(v: Column, digits: int = 6) -> Column:
    from turnloom.functions.numbers import quantized

    return F.transform(v, lambda x: quantized(x, digits))
