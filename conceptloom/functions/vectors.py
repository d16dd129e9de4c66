"""Vector functions over array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; -1 where a norm is zero."""
    n = norm(a) * norm(b)
    return F.when(n == 0, F.lit(-1.0)).otherwise(F.try_divide(dot(a, b), n))


def unit(a: Column) -> Column:
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors (array of arrays) whose mask is 1; zeros if none is."""
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["t"])
    zero = F.transform(tokens[0], lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, t: F.zip_with(s, t, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda x: x / F.greatest(F.size(kept), F.lit(1)))


def cls_pool(tokens: Column) -> Column:
    return tokens[0]


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)
