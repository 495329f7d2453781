"""Likeness of token sets and vectors as column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column) -> Column:
    i = F.size(F.array_intersect(a, b))
    n = F.size(a) + F.size(b) - i
    return F.when(n > 0, i / n).otherwise(F.lit(0.0))


def pair_tfidf(a: Column, b: Column) -> Column:
    """Cosine of the TF-IDF vectors of two sets weighed against each other only, in closed form."""
    i = F.size(F.array_intersect(a, b)).cast("double")
    w = (1 + math.log(1.5)) ** 2
    x, y = i + w * (F.size(a) - i), i + w * (F.size(b) - i)
    return F.when((x > 0) & (y > 0), i / F.sqrt(x * y)).otherwise(F.lit(0.0))


def text_likeness(a: Column, b: Column) -> Column:
    """0.4 Jaccard + 0.4 TF-IDF cosine (where Jaccard exceeds 0.1) + 0.2 overlap of the larger set."""
    j, i = jaccard(a, b), F.size(F.array_intersect(a, b))
    most = F.greatest(F.size(a), F.size(b))
    cos = F.when(j > 0.1, pair_tfidf(a, b)).otherwise(F.lit(0.0))
    return 0.4 * j + 0.4 * cos + 0.2 * F.when(most > 0, i / most).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))
