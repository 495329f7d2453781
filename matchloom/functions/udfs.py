"""Functions for SQL sessions that built-in ones cannot say."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.registry import alike, likeness


@F.pandas_udf(T.DoubleType())
def name_ratio(new: pd.Series, held: pd.Series) -> pd.Series:
    """2 M / T over matching blocks of two names in lower case; not symmetric; null if either is null. Equal pairs are compared once a batch."""
    seen: dict[tuple, float | None] = {}
    out = []
    for pair in zip(new, held, strict=True):
        if pair not in seen:
            seen[pair] = None if pair[0] is None or pair[1] is None else likeness(*pair)
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


def likely_names(held: list[str], above: float):
    """A function that gives the names of a short list that a name is liker to than ``above``, as an array of ``name``, ``ratio`` in their order; null gives null."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("ratio", T.DoubleType())])))
    def found(new: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [{"name": n, "ratio": r} for r, n in alike(x, held, above)] for x in new], dtype=object)

    return found


def register(spark: SparkSession) -> None:
    """Makes ``name_ratio`` known to ``spark.sql``."""
    spark.udf.register("name_ratio", name_ratio)
