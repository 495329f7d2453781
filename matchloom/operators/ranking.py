"""Positions, codes and percentiles over whole tables without a single-partition window.

Rows are sorted by range once and written to the checkpoint folder; each partition is numbered
alone and shifted by the counts of the partitions before it. A hot group is spread over many
partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def _placed(df: DataFrame, order: list[Column]) -> DataFrame:
    return checkpointed(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))


def running(df: DataFrame, order: list[Column], amount: Column, out: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over all rows up to and including each row in a total order."""
    own = _placed(df.withColumn("__amount", amount.cast("bigint")), order)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = own.groupBy("__part").agg(F.sum("__amount").alias("__t"))
    shift = totals.select("__part", F.coalesce(F.sum("__t").over(before), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        own.withColumn("__own", F.sum("__amount").over(inside))
        .join(F.broadcast(shift), "__part")  # one row per partition
        .withColumn(out, F.col("__own") + F.col("__shift"))
        .drop("__own", "__shift", "__part", "__amount")
    )


def positions(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """``df`` with the position (from 1) of each row in its group, in a total order."""
    own = _placed(df, [F.col(g) for g in group] + order)
    counts = own.groupBy(*group, "__part").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(*[F.col(g).alias(f"__k{i}") for i, g in enumerate(group)], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    inside = Window.partitionBy(*group, "__part").orderBy(*order)
    numbered = own.withColumn("__own", F.row_number().over(inside))
    on = [F.col(g).eqNullSafe(F.col(f"__k{i}")) for i, g in enumerate(group)] + [F.col("__part") == F.col("__p")]
    cols = [c for c in df.columns if c != out]
    return numbered.join(shift, on).select(*cols, (F.col("__own") + F.col("__shift")).cast("bigint").alias(out))


def leaders(df: DataFrame, group: list[str], order: list[Column], n: int, out: str) -> DataFrame:
    """The first ``n`` rows of each group in a total order, with their place (from 1).

    Every task keeps at most ``n`` rows of a group before anything is shuffled, so a hot group
    reaches one task as ``n`` rows a task only. Null is a group of its own.
    """
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")).where(F.col(out) <= n)


def average_percentile(df: DataFrame, value: str, out: str) -> DataFrame:
    """``df`` with the percentile of ``value`` among all non-null values, ties sharing their mean rank. Null stays null."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    upto = running(counts, [F.col("__v")], F.col("__c"), "__upto")
    n = counts.agg(F.sum("__c").alias("__n"))
    pct = upto.join(F.broadcast(n)).select("__v", ((F.col("__upto") - (F.col("__c") - 1) / 2) / F.col("__n")).alias(out))
    return df.join(pct, df[value] == pct["__v"], "left").drop("__v")


def dense_codes(df: DataFrame, value: str, out: str) -> DataFrame:
    """``value``, ``out``: every different non-null value with its place (from 0) in ascending order."""
    own = df.select(value).where(F.col(value).isNotNull()).distinct()
    return running(own, [F.col(value)], F.lit(1), out).withColumn(out, F.col(out) - 1)


def scaled(df: DataFrame, value: str, out: str) -> DataFrame:
    """``value`` scaled to 0..1 over all rows; a constant column gives 0, null counts as 0.5."""
    x = df.withColumn("__x", F.coalesce(F.col(value).cast("double"), F.lit(0.5)))
    ends = x.agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"))
    width = F.col("__hi") - F.col("__lo")
    return x.join(F.broadcast(ends)).withColumn(out, F.when(width == 0, 0.0).otherwise((F.col("__x") - F.col("__lo")) / width)).drop("__x", "__lo", "__hi")
