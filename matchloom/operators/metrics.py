"""Ranking metrics, and the joining of fold models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranking import average_percentile, positions, running


def average_precision(ranked: DataFrame, user: str, rank: str, hit: Column, total: DataFrame | None = None) -> DataFrame:
    """``user``, ``ap``. The divisor is the number of hits in the ranking, or ``total`` (``user``, ``n``) with hits never ranked, whose users without a ranked hit have 0. Users without hits are left out."""
    hits = positions(ranked.where(hit), [user], [F.col(rank)], "__i")
    per = hits.groupBy(user).agg(F.sum(F.col("__i") / F.col(rank)).alias("s"), F.count("*").alias("n"))
    if total is not None:
        per = total.join(per.drop("n"), user, "left")
    return per.select(user, (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("ap"))


def _area(p: Column, n: Column, s: Column) -> Column:
    """The area from the number of positives, of all, and the positives' sum of mean ranks; null if a class is missing."""
    p = p.cast("double")
    return F.try_divide(s - p * (p + 1) / 2, p * (n - p))


def auc(df: DataFrame, score: str, label: Column) -> DataFrame:
    """One row: the exact area under the curve by mean ranks; null if a class is missing."""
    x = average_percentile(df.withColumn("__y", label.cast("int")), score, "__pct")
    a = x.agg(F.count("*").alias("n"), F.sum("__y").alias("p"), F.sum(F.when(F.col("__y") == 1, F.col("__pct"))).alias("s"))
    return a.select(_area(F.col("p"), F.col("n"), F.col("s") * F.col("n")).alias("auc"))


def auc_by(df: DataFrame, group: str, score: str, label: Column) -> DataFrame:
    """``group``, ``auc``: the exact area under the curve of each group; rows without a score or label are left out.

    Rows are aggregated to one per group and score first; ranks are sums over ranges of these, so a
    group of any size is no single task's work.
    """
    own = df.select(F.col(group).alias("__g"), F.col(score).alias("__v"), label.cast("int").alias("__y")).where("__v is not null and __y is not null")
    own = own.groupBy("__g", "__v").agg(F.count("*").alias("__c"), F.sum("__y").alias("__p"))
    upto = running(own, [F.col("__g"), F.col("__v")], F.col("__c"), "__upto")
    base = upto.groupBy(F.col("__g").alias("__b")).agg(F.min(F.col("__upto") - F.col("__c")).alias("__base"))
    rank = F.col("__upto") - F.col("__base") - (F.col("__c") - 1) / 2
    per = upto.join(base, F.col("__g").eqNullSafe(F.col("__b"))).select("__g", "__c", "__p", rank.alias("__rank")).groupBy("__g")
    per = per.agg(F.sum("__p").alias("p"), F.sum("__c").alias("n"), F.sum(F.col("__p") * F.col("__rank")).alias("s"))
    return per.select(F.col("__g").alias(group), _area(F.col("p"), F.col("n"), F.col("s")).alias("auc"))


def fold_mean(preds: DataFrame, keys: list[str], fold: str, pred: str, weights: DataFrame) -> DataFrame:
    """``keys``, ``pred``: the mean of the predictions of all fold models, weighted by ``weights`` (``fold``, ``weight``); one row a fold is broadcast."""
    w = F.broadcast(weights.select(F.col(fold).alias("__f"), F.col("weight").alias("__w")))
    x = preds.join(w, preds[fold] == w["__f"])
    return x.groupBy(*keys).agg((F.sum(F.col(pred) * F.col("__w")) / F.sum("__w")).alias(pred))
