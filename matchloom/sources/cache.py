"""Results kept by the MD5 of the text they were made from, as Parquet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class TextCache:
    """A Parquet folder of ``key`` and result columns, written in batches; of a key the row of the latest batch counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _all(self) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self.path)
        except AnalysisException:
            return None

    def read(self) -> DataFrame | None:
        """One row a key, without the number of its batch; None before anything is written."""
        held = self._all()
        if held is None:
            return None
        cols = [c for c in held.columns if c not in ("key", "__batch")]
        last = F.max_by(F.struct(*cols), F.struct("__batch", F.xxhash64(*cols))).alias("x")
        return held.groupBy("key").agg(last).select("key", *[F.col("x")[c].alias(c) for c in cols])

    def keyed(self, df: DataFrame, text: str) -> DataFrame:
        return df.withColumn("key", F.md5(F.col(text)))

    def misses(self, df: DataFrame, text: str) -> DataFrame:
        """Different non-null texts that have no result yet: ``key``, ``text``."""
        new = self.keyed(df.where(F.col(text).isNotNull()), text).select("key", F.col(text).alias("text")).dropDuplicates(["key"])
        held = self._all()
        return new if held is None else new.join(held.select("key"), "key", "left_anti")

    def add(self, results: DataFrame) -> None:
        """Appends a batch; its number is one above all that are there."""
        held = self._all()
        last = None if held is None else held.agg(F.max("__batch")).first()[0]
        results.withColumn("__batch", F.lit((last or 0) + 1).cast("bigint")).write.mode("append").parquet(self.path)

    def attach(self, df: DataFrame, text: str, missing: dict | None = None) -> DataFrame:
        """``df`` with the results of its texts; a text without one has null, or the value ``missing`` names for the column."""
        held = self.read()
        own = self.keyed(df, text)
        out = own if held is None else own.join(held, "key", "left")
        for c, value in (missing or {}).items():
            filled = F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)
            out = out.withColumn(c, F.coalesce(F.col(c), filled) if c in out.columns else filled)
        return out
