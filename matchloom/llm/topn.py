"""Top N items within every group (problem 5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _heads(n: int):
    """Keeps the first n rows of each group of a sorted partition, with their place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, seen = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            g = batch.column(0)
            new = np.ones(batch.num_rows, bool)
            new[1:] = pc.not_equal(g.slice(1), g.slice(0, len(g) - 1)).to_numpy(zero_copy_only=False)
            same = g[0].as_py() == last
            start = np.flatnonzero(new)
            at = np.arange(batch.num_rows) - np.repeat(start, np.diff(np.append(start, batch.num_rows))) + 1
            if same:
                head = start[1] if len(start) > 1 else batch.num_rows
                at[:head] += seen
            last, seen = g[-1].as_py(), int(at[-1])
            keep = pa.array(at <= n)
            out = batch.filter(keep)
            k = out.num_rows
            yield pa.RecordBatch.from_arrays(
                [*out.columns, pa.array(np.full(k, part, "int64")), pa.array(at[at <= n].astype("int64"))],
                names=[*batch.schema.names, "__part", "__at"],
            )

    return run


def top_n(df: DataFrame, group: str, item: str, scores: list[tuple[Column, int]], n: int) -> DataFrame:
    """``group``, ``item``, ``position`` (1..n): the n best different items of every group.

    ``scores`` are integer columns, best first; the second member stands for null. An item counts by its
    best row; ties go to the smaller item. Rows without group or item are left out; repeated rows
    change nothing; an empty table gives no rows. All different (group, item) pairs are sorted by
    range on (group, scores, item), so a hot group is spread over many partitions; each partition
    keeps at most n rows of a group, and the counts of earlier partitions make positions exact.
    """
    rows = df.select(F.col(group).alias("__g"), F.col(item).alias("__i"), *[c.alias(f"__s{k}") for k, (c, _) in enumerate(scores)])
    kinds = dict(rows.dtypes)
    filled = [F.coalesce(F.col(f"__s{k}").cast("bigint"), F.lit(null).cast("bigint")) for k, (_, null) in enumerate(scores)]
    rows = rows.where("__g is not null and __i is not null")
    if len(scores) <= 2 and all(kinds[f"__s{k}"] in ("tinyint", "smallint", "int") for k in range(len(scores))):
        # Two 32-bit scores in one number: its maximum is aggregated by hash, that of a struct only by sorting.
        first, second = [*filled, F.lit(0).cast("bigint")][:2]
        names, best = ["__s0"], F.max(F.shiftleft(first, 32) + second + F.lit(1 << 31)).alias("__s0")
        best = rows.groupBy("__g", "__i").agg(best)
    else:
        names = [f"__s{k}" for k in range(len(scores))]
        best = F.max(F.struct(*[f.alias(n) for f, n in zip(filled, names, strict=True)])).alias("__best")
        best = rows.groupBy("__g", "__i").agg(best).select("__g", "__i", *[F.col(f"__best.{n}").alias(n) for n in names])
    order = [F.col("__g"), *[F.col(s).desc() for s in names], F.col("__i")]
    ordered = best.repartitionByRange(*order).sortWithinPartitions(*order).select("__g", "__i")
    types = dict(ordered.dtypes)
    heads = ordered.mapInArrow(_heads(n), f"__g {types['__g']}, __i {types['__i']}, __part bigint, __at bigint")
    before = Window.partitionBy("__g").orderBy("__part").rangeBetween(Window.unboundedPreceding, -1)
    return (
        heads.withColumn("position", F.coalesce(F.count("*").over(before), F.lit(0)) + F.col("__at"))
        .where(F.col("position") <= n)
        .select(F.col("__g").alias(group), F.col("__i").alias(item), "position")
    )
