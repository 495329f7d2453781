"""Splits that keep related records together (problem 1).

Ids are brought to one spelling, accounts are joined over links by large-star and small-star
steps, and the components are balanced by the largest-differencing method: in blocks of bounded
size first, then over the bins of the blocks. Whole bins go to the splits.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

BINS, BLOCK, FAN = 100, 20_000, 256
SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
_WIDE = "０１２３４５６７８９ＡＢＣＤＥＦａｂｃｄｅｆｘＸｕｉＵＩ：－｛｝"
_PLAIN = "0123456789ABCDEFabcdefxXuiUI:-{}"


def account(c: Column) -> Column:
    """The 32-digit id that a text spells, in lower case; else the text itself behind a mark; null stays null.

    Full-width forms, case, blanks, hyphens, braces, invisible characters and a leading ``uid:``
    or the like do not matter.
    """
    t = F.lower(F.translate(c, _WIDE, _PLAIN))
    t = F.regexp_replace(t, r"[\s\p{Z}\p{Cf}\-{}()\[\]]", "")
    t = F.regexp_replace(t, r"^(?:urn:)?(?:uuid|uid|id|user)[:=_#]?(?=[0-9a-f]{32}$)|^0x(?=[0-9a-f]{32}$)", "")
    return F.when(t.rlike("^[0-9a-f]{32}$"), t).otherwise(F.concat(F.lit("="), c))


def components(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``node``, ``root``: every node of the pairs with the least node of its component.

    Each round is one large-star and one small-star step, written to the checkpoint folder, until
    nothing changes; the number of rounds grows with the logarithm of the longest chain. Minima are aggregated before
    the shuffle, so a node with very many links is no single task's work. Null and self links are
    left out.
    """
    e = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = checkpointed(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = checkpointed(small.union(low).distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def differencing(loads: list[np.ndarray]) -> list[np.ndarray]:
    """Largest differencing of k-part tuples: for each tuple, the bin of each of its parts.

    The two tuples of largest spread are added, greatest parts to least, until one is left.
    """
    k = len(loads[0])
    heap = [(-float(x.max() - x.min()), i) for i, x in enumerate(loads)]
    heapq.heapify(heap)
    sums, joined = list(loads), []
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        pa_, pb = np.argsort(-sums[a], kind="stable"), np.argsort(sums[b], kind="stable")
        s = sums[a][pa_] + sums[b][pb]
        sums[a] = sums[b] = None
        joined.append((a, b, pa_, pb))
        sums.append(s)
        heapq.heappush(heap, (-float(s.max() - s.min()), len(sums) - 1))
    place: list = [None] * len(sums)
    place[heap[0][1]] = np.arange(k)
    for i in range(len(joined) - 1, -1, -1):
        a, b, pa_, pb = joined[i]
        where = place[len(loads) + i]
        for x, p in ((a, pa_), (b, pb)):
            place[x] = np.empty(k, int)
            place[x][p] = where
    return place[: len(loads)]


def _block_bins(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["weight", "component"], ascending=[False, True])
        loads = []
        for w in pdf["weight"].to_numpy(float):
            x = np.zeros(k)
            x[0] = w
            loads.append(x)
        return pdf.assign(part=[int(p[0]) for p in differencing(loads)])[["component", "block", "part", "weight"]]

    return run


def _joined_bins(k: int):
    """Differences the bins of one group of blocks: which bin of the group each bin of each block goes to."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="block", columns="part", values="weight", aggfunc="sum", fill_value=0.0)
        wide = wide.reindex(columns=range(k), fill_value=0.0).sort_index()
        loads = list(wide.to_numpy(float))
        group = int(pdf["group"].iloc[0])
        rows = [(group, int(block), j, int(p[j]), float(x[j])) for block, x, p in zip(wide.index, loads, differencing(loads), strict=True) for j in range(k)]
        return pd.DataFrame(rows, columns=["group", "block", "part", "bin", "weight"])

    return run


def _split_of(totals: dict[int, float], shares: dict[str, float]) -> dict[int, str]:
    """Whole bins to splits: the heaviest first, each to the split that lacks most."""
    left = {s: q * sum(totals.values()) for s, q in shares.items()}
    out = {}
    for b in sorted(totals, key=lambda b: (-totals[b], b)):
        out[b] = max(left, key=lambda x: left[x])
        left[out[b]] -= totals[b]
    return out


def balance(weights: DataFrame, shares: dict[str, float] | None = None, bins: int = BINS, block: int = BLOCK, fan: int = FAN) -> DataFrame:
    """``component``, ``bin``, ``split`` for rows of ``component``, ``weight``.

    Components are spread over blocks of about ``block`` rows by hash; the ``bins`` sums of ``fan`` blocks at a
    time are joined, and of these groups again, so no task grows with the data. A component heavier
    than a bin fills its own. Only the sums of the last bins reach the driver.
    """
    shares = SHARES if shares is None else shares
    n = weights.count()
    blocks = -(-n // block) or 1
    own = weights.select("component", F.col("weight").cast("double").alias("weight"), F.pmod(F.xxhash64("component"), F.lit(blocks)).alias("block"))
    parts = checkpointed(
        own.repartition(blocks, "block").groupBy("block").applyInPandas(_block_bins(bins), "component string, block bigint, part bigint, weight double")
    )
    placed = parts.select("component", "block", "part")
    sums = parts.groupBy("block", "part").agg(F.sum("weight").alias("weight"))
    while blocks > 1:
        grouped = sums.withColumn("group", F.floor(F.col("block") / fan)).groupBy("group")
        got = checkpointed(grouped.applyInPandas(_joined_bins(bins), "group bigint, block bigint, part bigint, bin bigint, weight double"))
        placed = placed.join(got.drop("weight"), ["block", "part"]).select("component", F.col("group").alias("block"), F.col("bin").alias("part"))
        sums = got.groupBy(F.col("group").alias("block"), F.col("bin").alias("part")).agg(F.sum("weight").alias("weight"))
        blocks = -(-blocks // fan)
    split = _split_of({r["part"]: r["weight"] for r in sums.collect()}, shares)
    final = weights.sparkSession.createDataFrame(list(split.items()), "part bigint, split string")
    return placed.join(F.broadcast(final), "part").select("component", F.col("part").alias("bin"), "split")  # one row a bin


def related_splits(
    rows: DataFrame, key: str, links: DataFrame, a: str, b: str, shares: dict[str, float] | None = None
) -> DataFrame:
    """``key``, ``component``, ``n_rows``, ``split``: one row per different stored non-null key of ``rows``.

    Keys that spell the same account, and accounts that links connect directly or through others
    (known to ``rows`` or not), share a component and so a split. Repeated, reversed, null, empty and
    self links change nothing; blank keys are accounts of their own. Empty tables give no rows.
    """
    linked = links.select(account(F.col(a)).alias("x"), account(F.col(b)).alias("y"), F.col(a).alias("ra"), F.col(b).alias("rb"))
    linked = linked.where("trim(ra) <> '' and trim(rb) <> ''").select("x", "y")
    roots = components(linked, "x", "y")
    stored = rows.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n_rows")).where("__key is not null")
    stored = stored.withColumn("__account", account(F.col("__key")))
    stored = checkpointed(
        stored.join(roots, stored["__account"] == roots["node"], "left").select(
            "__key", "n_rows", F.coalesce("root", "__account").alias("component")
        )
    )
    split = balance(stored.groupBy("component").agg(F.sum("n_rows").alias("weight")), shares)
    return stored.join(split, "component").select(F.col("__key").alias(key), "component", "n_rows", "bin", "split")


def assign_rows(rows: DataFrame, key: str, by_key: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """All rows with ``split``. Rows without a key belong to nobody: each is drawn by a hash of its content, so equal rows stay together."""
    shares = SHARES if shares is None else shares
    u = F.pmod(F.xxhash64(*rows.columns), F.lit(1_000_000)) / 1e6
    drawn, upto = F.lit(None).cast("string"), 0.0
    for s, q in shares.items():
        upto += q
        drawn = F.coalesce(drawn, F.when(u < upto, F.lit(s)))
    drawn = F.coalesce(drawn, F.lit(list(shares)[-1]))
    known = by_key.select(F.col(key).alias("__key"), F.col("split").alias("__split"))
    cols = [c for c in rows.columns if c != "split"]
    own = rows.withColumn("__drawn", drawn).drop("split")
    # Rows without a key stay where they are: in the join they would all meet in one task.
    held = own.where(F.col(key).isNotNull()).join(known, F.col(key) == F.col("__key"), "left")
    held = held.select(*cols, F.coalesce("__split", "__drawn").alias("split"))
    return held.unionByName(own.where(F.col(key).isNull()).select(*cols, F.col("__drawn").alias("split")))


def sharing_pairs(by_key: DataFrame, key: str) -> DataFrame:
    """``<key>_a``, ``<key>_b`` (a < b): stored keys of one component and split; a component holds the spellings of one person."""
    x = by_key.select("component", "split", F.col(key).alias(f"{key}_a"))
    y = by_key.select("component", "split", F.col(key).alias(f"{key}_b"))
    return x.join(y, ["component", "split"]).where(F.col(f"{key}_a") < F.col(f"{key}_b")).select(f"{key}_a", f"{key}_b")
