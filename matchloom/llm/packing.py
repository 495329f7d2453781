"""Filling containers of fixed capacity (problem 8).

All planning works on the histogram of lengths, whose size is bounded by the capacity: patterns of
few different lengths are fitted to it by non-negative least squares, rounded and realised; what is
left fills the gaps, best fit first. The plan then reaches the items through their exact rank
among the items of equal length.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

LEVELS, PARTS, STEPS = 128, 4, 150


@dataclass
class Kind:
    """``count`` containers that hold the same lengths."""

    count: int
    room: int
    parts: dict[int, int] = field(default_factory=dict)


def patterns(levels: int = LEVELS, parts: int = PARTS) -> list[dict[int, int]]:
    """Multisets of levels that fill a container exactly: up to ``parts`` items, or any number of two levels."""
    found: set[tuple[tuple[int, int], ...]] = set()

    def walk(left: int, least: int, had: tuple[int, ...]) -> None:
        if len(had) < parts and left >= least:
            found.add(tuple(sorted(_times((*had, left)).items())))
            if len(had) < parts - 1:
                for x in range(least, left // 2 + 1):
                    walk(left - x, x, (*had, x))

    walk(levels, 1, ())
    for a in range(1, levels):
        for m in range(1, levels // a + 1):
            rest = levels - a * m
            if rest == 0:
                found.add(((a, m),))
            for b in range(a + 1, rest + 1):
                if rest % b == 0:
                    found.add(((a, m), (b, rest // b)))
    return [dict(p) for p in sorted(found)]


def _times(xs: tuple[int, ...]) -> dict[int, int]:
    out: dict[int, int] = defaultdict(int)
    for x in xs:
        out[x] += 1
    return out


def fitted(pats: list[dict[int, int]], want: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """Non-negative repeat counts x of the patterns that bring A x close to ``want`` (accelerated projected gradient).

    Levels weigh by their size, since a large item left over costs most.
    """
    size = np.fromiter(map(len, pats), int, len(pats))
    rows = np.fromiter(itertools.chain.from_iterable(pats), int, int(size.sum()))
    vals = np.fromiter(itertools.chain.from_iterable(p.values() for p in pats), float, int(size.sum()))
    cols = np.repeat(np.arange(len(pats)), size)
    weight = np.sqrt(np.arange(len(want)))
    scale = max(float(want.max()), 1.0)
    b = want / scale * weight
    vals = vals * weight[rows]
    norm = np.sqrt(np.bincount(cols, vals**2, len(pats)))
    vals = vals / norm[cols]
    u = np.random.default_rng(0).random(len(pats))
    for _ in range(12):
        u = np.bincount(cols, vals * np.bincount(rows, vals * u[cols], len(want))[rows], len(pats))
        top = float(np.linalg.norm(u))
        u /= top
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(steps):
        gap = np.bincount(rows, vals * y[cols], len(want)) - b
        now = np.maximum(0, y - np.bincount(cols, vals * gap[rows], len(pats)) / (1.02 * top))
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y, x, t = now + (t - 1) / nt * (now - x), now, nt
    return x / norm * scale


def planned(hist: np.ndarray, levels: int = LEVELS) -> list[Kind]:
    """Kinds of containers that hold all ``hist[n]`` items of each length n = 1..capacity."""
    capacity = len(hist) - 1
    left = hist.astype("int64").copy()
    left[0] = 0
    kinds: list[Kind] = []
    if left[capacity]:
        kinds.append(Kind(int(left[capacity]), 0, {capacity: 1}))
        left[capacity] = 0
    grain = -(-capacity // levels)
    levels = capacity // grain
    level_of = -(-np.arange(capacity + 1) // grain)
    want = np.bincount(level_of, left, max(levels, int(level_of[-1])) + 1)[: levels + 1]
    own = {v: [n for n in np.flatnonzero(left)[::-1] if level_of[n] == v] for v in range(1, levels + 1)}
    pats = [p for p in patterns(levels) if all(want[v] >= m for v, m in p.items())]
    if pats:
        times = fitted(pats, want)
        for i in np.argsort(-times, kind="stable"):
            reps = int(times[i] + 0.5)
            if not reps:
                break
            reps = min([reps, *(int(want[v]) // m for v, m in pats[i].items())])
            if reps <= 0:
                continue
            for v, m in pats[i].items():
                want[v] -= reps * m
            kinds += _realised(pats[i], reps, own, left, capacity)
    return _best_fit(left, kinds, capacity)


def _realised(pattern: dict[int, int], reps: int, own: dict[int, list[int]], left: np.ndarray, capacity: int) -> list[Kind]:
    """``reps`` containers of a pattern in exact lengths, the longest of each level first."""
    out = []
    while reps:
        n, parts = reps, {}
        for v, m in pattern.items():
            lengths = own[v]
            while not left[lengths[0]]:
                lengths.pop(0)
            if left[lengths[0]] >= m:
                parts[lengths[0]] = m
                n = min(n, int(left[lengths[0]]) // m)
            else:
                n, need = 1, m
                for x in lengths:
                    take = min(need, int(left[x]))
                    if take:
                        parts[x] = take
                        need -= take
                    if not need:
                        break
        for x, m in parts.items():
            left[x] -= n * m
        out.append(Kind(n, capacity - sum(x * m for x, m in parts.items()), parts))
        reps -= n
    return out


def _best_fit(left: np.ndarray, kinds: list[Kind], capacity: int) -> list[Kind]:
    by_room: dict[int, list[Kind]] = defaultdict(list)
    for k in kinds:
        by_room[k.room].append(k)
    rooms = sorted(by_room)

    def put(k: Kind) -> None:
        if not by_room[k.room] and (not rooms or k.room not in rooms):
            insort(rooms, k.room)
        by_room[k.room].append(k)

    for n in range(capacity, 0, -1):
        c = int(left[n])
        while c:
            at = bisect_left(rooms, n)
            while at < len(rooms) and not by_room[rooms[at]]:
                rooms.pop(at)
            if at == len(rooms):
                m = min(capacity // n, c)
                k = Kind(c // m, capacity - m * n, {n: m})
            else:
                k = by_room[rooms[at]].pop()
                m = min(k.room // n, c)
                if k.count * m > c:
                    rest = Kind(k.count - c // m, k.room, dict(k.parts))
                    k = Kind(c // m, k.room, dict(k.parts))
                    put(rest)
                k.room -= m * n
                k.parts[n] = k.parts.get(n, 0) + m
            c -= k.count * m
            put(k)
    return [k for ks in by_room.values() for k in ks]


def segments(kinds: list[Kind]) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """For each length: (first rank, first container, items of it per container), by rank; and the number of containers."""
    out: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    base = 0
    for k in kinds:
        for n, m in k.parts.items():
            out[n].append((used[n], base, m))
            used[n] += m * k.count
        base += k.count
    return out, base


def _assign(span: int, parts: np.ndarray, offsets: np.ndarray, kinds: np.ndarray, seg_key: np.ndarray, seg_base: np.ndarray, seg_times: np.ndarray, containers: np.ndarray):
    """Places items by their rank among the items of their budget and length; ``span`` exceeds every length, ``kinds`` are the planned (budget, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = -1, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part, budget, n = (batch.column(c).to_numpy(zero_copy_only=False).astype("int64") for c in ("part", "budget", "n_tokens"))
            key = (part * len(containers) + budget) * span + n
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            at = np.arange(len(key)) - np.repeat(start, np.diff(np.append(start, len(key))))
            if key[0] == last:
                at[: start[1] if len(start) > 1 else len(key)] += seen
            last, seen = int(key[-1]), int(at[-1]) + 1
            rank = at + offsets[np.searchsorted(parts, key)]
            lookup = (np.searchsorted(kinds, budget * span + n) << 40) + rank
            s = np.maximum(np.searchsorted(seg_key, lookup, "right") - 1, 0)
            if len(seg_key):
                held = seg_base[s] + (lookup - seg_key[s]) // seg_times[s]
            else:
                held = np.zeros(len(rank), "int64")
            held = np.where(n == 0, rank % np.maximum(containers[budget], 1), held)
            yield pa.RecordBatch.from_arrays(
                [pa.array(budget), pa.array(held), *(batch.column(c) for c in ("key", "piece_no", "start_token", "n_tokens"))],
                names=["budget", "container_id", "key", "piece_no", "start_token", "n_tokens"],
            )

    return run


def fill_containers(sizes: DataFrame, key: str, size: str, budgets: DataFrame, name: str = "budget_name", capacity: str = "capacity_tokens") -> DataFrame:
    """``name``, ``container_id`` (from 0), ``key``, ``piece_no``, ``start_token``, ``n_tokens``: every item once per budget.

    An item beyond the capacity is cut into full pieces and a rest; no other item is cut. Items of
    size 0 or null take no room and are spread over the containers. Budgets without a positive
    capacity are left out. Repeated keys are items of their own. An empty table gives no rows.
    Budgets are a small fixed table; histograms, offsets and plans on the driver are bounded by their
    capacities and by partitions. Equal inputs give equal containers: items of equal length rank by key and piece.
    """
    caps = [(r[0], int(r[1])) for r in budgets.select(name, capacity).distinct().where(f"{capacity} > 0").orderBy(capacity, name).collect()]
    span = max((c for _, c in caps), default=0) + 1
    spark = sizes.sparkSession
    own = sizes.select(F.col(key).alias("key"), F.greatest(F.coalesce(F.col(size).cast("bigint"), F.lit(0)), F.lit(0)).alias("n"))
    kind = dict(own.dtypes)["key"]
    if not caps:
        return spark.createDataFrame([], f"{name} string, container_id bigint, {key} {kind}, piece_no bigint, start_token bigint, n_tokens bigint")
    own = checkpointed(own)  # The range sort reads its input twice; sizes may be dear.
    cap = F.array(*[F.struct(F.lit(i).cast("bigint").alias("budget"), F.lit(c).cast("bigint").alias("cap")) for i, (_, c) in enumerate(caps)])
    items = own.select("key", "n", F.explode(cap).alias("c")).select(
        "key", "n", "c.budget", "c.cap", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.ceil(F.col("n") / F.col("c.cap")) - 1, F.lit(0)))).alias("piece_no")
    )
    items = items.select(
        "key", "budget", "piece_no", (F.col("piece_no") * F.col("cap")).alias("start_token"),
        F.least("cap", F.col("n") - F.col("piece_no") * F.col("cap")).alias("n_tokens"),
    )
    order = ["budget", "n_tokens", "key", "piece_no"]
    ranked = checkpointed(
        items.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("bigint"))
    )
    counts = ranked.groupBy("budget", "n_tokens", "part").agg(F.count("*").alias("c")).orderBy("budget", "n_tokens", "part").collect()
    hist = [np.zeros(c + 1, "int64") for _, c in caps]
    parts, offsets = [], []
    for r in counts:
        parts.append((r["part"] * len(caps) + r["budget"]) * span + r["n_tokens"])
        offsets.append(int(hist[r["budget"]][r["n_tokens"]]))
        hist[r["budget"]][r["n_tokens"]] += r["c"]
    by = np.argsort(np.array(parts, "int64"))
    seg, containers = [], []
    for i, h in enumerate(hist):
        held, n = segments(planned(h))
        containers.append(n)
        seg += [(i * span + length, first, base, times) for length, ss in held.items() for first, base, times in ss]
    seg.sort()
    table = np.array(seg, "int64").reshape(-1, 4)
    kinds, which = np.unique(table[:, 0], return_inverse=True)
    seg_key = (which.astype("int64") << 40) + table[:, 1]
    out = ranked.mapInArrow(
        _assign(span, np.array(parts, "int64")[by], np.array(offsets, "int64")[by], kinds, seg_key, table[:, 2].copy(), table[:, 3].copy(), np.array(containers, "int64")),
        f"budget bigint, container_id bigint, key {kind}, piece_no bigint, start_token bigint, n_tokens bigint",
    )
    label = F.element_at(F.array(*[F.lit(x) for x, _ in caps]), (F.col("budget") + 1).cast("int"))
    return out.select(label.alias(name), "container_id", F.col("key").alias(key), "piece_no", "start_token", "n_tokens")


def filling(placed: DataFrame, budgets: DataFrame, name: str = "budget_name", capacity: str = "capacity_tokens") -> DataFrame:
    """``name``, ``capacity``, ``containers``, ``tokens``, ``fill``: how full the containers of each budget are."""
    per = placed.groupBy(name, "container_id").agg(F.sum("n_tokens").alias("t"))
    out = per.groupBy(name).agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), F.max("t").alias("fullest"))
    return out.join(budgets.select(name, capacity).distinct(), name).withColumn("fill", F.col("tokens") / (F.col("containers") * F.col(capacity)))
