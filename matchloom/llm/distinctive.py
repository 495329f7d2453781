"""How distinctive a term is per record (problem 4): parsimonious language models.

Each record's term distribution is separated by expectation-maximisation from the background of
all records. The records of an Arrow batch are iterated together, each until it has converged
itself, so results depend on no batch or partition. The converged probabilities rank the terms of
a record; its leaders are checked exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

OWN_SHARE, TOLERANCE, ROUNDS = 0.1, 1e-7, 300
#: Places of a record's ranking that are proposed as its standing-out term.
LEADERS = 8
#: The table of terms is broadcast up to this size in bytes. Beyond it, only terms that hold at least
#: 1 / HEAVY of all (record, term) rows of a field are (at most HEAVY a field), the others are joined by shuffle.
BROADCAST_BYTES, HEAVY = 16 << 20, 2000


def records(texts: DataFrame) -> DataFrame:
    """``rec_id``, ``field_name``, ``terms`` (array of term, c by term) from rows of ``rec_id``, ``field_name``, ``items`` (array of terms).

    Terms count in lower case without the blanks around them; null and empty ones count for nothing. All
    rows of a record are one; rows are shuffled once, before their items are spread.
    """
    # Outer, since else a filter on the items would compute them twice; null terms go with the empty ones.
    own = texts.where("rec_id is not null").repartition("rec_id").select("rec_id", "field_name", F.explode_outer("items").alias("term"))
    own = own.select("rec_id", "field_name", F.lower(F.trim("term")).alias("term")).where("term <> ''")
    counts = own.groupBy("rec_id", "field_name", "term").agg(F.count("*").alias("c"))
    return counts.groupBy("rec_id", "field_name").agg(F.array_sort(F.collect_list(F.struct("term", "c"))).alias("terms"))


def _fixed_point(c: np.ndarray, back: np.ndarray, rec: np.ndarray) -> np.ndarray:
    """Where expectation-maximisation converges to: c / E - back / OWN_SHARE, or 0, by records (``rec`` ascending from 0)."""
    q = back / OWN_SHARE
    by = np.lexsort((q / c, rec))
    start = np.flatnonzero(np.append(True, np.diff(rec[by]) != 0))
    size = np.diff(np.append(start, len(by)))

    def upto(x: np.ndarray) -> np.ndarray:
        s = np.cumsum(x)
        return s - np.repeat(s[start] - x[start], size)

    expected = upto(c[by]) / (1 + upto(q[by]))
    held = c[by] > q[by] * expected
    # Terms by falling c / q: the ones held are a run from the first on.
    last = np.maximum.reduceat(np.where(held, np.arange(len(by)), start[np.repeat(np.arange(len(start)), size)]), start)
    out = np.empty(len(c))
    out[by] = np.maximum(0, c[by] / np.repeat(expected[last], size) - q[by])
    return out


def converged(c: np.ndarray, back: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Each term's share of what is its record's own; records begin at ``start`` and have at least one term.

    A record that still moves after ROUNDS rounds takes the point that the rounds approach.
    """
    size = np.diff(np.append(start, len(c)))
    out = c / np.repeat(np.add.reduceat(c, start), size)
    at, own, rest, p = np.arange(len(c)), c, back, out.copy()
    for _ in range(ROUNDS):
        e = own * (OWN_SHARE * p) / (OWN_SHARE * p + rest)
        now = e / np.repeat(np.maximum(np.add.reduceat(e, start), 1e-300), size)
        moved = np.maximum.reduceat(np.abs(now - p), start) >= TOLERANCE
        out[at] = p = now
        if not moved.all():
            kept = np.repeat(moved, size)
            at, own, rest, p, size = at[kept], own[kept], rest[kept], p[kept], size[moved]
            start = np.cumsum(size) - size
            if not len(at):
                return out
    out[at] = _fixed_point(own, rest, np.repeat(np.arange(len(size)), size))
    return out


def _whole_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of whole records: the last record of a batch waits for the next batch, which may go on with it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = [batch.column(i)[-1].as_py() for i in (0, 1)]
        same = np.ones(batch.num_rows, bool)
        for i in (0, 1):
            same &= pc.equal(batch.column(i), pa.scalar(last[i], batch.column(i).type)).to_numpy(zero_copy_only=False)
        cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        elif held and [held[-1].column(i)[-1].as_py() for i in (0, 1)] != last:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _em(total: dict[str, int], n: dict[str, int], leaders: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_records(batches):
            key, name, term = (t.column(x).combine_chunks() for x in ("rec_id", "field_name", "term"))
            c, d, cf = (t.column(x).to_numpy().astype(float) for x in ("c", "d", "cf"))
            kind, which = np.unique(name.to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
            new = np.append(True, pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False) | (which[1:] != which[:-1]))
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(c)))
            of = lambda x: np.array([x[k] for k in kind], float)[which]
            p = converged(c, (1 - OWN_SHARE) * cf / of(total), start)
            rec = np.repeat(np.arange(len(start)), size)
            order = np.lexsort((np.arange(len(p)), -p, rec))
            place = np.empty(len(p), "int64")
            place[order] = np.arange(len(p)) - start[rec] + 1
            score = c * np.log(of(n) / d)
            by = np.lexsort((-score, rec))
            first, second = by[start], by[np.minimum(start + 1, len(by) - 1)]
            others = score[first][rec]
            others[first] = np.where(size > 1, score[second], np.nan)
            keep = np.flatnonzero(place <= (leaders or len(p)))
            take = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [key.take(take), name.take(take), term.take(take), pa.array(c[keep].astype("int64")), pa.array(d[keep].astype("int64")),
                 pa.array(of(n)[keep].astype("int64")), pa.array(p[keep]), pa.array(place[keep]), pa.array(score[keep]), pa.array(others[keep], from_pandas=True)],
                names=["rec_id", "field_name", "term", "c", "d", "n", "probability", "place", "score", "others"],
            )

    return run


def distinctive_terms(recs: DataFrame, leaders: int | None = None) -> DataFrame:
    """``rec_id``, ``field_name``, ``term``, ``c``, ``d``, ``n``, ``probability``, ``place``, ``score``, ``others`` for rows of ``records``.

    ``d`` of the ``n`` records of the field hold the term; ``probability`` is the term's converged
    share of what is the record's own, ``place`` its rank in the record (ties by term); with ``leaders``
    only so many places of a record are given. ``score`` is c * ln(n / d), ``others`` the highest of the
    record's other terms, null if there is none. A record of one term has probability 1; an empty
    input gives no rows. Statistics cover all records.
    """
    recs = checkpointed(recs)
    counts = recs.select("rec_id", "field_name", F.explode("terms").alias("x")).select("rec_id", "field_name", "x.term", "x.c")
    stats = checkpointed(counts.groupBy("field_name", "term").agg(F.count("*").alias("d"), F.sum("c").alias("cf")))
    size = stats.groupBy("field_name").agg(F.sum("cf").alias("total"), F.sum("d").alias("pairs"), F.sum(F.octet_length("term") + 48).alias("bytes"))
    size = {r["field_name"]: r for r in size.collect()}  # one row a field
    n = {r["field_name"]: r["n"] for r in recs.groupBy("field_name").agg(F.count("*").alias("n")).collect()}
    on = ["field_name", "term"]
    cols = ["rec_id", "field_name", "term", "c", "d", "cf"]
    if sum(r["bytes"] for r in size.values()) <= BROADCAST_BYTES:
        # A record's terms leave the join as they entered it, side by side.
        own = counts.join(F.broadcast(stats), on).select(*cols)
    else:
        hot = F.coalesce(*[F.when(F.col("field_name") == f, F.col("d") * HEAVY >= r["pairs"]) for f, r in size.items()])
        most = F.broadcast(stats.where(hot))
        rest = counts.join(most.select(*on), on, "left_anti").join(stats.where(~hot).hint("shuffle_merge"), on).select(*cols)
        own = counts.join(most, on).select(*cols).union(rest).repartition("rec_id", "field_name").sortWithinPartitions("rec_id", "field_name", "term")
    key = dict(recs.dtypes)["rec_id"]
    total = {f: r["total"] for f, r in size.items()}
    return own.mapInArrow(
        _em(total, n, leaders),
        f"rec_id {key}, field_name string, term string, c bigint, d bigint, n bigint, probability double, place bigint, score double, others double",
    )


def standing_out(scored: DataFrame, ratio: float = 2.0, leaders: int = LEADERS) -> DataFrame:
    """``rec_id``, ``field_name``, ``term``: of each record of two or more terms the leader whose score is ahead of and ``ratio`` times that of all its other terms, if there is one.

    The model proposes a record's first ``leaders`` places; the score is an exact check of them.
    """
    ahead = (F.col("score") > F.col("others")) & (F.col("score") >= ratio * F.col("others") * (1 - 1e-12))
    return scored.where((F.col("place") <= leaders) & ahead).select("rec_id", "field_name", "term")
