"""Truncated SVD of the TF-IDF rows of joined texts, without the joined texts and without their matrix.

A document is a sequence of members, each with its words; its terms are the words and the pairs of
neighbouring words of the sequence. With P (documents x members), T (members x terms within one text)
and M (documents x terms where two texts meet) the counts are P T + M, so that a step of the solver
takes as many products as there are pairs and terms of members, not as there are terms of documents.
The counts themselves are made twice, block by block: for document frequencies and for lengths.

Blocks are rows of binary columns that hold arrays. The driver holds numbers a document and a member,
none a pair or a term; the solver's space lies in files of its temporary folder.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed
from . import ranking

#: Pairs a block.
BLOCK = 200_000
#: Directions a step, and most directions held: a restart keeps half of them.
STEP, HELD = 3, 30
#: Rows of the space that are in memory at once.
PART = 65_536
#: Bytes of partial sums that one product sends to the driver, if two tasks' fit.
SENT = 8 << 20
#: A direction is found when its residual is below this share of the largest squared singular value.
TOLERANCE = 1e-9


@dataclass
class Members:
    """Words of the members by place: those of member i are words[at[i]:at[i + 1]], numbers below ``n``."""

    at: np.ndarray
    words: np.ndarray
    n: int

    def of(self, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words of ``members`` in order, place in ``members`` of each)."""
        size = self.at[members + 1] - self.at[members]
        place = np.repeat(np.arange(len(members)), size)
        shift = np.repeat(self.at[members] - (np.cumsum(size) - size), size)
        return self.words[np.arange(len(place)) + shift].astype(np.int64), place

    def pairs(self, words: np.ndarray) -> np.ndarray:
        """Terms of neighbouring words; words are the terms below ``n``."""
        return (words[:-1] + 1) * self.n + words[1:]


def members(df: DataFrame) -> Members:
    """From ``uid`` (every number from 0 up) and ``words`` (array of strings)."""
    held = checkpointed(df.select("uid", "words"))
    ids = checkpointed(ranking.dense_codes(held.select(F.explode("words").alias("word")), "word", "id"))
    rows = held.select("uid", F.posexplode("words").alias("pos", "word")).join(ids, "word")
    got = rows.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("id").cast("int").alias("id")))).alias("x")).select("uid", F.col("x.id").alias("x")).toArrow()
    uid, x = got["uid"].to_numpy(), got["x"].combine_chunks()
    size = np.zeros(held.count() + 1, np.int64)
    size[uid + 1] = x.value_lengths().to_numpy()
    at, words = np.cumsum(size), np.empty(size.sum(), np.int32)
    low = x.offsets.to_numpy()[:-1]
    to = np.repeat(at[uid] - (low - low[0] if len(low) else low), size[uid + 1])
    words[np.arange(len(to)) + to] = x.flatten().to_numpy()
    return Members(at, words, max(ids.count(), 1))


def _array(x, kind=np.int32) -> np.ndarray:
    return np.frombuffer(x, kind)


def _column(table: pa.Table, name: str, kind=np.int32) -> np.ndarray:
    return np.concatenate([np.empty(0, kind), *(_array(x.as_py(), kind) for x in table[name])])


def _rows(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    """Arrays become binary."""
    cells = [[v.tobytes() if isinstance(v, np.ndarray) else v for v in c] for c in zip(*rows, strict=True)] or [[] for _ in schema]
    return pa.table([pa.array(c, k) for c, (_, k) in zip(cells, schema, strict=True)], [n for n, _ in schema])


def _sql(schema: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"{n} {'int' if k == pa.int32() else 'binary'}" for n, k in schema)


_I, _B = pa.int32(), pa.binary()
PAIRS = [("block", _I), ("docs", _I), ("doc", _B), ("uid", _B)]
CUT = [("block", _I), ("part", _I), *((x, _B) for x in ("code", "n", "t_code", "t_uid", "m_code", "m_doc"))]
TERMS = [("block", _I), ("part", _I), ("size", _I), *((x, _B) for x in ("code", "idf", "t_ix", "t_uid", "m_ix", "m_doc"))]


def _starts(x: np.ndarray) -> np.ndarray:
    """Where each run of equal numbers begins."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.empty(0, np.int64)


def _sums(values: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(groups, sums of the rows of values of each) of groups that stand together."""
    at = _starts(groups)
    return groups[at], np.add.reduceat(values, at, axis=0) if len(at) else values[:0]


def _terms(doc: np.ndarray, uid: np.ndarray, own: Members) -> tuple[np.ndarray, ...]:
    """Terms of a block: (term, its document) of every occurrence, and whether two texts meet there."""
    words, place = own.of(uid)
    of = doc[place]
    near = of[1:] == of[:-1]
    codes = np.r_[words, own.pairs(words)[near]]
    met = np.r_[np.zeros(len(words), bool), (place[1:] != place[:-1])[near]]
    return codes, np.r_[of, of[1:][near]], met


def _counted(codes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, ...]:
    """(different terms in order; document, place of the term and count of each document's different terms)."""
    terms, ix = np.unique(codes, return_inverse=True)
    key = of.astype(np.int64) * len(terms) + ix
    key.sort()
    at = _starts(key)
    doc, ix = np.divmod(key[at], max(len(terms), 1))
    return terms, doc, ix, np.diff(np.r_[at, len(key)])


class Joined:
    """``pairs``: ``doc``, ``part``, ``uid``; a document's members in the order of part and number, equal rows once."""

    def __init__(self, pairs: DataFrame, docs: int, own: Members, rows: int) -> None:
        self.spark, self.docs, self.users = pairs.sparkSession, docs, len(own.at) - 1
        self.tasks = max(1, self.spark.sparkContext.defaultParallelism)
        n = rows // BLOCK + 1
        held = self.spark.sparkContext.broadcast(own)

        def placed(table: pa.Table) -> pa.Table:
            doc, part, uid = (table[c].to_numpy() for c in ("doc", "part", "uid"))
            order = np.lexsort((uid, part, doc))
            doc, part, uid = doc[order], part[order], uid[order]
            new = np.r_[True, (doc[1:] != doc[:-1]) | (part[1:] != part[:-1]) | (uid[1:] != uid[:-1])]
            doc, uid = doc[new], uid[new]
            return _rows(PAIRS, [(table["block"][0].as_py(), len(_starts(doc)), doc, uid)])

        ints = pairs.select(*[F.col(c).cast("int").alias(c) for c in ("doc", "part", "uid")])
        self.by_doc = checkpointed(ints.withColumn("block", F.col("doc") % n).repartition(n, "block").groupBy("block").applyInArrow(placed, _sql(PAIRS)))

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for doc, uid in zip(b["doc"], b["uid"], strict=True):
                    doc, uid = _array(doc.as_py()), _array(uid.as_py())
                    yield from _rows(PAIRS, [(int(k), 0, doc[uid % n == k], uid[uid % n == k]) for k in range(n)]).to_batches()

        def together(table: pa.Table) -> pa.Table:
            doc, uid = _column(table, "doc"), _column(table, "uid")
            order = np.argsort(uid, kind="stable")
            return _rows(PAIRS, [(table["block"][0].as_py(), 0, doc[order], uid[order])])

        self.by_user = checkpointed(self.by_doc.mapInArrow(split, _sql(PAIRS)).repartition(n, "block").groupBy("block").applyInArrow(together, _sql(PAIRS)))
        self.n = self.by_doc.agg(F.sum("docs")).first()[0] or 0
        total = self.n

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block, doc, uid in zip(*(b[c].to_pylist() for c in ("block", "doc", "uid")), strict=True):
                    codes, of, met = _terms(_array(doc), _array(uid), held.value)
                    m_code, m_doc = codes[met], of[met].astype(np.int32)
                    terms, _, ix, _ = _counted(codes, of)
                    df = np.bincount(ix, minlength=len(terms)).astype(np.int32)
                    mine = np.arange(block, len(held.value.at) - 1, n)
                    words, place = held.value.of(mine)
                    inside = place[1:] == place[:-1]
                    t_code, t_uid = np.r_[words, held.value.pairs(words)[inside]], mine[np.r_[place, place[1:][inside]]].astype(np.int32)
                    for k in range(n):
                        c, t, m = (x % n == k for x in (terms, t_code, m_code))
                        yield from _rows(CUT, [(block, k, terms[c], df[c], t_code[t], t_uid[t], m_code[m], m_doc[m])]).to_batches()

        def weighed(table: pa.Table) -> pa.Table:
            part = table["part"][0].as_py()
            code, df = _column(table, "code", np.int64), _column(table, "n")
            terms, ix = np.unique(code, return_inverse=True)
            idf = np.log((total + 1) / (np.bincount(ix, df, len(terms)) + 1)) + 1
            found = []
            for c, to in (("t_code", "t_uid"), ("m_code", "m_doc")):
                codes, to = _column(table, c, np.int64), _column(table, to)
                at = np.minimum(np.searchsorted(terms, codes), max(len(terms) - 1, 0))
                known = terms[at] == codes if len(terms) else np.zeros(len(codes), bool)  # a member of no document may have terms of its own
                at, to = at[known].astype(np.int32), to[known]
                order = np.argsort(at, kind="stable")
                found += [at[order], to[order]]
            none, at, rows = np.empty(0, np.int32), 0, [(-1, part, len(terms), terms, idf, *found)]
            for block, own_ in zip(table["block"].to_pylist(), table["code"].to_pylist(), strict=True):
                size = len(own_) // 8
                rows.append((block, part, 0, own_, idf[ix[at : at + size]], none, none, none, none))
                at += size
            return _rows(TERMS, rows)

        store = checkpointed(self.by_doc.mapInArrow(cut, _sql(CUT)).repartition(n, "part").groupBy("part").applyInArrow(weighed, _sql(TERMS)))
        self.terms = store.where("block < 0").select("idf", "t_ix", "t_uid", "m_ix", "m_doc", "code")
        self.size = store.agg(F.sum("size")).first()[0] or 0

        def lengths(left: pa.Table, right: pa.Table) -> pa.Table:
            rows = []
            for doc, uid in zip(left["doc"].to_pylist(), left["uid"].to_pylist(), strict=True):
                every = _array(doc)[_starts(_array(doc))]
                codes, of, _ = _terms(_array(doc), _array(uid), held.value)
                _, of, ix, c = _counted(codes, of)
                idf = _column(right, "idf", np.float64)[np.argsort(_column(right, "code", np.int64))]
                of, x = _sums(np.square(c * idf[ix]), of)
                rows.append((every, of.astype(np.int32), x))
            return _rows([("every", _B), ("doc", _B), ("x", _B)], rows)

        own_idf = store.where("block >= 0").select("block", "code", "idf")
        self.present = np.zeros(docs, bool)
        got = self.by_doc.groupBy("block").cogroup(own_idf.groupBy("block")).applyInArrow(lengths, "every binary, doc binary, x binary")
        square = np.zeros(docs)
        for every, doc, x in got.collect():
            self.present[_array(every)] = True
            square[_array(doc)] = _array(x, np.float64)
        held.destroy()
        self.scale = np.divide(1, np.sqrt(square), out=np.zeros(docs), where=square > 0)[:, None]

    def _passed(self, x: np.ndarray, forward: bool) -> np.ndarray:
        """Sums over the documents of each member, or over the members of each document."""
        source, to = ("uid", "doc") if forward else ("doc", "uid")
        held = self.spark.sparkContext.broadcast(x)

        def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = [_sums(held.value[_array(s)], _array(t)) for s, t in zip(b[source].to_pylist(), b[to].to_pylist(), strict=True)]
                yield from _rows([("at", _B), ("x", _B)], rows).to_batches()

        out = np.zeros((self.docs if forward else self.users, x.shape[1]))
        for at, v in (self.by_doc if forward else self.by_user).coalesce(2 * self.tasks).mapInArrow(summed, "at binary, x binary").collect():
            out[_array(at)] = _array(v, np.float64).reshape(-1, x.shape[1])
        held.destroy()
        return out

    def _termwise(self, u: np.ndarray, w: np.ndarray, out: Callable, schema: list[tuple[str, pa.DataType]]) -> list:
        """``out`` of an iterator over (block, its terms' sums over members ``u`` and documents ``w``)."""
        held = self.spark.sparkContext.broadcast((u, w))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def each():
                for b in batches:
                    for r in b.to_pylist():
                        r = {c: _array(v, {"idf": np.float64, "code": np.int64}.get(c, np.int32)) for c, v in r.items()}
                        z = np.zeros((len(r["idf"]), u_width))
                        for ix, to, x in (("t_ix", "t_uid", held.value[0]), ("m_ix", "m_doc", held.value[1])):
                            at, sums = _sums(x[r[to]], r[ix])
                            z[at] += sums
                        yield r, z

            yield from _rows(schema, out(each(), *held.value)).to_batches()

        u_width = u.shape[1]
        tasks = min(self.tasks, max(2, SENT // max(u.nbytes + w.nbytes, 1)))
        got = self.terms.coalesce(tasks).mapInArrow(run, _sql(schema)).collect()
        held.destroy()
        return got

    def product(self, x: np.ndarray) -> np.ndarray:
        """The matrix times its transpose times ``x``."""
        w = x * self.scale
        u = self._passed(w, False)

        def back(blocks, u, w) -> list[tuple]:
            to_users, to_docs, any_ = np.zeros(u.T.shape), np.zeros(w.T.shape), False
            for r, z in blocks:
                z *= np.square(r["idf"])[:, None]
                for j in range(z.shape[1]):
                    to_users[j] += np.bincount(r["t_uid"], z[r["t_ix"], j], u.shape[0])
                    to_docs[j] += np.bincount(r["m_doc"], z[r["m_ix"], j], w.shape[0])
                any_ = True
            return [(to_users, to_docs)] if any_ else []

        to_users, to_docs = np.zeros(u.T.shape), np.zeros(w.T.shape)
        for a, b in self._termwise(u, w, back, [("u", _B), ("w", _B)]):
            to_users += _array(a, np.float64).reshape(to_users.shape)
            to_docs += _array(b, np.float64).reshape(to_docs.shape)
        return (self._passed(np.ascontiguousarray(to_users.T), True) + to_docs.T) * self.scale

    def signs(self, x: np.ndarray) -> np.ndarray:
        """For each column of ``x`` the sign of the largest entry of the transposed matrix times it."""
        w = x * self.scale

        def largest(blocks, u, w) -> list[tuple]:
            rows = []
            for r, z in blocks:
                z *= r["idf"][:, None]
                if len(z):
                    at = np.abs(z).argmax(0)
                    rows.append((z[at, np.arange(z.shape[1])], r["code"][at]))
            return rows

        got = self._termwise(self._passed(w, False), w, largest, [("z", _B), ("code", _B)])
        if not got:
            return np.ones(x.shape[1])
        z, code = np.array([_array(a, np.float64) for a, _ in got]), np.array([_array(b, np.int64) for _, b in got])
        best = [np.lexsort((code[:, j], -np.abs(z[:, j])))[0] for j in range(x.shape[1])]
        return np.where(z[best, np.arange(x.shape[1])] < 0, -1.0, 1.0)

    def reduced(self, k: int) -> np.ndarray:
        """Documents by ``k`` numbers (fewer for fewer terms or documents): the matrix in its first right singular directions."""
        k = min(k, self.n, self.size)
        if not k:
            return np.zeros((self.docs, 0))
        values, vectors = leading(self.product, (self.scale[:, 0] > 0).nonzero()[0], self.docs, k)
        out = np.zeros((self.docs, k))
        out[:, : len(values)] = vectors * np.sqrt(np.maximum(values, 0)) * self.signs(vectors)
        return out


def _orthogonal(x: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what ``x`` has beyond ``basis``."""
    for _ in range(2):
        size = np.linalg.norm(x, axis=0)
        x = x[:, size > 0] / size[size > 0]
        x = x - basis @ (basis.T @ x)
        values, turn = np.linalg.eigh(x.T @ x)
        kept = values > 1e-12
        x = x @ (turn[:, kept] / np.sqrt(values[kept]))
    return x


def leading(product: Callable[[np.ndarray], np.ndarray], rows: np.ndarray, n: int, k: int, step: int = STEP, held: int = HELD, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues and their vectors of a positive operator that is zero outside ``rows``.

    Each step adds the residuals of the first directions that aren't found yet to the space and
    solves the problem within it. It ends when all residuals are small or nothing is left to add.
    """
    # As many directions as are wanted, since a space grown from fewer holds no more copies of an eigenvalue than that.
    start = np.zeros((n, min(max(step, k), len(rows))))
    start[rows] = np.random.default_rng(1).standard_normal((len(rows), start.shape[1]))
    held = max(held, 2 * k + step)
    with tempfile.TemporaryFile() as f, tempfile.TemporaryFile() as g:
        # Columns up to ``m`` are in use: an orthonormal basis and its products.
        q, aq = (np.memmap(x, np.float64, "w+", shape=(n, held), order="F") for x in (f, g))
        parts, m, new = [slice(i, i + PART) for i in range(0, n, PART)], 0, _orthogonal(start, np.zeros((n, 0)))
        while True:
            to = m + new.shape[1]
            q[:, m:to] = new
            for i in range(m, to, step):
                aq[:, i : min(i + step, to)] = product(np.array(q[:, i : min(i + step, to)]))
            m = to
            h = sum(q[p, :m].T @ aq[p, :m] for p in parts)
            values, turn = np.linalg.eigh((h + h.T) / 2)
            values, turn = values[::-1], turn[:, ::-1]
            if m + step > held:
                kept = held // 2
                for p in parts:
                    q[p, :kept], aq[p, :kept] = q[p, :m] @ turn[:, :kept], aq[p, :m] @ turn[:, :kept]
                m, values, turn = kept, values[:kept], np.eye(kept)
            first = turn[:, :k]
            rest = lambda p, c: aq[p, :m] @ first[:, c] - (q[p, :m] @ first[:, c]) * values[:k][c]  # noqa: B023, E731
            size = np.sqrt(sum(np.square(rest(p, slice(None))).sum(0) for p in parts))
            missing = np.flatnonzero(size > tolerance * max(values[0], 0))
            if m >= k and not len(missing):
                break
            new = np.vstack([rest(p, missing[:step]) for p in parts])
            if m < k:  # residuals alone may be too few
                more = np.zeros((n, step))
                more[rows] = np.random.default_rng(m + 1).standard_normal((len(rows), step))
                new = np.hstack([new, more])[:, :step]
            new = _orthogonal(new, q[:, :m])
            if not new.shape[1]:
                break
        return values[:k], np.vstack([q[p, :m] @ first for p in parts])
