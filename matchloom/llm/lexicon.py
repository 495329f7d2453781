"""Encoding with a public byte-level BPE through a transducer lexicon (problem 7).

Words that the corpus repeats are compiled into a minimal acyclic automaton: shared prefixes and
suffixes, a count on every arc, so that a word's path sums to its number, which points at its ids.
The file of arrays is memory-mapped by the workers; words outside it are merged exactly.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import io
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

#: Folder of the vocabulary files; every executor has it.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Most words of a lexicon, longest word of it in characters. Speed only: results do not depend on them.
WORDS, LONGEST = 50_000, 64
KNOWN = 300_000
# Fixed value: the pattern that cuts text into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD = regex.compile(PATTERN)


def ranks_of(folder: str = TOKENIZERS, name: str = VOCABULARY) -> dict[bytes, int]:
    with open(os.path.join(folder, name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by exact merging: the lowest rank first, the leftmost of equals, in n log n steps."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end = list(range(1, n + 1))
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n:
            r = ranks.get(word[i : end[j]])
            if r is not None:
                heapq.heappush(heap, (r, i, end[i], end[j]))

    for i in range(n - 1):
        offer(i)
    live = bytearray(b"\x01") * n
    while heap:
        _, i, mid, to = heapq.heappop(heap)
        if not live[i] or end[i] != mid:
            continue
        j = after[i]
        if j >= n or end[j] != to:
            continue
        live[j] = 0
        end[i], after[i] = to, after[j]
        if after[j] < n:
            before[after[j]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = after[i]
    return out


def compiled(words: list[bytes], ids: list[list[int]]) -> bytes:
    """The automaton of sorted different words and their ids, as one file of arrays."""
    arcs: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path = [0]
    last = b""

    def minimize(down_to: int) -> None:
        while len(path) - 1 > down_to:
            child = path.pop()
            key = (final[child], tuple(arcs[child].items()))
            same = register.setdefault(key, child)
            if same != child:
                arcs[path[-1]][last[len(path) - 1]] = same

    for w in words:
        common = 0
        while common < min(len(w), len(last)) and w[common] == last[common]:
            common += 1
        minimize(common)
        for b in w[common:]:
            arcs.append({})
            final.append(False)
            arcs[path[-1]][b] = len(arcs) - 1
            path.append(len(arcs) - 1)
        final[path[-1]] = True
        last = w
    minimize(0)
    number, order, todo = {}, [], [0]
    while todo:
        s = todo.pop()
        if s in number:
            continue
        number[s] = len(order)
        order.append(s)
        todo += arcs[s].values()
    below: dict[int, int] = {}
    stack = [0]
    while stack:
        s = stack[-1]
        open_ = [t for t in arcs[s].values() if t not in below]
        if open_:
            stack += open_
            continue
        below[s] = final[s] + sum(below[t] for t in arcs[s].values())
        stack.pop()
    keys, targets, counts = [], [], []
    for s in order:
        passed = int(final[s])
        for b, t in sorted(arcs[s].items()):
            keys.append(number[s] * 256 + b)
            targets.append(number[t])
            counts.append(passed)
            passed += below[t]
    by = np.argsort(np.array(keys, "int64"), kind="stable")
    sizes = np.fromiter(map(len, ids), "int64", len(ids))
    parts = [
        np.array(keys, "int64")[by], np.array(targets, "int64")[by], np.array(counts, "int64")[by],
        np.array([final[s] for s in order], "int64"), np.concatenate([[0], np.cumsum(sizes)]).astype("int64"),
        np.fromiter(itertools.chain.from_iterable(ids), "int64", int(sizes.sum())),
    ]
    head = np.array([len(parts), *map(len, parts)], "int64")
    out = io.BytesIO()
    for x in (head, *parts):
        out.write(x.tobytes())
    return out.getvalue()


class Lexicon:
    """A memory-mapped automaton."""

    def __init__(self, path: str) -> None:
        data = np.memmap(path, "int64", "r")
        n = int(data[0])
        bounds = np.cumsum([n + 1, *data[1 : n + 1]])
        self.keys, self.targets, self.counts, self.final, self.offsets, self.ids = (
            data[a:z] for a, z in itertools.pairwise(bounds)
        )

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 where the automaton does not accept it; all words step together."""
        size = np.fromiter(map(len, words), "int64", len(words))
        by = np.argsort(-size, kind="stable")
        flat = np.frombuffer(b"".join(words), "uint8").astype("int64")
        start = (np.cumsum(size) - size)[by]
        size = size[by]
        state, total = np.zeros(len(words), "int64"), np.zeros(len(words), "int64")
        for i in range(int(size[0]) if len(words) and len(self.keys) else 0):
            n = int(np.searchsorted(-size, -i, "left"))
            key = state[:n] * 256 + flat[start[:n] + i]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = (self.keys[at] == key) & (state[:n] >= 0)
            total[:n] += np.where(ok, self.counts[at], 0)
            state[:n] = np.where(ok, self.targets[at], -1)
            if not ok.any() and n == len(words):
                break
        if not len(self.keys):
            state[:] = -1
        out = np.empty(len(words), "int64")
        out[by] = np.where((state >= 0) & (self.final[np.maximum(state, 0)] == 1), total, -1)
        return out


def frequent_words(texts: DataFrame, text: str, most: int = WORDS) -> list[str]:
    """The most frequent repeated words of all texts (at most ``most`` reach the driver), cut on the JVM side."""
    cut = F.explode(F.regexp_extract_all(F.col(text), F.lit("(?U)" + PATTERN), F.lit(0))).alias("w")
    counts = texts.select(cut).where(F.length("w").between(1, LONGEST)).groupBy("w").agg(F.count("*").alias("n"))
    return [r["w"] for r in counts.where("n > 1").orderBy(F.desc("n"), "w").limit(most).collect()]


def published(df: DataFrame, text: str, folder: str, name: str, most: int = WORDS) -> str:
    """Compiles the lexicon of a corpus into the shared folder and hands it to all executors; its file name."""
    spark = df.sparkSession
    sc = spark.sparkContext
    ranks = ranks_of(folder, name)
    words = sorted({w.encode() for w in frequent_words(df, text, most)})
    data = compiled(words, [merged(w, ranks) for w in words])
    file = f"lexicon-{hashlib.sha256(data).hexdigest()[:24]}.bin"
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{checkpoint_dir(spark)}/{file}")
    fs = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        out.write(bytearray(data))
        out.close()
    sc.addFile(path.toString())
    return file


_open: dict = {}


def _tools(file: str, folder: str, name: str) -> tuple[Lexicon, dict[bytes, int], dict[str, list[int]]]:
    if _open.get("file") != (file, folder, name):
        _open.clear()
        _open["tools"] = (Lexicon(SparkFiles.get(file)), ranks_of(folder, name), {})
        _open["file"] = (file, folder, name)
    return _open["tools"]


def _learn(new: list[str], lexicon: Lexicon, ranks: dict[bytes, int], known: dict[str, list[int]]) -> None:
    raw = [w.encode("utf-8", "surrogatepass") for w in new]
    for w, b, n in zip(new, raw, lexicon.numbers(raw), strict=True):
        known[w] = lexicon.ids[lexicon.offsets[n] : lexicon.offsets[n + 1]].tolist() if n >= 0 else merged(b, ranks)


def _encode(file: str, folder: str, name: str, only_count: bool, step: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, ranks, known = _tools(file, folder, name)
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                part = batch.slice(lo, step)
                words = [_WORD.findall(t) if t else [] for t in part.column(1).to_pylist()]
                new = list({w for ws in words for w in ws if w not in known})
                if len(known) + len(new) > KNOWN:
                    known.clear()
                    new = list({w for ws in words for w in ws})
                if new:
                    _learn(new, lexicon, ranks, known)
                if only_count:
                    out = pa.array([sum(len(known[w]) for w in ws) for ws in words], pa.int64())
                else:
                    out = pa.array([list(itertools.chain.from_iterable(map(known.__getitem__, ws))) for ws in words], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), out], names=["k", "v"])

    return run


def _run(df: DataFrame, key: str, text: str, only_count: bool, out: str, kind: str, folder: str | None, name: str, most: int) -> DataFrame:
    folder = TOKENIZERS if folder is None else folder
    own = df.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t"))
    file = published(own, "t", folder, name, most)
    done = own.mapInArrow(_encode(file, folder, name, only_count), f"k {dict(own.dtypes)['k']}, v {kind}")
    return done.select(F.col("k").alias(key), F.col("v").alias(out))


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, name: str = VOCABULARY, most: int = WORDS) -> DataFrame:
    """``key``, ``ids``: the token ids of every text, without special tokens (their strings are ordinary text).

    Null and empty texts give an empty list; blank texts are encoded like any other. Every row gives
    one row, repeated ones too; a null key stays null. Texts are encoded whole, whatever their length.
    """
    return _run(df, key, text, False, "ids", "array<int>", folder, name, most)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str | None = None, name: str = VOCABULARY, most: int = WORDS) -> DataFrame:
    """``key``, ``n_tokens``: as ``encode``, only the lengths."""
    return _run(df, key, text, True, "n_tokens", "bigint", folder, name, most)
