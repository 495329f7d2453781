"""Queries and operators that do the whole of what the surveyed system does."""

import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from matchloom.operators import joined, metrics, rejects
from matchloom.plans import learning


def test_average_precision_of_users_never_ranked(spark):
    ranked = spark.createDataFrame([("u", k, k == 25) for k in range(1, 31)] + [("w", 1, False)], "user string, rk int, hit boolean")
    total = spark.createDataFrame([("u", 1), ("w", 2)], "user string, n long")
    got = {r["user"]: r["ap"] for r in metrics.average_precision(ranked, "user", "rk", F.col("hit"), total).collect()}
    assert got == {"u": pytest.approx(1 / 25), "w": 0.0}


def test_semantic_map_covers_all_ranks(spark, sf_dir):
    q = entry.queries()
    every = q["map_pipeline"](spark, sf_dir).agg(F.avg("ap")).first()[0]
    assert q["map_semantic_all"](spark, sf_dir).first()["map"] == pytest.approx(every, abs=1e-6)
    assert q["map_semantic"](spark, sf_dir).first()["map"] < every / 2


def _terms(text):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if len(x) > 1]
    return collections.Counter(w + [f"{a} {b}" for a, b in zip(w, w[1:])])


def _products(texts, most=None, k=10):
    """Products of the documents' vectors in a dense truncated SVD, which no sign changes."""
    tf = [_terms(x) for x in texts]
    total = sum(tf, collections.Counter())
    vocab = sorted(total, key=lambda t: (-total[t], t))[:most]
    df = [sum(t in c for c in tf) for t in vocab]
    x = np.array([[c[t] * (math.log((1 + len(tf)) / (1 + d)) + 1) for t, d in zip(vocab, df)] for c in tf])
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    y = u[:, :k] * s[:k]
    return y @ y.T


def _got(df, keys):
    found = {r["jd_no"]: r["vector"] for r in df.collect()}
    assert set(found) == set(keys)
    y = np.array([found[k] for k in keys])
    return y @ y.T


def test_reduced_descriptions(spark, sf_dir):
    rows = {r["jd_no"]: r["job_description"] or "" for r in spark.read.parquet(f"{sf_dir}/table2_jd.parquet").collect()}
    assert np.allclose(_got(entry.queries()["tfidf_reduced"](spark, sf_dir), rows), _products(rows.values(), 1000), atol=1e-6)


def test_reduced_experiences(spark, sf_dir):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()
    text = {r["user_id"]: "nan" if r["experience"] is None else r["experience"] for r in read("table1_user")}
    known = {r["jd_no"] for r in read("table2_jd")}
    pairs = [{(r["jd_no"], r["user_id"]) for r in read(t) if r["jd_no"] and r["user_id"]} for t in ("table3_action", "user_exposure")]
    joined = collections.defaultdict(list)
    for j, u in [*sorted(p for p in pairs[0] if p[0] in known), *sorted(pairs[1])]:
        joined[j].append(text.get(u, "nan"))
    assert np.allclose(_got(entry.queries()["tfidf_experience"](spark, sf_dir), joined), _products([" ".join(x) for x in joined.values()]), atol=1e-6)


def test_reduced_small(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("c",)], "jd_no string")
    counts = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "x", 1)], "doc string, term string, c long")
    for gram in (0, 2000):
        got = {r["jd_no"]: r["vector"] for r in learning.reduced(docs, counts, "jd_no", gram=gram).collect()}
        assert got["c"] == [0.0, 0.0] and [math.hypot(*got[x]) for x in "ab"] == pytest.approx([1, 1])
    assert learning.reduced(docs, counts.limit(0), "jd_no").first()["vector"] == []


def test_joined_texts_are_never_spread_into_terms_of_documents(spark):
    """Members in order over several blocks; what a step reads grows with pairs and members, not with terms of documents."""
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 40, rng.integers(0, 12))) for _ in range(60)]
    rows = sorted({(int(d), int(p), int(u)) for d, p, u in rng.integers(0, (30, 2, 60), (2000, 3)) if d != 7})
    own = joined.members(spark.createDataFrame([(i, x.split()) for i, x in enumerate(texts)], "uid int, words array<string>"))
    pairs = spark.createDataFrame([*rows, *rows[:9]], "doc int, part int, uid int")
    found = joined.Joined(pairs, 31, own, 3 * joined.BLOCK)
    docs = [d for d in range(30) if d != 7]
    assert found.present.nonzero()[0].tolist() == docs
    want = [" ".join(texts[u] for d, _, u in rows if d == doc) for doc in docs]
    y = found.reduced(10)[docs]
    assert np.allclose(y @ y.T, _products(want), atol=1e-8)
    held = sum(len(r["t_ix"]) + len(r["m_ix"]) for r in found.terms.collect()) / 4
    assert held < 0.5 * sum(len(_terms(x)) for x in want)


@pytest.mark.parametrize("values", [[9.0, *[5.0] * 8, 3.0, 2.0, *[1.0] * 80], [1.0] * 50, [4.0, 3.0, *[0.0] * 40], [7.0] * 3])
def test_leading_directions_with_equal_values(values):
    d = np.array([*values, 0.0, 0.0])
    k = min(10, len(values))
    got, x = joined.leading(lambda y: d[:, None] * y, np.arange(len(values)), len(d), k)
    assert np.allclose(got, sorted(values, reverse=True)[:k]) and np.allclose(x.T @ x, np.eye(k)) and np.allclose(d[:, None] * x, x * got, atol=1e-7)


@pytest.mark.parametrize(("name", "score", "texts"), [("text_similarity_all", "likeness", ("experience", "job_description")), ("experience_quality_all", "quality", ("experience", "jd_title"))])
def test_every_exposed_pair_has_a_score(spark, sf_dir, name, score, texts):
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    pairs = read("user_exposure").select("user_id", "jd_no").distinct()
    got = entry.queries()[name](spark, sf_dir).toPandas()
    assert len(got) == pairs.count() == len(got.drop_duplicates(["user_id", "jd_no"])) and got[score].notna().all()
    u, j = read("table1_user").dropDuplicates(["user_id"]), read("table2_jd").dropDuplicates(["jd_no"])
    bare = pairs.join(u, "user_id", "left").join(j, "jd_no", "left").where(" or ".join(f"{t} is null" for t in texts)).select("user_id", "jd_no").toPandas()
    assert len(bare) and set(bare.merge(got)[score]) == {0.0} and len(bare.merge(got)) == len(bare)


def test_bisection_leaves_only_bad_lines_to_the_scanner(monkeypatch):
    good = "\t".join(["0123456789abcdef" * 2, "a", "b", "530", "100", "", "", "c", "20190228", "", "text"])
    lines = [good + "\t" if i % 13 == 5 else good for i in range(500)]
    seen, scan = [], rejects._scanned
    monkeypatch.setattr(rejects, "_scanned", lambda x: seen.append(x) or scan(x))
    out = pa.Table.from_batches(rejects._solve(pa.array(range(500), pa.int64()), pa.array(lines)))
    assert seen == [x for x in lines if x != good]
    assert out["line_no"].to_pylist() == list(range(500)) and out["reason"].to_pylist() == [None if x == good else "column_count" for x in lines]
