import math

import pytest
from pyspark.sql import functions as F

from matchloom.functions import parsing as P
from matchloom.functions import similarity as S
from matchloom.operators import metrics, ranking
from matchloom.operators.registry import Registry, likeness
from matchloom.session import checkpoint_dir


@pytest.mark.parametrize(
    ("code", "low", "high"),
    [("200001000000", 200001, 0), ("0400106000", 4001, 6000), ("10000115000", 10000, 115000), ("400106000", 4001, 6000), ("-", -1, -1), (None, -1, -1), ("12345678", -1, -1)],
)
def test_salary(spark, code, low, high):
    if code == "10000115000":
        low = 10000
    df = spark.createDataFrame([(code,)], "c string")
    got = df.select(P.salary(F.col("c"), True), P.salary(F.col("c"), False)).first()
    assert (got[0], got[1]) == (low, high)


def test_closed_form_cosine_equals_dense(spark):
    import random

    random.seed(3)
    rows = [([str(x) for x in random.sample(range(12), random.randint(1, 9))], [str(x) for x in random.sample(range(12), random.randint(1, 9))]) for _ in range(40)]
    df = spark.createDataFrame(rows, "a array<string>, b array<string>")
    for r in df.select("a", "b", S.pair_tfidf(F.col("a"), F.col("b")).alias("c")).collect():
        terms = set(r["a"]) | set(r["b"])
        idf = {t: math.log(3 / (1 + (t in r["a"]) + (t in r["b"]))) + 1 for t in terms}
        va, vb = ({t: idf[t] for t in x} for x in (r["a"], r["b"]))
        dense = sum(va[t] * vb[t] for t in va.keys() & vb.keys()) / math.sqrt(sum(v * v for v in va.values()) * sum(v * v for v in vb.values()))
        assert r["c"] == pytest.approx(dense)


def test_ladder_flags_and_cosine(spark):
    df = spark.createDataFrame([("Java", "java", None), ("Java dev", "java", None), ("a b", "b c", None)], "a string, b string, n int")
    assert [round(r[0], 3) for r in df.select(P.ladder(F.col("a"), F.col("b"))).collect()] == [1.0, 0.7, 0.333]
    assert {r[0] for r in df.select(P.flag(F.col("n") > 1)).collect()} == {0}
    v = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert v.select(S.cosine(F.col("a"), F.col("b"))).first()[0] == 0.0


def test_percentiles_positions_and_codes(spark):
    rows = [(i, v) for i, v in enumerate([3.0, 1.0, 3.0, None, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "i int, v double")
    pct = {r["i"]: r["p"] for r in ranking.average_percentile(df, "v", "p").collect()}
    assert pct == {0: 0.8, 1: 0.2, 2: 0.8, 3: None, 4: 0.4, 5: 0.8}
    pos = ranking.positions(df.withColumn("g", F.lit("x")), ["g"], [F.desc_nulls_last("v"), F.col("i")], "p")
    assert {r["i"]: r["p"] for r in pos.collect()} == {0: 1, 2: 2, 5: 3, 4: 4, 1: 5, 3: 6}
    assert {r["v"]: r["c"] for r in ranking.dense_codes(df, "v", "c").collect()} == {1.0: 0, 2.0: 1, 3.0: 2}
    one = spark.createDataFrame([(1, 5.0), (2, 5.0)], "i int, v double")
    assert {r["s"] for r in ranking.scaled(one, "v", "s").collect()} == {0.0}
    assert ranking.average_percentile(df.limit(0), "v", "p").count() == 0


def test_average_precision_and_auc(spark):
    df = spark.createDataFrame([("u", k, k in (1, 3)) for k in range(1, 5)] + [("w", 1, False)], "user string, rk int, hit boolean")
    assert metrics.average_precision(df, "user", "rk", F.col("hit")).first()["ap"] == pytest.approx((1 + 2 / 3) / 2)
    total = spark.createDataFrame([("u", 3)], "user string, n long")
    assert metrics.average_precision(df, "user", "rk", F.col("hit"), total).first()["ap"] == pytest.approx((1 + 2 / 3) / 3)
    x = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.4, 0), (0.9, 1)], "s double, y int")
    assert metrics.auc(x, "s", F.col("y") == 1).first()["auc"] == pytest.approx(0.875)
    assert metrics.auc(x.where("y = 1"), "s", F.col("y") == 1).first()["auc"] is None


def test_registry(spark):
    assert likeness("tide", "diet") == 0.25 and likeness("diet", "tide") == 0.5
    r = Registry(["skills", "tools"])
    assert [r.add("skills", x) for x in ("javascript", "javascripts", "javascript", "x", "y" * 51, None)] == ["javascript", "javascript", "javascript", None, None, None]
    assert r.add("tools", "javascript") == "javascript" and r.add("other", "thing") == "thing"
    assert r.add_category("skill") == "skills" and r.add_category("SKILLS") is None and r.add_category("a/b") is None and r.add_category("licences") == "licences"
    r.clean()
    assert list(r.entities) == ["skills"]
    e = spark.createDataFrame([("o", "skills", "javascripts"), ("o", "skills", "javascript"), ("o", "skills", "x")], "owner string, category string, entity string")
    assert [tuple(x) for x in r.normalised(e).collect()] == [("o", "skills", "javascript")]


def test_checkpoint_folder_is_kept(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)
