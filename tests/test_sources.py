import pytest
from pyspark.sql import functions as F

from matchloom.sources import delimited as D
from matchloom.sources.cache import TextCache


def write(path, text):
    path.write_text(text, encoding="utf-8")
    return str(path)


@pytest.mark.parametrize(("header", "sep"), [("a,b", ","), ("a\tb\tc,d", "\t"), ("a;b;c", ";"), ("a", ","), ("a\tb;c", ",")])
def test_sniffing(header, sep):
    assert D.sniffed_separator(header) == sep


def test_reading(spark, tmp_path):
    p = write(tmp_path / "a.csv", 'user_id,"job_description\t"\n1,x\n2,\\N\n')
    assert [tuple(r) for r in D.read_delimited(spark, p).orderBy("user_id").collect()] == [("1", "x"), ("2", None)]
    p = write(tmp_path / "b.txt", "user_id jd_no\nu j\n")
    assert [tuple(r) for r in D.read_delimited(spark, p, sep=" ").collect()] == [("u", "j")]


def test_ragged_lines(spark, tmp_path):
    p = write(tmp_path / "a.tsv", 'a\tb\tc\n1\t2\t3\t4\n5\n6\t"7\t8\n')
    assert sorted(tuple(r) for r in D.read_ragged(spark, p).collect()) == [("1", "2", "3\t4"), ("5", "", ""), ("6", '"7', "8")]
    merged = spark.createDataFrame([("1\t2",), ("3",)], ["x\ty"])
    assert sorted(tuple(r) for r in D.split_merged(merged).collect()) == [("1", "2"), ("3", "")]


def test_names(spark):
    df = spark.createDataFrame([("1", "t", "d")], ["position_no", "Title", "Long_Description"])
    assert D.inferred_names(df).columns == ["jd_no", "Title", "job_description"]
    assert D.resolved(df.withColumnRenamed("position_no", "id"), D.JOB_ALIASES, ["jd_no", "jd_title"]).columns[:2] == ["jd_no", "jd_title"]
    with pytest.raises(ValueError, match="user_id"):
        D.resolved(spark.createDataFrame([("1",)], ["x"]), D.USER_ALIASES, ["user_id"])


def test_sinks_and_stop_words(spark, tmp_path):
    ranked = spark.createDataFrame([("u", "b", 2), ("u", "a", 1)], "user_id string, jd_no string, rk int")
    D.write_pairs(ranked, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    imp = spark.createDataFrame([("f", 1.0), ("g", 2.0)], "feature string, avg_imp double")
    D.write_top(imp, str(tmp_path / "top"), 1)
    assert spark.read.option("header", True).csv(str(tmp_path / "top")).first()["feature"] == "g"
    assert {"the", "　"} <= {r[0] for r in D.stop_words(spark, write(tmp_path / "s.txt", "the\n\nthe\n")).collect()}


def test_cache(spark, tmp_path):
    cache = TextCache(spark, str(tmp_path / "cache"))
    df = spark.createDataFrame([("a",), ("b",), ("a",), (None,)], "text string")
    assert cache.misses(df, "text").count() == 2
    cache.add(cache.misses(df.limit(1), "text").select("key", F.length("text").alias("n")))
    assert [r["text"] for r in cache.misses(df, "text").collect()] == ["b"]
    assert sorted(str(r["n"]) for r in cache.attach(df, "text").collect()) == ["1", "1", "None", "None"]
