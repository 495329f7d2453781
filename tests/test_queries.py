import pytest
from conftest import compare

import __spark_entry__ as entry
from matchloom.plans import registry, dealt

SQL = registry.SQL | dealt.SQL
QUERIES = registry.QUERIES | dealt.QUERIES


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf_dir, name):
    compare(spark, sf_dir, QUERIES[name], SQL[name])


def test_entry_has_a_stable_schema(spark, sf_dir):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "jd_no", "score", "rk"]
    assert df.where("rk > 5 or rk < 1").count() == 0


def test_learning_queries(spark, sf_dir):
    oof = QUERIES["gbt_oof"](spark, sf_dir)
    assert oof.where("pred < 0 or pred > 1").count() == 0
    assert oof.groupBy("user_id").agg({"fold": "max"}).count() == oof.select("user_id", "fold").distinct().count()
    assert {len(r["vector"]) for r in QUERIES["tfidf_reduced"](spark, sf_dir).take(5)} == {10}
