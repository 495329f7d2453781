"""Queries of this subpackage over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import packed
from ..session import table
from . import distinctive, languages, lexicon, normalize, packing, splits, topn

#: The fields of problem 2 by table and key.
LOOKS = [("table1_user", "user_id", ["experience"]), ("table2_jd", "jd_no", ["jd_title", "jd_sub_type"])]


def _splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.related_splits(
        table(spark, sf_dir, "table3_action"), "user_id", table(spark, sf_dir, "user_link"), "user_id", "linked_user_id"
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sharing_pairs(_splits(spark, sf_dir), "user_id")


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _splits(spark, sf_dir)


def p1_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.assign_rows(table(spark, sf_dir, "table3_action"), "user_id", _splits(spark, sf_dir))


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [normalize.forms(table(spark, sf_dir, t), key, fields) for t, key, fields in LOOKS]
    return parts[0].unionByName(parts[1])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.changed(_forms(spark, sf_dir))


def p2_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _forms(spark, sf_dir).distinct()


def _term_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rec_id``, ``field_name``, ``items``: the values of users and the title words of jobs in consistent form."""
    users = table(spark, sf_dir, "table1_user")
    values = packed.packed_items(users, "user_id", ["experience"])
    of_users = values.select(F.col("__key").alias("rec_id"), "field_name", normalize.consistent_forms(F.col("items")).alias("items"))
    titles = table(spark, sf_dir, "table2_jd").select("jd_no", "jd_title").dropDuplicates()
    words = F.split(normalize.consistent_form(F.col("jd_title")), r"\s+")
    return of_users.union(titles.select(F.col("jd_no").alias("rec_id"), F.lit("jd_title").alias("field_name"), words.alias("items")))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.records(_term_lists(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.standing_out(distinctive.distinctive_terms(_records(spark, sf_dir), distinctive.LEADERS))


def p4_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.distinctive_terms(_records(spark, sf_dir))


def _best(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = [(F.col("satisfied"), -1), (F.col("delivered"), -1)]
    return topn.top_n(table(spark, sf_dir, "table3_action"), "user_id", "jd_no", scores, 5)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir).select("user_id", "jd_no")


def p5_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _best(spark, sf_dir)


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = lexicon.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text")
    return packing.fill_containers(sizes, "doc_id", "n_tokens", table(spark, sf_dir, "pack_budget"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _containers(spark, sf_dir)


def p8_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.filling(_containers(spark, sf_dir), table(spark, sf_dir, "pack_budget"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.language_segments(table(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.mislabelled(_segments(spark, sf_dir))


def p9_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_splits, p1_rows, p2_found, p2_forms, p4_found, p4_terms, p5_found, p5_top, p7_ids,
        p8_containers, p8_filling, p9_found, p9_segments,
    )
}

#: Where SQL can say the same over whole tables; the other problems are tested against brute force.
SQL: dict[str, str] = {
    "p1_found": r"""
with recursive acc as (
  select x as raw, case when regexp_matches(t, '^[0-9a-f]{32}$') then t else '=' || x end as a from (
    select x, regexp_replace(regexp_replace(lower(translate(x,
      '０１２３４５６７８９ＡＢＣＤＥＦａｂｃｄｅｆ', '0123456789ABCDEFabcdef')), '^\s*uid:', ''), '[\s{}-]', '', 'g') as t
    from (select user_id as x from table3_action union select user_id from user_link union select linked_user_id from user_link)
    where x is not null)),
e as (select distinct p.a as u, q.a as v from user_link l join acc p on p.raw = l.user_id join acc q on q.raw = l.linked_user_id
      where p.a <> q.a and trim(l.user_id) <> '' and trim(l.linked_user_id) <> ''),
b as (select u, v from e union select v, u from e),
r(u, v) as (select u, v from b union select r.u, b.v from r join b on b.u = r.v),
k as (select s.user_id, coalesce((select least(min(r.v), acc.a) from r where r.u = acc.a), acc.a) as c
      from (select distinct user_id from table3_action where user_id is not null) s join acc on acc.raw = s.user_id)
select x.user_id as user_id_a, y.user_id as user_id_b from k x join k y on x.c = y.c and x.user_id < y.user_id""",
    "p5_top": """
with b as (select user_id, jd_no, max(coalesce(satisfied, -1) * 1000 + coalesce(delivered, -1)) as s
  from table3_action where user_id is not null and jd_no is not null group by user_id, jd_no)
select user_id, jd_no, cast(row_number() over (partition by user_id order by s desc, jd_no) as bigint) as position
from b qualify row_number() over (partition by user_id order by s desc, jd_no) <= 5""",
}
SQL["p5_found"] = f"select user_id, jd_no from ({SQL['p5_top']})"
