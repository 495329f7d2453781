"""Queries of the matching operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions import similarity as S
from ..operators import metrics, ranking
from ..session import checkpointed, table
from .registry import QUERIES, SQL, query  # noqa: F401

ACTION_KEYS = "user_id is not null and jd_no is not null"
_USERS = "(select distinct * exclude (loaded_at) from table1_user)"
_JOBS = "(select distinct * exclude (loaded_at) from table2_jd)"
_PAIRS = f"(select user_id, jd_no, count(*) as c from table3_action where {ACTION_KEYS} group by 1, 2)"


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per user: deliveries differ in loaded_at only."""
    return table(spark, sf_dir, "table1_user").drop("loaded_at").dropDuplicates(["user_id"])


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "table2_jd").drop("loaded_at").dropDuplicates(["jd_no"])


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "table3_action").where(ACTION_KEYS)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions(spark, sf_dir).groupBy("user_id", "jd_no").agg(F.count("*").alias("c"))


@query("""
with a as (select o_custkey as user_id, l_partkey as jd_no, case when l_returnflag = 'R' then 1 else 0 end as delivered,
             case when l_linestatus = 'F' then 1 else 0 end as satisfied from lineitem join orders on l_orderkey = o_orderkey),
d as (select user_id, jd_no, count(*) as c, max(delivered * 2 + satisfied) as best from a group by 1, 2),
u as (select user_id, count(*) as jd_nunique, count(distinct p_type) as sub_nunique from d join part on p_partkey = jd_no group by 1),
g as (select d.user_id, d.jd_no, round(0.5e0 * best / 3 + 0.3e0 * least(1.0e0, 0.3e0 + 0.1e0 * c) + 0.2e0 * sub_nunique / jd_nunique, 6) as score
      from d join u on u.user_id = d.user_id)
select user_id, jd_no, score, cast(row_number() over (partition by user_id order by score desc, jd_no) as bigint) as rk
from g qualify rk <= 5""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_linestatus")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    best = (F.col("l_returnflag") == "R").cast("int") * 2 + (F.col("l_linestatus") == "F").cast("int")
    d = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("jd_no"))
    # Written once: both the leaders and the counts of each user read it.
    d = checkpointed(d.agg(F.count("*").alias("c"), F.max(best).alias("best")))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("jd_no"), "p_type")
    u = d.select("user_id", "jd_no").join(part, "jd_no").groupBy("user_id").agg(F.count("*").alias("jn"), F.count_distinct("p_type").alias("sn"))
    # What differs within a user orders its rows; the user's own term joins the few that are left.
    own = 0.5 * F.col("best") / 3 + 0.3 * F.least(F.lit(1.0), 0.3 + 0.1 * F.col("c"))
    top = ranking.leaders(d.withColumn("own", own), ["user_id"], [F.desc("own"), F.col("jd_no")], 5, "rk")
    score = F.col("own") + 0.2 * F.col("sn") / F.col("jn")
    return top.join(u, "user_id").select("user_id", "jd_no", F.round(score, 6).alias("score"), "rk")


@query(f"select user_id, jd_no, c as user_jd_cnt, cast(sum(c) over (partition by user_id) as bigint) as jd_cnt, count(*) over (partition by user_id) as jd_nunique from {_PAIRS}")
def pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    per = p.groupBy("user_id").agg(F.sum("c").alias("jd_cnt"), F.count("*").alias("jd_nunique"))
    return p.join(per, "user_id").select("user_id", "jd_no", F.col("c").alias("user_jd_cnt"), "jd_cnt", "jd_nunique")


@query("select jd_no, count(user_id) as jd_user_cnt from table3_action where jd_no is not null group by 1")
def job_user_cnt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "table3_action").where("jd_no is not null").groupBy("jd_no").agg(F.count("user_id").alias("jd_user_cnt"))


@query(f"""select user_id, count(distinct coalesce(city, -1)) as city_nunique, count(distinct jd_title) as title_nunique,
count(distinct jd_sub_type) as sub_type_nunique from {_PAIRS} p join {_JOBS} j using (jd_no) group by 1""")
def user_job_nunique(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir).select("jd_no", F.coalesce("city", F.lit(-1)).alias("city"), "jd_title", "jd_sub_type")
    x = pairs(spark, sf_dir).select("user_id", "jd_no").join(j, "jd_no")
    return x.groupBy("user_id").agg(
        F.count_distinct("city").alias("city_nunique"), F.count_distinct("jd_title").alias("title_nunique"), F.count_distinct("jd_sub_type").alias("sub_type_nunique")
    )


@query(f"select jd_no, count(distinct live_city_id) as user_city_nunique from {_PAIRS} p join {_USERS} u using (user_id) group by 1")
def job_city_nunique(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = users(spark, sf_dir).select("user_id", "live_city_id")
    return pairs(spark, sf_dir).join(u, "user_id").groupBy("jd_no").agg(F.count_distinct("live_city_id").alias("user_city_nunique"))


@query(f"""with b as (select user_id, jd_no, max(coalesce(delivered, -1) * 10 + coalesce(satisfied, -1)) as m, max_by(struct_pack(d := delivered, s := satisfied),
coalesce(delivered, -1) * 10 + coalesce(satisfied, -1)) as x from table3_action a where {ACTION_KEYS} and exists (select 1 from table2_jd j where j.jd_no = a.jd_no) group by 1, 2)
select user_id, jd_no, x.d as delivered, x.s as satisfied from b""")
def dedup_keep_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "table2_jd").select("jd_no")
    best = F.max_by(F.struct("delivered", "satisfied"), F.coalesce("delivered", F.lit(-1)) * 10 + F.coalesce("satisfied", F.lit(-1)))
    d = actions(spark, sf_dir).groupBy("user_id", "jd_no").agg(best.alias("x"))
    return d.join(known, "jd_no", "left_semi").select("user_id", "jd_no", "x.delivered", "x.satisfied")


@query("select count(*) as n, count(distinct jd_no) as jobs from table3_action a where exists (select 1 from table2_jd j where j.jd_no = a.jd_no)")
def actions_semi_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "table2_jd").select("jd_no")
    return table(spark, sf_dir, "table3_action").join(known, "jd_no", "left_semi").agg(F.count("*").alias("n"), F.count_distinct("jd_no").alias("jobs"))


@query("select user_id, jd_no, action_at from table3_action a where jd_no is not null and not exists (select 1 from table2_jd j where j.jd_no = a.jd_no)")
def actions_anti_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "table2_jd").select("jd_no")
    return table(spark, sf_dir, "table3_action").where("jd_no is not null").join(known, "jd_no", "left_anti").select("user_id", "jd_no", "action_at")


@query(f"select a.user_id, a.jd_no, a.delivered, a.satisfied, a.action_at, u.live_city_id, u.cur_degree_id, j.city, j.jd_title, j.min_edu_level from table3_action a left join {_USERS} u on u.user_id = a.user_id left join {_JOBS} j on j.jd_no = a.jd_no")
def train_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = users(spark, sf_dir).select("user_id", "live_city_id", "cur_degree_id")
    j = jobs(spark, sf_dir).select("jd_no", "city", "jd_title", "min_edu_level")
    a = table(spark, sf_dir, "table3_action").select("user_id", "jd_no", "delivered", "satisfied", "action_at")
    return a.join(u, "user_id", "left").join(j, "jd_no", "left")


@query(f"""select user_id, jd_no, delivered, satisfied from (select distinct user_id, jd_no, delivered, satisfied from table3_action)
union all select user_id, jd_no, -1, -1 from (select distinct user_id, jd_no from user_exposure)""")
def train_test_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = table(spark, sf_dir, "table3_action").select("user_id", "jd_no", "delivered", "satisfied").distinct()
    return train.unionByName(table(spark, sf_dir, "user_exposure").select("user_id", "jd_no").distinct().withColumns({"delivered": F.lit(-1), "satisfied": F.lit(-1)}))


@query(f"""select e.user_id, e.jd_no, u.cur_industry_id, j.jd_industry, j.jd_no is not null as known from (select distinct user_id, jd_no from user_exposure) e
left join {_USERS} u on u.user_id = e.user_id left join {_JOBS} j on j.jd_no = e.jd_no""")
def exposures_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "user_exposure").select("user_id", "jd_no").distinct()
    j = jobs(spark, sf_dir).select("jd_no", "jd_industry", F.lit(True).alias("known"))
    e = e.join(users(spark, sf_dir).select("user_id", "cur_industry_id"), "user_id", "left").join(j, "jd_no", "left")
    return e.withColumn("known", F.coalesce("known", F.lit(False)))


def _salary_sql(c: str, low: bool) -> str:
    arms = " ".join(f"when {n} then try_cast({f'substr({c}, 1, {cut})' if low else f'substr({c}, {cut + 1})'} as bigint)" for n, cut in P.SALARY_SPLIT.items())
    return f"coalesce(case length({c}) {arms} end, -1)"


@query(f"select user_id, {_salary_sql('desire_jd_salary_id', True)} as min_desire, {_salary_sql('desire_jd_salary_id', False)} as max_desire, {_salary_sql('cur_salary_id', True)} as min_cur, {_salary_sql('cur_salary_id', False)} as max_cur from {_USERS}")
def salary_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = [P.salary(F.col(c), low).alias(f"{'min' if low else 'max'}_{n}") for c, n in (("desire_jd_salary_id", "desire"), ("cur_salary_id", "cur")) for low in (True, False)]
    return users(spark, sf_dir).select("user_id", *cols)


@query(f"""select user_id, regexp_extract_all(desire_jd_city_id, '[0-9]+') as cities,
case when list_contains(regexp_extract_all(desire_jd_city_id, '[0-9]+'), cast(live_city_id as varchar)) then 1 else 0 end as lives_there from {_USERS}""")
def array_city_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    cities = P.digits(F.col("desire_jd_city_id"))
    return users(spark, sf_dir).select("user_id", cities.alias("cities"), P.flag(F.array_contains(cities, F.col("live_city_id").cast("string"))).cast("int").alias("lives_there"))


@query(f"""select user_id, length(string_split(experience, '|')) as len_experience, length(string_split(desire_jd_industry_id, ',')) as len_industry,
coalesce(replace(experience, '|', ' '), 'nan') as joined,
length(list_filter(string_split(experience, '|'), lambda x: length(x) >= 4)) / length(string_split(experience, '|')) as eff_ratio from {_USERS}""")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.split("experience", r"\|")
    return users(spark, sf_dir).select(
        "user_id", P.parts_count(F.col("experience"), r"\|").alias("len_experience"), P.parts_count(F.col("desire_jd_industry_id"), ",").alias("len_industry"),
        F.coalesce(F.replace("experience", F.lit("|"), F.lit(" ")), F.lit("nan")).alias("joined"),
        F.try_divide(F.size(F.filter(parts, lambda x: F.length(x) >= 4)), F.size(parts)).alias("eff_ratio"),
    )


_DAY = "case when regexp_matches({0}, '^[0-9]{{8}}$') then cast(try_strptime({0}, '%Y%m%d') as date) end"


@query(f"""with d as (select jd_no, {_DAY.format('start_date')} as s, {_DAY.format('end_date')} as e from {_JOBS})
select jd_no, case when e = date '2200-01-01' then null else s end as start_day, case when e = date '2200-01-01' then null else e end as end_day,
month(s) as start_month, day(s) as start_dom, case when e = date '2200-01-01' then null else date_diff('day', s, e) end as open_days from d""")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = jobs(spark, sf_dir).select("jd_no", P.day(F.col("start_date")).alias("s"), P.day(F.coalesce(F.nullif("end_date", F.lit("\\N")), F.lit(None))).alias("e"))
    open_ended = F.coalesce(F.col("e") == F.lit("2200-01-01").cast("date"), F.lit(False))
    keep = lambda c: F.when(~open_ended, c)
    return d.select(
        "jd_no", keep(F.col("s")).alias("start_day"), keep(F.col("e")).alias("end_day"), F.month("s").cast("bigint").alias("start_month"),
        F.dayofmonth("s").cast("bigint").alias("start_dom"), keep(F.datediff("e", "s")).cast("bigint").alias("open_days"),
    )


@query(f"select user_id, 2019 - try_cast(case when start_work_date = '-' then null else start_work_date end as bigint) as work_years from {_USERS}")
def work_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return users(spark, sf_dir).select("user_id", (F.lit(2019) - F.nullif("start_work_date", F.lit("-")).try_cast("bigint")).alias("work_years"))


def _case(c: str, codes: dict) -> str:
    return f"case {c} " + " ".join(f"when {k!r} then {v}" for k, v in codes.items()) + " end"


_CODES = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


@query(f"select jd_no, {_case(_STRIP.format('min_edu_level'), P.DEGREES)} as edu, {_case('min_years', P.LEAST_YEARS)} as least_years, {_case('min_years', P.MOST_YEARS)} as most_years from {_JOBS}")
def code_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).select(
        "jd_no", P.coded(P.stripped(F.col("min_edu_level")), P.DEGREES).alias("edu"), P.coded(F.col("min_years"), P.LEAST_YEARS).alias("least_years"),
        P.coded(F.col("min_years"), P.MOST_YEARS).alias("most_years"),
    )


@query(f"""select e.user_id, e.jd_no, case when u.live_city_id = j.city then 1 else 0 end as same_city,
case when {_case(_STRIP.format('u.cur_degree_id'), P.DEGREES)} >= {_case(_STRIP.format('j.min_edu_level'), P.DEGREES)} then 1 else 0 end as degree_ge,
case when u.cur_industry_id is null or u.desire_jd_industry_id is null then -1 when contains(u.desire_jd_industry_id, u.cur_industry_id) then 1 else 0 end as industry_in,
case when j.jd_sub_type is null or u.desire_jd_type_id is null then -1 when contains(u.desire_jd_type_id, j.jd_sub_type) then 1 else 0 end as type_in
from (select distinct user_id, jd_no from user_exposure) e join {_USERS} u on u.user_id = e.user_id join {_JOBS} j on j.jd_no = e.jd_no""")
def compare_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _exposed(spark, sf_dir)
    degree = lambda c: P.coded(P.stripped(F.col(c)), P.DEGREES)
    return x.select(
        "user_id", "jd_no", P.flag(F.col("live_city_id") == F.col("city")).cast("int").alias("same_city"),
        P.flag(degree("cur_degree_id") >= degree("min_edu_level")).cast("int").alias("degree_ge"),
        P.contained(F.col("cur_industry_id"), F.col("desire_jd_industry_id")).cast("int").alias("industry_in"),
        P.contained(F.col("jd_sub_type"), F.col("desire_jd_type_id")).cast("int").alias("type_in"),
    )


def _exposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "user_exposure").select("user_id", "jd_no").distinct()
    return e.join(users(spark, sf_dir), "user_id").join(jobs(spark, sf_dir), "jd_no")


@query(f"""with c as (select jd_no, trim(regexp_replace(replace(coalesce(job_description, ''), '\\n', ' '), '\\s+', ' ', 'g')) as text from {_JOBS})
select jd_no, text, md5(text) as key, cast(length(text) as bigint) as n from c where length(text) >= 10""")
def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = jobs(spark, sf_dir).select("jd_no", P.cleaned(F.col("job_description")).alias("text"))
    return t.where("length(text) >= 10").select("jd_no", "text", F.md5("text").alias("key"), F.length("text").cast("bigint").alias("n"))


_TOK = r"list_distinct(list_filter(string_split_regex(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: length(x) > 1))"
_EXP = f"(select distinct user_id, jd_no from user_exposure) e join {_USERS} u on u.user_id = e.user_id join {_JOBS} j on j.jd_no = e.jd_no"


@query(f"""with t as (select e.user_id, e.jd_no, {_TOK.format('u.experience')} as a, {_TOK.format('j.job_description')} as b from {_EXP}),
j as (select user_id, jd_no, len(list_intersect(a, b)) as i, len(a) as n1, len(b) as n2 from t where a is not null and b is not null),
s as (select *, case when n1 + n2 - i > 0 then i / (n1 + n2 - i) else 0 end as jac,
  case when n1 > 0 and n2 > 0 then i / sqrt((i + (1 + ln(1.5e0)) ^ 2 * (n1 - i)) * (i + (1 + ln(1.5e0)) ^ 2 * (n2 - i))) else 0 end as cos from j)
select user_id, jd_no, i as common, round(jac, 6) as jac, round(0.4e0 * jac + 0.4e0 * case when jac > 0.1e0 then cos else 0 end
  + 0.2e0 * case when greatest(n1, n2) > 0 then i / greatest(n1, n2) else 0 end, 6) as likeness from s""")
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only pairs that have both texts, as its SQL says; ``text_similarity_all`` has every pair."""
    u, j = _texts(spark, sf_dir)
    x = table(spark, sf_dir, "user_exposure").select("user_id", "jd_no").distinct().join(u, "user_id").join(j, "jd_no").where("a is not null and b is not null")
    return _likeness(x)


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    u = users(spark, sf_dir).select("user_id", P.tokens(F.col("experience")).alias("a"))
    return u, jobs(spark, sf_dir).select("jd_no", P.tokens(F.col("job_description")).alias("b"))


def _likeness(x: DataFrame) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return x.select("user_id", "jd_no", F.size(F.array_intersect(a, b)).cast("bigint").alias("common"), F.round(S.jaccard(a, b), 6).alias("jac"), F.round(S.text_likeness(a, b), 6).alias("likeness"))


_EXP_ALL = f"(select distinct user_id, jd_no from user_exposure) e left join {_USERS} u on u.user_id = e.user_id left join {_JOBS} j on j.jd_no = e.jd_no"


@query(f"""with t as (select e.user_id, e.jd_no, coalesce({_TOK.format('u.experience')}, []) as a, coalesce({_TOK.format('j.job_description')}, []) as b from {_EXP_ALL}),
j as (select user_id, jd_no, len(list_intersect(a, b)) as i, len(a) as n1, len(b) as n2 from t),
s as (select *, case when n1 + n2 - i > 0 then i / (n1 + n2 - i) else 0 end as jac,
  case when n1 > 0 and n2 > 0 then i / sqrt((i + (1 + ln(1.5e0)) ^ 2 * (n1 - i)) * (i + (1 + ln(1.5e0)) ^ 2 * (n2 - i))) else 0 end as cos from j)
select user_id, jd_no, i as common, round(jac, 6) as jac, round(0.4e0 * jac + 0.4e0 * case when jac > 0.1e0 then cos else 0 end
  + 0.2e0 * case when greatest(n1, n2) > 0 then i / greatest(n1, n2) else 0 end, 6) as likeness from s""")
def text_similarity_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exposed pair; 0 where a text is missing."""
    u, j = _texts(spark, sf_dir)
    x = table(spark, sf_dir, "user_exposure").select("user_id", "jd_no").distinct().join(u, "user_id", "left").join(j, "jd_no", "left")
    return _likeness(x.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in "ab"}))


@query(f"""select e.user_id, e.jd_no, case when u.experience is null or j.jd_sub_type is null then 0 else
cast(len(list_intersect(list_distinct(list_concat(coalesce({_TOK.format('j.jd_title')}, []), {_TOK.format('j.jd_sub_type')})), {_TOK.format('u.experience')})) as bigint) end as hits from {_EXP}""")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each person and each position are cut once, before pairs are joined."""
    wanted = F.array_union(F.coalesce(P.tokens(F.col("jd_title")), F.array().cast("array<string>")), P.tokens(F.col("jd_sub_type")))
    j = jobs(spark, sf_dir).select("jd_no", F.when(F.col("jd_sub_type").isNotNull(), wanted).alias("wanted"))
    u = users(spark, sf_dir).select("user_id", P.tokens(F.col("experience")).alias("held"))
    x = table(spark, sf_dir, "user_exposure").select("user_id", "jd_no").distinct().join(u, "user_id").join(j, "jd_no")
    return x.select("user_id", "jd_no", F.when(F.col("held").isNotNull() & F.col("wanted").isNotNull(), F.size(F.array_intersect("wanted", "held"))).otherwise(0).cast("bigint").alias("hits"))


@query(f"""with t as (select e.user_id, e.jd_no, string_split(u.experience, '|') as segs, list_filter({_TOK.format("concat_ws(' ', j.jd_title, j.jd_sub_type)")}, lambda x: not regexp_matches(x, '[0-9]')) as kw from {_EXP} where u.experience is not null),
w as (select *, list_transform(segs, lambda s, i: pow(0.8e0, i - 1)) as ws, list_transform(segs, lambda s: case when len({_TOK.format('s')}) = 0 then 0e0
  else least(1e0, len(list_intersect({_TOK.format('s')}, kw)) / sqrt(len({_TOK.format('s')})) * case when len(list_filter(kw, lambda k: contains(s, k))) > 0 then 1.2e0 else 1e0 end) end) as q from t)
select user_id, jd_no, round(list_sum(list_transform(q, lambda x, i: x * ws[i])) / list_sum(ws), 6) as quality from w""")
def experience_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only pairs that have an experience, as its SQL says; ``experience_quality_all`` has every pair."""
    e = table(spark, sf_dir, "user_exposure").select("user_id", "jd_no").distinct()
    x = e.join(_segments(users(spark, sf_dir)).where("segs is not null"), "user_id").join(_asked(spark, sf_dir), "jd_no")
    return x.select("user_id", "jd_no", _quality().alias("quality"))


def _segments(u: DataFrame) -> DataFrame:
    """``user_id``, ``segs``: the text, words and weight of each part of an experience, cut once a person."""
    parts = F.transform(F.split("experience", r"\|"), lambda s, i: F.struct(s.alias("s"), P.tokens(s).alias("t"), F.pow(F.lit(0.8), i).alias("w")))
    return u.select("user_id", parts.alias("segs"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs(spark, sf_dir).select("jd_no", "jd_title", P.keywords(F.concat_ws(" ", "jd_title", "jd_sub_type")).alias("kw"))


def _quality() -> Column:
    def one(x):
        held = F.exists("kw", lambda k: x["s"].contains(k))
        raw = F.size(F.array_intersect(x["t"], F.col("kw"))) / F.sqrt(F.size(x["t"]).cast("double")) * F.when(held, 1.2).otherwise(1.0)
        return F.when(F.size(x["t"]) == 0, 0.0).otherwise(F.least(F.lit(1.0), raw))

    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    q = F.transform("segs", lambda x: one(x) * x["w"])
    return F.round(total(q) / total(F.transform("segs", lambda x: x["w"])), 6)


@query(f"""with t as (select e.user_id, e.jd_no, case when j.jd_title is not null then string_split(u.experience, '|') end as segs, list_filter({_TOK.format("concat_ws(' ', j.jd_title, j.jd_sub_type)")}, lambda x: not regexp_matches(x, '[0-9]')) as kw from {_EXP_ALL}),
w as (select *, list_transform(segs, lambda s, i: pow(0.8e0, i - 1)) as ws, list_transform(segs, lambda s: case when len({_TOK.format('s')}) = 0 then 0e0
  else least(1e0, len(list_intersect({_TOK.format('s')}, kw)) / sqrt(len({_TOK.format('s')})) * case when len(list_filter(kw, lambda k: contains(s, k))) > 0 then 1.2e0 else 1e0 end) end) as q from t)
select user_id, jd_no, coalesce(round(list_sum(list_transform(q, lambda x, i: x * ws[i])) / list_sum(ws), 6), 0e0) as quality from w""")
def experience_quality_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every exposed pair; 0 where the experience or the title is missing."""
    e = table(spark, sf_dir, "user_exposure").select("user_id", "jd_no").distinct()
    both = F.col("segs").isNotNull() & F.col("jd_title").isNotNull()
    return e.join(_segments(users(spark, sf_dir)), "user_id", "left").join(_asked(spark, sf_dir), "jd_no", "left").select("user_id", "jd_no", F.when(both, _quality()).otherwise(0.0).alias("quality"))


@query(f"select a.user_id, a.jd_no, a.t as jd_title, b.name from (select user_id, jd_no, lower(jd_title) as t from {_JOBS} j join (select distinct user_id, jd_no from user_exposure) e using (jd_no)) a join (select distinct ref_name as name from ref_item where ref_kind = 'job_type') b on contains(a.t, lower(b.name))")
def title_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every different title is compared with the names once; ref_item is a fixed table."""
    names = table(spark, sf_dir, "ref_item").where("ref_kind = 'job_type'").select(F.col("ref_name").alias("name")).distinct()
    e = table(spark, sf_dir, "user_exposure").select("user_id", "jd_no").distinct()
    titled = jobs(spark, sf_dir).select("jd_no", F.lower("jd_title").alias("jd_title"))
    held = titled.select("jd_title").distinct().join(F.broadcast(names), F.col("jd_title").contains(F.lower("name")))
    return e.join(titled.join(held, "jd_title"), "jd_no").select("jd_no", "user_id", "jd_title", "name")


@query("""with c as (select label, list(embedding) as l, count(*) as n from embeddings group by 1),
m as (select label, unnest(range(1, 65)) as i, l from c), k as (select label, list(round(list_avg(list_transform(l, lambda v: cast(v[i] as double))), 9) order by i) as mean from m group by 1)
select vec_id, label, round(list_cosine_similarity(list_transform(embedding, lambda x: cast(x as double)), mean), 5) as cos from embeddings join k using (label)""")
def vector_centroid_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    parts = v.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
    mean = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("mean"))
    return v.join(mean, "label").select("vec_id", "label", F.round(S.cosine(F.col("embedding"), F.col("mean")), 5).alias("cos"))


@query("""select event_id, round(least(0.95e0, greatest(0.05e0, (rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0) / count(*) over ())), 9) as pct from events""")
def pct_rank_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ranking.average_percentile(table(spark, sf_dir, "events").select("event_id", "value"), "value", "pct")
    return x.select("event_id", F.round(F.least(F.lit(0.95), F.greatest(F.lit(0.05), "pct")), 9).alias("pct"))


@query("select event_id, round((value - min(value) over ()) / (max(value) over () - min(value) over ()), 9) as scaled from events")
def minmax_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.scaled(table(spark, sf_dir, "events").select("event_id", "value"), "value", "scaled").select("event_id", F.round("scaled", 9).alias("scaled"))


@query(f"select jd_title, cast(dense_rank() over (order by jd_title) - 1 as bigint) as code from (select distinct jd_title from table2_jd where jd_title is not null)")
def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.dense_codes(table(spark, sf_dir, "table2_jd"), "jd_title", "code")


@query("select user_id, cast((dense_rank() over (order by user_id) - 1) % 5 as bigint) as fold from (select distinct user_id from table3_action where user_id is not null)")
def user_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.dense_codes(table(spark, sf_dir, "table3_action"), "user_id", "fold").withColumn("fold", F.col("fold") % 5)


_RANKED = "r as (select *, row_number() over (partition by user_id order by value desc, event_id) rk from events), p as (select *, row_number() over (partition by user_id order by rk) ix from r where event_type = 'purchase')"


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return ranking.positions(e, ["user_id"], [F.desc("value"), F.col("event_id")], "rk")


@query(f"with {_RANKED} select user_id, round(avg(ix / rk), 8) as ap from p group by 1")
def map_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(_ranked(spark, sf_dir), "user_id", "rk", F.col("event_type") == "purchase").select("user_id", F.round("ap", 8).alias("ap"))


@query(f"""with {_RANKED}, s as (select user_id, sum(ix / rk) as s from p where rk <= 20 group by 1), n as (select user_id, count(*) as n from events where event_type = 'purchase' group by 1)
select round(avg(s.s / n.n), 8) as map from s join n using (user_id)""")
def map_semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only hits in the first 20 places, and only users who have one, as its SQL says; ``map_semantic_all`` is the reference's metric."""
    ap = metrics.average_precision(_ranked(spark, sf_dir).where("rk <= 20"), "user_id", "rk", F.col("event_type") == "purchase", _purchases(spark, sf_dir))
    return ap.where("ap > 0").agg(F.round(F.avg("ap"), 8).alias("map"))


def _purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"""with {_RANKED}, s as (select user_id, sum(ix / rk) as s from p group by 1), n as (select user_id, count(*) as n from events where event_type = 'purchase' and user_id is not null group by 1)
select round(avg(coalesce(s.s, 0) / n.n), 8) as map from n left join s using (user_id)""")
def map_semantic_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every place counts; a user whose hits are never ranked has 0."""
    total = _purchases(spark, sf_dir).where("user_id is not null")
    ap = metrics.average_precision(_ranked(spark, sf_dir), "user_id", "rk", F.col("event_type") == "purchase", total)
    return ap.agg(F.round(F.avg("ap"), 8).alias("map"))


@query("""with r as (select event_type = 'purchase' as y, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0 as rk from events),
a as (select sum(case when y then rk end) as s, count(*) filter (y) as p, count(*) as n from r)
select round((s - p * (p + 1) / 2.0) / (p * (n - p)), 8) as auc from a""")
def auc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(table(spark, sf_dir, "events").select("value", "event_type"), "value", F.col("event_type") == "purchase").select(F.round("auc", 8).alias("auc"))


@query(f"""with s as (select e.user_id, e.jd_no, j.jd_no is not null as known, coalesce(p.n, 0) as score from (select distinct user_id, jd_no from user_exposure) e
left join {_JOBS} j on j.jd_no = e.jd_no left join (select jd_no, count(*) as n from table3_action where jd_no is not null group by 1) p on p.jd_no = e.jd_no)
select user_id, jd_no, known, score, round(case when max(score) over (partition by user_id) > 0 then 100e0 * score / max(score) over (partition by user_id) else 0 end, 4) as relative,
cast(row_number() over (partition by user_id order by known desc, score desc, jd_no) as bigint) as rk from s""")
def rank_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    pop = table(spark, sf_dir, "table3_action").where("jd_no is not null").groupBy("jd_no").agg(F.count("*").alias("score"))
    e = table(spark, sf_dir, "user_exposure").select("user_id", "jd_no").distinct()
    s = e.join(jobs(spark, sf_dir).select("jd_no", F.lit(True).alias("known")), "jd_no", "left").join(pop, "jd_no", "left").fillna(0, ["score"]).fillna(False, ["known"])
    top = s.groupBy("user_id").agg(F.max("score").alias("top"))
    s = s.join(top, "user_id").withColumn("relative", F.round(F.when(F.col("top") > 0, 100.0 * F.col("score") / F.col("top")).otherwise(0.0), 4)).drop("top")
    return ranking.positions(s, ["user_id"], [F.desc("known"), F.desc("score"), F.col("jd_no")], "rk")


@query("""with f as (select p_type as feature, p_size % 5 as fold, sum(p_retailprice) as imp from part group by 1, 2), m as (select feature, avg(imp) as avg_imp from f group by 1)
select feature, round(avg_imp, 6) as avg_imp, round(avg_imp / sum(avg_imp) over (), 6) as share from m where avg_imp > 0 order by avg_imp desc, feature limit 50""")
def importance_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("feature"), (F.col("p_size") % 5).alias("fold")).agg(F.sum("p_retailprice").alias("imp"))
    m = f.groupBy("feature").agg(F.avg("imp").alias("avg_imp")).where("avg_imp > 0")
    total = m.agg(F.sum("avg_imp").alias("t"))
    out = m.join(F.broadcast(total)).orderBy(F.desc("avg_imp"), "feature").limit(50)
    return out.select("feature", F.round("avg_imp", 6).alias("avg_imp"), F.round(F.col("avg_imp") / F.col("t"), 6).alias("share"))


@query(f"""with t as (select jd_no, unnest({_TOK.format('jd_title')}) as term from {_JOBS}), n as (select count(*) as n from {_JOBS} where jd_title is not null),
d as (select term, count(*) as df from t group by 1), w as (select jd_no, term, ln((1 + n) / (1 + df)) + 1 as w from t join d using (term), n)
select jd_no, term, round(w / sqrt(sum(w * w) over (partition by jd_no)), 6) as weight from w""")
def tfidf_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir).where("jd_title is not null").select("jd_no", P.tokens(F.col("jd_title")).alias("ts"))
    t = j.select("jd_no", F.explode("ts").alias("term"))
    d = t.groupBy("term").agg(F.count("*").alias("df"))
    w = t.join(d, "term").join(F.broadcast(j.agg(F.count("*").alias("n")))).select("jd_no", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("w"))
    norm = w.groupBy("jd_no").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "jd_no").select("jd_no", "term", F.round(F.col("w") / F.col("norm"), 6).alias("weight"))


@query(f"""with t as (select distinct e.jd_no, e.user_id, {_TOK.format('u.experience')} as ts from (select distinct user_id, jd_no from user_exposure) e join {_USERS} u on u.user_id = e.user_id)
select jd_no, term, count(*) as n from (select jd_no, unnest(ts) as term from t) group by 1, 2""")
def job_term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = users(spark, sf_dir).select("user_id", P.tokens(F.col("experience")).alias("ts"))
    e = table(spark, sf_dir, "user_exposure").select("user_id", "jd_no").distinct().join(u, "user_id")
    return e.select("jd_no", F.explode("ts").alias("term")).groupBy("jd_no", "term").agg(F.count("*").alias("n"))


@query("""select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, json_extract_string(props, '$.missing') is null as bad from events""")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.from_json("props", "k bigint, missing string")
    return table(spark, sf_dir, "events").select("event_id", x["k"].alias("k"), x["missing"].isNull().alias("bad"))
