"""From labelled pairs to a final ranking: out-of-fold predictions, their quality, the joined fold models, the blend.

The fold model here is the smoothed rate of a job's positive pairs outside the fold, which SQL can say
too; `learning.FoldModels` gives predictions of boosted trees with the same columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..functions.udfs import likely_names
from ..operators import metrics, ranking
from ..session import checkpointed, table
from .catalog import _CODES, _EXP, _EXP_ALL, _JOBS, _USERS, ACTION_KEYS, _case, _exposed, _salary_sql, actions, jobs, users
from .registry import query

FOLDS = 5
#: Shares of both targets in the final metric and in the blend.
SHARE = {"satisfied": 0.7, "delivered": 0.3}

_F = f"""u as (select user_id, (dense_rank() over (order by user_id) - 1) % {FOLDS} as fold from (select distinct user_id from table3_action where user_id is not null)),
x as (select user_id, jd_no, fold, max(coalesce(satisfied, 0)) as satisfied, max(coalesce(delivered, 0)) as delivered
  from table3_action join u using (user_id) where jd_no is not null group by 1, 2, 3),
k as (select jd_no, fold, count(*) as n, sum(satisfied) as s, sum(delivered) as d from x group by 1, 2),
t as (select jd_no, sum(n) as n, sum(s) as s, sum(d) as d from k group by 1),
o as (select x.*, (t.s - k.s + 1) / (t.n - k.n + 2) as sat, (t.d - k.d + 1) / (t.n - k.n + 2) as dev from x join t using (jd_no) join k using (jd_no, fold)),
ra as (select fold, satisfied, delivered, rank() over (partition by fold order by sat) + (count(*) over (partition by fold, sat) - 1) / 2.0 as rs,
  rank() over (partition by fold order by dev) + (count(*) over (partition by fold, dev) - 1) / 2.0 as rd from o),
au as (select fold, (sum(rs) filter (satisfied = 1) - sum(satisfied) * (sum(satisfied) + 1) / 2.0) / (sum(satisfied) * (count(*) - sum(satisfied))) as sat,
  (sum(rd) filter (delivered = 1) - sum(delivered) * (sum(delivered) + 1) / 2.0) / (sum(delivered) * (count(*) - sum(delivered))) as dev from ra group by 1)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``user_id``, ``jd_no``, ``fold``, ``satisfied``, ``delivered``: every acted pair once with its best labels; a person's pairs share a fold."""
    y = {c: F.max(F.coalesce(c, F.lit(0))).alias(c) for c in SHARE}
    p = actions(spark, sf_dir).groupBy("user_id", "jd_no").agg(*y.values())
    folds = ranking.dense_codes(p, "user_id", "fold").withColumn("fold", F.col("fold") % FOLDS)
    return p.join(folds, "user_id")


def fold_rates(pairs: DataFrame) -> DataFrame:
    """``jd_no``, ``fold``, ``sat``, ``dev``: what the model of each fold says of each job, from the pairs outside the fold."""
    k = pairs.groupBy("jd_no", "fold").agg(F.count("*").alias("n"), F.sum("satisfied").alias("s"), F.sum("delivered").alias("d"))
    t = k.groupBy("jd_no").agg(*[F.sum(c).alias(f"{c}_all") for c in "nsd"])
    every = t.select("*", F.explode(F.sequence(F.lit(0), F.lit(FOLDS - 1)).cast("array<bigint>")).alias("fold"))
    x = every.join(k, ["jd_no", "fold"], "left").fillna(0, list("nsd"))
    rate = lambda c: (F.col(f"{c}_all") - F.col(c) + 1) / (F.col("n_all") - F.col("n") + 2)
    return x.select("jd_no", "fold", rate("s").alias("sat"), rate("d").alias("dev"))


def _out_of_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = checkpointed(labelled(spark, sf_dir))
    return p.join(fold_rates(p), ["jd_no", "fold"])


@query(f"with {_F} select user_id, jd_no, fold, satisfied, delivered, round(sat, 9) as sat, round(dev, 9) as dev from o")
def rate_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _out_of_fold(spark, sf_dir)
    return x.select("user_id", "jd_no", "fold", "satisfied", "delivered", F.round("sat", 9).alias("sat"), F.round("dev", 9).alias("dev"))


def _aucs(oof: DataFrame) -> DataFrame:
    """``fold``, ``sat``, ``dev``: areas under the curve; one row a fold."""
    a = metrics.auc_by(oof, "fold", "sat", F.col("satisfied")).withColumnRenamed("auc", "sat")
    return a.join(metrics.auc_by(oof, "fold", "dev", F.col("delivered")).withColumnRenamed("auc", "dev"), "fold")


@query(f"with {_F} select fold, round(sat, 8) as sat, round(dev, 8) as dev from au union all select -1, round(avg(sat), 8), round(avg(dev), 8) from au")
def fold_aucs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the curve of each fold, and their mean as fold -1."""
    a = checkpointed(_aucs(checkpointed(_out_of_fold(spark, sf_dir))))
    mean = a.agg(F.lit(-1).cast("bigint").alias("fold"), F.avg("sat").alias("sat"), F.avg("dev").alias("dev"))
    return a.unionByName(mean).select("fold", F.round("sat", 8).alias("sat"), F.round("dev", 8).alias("dev"))


def _mean_precision(oof: DataFrame, pred: str, label: str) -> DataFrame:
    ranked = ranking.positions(oof, ["user_id"], [F.desc(F.round(pred, 9)), F.col("jd_no")], "rk")
    return metrics.average_precision(ranked, "user_id", "rk", F.col(label) == 1).agg(F.avg("ap").alias(pred))


_MAP = "(select avg(ap) as m from (select user_id, avg(ix / rk) as ap from (select *, row_number() over (partition by user_id order by rk) as ix from (select user_id, {1}, row_number() over (partition by user_id order by round({0}, 9) desc, jd_no) as rk from o) where {1} = 1) group by 1))"


@query(f"with {_F} select round(a.m, 8) as map_sat, round(b.m, 8) as map_dev, round(0.7e0 * a.m + 0.3e0 * b.m, 8) as final from {_MAP.format('sat', 'satisfied')} a, {_MAP.format('dev', 'delivered')} b")
def final_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean average precision of both targets out of fold, and the final metric of them."""
    oof = checkpointed(_out_of_fold(spark, sf_dir))
    m = _mean_precision(oof, "sat", "satisfied").join(F.broadcast(_mean_precision(oof, "dev", "delivered")))  # one row each
    final = SHARE["satisfied"] * F.col("sat") + SHARE["delivered"] * F.col("dev")
    return m.select(F.round("sat", 8).alias("map_sat"), F.round("dev", 8).alias("map_dev"), F.round(final, 8).alias("final"))


@query(f"""with {_F}, e as (select distinct user_id, jd_no from user_exposure),
f as (select e.user_id, e.jd_no, a.sat as ws, a.dev as wd, coalesce((t.s - coalesce(k.s, 0) + 1) / (t.n - coalesce(k.n, 0) + 2), 0.5) as ps,
  coalesce((t.d - coalesce(k.d, 0) + 1) / (t.n - coalesce(k.n, 0) + 2), 0.5) as pd from e cross join au a left join t on t.jd_no = e.jd_no left join k on k.jd_no = e.jd_no and k.fold = a.fold),
g as (select user_id, jd_no, sum(ps * ws) / sum(ws) as sat, sum(pd * wd) / sum(wd) as dev from f group by 1, 2),
h as (select g.user_id, g.jd_no, x.satisfied, x.delivered, round(g.sat, 6) as sat, round(g.dev, 6) as dev, coalesce(case when u.live_city_id = j.city then 1 else 0 end, 0) as same_city,
  round(0.7e0 * g.sat + 0.3e0 * g.dev, 6) as score
  from g left join x on x.user_id = g.user_id and x.jd_no = g.jd_no left join {_USERS} u on u.user_id = g.user_id left join {_JOBS} j on j.jd_no = g.jd_no)
select *, cast(row_number() over (partition by user_id order by score desc, jd_no) as bigint) as rk from h""")
def blended_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposed pairs ranked by the blend of both targets' joined fold models, with labels and a dimension where there are any.

    Fold models weigh by their area under the curve; a job nobody acted on is at 0.5.
    """
    p = checkpointed(labelled(spark, sf_dir))
    rates = checkpointed(fold_rates(p))
    aucs = checkpointed(_aucs(p.join(rates, ["jd_no", "fold"])))
    means = [metrics.fold_mean(rates, ["jd_no"], "fold", c, aucs.select("fold", F.col(c).alias("weight"))) for c in ("sat", "dev")]
    e = table(spark, sf_dir, "user_exposure").select("user_id", "jd_no").distinct()
    g = reduce(lambda a, b: a.join(b, "jd_no", "left"), means, e).fillna(0.5, ["sat", "dev"])
    city = _exposed(spark, sf_dir).select("user_id", "jd_no", P.flag(F.col("live_city_id") == F.col("city")).cast("int").alias("same_city"))
    h = g.join(p.drop("fold"), ["user_id", "jd_no"], "left").join(city, ["user_id", "jd_no"], "left").fillna(0, ["same_city"])
    h = h.withColumn("score", F.round(SHARE["satisfied"] * F.col("sat") + SHARE["delivered"] * F.col("dev"), 6))
    h = h.withColumns({c: F.round(c, 6) for c in ("sat", "dev")})
    return ranking.positions(h, ["user_id"], [F.desc("score"), F.col("jd_no")], "rk")


@query(f"""select user_id, jd_no, satisfied, delivered, case when satisfied = -1 then 'score' else 'train' end as part from
(select user_id, jd_no, delivered, satisfied from (select distinct user_id, jd_no, delivered, satisfied from table3_action where {ACTION_KEYS})
 union all select user_id, jd_no, -1, -1 from (select distinct user_id, jd_no from user_exposure))""")
def label_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows to train on and rows to score, told apart by the label -1; a null label is to train on."""
    train = actions(spark, sf_dir).select("user_id", "jd_no", "satisfied", "delivered").distinct()
    both = train.unionByName(table(spark, sf_dir, "user_exposure").select("user_id", "jd_no").distinct().withColumns({c: F.lit(-1) for c in SHARE}))
    return both.withColumn("part", F.when(F.col("satisfied") == -1, "score").otherwise("train"))


@query("""select jd_no, count(user_id) as jd_user_cnt from (select user_id, jd_no from table3_action union all select user_id, jd_no from (select distinct user_id, jd_no from user_exposure))
where jd_no is not null group by 1""")
def job_user_cnt_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a person per job, over what was acted on and what is to be scored."""
    acted, shown = table(spark, sf_dir, "table3_action").select("user_id", "jd_no"), table(spark, sf_dir, "user_exposure").select("user_id", "jd_no").distinct()
    return acted.union(shown).where("jd_no is not null").groupBy("jd_no").agg(F.count("user_id").alias("jd_user_cnt"))


_EDU = _CODES.format("{0}")


@query(f"""select e.user_id, e.jd_no, coalesce((u.live_city_id = j.city)::int, 0.5e0) as city, coalesce(({_case(_EDU.format('u.cur_degree_id'), P.DEGREES)} >= {_case(_EDU.format('j.min_edu_level'), P.DEGREES)})::int, 0.5e0) as degree,
 coalesce(least(1e0, p.n / 10), 0.5e0) as activity from {_EXP_ALL} left join (select user_id, count(*) as n from table3_action where {ACTION_KEYS} group by 1) p on p.user_id = e.user_id""")
def feature_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features of every exposed pair under fixed names, 0.5 where one cannot be told."""
    e = table(spark, sf_dir, "user_exposure").select("user_id", "jd_no").distinct()
    n = actions(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    x = e.join(users(spark, sf_dir), "user_id", "left").join(jobs(spark, sf_dir), "jd_no", "left").join(n, "user_id", "left")
    degree = lambda c: P.coded(P.stripped(F.col(c)), P.DEGREES)
    own = {"city": F.col("live_city_id") == F.col("city"), "degree": degree("cur_degree_id") >= degree("min_edu_level"), "activity": F.least(F.lit(1.0), F.col("n") / 10)}
    return x.select("user_id", "jd_no", *[F.coalesce(c.cast("double"), F.lit(0.5)).alias(k) for k, c in own.items()])


@query()
def name_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of job types beside each different sub-type that are likelier than 0.8 the same; the names are a fixed table's, so each sub-type is read once."""
    names = [r[0] for r in table(spark, sf_dir, "ref_item").where("ref_kind = 'job_type'").select("ref_name").distinct().orderBy("ref_name").collect()]
    kinds = jobs(spark, sf_dir).where("jd_sub_type is not null").select("jd_sub_type").distinct()
    return kinds.select("jd_sub_type", F.inline(likely_names(names, 0.8)("jd_sub_type")))


_SAL = {n: _salary_sql(f"u.{c}", low) for n, c, low in (("min_desire", "desire_jd_salary_id", True), ("max_desire", "desire_jd_salary_id", False), ("min_cur", "cur_salary_id", True), ("max_cur", "cur_salary_id", False))}
_YEARS = "2019 - try_cast(case when u.start_work_date = '-' then null else u.start_work_date end as bigint)"


@query(f"""select e.user_id, e.jd_no, {', '.join(f"(coalesce({sql} <= j.{n[:3]}_salary, false))::int as {n}_le" for n, sql in _SAL.items())},
(coalesce({_CODES.format('u.cur_degree_id')} = {_CODES.format('j.min_edu_level')}, false))::int as same_edu,
(coalesce({_YEARS} > {_case('j.min_years', P.LEAST_YEARS)}, false))::int as over_least_years, (coalesce({_YEARS} > {_case('j.min_years', P.MOST_YEARS)}, false))::int as over_most_years
from {_EXP}""")
def compare_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a person's salary bounds lie within a job's, degrees are equal, and years exceed the asked ones; missing operands give 0."""
    x = _exposed(spark, sf_dir)
    out = {}
    for who, c in (("desire", "desire_jd_salary_id"), ("cur", "cur_salary_id")):
        for end in ("min", "max"):
            out[f"{end}_{who}_le"] = P.salary(F.col(c), end == "min") <= F.col(f"{end}_salary")
    out["same_edu"] = P.stripped(F.col("cur_degree_id")) == P.stripped(F.col("min_edu_level"))
    years = F.lit(2019) - F.nullif("start_work_date", F.lit("-")).try_cast("bigint")
    out["over_least_years"] = years > P.coded(F.col("min_years"), P.LEAST_YEARS)
    out["over_most_years"] = years > P.coded(F.col("min_years"), P.MOST_YEARS)
    return x.select("user_id", "jd_no", *[P.flag(c).cast("int").alias(n) for n, c in out.items()])


RESUME = ["experience", "desire_jd_industry_id", "desire_jd_type_id", "cur_industry_id", "cur_jd_type"]


@query(f"select user_id, {' || '.join(f'''coalesce({c}, 'nan') || ' ' ''' for c in RESUME)} as resume from {_USERS}")
def resume_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five fields as one text, each followed by a blank; missing ones read ``nan``."""
    parts = [x for c in RESUME for x in (F.coalesce(F.col(c).cast("string"), F.lit("nan")), F.lit(" "))]
    return users(spark, sf_dir).select("user_id", F.concat(*parts).alias("resume"))


@query(f"select jd_no, coalesce(jd_title, '未知职位') as jd_title, coalesce(job_description, '') as job_description from {_JOBS}")
def job_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs with a title and a description in any case."""
    return jobs(spark, sf_dir).select("jd_no", F.coalesce("jd_title", F.lit("未知职位")).alias("jd_title"), F.coalesce("job_description", F.lit("")).alias("job_description"))


def feature_columns(df: DataFrame, left_out: list[str], wanted: list[str] = ()) -> list[str]:
    """Columns to learn from: all but the keys, labels and raw texts of ``left_out``, then what is ``wanted`` and missing."""
    own = [c for c in df.columns if c not in left_out]
    return own + [c for c in wanted if c not in own]


def dimension_columns(columns: list[str], marks: dict[str, list[str]]) -> dict[str, list[str]]:
    """For each dimension the columns whose name holds one of its marks; a column may be of several."""
    return {d: [c for c in columns if any(m in c for m in ms)] for d, ms in marks.items()}


def importance_by_dimension(importance: DataFrame, dimensions: dict[str, list[str]], feature: str = "feature", value: str = "gain") -> DataFrame:
    """``dimension``, ``total``, ``share`` (of the importance of all features, 0 if that is 0)."""
    rows = [(d, c) for d, cs in dimensions.items() for c in cs]
    held = F.broadcast(importance.sparkSession.createDataFrame(rows, f"dimension string, {feature} string"))
    every = importance.agg(F.sum(value).alias("__all"))
    x = importance.join(held, feature).groupBy("dimension").agg(F.sum(value).alias("total"))
    return x.join(F.broadcast(every)).select("dimension", "total", F.coalesce(F.try_divide("total", "__all"), F.lit(0.0)).alias("share"))


def looked_up(df: DataFrame, key: str, value: Column | str | int) -> DataFrame:
    """The row of one key, at most one; the filter reaches the scan."""
    return df.where(F.col(key) == value).limit(1)


def sampled_keys(df: DataFrame, key: str, share: float, most: int, seed: int = 42) -> DataFrame:
    """``key``: a share of the different keys, at most ``most``, drawn without replacement by a hash with a seed."""
    own = df.select(key).where(F.col(key).isNotNull()).distinct()
    return own.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) < int(share * 1_000_000)).orderBy(F.xxhash64(F.lit(seed), key), key).limit(most)
