"""Text scores on segmented words: ideographs in pairs, stop words left out, lists split as inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..operators import packed
from ..session import table
from . import dealt
from .catalog import _EXP_ALL, _JOBS, _USERS, _likeness, jobs, users
from .registry import query

#: Stop words of the queries below; operators take any list.
STOP = "以及 我们 你们 他们 没有 可以 需要 进行 具有 the and for with are you our this that from will can und der die das mit für les des une pour avec los las del para con que com não por".split()
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP) + "]"


def _seg(t: str, stop: bool = True) -> str:
    runs = rf"string_split_regex(regexp_replace(lower({t}), '(\p{{Han}}+)', ' \1 ', 'g'), '[^\p{{L}}\p{{N}}]+')"
    pairs = r"case when length(r) > 2 and regexp_matches(r, '^\p{Han}') then list_transform(range(1, length(r)), lambda i: substr(r, i, 2)) else [r] end"
    kept = f" and not list_contains({_STOP}, x)" if stop else ""
    return f"list_filter(flatten(list_transform({runs}, lambda r: {pairs})), lambda x: length(x) > 1{kept})"


@query(f"select jd_no, array_to_string({_seg('job_description')}, ' ') as words from {_JOBS} where job_description is not null")
def segmented_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions as their words, joined by blanks."""
    return jobs(spark, sf_dir).where("job_description is not null").select("jd_no", F.array_join(P.segmented(F.col("job_description"), STOP), " ").alias("words"))


@query(f"""with t as (select e.user_id, e.jd_no, coalesce(list_distinct({_seg('u.experience')}), []) as a, coalesce(list_distinct({_seg('j.job_description')}), []) as b from {_EXP_ALL}),
j as (select user_id, jd_no, len(list_intersect(a, b)) as i, len(a) as n1, len(b) as n2 from t),
s as (select *, case when n1 + n2 - i > 0 then i / (n1 + n2 - i) else 0 end as jac,
  case when n1 > 0 and n2 > 0 then i / sqrt((i + (1 + ln(1.5e0)) ^ 2 * (n1 - i)) * (i + (1 + ln(1.5e0)) ^ 2 * (n2 - i))) else 0 end as cos from j)
select user_id, jd_no, i as common, round(jac, 6) as jac, round(0.4e0 * jac + 0.4e0 * case when jac > 0.1e0 then cos else 0 end
  + 0.2e0 * case when greatest(n1, n2) > 0 then i / greatest(n1, n2) else 0 end, 6) as likeness from s""")
def segmented_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeness of experience and description of every exposed pair; 0 where either has no words. Words are cut once a side."""
    words = lambda c: F.coalesce(F.array_distinct(P.segmented(F.col(c), STOP)), F.array().cast("array<string>"))
    u = users(spark, sf_dir).select("user_id", words("experience").alias("a"))
    j = jobs(spark, sf_dir).select("jd_no", words("job_description").alias("b"))
    x = table(spark, sf_dir, "user_exposure").select("user_id", "jd_no").distinct().join(u, "user_id", "left").join(j, "jd_no", "left")
    return _likeness(x.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in "ab"}))


def quality(segments: Column, wanted: Column) -> Column:
    """How well the parts of an experience (``s`` text, ``t`` words) meet the wanted words; earlier parts weigh more, by 0.8 a step.

    A part scores its hits by the root of its words, 1.2 times that if it holds a key word (any wanted one without
    digits, or, if all have digits, any wanted one), 1 at most; a part without words scores 0.
    """
    plain = F.filter(wanted, lambda w: ~w.rlike("[0-9]"))
    keys = F.when(F.size(plain) > 0, plain).otherwise(wanted)

    def one(x: Column) -> Column:
        hits = F.size(F.array_intersect(x["t"], wanted)) / F.sqrt(F.size(x["t"]).cast("double"))
        return F.when(F.size(x["t"]) == 0, 0.0).otherwise(F.least(F.lit(1.0), hits * F.when(F.exists(keys, lambda k: x["s"].contains(k)), 1.2).otherwise(1.0)))

    total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)
    weight = lambda i: F.pow(F.lit(0.8), i)
    return F.coalesce(F.try_divide(total(F.transform(segments, lambda x, i: one(x) * weight(i))), total(F.transform(segments, lambda x, i: weight(i)))), F.lit(0.0))


_W = _seg("concat_ws(' ', j.jd_title, j.jd_sub_type)", False)
_T = f"list_distinct({_seg('s', False)})"


@query(f"""with v as ({dealt.SQL['p6_found']}), l as (select user_id, list(lower(item) order by pos) as segs from v where field_name = 'experience' group by 1),
t as (select e.user_id, e.jd_no, case when j.jd_title is not null then coalesce(l.segs, []) else [] end as segs, coalesce(list_distinct({_W}), []) as w
 from (select distinct user_id, jd_no from user_exposure) e left join l on l.user_id = e.user_id left join {_JOBS} j on j.jd_no = e.jd_no),
k as (select *, case when len(list_filter(w, lambda x: not regexp_matches(x, '[0-9]'))) > 0 then list_filter(w, lambda x: not regexp_matches(x, '[0-9]')) else w end as kw from t),
q as (select *, list_transform(segs, lambda s, i: pow(0.8e0, i - 1)) as ws, list_transform(segs, lambda s: case when len({_T}) = 0 then 0e0
  else least(1e0, len(list_intersect({_T}, w)) / sqrt(len({_T})) * case when len(list_filter(kw, lambda k: contains(s, k))) > 0 then 1.2e0 else 1e0 end) end) as q from k)
select user_id, jd_no, case when len(segs) = 0 then 0e0 else round(list_sum(list_transform(q, lambda x, i: x * ws[i])) / list_sum(ws), 6) end as quality from q""")
def segmented_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every exposed pair's experience by its values; 0 where the experience or the title is missing."""
    seps = packed.infer_separators(table(spark, sf_dir, "table1_user"), dealt.LISTS)["experience"]
    parts = F.transform(packed.split_values(F.col("experience"), seps), lambda s: F.struct(F.lower(s).alias("s"), F.array_distinct(P.segmented(s)).alias("t")))
    u = users(spark, sf_dir).select("user_id", parts.alias("segs"))
    wanted = F.array_distinct(P.segmented(F.concat_ws(" ", "jd_title", "jd_sub_type")))
    j = jobs(spark, sf_dir).where("jd_title is not null").select("jd_no", wanted.alias("w"))
    e = table(spark, sf_dir, "user_exposure").select("user_id", "jd_no").distinct()
    x = e.join(u, "user_id", "left").join(j, "jd_no", "left")
    own = F.when(F.col("segs").isNotNull() & F.col("w").isNotNull(), quality(F.col("segs"), F.col("w"))).otherwise(0.0)
    return x.select("user_id", "jd_no", F.round(own, 6).alias("quality"))


@query(f"""with t as (select jd_no, unnest(list_distinct({_seg('jd_title')})) as term from {_JOBS}), n as (select count(*) as n from {_JOBS} where jd_title is not null),
d as (select term, count(*) as df from t group by 1), w as (select jd_no, term, ln((1 + n) / (1 + df)) + 1 as w from t join d using (term), n)
select jd_no, term, round(w / sqrt(sum(w * w) over (partition by jd_no)), 6) as weight from w""")
def segmented_tfidf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF weights of the different words of titles, each title's of unit length."""
    t = jobs(spark, sf_dir).where("jd_title is not null").select("jd_no", F.array_distinct(P.segmented(F.col("jd_title"), STOP)).alias("ts"))
    n = t.count()
    rows = t.select("jd_no", F.explode("ts").alias("term"))
    d = rows.groupBy("term").agg((F.log((1 + n) / (1 + F.count("*"))) + 1).alias("idf"))
    x = rows.join(d, "term").groupBy("jd_no").agg(F.collect_list(F.struct("term", "idf")).alias("x"), F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    return x.select("jd_no", "norm", F.explode("x").alias("x")).select("jd_no", "x.term", F.round(F.col("x.idf") / F.col("norm"), 6).alias("weight"))
