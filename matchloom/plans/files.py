"""Round trips through delimited files and the text cache, in the shared folder of the session."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..session import checkpoint_dir, table
from ..sources import delimited
from ..sources.cache import TextCache
from . import chain, semantic
from .catalog import _JOBS, _USERS, jobs, rank_submission, users
from .registry import query

#: The separators of the files, and a header of foreign names.
SEPARATORS = {"comma": ",", "tab": "\t", "semicolon": ";"}
FOREIGN = {"user_id": "userid", "cur_jd_type": "job_type"}


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("\nunion all ".join(f"select '{n}' as file, user_id, nullif(cur_degree_id, '\\N') as cur_degree_id, nullif(start_work_date, '\\N') as start_work_date, nullif(cur_jd_type, '\\N') as cur_jd_type from {_USERS}" for n in SEPARATORS))
def delimited_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People written under three separators and read back: separators are told by the header, foreign names resolved, ``\\N`` is null."""
    u = users(spark, sf_dir).select("user_id", "cur_degree_id", "start_work_date", "cur_jd_type")
    out = []
    for name, sep in SEPARATORS.items():
        path = _folder(spark, f"people-{name}")
        own = u.withColumnsRenamed(FOREIGN) if name == "semicolon" else u
        own.write.options(header=True, sep=sep, nullValue="\\N", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
        got = delimited.resolved(delimited.read_delimited(spark, path), delimited.USER_ALIASES, ["user_id", "cur_jd_type"])
        out.append(got.select(F.lit(name).alias("file"), *u.columns))
    return reduce(DataFrame.unionByName, out)


@query("select distinct user_id, jd_no from user_exposure")
def submission_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranked pairs as the file that is handed in, read back."""
    path = _folder(spark, "submission")
    delimited.write_pairs(rank_submission(spark, sf_dir), path)
    return delimited.read_delimited(spark, path)


@query(f"select jd_no, md5(job_description) as key, coalesce(length(job_description), 0) as n from {_JOBS}")
def cached_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of descriptions through the cache: a wrong batch, a later right one, then what is missing; 0 for no text."""
    cache = TextCache(spark, _folder(spark, "cache"))
    j = jobs(spark, sf_dir).select("jd_no", "job_description")
    some = cache.misses(j.where("jd_no < '8'"), "job_description")
    cache.add(some.select("key", F.lit(-1).cast("bigint").alias("n")))
    for left in (some, cache.misses(j, "job_description")):
        cache.add(left.select("key", F.length("text").cast("bigint").alias("n")))
    return cache.attach(j, "job_description", {"n": 0}).select("jd_no", "key", F.col("n").cast("bigint").alias("n"))


_SUMS = "len(rs) + len(rf) + len(rt)"


@query(f"""with {semantic._R} select r.user_id, md5({' || '.join(f"coalesce(u.{c}, 'nan') || ' '" for c in chain.RESUME)}) as key, cast({_SUMS} as bigint) as triples,
cast((len(rs) > 0)::int + (len(rf) > 0)::int + (len(rt) > 0)::int as bigint) as relations, {semantic._tree_sql('rs', 'rf', 'rd')} as dimension from r join {_USERS} u on u.user_id = r.user_id""")
def semantic_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Models of people (triples, relations, tree) through the cache by the text of the resume; a text that is cached is not modelled again."""
    cache = TextCache(spark, _folder(spark, "models"))
    x = chain.resume_text(spark, sf_dir).join(semantic._resume(spark, sf_dir), "user_id")
    for part in ("user_id < '8'", "true"):
        lists = cache.keyed(x.where(part), "resume")
        new = lists.join(cache.misses(x.where(part), "resume").select("key"), "key", "left_semi").dropDuplicates(["key"])
        dims = semantic.default_dimensions({"技能": F.col("r_skill"), "行业领域": F.col("r_field"), "教育背景": F.col("r_degree")})
        rels = semantic._relations(semantic.SAID)
        objects = F.aggregate(rels, F.lit(0), lambda s, r: s + F.size(r["objects"]))
        cache.add(new.select("key", objects.cast("bigint").alias("triples"), F.size(rels).cast("bigint").alias("relations"), dims[0]["name"].alias("dimension")))
    return cache.attach(x.select("user_id", "resume"), "resume").drop("resume")


_COS = "list_cosine_similarity(list_transform({0}.embedding, lambda x: cast(x as double)), list_transform({1}.embedding, lambda x: cast(x as double)))"


@query(f"""select a.vec_id, round(case when b.vec_id is null or c.vec_id is null then 0.4e0 else 0.7e0 * {_COS.format('a', 'b')} + 0.3e0 * {_COS.format('a', 'c')} end, 5) as fit
from embeddings a left join embeddings b on b.vec_id = a.vec_id + 1 left join embeddings c on c.vec_id = a.vec_id + 2""")
def vector_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.7 and 0.3 of the likeness of each vector to the two after it, joined back to its row; 0.4 where one is missing."""
    v = table(spark, sf_dir, "embeddings")
    title, kind = (v.select((F.col("vec_id") - i).alias("vec_id"), F.col("embedding").alias(n)) for i, n in ((1, "title"), (2, "kind")))
    x = v.join(title, "vec_id", "left").join(kind, "vec_id", "left")
    fit = 0.7 * S.cosine(F.col("embedding"), F.col("title")) + 0.3 * S.cosine(F.col("embedding"), F.col("kind"))
    return x.select("vec_id", F.round(F.when(F.col("title").isNotNull() & F.col("kind").isNotNull(), fit).otherwise(0.4), 5).alias("fit"))
