"""Grouped cross-validation with out-of-fold predictions, importance, and reduced text vectors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.mllib.linalg import Vectors, VectorUDT
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing as P
from ..operators import joined, metrics, ranking
from ..session import checkpointed, table
from .catalog import ACTION_KEYS, actions, jobs, users
from .chain import feature_columns
from .registry import query

FEATURES = ["pair_n", "user_n", "job_n"]
#: The categorical features.
CATEGORIES = ["live_city_id", "city"]
#: Most different values of a categorical feature; beyond, values share so many codes by hash.
MOST_VALUES = 1000
#: Up to so many terms their products are held on the driver (8 bytes each).
GRAM = 2000


class FoldModels:
    """Boosted trees, one model a fold, each trained on the other folds.

    ``categorical`` features are told apart by value, null being one. With ``early`` the fold itself
    is the validation set that ends a model's rounds. The data is written once, the models are the driver's.
    """

    def __init__(self, df: DataFrame, label: str, features: list[str], fold: str, folds: int = 5, rounds: int = 1, categorical: list[str] = (), early: bool = False) -> None:
        self.df, self.label, self.fold = df, label, fold
        self.features, self.categorical = [*features, *categorical], list(categorical)
        self.columns = df.columns
        held = checkpointed(df)
        self.codes = {c: _codes(held, c) for c in self.categorical}
        self.data = checkpointed(self.assembled(held))
        bins = max([32, *(n + 1 for _, n in self.codes.values())])
        learner = GBTClassifier(featuresCol="__x", labelCol=label, maxIter=rounds, maxDepth=6, stepSize=0.1, featureSubsetStrategy="all", maxBins=bins, seed=1)
        if early:
            learner = learner.setValidationIndicatorCol("__held")
            learner.set(learner.validationTol, 0.001)
            self.models = [learner.fit(self.data.withColumn("__held", F.col(fold) == k)) for k in range(folds)]
        else:
            self.models = [learner.fit(self.data.where(F.col(fold) != k)) for k in range(folds)]

    def assembled(self, df: DataFrame) -> DataFrame:
        """``df`` with its feature vector; values of a category never seen are one more code."""
        x = df
        for c in self.categorical:
            table_, n = self.codes[c]
            code = F.pmod(F.xxhash64(c), F.lit(MOST_VALUES)).cast("double") if table_ is None else F.col("__code")
            if table_ is not None:
                x = x.join(F.broadcast(table_.withColumnRenamed("value", "__value")), F.col(c).cast("string") == F.col("__value"), "left").drop("__value")
            x = x.withColumn(f"__{c}", F.coalesce(code, F.lit(float(n)))).drop("__code")
        own = [f"__{c}" if c in self.categorical else c for c in self.features]
        out = VectorAssembler(inputCols=own, outputCol="__x", handleInvalid="keep").transform(x).drop(*[f"__{c}" for c in self.categorical])
        attrs = [NominalAttr(i, self.codes[c][1] + 1) if c in self.categorical else None for i, c in enumerate(self.features)]
        kinds = {"nominal": [a.json() for a in attrs if a], "numeric": [{"idx": i} for i, a in enumerate(attrs) if a is None]}
        meta = {"ml_attr": {"attrs": {k: xs for k, xs in kinds.items() if xs}, "num_attrs": len(attrs)}}
        return out.withMetadata("__x", meta) if self.categorical else out

    def out_of_fold(self) -> DataFrame:
        """The rows with ``pred`` from the model that has not seen their fold."""
        parts = [self._predicted(m, self.data.where(F.col(self.fold) == k)) for k, m in enumerate(self.models)]
        return reduce(DataFrame.unionByName, parts).select(*self.columns, "pred")

    def scored(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """``keys``, ``pred``: the mean of all fold models on new rows, weighted by each model's area under the curve on its fold."""
        own = checkpointed(self.assembled(df))
        parts = [self._predicted(m, own).select(*keys, F.lit(k).cast("bigint").alias(self.fold), "pred") for k, m in enumerate(self.models)]
        aucs = metrics.auc_by(self.out_of_fold(), self.fold, "pred", F.col(self.label)).fillna(0.5, ["auc"])
        return metrics.fold_mean(reduce(DataFrame.unionByName, parts), keys, self.fold, "pred", aucs.withColumnRenamed("auc", "weight"))

    @staticmethod
    def _predicted(model, df: DataFrame) -> DataFrame:
        return model.transform(df).withColumn("pred", vector_to_array("probability")[1])

    def importance(self) -> DataFrame:
        """``fold``, ``feature``, ``splits``, ``gain``."""
        rows = []
        for k, model in enumerate(self.models):
            used = [0] * len(self.features)
            for line in model.toDebugString.split("\n"):
                if "If (feature " in line:
                    used[int(line.split("feature ")[1].split(" ")[0])] += 1
            rows += [(k, f, used[i], float(model.featureImportances[i])) for i, f in enumerate(self.features)]
        return self.df.sparkSession.createDataFrame(rows, "fold int, feature string, splits int, gain double")


@dataclass
class NominalAttr:
    index: int
    values: int

    def json(self) -> dict:
        return {"idx": self.index, "vals": [str(i) for i in range(self.values)]}


def _codes(df: DataFrame, c: str) -> tuple[DataFrame | None, int]:
    """(``value``, ``__code`` of a category by falling count, number of codes); without a table where it has more than MOST_VALUES values."""
    counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("value")).agg(F.count("*").alias("n"))
    top = [r["value"] for r in counts.orderBy(F.desc("n"), "value").limit(MOST_VALUES + 1).collect()]
    if len(top) > MOST_VALUES:
        return None, MOST_VALUES
    return df.sparkSession.createDataFrame([(v, float(i)) for i, v in enumerate(top)], "value string, __code double"), len(top)


def _examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = actions(spark, sf_dir)
    p = a.groupBy("user_id", "jd_no").agg(F.count("*").alias("pair_n"), F.max(F.coalesce("delivered", F.lit(0))).alias("label"))
    u = p.groupBy("user_id").agg(F.sum("pair_n").alias("user_n"))
    j = p.groupBy("jd_no").agg(F.sum("pair_n").alias("job_n"))
    folds = ranking.dense_codes(p, "user_id", "fold").withColumn("fold", F.col("fold") % 5)
    return p.join(u, "user_id").join(j, "jd_no").join(folds, "user_id")


@query()
def gbt_oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FoldModels(_examples(spark, sf_dir), "label", FEATURES, "fold").out_of_fold().select("user_id", "jd_no", "fold", "pred")


@query()
def gbt_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    imp = FoldModels(_examples(spark, sf_dir), "label", FEATURES, "fold").importance()
    return imp.groupBy("feature").agg(F.avg("splits").alias("avg_splits"), F.avg("gain").alias("avg_gain"))


#: Columns that are no features: keys, label, fold, raw texts.
LEFT_OUT = ["user_id", "jd_no", "label", "fold", *CATEGORIES, "desire_jd_city_id", "desire_jd_salary_id", "cur_degree_id", "min_edu_level", "pair_n"]


def _described(spark: SparkSession, sf_dir: str, pairs: DataFrame) -> DataFrame:
    """Pairs with what is known of both sides: activity, salaries, degrees, years, and the categorical cities."""
    n = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(-1.0))
    u = users(spark, sf_dir)
    u = u.select(
        "user_id", "live_city_id", P.salary(F.col("desire_jd_salary_id"), True).alias("min_desire"), P.salary(F.col("desire_jd_salary_id"), False).alias("max_desire"),
        F.coalesce(P.coded(P.stripped(F.col("cur_degree_id")), P.DEGREES), F.lit(-1)).alias("degree"),
        F.coalesce(F.lit(2019) - F.nullif("start_work_date", F.lit("-")).try_cast("bigint"), F.lit(-1)).alias("years"), P.digits(F.col("desire_jd_city_id")).alias("__cities"),
    )
    j = jobs(spark, sf_dir).select("jd_no", "city", n("min_salary").alias("min_salary"), n("max_salary").alias("max_salary"), F.coalesce(P.coded(P.stripped(F.col("min_edu_level")), P.DEGREES), F.lit(-1)).alias("edu"))
    acted = actions(spark, sf_dir).groupBy("user_id", "jd_no").agg(F.count("*").alias("c"))
    of_users, of_jobs = (acted.groupBy(k).agg(F.sum("c").alias(f"{k[:4]}_n")) for k in ("user_id", "jd_no"))
    x = pairs.join(u, "user_id", "left").join(j, "jd_no", "left").join(of_users, "user_id", "left").join(of_jobs, "jd_no", "left")
    x = x.withColumns({"same_city": P.flag(F.col("live_city_id") == F.col("city")), "wanted_city": P.flag(F.array_contains("__cities", F.col("city").cast("string")))})
    return x.drop("__cities").fillna(0, ["user_n", "jd_n_n"]).fillna(-1, ["min_desire", "max_desire", "degree", "years", "min_salary", "max_salary", "edu"])


def _full(spark: SparkSession, sf_dir: str, rounds: int) -> FoldModels:
    p = _examples(spark, sf_dir).select("user_id", "jd_no", "label", "fold")
    x = _described(spark, sf_dir, p)
    return FoldModels(x, "label", feature_columns(x, LEFT_OUT), "fold", rounds=rounds, categorical=CATEGORIES, early=True)


@query()
def gbt_early(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of all features, categorical ones included, in models that stop when their own fold gains no more."""
    imp = _full(spark, sf_dir, 8).importance()
    return imp.groupBy("feature").agg(F.avg("splits").alias("avg_splits"), F.avg("gain").alias("avg_gain"))


@query()
def gbt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposed pairs by the joined fold models, ranked for each person."""
    e = table(spark, sf_dir, "user_exposure").select("user_id", "jd_no").distinct()
    got = _full(spark, sf_dir, 3).scored(_described(spark, sf_dir, e), ["user_id", "jd_no"])
    return ranking.positions(got, ["user_id"], [F.desc("pred"), F.col("jd_no")], "rk")


def _weighted(counts: DataFrame, docs: int, most: int | None) -> tuple[DataFrame, int]:
    """(``doc``, ``ix``, ``w``: the TF-IDF row of unit length of each document that has terms, number of terms)."""
    terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("c").alias("total"))
    if most is not None:
        terms = terms.orderBy(F.desc("total"), "term").limit(most)
    terms = ranking.running(terms, [F.col("term")], F.lit(1), "ix")
    terms = checkpointed(terms.select("term", (F.col("ix") - 1).cast("int").alias("ix"), (F.log((docs + 1) / (F.col("df") + 1)) + 1).alias("idf")))
    x = counts.join(terms, "term").groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("ix", (F.col("c") * F.col("idf")).alias("w")))).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, y: s + y["w"] * y["w"]))
    x = x.withColumn("norm", norm).select("doc", F.col("x.ix").alias("ix"), F.transform("x", lambda y: y["w"] / F.col("norm")).alias("w"))
    return checkpointed(x), terms.count()


def reduced(docs: DataFrame, counts: DataFrame, key: str, most: int | None = None, k: int = 10, gram: int = GRAM) -> DataFrame:
    """``key``, ``vector``: a truncated SVD of the TF-IDF rows of ``docs`` by ``counts`` (``doc``, ``term``, ``c``).

    ``most`` keeps the most frequent terms; without it the vocabulary has no bound. At most k
    numbers, fewer for fewer terms or documents; documents without terms get zeros. The largest
    entry of each direction is positive. Up to ``gram`` terms need one pass (products of terms on
    the driver), more a pass per step of the solver; the driver holds k numbers a term.
    """
    spark, docs = docs.sparkSession, checkpointed(docs.select(key).distinct())
    n_docs = docs.count()
    x, n = _weighted(counts, n_docs, most)
    k = min(k, n, n_docs)
    v = np.zeros((n, k))
    if k:
        vector = F.udf(lambda i, w: Vectors.sparse(n, i, w), VectorUDT())
        # Kept (on disk where memory is short), since the solver reads the rows in every step.
        held_rows = x.select(vector("ix", "w").alias("x")).persist()
        rows = RowMatrix(held_rows)
        found = np.linalg.eigh(rows.computeGramianMatrix().toArray())[1][:, ::-1][:, :k] if n <= gram else rows.computeSVD(k).V.toArray()
        held_rows.unpersist()
        v[:, : found.shape[1]] = found * np.where(found[np.abs(found).argmax(0), np.arange(found.shape[1])] < 0, -1, 1)
    held = spark.sparkContext.broadcast(v)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.column("ix").offsets.to_numpy()
            i, w = (b.column(c).values.to_numpy() for c in ("ix", "w"))
            out = [w[lo:hi] @ held.value[i[lo:hi]] for lo, hi in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(out, pa.list_(pa.float64()))], ["doc", "vector"])

    got = x.mapInArrow(project, f"doc {dict(x.dtypes)['doc']}, vector array<double>")
    return docs.join(got, docs[key] == got["doc"], "left").select(key, F.coalesce("vector", F.array_repeat(F.lit(0.0), k)).alias("vector"))


@query()
def tfidf_reduced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten components of the TF-IDF vectors of job descriptions, by the 1,000 most frequent words and pairs of words."""
    j = jobs(spark, sf_dir).select("jd_no", P.words(F.coalesce("job_description", F.lit(""))).alias("w"))
    counts = j.select(F.col("jd_no").alias("doc"), F.explode(F.concat("w", P.word_pairs(F.col("w")))).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("c"))
    return reduced(j, counts, "jd_no", most=1000)


@query()
def tfidf_experience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten components of the TF-IDF vectors of the joined experiences of each job's people, by all words and pairs of words.

    People of the actions on known jobs come first, then those of the exposures, each by
    ``user_id``; the pair of words where two experiences meet counts too. The joined text is
    never built.
    """
    acted = actions(spark, sf_dir).select("user_id", "jd_no")
    shown = table(spark, sf_dir, "user_exposure").where(ACTION_KEYS).select("user_id", "jd_no")
    named = jobs(spark, sf_dir).where("jd_no is not null").select("jd_no", F.lit(True).alias("known")).union(shown.select("jd_no", F.lit(False)))
    docs = ranking.running(named.groupBy("jd_no").agg(F.max("known").alias("known")), [F.col("jd_no")], F.lit(1), "doc")
    docs = checkpointed(docs.select("jd_no", "known", (F.col("doc") - 1).cast("int").alias("doc")))
    people = checkpointed(ranking.dense_codes(acted.select("user_id").union(shown.select("user_id")), "user_id", "uid").select("user_id", F.col("uid").cast("int").alias("uid")))
    words = users(spark, sf_dir).select("user_id", P.words(F.coalesce("experience", F.lit("nan"))).alias("words"))
    own = joined.members(people.join(words, "user_id", "left").select("uid", F.coalesce("words", F.array(F.lit("nan"))).alias("words")))
    p = acted.join(docs.where("known"), "jd_no").select("doc", "user_id", F.lit(0).alias("part"))
    p = p.union(shown.join(docs, "jd_no").select("doc", "user_id", F.lit(1).alias("part"))).join(people, "user_id").select("doc", "part", "uid")
    found = joined.Joined(p, docs.count(), own, acted.count() + shown.count())
    held = spark.sparkContext.broadcast((found.present, found.reduced(10)))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present, vectors = held.value
        for b in batches:
            b = b.filter(pa.array(present[b.column("doc").to_numpy()]))
            yield pa.RecordBatch.from_arrays([b.column("jd_no"), pa.array(list(vectors[b.column("doc").to_numpy()]), pa.list_(pa.float64()))], ["jd_no", "vector"])

    return docs.select("jd_no", "doc").mapInArrow(looked_up, "jd_no string, vector array<double>")
