"""Readers and writers of delimited files.

Schemas are explicit where a caller knows them. Only header lines reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names under which foreign headers know a column.
USER_ALIASES = {
    "user_id": ["userid", "id", "user"], "experience": ["work_experience", "exp"],
    "desire_jd_industry_id": ["desire_industry", "industry_desired"], "desire_jd_type_id": ["desire_job_type", "job_type_desired"],
    "cur_industry_id": ["current_industry", "industry"], "cur_jd_type": ["current_job_type", "job_type"],
}
JOB_ALIASES = {
    "jd_no": ["jdno", "job_id", "jobid", "id"], "jd_title": ["job_title", "title", "position_name"],
    "job_description": ["description", "desc", "job_desc", "requirements"],
}


def first_line(spark: SparkSession, path: str) -> str:
    row = spark.read.text(path).first()
    return "" if row is None else row[0]


def sniffed_separator(header: str) -> str:
    """Tab or semicolon if it is strictly the most frequent in the header, else comma."""
    comma, tab, semi = (header.count(c) for c in ",\t;")
    if tab > comma and tab > semi:
        return "\t"
    return ";" if semi > comma and semi > tab else ","


def header_names(header: str, sep: str) -> list[str]:
    return [x.strip().strip('"').strip() for x in header.rstrip("\r\n").split(sep)]


def read_delimited(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str | None = None, skip_bad: bool = False) -> DataFrame:
    """A file with a header. Without a schema all columns are text; ``\\N`` is null; names lose blanks and quotes."""
    header = first_line(spark, path)
    sep = sniffed_separator(header) if sep is None else sep
    names = header_names(header, sep)
    schema = schema or T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", True).option("sep", sep).option("nullValue", "\\N")
    return reader.option("mode", "DROPMALFORMED" if skip_bad else "PERMISSIVE").csv(path)


def read_ragged(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """Lines of any number of fields: what is too much joins the last column, what lacks is empty. Quotes are text."""
    header = first_line(spark, path)
    sep = sniffed_separator(header) if sep is None else sep
    names = header_names(header, sep)
    lines = spark.read.text(path).where((F.col("value") != header) & (F.trim("value") != ""))
    parts = F.split("value", "\\Q" + sep + "\\E", len(names))
    return lines.select(parts.alias("p")).select(*[F.coalesce(F.get("p", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def split_merged(df: DataFrame, sep: str = "\t") -> DataFrame:
    """A frame of one column whose name and rows still hold ``sep``, as several columns."""
    if len(df.columns) != 1 or sep not in df.columns[0]:
        return df
    names = header_names(df.columns[0], sep)
    parts = F.split(df[df.columns[0]], "\\Q" + sep + "\\E", len(names))
    return df.select(parts.alias("p")).select(*[F.coalesce(F.get("p", F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def inferred_names(df: DataFrame) -> DataFrame:
    """Names ``job_description`` and ``jd_no`` by what the headers say, by place if they say nothing."""
    cols = df.columns
    pick = lambda words, other: next((c for c in cols if any(w in c.lower() for w in words)), other)
    text = "job_description" if "job_description" in cols else pick(["description", "desc"], cols[-1])
    key = "jd_no" if "jd_no" in cols else pick(["id", "no"], cols[0])
    out = df.withColumnRenamed(text, "job_description")
    return out if key == text else out.withColumnRenamed(key, "jd_no")


def resolved(df: DataFrame, aliases: dict[str, list[str]], required: list[str]) -> DataFrame:
    """Standard names for foreign ones, the first alias present; a missing required column raises an error."""
    lower = {c.lower(): c for c in reversed(df.columns)}
    renamed = {}
    for name, others in aliases.items():
        if name not in df.columns:
            found = next((lower[o] for o in others if o in lower and lower[o] not in renamed), None)
            if found is not None:
                renamed[found] = name
    out = df.withColumnsRenamed(renamed)
    missing = missing_columns(out, required)
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return out


def missing_columns(df: DataFrame, names: list[str]) -> list[str]:
    return [n for n in names if n not in df.columns]


def stop_words(spark: SparkSession, path: str) -> DataFrame:
    """One word per line, with the usual blanks added."""
    blanks = spark.createDataFrame([(c,) for c in ("\n", "\u00a0", "\u3000", "\u2002")], "word string")
    return spark.read.text(path).select(F.trim("value").alias("word")).where("word <> ''").union(blanks).distinct()


def write_pairs(ranked: DataFrame, path: str) -> None:
    """``user_id,jd_no`` in rank order, with a header."""
    ranked.orderBy("user_id", "rk").select("user_id", "jd_no").write.mode("overwrite").option("header", True).csv(path)


def write_top(importance: DataFrame, path: str, n: int | None = None) -> None:
    """Features by descending importance, all or the first ``n``."""
    out = importance.orderBy(F.desc("avg_imp"), "feature")
    (out if n is None else out.limit(n)).write.mode("overwrite").option("header", True).csv(path)
