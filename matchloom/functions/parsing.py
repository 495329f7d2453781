"""Column functions for codes, dates and delimited texts. Null in gives null out unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Salary code length before the digits of its lower bound; degree and year codes.
SALARY_SPLIT = {12: 6, 11: 5, 10: 5, 9: 4}
DEGREES = {"其他": 0, "初中": 1, "中技": 2, "中专": 2, "高中": 2, "大专": 3, "本科": 4, "硕士": 5, "MBA": 5, "EMBA": 5, "博士": 6}
LEAST_YEARS = {103: 1, 305: 3, 510: 5, 1099: 10}
MOST_YEARS = {103: 3, 305: 5, 510: 10}


def salary(c: Column, low: bool) -> Column:
    """Lower or upper bound of a salary code of 9 to 12 digits; -1 for anything else and for null."""
    out = F.lit(None).cast("bigint")
    for n, cut in SALARY_SPLIT.items():
        part = F.substring(c, 1, cut) if low else F.substring(c, cut + 1, n - cut)
        out = F.when(F.length(c) == n, part.try_cast("bigint")).otherwise(out)
    return F.coalesce(out, F.lit(-1).cast("bigint"))


def coded(c: Column, codes: dict) -> Column:
    """The value of a code; null for unknown codes."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in codes.items() for x in kv]), c)


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def digits(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0))


def day(c: Column) -> Column:
    """yyyymmdd as a date; null for impossible days."""
    return F.try_to_date(c, "yyyyMMdd")


def parts_count(c: Column, sep: str) -> Column:
    return F.size(F.split(c, sep)).cast("bigint")


def contained(a: Column, b: Column) -> Column:
    """1 if a stands in b, else 0; -1 if either is missing."""
    return F.when(a.isNull() | b.isNull(), F.lit(-1)).otherwise(b.contains(a).cast("int")).cast("bigint")


def flag(c: Column) -> Column:
    """Comparisons with missing operands are false."""
    return F.coalesce(c, F.lit(False)).cast("int").cast("bigint")


def cleaned(c: Column) -> Column:
    """Line breaks, real or written, and runs of blanks become one blank; missing becomes empty."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\n"), F.lit(" ")), r"\s+", " "))


def tokens(c: Column) -> Column:
    """Different lower-case words of more than one character, in order."""
    return F.array_distinct(words(c))


def words(c: Column) -> Column:
    """Lower-case words of more than one character, in order, repeats kept."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: F.length(x) > 1)


def segmented(c: Column, stop: list[str] = ()) -> Column:
    """Lower-case words of more than one character in order, repeats kept; a run of more than two ideographs gives its overlapping pairs.

    Words of ``stop`` are left out. Pairs stand in for a dictionary of Chinese words, of which most have two
    ideographs, and depend on no model.
    """
    runs = F.split(F.regexp_replace(F.lower(c), r"(\p{IsHan}+)", " $1 "), r"[^\p{L}\p{N}]+")
    pairs = lambda r: F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2)))
    words_ = F.flatten(F.transform(runs, lambda r: F.when((F.length(r) > 2) & r.rlike(r"^\p{IsHan}"), pairs(r)).otherwise(F.array(r))))
    return F.filter(words_, lambda x: (F.length(x) > 1) & ~x.isin(*stop) if stop else F.length(x) > 1)


def word_pairs(w: Column) -> Column:
    """Neighbouring words of an array, joined by a blank."""
    n = F.size(w) - 1
    return F.when(n > 0, F.zip_with(F.slice(w, F.lit(1), n), F.slice(w, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def families(c: Column) -> Column:
    """The two-character families of the parts of a comma list."""
    return F.transform(F.filter(F.split(c, ","), lambda x: F.length(x) >= 2), lambda x: F.substring(x, 1, 2))


def keywords(c: Column) -> Column:
    return F.filter(tokens(c), lambda x: ~x.rlike("[0-9]"))


def ladder(a: Column, b: Column) -> Column:
    """Likeness of two names: 1 if equal, 0.7 if one holds the other, else the common words as a share of all."""
    x, y = F.lower(a), F.lower(b)
    p, q = F.array_distinct(F.split(x, r"\s+")), F.array_distinct(F.split(y, r"\s+"))
    common = F.size(F.array_intersect(p, q)) / F.greatest(F.size(F.array_union(p, q)), F.lit(1))
    return F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.7).when(_several_words(x) & _several_words(y), common).otherwise(0.0)


def _several_words(c: Column) -> Column:
    """Names neither of which holds the other can share a word only if both have blanks."""
    return c.rlike(r"\s")


def word_share(a: Column, b: Column) -> Column:
    """Common words of two texts as a share of the larger set of words; 0 where either has none or is missing."""
    p, q = (F.array_remove(F.array_distinct(F.split(F.lower(x), r"\s+")), "") for x in (a, b))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(p, q)), F.greatest(F.size(p), F.size(q))), F.lit(0.0))


def name_likeness(a: Column, b: Column) -> Column:
    """As ``ladder``, with the common words as a share of the larger set of words, which is the surveyed rule."""
    x, y = F.lower(a), F.lower(b)
    return F.when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.7).when(_several_words(x) & _several_words(y), word_share(a, b)).otherwise(0.0)
