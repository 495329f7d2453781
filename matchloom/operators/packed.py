"""Several values packed in one field (problem 6).

The separators of each field (a source) are inferred from its whole column. Every candidate mark gets
two scores between 0 and 1. Piece-count consistency: how many of the pieces of the rows that hold the
mark it cuts by itself. Piece type regularity: how many of the pieces beside it are values, which
stand beside ever other pieces, and not fragments of a name, whose other part is always the same. Both
are shares, so they do not move as a table grows. Fields of digit runs take
every mark. Splitting and positions stay on the JVM side.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks that may separate values, each with its other forms; marks of an absent field;
# brackets that may stand around a list.
MARKS = {"|": "|｜", ";": ";；", "\t": "\t", "\n": "\n\r", ",": ",，、", "/": "/", "-": "-", " ": " "}
NOTHING = ["", "-", "\\N"]
BRACKETS = ["[]", "()", "{}"]
#: Regularity taken for granted of a mark before anything is seen, weighing as much as WEIGHT
#: observations: slashes, hyphens and blanks stand in words and names, the other marks do not.
PRIOR = {m: 0.1 if m in "/- " else 0.9 for m in MARKS}
WEIGHT = 10
#: A mark separates from this product of both scores on. Names stay below 0.05, separators above 0.3.
LEAST_SCORE = 0.15
#: Sizes of the sketch of neighbouring pieces: left pieces, and right pieces of each.
LEFTS, RIGHTS = 1024, 64

#: All blanks: ASCII white space and the Unicode separators.
_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
BLANKS = " \t\n\x0b\f\r" + _SPACES
_QUOTED = r'''"[^"]*+(?:""[^"]*+)*+"'''


def _cls(chars: list[str]) -> str:
    return "".join("\\" + c if re.match(r"[\[\]\\^\-|&]", c) else {"\t": r"\t", "\n": r"\n\r"}.get(c, c) for c in chars)


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def _bare(t: Column) -> Column:
    """A trimmed text without the brackets around it; null where it says nothing. ``t`` is used often, so it should be a column."""
    inner = F.substr(t, F.lit(2), F.length(t) - 2)
    out = F.when(~t.isin(*NOTHING), t)
    for a, z in BRACKETS:
        out = F.when(t.startswith(a) & t.endswith(z) & (F.length(t) > 1) & ~inner.contains(a) & ~inner.contains(z), inner).otherwise(out)
    return out


def separator_scores(df: DataFrame, fields: list[str]) -> DataFrame:
    """One row per field and mark found in it: ``field_name``, ``sep``, ``gaps``, ``alone``, ``seen``, ``varied``, ``digit_gaps``.

    A gap is a run of marks between two pieces; its first mark that is no blank counts, wide forms as
    their plain ones, and quoted text is one piece. ``alone / gaps`` is the piece-count consistency: over
    all gaps of the mark, the mean share of the gaps of the row that are of the mark. ``varied / seen``
    is the piece type regularity: the chance that a left piece met twice has different right pieces,
    averaged over left pieces by the root of their occurrences (``seen`` is that evidence, none where no
    left piece is met twice), so that neither rare noise nor one text that a third of all rows copy decides. ``digit_gaps`` have digits on both sides. Pieces are counted in a sketch of signed
    sums, LEFTS x RIGHTS cells per field and mark however large the table; cells hold several pieces
    without bias.
    """
    plain = "".join(m * (len(forms) - 1) for m, forms in MARKS.items()) + " " * len(_SPACES)
    other = "".join(forms.replace(m, "", 1) for m, forms in MARKS.items()) + _SPACES
    gap = rf" *+([{_cls([m for m in MARKS if m != ' '])}])[{_cls(list(MARKS))}]*+| ++"
    long = df.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).cast("string").alias("v")) for f in fields])).alias("x"))
    # One step a select, and no filter before or from the generators (outer ones infer none): an expression
    # that is used more than once would be computed as often.
    long = long.select("x.field_name", _trim(F.col("x.v")).alias("v")).select("field_name", _bare(F.col("v")).alias("v"))
    long = long.select("field_name", F.when(F.col("v").contains('"'), F.regexp_replace("v", _QUOTED, "\u0001")).otherwise(F.col("v")).alias("v"))
    long = long.select("field_name", F.btrim(F.translate("v", other, plain), F.lit("".join(MARKS))).alias("v"))
    rows = long.select("field_name", "v", F.regexp_extract_all("v", F.lit(gap)).alias("g"))
    rows = rows.select("field_name", F.split("v", gap).alias("p"), "g", F.array_join("g", "").alias("j"))
    counts = [F.length("j") - F.length(F.replace("j", F.lit(m), F.lit(""))) if m != " " else F.size("g") - F.length("j") for m in MARKS]
    rows = rows.select("field_name", "p", "g", *[n.alias(f"n{i}") for i, n in enumerate(counts)])
    own = F.coalesce(*[F.when(F.col("sep") == m, F.col(f"n{i}")) for i, m in enumerate(MARKS)])
    gaps = rows.select("*", F.posexplode_outer("g").alias("at", "sep")).where("at is not null").withColumn("sep", F.when(F.col("sep") == "", " ").otherwise(F.col("sep")))
    gaps = gaps.select("field_name", "sep", (own / F.size("g")).alias("share"), F.get("p", F.col("at")).alias("l"), F.get("p", F.col("at") + 1).alias("r"))
    left, both = F.xxhash64("l"), F.xxhash64("l", "r")
    sign = lambda h: 1 - 2 * F.shiftrightunsigned(h, 63)
    number = r"^'?\p{Nd}+'?$"
    cells = (
        gaps.groupBy("field_name", "sep", F.pmod(left, F.lit(LEFTS)).alias("a"), F.pmod(both, F.lit(RIGHTS)).alias("b"))
        .agg(F.count("*").alias("n"), F.sum(sign(left)).alias("x"), F.sum(sign(both)).alias("y"), F.sum("share").alias("alone"),
             F.sum((F.col("l").rlike(number) & F.col("r").rlike(number)).cast("int")).alias("digit_gaps"))
    )
    lefts = cells.groupBy("field_name", "sep", "a").agg(
        F.sum("n").cast("double").alias("n"), F.pow(F.sum("x"), 2).alias("x"), F.sum(F.pow("y", 2)).alias("y"), F.sum("alone").alias("alone"), F.sum("digit_gaps").alias("digit_gaps")
    )
    return lefts.groupBy("field_name", "sep").agg(
        F.sum("n").cast("bigint").alias("gaps"), F.sum("alone").alias("alone"),
        F.sum((F.col("x") - F.col("n")) / F.pow("n", 1.5)).alias("seen"), F.sum((F.col("x") - F.col("y")) / F.pow("n", 1.5)).alias("varied"),
        F.sum("digit_gaps").alias("digit_gaps"),
    )


@dataclass
class Evidence:
    gaps: float = 0.0
    alone: float = 0.0
    seen: float = 0.0
    varied: float = 0.0

    def scores(self, consistency: float, regularity: float) -> tuple[float, float]:
        """Both scores; what is given beforehand weighs as much as WEIGHT observations."""
        c = (self.alone + WEIGHT * consistency) / (self.gaps + WEIGHT)
        t = (max(self.varied, 0.0) + WEIGHT * regularity) / (max(self.seen, self.varied, 0.0) + WEIGHT)
        return min(c, 1.0), min(t, 1.0)


def infer_separators(df: DataFrame, fields: list[str]) -> dict[str, list[str] | None]:
    """Separators of each field, or None for a field of digit runs.

    A mark separates the values of a field if the product of its two scores reaches LEAST_SCORE. What
    the fields other than digit runs say together about the mark, and before that PRIOR, counts like
    WEIGHT observations, so a mark that a small table hardly shows is judged alike. There is no
    switch by size. Only fields x marks rows reach the driver.
    """
    by_field: dict[str, dict[str, Evidence]] = {f: {} for f in fields}
    digits = dict.fromkeys(fields, 0)
    for r in separator_scores(df, fields).collect():
        by_field[r["field_name"]][r["sep"]] = Evidence(r["gaps"], r["alone"], r["seen"], r["varied"])
        digits[r["field_name"]] += r["digit_gaps"]
    texts = [f for f in fields if not by_field[f] or digits[f] < 0.8 * sum(e.gaps for e in by_field[f].values())]
    out: dict[str, list[str] | None] = dict.fromkeys(fields)
    for f in texts:
        out[f] = []
    for m, forms in MARKS.items():
        own = {f: by_field[f].get(m, Evidence()) for f in texts}
        every = Evidence(*(sum(getattr(e, x) for e in own.values()) for x in ("gaps", "alone", "seen", "varied")))
        for f, e in own.items():
            c, t = e.scores(*every.scores(1.0, PRIOR[m]))
            if c * t >= LEAST_SCORE:
                out[f] += forms.replace("\r", "")
    return out


def split_values(c: Column, seps: list[str] | None) -> Column:
    """The values of a packed text in order, as an array; null and "nothing" give an empty array."""
    empty = F.array().cast("array<string>")
    if seps is None:
        return F.when(_trim(c).isin(*NOTHING), empty).otherwise(F.coalesce(F.regexp_extract_all(c, F.lit(r"(\p{Nd}+)"), F.lit(1)), empty))
    d = _cls(seps)
    b = rf"[\s\p{{Z}}&&[^{d}]]"
    single = r"'[^']*+(?:''[^']*+)*+'"
    item = rf"{b}*({_QUOTED}|{single}|[^{d}]*){b}*(?:[{d}]|$)"

    def clean(x: Column) -> Column:
        t = _trim(x)
        inside = F.substr(t, F.lit(2), F.length(t) - 2)
        out = t
        for q in ("'", '"'):
            whole = t.startswith(q) & t.endswith(q) & (F.length(t) >= 2)
            out = F.when(whole, _trim(F.replace(inside, F.lit(q + q), F.lit(q)))).otherwise(out)
        return out

    def pieces(t: Column) -> Column:
        quoted = F.transform(F.regexp_extract_all(t, F.lit(item), F.lit(1)), clean)
        plain = F.transform(F.split(t, f"[{d}]"), _trim)
        return F.filter(F.when(t.contains('"') | t.contains("'"), quoted).otherwise(plain), lambda x: x != "")

    # Bound as variables of a one-item array, so that each step is computed once.
    bare = F.transform(F.transform(F.array(c), _trim), _bare)
    return F.coalesce(F.get(F.transform(bare, pieces), F.lit(0)), empty)


def packed_items(df: DataFrame, key: str, fields: list[str], seps: dict[str, list[str] | None] | None = None) -> DataFrame:
    """``__key``, ``field_name``, ``items``: the array of values of each field, one row per field and different row of the named columns.

    Rows without a key are left out. A text of any length is split whole.
    """
    names = {f: f"__f{i}" for i, f in enumerate(fields)}
    own = df.select(F.col(key).alias("__key"), *[F.col(f).cast("string").alias(n) for f, n in names.items()]).where("__key is not null")
    seps = infer_separators(own.select(*[F.col(n).alias(f) for f, n in names.items()]), fields) if seps is None else seps
    cells = [F.struct(F.lit(f).alias("field_name"), split_values(F.col(n), seps[f]).alias("items")) for f, n in names.items()]
    return own.dropDuplicates().select("__key", F.explode(F.array(*cells)).alias("x")).select("__key", "x.field_name", "x.items")


def explode_packed(df: DataFrame, key: str, fields: list[str], seps: dict[str, list[str] | None] | None = None) -> DataFrame:
    """``key``, ``field_name``, ``pos`` (from 1), ``item``: one row per value of each field.

    Repeated rows of a key with the same values count once; repeats within a field are kept.
    Null, blank and "nothing" fields, and an empty table, give no rows; rows without a key are
    left out. A text of any length is split whole. Only named columns are read.
    """
    long = packed_items(df, key, fields, seps).select("__key", "field_name", F.posexplode_outer("items").alias("p", "item")).where("p is not null")
    return long.select(F.col("__key").alias(key), "field_name", (F.col("p") + 1).cast("bigint").alias("pos"), "item")
