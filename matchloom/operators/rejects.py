"""Loading of delimited lines that may break the format (problem 3).

Blocks of lines go through a columnar path: one syntax match, one bulk CSV parse and vectorised value
checks, which each tell their failing lines apart. A block that the bulk parse refuses is halved
again and again until the record at fault stands alone; every isolated line, and no other, is then
scanned strictly to name the reason.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pv
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The columns of a line, in order.
COLUMNS = [
    "jd_no", "jd_title", "jd_sub_type", "city", "min_salary", "max_salary", "min_years",
    "min_edu_level", "start_date", "end_date", "job_description",
]
NUMBERS = ["city", "min_salary", "max_salary", "min_years"]
DATES = ["start_date", "end_date"]
TITLES = ["jd_title", "jd_sub_type"]
BLOCK, BLOCK_BYTES = 4096, 1 << 28

_FIELD = r'(?:"(?:[^"]|"")*"|[^"\t\r\n]*)'
#: A whole line in the columnar path: no line break outside quotes, so lines can be joined.
_LINE = rf"^{_FIELD}(?:\t{_FIELD}){{{len(COLUMNS) - 1}}}$"
_BAD_CHARS = "[\\x{FFFD}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{9F}]"
_OUT = pa.schema(
    [("line_no", pa.int64()), *((c, pa.string()) for c in COLUMNS), ("reason", pa.string())]
)


def _matches(values: pa.Array, pattern: str) -> pa.Array:
    """Where a value is null or matches."""
    return pc.fill_null(pc.match_substring_regex(values, pattern), True)


def _real_days(values: pa.Array) -> pa.Array:
    """Where a value is null or a real day as yyyymmdd."""
    shaped = _matches(values, "^[0-9]{8}$")
    n = pc.fill_null(pc.if_else(shaped, values, "19700101"), "19700101").cast(pa.int64()).to_numpy()
    y, m, d = n // 10000, n // 100 % 100, n % 100
    leap = (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0))
    last = np.array([0, 31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 0, 12)]
    last = last + (leap & (m == 2))
    return pc.and_(shaped, pa.array((y > 0) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= last)))


def _parsed(text: pa.Array) -> pa.Table | None:
    """A block of lines of right syntax, bulk-parsed; None if the parse fails or gives another number of rows."""
    data = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(text)], pa.int32()), text), "\n")[0].as_buffer()
    try:
        got = pv.read_csv(
            pa.BufferReader(data),
            pv.ReadOptions(column_names=COLUMNS, use_threads=False, block_size=data.size + 1),
            pv.ParseOptions(delimiter="\t", quote_char='"', double_quote=True, newlines_in_values=True),
            pv.ConvertOptions(
                column_types=dict.fromkeys(COLUMNS, pa.string()), null_values=["", "\\N"],
                strings_can_be_null=True, quoted_strings_can_be_null=True,
            ),
        )
    except pa.ArrowInvalid:
        return None
    return got.combine_chunks() if got.num_rows == len(text) else None


def _valid(got: pa.Table) -> pa.Array:
    """Where all values of a parsed line are valid."""
    col = lambda c: got[c].chunk(0) if got[c].num_chunks else pa.array([], pa.string())
    ok = pc.and_(pc.is_valid(col("jd_no")), _matches(col("jd_no"), "^[0-9a-f]{32}$"))
    for c in TITLES:
        said = pc.fill_null(pc.not_equal(pc.utf8_trim_whitespace(col(c)), ""), False)
        ok = pc.and_(ok, pc.and_(said, pc.invert(pc.fill_null(pc.match_substring_regex(col(c), _BAD_CHARS), False))))
    for c in NUMBERS:
        ok = pc.and_(ok, _matches(col(c), "^-?[0-9]+$"))
    for c in DATES:
        ok = pc.and_(ok, _real_days(col(c)))
    return ok


_STRICT_FIELD = re.compile(r'"((?:[^"]|"")*)"(?=\t|\Z)|([^"\t]*)(?=\t|\Z)')
_CONTROL = re.compile("[\x00-\x1f\x7f-\x9f]")
_CONTROL_QUOTED = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")


_ID, _NUMBER, _DAY = (re.compile(x).fullmatch for x in ("[0-9a-f]{32}", "-?[0-9]+", "[0-9]{8}"))


def _real_day(v: str) -> bool:
    if not _DAY(v):
        return False
    y, m, d = int(v[:4]), int(v[4:6]), int(v[6:])
    return y > 0 and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]


def diagnose(line: str | None) -> tuple[list[str | None], str | None]:
    """(fields, reason) of one line by the strict rules; fields are empty where a reason is given."""
    line = "" if line is None else line
    return _scanned(line[:-1] if line.endswith("\r") else line)


def _scanned(line: str) -> tuple[list[str | None], str | None]:
    fields: list[tuple[str, bool]] = []
    at = 0
    while True:
        m = _STRICT_FIELD.match(line, at)
        if m is None:
            return [], "quoting"
        quoted = m.group(1) is not None
        fields.append((m.group(1).replace('""', '"') if quoted else m.group(2), quoted))
        at = m.end()
        if at == len(line):
            break
        at += 1
    if len(fields) != len(COLUMNS):
        return [], "column_count"
    row = {c: (None if v in ("", "\\N") else v) for c, (v, _) in zip(COLUMNS, fields, strict=True)}
    quoted_of = {c: q for c, (_, q) in zip(COLUMNS, fields, strict=True)}
    bad = row["jd_no"] is None or not _ID(row["jd_no"])
    for c in TITLES:
        v = row[c]
        control = _CONTROL_QUOTED if quoted_of[c] else _CONTROL
        bad = bad or v is None or not v.strip() or "\ufffd" in v or bool(control.search(v))
    for c in NUMBERS:
        bad = bad or (row[c] is not None and not _NUMBER(row[c]))
    for c in DATES:
        bad = bad or (row[c] is not None and not _real_day(row[c]))
    return ([], "invalid_value") if bad else ([row[c] for c in COLUMNS], None)


def _diagnosed(keys: pa.Array, text: pa.Array) -> pa.RecordBatch:
    rows = [_scanned(t) for t in text.to_pylist()]
    cols = zip(*[fields or [None] * len(COLUMNS) for fields, _ in rows], strict=True) if rows else [[]] * len(COLUMNS)
    return pa.RecordBatch.from_arrays(
        [keys, *(pa.array(c, pa.string()) for c in cols), pa.array([r for _, r in rows], pa.string())], schema=_OUT
    )


def _solve(keys: pa.Array, text: pa.Array) -> Iterator[pa.RecordBatch]:
    """The lines of a block in their order: the valid ones of every bulk parse, and what masks and bisection isolated."""
    shaped = pc.match_substring_regex(text, _LINE)
    apart = [pc.indices_nonzero(pc.invert(shaped))]
    todo = [pc.indices_nonzero(shaped)]
    found, places = [], []
    while todo:
        at = todo.pop()
        if not len(at):
            continue
        got = _parsed(text.take(at))
        if got is None:
            if len(at) == 1:
                apart.append(at)
            else:
                todo += [at[len(at) // 2 :], at[: len(at) // 2]]
            continue
        ok = _valid(got)
        apart.append(at.filter(pc.invert(ok)))
        places.append(at.filter(ok))
        found.append(got.filter(ok).add_column(0, "line_no", keys.take(places[-1])).append_column("reason", pa.nulls(len(places[-1]), pa.string())))
    places.append(pa.concat_arrays(apart))
    if len(places[-1]):
        found.append(pa.Table.from_batches([_diagnosed(keys.take(places[-1]), text.take(places[-1]))]))
    if found:
        whole = pa.concat_tables(t.cast(_OUT) for t in found)
        order = np.argsort(pa.concat_arrays([p for p in places if len(p)]).to_numpy(), kind="stable")
        yield from whole.take(pa.array(order)).combine_chunks().to_batches()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = batch.column(0).cast(pa.int64())
        text = pc.fill_null(batch.column(1).cast(pa.string()), "")
        text = pc.replace_substring_regex(text, "\r$", "")
        lo = 0
        while lo < len(text):
            # A block is joined into one text, which must stay well below 2 GB.
            n = min(BLOCK, len(text) - lo)
            while n > 1 and pc.sum(pc.binary_length(text.slice(lo, n))).as_py() > BLOCK_BYTES:
                n //= 2
            yield from _solve(keys.slice(lo, n), text.slice(lo, n))
            lo += n


def parse_lines(lines: DataFrame, key: str = "line_no", text: str = "raw_text") -> DataFrame:
    """One row per line: ``line_no``, the eleven columns as text, and ``reason``.

    ``reason`` is null for a loadable line; else it is the first of quoting, column_count and
    invalid_value that applies, and the columns are null. A null or empty line has one field, so
    its reason is column_count. Repeated lines are each given. Other columns of the input are not
    carried, so clashing names do no harm; an empty input gives an empty result. No shuffle.
    """
    return lines.select(F.col(key).cast("bigint").alias("line_no"), F.col(text).cast("string").alias("raw_text")).mapInArrow(
        _blocks, ", ".join(["line_no bigint", *(f"{c} string" for c in COLUMNS), "reason string"])
    )


def _typed(c: str) -> Column:
    if c in NUMBERS:
        return F.expr(f"try_cast({c} as bigint)").alias(c)
    if c in DATES:
        return F.expr(f"try_to_date({c}, 'yyyyMMdd')").alias(c)
    return F.col(c)


def loadable(parsed: DataFrame) -> DataFrame:
    """The valid lines with typed columns. ``beyond_64_bits`` tells the digits of numbers that don't fit, which are null in their columns: ``column=digits``, joined by commas; null if all fit."""
    over = [F.when(F.expr(f"try_cast({c} as bigint)").isNull() & F.col(c).isNotNull(), F.concat(F.lit(f"{c}="), c)) for c in NUMBERS]
    kept = F.nullif(F.concat_ws(",", *over), F.lit(""))
    return parsed.where(F.col("reason").isNull()).select("line_no", *map(_typed, COLUMNS), kept.alias("beyond_64_bits"))


def rejected(parsed: DataFrame) -> DataFrame:
    """The failed lines with their reason."""
    return parsed.where(F.col("reason").isNotNull()).select("line_no", "reason")
