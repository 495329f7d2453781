"""Queries of the core problems (3 and 6) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import packed, rejects
from ..session import table

#: The packed fields of table1_user.
LISTS = ["desire_jd_city_id", "desire_jd_industry_id", "desire_jd_type_id", "experience"]


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.rejected(rejects.parse_lines(table(spark, sf_dir, "raw_jd_line")))


def p3_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rejects.loadable(rejects.parse_lines(table(spark, sf_dir, "raw_jd_line")))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.explode_packed(table(spark, sf_dir, "table1_user"), "user_id", LISTS)


def p6_separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed.separator_scores(table(spark, sf_dir, "table1_user"), LISTS)


QUERIES = {f.__name__: f for f in (p3_found, p3_loaded, p6_found, p6_separators)}

_D = r"|｜;；\t\n\r,，、"
_ITEM = rf'''[ \x0B\f\p{{Z}}]*("[^"]*(?:""[^"]*)*"|'[^']*(?:''[^']*)*'|[^{_D}]*)[ \x0B\f\p{{Z}}]*(?:[{_D}]|$)'''.replace("'", "''")
_TRIMMED = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_F = r'(?:"(?:[^"]|"")*"|[^"\t]*)'

_LINE_COLUMNS = ", ".join(f"'{c}'" for c in rejects.COLUMNS)
_DAY = "({0} is null or (regexp_full_match({0}, '[0-9]{{8}}') and {0} >= '00010101' and try_strptime({0}, '%Y%m%d') is not null))"
_NAME = (
    "({0} is not null and not regexp_full_match({0}, '[\\s\\p{{Z}}\\x0B\\x{{1C}}-\\x{{1F}}\\x{{85}}]*') and "
    "not regexp_matches({0}, '[\\x{{FFFD}}\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x{{9F}}]') and (starts_with({1}, '\"') or not regexp_matches({0}, '[\\n\\r]')))"
)

_LINES = rf"""
with l as (select line_no, regexp_replace(coalesce(raw_text, ''), '\r$', '') as t from raw_jd_line),
s as (select line_no, t, regexp_full_match(t, '(?s){_F}(\t{_F})*') as quoted_well, regexp_full_match(t, '(?s){_F}(\t{_F}){{10}}') as eleven from l),
x as (select line_no, quoted_well, eleven, regexp_extract(t, '(?s)^{"\\t".join([f"({_F})"] * 11)}$', [{_LINE_COLUMNS}]) as f from s),
r as (select line_no, quoted_well, eleven, {', '.join(f"f.{c} as raw_{c}" for c in rejects.COLUMNS)} from x),
v as (select *, {', '.join(f"nullif(nullif(case when starts_with(raw_{c}, chr(34)) then replace(raw_{c}[2:-2], chr(34) || chr(34), chr(34)) else raw_{c} end, ''), chr(92) || 'N') as {c}" for c in rejects.COLUMNS)} from r),
d as (select *, case when not quoted_well then 'quoting' when not eleven then 'column_count' when not coalesce(regexp_full_match(jd_no, '[0-9a-f]{{32}}'), false)
  or not ({' and '.join(_NAME.format(c, 'raw_' + c) for c in rejects.TITLES)})
  or not ({' and '.join(f"({c} is null or regexp_full_match({c}, '-?[0-9]+'))" for c in rejects.NUMBERS)})
  or not ({' and '.join(_DAY.format(c) for c in rejects.DATES)}) then 'invalid_value' end as reason from v)"""
_TYPED = {c: f"try_cast({c} as bigint)" for c in rejects.NUMBERS} | {c: f"cast(try_strptime({c}, '%Y%m%d') as date)" for c in rejects.DATES}
_BEYOND = ", ".join(f"case when {c} is not null and try_cast({c} as bigint) is null then '{c}=' || {c} end" for c in rejects.NUMBERS)

#: SQL of the queries above. p6 writes down the separators that the operator infers.
SQL = {
    "p3_found": f"{_LINES} select line_no, reason from d where reason is not null",
    "p3_loaded": f"{_LINES} select line_no, {', '.join(f'{_TYPED.get(c, c)} as {c}' for c in rejects.COLUMNS)}, nullif(concat_ws(',', {_BEYOND}), '') as beyond_64_bits from d where reason is null",
    "p6_found": f"""
with u as (select distinct user_id, {', '.join(LISTS)} from table1_user where user_id is not null),
l as ({' union all '.join(f"select user_id, '{f}' as field_name, {_TRIMMED.format(f)} as t from u" for f in LISTS)}),
b as (select user_id, field_name, case when regexp_matches(t, '^(\\[[^\\[\\]]*\\]|\\([^()]*\\)|\\{{[^{{}}]*\\}})$') then t[2:-2] else t end as t
      from l where t not in ('', '-', '\\N')),
x as (select user_id, field_name, case when field_name = 'desire_jd_city_id' then regexp_extract_all(t, '[0-9]+')
        else regexp_extract_all(t, '{_ITEM}', 1) end as raw from b),
c as (select user_id, field_name, list_filter(list_transform(list_transform(raw, lambda r: {_TRIMMED.format('r')}), lambda r:
        case when length(r) >= 2 and r[1] = '"' and r[-1] = '"' then {_TRIMMED.format("replace(r[2:-2], '" + '""' + "', '" + '"' + "')")}
             when length(r) >= 2 and r[1] = '''' and r[-1] = '''' then {_TRIMMED.format("replace(r[2:-2], '''''', '''')")} else r end), lambda r: r <> '') as items from x)
select user_id, field_name, cast(pos as bigint) as pos, items[pos] as item
from (select user_id, field_name, items, unnest(range(1, length(items) + 1)) as pos from c)""",
}
