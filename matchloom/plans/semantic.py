"""Entity, relation and tree models of people and positions, matched per exposed pair.

Models are arrays of each record's own values; all comparisons are column functions inside the
pair, so nothing but the pair join is shuffled. People's lists are split as problem 6 infers; the
lists of positions come clean, by ``|`` and comma.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import jsons
from ..functions import parsing as P
from ..functions import semantics as M
from ..operators import metrics, packed, ranking
from ..operators.registry import Registry
from ..session import checkpointed, table
from . import dealt
from .catalog import _CODES, _JOBS, _USERS, jobs, users
from .registry import query

EMPTY = "array<string>"
#: What relations are called, of people and of positions, with the lists of their objects.
SAID = {"技能": "r_skill", "期望行业": "r_field", "期望职位": "r_type"}
ASKED = {"技能要求": "j_skill", "行业": "j_field", "职位": "j_type"}
#: Dimensions by the categories they gather; what a dimension's description says.
GROUPS = {"技术能力": ["skills", "技术能力", "专业技能"], "工作经验": ["experience", "工作经验", "项目经验"], "教育背景": ["education", "教育背景", "学历"]}
OTHER, DESCRIBED, OTHER_DESCRIBED = "通用能力", "{}相关的能力和资质", "综合能力和资质"


def _names(c: Column) -> Column:
    """Valid names (2 to 50 characters), different, lower case."""
    t = F.transform(c, lambda x: F.trim(F.lower(x)))
    return F.coalesce(F.array_distinct(F.filter(t, lambda x: F.length(x).between(2, 50))), F.array().cast(EMPTY))


def _resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    seps = packed.infer_separators(table(spark, sf_dir, "table1_user"), dealt.LISTS)
    lists = {"r_skill": "experience", "r_field": "desire_jd_industry_id", "r_type": "desire_jd_type_id"}
    own = [_names(packed.split_values(F.col(c), seps[c])).alias(n) for n, c in lists.items()]
    return users(spark, sf_dir).select("user_id", *own, _names(F.array(P.stripped(F.col("cur_degree_id")))).alias("r_degree"))


def _position(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = {"j_skill": F.split("jd_key", r"\|"), "j_field": F.split("jd_industry", ","), "j_type": F.array("jd_sub_type"), "j_degree": F.array(P.stripped(F.col("min_edu_level")))}
    return jobs(spark, sf_dir).select("jd_no", F.coalesce("jd_title", F.lit("未知职位")).alias("title"), *[_names(c).alias(n) for n, c in own.items()])


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "user_exposure").select("user_id", "jd_no").distinct()
    return e.join(_resume(spark, sf_dir), "user_id").join(_position(spark, sf_dir), "jd_no")


def _held(wanted: str, held: str) -> Column:
    """Share of the wanted names that a held name equals, holds or is held by."""
    return F.size(F.filter(wanted, lambda w: F.exists(held, lambda h: M.near(w, h)))) / F.size(wanted)


_N = "coalesce(list_distinct(list_filter(list_transform({0}, lambda x: trim(lower(x))), lambda x: length(x) between 2 and 50)), [])"
_LISTS = ", ".join(f"list(item order by pos) filter (field_name = '{f}') as {f}" for f in dealt.LISTS)
_R = f"""v as ({dealt.SQL['p6_found']}), l as (select user_id, {_LISTS} from v group by 1),
r as (select u.user_id, u.cur_degree_id, {_N.format('l.experience')} as rs, {_N.format('l.desire_jd_industry_id')} as rf, {_N.format('l.desire_jd_type_id')} as rt,
 {_N.format('[' + _CODES.format('u.cur_degree_id') + ']')} as rd from {_USERS} u left join l on l.user_id = u.user_id)"""
_P = f"""{_R}, p as (select e.user_id, e.jd_no, j.jd_title, rs, rf, rt, rd, {_N.format("string_split(j.jd_key, '|')")} as js, {_N.format("string_split(j.jd_industry, ',')")} as jf,
 {_N.format('[j.jd_sub_type]')} as jt, {_N.format('[' + _CODES.format('j.min_edu_level') + ']')} as jg
 from (select distinct user_id, jd_no from user_exposure) e join r on r.user_id = e.user_id join {_JOBS} j on j.jd_no = e.jd_no)"""
_WORDS = r"list_distinct(string_split_regex({0}, '\s+'))"
_COMMON = f"len(list_intersect({_WORDS.format('w')}, {_WORDS.format('h')}))"
_LADDER = f"case when w = h then 1e0 when contains(w, h) or contains(h, w) then 0.7e0 else {_COMMON} / len(list_distinct(list_concat({_WORDS.format('w')}, {_WORDS.format('h')}))) end"
_LIKENESS = f"case when w = h then 1e0 when contains(w, h) or contains(h, w) then 0.7e0 else {_COMMON} / greatest(len({_WORDS.format('w')}), len({_WORDS.format('h')})) end"


def _best(wanted: str, held: str, likeness: str) -> str:
    return f"case when len({wanted}) > 0 and len({held}) > 0 then list_avg(list_transform({wanted}, lambda w: list_max(list_transform({held}, lambda h: {likeness})))) end"


_HELD = "len(list_filter({0}, lambda w: len(list_filter({1}, lambda h: contains(w, h) or contains(h, w))) > 0)) / len({0})"
_MATCH = f"""{_P}, m as (select *, {_best('js', 'rs', _LADDER)} as bs, {_best('jf', 'rf', _LADDER)} as bf from p),
s as (select user_id, jd_no, js, jf, rs, rf, case when bs is null and bf is null then 0 else (coalesce(bs, 0) + coalesce(bf, 0)) / ((bs is not null)::int + (bf is not null)::int) end as entity,
 case when len(js) + len(jf) = 0 then 0 else ((len(js) > 0 and len(rs) > 0)::int + (len(jf) > 0 and len(rf) > 0)::int) / ((len(js) > 0)::int + (len(jf) > 0)::int) end as dimension,
 case when len(js) + len(jf) = 0 then 0 else (case when len(js) > 0 and len(rs) > 0 then 0.4e0 + 0.6e0 * {_HELD.format('js', 'rs')} else 0 end
  + case when len(jf) > 0 and len(rf) > 0 then 0.4e0 + 0.6e0 * {_HELD.format('jf', 'rf')} else 0 end) / ((len(js) > 0)::int + (len(jf) > 0)::int) end as relation from m)"""


@query(f"with {_MATCH} select user_id, jd_no, round(dimension, 6) as dimension, round(entity, 6) as entity, round(relation, 6) as relation, round(0.3e0 * dimension + 0.5e0 * entity + 0.2e0 * relation, 6) as score from s")
def semantic_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skills and fields as the two dimensions, categories and relations of both sides, under one name each."""
    x = _pairs(spark, sf_dir)
    some = lambda c: (F.size(c) > 0).cast("int")
    wanted = some("j_skill") + some("j_field")
    rel = lambda w, h: F.when((F.size(w) > 0) & (F.size(h) > 0), 0.4 + 0.6 * _held(w, h)).otherwise(0.0)
    entity = M.entity_matching({"技能": M.entity_score(F.col("j_skill"), F.col("r_skill"), P.ladder), "行业领域": M.entity_score(F.col("j_field"), F.col("r_field"), P.ladder)})
    dimension = F.when(wanted == 0, 0.0).otherwise((some("j_skill") * some("r_skill") + some("j_field") * some("r_field")) / wanted)
    relation = F.when(wanted == 0, 0.0).otherwise((rel("j_skill", "r_skill") + rel("j_field", "r_field")) / wanted)
    x = x.select("user_id", "jd_no", entity.alias("entity"), dimension.alias("dimension"), relation.alias("relation"))
    score = M.overall(F.col("dimension"), F.col("entity"), F.col("relation"))
    return x.select("user_id", "jd_no", *[F.round(c, 6).alias(c) for c in ("dimension", "entity", "relation")], F.round(score, 6).alias("score"))


def _gaps() -> Column:
    near = lambda a, c: F.exists(c, lambda b: M.near(a, b))
    return F.array_sort(F.filter("j_skill", lambda w: ~near(w, F.col("r_skill")))).alias("gaps")


def _strengths() -> Column:
    wanted = F.concat("j_skill", "j_field")
    return F.array_sort(F.filter(F.array_union("r_skill", "r_field"), lambda h: F.exists(wanted, lambda w: M.near(h, w)))).alias("strengths")


_GAPS = "list_sort(list_filter(js, lambda w: len(list_filter(rs, lambda h: contains(w, h) or contains(h, w))) = 0)) as gaps"
_STRENGTHS = "list_sort(list_filter(list_distinct(list_concat(rs, rf)), lambda h: len(list_filter(list_concat(js, jf), lambda w: contains(w, h) or contains(h, w))) > 0)) as strengths"


@query(f"with {_P} select user_id, jd_no, {_GAPS}, {_STRENGTHS} from p")
def gaps_and_strengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("user_id", "jd_no", _gaps(), _strengths())


def default_dimensions(categories: dict[str, Column]) -> Column:
    """Dimensions (``name``, ``description``, ``entities``) of lists by category: GROUPS that hold entities; if there is none, OTHER with everything."""
    some = [
        (d, F.flatten(F.array(*[categories[c] for c in cs if c in categories])) if any(c in categories for c in cs) else F.array().cast(EMPTY))
        for d, cs in GROUPS.items()
    ]
    made = lambda name, text, xs: F.struct(F.lit(name).alias("name"), F.lit(text).alias("description"), xs.alias("entities"))
    grouped = F.filter(F.array(*[made(d, DESCRIBED.format(d), xs) for d, xs in some]), lambda d: F.size(d["entities"]) > 0)
    return F.when(F.size(grouped) > 0, grouped).otherwise(F.array(made(OTHER, OTHER_DESCRIBED, F.flatten(F.array(*categories.values())))))


def _relations(names: dict[str, str]) -> Column:
    made = [F.struct(F.lit(r).alias("relation"), F.col(c).alias("objects")) for r, c in names.items()]
    return F.filter(F.array(*made), lambda x: F.size(x["objects"]) > 0)


def modelled(pairs: DataFrame) -> DataFrame:
    """``dimension``, ``entity``, ``relation`` and ``score`` of pairs with the lists of both sides, beside their other columns."""
    tree = {s: default_dimensions({"技能": F.col(f"{s}_skill"), "行业领域": F.col(f"{s}_field"), "教育背景": F.col(f"{s}_degree")}) for s in "rj"}
    x = pairs.withColumns({"__rt": tree["r"], "__jt": tree["j"], "__rr": _relations(SAID), "__jr": _relations(ASKED)})
    by_category = {c: M.entity_score(F.col(f"j_{n}"), F.col(f"r_{n}")) for c, n in (("技能", "skill"), ("行业领域", "field"), ("教育背景", "degree"))}
    x = x.withColumns({
        "dimension": M.coverage(F.col("__jt"), F.col("__rt")), "entity": M.entity_matching(by_category),
        "relation": M.relation_matching(F.col("__jr"), F.col("__rr")),
    })
    return x.drop("__rt", "__jt", "__rr", "__jr").withColumn("score", M.overall(F.col("dimension"), F.col("entity"), F.col("relation")))


def _tree_sql(skill: str, field: str, degree: str) -> str:
    return f"case when len({degree}) > 0 then '教育背景' else '{OTHER}' end"


def _rel_sql(likeness: float, wanted: str, held: str) -> str:
    return f"case when len({wanted}) > 0 and len({held}) > 0 then {0.4 * likeness}e0 + 0.6e0 * {_HELD.format(wanted, held)} else 0e0 end"


_MODEL = f"""{_P}, m as (select *, {_best('js', 'rs', _LIKENESS)} as bs, {_best('jf', 'rf', _LIKENESS)} as bf, {_best('jg', 'rd', _LIKENESS)} as bd from p),
s as (select *, case when {_tree_sql('rs', 'rf', 'rd')} = {_tree_sql('js', 'jf', 'jg')} then 1e0 else 0e0 end as dimension,
 coalesce((coalesce(bs, 0) + coalesce(bf, 0) + coalesce(bd, 0)) / nullif((bs is not null)::int + (bf is not null)::int + (bd is not null)::int, 0), 0) as entity,
 coalesce(({_rel_sql(0.7, 'js', 'rs')} + {_rel_sql(0.7, 'jf', 'rf')} + {_rel_sql(0.7, 'jt', 'rt')}) / nullif((len(js) > 0)::int + (len(jf) > 0)::int + (len(jt) > 0)::int, 0), 0) as relation from m),
q as (select *, round(0.3e0 * dimension + 0.5e0 * entity + 0.2e0 * relation, 6) as score from s),
k as (select *, row_number() over (partition by user_id order by score desc, jd_no) as rk, max(score) over (partition by user_id) as top from q)"""


@query(f"with {_MODEL} select user_id, jd_no, round(dimension, 6) as dimension, round(entity, 6) as entity, round(relation, 6) as relation, score, cast(rk as bigint) as rk from k")
def ranked_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's candidate positions by the match of dimensions (trees), entities and relations."""
    x = modelled(_pairs(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("dimension", "entity", "relation", "score")})
    x = checkpointed(x.select("user_id", "jd_no", "dimension", "entity", "relation", "score"))  # ranking reads its input twice
    return ranking.positions(x, ["user_id"], [F.desc("score"), F.col("jd_no")], "rk")


@query(f"with {_MODEL} select user_id, cast(rk as bigint) as rk, jd_no, coalesce(jd_title, '未知职位') as title, score, round(case when top > 0 then 100 * score / top else 0 end, 4) as relative, {_GAPS}, {_STRENGTHS} from k where rk <= 5")
def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best positions of each person, their score relative to the best, and what is missing or held."""
    x = modelled(_pairs(spark, sf_dir)).select("user_id", "jd_no", "title", F.round("score", 6).alias("score"), _gaps(), _strengths())
    top = ranking.leaders(x, ["user_id"], [F.desc("score"), F.col("jd_no")], 5, "rk")
    best = F.max("score").over(ranking.Window.partitionBy("user_id"))  # at most five rows
    relative = F.round(F.when(best > 0, 100 * F.col("score") / best).otherwise(0.0), 4)
    return top.select("user_id", "rk", "jd_no", "title", "score", relative.alias("relative"), "gaps", "strengths")


_HITS = "select user_id, jd_no from table3_action where user_id is not null and jd_no is not null and {0} = 1 group by 1, 2"
_QUALITY = "(select avg(coalesce(s.s, 0) / n.n) as m from (select user_id, count(*) as n from ({0}) group by 1) n left join (select user_id, sum(ix / rk) as s from (select *, row_number() over (partition by user_id order by rk) as ix from k join ({0}) using (user_id, jd_no)) group by 1) s using (user_id))"


@query(f"with {_MODEL} select round(a.m, 8) as map_sat, round(b.m, 8) as map_dev, round(0.7e0 * a.m + 0.3e0 * b.m, 8) as final from {_QUALITY.format(_HITS.format('satisfied'))} a, {_QUALITY.format(_HITS.format('delivered'))} b")
def match_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean average precision of the matches against both labels, positives that were never ranked included, and the final metric."""
    ranked = checkpointed(ranked_matches(spark, sf_dir).select("user_id", "jd_no", "rk"))
    a = table(spark, sf_dir, "table3_action").where("user_id is not null and jd_no is not null")
    out = []
    for name, label in (("map_sat", "satisfied"), ("map_dev", "delivered")):
        hits = a.where(F.col(label) == 1).select("user_id", "jd_no").distinct()
        total = hits.groupBy("user_id").agg(F.count("*").alias("n"))
        own = ranked.join(hits, ["user_id", "jd_no"], "left_semi")
        out.append(metrics.average_precision(own, "user_id", "rk", F.lit(True), total).agg(F.avg("ap").alias(name)))
    final = 0.7 * F.col("map_sat") + 0.3 * F.col("map_dev")
    return out[0].join(F.broadcast(out[1])).select(F.round("map_sat", 8).alias("map_sat"), F.round("map_dev", 8).alias("map_dev"), F.round(final, 8).alias("final"))  # one row each


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``owner``, ``category``, ``entity``, ``seq``: the rule extractor over people."""
    r = _resume(spark, sf_dir)
    own = [F.struct(F.lit(c).alias("category"), F.col(x).alias("xs")) for c, x in (("技能", "r_skill"), ("行业领域", "r_field"))]
    x = r.select(F.col("user_id").alias("owner"), F.explode(F.array(*own)).alias("e"))
    return x.select("owner", "e.category", F.posexplode("e.xs").alias("seq", "entity"))


_E = f"""{_R}, e as (select user_id as owner, '技能' as category, unnest(rs) as entity from r union all select user_id, '行业领域', unnest(rf) from r)"""


@query(f"with {_E} select category, count(*) as mentions, count(distinct entity) as entities, count(distinct owner) as owners from e group by 1")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = entities(spark, sf_dir)
    by = e.groupBy("category", "entity").agg(F.count("*").alias("n")).groupBy("category").agg(F.sum("n").alias("mentions"), F.count("*").alias("entities"))
    who = e.select("category", "owner").distinct().groupBy("category").agg(F.count("*").alias("owners"))
    return by.join(who, "category")


@query("""with t as (select user_id as subject, jd_no as object, case when satisfied = 1 then 'satisfied' when delivered = 1 then 'delivered' else 'browsed' end as relation,
 epoch_us(action_at) as seq from table3_action where user_id is not null and jd_no is not null)
select subject, object, max_by(relation, (seq, relation)) as relation, count(*) as n, list_sort(list(distinct relation)) as relations from t group by 1, 2""")
def triples_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with their last relation."""
    rel = F.when(F.col("satisfied") == 1, "satisfied").when(F.col("delivered") == 1, "delivered").otherwise("browsed")
    t = table(spark, sf_dir, "table3_action").where("user_id is not null and jd_no is not null").select(
        F.col("user_id").alias("subject"), F.col("jd_no").alias("object"), rel.alias("relation"), F.col("action_at").alias("seq")
    )
    last = F.max(F.struct("seq", "relation"))["relation"]
    return t.groupBy("subject", "object").agg(last.alias("relation"), F.count("*").alias("n"), F.array_sort(F.collect_set("relation")).alias("relations"))


def node_types(triples: DataFrame, seq: str) -> DataFrame:
    """``node``, ``type``: subject or object, by the role a node has first in the order of ``seq``, the subject of a triple first."""
    roles = [triples.select(F.col(c).alias("node"), F.struct(F.col(seq).alias("seq"), F.lit(i).alias("place")).alias("first")) for i, c in enumerate(("subject", "object"))]
    both = roles[0].union(roles[1]).where("node is not null")
    return both.groupBy("node").agg(F.min("first")["place"].alias("place")).select("node", F.when(F.col("place") == 0, "subject").otherwise("object").alias("type"))


@query("""with n as (select user_id as node, linked_at as seq, 0 as place from user_link union all select linked_user_id, linked_at, 1 from user_link)
select node, case min_by(place, (coalesce(epoch_us(seq), -9223372036854775807), place)) when 0 then 'subject' else 'object' end as type from n where node is not null group by 1""")
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the account graph by their first role; links without a time come first."""
    return node_types(table(spark, sf_dir, "user_link").select(F.col("user_id").alias("subject"), F.col("linked_user_id").alias("object"), "linked_at"), "linked_at")


@query(f"""with {_R} select user_id as owner, {_tree_sql('rs', 'rf', 'rd')} as dimension,
cast(case when len(rd) > 0 then len(rd) else len(rs) + len(rf) end as bigint) as entities from r""")
def default_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default tree of each person: a dimension and the number of entities under it."""
    dims = default_dimensions({"技能": F.col("r_skill"), "行业领域": F.col("r_field"), "教育背景": F.col("r_degree")})
    x = _resume(spark, sf_dir).select(F.col("user_id").alias("owner"), F.explode(dims).alias("d"))
    return x.select("owner", F.col("d.name").alias("dimension"), F.size("d.entities").cast("bigint").alias("entities"))


@query(f"""with {_E}, g as (select owner, category, case category when '技能' then '技术能力' else '通用能力' end as dimension, entity from e)
select owner, dimension, cast(count(*) as bigint) as entities, bool_or(dimension = '技术能力') as grouped from g group by 1, 2""")
def tree_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities by two dimensions of their category; ``default_tree`` has the reference's grouping."""
    dim = F.when(F.col("category") == "技能", "技术能力").otherwise("通用能力")
    g = entities(spark, sf_dir).select("owner", dim.alias("dimension"))
    return g.groupBy("owner", "dimension").agg(F.count("*").alias("entities"), F.bool_or(F.col("dimension") == "技术能力").alias("grouped"))


@query("""select jd_no, case when city % 2 = 0 then jd_no else 'jd_root' end as root, coalesce(jd_sub_type, '') as dimension, case when city % 3 = 0 then 'd' else '' end as description, [jd_no, 'x'] as entities
from (select distinct * exclude (loaded_at) from table2_jd) where jd_sub_type is not null""")
def json_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees read back from free text around JSON whose keys have either spelling or lack."""
    j = jobs(spark, sf_dir).where("jd_sub_type is not null")
    even, three = F.coalesce(F.col("city") % 2 == 0, F.lit(False)), F.coalesce(F.col("city") % 3 == 0, F.lit(False))
    xs = F.array("jd_no", F.lit("x"))
    named = F.to_json(F.struct(
        F.when(even, F.col("jd_no")).alias("root"),
        F.array(F.struct(F.col("jd_sub_type").alias("name"), F.when(three, "d").alias("description"), xs.alias("entities")), F.struct(F.lit(None).cast("string").alias("name"), F.lit("gone").alias("description"), xs.alias("entities"))).alias("dimensions"),
    ))
    other = F.to_json(F.struct(F.when(even, F.col("jd_no")).alias("根节点"), F.array(F.struct(F.col("jd_sub_type").alias("维度"), F.when(three, "d").alias("描述"), xs.alias("实体"))).alias("维度节点")))
    text = F.concat(F.lit("Here:\n"), F.when(F.substring("jd_no", 1, 1) < "8", named).otherwise(other), F.lit("\nDone."))
    t = j.select("jd_no", jsons.tree(text, "jd_root").alias("t")).select("jd_no", "t.root", F.explode("t.dimensions").alias("d"))
    return t.select("jd_no", "root", F.col("d.name").alias("dimension"), F.col("d.description"), F.col("d.entities"))


@query()
def canonical_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry over ref_item, a fixed table, in the order of kind and code."""
    held = Registry(["city", "industry", "job_type"])
    for r in table(spark, sf_dir, "ref_item").orderBy("ref_kind", "ref_code", "ref_name").collect():
        held.add(r["ref_kind"], r["ref_name"])
    return held.table(spark)


#: What the seeded registry holds besides what people and positions say, and the words looked for in these.
REQUIREMENTS = {"教育背景": ["本科", "大专"], "工作经验": ["经验"], "技能": ["团队", "沟通", "解决问题", "责任心", "学习能力", "office", "项目管理"]}
SEEDS = {
    "教育背景": "本科 大专 硕士 博士 高中 中专 计算机科学 软件工程 工商管理 市场营销".split(),
    "行业领域": "互联网 金融 教育 医疗 房地产 制造业 零售 物流 咨询 广告 建筑".split(),
    "职位要求": "团队合作 沟通能力 解决问题能力 学习能力 责任心 执行力 创新能力 领导力".split(),
    "工作职责": "项目管理 团队管理 客户沟通 数据分析 产品开发 市场推广 销售".split(),
}


def seeded(people: DataFrame, positions: DataFrame, n_people: int = 10, n_positions: int = 5) -> Registry:
    """A registry of the first people's values (2 to 10 characters, of texts of more than 10), the requirements
    that the first positions' texts (of more than 50 characters) name, and SEEDS. Only that many rows reach the driver."""
    held = Registry()
    said = people.where(F.length("experience") > 10).select("user_id", F.split("experience", r"\|").alias("xs"))
    for r in people.select("user_id").orderBy("user_id").limit(n_people).join(said, "user_id").orderBy("user_id").collect():
        for x in r["xs"]:
            if 1 < len(x) <= 10:
                held.add("技能", x)
    for r in positions.orderBy("jd_no").limit(n_positions).where(F.length("job_description") > 50).select("job_description").collect():
        for category, words in REQUIREMENTS.items():
            for w in words:
                if w in r["job_description"]:
                    held.add(category, w)
    for category, names in SEEDS.items():
        for x in names:
            held.add(category, x)
    return held


@query()
def seeded_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded(users(spark, sf_dir), jobs(spark, sf_dir)).table(spark)
