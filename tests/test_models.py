import random

import pytest
from pyspark.sql import functions as F

from matchloom.functions import jsons
from matchloom.functions import parsing as P
from matchloom.functions import semantics as M
from matchloom.operators import metrics, ranking
from matchloom.operators.registry import Registry
from matchloom.plans import chain, learning, semantic
from matchloom.sources.cache import TextCache

DIMS = "array<struct<name:string,description:string>>"
RELS = "array<struct<relation:string,objects:array<string>>>"


def test_likeness_of_names(spark):
    df = spark.createDataFrame([("Java", "java"), ("Java dev", "java"), ("a b", "b c d"), ("", ""), ("x", " "), ("x", None)], "a string, b string")
    got = [r[0] for r in df.select(M.name_likeness(F.col("a"), F.col("b"))).collect()]
    assert [round(x, 3) for x in got[:4]] == [1.0, 0.7, 0.333, 1.0] and got[4:] == [0.0, 0.0]


def test_dimensions(spark):
    rows = [
        ([("Tools", "java sql"), ("School", "")], [("tools", "java go"), ("x", "y")]), ([("Tools", "")], []), ([], [("x", "y")]), (None, None),
    ]
    df = spark.createDataFrame(rows, f"w {DIMS}, h {DIMS}")
    assert [round(r[0], 3) for r in df.select(M.coverage(F.col("w"), F.col("h"))).collect()] == [0.425, 0.0, 0.0, 0.0]


def test_relations(spark):
    rows = [
        ([("needs skill", ["java", "sql"]), ("city", ["x"])], [("skill", ["java 8"]), ("years", ["3"])]), ([("skill", ["go"])], []), ([], [("skill", ["go"])]),
        ([("skill", ["go", "go", "c"])], [("skill", ["go"])]),
    ]
    df = spark.createDataFrame(rows, f"w {RELS}, h {RELS}")
    got = [round(r[0], 3) for r in df.select(M.relation_matching(F.col("w"), F.col("h"))).collect()]
    assert got == [round((0.4 * 0.7 + 0.6 * 0.5) / 2, 3), 0.0, 0.0, round(0.4 + 0.6 * 2 / 3, 3)]


def test_weights_of_categories(spark):
    df = spark.createDataFrame([(0.5, 1.0, None), (None, None, None)], "a double, b double, c double")
    got = [r[0] for r in df.select(M.entity_matching({"skills": F.col("a"), "技能": F.col("b"), "education": F.col("c")})).collect()]
    assert got == [pytest.approx((0.5 * 0.5 + 0.5 * 1.0) / 1.0), 0.0]


def test_default_dimensions(spark):
    df = spark.createDataFrame([(["a"], ["b"]), (["a"], []), ([], [])], "s array<string>, e array<string>")
    got = [[(d["name"], d["entities"]) for d in r[0]] for r in df.select(semantic.default_dimensions({"技能": F.col("s"), "教育背景": F.col("e")})).collect()]
    assert got == [[("教育背景", ["b"])], [("通用能力", ["a"])], [("通用能力", [])]]


def test_nodes_by_first_role(spark):
    t = spark.createDataFrame([("a", "b", 2), ("b", "c", 1), ("d", "d", 3), (None, "e", 4)], "subject string, object string, seq int")
    assert {tuple(r) for r in semantic.node_types(t, "seq").collect()} == {("a", "subject"), ("b", "subject"), ("c", "object"), ("d", "subject"), ("e", "object")}


def test_json_in_text(spark):
    texts = ['x {"a": {"b": 1}} y }z', "no", None, "", "{", 'so {"k":\n["v"]}']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(jsons.extracted(F.col("t"))).collect()] == ['{"a": {"b": 1}} y }', None, None, None, None, '{"k":\n["v"]}']
    assert [r[0] for r in df.select(jsons.lists(F.col("t"))).collect()][1:] == [{}, {}, {}, {}, {"k": ["v"]}]
    rows = [('[["a","r","b"],["a","r",["c","d"]],["a","r",[]],["a"]]',), ("bad",), (None,)]
    got = [[tuple(t) for t in r[0]] for r in spark.createDataFrame(rows, "t string").select(jsons.triples(F.col("t"))).collect()]
    assert got == [[("a", "r", "b"), ("a", "r", "c"), ("a", "r", "")], [], []]
    rows = [('{"root":"R","dimensions":[{"name":"n","entities":["e"]},{"描述":"q"}]}',), ('{"根节点":"K","维度节点":[{"维度":"m","描述":"d","实体":["z"]}]}',), ("bad",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(jsons.tree(F.col("t"), "root")).collect()]
    assert [(x["root"], x["dimensions"] and [tuple(d) for d in x["dimensions"]]) for x in got] == [("R", [("n", "", ["e"])]), ("K", [("m", "d", ["z"])]), ("root", None), ("root", None)]


def test_segmented_words(spark):
    df = spark.createDataFrame([("负责Java开发 and SQL，会a",), ("软件",), ("",), (None,), ("软",)], "t string")
    got = [r[0] for r in df.select(P.segmented(F.col("t"), ["and"])).collect()]
    assert got == [["负责", "java", "开发", "sql"], ["软件"], [], None, []]
    assert df.limit(1).select(P.segmented(F.lit("软件工程师"))).first()[0] == ["软件", "件工", "工程", "程师"]


def test_areas_by_group(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(6) / 6, rng.randrange(2)) for _ in range(300)] + [("c", 0.5, 1), (None, 0.1, 0), (None, 0.2, 1), ("a", None, 1)]
    got = {r["g"]: r["auc"] for r in metrics.auc_by(spark.createDataFrame(rows, "g string, s double, y int"), "g", "s", F.col("y")).collect()}
    for g in "ab":
        own = [(s, y) for k, s, y in rows if k == g and s is not None]
        pos, neg = ([s for s, y in own if y == v] for v in (1, 0))
        assert got[g] == pytest.approx(sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg))
    assert got["c"] is None and got[None] == 1.0


def test_fold_mean_and_leaders(spark):
    p = spark.createDataFrame([("x", 0, 1.0), ("x", 1, 0.0), ("y", 1, 0.5)], "k string, fold long, pred double")
    w = spark.createDataFrame([(0, 0.6), (1, 0.4)], "fold long, weight double")
    assert {r["k"]: r["pred"] for r in metrics.fold_mean(p, ["k"], "fold", "pred", w).collect()} == {"x": pytest.approx(0.6), "y": pytest.approx(0.5)}
    df = spark.createDataFrame([(g, i % 5, i) for g in ("a", None) for i in range(20)], "g string, s int, i int")
    got = {(r["g"], r["rk"]): (r["s"], r["i"]) for r in ranking.leaders(df, ["g"], [F.desc("s"), F.col("i")], 3, "rk").collect()}
    assert got == {(g, k + 1): (4, 4 + 5 * k) for g in ("a", None) for k in range(3)}
    assert ranking.leaders(df.limit(0), ["g"], [F.col("i")], 3, "rk").count() == 0


def test_chosen_columns(spark):
    df = spark.createDataFrame([("u", 1, 2.0)], "user_id string, comp_skill_text int, comp_salary double")
    assert chain.feature_columns(df, ["user_id"], ["comp_salary", "comp_x"]) == ["comp_skill_text", "comp_salary", "comp_x"]
    dims = chain.dimension_columns(["comp_skill_text", "comp_salary"], {"skills": ["skill"], "traits": ["skill_text"], "self": ["salary"], "none": ["z"]})
    assert dims == {"skills": ["comp_skill_text"], "traits": ["comp_skill_text"], "self": ["comp_salary"], "none": []}
    imp = spark.createDataFrame([("comp_skill_text", 3.0), ("comp_salary", 1.0)], "feature string, gain double")
    assert {r["dimension"]: r["share"] for r in chain.importance_by_dimension(imp, dims).collect()} == {"skills": 0.75, "traits": 0.75, "self": 0.25}


def test_lookup_and_sample(spark):
    df = spark.createDataFrame([(f"u{i % 50}", i) for i in range(200)] + [(None, 1)], "user_id string, n int")
    assert chain.looked_up(df, "user_id", "u7").count() == 1 and chain.looked_up(df, "user_id", "none").count() == 0
    a, b, c = ([r[0] for r in chain.sampled_keys(df.repartition(k), "user_id", 0.3, 3, seed).collect()] for k, seed in ((1, 42), (5, 42), (2, 7)))
    assert a == b and len(set(a)) == 3 and a != c
    assert chain.sampled_keys(df.limit(0), "user_id", 0.3, 3).count() == 0


def test_registry_round_trip_and_proposals(spark, tmp_path):
    r = Registry()
    assert r.propose(" 工具 ", "what is used", ["Excel", "Word", "Git", "Vim", "Bash", "Zsh"]) == "工具" and r.propose("少", "", ["a", "b"]) is None
    assert r.names("工具") == ["Excel", "Word", "Git", "Vim", "Bash"]
    assert r.add("技能", "  x") == "x" and r.add("技能", " " * 51) is None and r.add("工具", "excel") == "Excel"
    assert r.add_category("a_b-c~`") == "a_b-c~`" and all(r.add_category(f"w{x}v") is None for x in "!@#$%^&*()+={}[]|\\:;\"'<>,.?/")
    r.save(str(tmp_path / "registry"), spark)
    s = Registry.load(str(tmp_path / "registry"), spark)
    assert (s.entities, s.canonical, s.descriptions) == (r.entities, r.canonical, {k: v for k, v in r.descriptions.items() if v})


def test_seeded_registry(spark):
    people = spark.createDataFrame([(f"u{i:02}", "Java开发|测试|x|" + "y" * 11) for i in range(12)] + [("t", "短|短二")], "user_id string, experience string")
    positions = spark.createDataFrame([("j", "需要本科学历，有经验，责任心强。" * 5), ("k", "本科")], "jd_no string, job_description string")
    r = semantic.seeded(people, positions)
    assert r.names("技能") == ["Java开发", "测试", "责任心"] and r.names("工作经验") == ["经验"] and r.names("教育背景")[0] == "本科"


def test_latest_batch_counts(spark, tmp_path):
    cache = TextCache(spark, str(tmp_path / "cache"))
    df = spark.createDataFrame([("a",), ("b",), (None,)], "text string")
    assert [r["v"] for r in cache.attach(df, "text", {"v": [0.0, 0.0]}).collect()] == [[0.0, 0.0]] * 3
    for n in (1, 2):
        cache.add(cache.keyed(df.limit(1), "text").select("key", F.lit(n).alias("n")))
    assert sorted((str(r["text"]), r["n"]) for r in cache.attach(df, "text", {"n": 0}).collect()) == [("None", 0), ("a", 2), ("b", 0)]


def test_categories_in_fold_models(spark):
    rows = [(i, i % 5, ["x", "y", "z", None][i % 4], float(i % 4 == 1), float(i % 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, fold int, c string, label double, f double")
    m = learning.FoldModels(df, "label", ["f"], "fold", rounds=2, categorical=["c"], early=True)
    out = {r["id"]: r["pred"] for r in m.out_of_fold().collect()}
    assert len(out) == 200 and all((out[i] > 0.5) == (i % 4 == 1) for i in out)
    new = spark.createDataFrame([(1, "y", 0.0), (2, "new", 1.0), (3, None, None)], "id int, c string, f double")
    got = {r["id"]: r["pred"] for r in m.scored(new, ["id"]).collect()}
    assert got[1] > 0.5 > got[2] and got[3] < 0.5
    top = m.importance().groupBy("feature").agg(F.avg("gain").alias("g")).orderBy(F.desc("g")).first()
    assert top["feature"] == "c"


def test_category_of_very_many_values(spark, monkeypatch):
    monkeypatch.setattr(learning, "MOST_VALUES", 8)
    df = spark.createDataFrame([(i, i % 5, f"v{i % 30}", float(i % 2)) for i in range(150)], "id int, fold int, c string, label double")
    assert learning.FoldModels(df, "label", [], "fold", categorical=["c"]).out_of_fold().count() == 150


def test_registered_functions(spark):
    from matchloom.functions import udfs

    udfs.register(spark)
    df = spark.createDataFrame([("tide", "diet"), ("diet", "tide"), (None, "x"), ("a", "A")], "a string, b string")
    df.createOrReplaceTempView("names_to_compare")
    assert [r[0] for r in spark.sql("select name_ratio(a, b) from names_to_compare").collect()] == [0.25, 0.5, None, 1.0]
    got = df.select("a", F.inline_outer(udfs.likely_names(["diet", "A", "edit"], 0.45)("a"))).collect()
    assert [tuple(r) for r in got] == [("tide", None, None), ("diet", "diet", 1.0), ("diet", "edit", 0.75), (None, None, None), ("a", "A", 1.0)]
