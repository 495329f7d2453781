import random
import re

import pytest

from matchloom.operators import packed

SEPS = ["|", "｜", ";", "；", "\t", "\n", ",", "，", "、"]


def plain_split(v, seps):
    """A character-by-character reading of the same rules."""
    if v is None:
        return []
    t = v.strip()
    if t in packed.NOTHING:
        return []
    for a, z in packed.BRACKETS:
        if len(t) > 1 and t[0] == a and t[-1] == z and not re.search(rf"[\{a}\{z}]", t[1:-1]):
            t = t[1:-1]
            break
    out, i = [], 0
    while i <= len(t):
        m = re.compile(r'''\s*?("[^"]*(?:""[^"]*)*"|'[^']*(?:''[^']*)*')[^\S\t\n\r]*''').match(t, i)
        if m and (m.end() == len(t) or t[m.end()] in seps + ["\r"]):
            q = m.group(1)[0]
            out.append(m.group(1)[1:-1].replace(q + q, q))
            i = m.end() + 1
            continue
        j = i
        while j < len(t) and t[j] not in seps + ["\r"]:
            j += 1
        out.append(t[i:j])
        i = j + 1
    return [x.strip() for x in out if x.strip()]


CASES = [
    ("a|b；c", ["a", "b", "c"]), ('"a|b", c', ["a|b", "c"]), ('"k ""x"", 2";d', ['k "x", 2', "d"]), ("['a','b']", ["a", "b"]),
    ("{a b , c/d}", ["a b", "c/d"]), ("(x)", ["x"]), (",,a,,", ["a"]), ("a,a", ["a", "a"]), ("-", []), (" \\N ", []), ("", []), (None, []),
    ('"open, b', ['"open', "b"]), ('"a"b,c', ['"a"b', "c"]), ("　a 、 b", ["a", "b"]), ("don't,it's", ["don't", "it's"]), ("x" * 50_000 + ",y", ["x" * 50_000, "y"]),
]


def test_splitting(spark):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(CASES)], "i int, v string")
    from pyspark.sql import functions as F

    got = {r["i"]: r["x"] for r in df.select("i", packed.split_values(F.col("v"), SEPS).alias("x")).collect()}
    for i, (v, want) in enumerate(CASES):
        assert got[i] == want, v
        assert plain_split(v, SEPS) == want, v


def test_whole_table_against_plain_reading(spark, sf_dir):
    from matchloom.session import table

    users = table(spark, sf_dir, "table1_user")
    fields = ["desire_jd_city_id", "desire_jd_industry_id", "desire_jd_type_id", "experience"]
    want = set()
    for r in users.dropDuplicates(["user_id"]).collect():
        for f in fields:
            items = re.findall(r"\d+", r[f] or "") if f == "desire_jd_city_id" else plain_split(r[f], SEPS)
            want |= {(r["user_id"], f, i + 1, x) for i, x in enumerate(items)}
    got = [tuple(r) for r in packed.explode_packed(users, "user_id", fields).collect()]
    assert len(got) == len(set(got)) and set(got) == want


@pytest.mark.parametrize("n", [0, 3, 2000])
def test_inference_at_every_size(spark, n):
    words = [f"name{i}/part{i}" for i in range(25)]
    rows = [(str(i), ",".join(words[(i * k * k + k) % 25] for k in range(1, 6)), f"{i % 90 + 10} {i % 70 + 10}-{i % 50 + 10}") for i in range(n)]
    df = spark.createDataFrame(rows, "id string, v string, w string")
    seps = packed.infer_separators(df, ["v", "w"])
    assert "," in seps["v"] and "/" not in seps["v"] and " " not in seps["v"]
    assert n < 3 or seps["w"] is None
    assert packed.explode_packed(df, "id", ["v"]).count() == 5 * n


@pytest.mark.parametrize("times", [1, 10, 100])
def test_same_separators_as_a_noisy_table_grows(spark, times):
    """Decorated and misspelt names, and a hot text held by a third of all rows, move no verdict."""
    rng = random.Random(times)
    words = ["TCP/IP", "C/C++", "A/B", "PL/SQL", "SQL Server", "unit test", *(f"w{i}" for i in range(60))]

    def noisy(w):
        if rng.random() < 0.15:
            at = rng.randrange(len(w) + 1)
            return w[:at] + rng.choice("abcdefghijklmnop") + str(rng.randrange(10**6)) + w[at:]
        return w

    rows = []
    for i in range(100 * times):
        d = rng.choice(["|", ";", "、", "; "])
        v = "TCP/IP|C/C++;w1|w2" if i % 3 == 0 else d.join(noisy(rng.choice(words)) for _ in range(rng.randint(1, 12)))
        rows.append((str(i), v))
    df = spark.createDataFrame(rows, "id string, v string")
    seps = packed.infer_separators(df, ["v"])["v"]
    assert {"|", ";", "、"} <= set(seps) and not {"/", " ", "-"} & set(seps)


def test_a_hot_text_does_not_decide(spark):
    """A third of all rows copy one text with a mark that is rare elsewhere."""
    rng = random.Random(2)
    words = ["TCP/IP", "C/C++", "A/B", "unit test", *(f"w{i}" for i in range(60))]
    rows = []
    for i in range(6000):
        d = "\n" if rng.random() < 0.05 else rng.choice([",", "|"])
        rows.append((str(i), "w1\nTCP/IP" if i % 3 == 0 else d.join(rng.choice(words) for _ in range(rng.randint(1, 6)))))
    seps = packed.infer_separators(spark.createDataFrame(rows, "id string, v string"), ["v"])["v"]
    assert {"\n", ",", "|"} <= set(seps) and not {"/", " "} & set(seps)


def test_scores_are_shares(spark):
    df = spark.createDataFrame([(f"a{i % 7},b{i % 11},c{i % 13} d{i % 13}",) for i in range(500)], "v string")
    got = {r["sep"]: r for r in packed.separator_scores(df, ["v"]).collect()}
    assert got[","]["gaps"] == 1000 and got[" "]["gaps"] == 500
    assert got[","]["alone"] / got[","]["gaps"] == pytest.approx(2 / 3) and got[" "]["alone"] / got[" "]["gaps"] == pytest.approx(1 / 3)
    assert got[","]["varied"] / got[","]["seen"] > 0.8 and abs(got[" "]["varied"] / got[" "]["seen"]) < 0.05


def test_rows_without_key_and_clashing_columns(spark):
    df = spark.createDataFrame([(None, "a,b", 1), ("u", "a,b", 1), ("u", "a,b", 2)], "id string, v string, pos int")
    assert [tuple(r) for r in packed.explode_packed(df, "id", ["v"]).orderBy("pos").collect()] == [("u", "v", 1, "a"), ("u", "v", 2, "b")]
