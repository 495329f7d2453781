import itertools
import math
import os
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import compare
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.llm import catalog, distinctive, languages, lexicon, normalize, packing, splits, topn
from matchloom.session import table

HEX = "0123456789abcdef" * 2
needs_vocabulary = pytest.mark.skipif(not os.path.exists(os.path.join(lexicon.TOKENIZERS, lexicon.VOCABULARY)), reason="no vocabulary here")


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    compare(spark, sf_dir, catalog.QUERIES[name], catalog.SQL[name])


# --- problem 1


@pytest.mark.parametrize("text", [HEX.upper(), f" {HEX}\t", f"uid:{HEX}", "{" + f"{HEX[:8]}-{HEX[8:12]}-{HEX[12:16]}-{HEX[16:20]}-{HEX[20:]}" + "}", HEX[:16] + " " + HEX[16:], HEX.translate({ord(c): chr(ord(c) + 0xFEE0) for c in HEX})])
def test_spellings(spark, text):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(splits.account(F.col("c"))).first()[0] == HEX


def test_other_ids_stay_apart(spark):
    df = spark.createDataFrame([("u1",), ("U1",), (HEX[:-1],), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(splits.account(F.col("c"))).collect()] == ["=u1", "=U1", "=" + HEX[:-1], "=", None]


@pytest.mark.parametrize("shape", ["chain", "star", "random"])
def test_components_against_union_find(spark, shape):
    rng = random.Random(5)
    edges = {"chain": [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)], "star": [("hub", f"n{i}") for i in range(200)], "random": [(f"n{rng.randrange(80)}", f"n{rng.randrange(80)}") for _ in range(60)]}[shape]
    edges += [(None, "n1"), ("n2", "n2"), edges[0], edges[0][::-1]]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a and b and a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r["node"]: r["root"] for r in splits.components(spark.createDataFrame(edges, "a string, b string"), "a", "b").collect()}
    assert got == {n: find(n) for n in parent}


def test_differencing_balances():
    rng = np.random.default_rng(1)
    loads = []
    for w in rng.integers(1, 1000, 500):
        x = np.zeros(10)
        x[0] = w
        loads.append(x)
    total = np.zeros(10)
    for x, p in zip(loads, splits.differencing(loads), strict=True):
        np.add.at(total, p, x)
    assert total.sum() == sum(x.sum() for x in loads) and total.max() - total.min() <= 2


def test_blocks_are_joined_in_levels(spark):
    rng = random.Random(9)
    w = {f"c{i}": rng.choice([1, 2, 5, 40]) for i in range(3000)} | {"hot": 400}
    df = spark.createDataFrame(list(w.items()), "component string, weight long")
    got = splits.balance(df, bins=20, block=100, fan=4).collect()
    assert {r["component"] for r in got} == set(w) and len(got) == len(w)
    load, of_bin = Counter(), {}
    for r in got:
        load[r["bin"]] += w[r["component"]]
        assert of_bin.setdefault(r["bin"], r["split"]) == r["split"]
    hot = load.pop(next(r["bin"] for r in got if r["component"] == "hot"))
    assert max(load.values()) - min(load.values()) <= 40 and len(load) == 19 and hot < min(load.values()) + 400
    size = Counter()
    for r in got:
        size[r["split"]] += w[r["component"]]
    assert abs(size["train"] / sum(size.values()) - 0.8) < 0.03


def test_splits_with_a_hot_user(spark):
    rows = [("hot", i) for i in range(400)] + [(f"u{i % 300}", i) for i in range(800)] + [(None, 1), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "user_id string, split int")
    links = spark.createDataFrame([("u1", "u2"), ("u2", "x"), ("x", "u3"), ("u4", None)], "a string, b string")
    by = splits.related_splits(df, "user_id", links, "a", "b")
    held = {r["user_id"]: r for r in by.collect()}
    assert len(held) == 301 and held["u1"]["component"] == held["u2"]["component"] == held["u3"]["component"] != held["u4"]["component"]
    size = Counter()
    for r in held.values():
        size[r["split"]] += r["n_rows"]
    assert abs(size["train"] - 960) <= 60 and abs(size["test"] - 120) <= 40
    assert {tuple(r) for r in splits.sharing_pairs(by, "user_id").collect()} == {("u1", "u2"), ("u1", "u3"), ("u2", "u3")}
    out = splits.assign_rows(df, "user_id", by)
    assert out.count() == len(rows) and out.where("split is null").count() == 0
    assert out.where("user_id is null").select("split").distinct().count() <= 2
    none = splits.related_splits(df.limit(0), "user_id", links.limit(0), "a", "b")
    assert none.count() == 0


# --- problem 2

FORMS = [
    ("Јava开发", "Java开发"), ("ＥＲР", "ERP"), ("oﬀеr", "offer"), ("Técnісo", "Técnico"), ("护⼠", "护士"), ("⻔店", "门店"),
    ("预﻿算​", "预算"), ("a b　c", "a b c"), ("e​́", "é"), ("물", "물"), ("理", "理"),
    ("разрaботчик", "разработчик"), ("，；｜（Ａ）", ",;|(A)"), ("Инженер по", "Инженер по"), ("a  b\t\n", "a  b\t\n"), ("、。", "、。"),
    ("Kỹ sư", "Kỹ sư"), ("Qualita\u0308tspr\u00fcfung".replace("a\u0308", "\u0430\u0308"), "Qualitätsprüfung"), ("", ""), (None, None), ("x" * 100_000 + "​", "x" * 100_000),
]


FORMS += [
    ("հello", "hello"), ("Ꭰata", "Data"), ("ꓐig", "Big"), ("ʙig", "big"), ("ᴀb", "ab"), ("工程ニ", "工程二"), ("エ程师", "工程师"), ("能カ", "能力"), ("人ロ", "人口"),
    ("三カ月", "三カ月"), ("プ口グラム", "プログラム"), ("デ一タ入力", "データ入力"), ("データ入口", "データ入口"), ("Հայերեն", "Հայերեն"), ("ᎠᎡ", "ᎠᎡ"), ("ﾌﾟﾛ", "プロ"),
]


@pytest.mark.parametrize(("text", "form"), FORMS)
def test_forms(text, form):
    assert normalize.consistent(text) == form
    assert normalize.consistent(form) == form


def test_every_character_settles():
    for c in itertools.chain(range(0x20, 0xD800), range(0xE000, 0x1D100), range(0x1D400, 0x30000)):
        t = normalize.consistent(f"x{chr(c)}y")
        assert normalize.consistent(t) == t and unicodedata.is_normalized("NFC", t), hex(c)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aeіо̧́​물Ａ理 中⼠", max_size=20))
def test_splicing_equals_whole_normalization(s):
    whole = "".join(c for c in s if c != "​")
    whole = unicodedata.normalize("NFC", "".join(normalize.RADICAL_OF.get(c) or (unicodedata.normalize("NFKC", c) if c in "Ａ理⼠" else c) for c in whole))
    assert normalize.consistent(s) == normalize._MIXED.sub(normalize._word, whole)


def test_quick_check_misses_nothing():
    import regex

    quick = regex.compile(normalize._QUICK)
    sample = [*map(chr, itertools.chain(range(0x20, 0xD800), range(0xE000, 0x30000)))]
    plain = regex.compile(normalize._PLAIN)
    assert all(plain.search(c) for c in sample if quick.search(c))
    for c in sample:
        assert quick.search(c) or normalize.consistent(c) == c, hex(ord(c))
    near = [c for c in sample if not quick.search(c)][:: 7] + list("aАеoӏı工エー力カプ一")
    rng = random.Random(4)
    for _ in range(60_000):
        t = "".join(rng.choice(near) for _ in range(4))
        assert (plain.search(t) and quick.search(t)) or normalize.consistent(t) == t, t


def test_form_columns(spark, sf_dir):
    jobs = table(spark, sf_dir, "table2_jd")
    for r in normalize.forms(jobs, "jd_no", ["jd_title", "jd_sub_type"]).collect():
        assert r["form"] == normalize.consistent(r["value"])
    df = spark.createDataFrame([("k", "Ａ", "z"), ("k", "Ａ", "z"), ("m", None, "z"), (None, "Ａ", "z")], "id string, v string, form string")
    assert [tuple(r) for r in normalize.changed(normalize.forms(df, "id", ["v"])).collect()] == [("k", "v")]


# --- problem 4


def test_cases_against_brute_force(spark, sf_dir):
    docs = defaultdict(Counter)
    for r in catalog._term_lists(spark, sf_dir).collect():
        for t in r["items"] or ():
            if r["rec_id"] and t.strip():
                docs[r["field_name"], r["rec_id"]][t.strip().lower()] += 1
    n, d = Counter(f for f, _ in docs), Counter((f, t) for (f, _), c in docs.items() for t in c)
    want = set()
    for (f, k), c in docs.items():
        s = sorted(((x * math.log(n[f] / d[f, t]), t) for t, x in c.items()), reverse=True)
        if len(s) > 1 and s[0][0] > s[1][0] and s[0][0] >= 2 * s[1][0]:
            want.add((k, f, s[0][1]))
    assert {tuple(r) for r in catalog.p4_found(spark, sf_dir).collect()} == want


def recs_of(spark, rows):
    """Records from rows of (rec_id, field_name, term, c)."""
    return distinctive.records(spark.createDataFrame([(r, f, [t] * c) for r, f, t, c in rows], "rec_id string, field_name string, items array<string>"))


def test_probabilities(spark):
    rows = [(f"r{i}", "f", "common", 1) for i in range(50)] + [("r0", "f", "rare", 1), ("r1", "f", "own", 3)]
    got = {(r["rec_id"], r["term"]): r for r in distinctive.distinctive_terms(recs_of(spark, rows)).collect()}
    assert got["r0", "rare"]["place"] == 1 and got["r1", "own"]["place"] == 1 and got["r5", "common"]["probability"] == pytest.approx(1)
    assert got["r0", "rare"]["probability"] + got["r0", "common"]["probability"] == pytest.approx(1)
    assert (got["r0", "rare"]["d"], got["r0", "common"]["d"], got["r0", "rare"]["n"]) == (1, 50, 50)
    assert got["r5", "common"]["others"] is None and got["r0", "common"]["others"] == got["r0", "rare"]["score"]
    empty = distinctive.records(spark.createDataFrame([(None, "f", ["x"]), ("r", "f", [None]), ("r", "f", [""]), ("r", "f", None)], "rec_id string, field_name string, items array<string>"))
    assert distinctive.standing_out(distinctive.distinctive_terms(empty)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.tuples(st.integers(1, 9), st.floats(1e-6, 0.3)), min_size=1, max_size=8), min_size=1, max_size=6))
def test_rounds_approach_the_fixed_point(model):
    c = np.array([x for r in model for x, _ in r], float)
    back = np.array([q for r in model for _, q in r])
    size = np.array([len(r) for r in model])
    start = np.cumsum(size) - size
    got = distinctive.converged(c, back, start)
    want = distinctive._fixed_point(c, back, np.repeat(np.arange(len(size)), size))
    assert np.abs(np.add.reduceat(got, start) - 1).max() < 1e-6 and np.abs(np.add.reduceat(want, start) - 1).max() < 1e-9
    assert np.abs(got - want).max() < 1e-2
    alone = [distinctive.converged(c[a : a + n], back[a : a + n], np.array([0])) for a, n in zip(start, size, strict=True)]
    assert np.abs(np.concatenate(alone) - got).max() < 1e-12  # sums of other lengths may round otherwise


def test_cases_of_random_collections_are_leaders():
    """Whatever stands out by the score is among the first places of the model."""
    rng, places = random.Random(1), []
    for _ in range(400):
        vocabulary, most, longest = rng.randint(3, 60), rng.choice([1, 2, 4, 10]), rng.choice([3, 8, 20, 40])
        share = [1 / (i + 1) ** rng.choice([0, 1, 1.5]) for i in range(vocabulary)]
        recs = [Counter() for _ in range(rng.randint(5, 60))]
        for r in recs:
            for t in rng.choices(range(vocabulary), share, k=rng.randint(1, longest)):
                r[t] += rng.randint(1, most)
        d, cf = Counter(t for r in recs for t in r), sum(recs, Counter())
        for r in recs:
            c, back = np.array([*r.values()], float), 0.9 * np.array([cf[t] for t in r], float) / cf.total()
            score = c * np.log(len(recs) / np.array([d[t] for t in r]))
            first, second = [*np.argsort(-score), 0][:2]
            if len(r) > 1 and score[first] > score[second] and score[first] >= 2 * score[second]:
                p = distinctive.converged(c, back, np.array([0]))
                places.append(1 + int((p > p[first] + 1e-12).sum()))
    assert len(places) > 1000 and max(places) <= distinctive.LEADERS


def test_records_across_batches():
    import pyarrow as pa

    rows = [(f"r{i}", "f", f"t{j}", 1 + j % 2, 1, 2) for i in range(7) for j in range(1 + i * 3 % 5)]
    names = ["rec_id", "field_name", "term", "c", "d", "cf"]

    def run(step):
        batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[a : a + step]]) for a in range(0, len(rows), step)]
        return [r for b in distinctive._em({"f": 40}, {"f": 7}, None)(iter(batches)) for r in b.to_pylist()]

    assert run(1) == run(2) == run(5) == run(100) and len(run(3)) == len(rows)


def test_large_term_tables_are_joined_by_shuffle(spark, monkeypatch):
    rng = random.Random(8)
    recs = recs_of(spark, [(f"r{i}", rng.choice("fg"), f"t{rng.randrange(60)}", rng.randint(1, 3)) for i in range(80) for _ in range(6)])
    show = lambda: sorted((r["rec_id"], r["field_name"], r["place"], r["term"], r["c"], r["d"], round(r["probability"], 9)) for r in distinctive.distinctive_terms(recs).collect())
    small = show()
    monkeypatch.setattr(distinctive, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(distinctive, "HEAVY", 30)
    assert show() == small


def test_the_model_decides_the_leaders(spark, sf_dir, monkeypatch):
    """Without expectation-maximisation terms rank by their counts, and cases are missed."""
    recs = catalog._records(spark, sf_dir)
    found = {tuple(r) for r in distinctive.standing_out(distinctive.distinctive_terms(recs), leaders=1).collect()}
    ranked = distinctive.distinctive_terms(recs).toPandas()
    flat = ranked.sort_values(["field_name", "rec_id", "c", "term"], ascending=[True, True, False, True]).groupby(["field_name", "rec_id"]).head(1)
    plain = flat[(flat.score > flat.others) & (flat.score >= 2 * flat.others)]
    assert found and found > set(zip(plain.rec_id, plain.field_name, plain.term, strict=True))


# --- problem 5


def test_top_items(spark):
    rng = random.Random(2)
    rows = [("hot", f"j{i:04}", rng.choice([None, 0, 1])) for i in range(3000)] + [(f"g{rng.randrange(40)}", f"j{rng.randrange(9)}", rng.choice([None, 0, 1])) for _ in range(600)]
    rows += [(None, "j1", 1), ("g1", None, 1)]
    df = spark.createDataFrame(rows, "g string, i string, position int").repartition(7)
    got = {(r["g"], r["i"], r["position"]) for r in topn.top_n(df, "g", "i", [(F.col("position"), -1)], 5).collect()}
    wide = topn.top_n(df.withColumn("w", F.col("position").cast("bigint")), "g", "i", [(F.col("w"), -1), (F.lit(0), 0)], 5)
    assert {tuple(r) for r in wide.collect()} == got
    signs = spark.createDataFrame([("g", "a", -5, -7), ("g", "b", -5, 7), ("g", "c", 0, -9), ("g", "d", None, 0)], "g string, i string, s int, t int")
    ranked = topn.top_n(signs, "g", "i", [(F.col("s"), -1), (F.col("t"), -1)], 9).orderBy("position").collect()
    assert [r["i"] for r in ranked] == ["c", "d", "b", "a"]
    best = {}
    for g, i, s in rows:
        if g and i:
            best[g, i] = max(best.get((g, i), -1), -1 if s is None else s)
    want, groups = set(), defaultdict(list)
    for (g, i), s in best.items():
        groups[g].append((-s, i))
    for g, xs in groups.items():
        want |= {(g, i, k + 1) for k, (_, i) in enumerate(sorted(xs)[:5])}
    assert got == want
    assert topn.top_n(df.limit(0), "g", "i", [(F.col("position"), -1)], 5).count() == 0


# --- problem 7

TEXTS = ["", " ", "\n\n  a", "don't  stop", "招聘" * 40, "🙂👩‍💻", "<|endoftext|> [pad]", "a" * 30_000, "Größe 12345 naïve", " x y\r\n\tz", "'s 'S"]


@needs_vocabulary
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_merging_equals_the_public_encoder(text):
    assert [i for w in lexicon._WORD.findall(text) for i in lexicon.merged(w.encode(), _ranks())] == _public().encode_ordinary(text)


_held = {}


def _ranks():
    return _held.setdefault("ranks", None) or _held.update(ranks=lexicon.ranks_of()) or _held["ranks"]


def _public():
    import tiktoken

    if "enc" not in _held:
        _held["enc"] = tiktoken.Encoding("own", pat_str=lexicon.PATTERN, mergeable_ranks=_ranks(), special_tokens={})
    return _held["enc"]


def test_automaton_accepts_its_words_only(tmp_path):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 7))).encode() for _ in range(800)})
    ids = [[i, i + 1][: 1 + i % 2] for i in range(len(words))]
    path = tmp_path / "x.bin"
    path.write_bytes(lexicon.compiled(words, ids))
    lex = lexicon.Lexicon(str(path))
    assert lex.numbers(words).tolist() == list(range(len(words)))
    other = [w for w in (bytes(x) for x in itertools.product(b"abcde", repeat=4)) if w not in set(words)]
    assert set(lex.numbers(other).tolist()) == {-1}
    path.write_bytes(lexicon.compiled([], []))
    assert lexicon.Lexicon(str(path)).numbers([b"a"]).tolist() == [-1]


@needs_vocabulary
def test_encoding_of_a_corpus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(10**9 + i, t) for i, t in enumerate([*TEXTS, None])] + [(10**9, "")], "doc_id long, text string")
    docs = docs.union(extra)
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = lexicon.encode(docs).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["ids"] == _public().encode_ordinary(text[r["doc_id"]] or "")
    assert {r["doc_id"]: r["n_tokens"] for r in lexicon.token_counts(docs).collect()} == {r["doc_id"]: len(r["ids"]) for r in rows}
    assert lexicon.encode(docs.limit(0)).count() == 0


# --- problem 8


@pytest.mark.parametrize("capacity", [1, 7, 64, 130, 1000])
def test_plans_hold_every_item(capacity):
    rng = np.random.default_rng(capacity)
    hist = np.bincount(np.minimum(rng.geometric(min(1, 6 / capacity), 4000), capacity), minlength=capacity + 1)
    kinds = packing.planned(hist)
    held = np.zeros(capacity + 1, int)
    for k in kinds:
        used = sum(n * m for n, m in k.parts.items())
        assert used <= capacity and used + k.room == capacity and k.count > 0
        for n, m in k.parts.items():
            held[n] += m * k.count
    assert (held[1:] == hist[1:]).all()
    tokens = int((np.arange(capacity + 1) * hist).sum())
    assert sum(k.count for k in kinds) <= -(-tokens // capacity) * 1.03 + 1


def test_containers(spark):
    rng = random.Random(8)
    rows = [(i, rng.choice([0, None, 5, 17, 17, 17, 40, 99, 100, 101, 350])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens int").repartition(5)
    budgets = spark.createDataFrame([("a", 100), ("b", 128), ("none", None), ("zero", 0)], "budget_name string, capacity_tokens int")
    placed = packing.fill_containers(df, "doc_id", "n_tokens", budgets)
    by = defaultdict(list)
    for r in placed.collect():
        by[r["budget_name"], r["doc_id"]].append(r)
    load = Counter()
    for name, cap in (("a", 100), ("b", 128)):
        for i, n in rows:
            pieces = sorted(by[name, i], key=lambda r: r["piece_no"])
            assert [p["piece_no"] for p in pieces] == list(range(max(1, -(-(n or 0) // cap))))
            at = 0
            for p in pieces:
                assert p["start_token"] == at
                at += p["n_tokens"]
                load[name, p["container_id"]] += p["n_tokens"]
            assert at == (n or 0)
        ids = {c for b, c in load if b == name}
        assert ids == set(range(len(ids))) and max(v for (b, _), v in load.items() if b == name) <= cap
    assert {b for b, _ in by} == {"a", "b"}
    assert sorted(map(tuple, placed.collect())) == sorted(map(tuple, packing.fill_containers(df.repartition(3), "doc_id", "n_tokens", budgets).collect()))
    assert packing.fill_containers(df.limit(0), "doc_id", "n_tokens", budgets).count() == 0
    assert packing.fill_containers(df, "doc_id", "n_tokens", budgets.limit(0)).count() == 0


def test_many_budgets_and_large_capacities(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice([3, 7, 40, 90]) if i else 3_000_000) for i in range(60)]
    caps = [(f"b{i}", c) for i, c in enumerate([10, 11, 12, 13, 14, 15, 16, 17, 18, 1 << 21])]
    placed = packing.fill_containers(spark.createDataFrame(rows, "doc_id long, n_tokens long"), "doc_id", "n_tokens", spark.createDataFrame(caps, "budget_name string, capacity_tokens int"))
    load = {(r["budget_name"], r["container_id"]): r["t"] for r in placed.groupBy("budget_name", "container_id").agg(F.sum("n_tokens").alias("t")).collect()}
    whole = sum(n for _, n in rows)
    for name, cap in caps:
        own = [t for (b, _), t in load.items() if b == name]
        assert sum(own) == whole and max(own) <= cap


# --- problem 9

SAID = {
    "en": ["The company offers a health check and paid holidays.", "Please send the report before Friday.", "They left because the family moved away.", "Nothing can go on without the contract."],
    "de": ["Die Firma bietet Vorsorge und bezahlten Urlaub.", "Bitte schicken Sie den Bericht vor dem Freitag.", "Wir suchen einen Prüfer mit viel Erfahrung.", "Ohne den Vertrag geht es nicht weiter."],
    "fr": ["L'entreprise propose des congés payés et un bilan.", "Nous cherchons un chef de dépôt avec expérience.", "Le problème du contrat est réglé, merci.", "Rien ne peut avancer sans le devis."],
    "es": ["La empresa ofrece vacaciones pagadas y revisión médica.", "Buscamos un jefe de obra con mucha experiencia.", "El problema del contrato ya está resuelto, gracias.", "Nada puede seguir sin el presupuesto."],
    "pt": ["A empresa oferece férias pagas e exame de saúde.", "Procuramos um gerente com muita experiência.", "O problema do contrato já está resolvido, obrigado.", "Nada pode continuar sem o orçamento, não."],
    "ru": ["Мы ищем человека с опытом работы.", "Пока не готов отчёт, дальше идти нельзя."],
    "ja": ["この仕事に興味がある方は、ぜひご連絡ください。", "今年の契約書は去年よりずっと複雑です。"],
    "zh": ["我们更看重态度，而不是学历。", "今年的合同比去年复杂得多，大家都很忙。"],
}


def corpus():
    rows, no = [], 0
    for lang, xs in SAID.items():
        for k in range(14):
            rows.append((no, f"{xs[k % len(xs)]} {xs[(k + 1) % len(xs)]}", lang))
            no += 1
    return rows


def test_segments(spark):
    cases = [
        (1000, f"{SAID['en'][0]} {SAID['en'][1]}\n{SAID['zh'][0]}", "en"), (1001, SAID["fr"][0], "es"), (1002, "任职要求：\n1. " + SAID["zh"][1], "zh-CN"),
        (1003, f"{SAID['es'][1]} {SAID['pt'][1]} {SAID['es'][2]}", "es"), (1004, "#42\n*** 🙂", None), (1005, None, "en"), (1006, "", "??"), (1007, SAID["ru"][0], None),
        (1008, "About us:\n• " + SAID["de"][2], "German"), (1009, "候选人曾在Vendreya公司带领10人的团队。", "zh_Hans"), (1010, SAID["en"][3], " "), (1011, "<|endoftext|>", "xx"),
    ]
    df = spark.createDataFrame(corpus() + cases, "doc_id long, text string, lang string")
    found = defaultdict(list)
    for r in languages.mislabelled(languages.language_segments(df)).orderBy("doc_id", "seg_no").collect():
        assert r["seg_no"] == len(found[r["doc_id"]]) + 1
        found[r["doc_id"]].append(r["seg_lang"])
    assert dict(found) == {1000: ["en", "zh"], 1001: ["fr"], 1003: ["es", "pt", "es"], 1007: ["ru"], 1010: ["en"]}


def test_labels(spark):
    names = [("zh_Hans", "zh"), ("EN-us ", "en"), ("Portuguese", "pt"), ("ger", "de"), ("und", None), ("", None), (None, None), ("??", None), ("pt-BR", "pt")]
    df = spark.createDataFrame([(a,) for a, _ in names], "c string")
    assert [r[0] for r in df.select(languages.label_code(F.col("c"))).collect()] == [b for _, b in names]


def test_without_labels_scripts_decide(spark):
    df = spark.createDataFrame([(1, SAID["zh"][0], None), (2, SAID["ru"][0], None)], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["seg_lang"] for r in languages.language_segments(df).collect()} == {1: "zh", 2: "ru"}
    assert languages.language_segments(df.limit(0)).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    docs = table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents")
    half = languages.labelled_sample(docs.where("pmod(xxhash64(text), 2) = 0"), "text", "lang")
    other = languages.labelled_sample(docs.where("pmod(xxhash64(text), 2) = 1"), "text", "lang")
    weights, right, total = languages.fitted(half), 0, 0
    for lang, xs in other.items():
        if xs:
            best = languages._evidence(weights, xs).argmax(1)
            right += sum(languages.LANGUAGES[b] == lang for b in best)
            total += len(xs)
    assert right / total > 0.95


#: Sentences unlike all of the sample.
FREE = {
    "en": [
        "What a nurse does here",
        "What a sales manager does here",
        "What a recruiter does here",
        "We are looking for an experienced engineer to join our team.",
        "You will design services and lead projects.",
        "Applicants must hold a valid driving licence.",
        "Our office sits next to the river and is easy to reach by train.",
        "I have been working in finance since 2015.",
        "Responsible for quality control of incoming goods.",
        "Travel expenses will be reimbursed within two weeks.",
        "Fluent spoken German is an advantage but not required.",
        "Send your resume and a short cover letter.",
        "He was promoted twice in three years.",
        "Strong attention to detail and good organisational skills.",
        "The role reports directly to the chief financial officer.",
        "Managed a budget of 2 million euros.",
        "Do you enjoy solving difficult problems?",
        "Part time work is possible after six months.",
    ],
    "de": [
        "Wir suchen einen erfahrenen Ingenieur für unser Team.",
        "Du entwirfst Dienste und leitest Projekte.",
        "Ein gültiger Führerschein ist Voraussetzung.",
        "Unser Büro liegt direkt am Fluss und ist gut mit der Bahn zu erreichen.",
        "Seit 2015 arbeite ich im Finanzwesen.",
        "Verantwortlich für die Qualitätskontrolle der eingehenden Waren.",
        "Reisekosten werden innerhalb von zwei Wochen erstattet.",
        "Fließendes Englisch ist von Vorteil, aber keine Bedingung.",
        "Senden Sie uns Ihren Lebenslauf und ein kurzes Anschreiben.",
        "Er wurde in drei Jahren zweimal befördert.",
        "Sorgfalt und gute Organisation zeichnen Sie aus.",
        "Die Stelle berichtet direkt an den Finanzvorstand.",
        "Verwaltung eines Budgets von 2 Millionen Euro.",
        "Lösen Sie gerne schwierige Aufgaben?",
        "Teilzeit ist nach sechs Monaten möglich.",
    ],
    "fr": [
        "Nous recherchons un ingénieur expérimenté pour rejoindre notre équipe.",
        "Vous concevrez des services et dirigerez des projets.",
        "Le permis de conduire est obligatoire.",
        "Notre bureau se trouve au bord de la rivière, près de la gare.",
        "Je travaille dans la finance depuis 2015.",
        "Responsable du contrôle de la qualité des marchandises.",
        "Les frais de déplacement sont remboursés sous deux semaines.",
        "La maîtrise de l'anglais est un atout mais pas une obligation.",
        "Envoyez votre CV et une courte lettre de motivation.",
        "Il a été promu deux fois en trois ans.",
        "Rigueur et sens de l'organisation sont indispensables.",
        "Le poste est rattaché au directeur financier.",
        "Gestion d'un budget de 2 millions d'euros.",
        "Aimez-vous résoudre des problèmes difficiles ?",
        "Le temps partiel est possible après six mois.",
    ],
    "es": [
        "Buscamos un ingeniero con experiencia para nuestro equipo.",
        "Diseñarás servicios y dirigirás proyectos.",
        "Es obligatorio tener carné de conducir.",
        "Nuestra oficina está junto al río y cerca de la estación.",
        "Trabajo en finanzas desde el año 2015.",
        "Responsable del control de calidad de las mercancías.",
        "Los gastos de viaje se reembolsan en dos semanas.",
        "El inglés fluido es una ventaja pero no un requisito.",
        "Envíe su currículum y una carta breve.",
        "Fue ascendido dos veces en tres años.",
        "Atención al detalle y buena organización.",
        "El puesto depende directamente del director financiero.",
        "Gestión de un presupuesto de 2 millones de euros.",
        "¿Te gusta resolver problemas difíciles?",
        "La jornada parcial es posible después de seis meses.",
    ],
    "pt": [
        "Procuramos um engenheiro experiente para a nossa equipe.",
        "Você vai desenhar serviços e liderar projetos.",
        "É obrigatório ter carteira de motorista.",
        "O nosso escritório fica perto do rio e da estação.",
        "Trabalho na área de finanças desde 2015.",
        "Responsável pelo controle de qualidade das mercadorias.",
        "As despesas de viagem são reembolsadas em duas semanas.",
        "Inglês fluente é uma vantagem, mas não é exigido.",
        "Envie o seu currículo e uma carta breve.",
        "Foi promovido duas vezes em três anos.",
        "Atenção aos detalhes e boa organização.",
        "O cargo responde diretamente ao diretor financeiro.",
        "Gestão de um orçamento de 2 milhões de euros.",
        "Você gosta de resolver problemas difíceis?",
        "O trabalho a tempo parcial é possível depois de seis meses.",
    ],
    "ru": [
        "Мы ищем опытного инженера в нашу команду.",
        "Вы будете проектировать сервисы.",
        "Отправьте резюме и краткое письмо.",
    ],
    "zh": [
        "我们正在寻找一位经验丰富的工程师加入团队。",
        "你将负责设计服务并领导项目。",
        "必须持有有效的驾驶执照。",
        "公司位于河边，交通便利。",
        "自2015年起从事金融工作。",
        "负责进货的质量检查。",
        "差旅费将在两周内报销。",
        "英语流利者优先。",
        "请发送简历和求职信。",
        "三年内晋升两次。",
        "注重细节，组织能力强。",
        "该职位直接向财务总监汇报。",
    ],
    "ja": [
        "経験豊富なエンジニアを募集しています。",
        "サービスの設計とプロジェクトの管理を担当します。",
        "有効な運転免許証が必要です。",
        "東京都港区勤務。経験者優遇。",
        "2015年から金融業界で働いています。",
        "入荷品の品質検査を担当。",
        "交通費は二週間以内に支給されます。",
        "英語が話せる方は歓迎します。",
        "履歴書と志望動機をお送りください。",
        "土日祝日休み。",
        "三年間で二回昇進しました。",
        "経理部長に直接報告します。",
    ],
}


@pytest.fixture(scope="module")
def machines(spark, sf_dir):
    return languages.fitted(languages.labelled_sample(table(spark, sf_dir.replace("sf0.001", "sf0.01"), "documents"), "text", "lang"))


def segmented(weights, texts):
    import pyarrow as pa

    out = [[] for _ in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array([None] * len(texts), pa.string())], ["k", "t", "c"])
    for got in languages._segment(weights)(iter([batch])):
        for r in got.to_pylist():
            out[r["key"]].append(r["seg_lang"])
    return out


def test_free_text_is_told(machines):
    pairs = [(x, s) for x, ss in FREE.items() for s in ss]
    best = languages._evidence(machines, [languages._cleaned(s) for _, s in pairs]).argmax(1)
    assert sum(languages.LANGUAGES[b] == x for b, (x, _) in zip(best, pairs, strict=True)) / len(pairs) > 0.95


def test_free_text_in_documents(machines):
    """Documents of one to three languages in sentences that no template of the sample has."""
    rng = random.Random(3)
    texts, want = [], []
    for _ in range(600):
        langs = [rng.choice(list(FREE))] if rng.random() < 0.6 else rng.sample(list(FREE), rng.choice([2, 3]))
        texts.append("\n".join(("" if x in ("zh", "ja") else " ").join(rng.sample(FREE[x], rng.randint(1, min(4, len(FREE[x]))))) for x in langs))
        want.append(langs)
    got = segmented(machines, texts)
    single = [g == w for g, w in zip(got, want, strict=True) if len(w) == 1]
    assert sum(single) / len(single) > 0.97
    assert sum(g == w for g, w in zip(got, want, strict=True)) / len(want) > 0.95


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("We are looking for an experienced engineer to join our team. You will design services and lead projects.", ["en"]),
        ("The trial period is 3 months. We offer a health check.\n我们正在寻找一位经验丰富的工程师加入团队", ["en", "zh"]),
        ("The trial period is 3 months. We offer a health check.\nDie Stelle ist ab sofort in Vollzeit zu besetzen", ["en", "de"]),
        ("東京都港区勤務。経験者優遇。", ["ja"]),
        ("Notes sur l'entretien pour le poste\nWe are looking for people. They work here.", ["en"]),
        ("Was wir bieten:\nThe trial period is 3 months.", ["en"]),
        ("软件工程师 Java", ["zh"]),
    ],
)
def test_lines_without_a_closing_mark(machines, text, want):
    assert segmented(machines, [text]) == [want]


def test_copies_do_not_fill_the_sample(spark, monkeypatch):
    monkeypatch.setattr(languages, "SAMPLE_DOCS", 60)
    rows = corpus() + [(10_000 + i, SAID["en"][0] + " copy", "fr") for i in range(3000)]
    sample = languages.labelled_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "text", "lang")
    assert all(sample[x] for x in ("en", "de", "fr", "es", "pt", "ja", "zh"))
