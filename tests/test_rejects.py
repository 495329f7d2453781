import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from matchloom.operators import rejects

ID = "0123456789abcdef" * 2
GOOD = [ID, "护士 A", "护士", "530", "100", "\\N", "", "本科", "20190228", "\\N", "text"]


def line(**changed):
    row = dict(zip(rejects.COLUMNS, GOOD, strict=True)) | changed
    return "\t".join(row.values())


CASES = [
    (line(), None),
    (line() + "\r", None),
    (line(jd_title='"a ""b""\tc\n"'), None),
    (line(job_description=""), None),
    (line(job_description='"x"y'), "quoting"),
    (line(jd_title='"open'), "quoting"),
    (line(jd_title='a "b" c'), "quoting"),
    (line(jd_title='"a" '), "quoting"),
    (line() + "\t", "column_count"),
    ("", "column_count"),
    (None, "column_count"),
    (line(jd_title='"a') + '"', "column_count"),
    (line(jd_no=ID.upper()), "invalid_value"),
    (line(jd_no="\\N"), "invalid_value"),
    (line(jd_title=" 　"), "invalid_value"),
    (line(jd_sub_type="\\N"), "invalid_value"),
    (line(jd_title='""'), "invalid_value"),
    (line(jd_title="a\x00b"), "invalid_value"),
    (line(jd_title="a\nb"), "invalid_value"),
    (line(jd_sub_type="a�b"), "invalid_value"),
    (line(jd_sub_type='"a\x07b"'), "invalid_value"),
    (line(city="１２"), "invalid_value"),
    (line(city="+1"), "invalid_value"),
    (line(city="-1"), None),
    (line(min_salary="1.5"), "invalid_value"),
    (line(start_date="20190229"), "invalid_value"),
    (line(start_date="20200229"), None),
    (line(end_date="19000229"), "invalid_value"),
    (line(end_date="2019010"), "invalid_value"),
    (line(end_date="00000101"), "invalid_value"),
    ("\t".join(rejects.COLUMNS), "invalid_value"),
    (line(job_description="x" * 200_000), None),
]


@pytest.mark.parametrize(("text", "reason"), CASES)
def test_diagnosis(text, reason):
    assert rejects.diagnose(text)[1] == reason


def solved(texts):
    batch = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.string())], names=["k", "t"])
    rows = [r for out in rejects._blocks(iter([batch])) for r in out.to_pylist()]
    return {r["line_no"]: r for r in rows}


def check_against_strict(texts):
    got = solved(texts)
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        fields, reason = rejects.diagnose(t)
        assert got[i]["reason"] == reason, t
        assert [got[i][c] for c in rejects.COLUMNS] == (fields or [None] * len(rejects.COLUMNS))


def test_blocks_agree_with_the_strict_rules():
    good = [line(jd_title=f"title {i}") for i in range(700)]
    check_against_strict(good)
    check_against_strict(good[:300] + [t for t, _ in CASES] + good[300:] + ['"'] + good[:40])


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(rejects.COLUMNS), st.text(alphabet='"\t\n\r a1\\N-0 \x00', max_size=6)), min_size=33, max_size=80))
def test_blocks_agree_on_random_fields(changes):
    check_against_strict([line(**{c: v}) for c, v in changes])


def test_frames(spark):
    df = spark.createDataFrame([(1, line(), "x"), (2, "a", "y"), (2, "a", "y")], "line_no long, raw_text string, reason string")
    parsed = rejects.parse_lines(df)
    assert [tuple(r) for r in rejects.rejected(parsed).orderBy("line_no").collect()] == [(2, "column_count")] * 2
    row = rejects.loadable(parsed).first()
    assert (row["city"], row["max_salary"], str(row["start_date"]), row["end_date"]) == (530, None, "2019-02-28", None)
    assert rejects.parse_lines(df.limit(0)).count() == 0
    assert row["beyond_64_bits"] is None


def test_numbers_beyond_64_bits_are_kept(spark):
    df = spark.createDataFrame([(1, line(city="9" * 40, min_salary="-" + "1" * 25))], "line_no long, raw_text string")
    row = rejects.loadable(rejects.parse_lines(df)).first()
    assert (row["city"], row["min_salary"]) == (None, None) and row["beyond_64_bits"] == "city=" + "9" * 40 + ",min_salary=-" + "1" * 25


def test_only_isolated_lines_are_scanned(monkeypatch):
    """One bad line in thirteen, as in the tables: all others come from the bulk parse."""
    scanned = []
    plain = rejects._scanned
    monkeypatch.setattr(rejects, "_scanned", lambda t: scanned.append(t) or plain(t))
    bad = [t for t, r in CASES if r]
    texts = [bad[i // 13 % len(bad)] if i % 13 == 0 else line(jd_title=f"title {i}") for i in range(5000)]
    got = solved(texts)
    assert len(got) == 5000 and len(scanned) == sum(r["reason"] is not None for r in got.values())


def test_refused_blocks_are_bisected(monkeypatch):
    plain, calls = rejects._parsed, []

    def refusing(text):
        calls.append(len(text))
        return None if any(t.endswith("refuse") for t in text.to_pylist()) else plain(text)

    monkeypatch.setattr(rejects, "_parsed", refusing)
    texts = [line(job_description="refuse" if i in (5, 777) else "fine") for i in range(1000)]
    got = solved(texts)
    assert len(got) == 1000 and all(r["reason"] is None for r in got.values()) and calls.count(1) >= 2 and len(calls) < 60
