import json

from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from sievewatch.functions import severity, text


def column(spark, values, expr, ddl="v STRING"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], ddl).select(expr).collect()]


def test_title_case_matches_python(spark):
    words = ["command and control", "o'neil x1y", "ÉCOLE été", "a--b", "", "x.y_z", "Already Done"]
    assert column(spark, words, text.title_case("v")) == [w.title() for w in words]


def test_capitalise_words_keeps_other_letters(spark):
    got = column(spark, ["authentication failed", "mySQL-x 9a", "a_b"], text.capitalise_words("v"))
    assert got == ["Authentication Failed", "MySQL-X 9a", "A_b"]


def test_strip_and_parse_int(spark):
    values = [" \t\n x y \x1f", " z　", "\x85q"]
    assert column(spark, values, text.py_strip("v")) == [v.strip() for v in values]
    assert column(spark, ["12abc", " -7", "x", "", None, "9.9"], text.js_parse_int("v")) == [
        12, -7, None, None, None, 9,
    ]


def test_first_truthy_skips_empty_but_not_in_last_place(spark):
    df = spark.createDataFrame([("", "b"), (None, ""), ("a", "b")], "x STRING, y STRING")
    assert [r[0] for r in df.select(text.first_truthy("x", "y")).collect()] == ["b", "", "a"]


def test_iso_timestamp_forms(spark):
    got = column(
        spark, ["2024-05-30T14:22:01.000Z", "2024-05-30T16:22:01.000+0200", "nonsense"],
        F.unix_timestamp(text.iso_timestamp("v")),
    )
    assert got == [1717078921, 1717078921, None]


JSON_DDL = "v STRUCT<s: STRING, n: INT, f: DOUBLE, a: ARRAY<STRING>, o: STRUCT<b: BOOLEAN, e: ARRAY<INT>>>"


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=12), min_size=1,
                max_size=6))
def test_python_json_matches_json_dumps(spark, texts):
    rows = [({"s": t, "n": i, "f": i + 0.5, "a": [t, "x"], "o": {"b": True, "e": []}},)
            for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, JSON_DDL)
    got = [r[0] for r in df.select(text.python_json("v", df.schema["v"].dataType)).collect()]
    want = [json.dumps(r[0], indent=2) for r in rows]
    assert got == want


def test_python_json_null_and_repr(spark):
    df = spark.createDataFrame(
        [({"s": None, "n": None, "f": 1.0, "a": ["it's", 'q"', "\\"], "o": None},)], JSON_DDL
    )
    dtype = df.schema["v"].dataType
    value = {"s": None, "n": None, "f": 1.0, "a": ["it's", 'q"', "\\"], "o": None}
    assert df.select(text.python_json("v", dtype)).first()[0] == json.dumps(value, indent=2)
    assert df.select(text.python_repr("v", dtype)).first()[0] == repr(value)


def test_severity_scales(spark):
    levels = [15, 12, 11, 8, 7, 4, 3, 0]
    got = column(spark, levels, severity.queue_band("v"), "v INT")
    assert got == ["CRITICAL"] * 2 + ["HIGH"] * 2 + ["MEDIUM"] * 2 + ["LOW"] * 2
    assert column(spark, ["x", None, "9x"], severity.queue_band("v")) == ["LOW", "LOW", "HIGH"]
    got = column(spark, [10.0, 8.8, 4.0, 3.9, None], severity.cvss_text("v"), "v DOUBLE")
    assert got == [
        "10.0/10 — CRITICAL (immediate action required)", "8.8/10 — HIGH (urgent attention needed)",
        "4.0/10 — MEDIUM (schedule remediation)", "3.9/10 — LOW (monitor)",
        "No CVSS score available",
    ]
