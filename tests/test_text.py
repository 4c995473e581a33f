"""Scalar functions: identifiers, references, measurements, comparison, numerals, post-processing."""

import pytest
from pyspark.sql import functions as F

from sondage.functions import numerals, text


def values(spark, rows, expression, schema="v string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(expression).collect()]


def test_numerals(spark):
    assert [numerals.prose_number(x) for x in ("一百零二", "万", "一万二千", "二〇二六", "三亿五", "十")] == [102, 0, 12000, 2026, 300000005, 10]
    assert [numerals.reference_number(x) for x in ("八", "十二", "一百零二", "12", "千", "", None)] == [8, 12, 102, 12, None, None, None]
    texts = ["二十三", "十", "一二", "三", "", "百", "八", "十二", "一百零二", "12", "千", "一〇三", None]
    got = spark.createDataFrame([(x,) for x in texts], "t string").select(numerals.label_number_column(F.col("t")), numerals.reference_number_column(F.col("t"))).collect()
    assert [r[0] for r in got] == [23, 10, None, 3, None, None, 8, 12, None, None, None, None, None]
    assert [r[1] for r in got] == [numerals.reference_number(x) for x in texts] == [23, 10, 12, 3, None, 100, 8, 12, 102, 12, None, 103, None]


def test_clean_and_identifier(spark):
    raw = [" M13：9 ", "－", "无", "None", None, "ｍ1,,2,", "T3,4", "a b:c"]
    assert values(spark, raw, text.clean_value(F.col("v"))) == ["M13:9", None, None, None, None, "m1,,2,", "T3,4", "a b:c"]
    assert values(spark, raw, text.identifier(F.col("v"))) == ["M13,9", "", "", "", "", "M1,2", "T3,4", "AB,C"]
    assert values(spark, ["T3：4", "T3,4"], text.sampling_id(F.col("v"))) == ["T3,4", "T3,4"]
    assert values(spark, ["Report A.PDF", "ｒeport　a"], text.report_name(F.col("v"))) == ["reporta", "reporta"]
    assert values(spark, ["仲M4:3", "BI(M5:1)", "M1:2和M3:4", "M13：9", "M14"], text.entity_id_text(F.col("v"))) == ["m4:3", "m5:1", "", "m13:9", ""]
    assert values(spark, ["M13:9", "M1:39"], text.discovery_id(F.col("v"))) == ["m139", "m139"]


def test_similarity(spark):
    rows = [("10 厘米", "10cm"), ("", ""), ("a", ""), ("abc", "abcd"), ("tide", "diet"), (None, "x")]
    got = values(spark, rows, text.text_similarity(F.col("a"), F.col("b")), "a string, b string")
    assert got[:3] == [1.0, 1.0, 0.0] and got[3] == pytest.approx(0.9) and got[4] == 0.25 and got[5] == 0.0
    assert values(spark, [("abc", "xabcx"), ("ab", "xab")], text.fuzzy_score(F.col("a"), F.col("b")), "a string, b string")[0] == 0.94


@pytest.mark.parametrize(
    ("key", "actual", "expected", "verdict"),
    [
        ("measurements", "长10厘米、宽5.0公分", "10公分 5厘米", "matched"),
        ("measurements", "2.3 cm; 1.1 cm", "2.3, 1.1 cm", "matched"),
        ("measurements", "1 cm", "10 cm", "mismatched"),
        ("measurements", "50 mm", "5 cm", "matched"),
        ("surface_color", "红", None, "not_applicable"),
        ("surface_color", None, "红", "missing"),
        ("figure_caption", "图版十四,2；图3-2F", "图3-2F、图版十四,2", "matched"),
        ("artifact_id", "M1:5", "M1:59", "mismatched"),
        ("texture", "泥质红陶", "泥质红陶罐", "matched"),
    ],
)
def test_compare(spark, key, actual, expected, verdict):
    rows = spark.createDataFrame([(key, actual, expected)], "key string, actual string, expected string")
    assert text.compare_fields(rows, "key", "actual", "expected").first()["verdict"] == verdict


def test_references(spark):
    got = values(spark, ["见图3-4、彩版八，2 及图3-4"], text.split_references(F.col("v")))[0]
    assert got["figures"] == ["图3-4"] and got["plates"] == ["彩版八,2"]
    assert values(spark, ["彩版八，2;彩版〇一", None], text.plate_keys(F.col("v"))) == [["彩版八,2", "彩版〇一"], []]


def test_post_process(spark):
    rules = {"space_removal", "punctuation_normalization", "unit_standardization"}
    assert values(spark, [" 高  12 厘米，口径8公分。"], text.post_process(F.col("v"), rules)) == ["高 12 cm,口径8 cm."]
    rules = {"chinese_number_to_arabic", "date_formatting"}
    assert values(spark, ["共一百零二件，记录于2026年7月15日"], text.post_process(F.col("v"), rules)) == ["共102件，记录于2026-07-15"]
    assert values(spark, ["2026/1/2 2026.11.3"], text.post_process(F.col("v"), {"date_formatting"})) == ["2026-01-02 2026-11-03"]


def test_numbers_and_hashes(spark):
    assert values(spark, ["1e5", "+1", "1.", ".5", "x", None], text.typed_number(F.col("v"))) == [None, 1.0, 1.0, 0.5, None, None]
    assert values(spark, ["=1", "a", None], text.guarded(F.col("v"))) == ["'=1", "a", None]
    assert values(spark, ["", "a" * 7, "中" * 10], text.token_estimate(F.col("v"))) == [32, 34, 43]
    assert spark.range(1).select(text.signature(F.array(F.lit("b"), F.lit("a"), F.lit("a"))) == text.signature(F.array(F.lit("a"), F.lit("b")))).first()[0]
