"""Record helpers on literal rows."""

import pytest
from pyspark.sql import functions as F

from sondage.operators import records as r


def one(spark, expression, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(expression).first()[0]


@pytest.mark.parametrize(("a", "b", "same"), [("M1:6", "M1:6", True), ("T03021:01", "T0302:01", True), ("M1:5", "M1:59", False), ("M13:9", "M1:39", False)])
def test_ids(spark, a, b, same):
    assert one(spark, r.ids_compatible(F.col("a"), F.col("b")), a=a, b=b) is same


def test_text_helpers(spark):
    assert one(spark, r.missing_colon(F.col("a"), F.col("b")), a="M02:2", b="M022") and not one(spark, r.missing_colon(F.col("a"), F.col("b")), a="M13:9", b="M139")
    assert one(spark, r.balanced_parentheses(F.col("a")), a="罐（图一") is False
    assert one(spark, r.last_visual_parenthesis(F.col("a")), a="罐（图一）碗(残)（图二）") == "图二"
    got = one(spark, r.prose_measurements(F.col("a")), a="口径 8、底径 4.5厘米，高12.0 cm")
    assert [(m["name"], list(m["amounts"])) for m in got][-1] == ("高", ["12.0"])
    assert one(spark, r.scoped_paragraph(F.col("a"), F.col("b")), a="x M1:2 red pot M1:3 cup", b="M1:2") == "M1:2 red pot "
    assert one(spark, r.byte_size(F.col("a")), a=1536) == "1.5 KB" and one(spark, r.display_id(F.col("a")), a="M1 , 2") == "M1:2"
    assert one(spark, r.remaining_seconds(F.lit(0.5), F.lit(10.0))) == 10 and one(spark, r.remaining_seconds(F.lit(0.01), F.lit(10.0))) is None
    assert one(spark, r.captions_compatible(F.col("a"), F.col("b")), a="图3-4 罐", b="罐（图3-4）")
    assert one(spark, r.upgrade(F.col("a"), F.col("b")), a="红陶罐", b="陶罐") is False and one(spark, r.upgrade(F.col("a"), F.col("b")), a="陶罐", b="夹砂陶罐")
    with pytest.raises(Exception, match="bad key"):
        one(spark, r.safe_path(F.col("a")), a="../x")


def test_repair(spark):
    rows = spark.createDataFrame([(1, "M13:9"), (2, "MI3:9"), (3, "M13:O"), (4, "XI:1"), (5, "M13:2"), (6, "M13:3")], "row_id int, t string")
    assert {x["row_id"]: x["repaired"] for x in r.repaired_ids(rows, "t").collect()} == {1: "M13:9", 2: "M13:9", 3: "M13:0", 4: None, 5: "M13:2", 6: "M13:3"}


def test_lookups(spark):
    cached = spark.createDataFrame([("e", "d", 1, "a b"), ("f", "d", 1, "zz")], "evidence_id string, document_id string, page int, quote string")
    blocks = spark.createDataFrame([("d", 1, "r2", 1, "xab"), ("d", 1, "r1", 0, "a  b c")], "document_id string, page int, region_id string, ord int, text string")
    assert {x["evidence_id"]: x["region_id"] for x in r.rebound(cached, blocks).collect()} == {"e": "r1", "f": None}
    box = "struct<l: double, t: double, r: double, b: double>"
    old = spark.createDataFrame([(1, "artifact", (0.1, 0.1, 0.2, 0.2), "c1"), (1, "artifact", (0.3, 0.1, 0.4, 0.2), "c2"), (1, "artifact", (0.3, 0.1, 0.4, 0.2), "c3")], f"page int, kind string, bbox {box}, crop string")
    new = spark.createDataFrame([(1, "artifact", (0.10000000001, 0.1, 0.2, 0.2), "n1"), (1, "artifact", (0.3, 0.1, 0.4, 0.2), "n2")], f"page int, kind string, bbox {box}, id string")
    assert [tuple(x) for x in r.crop_repair(old, new).collect()] == [("n1", "c1")]
    saved = spark.createDataFrame([("b", 0, "mine", "B"), ("own", 1, "x", "Own")], "key string, ord int, instruction string, label string")
    built = spark.createDataFrame([("a", 0, "ia", "A"), ("b", 1, "ib", "B2")], "key string, ord int, instruction string, label string")
    assert [(x["key"], x["label"], x["instruction"]) for x in r.replaced_fields(saved, built).collect()] == [("b", "B2", "mine"), ("own", "Own", "x"), ("a", "A", "ia")]
