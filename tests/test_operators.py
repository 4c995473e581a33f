"""Evaluation, verification, rematch, catalog, state, extraction, sources and feeds."""

import json

import pytest
from pyspark.sql import functions as F

from sondage.operators import catalog, evaluate, evidence, extraction, rematch, state, verify
from sondage.sources import files
from sondage.streaming import feeds


def test_human_left_join(spark):
    gold = spark.createDataFrame([(1, "A"), (2, "B"), (3, "B"), (4, "C"), (5, "")], "gold_id int, key string")
    pred = spark.createDataFrame([("p1", "A"), ("p2", ""), ("p3", None), ("p4", "D")], "record_id string, key string")
    got = {r["gold_id"]: r["match_status"] for r in evaluate.human_left_join(gold, pred).collect()}
    assert got == {1: "matched", 2: "ambiguous", 3: "ambiguous", 4: "not_found", 5: "not_found"}
    assert {r["record_id"] for r in evaluate.unmatched_predictions(pred, gold).collect()} == {"p2", "p3", "p4"}


def test_confusion(spark):
    rows = spark.createDataFrame([("failed", "failed"), ("passed", "passed"), ("passed", "failed"), ("failed", "passed"), ("passed", "uncertain")], "human string, machine string")
    got = verify.confusion(rows).first()
    assert [got[c] for c in ("tp", "fn", "fp", "tn", "coverage", "precision", "alignment", "review_load")] == [1, 1, 1, 1, 0.5, 0.5, 0.5, 0.5]
    none = verify.confusion(rows.limit(0)).first()
    assert none["coverage"] is None and none["pass_rate"] == 0.0


def test_failures(spark):
    field = "array<struct<field: string, verdict: string, failure_code: string, reason: string, causes_overall_failure: boolean>>"
    crop = lambda code, cause: ("artifact_crop", "failed", code, "", cause)
    rows = [(1, "failed", [crop("artifact_crop_missing", True), crop("invented", True)]), (2, "failed", [crop("artifact_crop_missing", False)]), (3, "passed", [crop("", True)]), (4, "failed", None), (5, "failed", [("identifier", "failed", None, "编号重复", True)])]
    frame = spark.createDataFrame(rows, f"record_id int, verdict string, field_results {field}")
    assert {r["code"]: r["count"] for r in verify.failure_distribution(frame).collect()} == {"artifact_crop_missing": 1, "artifact_id_duplicate": 1, "unclassified_failure": 2}
    assert verify.review_required(frame).first()["passed_with_doubt"] == 1


def test_outage_and_fail_closed(spark):
    rows = spark.createDataFrame([("uncertain", True)] * 8, "verdict string, model_unavailable boolean")
    closed = rows.withColumn("verdict", verify.fail_closed(F.col("verdict"), F.col("model_unavailable")))
    got = verify.run_totals(closed).first()
    assert (got["failed"], got["uncertain"], got["unavailable"], got["run_valid"]) == (0, 8, 8, False)


@pytest.mark.parametrize(("good", "bad", "expected"), [(11, 11, (9, 9)), (5, 20, (5, 9))])
def test_balanced_sample(spark, good, bad, expected):
    rows = spark.createDataFrame([(f"g{i}", "correct") for i in range(good)] + [(f"b{i}", "incorrect") for i in range(bad)], "record_id string, label string")
    got = [r["label"] for r in verify.balanced_sample(rows, 18, 7).collect()]
    assert (got.count("correct"), got.count("incorrect")) == expected
    assert verify.balanced_sample(rows, 18, 7, borrow=True).count() == 18


def test_rule_scopes(spark):
    rules = spark.createDataFrame([(1, "Unique ID", ""), (2, "尺寸", "精度"), (3, "style", "")], "rule_id int, title string, description string")
    assert {(r["rule_id"], r["scope"]) for r in verify.rule_scopes(rules).collect()} == {(1, "identifier"), (2, "measurements")}


def links(spark, rows):
    return spark.createDataFrame([(i, "a", "b", "caption_of", s, m, v) for i, s, m, v in rows], "id string, source_region_id string, target_region_id string, relation_type string, score double, method string, review_status string")


def test_rematch(spark):
    old = links(spark, [("same", 0.9, "ocr", "accepted"), ("removed", 0.5, "x", "unreviewed")])
    new = links(spark, [("same", 0.8, "ocr", "unreviewed"), ("added", 0.9, "directional", "unreviewed")])
    assert {(r["id"], r["change"]) for r in rematch.diff(old, new).collect()} == {("same", "changed"), ("removed", "removed"), ("added", "added")}
    got = rematch.report(old, new).first()
    assert (got["added"], got["removed"], got["changed"], got["unchanged"]) == (1, 1, 1, 0)
    kept = {r["id"]: (r["score"], r["protected"]) for r in rematch.protect(old, new).collect()}
    assert kept == {"same": (0.9, True), "added": (0.9, False)}
    rejected = links(spark, [("same", 0.9, "ocr", "rejected")])
    assert rematch.protect(rejected, new).count() == 0


def test_representatives(spark):
    rows = spark.createDataFrame([("e", "r1", 5, 0, False), ("e", "r2", 5, 1, True), ("f", "r3", 1, 2, True), ("g", "r4", 9, 3, False)], "entity_id string, record_id string, score int, ord int, has_crop boolean")
    assert {r["entity_id"]: r["record_id"] for r in catalog.representatives(rows, False).collect()} == {"e": "r1", "f": "r3", "g": "r4"}
    assert {r["entity_id"]: (r["record_id"], r["place"]) for r in catalog.representatives(rows, True).collect()} == {"e": ("r2", 1), "f": ("r3", 2)}


def test_state(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z")], "id int, scope string, v string")
    new = spark.createDataFrame([(2, "a", "new")], old.schema)
    assert sorted(r["id"] for r in state.replace_scope(old, new, ["scope"]).collect()) == [2, 3]
    assert {r["id"]: r["v"] for r in state.upsert(old, new, ["id"]).collect()} == {1: "x", 2: "new", 3: "z"}
    runs = spark.createDataFrame([("running",)], "s string")
    assert runs.select(state.moved(F.col("s"), "paused")).first()[0] == "paused"
    with pytest.raises(Exception, match="no move"):
        runs.select(state.moved(F.lit("completed"), "running")).collect()


def test_scope_sink(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, scope string")
    state.write_scope(rows, str(tmp_path / "t"), ["scope"])
    state.write_scope(spark.createDataFrame([(9, "b")], rows.schema), str(tmp_path / "t"), ["scope"])
    assert sorted(r["id"] for r in spark.read.parquet(str(tmp_path / "t")).collect()) == [1, 9]


def test_salvage():
    assert json.loads(extraction.salvage('```json\n{"a": [1, 2,], }\n```')) == {"a": [1, 2]}
    assert json.loads(extraction.salvage('{"a": {"b": 1}, "c": "un')) == {"a": {"b": 1}}
    assert json.loads(extraction.salvage('noise [1, {"x": "}"}] more')) == [1, {"x": "}"}]
    assert extraction.salvage("no json") is None and extraction.salvage(None) is None


def test_expand_and_ground(spark):
    row = spark.createDataFrame([('{"id": {"v": "M1", "s": "ok"}, "size": "5 cm", "x": 1}',)], "p string")
    got = {r["key"]: (r["value"], r["status"]) for r in row.select(F.inline(extraction.expanded(F.col("p"), ["id", "size", "color"]))).collect()}
    assert got == {"id": ("M1", "valid"), "size": ("5 cm", "valid"), "color": (None, "missing")}
    assert extraction.grounded("高12cm", "器物，高 12 ｃｍ。") == "高 12 ｃｍ"
    assert extraction.grounded("nowhere", "text") is None


def test_packed_segments(spark):
    rows = spark.createDataFrame([("d", 1, i, "word " * 20) for i in range(6)] + [("d", 2, 0, "x" * 500)], "document_id string, page int, ord int, text string")
    got = extraction.packed_segments(rows, most_chars=220, overlap=0).collect()
    assert all(len(r["text"]) <= 220 for r in got) and sum(r["page"] == 2 for r in got) >= 3


def test_model_contract(spark):
    rows = spark.createDataFrame([(i, "p") for i in range(3)], "k int, prompt string")
    assert extraction.ask(rows, "k", "prompt").count() == 3
    with pytest.raises(Exception, match="prompts"):
        extraction.ask(rows.coalesce(1), "k", "prompt", lambda p: []).collect()


def test_evidence(spark):
    regions = spark.createDataFrame([("j", "a", 1), ("j", "b", 2), ("j", "c", 3)], "job_id string, id string, page int")
    relations = spark.createDataFrame([("j", "r1", "a", "b"), ("j", "r2", "b", "c"), ("j", "r3", "b", "b")], "job_id string, id string, source_region_id string, target_region_id string")
    assert sorted(r["id"] for r in evidence.page_relations(relations, regions, 2).collect()) == ["r1", "r2", "r3"]
    records = spark.createDataFrame([("x", [1]), ("y", [1, 3])], "record_id string, source_pages array<int>")
    kept, links_, own = evidence.restored(records, relations, regions, keep=[1, 2])
    assert [r["record_id"] for r in kept.collect()] == ["x"] and sorted(r["id"] for r in links_.collect()) == ["r1", "r3"] and own.count() == 2
    kept, _, _ = evidence.restored(records, relations, regions, drop=[3])
    assert [r["record_id"] for r in kept.collect()] == ["x"]


def test_sources(spark, tmp_path):
    (tmp_path / "page_7.txt").write_text("0 0.5 0.5 0.2 0.2\nbad line\n9 0.5 0.5 0.2 0.2\n1 0.05 0.5 0.2 0.2\n")
    got = files.label_boxes(spark, str(tmp_path / "page_7.txt")).orderBy("kind").collect()
    assert [(r["page"], r["kind"], round(r["bbox"]["l"], 3)) for r in got] == [(7, "artifact", 0.4), (7, "number", 0.0)]
    header = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext\n"
    (tmp_path / "o.tsv").write_text(header + "5\t1\t1\t1\t1\t1\t10\t10\t20\t10\t90\tHello\n5\t1\t1\t1\t1\t2\t40\t10\t20\t10\t80\tworld\n5\t1\t1\t1\t1\t3\t70\t10\t20\t10\t10\tnoise\n")
    line = files.ocr_lines(spark, str(tmp_path / "o.tsv"), 100, 100).first()
    assert line["text"] == "Hello world" and line["bbox"]["r"] == 0.6 and line["confidence"] == pytest.approx(0.85)
    (tmp_path / "g.csv").write_text("ctx,seq,note\nM1,2,a\nM1,2,b\n,,\n,,only note\n")
    rows = files.human_sheet(spark, str(tmp_path / "g.csv"), context_col="ctx", sequence_col="seq").collect()
    assert [(r["canonical_artifact_id"], r["duplicate_key_count"]) for r in rows] == [("M1,2", 2), ("M1,2", 2)]
    (tmp_path / "d.json").write_text('{"page": 1, "predictions": [{"kind": "artifact", "bbox": [0.1, 0.1, 0.2, 0.2], "confidence": 0.5}]}\n')
    assert files.detections(spark, str(tmp_path / "d.json")).count() == 1
    (tmp_path / "e.json").write_text('{"page": 1, "predictions": [{"kind": "artifact", "bbox": [0.3, 0.1, 0.2, 0.2], "confidence": 0.5}]}\n')
    with pytest.raises(Exception, match="bad prediction"):
        files.detections(spark, str(tmp_path / "e.json")).collect()


def test_upsert_feed(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "done"), (1, 2, "failed")], "job_id int, page int, status string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = feeds.stream(spark, str(tmp_path / "in"), rows.schema)
    feeds.upsert_to(stream, str(tmp_path / "out"), ["job_id", "page"], str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out" / "v0")).count() == 2
