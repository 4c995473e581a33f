"""Assignment, page matching, detection metrics, entities and fusion."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sondage.operators import entity, fuse, index, match
from sondage.operators.assign import greedy, optimal

REGION = "job_id string, page int, id string, kind string, bbox struct<l: double, t: double, r: double, b: double>, text string, confidence double, ord long"


def test_assignment_is_not_greedy():
    assert optimal(np.array([[0.9, 0.8], [0.85, 0.1]]), 0.2) == [(0, 1), (1, 0)]
    assert greedy([(0.5, 1, 1), (0.5, 2, 1), (0.9, 1, 2)]) == [(0.9, 1, 2), (0.5, 2, 1)]


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 4), st.integers(1, 4), st.data())
def test_assignment_brute_force(n, m, data):
    scores = np.array([[data.draw(st.integers(0, 20)) / 20 for _ in range(m)] for _ in range(n)])
    value = lambda pairs: sum(scores[i, j] - 0.42 + 1e-9 for i, j in pairs)
    best = 0.0
    for choice in itertools.product(range(-1, m), repeat=n):
        pairs = [(i, j) for i, j in enumerate(choice) if j >= 0]
        if len({j for _, j in pairs}) == len(pairs) and all(scores[i, j] >= 0.42 for i, j in pairs):
            best = max(best, value(pairs))
    assert value(optimal(scores, 0.42)) == pytest.approx(best)


def page(spark, rows):
    return spark.createDataFrame([("j", 1, i, k, b, t, 0.9, n) for n, (i, k, b, t) in enumerate(rows)], REGION)


def test_simple_number(spark):
    rows = page(spark, [("a", "artifact", (0.10, 0.10, 0.35, 0.40), None), ("n", "number", (0.17, 0.41, 0.28, 0.46), "1")])
    got = match.match_pages(rows).collect()
    assert [(r["relation_type"], r["method"], r["source_region_id"], r["target_region_id"]) for r in got] == [("number_of", "directional_assignment", "n", "a")]


def test_groups_are_isolated(spark):
    rows = page(spark, [("gl", "group", (0.0, 0.0, 0.5, 1.0), None), ("gr", "group", (0.5, 0.0, 1.0, 1.0), None), ("al", "artifact", (0.30, 0.1, 0.48, 0.4), None), ("ar", "artifact", (0.52, 0.1, 0.70, 0.4), None), ("nl", "number", (0.40, 0.42, 0.46, 0.46), "1"), ("nr", "number", (0.54, 0.42, 0.60, 0.46), "2")])
    got = {(r["source_region_id"], r["target_region_id"], r["method"]) for r in match.match_pages(rows).filter("relation_type = 'number_of'").collect()}
    assert got == {("nl", "al", "directional_assignment_grouped"), ("nr", "ar", "directional_assignment_grouped")}


def test_group_caption_is_not_inherited(spark):
    rows = page(spark, [("g", "group", (0.1, 0.1, 0.9, 0.7), None), ("a", "artifact", (0.2, 0.2, 0.4, 0.6), None), ("b", "artifact", (0.5, 0.2, 0.8, 0.6), None), ("c", "caption", (0.2, 0.62, 0.8, 0.69), None)])
    kinds = [r["relation_type"] for r in match.match_pages(rows).collect()]
    assert "caption_of" not in kinds and kinds.count("contains") == 3 and kinds.count("caption_of_group") == 1


def test_empty_page_table(spark):
    assert match.match_pages(spark.createDataFrame([], REGION)).count() == 0


@pytest.mark.parametrize(
    ("caption", "label", "items", "said", "agree"),
    [
        ("图3-4:5", "5", [5], [5], 1.0),
        ("1-3. 罐 7、碗", "l2", [1, 2, 3, 7], [12], 0.0),
        ("１～３．罐", "3", [1, 2, 3], [3], 1.0),  # full width
        ("9-3. 倒 ", "9", [3, 9], [9], 1.0),  # a range that falls is its ends
        ("2-200. 长", "100", [2, 200], [100], 0.0),
        ("十二、罐 二十. 碗", "十二", [12, 20], [12], 1.0),
        ("M12:5. 罐", "O|", [5], [1], 0.0),
        ("3为罐，4是碗", "Fig 4", [3, 4], [4], 1.0),
        ("no items", "7", [], [7], None),
        ("1. 罐", "", [1], [], None),
        (None, None, [], [], None),
    ],
)
def test_items(spark, caption, label, items, said, agree):
    row = spark.createDataFrame([(caption, label)], "c string, l string").select(match.caption_items(F.coalesce("c", F.lit(""))).alias("c"), match.label_items(F.coalesce("l", F.lit(""))).alias("l"))
    got = row.select("c", "l", match.items_agree(F.col("c"), F.col("l")).alias("agree")).first()
    assert (sorted(got["c"]), sorted(got["l"]), got["agree"]) == (items, said, agree)


def test_references(spark):
    rows = spark.createDataFrame([("H125:1 见图六-3，并参见彩版八：2。",), ("圖两-A; Figure 12: 3b plate十",), ("m 13 : a9 and Fig 007",)], "t string")
    got = [r["references"] for r in index.references(rows, "t").collect()]
    assert got == [["artifact:h1251", "figure:6:3", "plate:8:2"], ["figure:12:3b", "figure:2:a", "plate:10"], ["artifact:m13a9", "figure:7"]]


def test_detection(spark):
    rows = lambda n: spark.createDataFrame([("artifact", 1, i, (0.1 * i, 0.1, 0.1 * i + 0.05, 0.3)) for i in range(n)], "kind string, page int, ord int, bbox struct<l: double, t: double, r: double, b: double>")
    got = {r["kind"]: r for r in match.detection_metrics(rows(2), rows(3), ["artifact", "caption"]).collect()}
    assert (got["artifact"]["precision"], got["artifact"]["matched_count"]) == (1.0, 2) and got["artifact"]["recall"] == pytest.approx(2 / 3)
    assert (got["caption"]["precision"], got["caption"]["recall"], got["caption"]["mean_iou"]) == (1.0, 1.0, 0.0)


def test_entities(spark):
    rows = [("j", "r1", 0, ["artifact:m13:9", "figure:3:1"]), ("j", "r2", 1, ["artifact:m1:39", "figure:3:1"]), ("j", "r3", 2, ["artifact:m13:9"]), ("j", "r4", 3, ["figure:3:1"]), ("j", "r5", 4, [])]
    frame = spark.createDataFrame(rows, "job_id string, record_id string, ord long, tokens array<string>")
    got = sorted(r["record_ids"] for r in entity.entities(entity.resolve(frame)).collect())
    assert got == [["r1", "r3", "r4"], ["r2"], ["r5"]]


def test_tokens(spark):
    row = spark.createDataFrame([(["H125:1", "BI(M5:1)"], "三-4", "2", None, "1")], "ids array<string>, f string, fi string, p string, pi string")
    got = row.select(entity.record_tokens(F.transform("ids", lambda v: F.lower(v)), F.col("f"), F.col("fi"), F.col("p"), F.col("pi"))).first()[0]
    assert "figure:三4:2" in got and not any(t.startswith("plate:") for t in got)


def test_components_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40) if i != 19], "a long, b long")
    got = {r["node"]: r["root"] for r in entity.components(links).collect()}
    assert all(got[i] == (0 if i < 20 else 20) for i in range(41))


def test_recall(spark):
    requested = spark.createDataFrame([(["figure:6:3", "plate:8:2"],)], "references array<string>")
    pages = spark.createDataFrame([("d", 2, "document", ["figure:6:3"]), ("d", 3, "monochrome_visual", ["figure:6:3"]), ("d", 4, "document", ["figure:6:3"]), ("d", 286, "color_plate", ["plate:8"]), ("d", 300, "document", ["plate:9"])], "document_id string, page int, page_type string, references array<string>")
    assert sorted(r["page"] for r in index.recall(requested, pages, [2], 24).collect()) == [3, 286]
    assert index.unresolved(requested, pages).count() == 0
    assert (index.scaled_limit(275, 24, 0.15), index.scaled_limit(275, 80, 0.45)) == (42, 124)


def test_index_pages(spark):
    lines = "\n".join(f"图{i} 罐" for i in range(9))
    rows = spark.createDataFrame([("插 图 目 录",), (lines,), ("见图一",), (None,)], "t string")
    assert [r[0] for r in rows.select(index.is_index_text(F.col("t"))).collect()] == [True, True, False, False]


def test_capped_chunks(spark):
    rows = [("d", 161, 0, "H1 text", ["h1"]), ("d", 162, 1, "goes on", []), ("d", 162, 2, "H2 text", ["h2"]), ("d", 170, 3, "x" * 30, [])]
    frame = spark.createDataFrame(rows, "document_id string, page int, ord int, text string, ids array<string>")
    got = [(r["ids"], r["first_page"], r["last_page"]) for r in index.capped_chunks(frame).orderBy("chunk").collect()]
    assert got == [(["h1"], 161, 162), (["h2"], 162, 170)]
    assert [r["ids"] for r in index.capped_chunks(frame, most_chars=20).orderBy("chunk").collect()] == [["h1"], ["h2"], ["h2"]]


def test_fragments(spark):
    rows = [("j", 1, "a", "H1", 0.1, 0.1, 0.2, "owner"), ("j", 1, "b", "", 0.1, 0.21, 0.3, "tail。"), ("j", 1, "c", "", 0.1, 0.31, 0.4, "free")]
    frame = spark.createDataFrame(rows, "job_id string, page int, block_id string, artifact_id string, l double, t double, b double, text string")
    assert {r["block_id"]: r["owner_id"] for r in fuse.merge_fragments(frame).collect()} == {"a": "a", "b": "a", "c": None}


def brute_entities(rows):
    """Union-find over a whole job, in order: first by identifiers, then by references that contradict none."""
    parent, ids = {}, {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    rows = sorted(rows, key=lambda r: r[2])
    named, seen = {}, {}
    for job, record, _, tokens in rows:
        for token in tokens:
            if token.startswith("artifact:"):
                a, b = find((job, record)), find(named.setdefault((job, token), (job, record)))
                parent[max(a, b)] = min(a, b)
    for job, record, _, tokens in rows:
        ids.setdefault(find((job, record)), set()).update(t for t in tokens if t.startswith("artifact:"))
    for job, record, _, tokens in rows:
        for token in sorted(t for t in tokens if not t.startswith("artifact:")):
            a, b = find((job, record)), find(seen.setdefault((job, token), (job, record)))
            if a != b and not (ids.get(a) and ids.get(b) and ids[a].isdisjoint(ids[b])):
                parent[b] = a
                ids.setdefault(a, set()).update(ids.get(b, ()))
    groups = {}
    for job, record, _, _ in rows:
        groups.setdefault(find((job, record)), set()).add((job, record))
    return sorted(map(sorted, groups.values()))


def test_resolution_is_that_of_the_whole_job(spark):
    random = np.random.default_rng(3)
    rows = []
    for n in range(300):
        tokens = {f"artifact:m{random.integers(60)}:1" for _ in range(random.integers(0, 2))} | {f"figure:{random.integers(50)}:{random.integers(3)}" for _ in range(random.integers(0, 3))}
        rows.append((f"j{n % 3}", f"r{n}", int(random.permutation(10_000)[0]) * 1000 + n, sorted(tokens)))
    got = entity.resolve(spark.createDataFrame(rows, "job_id string, record_id string, ord long, tokens array<string>")).collect()
    groups = {}
    for r in got:
        groups.setdefault((r["job_id"], r["group"]), set()).add((r["job_id"], r["record_id"]))
    assert sorted(map(sorted, groups.values())) == brute_entities(rows)


def test_registered_resolution(spark):
    from sondage.plans import evidence

    made = evidence.entity_resolution(spark, "/root/testdata/sf0.001").collect()
    rows = [(r["job_id"], r["record_id"], r["ord"], r["tokens"]) for r in evidence.entity_records(spark, "/root/testdata/sf0.001").collect()]
    assert sorted(sorted((r["job_id"], x) for x in r["record_ids"]) for r in made) == brute_entities(rows)


@pytest.mark.parametrize("connected", [False, True])
def test_spatial_assignment_brute_force(spark, connected):
    random = np.random.default_rng(5)
    rows = [("j", page, f"e{i}", f"r{k}", float(random.integers(0, 20)) / 20) for page in range(8) for i in range(random.integers(1, 4)) for k in range(random.integers(1, 4))]
    frame = spark.createDataFrame(rows, "job_id string, page int, evidence_id string, region_id string, score double")
    got = fuse.grouped_assignment(frame, ["job_id", "page"], "evidence_id", "region_id", 0.2, connected=connected).collect()
    for page in range(8):
        scores = {(e, r): s for _, p, e, r, s in rows if p == page}
        left, right = sorted({e for e, _ in scores}), sorted({r for _, r in scores})
        best = 0.0
        for choice in itertools.product([None, *right], repeat=len(left)):
            taken = [(e, r) for e, r in zip(left, choice, strict=True) if r]
            if len({r for _, r in taken}) == len(taken) and all(scores.get(x, 0) >= 0.2 for x in taken):
                best = max(best, sum(scores[x] - 0.2 + 1e-9 for x in taken))
        own = [(r["evidence_id"], r["region_id"]) for r in got if r["page"] == page]
        assert len({e for e, _ in own}) == len(own) == len({r for _, r in own})
        assert sum(scores[x] - 0.2 + 1e-9 for x in own) == pytest.approx(best)


def test_hint_tokens(spark):
    row = spark.createDataFrame([(["图三-4", "图五", "Fig 2:a"], ["彩版八：2", "彩版九 中"])], "f array<string>, p array<string>").select(entity.hint_tokens(F.col("f"), F.col("p"))).first()[0]
    assert row == ["figure:fig2:a", "figure:图三:4", "plate:彩版八:2"]
