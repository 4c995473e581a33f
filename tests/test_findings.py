"""What a review found on odd inputs and larger tables, query by query."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__  # noqa: F401  registers the queries
from sondage.llm import tokens
from sondage.llm.queries import vocabulary
from sondage.operators import evaluate, fuse
from sondage.plans.registry import QUERIES, SQL


@pytest.fixture
def against_sql(spark, tmp_path):
    """Rows of a query and of its SQL over the tables given as name=(rows, schema)."""

    def both(name, **tables):
        con = duckdb.connect()
        for table, (rows, schema) in tables.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
        found = con.execute(SQL[name])
        names = [d[0] for d in found.description]
        got = QUERIES[name](spark, str(tmp_path))
        assert sorted(got.columns) == sorted(names)
        return sorted(map(tuple, got.select(*names).collect()), key=repr), sorted(found.fetchall(), key=repr)

    return both


def test_quote_is_the_one_asked_for(against_sql):
    """Texts that repeat themselves with other points, spaces or case hold the words of a quote before its own place."""
    texts = ["The The The " * 30 + "the the the " * 30, "die, " * 5 + "die " * 40, "a b c " * 40, "-- " * 30 + "end", "?!", "", None, "Ötzung. " * 12 + "ötzung " * 14]
    got, expected = against_sql("quote_grounding", documents=([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert got == expected


def joined_rows(frame) -> int:
    """The most rows that one join of the executed plan gave."""
    jdf = frame._jdf
    jdf.collectToPython()
    most, todo = 0, [jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        else:
            if "Join" in name:
                most = max(most, node.metrics().apply("numOutputRows").value())
            todo += [node.children().apply(i) for i in range(node.children().size())]
    return most


def test_plate_references_join_classes(spark):
    """300 records and 300 labels of one number are 90,000 pairs, of which those that say the same need not meet."""
    records = spark.range(300).selectExpr("'j' AS job_id", "id AS record_id", "1 AS plate_no", "2 AS item_no", "if(id = 7, null, concat('M', id % 3)) AS artifact_id")
    labels = spark.range(300).selectExpr("'j' AS job_id", "id AS region_id", "id AS region_ord", "1 AS plate_no", "2 AS item_no", "if(id % 2 = 0, concat('M', id % 4), '') AS label_artifact", "id % 50 / 64D AS confidence")
    got = fuse.plate_references(records, labels)
    assert joined_rows(got) <= 3000
    found = {r["record_id"]: (r["region_id"], r["score"]) for r in got.collect()}
    assert len(found) == 300 and found[0] == (48, 0.99) and found[1] == (49, 0.96) and found[2] == (98, 0.99) and found[7] == (49, 0.96)


def test_hints_score_classes(spark):
    """200 records with one hint and 200 regions with one text are a pair of texts; weak pairs are never dealt out."""
    hints = spark.range(200).selectExpr("'j' AS job_id", "id AS record_id", "'caption_texts' AS hint_kind", "'abcdef' AS hint", "5 AS hint_page")
    regions = spark.range(200).selectExpr("'j' AS job_id", "id AS region_id", "cast(5 + id % 2 AS int) AS page", "'caption' AS kind", "if(id = 3, 'abcdef', 'abcdxy') AS text")
    got = fuse.hint_matches(hints, regions)
    assert joined_rows(got) <= 1000
    assert {(r["region_id"], round(r["score"], 6)) for r in got.collect()} == {(3, 0.9555)} and got.count() == 200


def test_asset_links_shuffle_no_pairs(spark):
    """Links by plate key are made distinct as classes; ids that come twice, with other keys, or without any, link once."""
    gold = spark.createDataFrame([(1, "s", ["a", "b"]), (1, "t", ["b", None]), (2, "u", ["a"]), (3, "s", []), (4, "s", None), (None, "x", ["b"])], "gold_id long, key string, plate_keys array<string>")
    assets = spark.createDataFrame([(10, 1, "s", ["a", "b"]), (11, 2, "s", ["b"]), (11, 3, "v", ["c", "a"]), (12, 4, "w", None)], "asset_id long, ord long, stem string, reference_keys array<string>")
    got = evaluate.asset_links(gold, assets, chunk=1)
    assert "hashpartitioning(gold_id, asset_id" not in re.sub(r"#\d+L?", "", got._jdf.queryExecution().toString())
    plates = [(1, 10), (1, 11), (2, 10), (2, 11), (None, 10), (None, 11)]
    expected = [(i, 11, "artifact") for i in (1, 3, 4)] + [(*p, "color_plate") for p in plates]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(expected, key=repr)


def test_plain_words_are_units():
    """Plain words and their marks need no normalizer: the ids are the library's, and only the rest is asked for in joined texts."""
    enc = tokens.PieceEncoder(vocabulary("word_bpe_49k.json"))
    texts = ["Ünd ÀÉ! Oningorth. oningorth*** étrechen, ÿß x) b?! " * 3, "word's 12a a×b café ＡＢ don't İst ŒUVRE a.b a1", ""]
    asked, joined = [], enc._joined_ids
    enc._joined_ids = lambda pieces: asked.extend(pieces) or joined(pieces)
    assert enc.encode(texts) == enc._library(texts)
    assert asked and not {"ünd".encode(), b"oningorth.", b"oningorth***", b"x)", "étrechen,".encode()} & set(asked)


def test_asset_links_are_dealt_evenly(spark):
    """One class of ids on either side is no single task's work."""
    gold = spark.range(400).selectExpr("id AS gold_id", "'s' AS key", "array('a', 'b') AS plate_keys")
    assets = spark.range(40).selectExpr("id AS asset_id", "id AS ord", "'t' AS stem", "array('b', 'a') AS reference_keys")
    got = evaluate.asset_links(gold, assets, chunk=8)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 16000 and max(sizes) <= 4000
    assert got.distinct().count() == 16000


def test_asset_links_without_ids(spark):
    """An id that is null links once by its keys, as in SQL."""
    gold = spark.createDataFrame([(None, "x", ["b"]), (1, "x", ["a", "b"])], "gold_id long, key string, plate_keys array<string>")
    assets = spark.createDataFrame([(None, 1, "s", ["b"]), (None, 2, "s", ["b"]), (2, 3, "s", ["b"])], "asset_id long, ord long, stem string, reference_keys array<string>")
    got = evaluate.asset_links(gold, assets)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(g, a, "color_plate") for g in (None, 1) for a in (None, 2)], key=repr)
