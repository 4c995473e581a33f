"""Queries: cards, review, sessions, linkage and page scopes over the whole driver tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions import geometry as g
from sondage.operators import catalog, sessions, verify
from sondage.plans.cases import cases
from sondage.plans.adapters import lines
from sondage.plans.registry import keyed_query as query
from sondage.session import table


Frame = DataFrame
text = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
named = lambda prefix, c: F.concat(F.lit(prefix), text(c))


# --- cards -------------------------------------------------------------------------------------------------------------

#: A line is a record of its order's entity; its fields follow from its numbers.
_CARDS = """
cards AS (SELECT l_orderkey * 10 + l_linenumber AS record_id, l_linenumber AS ord, CASE WHEN l_orderkey % 5 = 0 THEN NULL ELSE 'e' || l_orderkey END AS entity_id,
                 l_quantity::INTEGER % 4 = 1 AS has_body, l_quantity::INTEGER % 3 <> 0 AS has_caption, l_suppkey % 2 = 0 AS has_size, l_partkey % 6 = 0 AS own, CASE WHEN l_linenumber % 2 = 0 THEN 20 ELSE 5 END AS n, l_partkey % 3 = 0 AS crop, 1 + l_linenumber % 2 AS pages FROM lineitem),
scored AS (SELECT *, has_body::INTEGER * 12 + has_caption::INTEGER * 1 + has_size::INTEGER * 10 + 3 + own::INTEGER + CASE WHEN n >= 12 THEN 9 ELSE 0 END AS score,
                  NOT has_body AND NOT has_size AND has_caption AS sparse FROM cards),
shown AS (SELECT *, coalesce('entity:' || entity_id, 'record:' || record_id) AS card FROM scored WHERE NOT sparse AND (crop OR has_body OR has_size OR NOT (n < 12 AND pages <= 1))),
"""


def _cards(spark: SparkSession, sf: str) -> Frame:
    q = F.col("l_quantity").cast("int")
    when = lambda c, v: F.when(c, F.lit(v))
    fields = F.create_map(*(x for k, v in {
        "artifact_id": F.lit("M1:2"), "morphological_description": when(q % 4 == 1, "round"), "figure_caption": when(q % 3 != 0, "Fig 1"), "measurements": when(F.col("l_suppkey") % 2 == 0, "3 cm"), "texture": F.lit("None"), "completeness": F.lit(" "),
    }.items() for x in (F.lit(k), v.cast("string"))))
    return lines(spark, sf).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("record_id"), F.col("l_linenumber").alias("ord"), F.when(F.col("l_orderkey") % 5 != 0, named("e", "l_orderkey")).alias("entity_id"), fields.alias("fields"),
        F.when(F.col("l_partkey") % 6 == 0, F.array(F.lit("artifact_id"), F.lit("texture"))).alias("own_keys"), F.when(F.col("l_linenumber") % 2 == 0, "x" * 20).otherwise("x" * 5).alias("summary"), (1 + F.col("l_linenumber") % 2).alias("n_pages"), (F.col("l_partkey") % 3 == 0).alias("crop_bound"),
    )


@query(f"""WITH {_CARDS} best AS (SELECT *, row_number() OVER (PARTITION BY card ORDER BY score DESC, ord) AS k, min(ord) OVER (PARTITION BY card) AS place FROM shown),
crops AS (SELECT DISTINCT entity_id FROM cards WHERE crop AND entity_id IS NOT NULL)
SELECT b.record_id, b.entity_id, b.score::INTEGER AS score, b.place FROM best b LEFT JOIN crops c ON b.entity_id = c.entity_id WHERE k = 1 AND (crop OR c.entity_id IS NOT NULL)""")
def preview_cohort(spark: SparkSession, sf: str) -> Frame:
    """WN3, PR5, PR6: which cards the preview shows."""
    return catalog.preview_cards(_cards(spark, sf)).withColumn("score", F.col("score").cast("int"))


@query(f"WITH {_CARDS} z AS (SELECT 1) SELECT count(DISTINCT coalesce('entity:' || entity_id, 'record:' || record_id))::BIGINT AS count FROM cards WHERE crop")
def crop_bound_count(spark: SparkSession, sf: str) -> Frame:
    """AG10."""
    return catalog.crop_bound_entities(_cards(spark, sf))


@query("""WITH f AS (SELECT l_orderkey AS record_id, l_linenumber AS k, l_quantity::INTEGER % 2 = 0 AS filled, l_suppkey % 2 = 0 AS own FROM lineitem),
s AS (SELECT record_id, sum(CASE k WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 6 WHEN 4 THEN 10 WHEN 5 THEN 12 WHEN 6 THEN 1 ELSE 2 END + own::INTEGER) AS s FROM f WHERE filled GROUP BY record_id),
e AS (SELECT o_orderkey AS record_id, CASE WHEN o_custkey % 2 = 0 THEN 9 ELSE 0 END AS long FROM orders)
SELECT coalesce(s.record_id, e.record_id) AS record_id, (coalesce(s, 0) + coalesce(long, 0))::BIGINT AS score FROM s FULL JOIN e ON s.record_id = e.record_id""")
def representative_scores(spark: SparkSession, sf: str) -> Frame:
    """WN3: weights by field, a point for text on an own page, nine for a long summary."""
    key = F.element_at(F.array(*map(F.lit, ["artifact_id", "category", "material", "measurements", "morphological_description", "figure_caption", "other"])), F.col("l_linenumber"))
    fields = lines(spark, sf).select(F.col("l_orderkey").alias("record_id"), key.alias("key"), F.when(F.col("l_quantity").cast("int") % 2 == 0, "v").otherwise("NULL").alias("value"), (F.col("l_suppkey") % 2 == 0).alias("own_page"))
    summaries = table(spark, sf, "orders").select(F.col("o_orderkey").alias("record_id"), F.when(F.col("o_custkey") % 2 == 0, "x" * 12).otherwise("x" * 11).alias("summary"))
    return catalog.record_scores(fields, summaries).select("record_id", F.col("score").cast("long").alias("score"))


# --- verification ------------------------------------------------------------------------------------------------------

_REVIEW = """
rel AS (SELECT l_orderkey AS rid, 'r' || l_linenumber AS kind, round(l_discount * 100)::INTEGER * 10 / 100.0 AS score, CASE WHEN l_linenumber = 1 THEN 'ocr_scope' WHEN l_linenumber = 2 THEN 'spatial_fallback' ELSE 'manual' END AS method, l_linenumber FROM lineitem),
rec AS (SELECT o_orderkey AS record_id, o_custkey AS c, CASE WHEN o_custkey % 4 = 0 THEN (o_custkey % 10) / 10.0 END AS conf FROM orders),
agg AS (SELECT rid, min(score) AS s, bool_or(l_linenumber = 1) AS ocr, bool_or(l_linenumber = 2) AS layout FROM rel GROUP BY rid),
p AS (SELECT record_id, c, coalesce(conf, s, 0.0) AS conf, coalesce(ocr, false) AS ocr, coalesce(layout, false) AS layout FROM rec LEFT JOIN agg ON rid = record_id)
"""


def _review_records(spark: SparkSession, sf: str) -> tuple[Frame, Frame, Frame, Frame]:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    items = lines(spark, sf).select(F.col("l_orderkey").alias("o_orderkey"), F.concat_ws("-", text("l_orderkey"), text("l_linenumber")).alias("id"), "l_linenumber", (F.round(F.col("l_discount") * 100).cast("int") * 10 / 100.0).alias("score"))
    ids = items.groupBy("o_orderkey").agg(F.collect_list("id").alias("relation_ids"))
    own = table(spark, sf, "orders").join(ids, "o_orderkey", "left").select(k.alias("record_id"), F.when(c % 4 == 0, c % 10 / 10.0).alias("entity_confidence"), F.array((c % 7).cast("int")).alias("source_pages"), F.array((c % 5).cast("int"), F.lit(-1)).alias("associated_pages"), F.coalesce("relation_ids", F.array().cast("array<string>")).alias("relation_ids"), F.when(c % 3 == 0, F.array(named("p", k), F.lit("gone"))).otherwise(F.array().cast("array<string>")).alias("region_ids"), c.alias("c"))
    n = F.col("l_linenumber")
    relations = items.select("id", "score", F.when(n == 1, "ocr_scope").when(n == 2, "spatial_fallback").otherwise("manual").alias("method"), F.when(n <= 2, "number_of").otherwise("").alias("relation_type"))
    regions = table(spark, sf, "orders").select(named("p", k).alias("id"), F.when(c % 2 == 0, "color_plate").otherwise("artifact").alias("kind"))
    checks = table(spark, sf, "orders").select(k.alias("record_id"), F.lit("figure").alias("scope"), F.when(c % 8 == 0, "failed").otherwise("passed").alias("verdict")).filter(F.col("record_id") % 2 == 0)
    return own, relations, regions, checks


@query(f"""WITH {_REVIEW}
SELECT record_id, CASE WHEN record_id % 2 = 0 AND c % 8 <> 0 THEN 'correct' ELSE 'incorrect' END AS expected_label, (CASE WHEN c % 7 > 0 THEN c % 7 ELSE c % 5 END)::INTEGER AS primary_page,
       CASE WHEN conf >= 0.85 THEN 'high' WHEN conf >= 0.6 THEN 'medium' ELSE 'low' END AS confidence_bucket, CASE WHEN ocr THEN 'ocr_exact' WHEN layout THEN 'layout_fallback' ELSE 'other' END AS matching_method,
       CASE WHEN c % 5 > 0 AND c % 5 <> c % 7 THEN 'cross_page' ELSE 'same_page' END AS page_scope, c % 6 = 0 AS has_color_plate,
       list_concat(['expected:' || CASE WHEN record_id % 2 = 0 AND c % 8 <> 0 THEN 'correct' ELSE 'incorrect' END, 'confidence:' || CASE WHEN conf >= 0.85 THEN 'high' WHEN conf >= 0.6 THEN 'medium' ELSE 'low' END,
        'method:' || CASE WHEN ocr THEN 'ocr_exact' WHEN layout THEN 'layout_fallback' ELSE 'other' END, 'scope:' || CASE WHEN c % 5 > 0 AND c % 5 <> c % 7 THEN 'cross_page' ELSE 'same_page' END, 'color:' || CASE WHEN c % 6 = 0 THEN 'present' ELSE 'absent' END],
        [CASE WHEN record_id % 2 <> 0 THEN 'rule:general:covered' WHEN c % 8 = 0 THEN 'rule:figure:issue' ELSE 'rule:figure:covered' END]) AS tags FROM p""")
def sample_profiles(spark: SparkSession, sf: str) -> Frame:
    """SM3, SM4."""
    return verify.profiles(*_review_records(spark, sf))


@query(f"""WITH {_REVIEW}, t AS (SELECT rid, count(*) AS n, bool_or(l_linenumber <= 2) AS typed FROM rel GROUP BY rid)
SELECT record_id, c % 3 = 0 AND c % 2 = 1 AS artifact_crop_present, c % 6 = 0 AS color_plate_present, false AS caption_present, false AS number_present, coalesce(n, 0)::BIGINT AS relation_count,
       CASE WHEN coalesce(typed, false) THEN ['number_of'] ELSE [] END AS relation_types, CASE WHEN c % 6 = 0 THEN ['color_plate', 'other'] WHEN c % 3 = 0 THEN ['artifact', 'other'] ELSE [] END AS region_kinds FROM rec LEFT JOIN t ON rid = record_id""")
def visual_context(spark: SparkSession, sf: str) -> Frame:
    """VR5."""
    own, relations, regions, _ = _review_records(spark, sf)
    return verify.visual_context(own, regions, relations).withColumn("relation_count", F.col("relation_count").cast("long"))


@query("""WITH q AS (SELECT conv_id, role, turn, trim(text, ' ') AS text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS k FROM conversations WHERE trim(coalesce(text, ''), ' ') <> '')
SELECT conv_id AS record_id, role AS key, md5(string_agg(text, chr(1) ORDER BY k)) AS quotes FROM q WHERE k <= 5 GROUP BY 1, 2""")
def evidence_quotes(spark: SparkSession, sf: str) -> Frame:
    """VR8: the first five of each field that say something."""
    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("record_id"), F.col("role").alias("key"), F.col("turn").alias("pos"), F.col("text").alias("quote"))
    return verify.evidence_quotes(rows).select("record_id", "key", F.md5(F.array_join("quotes", "\x01")).alias("quotes"))


@query("""WITH p AS (SELECT p_partkey, p_size % 3 AS o, p_partkey % 4 AS v, p_partkey % 5 AS f FROM part),
x AS (SELECT *, CASE o WHEN 0 THEN 'failed' WHEN 1 THEN 'passed' ELSE 'uncertain' END AS overall, CASE v WHEN 0 THEN 'failed' WHEN 1 THEN 'passed' ELSE 'uncertain' END AS said FROM p)
SELECT p_partkey, len(r) AS n, r[1] AS rule, r[2] AS crop, r[3] AS chain, r[4] AS model FROM (SELECT p_partkey, ['figure/' || CASE WHEN o = 0 THEN 'failed/figure_caption_missing/true' ELSE 'passed/figure_caption_missing/false' END,
  'artifact_crop/' || CASE WHEN f = 0 THEN 'passed/artifact_crop_missing/false' ELSE 'failed/artifact_crop_missing/true' END, 'evidence_relation_chain/' || CASE WHEN f > 1 THEN 'passed' ELSE 'uncertain' END || '//false',
  CASE f WHEN 0 THEN 'caption' WHEN 1 THEN 'colour' ELSE 'x' END || '/' || said || '/' || CASE f WHEN 0 THEN 'figure_caption_evidence_conflict' WHEN 1 THEN 'structured_field_evidence_conflict' ELSE 'artifact_id_missing' END || '/' ||
  CASE WHEN overall = 'failed' AND said = 'failed' AND f <> 3 THEN 'true' ELSE 'false' END] AS r FROM x)""")
def judged_cards(spark: SparkSession, sf: str) -> Frame:
    """VR4, VR6: a card's results from rules, presence and model, held to known verdicts, codes and causes."""
    o, v, f = F.col("p_size") % 3, F.col("p_partkey") % 4, F.col("p_partkey") % 5
    overall = F.when(o == 0, "failed").when(o == 1, "passed").otherwise("uncertain")
    checks = F.array(F.struct(F.lit("figure").alias("scope"), F.when(o == 0, "failed").otherwise("passed").alias("verdict"), F.lit("r").alias("reason")))
    context = F.struct((f == 0).alias("artifact_crop_present"), F.when(f > 1, 2).otherwise(0).alias("relation_count"))
    found = F.array(F.struct(F.when(f == 0, "caption").when(f == 1, "colour").otherwise("x").alias("field"), F.when(v == 0, "FAILED").when(v == 1, "passed").when(v == 2, "maybe").alias("verdict"), F.when(f <= 1, "invented code").otherwise(" artifact_id_missing ").alias("failure_code"), F.when(f == 3, "false").when(f == 4, " True").alias("causes")))
    rows = table(spark, sf, "part").select("p_partkey", verify.judged(checks, context, found, overall).alias("r"))
    say = lambda i: F.concat_ws("/", F.col("r")[i]["field"], F.col("r")[i]["verdict"], F.coalesce(F.col("r")[i]["failure_code"], F.lit("")), text(F.col("r")[i]["causes_overall_failure"]))
    return rows.select("p_partkey", F.size("r").cast("long").alias("n"), say(0).alias("rule"), say(1).alias("crop"), say(2).alias("chain"), say(3).alias("model"))


@query("""WITH m AS (SELECT doc_id, CASE quality WHEN 1 THEN 'passed' ELSE 'uncertain' END AS v, toxic / 2.0 AS c FROM labels WHERE doc_id % 3 <> 0)
SELECT d.doc_id AS record_id, CASE WHEN n_chars % 2 = 0 THEN 'passed' ELSE 'failed' END AS verdict, coalesce(m.v, 'uncertain') AS ai_verdict, coalesce(m.c, 0.0)::DOUBLE AS ai_confidence, m.doc_id IS NULL AS model_unavailable,
       CASE WHEN m.doc_id IS NOT NULL THEN CASE WHEN m.v = 'passed' AND n_chars % 2 = 0 THEN 'agreed' ELSE 'conflict' END END AS consensus_status FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id""")
def sample_consensus(spark: SparkSession, sf: str) -> Frame:
    """JN7, SF46: the fixed sample against the blind run."""
    sample = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), F.when(F.col("n_chars") % 2 == 0, "passed").otherwise("failed").alias("verdict"))
    machine = table(spark, sf, "labels").filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("record_id"), F.when(F.col("quality") == 1, "passed").alias("verdict"), (F.col("toxic") / 2.0).alias("confidence"))
    return verify.sample_consensus(sample, machine)


@query("""WITH m AS (SELECT doc_id, quality FROM labels WHERE doc_id % 3 <> 0)
SELECT d.doc_id AS record_id, 'h' || (d.doc_id % 2) AS verdict, 'code' AS failure_code, 'why' AS failure_reason, 't' AS reviewed_at, CASE WHEN m.doc_id IS NULL THEN 'old' ELSE 'q' || quality END AS ai_verdict, CASE WHEN m.doc_id IS NULL THEN 'pending' ELSE 'agreed' END AS consensus_status FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id""")
def merged_review(spark: SparkSession, sf: str) -> Frame:
    """JN9: a model's results over a session's items; the four human columns stay."""
    one = F.lit
    items = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), named("h", F.col("doc_id") % 2).alias("verdict"), one("code").alias("failure_code"), one("why").alias("failure_reason"), one("t").alias("reviewed_at"), one("old").alias("ai_verdict"), one("pending").alias("consensus_status"))
    results = table(spark, sf, "labels").filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("record_id"), one("machine").alias("verdict"), one("x").alias("failure_code"), named("q", "quality").alias("ai_verdict"), one("agreed").alias("consensus_status"))
    return verify.merged_results(items, results)


@query("""WITH m AS (SELECT doc_id, quality, toxic FROM labels WHERE doc_id % 3 <> 0)
SELECT d.doc_id AS record_id, 'h' AS verdict, CASE WHEN m.doc_id IS NOT NULL THEN 'q' || quality END AS machine_verdict, (m.toxic * 0.5)::DOUBLE AS machine_confidence, coalesce(repeat('z', 1000), '') AS machine_reason, CAST(NULL AS VARCHAR) AS ai_verdict, 'pending' AS consensus_status FROM documents d JOIN m ON d.doc_id = m.doc_id
UNION ALL SELECT doc_id, 'h', NULL, NULL, '', NULL, 'pending' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM m)""")
def rechecked(spark: SparkSession, sf: str) -> Frame:
    """JN8: a new run's columns on the last version's items."""
    one = F.lit
    last = table(spark, sf, "documents").select(F.col("doc_id").alias("record_id"), one("h").alias("verdict"), one("old").alias("machine_verdict"), one(0.1).alias("machine_confidence"), one("old").alias("machine_reason"), one("old").alias("ai_verdict"), one("agreed").alias("consensus_status"))
    machine = table(spark, sf, "labels").filter("doc_id % 3 <> 0").select(F.col("doc_id").alias("record_id"), named("q", "quality").alias("verdict"), (F.col("toxic") * 0.5).alias("confidence"), F.repeat(one("z"), 1200).alias("reason"))
    return verify.rechecked(last, machine)


@query("""WITH v AS (SELECT c_custkey AS job_id, c_custkey % 4 AS last FROM customer)
SELECT job_id, (last + 1)::INTEGER AS target_version, CASE WHEN last + 1 > 2 THEN 'no_baseline' WHEN 'v' || (1 + job_id % 2) = 'v' || (last + 1) THEN 'allowed' ELSE 'wrong_baseline' END AS gate FROM v""")
def version_gate(spark: SparkSession, sf: str) -> Frame:
    """VR9."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer")
    versions = rows.select(k.alias("job_id"), F.explode(F.sequence(F.lit(0), (k % 4).cast("int"))).alias("version")).filter("version > 0")
    return verify.next_version(versions, rows.select(k.alias("job_id"), named("v", 1 + k % 2).alias("baseline")))


@query("""SELECT c_custkey AS job_id, CASE WHEN c_custkey % 5 = 0 THEN 'nothing' WHEN c_custkey % 5 = 1 THEN 'later_version' WHEN c_custkey % 5 = 2 THEN 'no_run' WHEN c_custkey % 7 * 5 >= 10 THEN 'reset' ELSE 'no_outage' END AS outcome FROM customer""")
def reset_gate(spark: SparkSession, sf: str) -> Frame:
    """VR10."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer")
    number = F.when(k % 5 == 0, F.array(F.lit(2))).when(k % 5 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    versions = rows.select(k.alias("job_id"), F.explode(number).alias("version"), F.when(k % 5 != 2, named("run", k)).alias("run_id"))
    return verify.resettable(versions, rows.select(named("run", k).alias("run_id"), F.lit(10).alias("total"), (k % 7).alias("unavailable")))


cases("failure_codes", ["string", "string", "string"], "VARCHAR", [
    (" artifact_crop_missing ", "x", None, "artifact_crop_missing"), ("invented", "figure", None, "figure_caption_missing"), (None, " Figure_Caption ", None, "figure_caption_evidence_conflict"), ("", "identifier", "编号重复", "artifact_id_duplicate"),
    (None, "identifier", None, "artifact_id_missing"), (None, "colour", None, "unclassified_failure"), ("unclassified_failure", "figure", None, "unclassified_failure"), (None, None, None, "unclassified_failure"),
], verify.failure_code, "SF45: the code of a failed field.")


# --- runs and sessions -------------------------------------------------------------------------------------------------

_RUNS = "runs AS (SELECT o_orderkey AS run_id, o_custkey AS job_id, CASE o_orderkey % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'paused' WHEN 3 THEN 'terminated' ELSE 'completed' END AS status, o_orderkey % 9 AS n FROM orders)"


def _runs(spark: SparkSession, sf: str) -> Frame:
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ["queued", "running", "paused", "terminated", "completed"])), (k % 5 + 1).cast("int"))
    n = (k % 9).alias
    return table(spark, sf, "orders").select(k.alias("run_id"), F.col("o_custkey").alias("job_id"), status.alias("status"), F.lit(False).alias("pause_requested"), n("pass_count"), n("fail_count"), n("uncertain_count"), F.col("o_orderdate").alias("updated_at"), n("total"))


def _action(action: str, allowed: list[str], to: str, already: str) -> None:
    inside = ", ".join(f"'{s}'" for s in allowed)
    count = "CASE WHEN outcome = 'moved' THEN 0 ELSE n END" if action == "terminate" else "n"

    @query(f"""WITH {_RUNS}, o AS (SELECT *, CASE WHEN status IN ({inside}) THEN 'moved' WHEN status = '{already}' THEN 'already' ELSE 'conflict' END AS outcome FROM runs)
    SELECT run_id, CASE WHEN outcome = 'moved' THEN '{to}' ELSE status END AS status, outcome = 'moved' AND {str(action == "pause").upper()} AS pause_requested, {count}::BIGINT AS pass_count, outcome FROM o""")
    def run(spark: SparkSession, sf: str) -> Frame:
        return sessions.run_action(_runs(spark, sf), action).select("run_id", "status", "pause_requested", F.col("pass_count").cast("long").alias("pass_count"), "outcome")

    from sondage.plans.registry import QUERIES, SQL

    QUERIES[f"run_{action}"], SQL[f"run_{action}"] = QUERIES.pop("run"), SQL.pop("run")


_action("pause", ["queued", "running"], "paused", "paused")
_action("resume", ["paused"], "queued", "none")
_action("terminate", ["queued", "running", "paused"], "terminated", "terminated")


def _one_run(name: str, active: list[str], refuse: bool) -> None:
    inside = ", ".join(f"'{s}'" for s in active)

    @query(f"""WITH {_RUNS}, a AS (SELECT job_id, max_by(run_id, (o_orderdate, run_id)) AS run_id FROM runs JOIN orders ON run_id = o_orderkey WHERE status IN ({inside}) GROUP BY job_id)
    SELECT c_custkey AS job_id, coalesce(run_id, c_custkey + 1000000000) AS run_id, CASE WHEN run_id IS NULL THEN 'created' ELSE '{"conflict" if refuse else "existing"}' END AS outcome FROM customer LEFT JOIN a ON job_id = c_custkey""")
    def run(spark: SparkSession, sf: str) -> Frame:
        wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("job_id"), (F.col("c_custkey") + 1_000_000_000).cast("long").alias("run_id"))
        return sessions.run_or_new(wanted, _runs(spark, sf), active, refuse)

    from sondage.plans.registry import QUERIES, SQL

    QUERIES[name], SQL[name] = QUERIES.pop("run"), SQL.pop("run")


_one_run("machine_run_created", sessions.ACTIVE_RUN, False)
_one_run("evaluation_run_created", sessions.ACTIVE_EVALUATION, True)


@query("""WITH j AS (SELECT c_custkey AS job_id, CASE c_custkey % 6 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' WHEN 2 THEN 'cancelled' ELSE 'completed' END AS status FROM customer),
f AS (SELECT o_custkey AS job_id, list_sort(list_distinct(list(o_orderkey % 50))) AS p FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 50 > 0 GROUP BY 1),
i AS (SELECT o_custkey AS job_id, list_sort(list_distinct(list(o_orderkey % 40))) AS p FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 40 > 0 GROUP BY 1),
x AS (SELECT j.job_id, CASE WHEN status = 'running' THEN 'running' WHEN coalesce(f.p, i.p) IS NULL THEN 'nothing' ELSE 'queued' END AS outcome, coalesce(f.p, i.p) AS p FROM j LEFT JOIN f ON j.job_id = f.job_id LEFT JOIN i ON j.job_id = i.job_id)
SELECT job_id, outcome, CASE WHEN outcome = 'queued' THEN p END AS pages FROM x""")
def retry_pages(spark: SparkSession, sf: str) -> Frame:
    """SS4."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    status = F.when(c % 6 == 0, "running").when(c % 6 == 1, "failed").when(c % 6 == 2, "cancelled").otherwise("completed")
    orders = table(spark, sf, "orders")
    runs = orders.select(F.col("o_custkey").alias("job_id"), (k % 50).alias("page"), F.when(F.col("o_orderstatus") == "F", "failed").otherwise("completed").alias("status"))
    issues = orders.select(F.col("o_custkey").alias("job_id"), (k % 40).alias("page"), F.when(F.col("o_orderpriority") == "1-URGENT", "error").otherwise("warning").alias("severity"))
    return sessions.retry_pages(runs, issues, table(spark, sf, "customer").select(c.alias("job_id"), status.alias("status")))


@query("""SELECT c_custkey AS job_id, CASE WHEN c_custkey % 7 = 0 THEN 'run_active' WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'review_open' WHEN c_custkey % 3 = 0 THEN 'no_first_version' ELSE 'created' END AS outcome,
       CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 3 <> 0 THEN CASE WHEN c_custkey % 3 = 1 THEN 3 ELSE 1 END END::BIGINT AS sequence, CASE WHEN c_custkey % 7 <> 0 AND c_custkey % 3 = 1 THEN 'e' || c_custkey || '-2' END AS archived FROM customer""")
def new_experiments(spark: SparkSession, sf: str) -> Frame:
    """SS15: of three jobs one has no experiment, one an active one with a first version, one an active one without."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer").select(k.alias("job_id"), k)
    name = lambda n: F.concat_ws("-", named("e", k), F.lit(n))
    own = rows.filter(k % 3 < 2)
    experiments = own.select("job_id", name("1").alias("experiment_id"), F.lit("archived").alias("status")).unionByName(own.select("job_id", name("2").alias("experiment_id"), F.lit("active").alias("status")))
    versions = own.filter(k % 3 == 1).select("job_id", name("2").alias("experiment_id"), F.lit(1).alias("version")).unionByName(own.select("job_id", name("1").alias("experiment_id"), F.lit(1).alias("version")))
    open_ = own.select("job_id", name("2").alias("experiment_id"), F.when(k % 2 == 0, "in_progress").otherwise("completed").alias("status"))
    runs = rows.filter(k % 7 == 0).select("job_id", F.lit("paused").alias("status"))
    return sessions.new_experiments(rows.select("job_id"), experiments, versions, runs, open_).withColumn("sequence", F.col("sequence").cast("long"))


@query(f"""WITH {_RUNS}, t AS (SELECT job_id, max_by(n, (o_orderdate, run_id)) AS total FROM runs JOIN orders ON run_id = o_orderkey WHERE n > 0 GROUP BY job_id)
SELECT c_custkey AS job_id, coalesce(total, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 11 END, 0)::BIGINT AS artifact_count FROM customer LEFT JOIN t ON job_id = c_custkey""")
def artifact_counts(spark: SparkSession, sf: str) -> Frame:
    """AG23."""
    k = F.col("c_custkey")
    jobs = table(spark, sf, "customer").select(k.alias("job_id"))
    return sessions.artifact_counts(jobs, _runs(spark, sf), jobs.filter("job_id % 2 = 0").select("job_id", (F.col("job_id") % 11).alias("count"))).withColumn("artifact_count", F.col("artifact_count").cast("long"))


@query("""WITH x AS (SELECT c_custkey AS job_id, c_custkey % 4 AS s, c_custkey % 5 AS v FROM customer)
SELECT job_id, CASE WHEN job_id % 9 = 0 THEN 'job_running' WHEN s = 0 THEN 'reopened' WHEN s = 1 THEN 'existing' ELSE 'created' END AS outcome, CASE WHEN job_id % 9 <> 0 AND s <= 1 THEN 's' || job_id END AS session_id,
       CASE WHEN job_id % 9 <> 0 THEN CASE WHEN s <= 1 THEN 7 ELSE v + 1 END END::INTEGER AS target_version FROM x""")
def open_sessions(spark: SparkSession, sf: str) -> Frame:
    """SS16."""
    k = F.col("c_custkey")
    rows = table(spark, sf, "customer")
    jobs = rows.select(k.alias("job_id"), F.when(k % 9 == 0, "running").otherwise("completed_with_warnings").alias("status"))
    own = rows.filter(k % 4 < 3).select(k.alias("job_id"), named("s", k).alias("session_id"), F.when(k % 4 == 0, "ai_review").when(k % 4 == 1, "conflict_review").otherwise("completed").alias("status"), F.lit(7).alias("target_version"), k.alias("updated_at"))
    versions = rows.select(k.alias("job_id"), F.explode(F.sequence(F.lit(0), (k % 5).cast("int"))).alias("version")).filter("version > 0")
    return sessions.open_sessions(jobs, own, versions)


@query("""WITH r AS (SELECT o_orderkey, list_sort(list(l_partkey::VARCHAR)) AS ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey % 4 <> 0 GROUP BY 1),
s AS (SELECT o_orderkey, substr(sha256(array_to_string(list_sort(list_distinct(ids)), '|')), 1, 24) AS sign FROM r)
SELECT o.o_custkey AS job_id, o.o_orderkey AS record_id, CASE WHEN o.o_orderkey % 4 = 0 THEN 'stale' ELSE 'unreviewed' END AS verdict, coalesce(sign, '') AS relation_signature, o.o_orderkey % 4 <> 0 AND o.o_orderkey % 3 = 0 AS relation_changed, o.o_orderkey % 4 = 0 AS stale FROM orders o LEFT JOIN s ON s.o_orderkey = o.o_orderkey""")
def session_items(spark: SparkSession, sf: str) -> Frame:
    """SS16, WN15."""
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("record_id"))
    ids = lines(spark, sf).groupBy(F.col("l_orderkey").alias("record_id")).agg(F.collect_list(text("l_partkey")).alias("relation_ids"))
    own = orders.filter("record_id % 4 <> 0").join(ids, "record_id", "left").withColumn("relation_ids", F.coalesce("relation_ids", F.array().cast("array<string>")))
    from sondage.functions.text import signature

    k = F.col("record_id")
    previous = own.select("job_id", "record_id", F.when(k % 3 == 0, "changed").when(k % 3 == 1, signature(F.col("relation_ids"))).otherwise("").alias("relation_signature"))
    return sessions.session_items(orders.withColumn("pos", F.lit(0)), own, previous).drop("pos")


@query("""SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 5 = 0 THEN 'stale' WHEN o_orderkey % 2 = 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'failed' ELSE 'passed' END ELSE 'unreviewed' END AS verdict,
       CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 6 = 0 THEN 'code' END AS failure_code, CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 6 = 0 THEN 'why' ELSE '' END AS failure_reason,
       CASE WHEN o_orderkey % 7 <> 0 THEN 'agreed' WHEN o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0 THEN 'human_resolved' ELSE 'conflict' END AS consensus_status, CASE WHEN o_orderkey % 2 <> 0 THEN 'kept' WHEN o_orderkey % 5 = 0 THEN 'stale' ELSE 'reviewed' END AS outcome FROM orders""")
def reviewed_items(spark: SparkSession, sf: str) -> Frame:
    """SS16."""
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders")
    items = orders.select(k.alias("record_id"), F.when(k % 5 == 0, "stale").otherwise("unreviewed").alias("verdict"), F.lit(None).cast("string").alias("failure_code"), F.lit("").alias("failure_reason"), F.when(k % 7 == 0, "conflict").otherwise("agreed").alias("consensus_status"), (k % 5 == 0).alias("stale"), F.lit("conflict_review").alias("session_status"))
    reviews = orders.filter(k % 2 == 0).select(k.alias("record_id"), F.when(k % 3 == 0, "failed").otherwise("passed").alias("verdict"), F.lit("code").alias("failure_code"), F.lit("why").alias("failure_reason"))
    return sessions.reviewed_items(items, reviews).drop("stale", "session_status")


_FIELDS = "f AS (SELECT o_orderkey AS record_id, 'k' AS key, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderstatus END AS value, 'valid' AS status, CASE o_orderkey % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' WHEN 2 THEN 'corrected' END AS decision, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'new' END AS given FROM orders)"


def _field_reviews(spark: SparkSession, sf: str) -> tuple[Frame, Frame]:
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders")
    fields = orders.select(k.alias("record_id"), F.lit("k").alias("key"), F.when(k % 4 != 0, F.col("o_orderstatus")).alias("value"), F.lit("valid").alias("status"))
    reviews = orders.filter(k % 5 < 3).select(k.alias("record_id"), F.lit("k").alias("key"), F.when(k % 5 == 0, "accepted").when(k % 5 == 1, "rejected").otherwise("corrected").alias("decision"), F.when(k % 3 != 0, "new").alias("value"))
    return sessions.field_reviews(fields, reviews)


@query(f"WITH {_FIELDS} SELECT record_id, key, CASE WHEN decision = 'corrected' THEN given ELSE value END AS value, CASE WHEN decision = 'rejected' THEN 'needs_review' WHEN decision = 'corrected' THEN CASE WHEN given IS NULL THEN 'missing' ELSE 'valid' END ELSE status END AS status, decision FROM f")
def field_reviews(spark: SparkSession, sf: str) -> Frame:
    """SS19."""
    return _field_reviews(spark, sf)[0]


@query(f"WITH {_FIELDS} SELECT record_id, key, decision, value AS before, CASE WHEN decision = 'corrected' THEN given ELSE value END AS after FROM f WHERE decision IS NOT NULL")
def field_revisions(spark: SparkSession, sf: str) -> Frame:
    """SS19, SC14."""
    return _field_reviews(spark, sf)[1]


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'rejected' WHEN o_orderkey % 3 = 1 THEN 'unreviewed' ELSE 'accepted' END AS review_status, o_orderkey % 3 = 0 AS reviewed FROM orders""")
def relation_reviews(spark: SparkSession, sf: str) -> Frame:
    """SS19: some are rejected, some taken back, the others stay."""
    k = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select(k.alias("id"))
    reviews = orders.filter("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, "rejected").otherwise("unreviewed").alias("status"), F.lit("me").alias("reviewer"), F.lit("why").alias("reason"))
    return sessions.relation_reviews(orders.withColumn("review_status", F.lit("accepted")), reviews)[0]


@query("""WITH r AS (SELECT o_orderkey AS run_id, CASE o_orderkey % 4 WHEN 0 THEN 'extraction' WHEN 1 THEN 'rematch' WHEN 2 THEN 'verification' ELSE 'evaluation' END AS kind, CASE o_custkey % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'running' WHEN 2 THEN 'paused' WHEN 3 THEN 'applying' ELSE 'completed' END AS status FROM orders),
i AS (SELECT *, CASE kind WHEN 'rematch' THEN status IN ('queued', 'running', 'applying', 'cancelling') WHEN 'evaluation' THEN status IN ('queued', 'running', 'paused') ELSE status IN ('queued', 'running') END AS interrupted FROM r)
SELECT run_id, kind, CASE WHEN interrupted THEN CASE WHEN kind = 'extraction' THEN 'queued' ELSE 'failed' END ELSE status END AS status, interrupted FROM i""")
def swept_runs(spark: SparkSession, sf: str) -> Frame:
    """SS10, SS17, SS20."""
    pick = lambda values, c: F.element_at(F.array(*map(F.lit, values)), (c % len(values) + 1).cast("int"))
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), pick(["extraction", "rematch", "verification", "evaluation"], F.col("o_orderkey")).alias("kind"), pick(["queued", "running", "paused", "applying", "completed"], F.col("o_custkey")).alias("status"))
    return sessions.swept(runs, runs)[0].select("run_id", "kind", "status", "interrupted")


@query("""SELECT o_orderkey AS run_id, CASE WHEN o_custkey % 3 = 0 THEN 'applied' WHEN o_orderkey % 2 = 0 THEN 'cancelling' ELSE 'cancelled' END AS status FROM orders""")
def cancelled_runs(spark: SparkSession, sf: str) -> Frame:
    """SS17, SS21."""
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_custkey") % 3 == 0, "applied").otherwise("running").alias("status"))
    return sessions.cancelled(runs, runs.filter("run_id % 2 = 0"))


@query("""WITH x AS (SELECT o_orderkey AS run_id, o_custkey AS job_id, o_orderkey % 6 AS s, CASE WHEN o_custkey % 2 = 0 THEN 'M1' ELSE 'M0' END AS now FROM orders)
SELECT run_id, job_id, CASE WHEN s = 0 THEN 'done' WHEN s = 1 THEN 'not_completed' WHEN job_id % 5 = 0 THEN 'review_open' WHEN job_id % 7 = 0 THEN 'evaluation_open' WHEN CASE WHEN s = 2 THEN 'M1' ELSE 'M0' END <> now THEN 'version_moved' ELSE 'apply' END AS gate FROM x WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = job_id)""")
def apply_gate(spark: SparkSession, sf: str) -> Frame:
    """SS11, SS12: which previews may be applied."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    runs = table(spark, sf, "orders").select(k.alias("run_id"), F.col("o_custkey").alias("job_id"), F.when(k % 6 == 0, "applied").when(k % 6 == 1, "running").otherwise("completed").alias("status"), F.when(k % 6 == 2, "M1").alias("base_version"))
    jobs = table(spark, sf, "customer").select(c.alias("job_id"), F.when(c % 2 == 0, "M1").alias("matching_version"))
    return sessions.apply_gate(runs, jobs, jobs.select("job_id", F.when(F.col("job_id") % 5 == 0, "ai_review").otherwise("completed").alias("status")), jobs.select("job_id", F.when(F.col("job_id") % 7 == 0, "paused").otherwise("failed").alias("status")))


@query("""SELECT o_custkey AS job_id, o_orderkey AS id, CASE o_custkey % 3 WHEN 0 THEN 'candidate' WHEN 1 THEN 'baseline' ELSE 'current' END AS origin FROM orders""")
def applied_snapshots(spark: SparkSession, sf: str) -> Frame:
    """SS11: applied, rolled back, or left alone, job by job."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("job_id"), F.col("o_orderkey").alias("id"))
    of = lambda name: rows.withColumn("origin", F.lit(name))
    outcomes = rows.select("job_id").distinct().filter("job_id % 3 < 2").withColumn("applied", F.col("job_id") % 3 == 0)
    return sessions.applied(of("current"), of("baseline"), of("candidate"), outcomes)


@query("""SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 2 = 0 THEN 'M0' ELSE 'M' || (o_orderkey % 4) END = CASE WHEN o_custkey % 3 = 0 THEN 'M1' ELSE 'M0' END AS valid FROM orders JOIN customer ON c_custkey = o_custkey""")
def runs_still_valid(spark: SparkSession, sf: str) -> Frame:
    """SS12."""
    k, c = F.col("o_orderkey"), F.col("c_custkey")
    runs = table(spark, sf, "orders").select(k.alias("run_id"), F.col("o_custkey").alias("job_id"), F.when(k % 2 != 0, named("M", k % 4)).alias("matching_version"))
    return sessions.still_valid(runs, table(spark, sf, "customer").select(c.alias("job_id"), F.when(c % 3 == 0, "M1").alias("matching_version")))


# --- pages, imports, requests --------------------------------------------------------------------------------------------

@query("""WITH p AS (SELECT p_size AS document_id, p_partkey AS page, CASE p_partkey % 5 WHEN 0 THEN 'color_plate' WHEN 1 THEN 'color_visual' WHEN 2 THEN 'mixed_visual' ELSE 'document' END AS page_type, (p_partkey % 8) / 8.0 AS v, p_partkey % 11 = 0 AS attempted, p_partkey % 13 = 0 AS requested FROM part),
n AS (SELECT document_id, count(*) AS n FROM p GROUP BY 1), m AS (SELECT document_id, CASE WHEN n <= 3 THEN 3 ELSE least(n, greatest(3, ceil(n * 0.45))) END AS most FROM n),
q AS (SELECT *, CASE page_type WHEN 'color_plate' THEN 11.0 WHEN 'color_visual' THEN 5.0 WHEN 'mixed_visual' THEN 3.0 ELSE 0.0 END AS pts FROM p),
r AS (SELECT document_id, page, (pts + v)::DOUBLE AS priority, row_number() OVER (PARTITION BY document_id ORDER BY pts + v DESC, page)::INTEGER AS place FROM q WHERE pts > 0 AND NOT attempted AND NOT requested)
SELECT r.* FROM r JOIN m ON r.document_id = m.document_id WHERE place <= most""")
def ocr_queue(spark: SparkSession, sf: str) -> Frame:
    """SO4."""
    return sessions.queue_of_pages(_pages(spark, sf), ["plate", "artifact"], least=3)


def _pages(spark: SparkSession, sf: str) -> Frame:
    k = F.col("p_partkey")
    kind = F.when(k % 5 == 0, "color_plate").when(k % 5 == 1, "color_visual").when(k % 5 == 2, "mixed_visual").otherwise("document")
    return table(spark, sf, "part").select(F.col("p_size").alias("document_id"), k.alias("page"), kind.alias("page_type"), (k % 8 / 8.0).alias("visual_score"), (k % 11 == 0).alias("attempted"), (k % 13 == 0).alias("requested"))


@query("""SELECT p_partkey AS page, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 5 = 1 AND p_partkey % 3 = 0 THEN 'color_plate' WHEN p_partkey % 5 = 1 THEN 'color_visual' WHEN p_partkey % 5 = 2 THEN 'mixed_visual' ELSE 'document' END AS page_type,
       CASE WHEN p_partkey % 3 = 0 THEN ['figure:1', 'plate:2'] WHEN p_partkey % 3 = 1 THEN ['figure:1', 'figure:9'] ELSE ['figure:1'] END AS references FROM part""")
def pages_after_ocr(spark: SparkSession, sf: str) -> Frame:
    """JN35: references grow, and a colour page that names a plate becomes one."""
    k = F.col("page")
    pages = _pages(spark, sf).withColumn("references", F.array(F.lit("figure:1")))
    read = pages.filter(k % 3 < 2).select("document_id", "page", F.when(k % 3 == 0, F.array(F.lit("plate:2"))).otherwise(F.array(F.lit("figure:9"), F.lit("figure:1"))).alias("found"))
    return sessions.after_ocr(pages, read).select("page", "page_type", "references")


@query("""WITH i AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'matched' ELSE 'ambiguous' END AS s FROM orders), k AS (SELECT * FROM i WHERE s = 'matched')
SELECT o_orderkey AS item_id, 'M' || (o_custkey % 50) AS artifact_id, (SELECT count(*) FROM k)::BIGINT AS total FROM k ORDER BY 'M' || (o_custkey % 50), o_orderdate, o_orderkey LIMIT 20 OFFSET 40""")
def items_page(spark: SparkSession, sf: str) -> Frame:
    """SO2."""
    k = F.col("o_orderkey")
    items = table(spark, sf, "orders").select(k.alias("item_id"), named("M", F.col("o_custkey") % 50).alias("artifact_id"), F.col("o_orderdate").alias("created_at"), F.when(k % 3 == 0, "matched").otherwise("ambiguous").alias("match_status"))
    return sessions.items_page(items, "matched", 40, 20).select("item_id", "artifact_id", "total")


@query("""WITH r AS (SELECT c_nationkey AS d, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE 'k' || (c_custkey % 40) END AS key FROM customer), k AS (SELECT d, key, count(*) AS n FROM r GROUP BY 1, 2),
c AS (SELECT d AS dataset_id, sum(n)::BIGINT AS row_count, coalesce(sum(n) FILTER (key IS NOT NULL), 0)::BIGINT AS valid_count, coalesce(sum(n) FILTER (key IS NULL), 0)::BIGINT AS unkeyed_count, coalesce(sum(n) FILTER (key IS NOT NULL AND n > 1), 0)::BIGINT AS duplicate_count FROM k GROUP BY d)
SELECT *, list_filter([CASE WHEN unkeyed_count > 0 THEN 'unkeyed:' || unkeyed_count END, CASE WHEN duplicate_count > 0 THEN 'duplicates:' || duplicate_count END], lambda x: x IS NOT NULL) AS warnings FROM c""")
def import_counts(spark: SparkSession, sf: str) -> Frame:
    """AG15, SC29."""
    k = F.col("c_custkey")
    return sessions.import_counts(table(spark, sf, "customer").select(F.col("c_nationkey").alias("dataset_id"), F.when(k % 6 != 0, named("k", k % 40)).alias("key")))


@query("""SELECT l_suppkey AS document_id, l_linenumber AS page, 'c' || (l_orderkey % 3) AS chunk, count(*)::BIGINT AS request_count, count(*) FILTER (l_partkey % 2 = 1)::BIGINT AS retry_count, count(*) FILTER (l_partkey % 5 = 0)::BIGINT AS truncation_count,
       sum(CASE WHEN l_partkey % 3 = 0 THEN 100 ELSE l_partkey END)::BIGINT AS prompt_tokens, sum(l_quantity::INTEGER)::BIGINT AS completion_tokens, sum(l_orderkey)::BIGINT AS llm_http_ms FROM lineitem GROUP BY 1, 2, 3""")
def request_totals(spark: SparkSession, sf: str) -> Frame:
    """AG22."""
    k = F.col("l_partkey")
    chunk = F.concat(named("c", F.col("l_orderkey") % 3), F.when(k % 4 == 1, F.lit(":part:1:retry:2")).when(k % 4 == 2, F.lit(":retry:1")).otherwise(F.lit("")))
    rows = lines(spark, sf).select(F.col("l_suppkey").alias("document_id"), F.col("l_linenumber").alias("page"), chunk.alias("chunk_id"), (k % 2).alias("attempt"), (k % 5 == 0).alias("truncated"), F.when(k % 3 != 0, k).alias("prompt_tokens"), F.lit(100).alias("prompt_estimate"), F.col("l_quantity").cast("int").alias("completion_tokens"), F.col("l_orderkey").alias("http_ms"))
    return sessions.request_totals(rows)


@query("""SELECT v.c_custkey AS version_id, 1 AS version, o_custkey AS run_id, 'completed' AS run_status, l_orderkey AS record_id, l_linenumber AS n, o_orderstatus AS fields FROM customer v JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber <> 2
UNION ALL SELECT v.c_custkey, 1, o_custkey, 'completed', -1 - l_orderkey, l_linenumber, NULL FROM customer v JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 2""")
def export_bundle(spark: SparkSession, sf: str) -> Frame:
    """JN26, JN32."""
    orders = table(spark, sf, "orders")
    versions = table(spark, sf, "customer").select(F.col("c_custkey").alias("version_id"), F.lit(1).alias("version"), F.col("c_custkey").alias("machine_run_id"))
    items = lines(spark, sf).join(orders.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("run_id")), "l_orderkey").select("run_id", F.when(F.col("l_linenumber") == 2, -1 - F.col("l_orderkey")).otherwise(F.col("l_orderkey")).alias("record_id"), F.col("l_linenumber").alias("n"))
    runs = versions.select(F.col("version_id").alias("run_id"), F.lit("completed").alias("status"))
    return sessions.export_bundle(versions, runs, items, orders.select(F.col("o_orderkey").alias("record_id"), F.col("o_orderstatus").alias("fields")))


@query("""WITH r AS (SELECT p_partkey // 20 AS page, p_partkey AS id, (p_size % 4) / 4.0 AS t, (p_partkey % 3) / 4.0 AS l FROM part) SELECT page::BIGINT AS page, id, row_number() OVER (PARTITION BY page ORDER BY t, l, id)::INTEGER AS place FROM r""")
def reading_order(spark: SparkSession, sf: str) -> Frame:
    """SO9."""
    k = F.col("p_partkey")
    l, t = k % 3 / 4.0, F.col("p_size") % 4 / 4.0
    return sessions.reading_order(table(spark, sf, "part").select(F.floor(k / 20).alias("page"), k.alias("id"), g.box(l, t, l + 0.1, t + 0.1).alias("bbox")), ["page"]).select("page", "id", "place")


@query("""WITH r AS (SELECT l_suppkey AS run_id, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber)::INTEGER AS place, count(*) OVER (PARTITION BY l_suppkey)::BIGINT AS total FROM lineitem) SELECT * FROM r WHERE place <= 200""")
def first_unmatched(spark: SparkSession, sf: str) -> Frame:
    """SO10."""
    rows = lines(spark, sf).select(F.col("l_suppkey").alias("run_id"), "l_orderkey", "l_linenumber")
    return sessions.first_of(rows, "run_id", ["l_orderkey", "l_linenumber"])


@query("""SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100""")
def newest_runs(spark: SparkSession, sf: str) -> Frame:
    """SC33."""
    return sessions.history_page(table(spark, sf, "orders"), "o_orderdate", "o_orderkey", 100).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""WITH f AS (SELECT l_orderkey * 10 + l_linenumber AS item_id, CASE l_linenumber % 3 WHEN 0 THEN 'notes' WHEN 1 THEN 'morphological_description' ELSE 'texture' END AS key, CASE l_partkey % 4 WHEN 0 THEN 'missing' WHEN 1 THEN 'mismatched' ELSE 'matched' END AS verdict, l_partkey FROM lineitem)
SELECT item_id, key, CASE WHEN key <> 'texture' AND verdict <> 'missing' THEN CASE WHEN l_partkey % 3 = 0 THEN 'matched' ELSE 'mismatched' END ELSE verdict END AS verdict, (CASE WHEN key <> 'texture' AND verdict <> 'missing' THEN (l_partkey % 5) / 4.0 ELSE 0.5 END)::DOUBLE AS score, CASE WHEN key <> 'texture' AND verdict <> 'missing' THEN 'semantic_llm' ELSE 'text' END AS method FROM f""")
def semantic_scores(spark: SparkSession, sf: str) -> Frame:
    """AG2, ML2: judgments take the place of the ratio for free text."""
    results, judgments = _semantic(spark, sf)
    return sessions.semantic_scores(results, judgments, ["morphological_description", "notes"])


def _semantic(spark: SparkSession, sf: str) -> tuple[Frame, Frame]:
    n, k = F.col("l_linenumber"), F.col("l_partkey")
    rows = lines(spark, sf).select((F.col("l_orderkey") * 10 + n).alias("item_id"), F.when(n % 3 == 0, "notes").when(n % 3 == 1, "morphological_description").otherwise("texture").alias("key"), k)
    results = rows.select("item_id", "key", F.when(k % 4 == 0, "missing").when(k % 4 == 1, "mismatched").otherwise("matched").alias("verdict"), F.lit(0.5).alias("score"), F.lit("text").alias("method"))
    return results, rows.select("item_id", "key", (k % 5 / 4.0).alias("score"), (k % 3 == 0).alias("matched"))


# --- views ---------------------------------------------------------------------------------------------------------------

@query("""SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND p_brand LIKE 'Brand#1%' AND p_size % 10 = 3""")
def insights_drill_down(spark: SparkSession, sf: str) -> Frame:
    """UX2."""
    rows = table(spark, sf, "part").withColumn("source_pages", F.array((F.col("p_size") % 10).cast("int")))
    return catalog.drilled(rows, F.col("p_type"), F.substring("p_brand", 1, 7), "ECONOMY", "Brand#1", 3).select("p_partkey")


@query("""SELECT o_orderkey FROM orders WHERE o_custkey % 4 = 1 AND o_orderstatus = 'F' AND contains(lower(o_orderpriority), 'urgent')""")
def evaluation_history(spark: SparkSession, sf: str) -> Frame:
    """UX6."""
    rows = table(spark, sf, "orders").withColumn("filename", F.concat(F.lit(" Report "), text(F.col("o_custkey") % 4), F.lit(".PDF"))).withColumn("status", F.col("o_orderstatus"))
    return catalog.history_filter(rows, "report1", False, " URGENT ", "F", F.col("o_orderpriority")).select("o_orderkey")


@query("""SELECT p_partkey AS version, 18 AS sample_count, (CASE WHEN p_size % 2 = 0 THEN floor((p_size / 64.0) * 100 + 0.5) ELSE floor((1 - (p_partkey % 8) / 8.0) * 100 + 0.5) END)::BIGINT AS error_coverage, floor((p_partkey % 8) / 8.0 * 100 + 0.5)::BIGINT AS precision, floor((p_partkey % 8) / 8.0 * 100 + 0.5)::BIGINT AS alignment,
       (CASE WHEN p_size % 3 = 0 THEN 25 END)::BIGINT AS review_load, (CASE WHEN p_size % 5 = 0 THEN 100 ELSE 9 END)::INTEGER AS passed, 4 AS errors, 0 AS uncertain FROM part""")
def report_view(spark: SparkSession, sf: str) -> Frame:
    """UX7."""
    k, s = F.col("p_partkey"), F.col("p_size")
    none = F.lit(None).cast("double")
    report = table(spark, sf, "part").select(k.alias("version"), F.lit(18).alias("sample_count"), (k % 8 / 8.0).alias("pass_rate"), F.when(s % 2 == 0, s / 64.0).alias("coverage"), none.alias("precision"), none.alias("alignment"), F.when(s % 3 == 0, F.lit(0.25)).alias("review_load"), F.when(s % 5 == 0, 100).alias("full_pass_count"), F.lit(9).alias("pass_count"), F.lit(None).cast("int").alias("full_fail_count"), F.lit(4).alias("fail_count"), F.lit(None).cast("int").alias("full_uncertain_count"))
    return catalog.report_view(report)


cases("preview_page", ["int", "array<int>", "array<int>", "array<int>", "array<int>"], "INTEGER", [(3, [4], [], [], [5], 3), (3, [3, 4], [4, 0, 6], [7], [], 6), (3, [3], None, [7], [8], 7), (3, [3], [3], [3], [8], 8), (3, [3], [], None, None, 3)], catalog.preview_page, "UX10: no colour plate, if there is another page.")
cases("field_keys", ["string"], "VARCHAR", [(" Rim Diameter (cm) ", "rim_diameter_cm"), ("口径", None), ("2nd side", None), ("a--B", "a_b")], catalog.field_key, "UX12.")


@query("""WITH k AS (SELECT s_nationkey, s_suppkey, 'rim_' || (s_suppkey % 3) AS base FROM supplier), n AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey, base ORDER BY s_suppkey) AS n FROM k)
SELECT s_suppkey AS ord, CASE WHEN n = 1 THEN base ELSE base || '_' || n END AS key FROM n""")
def numbered_keys(spark: SparkSession, sf: str) -> Frame:
    """UX12."""
    k = F.col("s_suppkey")
    labels = table(spark, sf, "supplier").select("s_nationkey", k.alias("ord"), F.concat(F.lit("Rim "), text(k % 3)).alias("label"))
    return catalog.numbered_keys(labels, "s_nationkey").select("ord", "key")


_ITEMS = "items AS (SELECT o_orderkey AS item_id, 'M' || (o_custkey % 20) || ':' || (o_orderkey % 7) AS artifact_id, [(o_orderkey % 40)::INTEGER] AS pages FROM orders), f AS (SELECT l_orderkey AS item_id, CASE WHEN l_linenumber % 2 = 0 THEN 'texture' ELSE 'category' END AS key, l_returnflag || 'x' AS actual, l_linestatus || 'rail' AS expected FROM lineitem)"


def _item_search(spark: SparkSession, sf: str, query_: str, key: str) -> Frame:
    k = F.col("o_orderkey")
    items = table(spark, sf, "orders").select(k.alias("item_id"), F.concat(named("M", F.col("o_custkey") % 20), F.lit(":"), text(k % 7)).alias("artifact_id"), F.array((k % 40).cast("int")).alias("source_pages"))
    results = lines(spark, sf).select(F.col("l_orderkey").alias("item_id"), F.when(F.col("l_linenumber") % 2 == 0, "texture").otherwise("category").alias("key"), F.concat("l_returnflag", F.lit("x")).alias("actual"), F.concat("l_linestatus", F.lit("rail")).alias("expected"))
    return catalog.item_search(items, results, query_, key).select("item_id")


@query(f"WITH {_ITEMS} SELECT item_id FROM items WHERE contains(replace(lower(artifact_id), ':', ''), 'm135')")
def search_item_ids(spark: SparkSession, sf: str) -> Frame:
    """UX5: separators do not count."""
    return _item_search(spark, sf, " m13，5 ", "artifact_id")


@query(f"WITH {_ITEMS} SELECT item_id FROM items WHERE EXISTS (SELECT 1 FROM f WHERE f.item_id = items.item_id AND key = 'texture' AND (contains(lower(actual), 'orail') OR contains(lower(expected), 'orail')))")
def search_item_field(spark: SparkSession, sf: str) -> Frame:
    """UX5."""
    return _item_search(spark, sf, "ORail", "texture")


@query(f"WITH {_ITEMS} SELECT item_id FROM items WHERE contains(lower(artifact_id), '3') OR contains(pages[1]::VARCHAR, '3')")
def search_items_all(spark: SparkSession, sf: str) -> Frame:
    """UX5: identifiers, pages and values."""
    return _item_search(spark, sf, "3", "all")
