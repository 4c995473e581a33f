"""Queries: evaluation, verification and re-matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sondage.functions import geometry as g
from sondage.functions.text import figure_tokens, measurement_overlap, measurement_tokens, measurements
from sondage.operators import evaluate, match, rematch, verify
from sondage.operators.evaluate import field_metrics, field_results, human_left_join
from sondage.plans.adapters import GOLD_FIELDS, GOLD_SQL, ITEMS_SQL, LINKS_SQL, RESULTS_SQL, gold_rows, items, predictions, snapshots
from sondage.plans.registry import query
from sondage.session import table

Frame = DataFrame


@query(f"WITH {GOLD_SQL} SELECT gold_id, key, pred_count::BIGINT AS pred_count, gold_count::BIGINT AS gold_count, match_status FROM joined")
def eval_human_left_join(spark: SparkSession, sf: str) -> Frame:
    return human_left_join(gold_rows(spark, sf), predictions(spark, sf)).select("gold_id", "key", "pred_count", "gold_count", "match_status")


@query(f"WITH {GOLD_SQL} SELECT key, status, priority, n_lines::BIGINT AS n_lines, l_suppkey, variant FROM pred WHERE key NOT IN (SELECT key FROM gold)")
def eval_unmatched_predictions(spark: SparkSession, sf: str) -> Frame:
    return evaluate.unmatched_predictions(predictions(spark, sf), gold_rows(spark, sf)).select("key", "status", "priority", "n_lines", "l_suppkey", "variant")


def _results(spark: SparkSession, sf: str) -> Frame:
    joined = human_left_join(gold_rows(spark, sf), predictions(spark, sf).select("key", *GOLD_FIELDS))
    return field_results(joined.withColumnRenamed("key", "join_key"), GOLD_FIELDS)


_METRICS = """,
agg AS (SELECT key, count(*) AS evaluated, count(*) FILTER (verdict = 'matched') AS matched, count(*) FILTER (exact) AS exact, count(*) FILTER (verdict = 'missing') AS missing,
               count(*) FILTER (verdict = 'mismatched') AS mismatched, avg(score) AS mean_score FROM results WHERE verdict NOT IN ('not_applicable', 'not_evaluated') GROUP BY key),
metrics AS (SELECT f.key, coalesce(evaluated, 0)::BIGINT AS evaluated, coalesce(matched, 0)::BIGINT AS matched, coalesce(exact, 0)::BIGINT AS exact, coalesce(missing, 0)::BIGINT AS missing,
                   coalesce(mismatched, 0)::BIGINT AS mismatched, 0::BIGINT AS extra, mean_score, exact / evaluated AS exact_rate
            FROM (VALUES {fields}) f(key) LEFT JOIN agg ON f.key = agg.key)
"""
_TWO = _METRICS.format(fields="('status'), ('priority')")


@query(f"WITH {RESULTS_SQL}{_TWO} SELECT * FROM metrics")
def eval_field_metrics(spark: SparkSession, sf: str) -> Frame:
    return field_metrics(_results(spark, sf), GOLD_FIELDS)


@query(f"WITH {RESULTS_SQL}{_METRICS.format(fields=chr(44).join(chr(40) + repr(f) + chr(41) for f in ['status', 'priority', 'texture', 'morphology']))} SELECT * FROM metrics")
def eval_field_dimension_fill(spark: SparkSession, sf: str) -> Frame:
    return field_metrics(_results(spark, sf), [*GOLD_FIELDS, "texture", "morphology"])


@query(f"""WITH {RESULTS_SQL}{_TWO}
SELECT (SELECT count(*) FROM joined)::BIGINT AS gold_rows, (SELECT count(*) FROM joined WHERE match_status = 'matched')::BIGINT AS matched, (SELECT count(*) FROM joined WHERE match_status = 'ambiguous')::BIGINT AS ambiguous,
       (SELECT count(*) FROM joined WHERE match_status = 'not_found')::BIGINT AS not_found, (SELECT avg(mean_score) FROM metrics) AS macro_score, (SELECT avg(exact_rate) FROM metrics) AS macro_exact,
       (SELECT count(*) FROM pred)::BIGINT AS predictions, (SELECT count(*) FROM joined WHERE match_status = 'matched') / (SELECT count(*) FROM pred) AS precision, (SELECT count(*) FROM joined WHERE match_status = 'matched') / (SELECT count(*) FROM joined) AS recall""")
def eval_summary(spark: SparkSession, sf: str) -> Frame:
    gold, pred = gold_rows(spark, sf), predictions(spark, sf)
    joined = human_left_join(gold, pred.select("key", *GOLD_FIELDS))
    metrics = field_metrics(field_results(joined.withColumnRenamed("key", "join_key"), GOLD_FIELDS), GOLD_FIELDS)
    return evaluate.summary(joined, metrics, pred.filter("key <> ''"), full_document=True)


@query(r"""
WITH w AS (SELECT doc_id, lang, string_split_regex(lower(text), '[^a-z0-9]+') AS words FROM documents),
a AS (SELECT item_id, string_split_regex(lower(text), '[^a-z0-9]+')[1:2] AS tokens FROM benchmark),
n AS (SELECT count(*) AS n FROM benchmark),
p AS (SELECT w.lang AS key, len(list_distinct(a.tokens)) > 0 AND len([x FOR x IN a.tokens IF NOT list_contains(w.words, x)]) = 0 AS hit FROM w JOIN n ON true JOIN a ON a.item_id = w.doc_id % n.n)
SELECT key, count(*)::BIGINT AS evaluated, count(*) FILTER (hit)::BIGINT AS hit, avg(hit::INTEGER)::DOUBLE AS hit_rate FROM p GROUP BY key""")
def eval_anchor_hits(spark: SparkSession, sf: str) -> Frame:
    words = lambda c: F.split(F.lower(c), "[^a-z0-9]+")
    anchors = table(spark, sf, "benchmark").select("item_id", F.slice(words(F.col("text")), 1, 2).alias("tokens"))
    total = anchors.agg(F.count("*").alias("n"))
    docs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("key"), F.array_distinct(words(F.col("text"))).alias("words")).crossJoin(total)
    return evaluate.anchor_hits(docs.join(anchors, F.col("item_id") == F.col("doc_id") % F.col("n")), "tokens", "words")


@query("""SELECT l_orderkey, l_linenumber, list_sort(list_distinct([CASE WHEN l_quantity::INTEGER % 10 = 0 THEN (l_quantity::INTEGER // 10)::VARCHAR ELSE (l_quantity::INTEGER // 10) || '.' || (l_quantity::INTEGER % 10) END || 'cm',
       ((l_linenumber + 1) * 100)::VARCHAR || 'cm'])) AS tokens FROM lineitem""")
def eval_measurement_tokens(spark: SparkSession, sf: str) -> Frame:
    text = F.concat(F.lit("H "), F.col("l_quantity").cast("int").cast("string"), F.lit(" mm; W "), (F.col("l_linenumber") + 1).cast("string"), F.lit("m"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", measurement_tokens(text, True).alias("tokens"))


@query("""WITH v AS (SELECT l_linenumber AS n, l_quantity::INTEGER AS q, round(l_tax * 100)::INTEGER AS t FROM lineitem)
SELECT n::INTEGER AS l_linenumber, ((CASE WHEN true THEN 1 ELSE 0 END) + (CASE WHEN t + 1 = n THEN 1 ELSE 0 END)) / 2 AS overlap, count(*)::BIGINT AS count FROM v GROUP BY 1, 2""")
def eval_measurement_overlap(spark: SparkSession, sf: str) -> Frame:
    q, t = F.col("l_quantity").cast("int"), F.round(F.col("l_tax") * 100).cast("int")
    expected = F.concat((q + 1000).cast("string"), F.lit(" cm, "), (t + 1).cast("string"), F.lit(" m"))
    actual = F.concat(F.col("l_linenumber").cast("string"), F.lit("m; "), ((q + 1000) * 10).cast("string"), F.lit("mm"))
    rows = table(spark, sf, "lineitem").select("l_linenumber", measurement_overlap(measurements(expected, True), measurements(actual, True)).alias("overlap"))
    return rows.groupBy("l_linenumber", "overlap").agg(F.count("*").alias("count"))


@query("""WITH v AS (SELECT p_partkey, ['fig' || (p_partkey % 7) || '-' || (p_partkey % 3), 'plate' || (p_partkey % 5)] AS e, ['plate' || (p_size % 5), 'fig' || (p_partkey % 7) || '-' || (p_size % 3)] AS a FROM part)
SELECT p_partkey, len(list_intersect(e, a)) / 2 AS score, len(list_intersect(e, a)) = 2 AS matched FROM v""")
def eval_figure_overlap(spark: SparkSession, sf: str) -> Frame:
    k, s = F.col("p_partkey"), F.col("p_size")
    text = lambda a, b, c, d: F.concat(F.lit("see Fig "), (k % 7).cast("string"), F.lit("-"), (c % 3).cast("string"), F.lit("; Plate "), (d % 5).cast("string"))
    e, a = figure_tokens(text(k, k, k, k), True), figure_tokens(text(k, k, s, s), True)
    score = F.size(F.array_intersect(e, a)) / F.size(e)
    return table(spark, sf, "part").select("p_partkey", score.alias("score"), (score == 1).alias("matched"))


_BOXES = """
boxes AS (SELECT p_partkey AS ord, (p_partkey // 10)::INTEGER AS page, CASE WHEN p_partkey % 2 = 0 THEN 'artifact' ELSE 'caption' END AS kind, (p_partkey % 10) / 10.0 AS l, (p_size % 5) / 64.0 AS shift FROM part),
gold AS (SELECT *, l::DOUBLE AS gl, l::DOUBLE + 0.0625 AS gr FROM boxes),
pairs AS (SELECT kind, page, ord AS pred_ord, ord AS gold_ord, greatest(0.0::DOUBLE, 0.0625::DOUBLE - shift::DOUBLE) * 0.5 AS inter FROM gold),
"""


@query(f"""WITH {_BOXES} x AS (SELECT *, inter / (2 * 0.0625::DOUBLE * 0.5 - inter) AS iou FROM pairs)
SELECT kind, page, pred_ord, gold_ord, round(iou, 9) AS iou FROM x WHERE iou >= 0.25""")
def detect_iou_pairs(spark: SparkSession, sf: str) -> Frame:
    p, t = _detections(spark, sf)
    return match.iou_pairs(p, t, 0.25).withColumn("iou", F.round("iou", 9))


def _detections(spark: SparkSession, sf: str) -> tuple[Frame, Frame]:
    """Ten boxes a page that do not touch each other; predictions are moved sideways by up to a box."""
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(F.floor(k / 10).cast("int").alias("page"), F.when(k % 2 == 0, "artifact").otherwise("caption").alias("kind"), k.alias("ord"), (k % 10 / 10.0).alias("l"), (F.col("p_size") % 5 / 64.0).alias("shift"))
    at = lambda d: g.box(F.col("l") + d, F.lit(0.25), F.col("l") + d + 0.0625, F.lit(0.75)).alias("bbox")
    return rows.select("page", "kind", "ord", at(F.col("shift"))), rows.select("page", "kind", "ord", at(F.lit(0.0)))


@query(f"""WITH {_BOXES} x AS (SELECT *, inter / (2 * 0.0625::DOUBLE * 0.5 - inter) AS iou FROM pairs),
n AS (SELECT kind, count(*) AS total, count(*) FILTER (iou >= 0.5) AS m, coalesce(avg(iou) FILTER (iou >= 0.5), 0.0) AS mean FROM x GROUP BY kind),
k AS (SELECT k.kind, coalesce(total, 0) AS total, coalesce(m, 0) AS m, coalesce(mean, 0.0) AS mean FROM (VALUES ('artifact'), ('caption'), ('group')) k(kind) LEFT JOIN n ON k.kind = n.kind)
SELECT kind, total::BIGINT AS predicted_count, total::BIGINT AS gold_count, m::BIGINT AS matched_count, CASE WHEN total = 0 THEN 1.0 ELSE m / total END::DOUBLE AS precision, CASE WHEN total = 0 THEN 1.0 ELSE m / total END::DOUBLE AS recall,
       CASE WHEN total = 0 THEN 1.0 ELSE m / total END::DOUBLE AS f1, round(mean, 9)::DOUBLE AS mean_iou FROM k""")
def detect_metrics(spark: SparkSession, sf: str) -> Frame:
    p, t = _detections(spark, sf)
    return match.detection_metrics(p, t, ["artifact", "caption", "group"]).withColumn("mean_iou", F.round("mean_iou", 9))


@query("""WITH b AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'artifact' ELSE 'caption' END AS kind, least(p_size % 3, p_size // 3 % 3) AS s FROM part),
n AS (SELECT kind, count(*) AS t, count(*) FILTER (s <= 1) AS m, avg(CASE s WHEN 0 THEN 1.0 ELSE 0.6 END) FILTER (s <= 1) AS mean FROM b GROUP BY 1)
SELECT kind, (2 * t)::BIGINT AS predicted_count, t::BIGINT AS gold_count, m::BIGINT AS matched_count, m / (2 * t) AS precision, m / t AS recall, round(2 * (m / (2 * t)) * (m / t) / (m / (2 * t) + m / t), 9) AS f1, round(mean, 9)::DOUBLE AS mean_iou FROM n""")
def detect_contested(spark: SparkSession, sf: str) -> Frame:
    """GE5, AG5: two predictions for every box; the better one has it, the other stays alone."""
    k, s = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, sf, "part").select(F.floor(k / 10).cast("int").alias("page"), F.when(k % 2 == 0, "artifact").otherwise("caption").alias("kind"), k, (k % 10 / 10.0).alias("l"), F.array(s % 3, F.floor(s / 3) % 3).alias("shifts"))
    at = lambda d: g.box(F.col("l") + d, F.lit(0.25), F.col("l") + d + 0.0625, F.lit(0.75)).alias("bbox")
    found = rows.select("page", "kind", k, "l", F.posexplode("shifts").alias("pos", "shift")).select("page", "kind", (k * 2 + F.col("pos")).alias("ord"), at(F.col("shift") / 64.0))
    own = match.detection_metrics(found, rows.select("page", "kind", k.alias("ord"), at(F.lit(0.0))), ["artifact", "caption"])
    return own.withColumns({"mean_iou": F.round("mean_iou", 9), "f1": F.round("f1", 9)})


@query(f"""WITH {ITEMS_SQL}, n AS (SELECT count(*) FILTER (human = 'failed' AND machine = 'failed') AS tp, count(*) FILTER (human = 'failed' AND machine = 'passed') AS fn,
       count(*) FILTER (human = 'passed' AND machine = 'failed') AS fp, count(*) FILTER (human = 'passed' AND machine = 'passed') AS tn, count(*) FILTER (human = 'passed') AS p, count(*) FILTER (human = 'failed') AS f FROM items)
SELECT tp::BIGINT AS tp, fn::BIGINT AS fn, fp::BIGINT AS fp, tn::BIGINT AS tn, p::BIGINT AS pass_count, f::BIGINT AS fail_count, (tp + fn + fp + tn)::BIGINT AS compared, round(tp / nullif(tp + fn, 0), 4) AS coverage, round(tp / nullif(tp + fp, 0), 4) AS precision, round((tp + tn) / nullif(tp + fn + fp + tn, 0), 4) AS alignment,
       round((tp + fp) / nullif(tp + fn + fp + tn, 0), 4) AS review_load, round(fp / nullif(tn + fp, 0), 4) AS false_positive_rate, round(fn / nullif(tp + fn, 0), 4) AS false_negative_rate, round(coalesce(p / nullif(p + f, 0), 0.0), 4) AS pass_rate FROM n""")
def confusion_matrix(spark: SparkSession, sf: str) -> Frame:
    return verify.confusion(items(spark, sf))


@query(f"""WITH {ITEMS_SQL}, c AS (SELECT record_id, 'text_evidence_conflict' AS code FROM items WHERE machine = 'failed' AND short UNION SELECT record_id, 'artifact_id_duplicate' FROM items WHERE machine = 'failed' AND copy AND record_id % 2 = 0
  UNION SELECT record_id, 'unclassified_failure' FROM items WHERE machine = 'failed' AND NOT short AND NOT (copy AND record_id % 2 = 0))
SELECT code, count(*)::BIGINT AS count FROM c GROUP BY code""")
def failure_distribution(spark: SparkSession, sf: str) -> Frame:
    return verify.failure_distribution(items(spark, sf).withColumn("verdict", F.col("machine")))


@query(f"""WITH {ITEMS_SQL} SELECT count(*) FILTER (machine = 'passed' AND (short OR copy OR odd))::BIGINT AS passed_with_doubt, count(*) FILTER (machine = 'failed')::BIGINT AS failed FROM items""")
def review_required(spark: SparkSession, sf: str) -> Frame:
    return verify.review_required(items(spark, sf).withColumn("verdict", F.col("machine")))


@query(f"""WITH {ITEMS_SQL} SELECT record_id, CASE WHEN machine = 'uncertain' AND NOT model_unavailable THEN 'failed' ELSE machine END AS verdict FROM items""")
def fail_closed_verdicts(spark: SparkSession, sf: str) -> Frame:
    return items(spark, sf).select("record_id", verify.fail_closed(F.col("machine"), F.col("model_unavailable")).alias("verdict"))


@query(f"""WITH {ITEMS_SQL} SELECT count(*)::BIGINT AS total, count(*) FILTER (machine = 'passed')::BIGINT AS passed, count(*) FILTER (machine = 'failed')::BIGINT AS failed, count(*) FILTER (machine = 'uncertain')::BIGINT AS uncertain,
       count(*) FILTER (model_unavailable)::BIGINT AS unavailable, NOT (count(*) > 0 AND count(*) FILTER (model_unavailable) * 5 >= count(*)) AS run_valid FROM items""")
def outage_gate(spark: SparkSession, sf: str) -> Frame:
    return verify.run_totals(items(spark, sf).withColumn("verdict", F.col("machine")))


@query(f"""WITH {ITEMS_SQL} SELECT record_id, CASE WHEN model_unavailable THEN 'benchmark_unavailable' WHEN machine IN ('passed', 'failed') AND human = machine THEN 'agreed' ELSE 'conflict' END AS consensus FROM items""")
def consensus(spark: SparkSession, sf: str) -> Frame:
    return items(spark, sf).select("record_id", verify.consensus(F.col("human"), F.col("machine"), F.when(F.col("model_unavailable"), "unavailable")).alias("consensus"))


_CARDS = """
cards AS (SELECT p_partkey AS record_id, p_name AS artifact_id, CASE WHEN p_size % 4 = 0 THEN 'invalid' ELSE 'valid' END AS color, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_brand END AS caption,
                 CASE WHEN p_size % 6 = 0 THEN 'none' ELSE p_size || ' cm' END AS size, CASE WHEN p_partkey % 10 = 0 THEN 'NULL' ELSE p_type END AS category FROM part),
ids AS (SELECT artifact_id, count(*) AS n FROM cards GROUP BY artifact_id),
checks AS (SELECT c.record_id, unnest(['classification', 'color', 'figure', 'identifier', 'measurements']) AS scope,
                  unnest([lower(trim(category)) NOT IN ('', 'none', 'null', 'nan'), color NOT IN ('invalid', 'ambiguous'), caption <> '', n = 1, size <> 'none']) AS good FROM cards c JOIN ids USING (artifact_id))
"""


def _cards(spark: SparkSession, sf: str) -> Frame:
    size = F.col("p_size")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_name").alias("artifact_id"), F.when(size % 4 == 0, "invalid").otherwise("valid").alias("surface_color_status"), F.when(size % 3 == 0, "").otherwise(F.col("p_brand")).alias("figure_caption"), F.when(size % 6 == 0, "none").otherwise(F.concat(size.cast("string"), F.lit(" cm"))).alias("measurements"), F.lit(None).cast("string").alias("texture"), F.when(F.col("p_partkey") % 10 == 0, "NULL").otherwise(F.col("p_type")).alias("category"), F.lit("").alias("material"))


SCOPES = ["classification", "color", "figure", "identifier", "measurements"]


@query(f"WITH {_CARDS} SELECT record_id, scope, CASE WHEN good THEN 'passed' ELSE 'failed' END AS verdict FROM checks")
def rule_checks(spark: SparkSession, sf: str) -> Frame:
    return verify.check_rules(_cards(spark, sf), SCOPES)


_LABELLED = _CARDS + ", labelled AS (SELECT record_id, CASE WHEN bool_and(good) THEN 'correct' ELSE 'incorrect' END AS label, sha256('7:' || record_id) AS h FROM checks WHERE scope IN ('color', 'figure', 'measurements') GROUP BY record_id)"


@query(f"""WITH {_LABELLED}, a AS (SELECT * FROM labelled WHERE label = 'correct' ORDER BY h LIMIT 9), b AS (SELECT * FROM labelled WHERE label <> 'correct' ORDER BY h LIMIT 9)
SELECT record_id, label FROM a UNION ALL SELECT record_id, label FROM b""")
def balanced_sample(spark: SparkSession, sf: str) -> Frame:
    labels = verify.expected_label(verify.check_rules(_cards(spark, sf), ["color", "figure", "measurements"]))
    return verify.balanced_sample(labels, 18, 7)


@query("""WITH r AS (SELECT s_suppkey AS rule_id, lower(s_name) AS text, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey) SELECT rule_id, 'identifier' AS scope FROM r WHERE rule_id % 2 = 0 UNION ALL SELECT rule_id, 'measurements' FROM r WHERE rule_id % 3 = 0""")
def rule_scope_inference(spark: SparkSession, sf: str) -> Frame:
    k = F.col("s_suppkey")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"))
    rules = table(spark, sf, "supplier").join(nations, "s_nationkey").select(k.alias("rule_id"), F.when(k % 2 == 0, "Unique ID").otherwise("Wording").alias("title"), F.when(k % 3 == 0, "every Size is exact").otherwise("").alias("description"))
    return verify.rule_scopes(rules)


_COMPARED = "o.source_region_id IS DISTINCT FROM n.source_region_id OR o.target_region_id IS DISTINCT FROM n.target_region_id OR o.relation_type IS DISTINCT FROM n.relation_type OR o.score IS DISTINCT FROM n.score OR o.method IS DISTINCT FROM n.method"


@query(f"""WITH {LINKS_SQL} SELECT coalesce(o.id, n.id) AS id, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' ELSE 'changed' END AS change, o.score AS before_score, n.score AS after_score
FROM old o FULL JOIN new n ON o.id = n.id WHERE o.id IS NULL OR n.id IS NULL OR {_COMPARED}""")
def rematch_diff(spark: SparkSession, sf: str) -> Frame:
    return rematch.diff(*snapshots(spark, sf)).select("id", "change", F.col("before.score").alias("before_score"), F.col("after.score").alias("after_score"))


@query(f"""WITH {LINKS_SQL}, kept AS (SELECT * FROM old WHERE review_status = 'accepted'), rej AS (SELECT DISTINCT source_region_id, target_region_id, relation_type FROM old WHERE review_status = 'rejected')
SELECT id, score, review_status, true AS protected FROM kept UNION ALL
SELECT id, score, review_status, false FROM new n WHERE NOT EXISTS (SELECT 1 FROM rej r WHERE r.source_region_id = n.source_region_id AND r.target_region_id = n.target_region_id AND r.relation_type = n.relation_type) AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.id = n.id)""")
def rematch_protection(spark: SparkSession, sf: str) -> Frame:
    return rematch.protect(*snapshots(spark, sf)).select("id", "score", "review_status", "protected")


@query(f"""WITH {LINKS_SQL}, d AS (SELECT CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.method IS DISTINCT FROM n.method OR o.score IS DISTINCT FROM n.score THEN 'changed' ELSE 'unchanged' END AS c FROM old o FULL JOIN new n ON o.id = n.id)
SELECT (SELECT count(*) FROM d WHERE c = 'added')::BIGINT AS added, (SELECT count(*) FROM d WHERE c = 'removed')::BIGINT AS removed, (SELECT count(*) FROM d WHERE c = 'changed')::BIGINT AS changed, (SELECT count(*) FROM d WHERE c = 'unchanged')::BIGINT AS unchanged,
       count(*) FILTER (score >= 0.85)::BIGINT AS confidence_high, count(*) FILTER (score >= 0.6 AND score < 0.85)::BIGINT AS confidence_medium, count(*) FILTER (score < 0.6)::BIGINT AS confidence_low,
       count(*) FILTER (contains(method, 'ocr'))::BIGINT AS method_ocr, count(*) FILTER (contains(method, 'fallback'))::BIGINT AS method_fallback, count(*) FILTER (contains(method, 'directional'))::BIGINT AS method_directional, count(*) FILTER (contains(method, 'spatial'))::BIGINT AS method_spatial FROM new""")
def rematch_report(spark: SparkSession, sf: str) -> Frame:
    return rematch.report(*snapshots(spark, sf))


@query("""SELECT r.r_regionkey AS record_id, n.n_nationkey AS n_nationkey, coalesce(CASE WHEN n.n_nationkey % 3 = 0 THEN NULL ELSE 'crop' || n.n_nationkey END,
       (SELECT 'crop' || max(m.n_nationkey) FROM nation m WHERE m.n_regionkey = r.r_regionkey AND m.n_nationkey % 3 <> 0)) AS crop FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""")
def sibling_crops(spark: SparkSession, sf: str) -> Frame:
    k = F.col("n_nationkey")
    rows = table(spark, sf, "nation").select(F.col("n_regionkey").alias("entity_id"), k, k.alias("ord"), F.when(k % 3 != 0, F.concat(F.lit("crop"), k.cast("string"))).alias("crop"))
    return evaluate.sibling_fill(rows, ["crop"]).select(F.col("entity_id").alias("record_id"), "n_nationkey", "crop")
