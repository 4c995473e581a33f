"""Rule-based verification: checks, verdicts, confusion, failures and balanced samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words in a rule's title or description that put it in a scope.
SCOPES = {
    "identifier": ["uniqueid", "artifactid", "identifier", "number", "编号", "器物号", "唯一"],
    "color": ["color", "颜色", "色泽", "表面色", "nullvalue"],
    "figure": ["figure", "caption", "plate", "图注", "图号", "图版", "序号"],
    "measurements": ["size", "dimension", "measurement", "尺寸", "口径", "底径", "高度", "precision"],
    "classification": ["material", "texture", "type", "category", "质地", "类别", "器型", "vessel", "alignment"],
}
# Texts that count as empty here, and the shape of a measurement.
EMPTY = ["", "无", "none", "null", "nan", "无记录"]
MEASURE = r"(?i)\d+(?:\.\d+)?\s*(?:cm|mm|m|厘米|毫米|米|㎝|㎜)?"
# Failure codes, and what a field without a code counts as: where the code is read, and where it is given.
CODES = [
    "artifact_id_missing", "artifact_id_duplicate", "artifact_id_evidence_conflict", "sequence_crop_conflict", "figure_caption_missing", "figure_caption_evidence_conflict", "color_plate_relation_conflict",
    "artifact_crop_missing", "text_evidence_conflict", "structured_measurements_error", "structured_classification_error", "structured_field_evidence_conflict",
]
FIELD_CODES = {
    "artifact_crop": "artifact_crop_missing", "sequence_crop_relation": "sequence_crop_conflict", "figure": "figure_caption_missing", "figure_caption": "figure_caption_evidence_conflict",
    "measurements": "structured_measurements_error", "classification": "structured_classification_error", "text_evidence": "text_evidence_conflict", "color_plate_relation": "color_plate_relation_conflict",
}
MODEL_FIELD_CODES = {
    "identifier": "artifact_id_evidence_conflict", "artifact_id": "artifact_id_evidence_conflict", "sequence_crop_relation": "sequence_crop_conflict", "number_crop_relation": "sequence_crop_conflict",
    "figure": "figure_caption_evidence_conflict", "figure_caption": "figure_caption_evidence_conflict", "caption": "figure_caption_evidence_conflict", "color_plate_relation": "color_plate_relation_conflict",
    "artifact_crop": "artifact_crop_missing", "text_evidence": "text_evidence_conflict", "measurements": "structured_measurements_error", "classification": "structured_classification_error",
}
RULE_CODES = {"figure": "figure_caption_missing", "measurements": "structured_measurements_error", "classification": "structured_classification_error"}
OTHER_MODEL_CODE = "structured_field_evidence_conflict"
UNCLASSIFIED = "unclassified_failure"
BUCKETS = [(0.85, "high"), (0.60, "medium")]


def filled(c: Column) -> Column:
    text = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return ~text.isin(EMPTY)


def rule_scopes(rules: DataFrame) -> DataFrame:
    """rule_id, scope: the scopes that a rule's words name."""
    text = F.regexp_replace(F.lower(F.concat_ws(" ", "title", "description")), r"[\s_\-]+", "")
    named = [F.when(text.rlike("|".join(words)), F.lit(scope)) for scope, words in SCOPES.items()]
    return rules.select("rule_id", F.explode(F.array_compact(F.array(*named))).alias("scope"))


def effective_rules(baseline: DataFrame, selected: DataFrame) -> DataFrame:
    """Baseline rules, then selected ones, each title and description once whatever their case."""
    rules = baseline.withColumn("part", F.lit(0)).unionByName(selected.withColumn("part", F.lit(1)))
    w = Window.partitionBy(F.lower(F.trim("title")), F.lower(F.trim("description"))).orderBy("part", "ord")
    return rules.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def check_rules(records: DataFrame, scopes: list[str]) -> DataFrame:
    """record_id, scope, verdict for each record and scope, or a check of completeness where no scope applies.

    ``records``: record_id, artifact_id, surface_color_status, figure_caption, measurements, texture, category, material.
    Identifiers are counted by an aggregate and a join, so a repeated identifier is no window partition.
    """
    has_id = filled(F.col("artifact_id"))
    counts = records.filter(has_id).groupBy(F.col("artifact_id").alias("__id")).agg(F.count("*").alias("__n"))
    joined = records.join(counts, F.col("artifact_id") == F.col("__id"), "left")
    size, caption = F.col("measurements").rlike(MEASURE), filled(F.col("figure_caption"))
    good = {
        "identifier": has_id & (F.coalesce("__n", F.lit(0)) == 1),
        "color": ~F.coalesce(F.lower("surface_color_status"), F.lit("")).isin("invalid", "ambiguous"),
        "figure": caption,
        "measurements": filled(F.col("measurements")) & size,
        "classification": filled(F.col("texture")) | filled(F.col("category")) | filled(F.col("material")),
        "completeness": has_id & caption & F.coalesce(size, F.lit(False)),
    }
    rows = [F.struct(F.lit(s).alias("scope"), F.when(F.coalesce(good[s], F.lit(False)), "passed").otherwise("failed").alias("verdict")) for s in (sorted(scopes) or ["completeness"])]
    return joined.select("record_id", F.inline(F.array(*rows)))


def expected_label(checks: DataFrame) -> DataFrame:
    """record_id, label: correct if every check passed; without checks incorrect."""
    return checks.groupBy("record_id").agg(F.when(F.bool_and(F.col("verdict") == "passed"), "correct").otherwise("incorrect").alias("label"))


def confidence_bucket(c: Column) -> Column:
    c = F.coalesce(c, F.lit(0.0))
    return F.when(c >= BUCKETS[0][0], BUCKETS[0][1]).when(c >= BUCKETS[1][0], BUCKETS[1][1]).otherwise("low")


def method_class(methods: Column) -> Column:
    """ocr_exact, layout_fallback or other, from the methods of a record's relations."""
    ocr = F.exists(methods, lambda m: F.contains(m, F.lit("ocr")) & ~F.contains(m, F.lit("fallback")))
    layout = F.exists(methods, lambda m: m.rlike("fallback|directional|nearest|spatial|global"))
    return F.when(ocr, "ocr_exact").when(layout, "layout_fallback").otherwise("other")


def fail_closed(verdict: Column, unavailable: Column) -> Column:
    """Uncertain fails unless the model could not be asked."""
    return F.when((verdict == "uncertain") & ~unavailable, "failed").otherwise(verdict)


def run_totals(items: DataFrame) -> DataFrame:
    """Totals of a run; it is invalid if a fifth or more of its items could not be judged."""
    v = F.col("verdict")
    one = items.agg(F.count("*").alias("total"), F.count_if(v == "passed").alias("passed"), F.count_if(v == "failed").alias("failed"), F.count_if(v == "uncertain").alias("uncertain"), F.count_if("model_unavailable").alias("unavailable"))
    return one.withColumn("run_valid", ~((F.col("total") > 0) & (F.col("unavailable") * 5 >= F.col("total"))))


def confusion(items: DataFrame) -> DataFrame:
    """Human against machine: a true positive is a failure both saw; uncertain and unreviewed items do not count. Rates have four
    places, null where nothing can be divided; the pass rate is the human's alone."""
    h, m = F.col("human"), F.col("machine")
    n = items.agg(*(F.count_if((h == a) & (m == b)).alias(name) for name, a, b in (("tp", "failed", "failed"), ("fn", "failed", "passed"), ("fp", "passed", "failed"), ("tn", "passed", "passed"))), F.count_if(h == "passed").alias("pass_count"), F.count_if(h == "failed").alias("fail_count"))
    tp, fn, fp, tn = map(F.col, ("tp", "fn", "fp", "tn"))
    total = tp + fn + fp + tn
    rate = {"coverage": (tp, tp + fn), "precision": (tp, tp + fp), "alignment": (tp + tn, total), "review_load": (tp + fp, total), "false_positive_rate": (fp, tn + fp), "false_negative_rate": (fn, tp + fn)}
    passed = F.try_divide("pass_count", F.col("pass_count") + F.col("fail_count"))
    return n.select("*", total.alias("compared"), *(F.round(F.try_divide(a, b), 4).alias(name) for name, (a, b) in rate.items()), F.round(F.coalesce(passed, F.lit(0.0)), 4).alias("pass_rate"))


def _mapped(c: Column, values: dict[str, str], other: Column) -> Column:
    out = other
    for name, value in values.items():
        out = F.when(c == name, value).otherwise(out)
    return out


def failure_code(code: Column, field: Column, reason: Column) -> Column:
    """The code of a failed field: its own if it is one, else what its field stands for; never read from wording, but for
    identifiers, where a reason says whether one is repeated."""
    code, field = F.trim(F.coalesce(code, F.lit(""))), F.lower(F.trim(F.coalesce(field, F.lit(""))))
    repeated = F.when(F.contains(F.coalesce(reason, F.lit("")), F.lit("重复")), "artifact_id_duplicate").otherwise("artifact_id_missing")
    return F.when(code.isin([*CODES, UNCLASSIFIED]), code).when(field == "identifier", repeated).otherwise(_mapped(field, FIELD_CODES, F.lit(UNCLASSIFIED)))


def rule_result(scope: Column, verdict: Column, reason: Column) -> Column:
    """What a rule's check says in a card's results: field, verdict, failure_code, method, causes_overall_failure."""
    code = F.when(scope == "identifier", F.when(F.contains(reason, F.lit("重复")), "artifact_id_duplicate").otherwise("artifact_id_missing")).otherwise(_mapped(scope, RULE_CODES, F.lit(None).cast("string")))
    return F.struct(scope.alias("field"), verdict.alias("verdict"), code.alias("failure_code"), F.lit("rule_heuristic").alias("method"), (verdict == "failed").alias("causes_overall_failure"))


def model_result(field: Column, verdict: Column, code: Column, causes: Column, overall: Column) -> Column:
    """A model's finding on a field, held to known verdicts and codes. It is a cause only where the card failed and the field
    did; what it says otherwise is kept as a doubt. ``causes`` is text, null where the model said nothing."""
    said = F.lower(F.coalesce(verdict, F.lit("uncertain")))
    said = F.when(said.isin("passed", "failed", "uncertain"), said).otherwise("uncertain")
    failed = (overall == "failed") & (said == "failed")
    known = F.trim(F.coalesce(code, F.lit("")))
    given = F.when(known.isin(CODES), known).otherwise(_mapped(F.lower(F.trim(F.coalesce(field, F.lit("")))), MODEL_FIELD_CODES, F.lit(OTHER_MODEL_CODE)))
    cause = failed & F.when(causes.isNull(), failed).otherwise(F.lower(F.trim(causes)) == "true")
    return F.struct(field.alias("field"), said.alias("verdict"), given.alias("failure_code"), F.lit("semantic_llm").alias("method"), cause.alias("causes_overall_failure"))


def failure_distribution(items: DataFrame) -> DataFrame:
    """code, count over distinct (record, code) of failed cards; only fields that failed and caused it count, and a card
    without any counts as unclassified. ``items``: record_id, verdict, field_results (field, verdict, failure_code, reason,
    causes_overall_failure)."""
    failed = items.filter("verdict = 'failed'")
    causal = F.filter("field_results", lambda r: (r["verdict"] == "failed") & F.coalesce(r["causes_overall_failure"], F.lit(False)))
    codes = F.array_distinct(F.transform(causal, lambda r: failure_code(r["failure_code"], r["field"], r["reason"])))
    own = failed.select("record_id", F.explode(F.when(F.size(F.coalesce(codes, F.array())) > 0, codes).otherwise(F.array(F.lit(UNCLASSIFIED)))).alias("code"))
    return own.distinct().groupBy("code").agg(F.count("*").alias("count")).orderBy(F.desc("count"), "code")


def review_required(items: DataFrame) -> DataFrame:
    """How many passed cards have a failed or uncertain field, beside all failed cards."""
    doubtful = F.exists("field_results", lambda r: r["verdict"].isin("failed", "uncertain"))
    v = F.col("verdict")
    return items.agg(F.count_if((v == "passed") & F.coalesce(doubtful, F.lit(False))).alias("passed_with_doubt"), F.count_if(v == "failed").alias("failed"))


def consensus(human: Column, machine: Column, benchmark: Column | None = None) -> Column:
    """agreed where the machine passed or failed a card as the human did, else conflict (uncertain and missing verdicts too);
    benchmark_unavailable where the benchmark was to be asked and could not."""
    agreed = F.coalesce(machine.isin("passed", "failed") & (human == machine), F.lit(False))
    out = F.when(agreed, "agreed").otherwise("conflict")
    return out if benchmark is None else F.when(benchmark == "unavailable", "benchmark_unavailable").otherwise(out)


def sample_consensus(sample: DataFrame, machine: DataFrame) -> DataFrame:
    """The fixed sample with the machine's blind verdicts: record_id, verdict, ai_verdict, ai_confidence, model_unavailable,
    consensus_status (null where the machine has no row: uncertain, and unavailable). Human columns stay."""
    found = machine.select("record_id", F.coalesce("verdict", F.lit("uncertain")).alias("ai_verdict"), F.coalesce("confidence", F.lit(0.0)).alias("ai_confidence"), F.lit(True).alias("__met"))
    joined = sample.join(found, "record_id", "left")
    met = F.coalesce("__met", F.lit(False))
    return joined.select(*sample.columns, F.coalesce("ai_verdict", F.lit("uncertain")).alias("ai_verdict"), F.coalesce("ai_confidence", F.lit(0.0)).alias("ai_confidence"), (~met).alias("model_unavailable"), F.when(met, consensus(F.col("verdict"), F.col("ai_verdict"))).alias("consensus_status"))


HUMAN = ["verdict", "reviewed_at", "failure_code", "failure_reason"]


def merged_results(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items with the columns of a run's results over their own, but for the four columns a human filled; items without a result
    stay as they are."""
    new = [c for c in results.columns if c in items.columns and c not in (*HUMAN, "record_id")]
    taken = results.select("record_id", F.struct(*new).alias("__new"))
    return items.join(taken, "record_id", "left").select(*(F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in items.columns))


def rechecked(previous: DataFrame, machine: DataFrame) -> DataFrame:
    """The last version's items with another run's machine columns: human columns are carried on, what the first review's
    model said is cleared and consensus is pending. Cards that the run has not seen have no machine verdict."""
    found = machine.select("record_id", F.col("verdict").alias("__v"), F.col("confidence").alias("__c"), F.substring(F.coalesce("reason", F.lit("")), 1, 1000).alias("__r"))
    joined = previous.join(found, "record_id", "left")
    fresh = {"machine_verdict": F.col("__v"), "machine_confidence": F.col("__c"), "machine_reason": F.coalesce("__r", F.lit("")), "ai_verdict": F.lit(None).cast("string"), "consensus_status": F.lit("pending")}
    return joined.select(*(c for c in previous.columns if c not in fresh), *(v.alias(k) for k, v in fresh.items()))


def calibrated(items: DataFrame, machine: DataFrame) -> DataFrame:
    """A session's items with the verdicts of the run after calibration beside the blind ones; cards it has not seen have none."""
    found = machine.select("record_id", F.col("verdict").alias("calibrated_machine_verdict"), F.col("confidence").alias("calibrated_machine_confidence"), F.substring(F.coalesce("reason", F.lit("")), 1, 1000).alias("__r"))
    return items.join(found, "record_id", "left").select(*items.columns, "calibrated_machine_verdict", "calibrated_machine_confidence", F.coalesce("__r", F.lit("")).alias("calibrated_machine_reason"))


def profiles(records: DataFrame, relations: DataFrame, regions: DataFrame, checks: DataFrame) -> DataFrame:
    """record_id, expected_label, primary_page, confidence_bucket, matching_method, page_scope, has_color_plate, tags of records
    (record_id, entity_confidence, source_pages, associated_pages, relation_ids, region_ids).

    Without an entity's confidence the least score of a record's relations counts. ``checks`` are those of ``check_rules``.
    """
    via = records.select("record_id", F.explode(F.array_distinct("relation_ids")).alias("id")).join(relations.select("id", "score", "method"), "id")
    linked = via.groupBy("record_id").agg(F.min("score").alias("__score"), F.collect_set("method").alias("__methods"))
    plates = records.select("record_id", F.explode("region_ids").alias("id")).join(regions.filter("kind = 'color_plate'").select("id").distinct(), "id").select("record_id").distinct().withColumn("__plate", F.lit(True))
    ruled = checks.groupBy("record_id").agg(F.min(F.col("verdict") == "passed").alias("__good"), F.array_sort(F.collect_set(F.concat(F.lit("rule:"), "scope", F.when(F.col("verdict") == "passed", ":covered").otherwise(":issue")))).alias("__rules"))
    joined = records.join(linked, "record_id", "left").join(plates, "record_id", "left").join(ruled, "record_id", "left")
    pages = lambda c: F.filter(F.coalesce(c, F.array().cast("array<int>")), lambda p: p > 0)
    source, other = pages(F.col("source_pages")), pages(F.col("associated_pages"))
    out = joined.select(
        "record_id",
        F.when(F.coalesce("__good", F.lit(False)), "correct").otherwise("incorrect").alias("expected_label"),
        F.coalesce(F.array_min(source), F.array_min(other), F.lit(0)).alias("primary_page"),
        confidence_bucket(F.coalesce("entity_confidence", "__score", F.lit(0.0))).alias("confidence_bucket"),
        method_class(F.coalesce("__methods", F.array().cast("array<string>"))).alias("matching_method"),
        F.when(F.size(F.array_except(other, source)) > 0, "cross_page").otherwise("same_page").alias("page_scope"),
        F.coalesce("__plate", F.lit(False)).alias("has_color_plate"),
        F.coalesce("__rules", F.array(F.lit("rule:general:covered"))).alias("__rules"),
    )
    tag = lambda name, c: F.concat(F.lit(f"{name}:"), c)
    tags = F.concat(F.array(tag("expected", F.col("expected_label")), tag("confidence", F.col("confidence_bucket")), tag("method", F.col("matching_method")), tag("scope", F.col("page_scope")), tag("color", F.when(F.col("has_color_plate"), "present").otherwise("absent"))), F.col("__rules"))
    return out.withColumn("tags", tags).drop("__rules")


def visual_context(records: DataFrame, regions: DataFrame, relations: DataFrame) -> DataFrame:
    """Per record what pictures it has: flags by the kinds of its regions (unknown ones are other), the number of its relations
    and their types."""
    own = records.select("record_id", F.explode(F.array_distinct("region_ids")).alias("id")).join(regions.select("id", "kind"), "id", "left")
    kinds = own.groupBy("record_id").agg(F.array_sort(F.collect_set(F.coalesce("kind", F.lit("other")))).alias("region_kinds"))
    via = records.select("record_id", F.explode("relation_ids").alias("id")).join(relations.select("id", "relation_type"), "id")
    types = via.groupBy("record_id").agg(F.count("*").alias("relation_count"), F.array_sort(F.collect_set(F.nullif("relation_type", F.lit("")))).alias("relation_types"))
    none = F.array().cast("array<string>")
    joined = records.select("record_id").join(kinds, "record_id", "left").join(types, "record_id", "left")
    joined = joined.withColumns({"region_kinds": F.coalesce("region_kinds", none), "relation_types": F.coalesce("relation_types", none), "relation_count": F.coalesce("relation_count", F.lit(0))})
    has = lambda *k: F.arrays_overlap("region_kinds", F.array(*map(F.lit, k)))
    return joined.select("record_id", has("artifact", "line_drawing").alias("artifact_crop_present"), has("color_plate").alias("color_plate_present"), has("caption").alias("caption_present"), has("number").alias("number_present"), "relation_count", "relation_types", "region_kinds")


def evidence_quotes(evidence: DataFrame, most: int = 5) -> DataFrame:
    """record_id, key, quotes: the first quotes that say something, per field. ``evidence``: record_id, key, pos, quote."""
    some = evidence.withColumn("quote", F.trim("quote")).filter("quote <> ''")
    return some.groupBy("record_id", "key").agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("pos", "quote"))), 1, most), lambda x: x["quote"]).alias("quotes"))


def judged(checks: Column, context: Column, findings: Column, overall: Column, most: int = 50) -> Column:
    """A card's results in order: rule checks, whether it has a crop, whether it has relations, then the model's findings; the
    first ``most``. ``checks``: array of scope, verdict, reason; ``findings``: array of field, verdict, failure_code, causes."""
    fixed = lambda field, verdict, code, method, cause: F.struct(F.lit(field).alias("field"), verdict.alias("verdict"), F.lit(code).cast("string").alias("failure_code"), F.lit(method).alias("method"), cause.alias("causes_overall_failure"))
    crop, linked = context["artifact_crop_present"], context["relation_count"] > 0
    presence = F.array(fixed("artifact_crop", F.when(crop, "passed").otherwise("failed"), "artifact_crop_missing", "deterministic_presence", ~crop), fixed("evidence_relation_chain", F.when(linked, "passed").otherwise("uncertain"), None, "deterministic_relation_presence", F.lit(False)))
    rules = F.transform(checks, lambda c: rule_result(c["scope"], c["verdict"], c["reason"]))
    model = F.transform(findings, lambda f: model_result(f["field"], f["verdict"], f["failure_code"], f["causes"], overall))
    return F.slice(F.concat(rules, presence, model), 1, most)


def next_version(versions: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per job (job_id, baseline asked for) the version a run would make and whether it may: the first takes baseline v1, the
    second v2, and later ones are refused."""
    last = versions.groupBy("job_id").agg(F.max("version").alias("__last"))
    target = F.coalesce("__last", F.lit(0)) + 1
    due = F.when(target == 1, "v1").when(target == 2, "v2")
    return jobs.join(last, "job_id", "left").select("job_id", target.alias("target_version"), F.when(due.isNull(), "no_baseline").when(F.col("baseline") == due, "allowed").otherwise("wrong_baseline").alias("gate"))


def resettable(versions: DataFrame, runs: DataFrame) -> DataFrame:
    """Per job what a reset of its first version does: nothing (there is none), or a refusal because of a later version, because
    no machine run made it, or because the model was available for more than four fifths; else reset."""
    per = versions.groupBy("job_id").agg(F.max("version").alias("__last"), F.max_by("run_id", F.when(F.col("version") == 1, 1)).alias("run_id"), F.bool_or(F.col("version") == 1).alias("__first"))
    joined = per.join(runs.select("run_id", "total", "unavailable"), "run_id", "left")
    broken = (F.coalesce("unavailable", F.lit(0)) > 0) & (F.coalesce("total", F.lit(0)) > 0) & (F.col("unavailable") * 5 >= F.col("total"))
    return joined.select("job_id", F.when(~F.col("__first"), "nothing").when(F.col("__last") > 1, "later_version").when(F.col("run_id").isNull(), "no_run").when(broken, "reset").otherwise("no_outage").alias("outcome"))


def balanced_sample(rows: DataFrame, size: int, seed: int, borrow: bool = False, label: str = "label", first: str = "correct", key: str = "record_id") -> DataFrame:
    """``size`` rows, half of them with the ``first`` label, by a seeded hash order.

    Without borrowing a short pool stays short; with it the rest comes from the other pool. Each pool is a top-k of its own,
    so no pool is sorted in one task.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    ranked = rows.withColumn("__h", h)
    half = size // 2
    pools = [ranked.filter(F.col(label) == first), ranked.filter(F.col(label) != first)]
    take = [half, size - half]
    if not borrow:
        a, b = (p.orderBy("__h").limit(n) for p, n in zip(pools, take, strict=True))
        return a.unionByName(b).drop("__h")
    tops = [p.orderBy("__h").limit(size).withColumn("__n", F.row_number().over(Window.orderBy("__h"))) for p in pools]  # at most ``size`` rows each
    both = tops[0].withColumn("__extra", F.col("__n") > take[0]).unionByName(tops[1].withColumn("__extra", F.col("__n") > take[1]))
    return both.orderBy("__extra", "__n", "__h").limit(size).drop("__h", "__n", "__extra")
