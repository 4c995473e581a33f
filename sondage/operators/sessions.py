"""Runs, review sessions, experiments and snapshots as tables: every step takes the rows as they are and returns them as they
become, with what was refused and why. All of it is set-at-a-time, so a step over one job is the step over all jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.functions.text import signature

# States that a run or session is active in, and states of a job that is done.
ACTIVE_RUN = ["queued", "running"]
ACTIVE_EVALUATION = ["queued", "running", "paused"]
ACTIVE_REMATCH = ["queued", "running", "applying", "cancelling"]
ENDED_REMATCH = ["completed", "applied", "failed", "cancelled"]
ACTIVE_SESSION = ["in_progress", "ai_review", "conflict_review"]
DONE_JOB = ["completed", "completed_with_warnings"]
RETRIABLE_JOB = [*DONE_JOB, "failed", "cancelled"]
# What a run may be asked to do: states it may be in, the state after, the state in which it is done already.
ACTIONS = {"pause": (["queued", "running"], "paused"), "resume": (["paused"], "queued"), "terminate": (["queued", "running", "paused"], "terminated")}
FIRST_MATCHING = "M0"


def run_action(runs: DataFrame, action: str) -> DataFrame:
    """Runs after pause, resume or terminate, with ``outcome``: moved, already (pausing a paused run, ending an ended one), or
    conflict, which changes nothing. Ending a run takes back its counts."""
    allowed, to = ACTIONS[action]
    fits = F.col("status").isin(allowed)
    outcome = F.when(fits, "moved").when((F.col("status") == to) & F.lit(action != "resume"), "already").otherwise("conflict")
    out = runs.withColumn("outcome", outcome).withColumn("status", F.when(fits, to).otherwise(F.col("status")))
    moved = F.col("outcome") == "moved"
    out = out.withColumn("pause_requested", F.when(moved, F.lit(action == "pause")).otherwise(F.col("pause_requested")))
    if action == "terminate":
        for c in ("pass_count", "fail_count", "uncertain_count"):
            out = out.withColumn(c, F.when(moved, 0).otherwise(F.col(c)))
    return out


def run_or_new(wanted: DataFrame, runs: DataFrame, active: list[str], refuse: bool = False) -> DataFrame:
    """job_id, run_id, outcome for each job that wants a run (job_id, run_id): its active run is returned (or the wish refused), else
    the new one is created. One active run a job; the newest if there are more."""
    now = runs.filter(F.col("status").isin(active)).groupBy("job_id").agg(F.max_by("run_id", F.struct("updated_at", "run_id")).alias("__now"))
    busy = F.col("__now").isNotNull()
    return wanted.join(now, "job_id", "left").select("job_id", F.coalesce("__now", "run_id").alias("run_id"), F.when(busy, "conflict" if refuse else "existing").otherwise("created").alias("outcome"))


def retry_pages(runs: DataFrame, issues: DataFrame, jobs: DataFrame) -> DataFrame:
    """job_id, outcome, pages of jobs whose failed pages are to be tried again: pages whose run failed, or where none did, pages with
    an error noted. Jobs still running, or without such pages, are refused. ``runs``: job_id, page, status; ``issues``: job_id, page,
    severity."""
    pages = lambda rows: rows.filter("page > 0").groupBy("job_id").agg(F.array_sort(F.collect_set("page")).alias("p"))
    failed = pages(runs.filter("status = 'failed'")).withColumnRenamed("p", "__failed")
    noted = pages(issues.filter("severity = 'error'")).withColumnRenamed("p", "__noted")
    joined = jobs.select("job_id", "status").join(failed, "job_id", "left").join(noted, "job_id", "left")
    found = F.coalesce("__failed", "__noted")
    outcome = F.when(~F.col("status").isin(RETRIABLE_JOB), "running").when(found.isNull(), "nothing").otherwise("queued")
    return joined.select("job_id", outcome.alias("outcome"), F.when(outcome == "queued", found).alias("pages"))


def new_experiments(jobs: DataFrame, experiments: DataFrame, versions: DataFrame, runs: DataFrame, sessions: DataFrame) -> DataFrame:
    """job_id, outcome, sequence, archived of a new experiment for each job: refused while a run is active or the active experiment has
    no first version (and says whether its review is still open); else it is numbered after all others and the active one archived."""
    one = lambda rows, name: rows.select("job_id").distinct().withColumn(name, F.lit(True))
    busy = one(runs.filter(F.col("status").isin(ACTIVE_EVALUATION)), "__busy")
    active = experiments.filter("status = 'active'").select("job_id", F.col("experiment_id").alias("__active"))
    first = versions.filter("version = 1").select("job_id", F.col("experiment_id").alias("__active")).distinct().withColumn("__first", F.lit(True))
    open_ = sessions.filter(F.col("status").isin(ACTIVE_SESSION)).select("job_id", F.col("experiment_id").alias("__active")).distinct().withColumn("__open", F.lit(True))
    count = experiments.groupBy("job_id").agg(F.count("*").alias("__n"))
    joined = jobs.select("job_id").join(busy, "job_id", "left").join(active, "job_id", "left").join(first, ["job_id", "__active"], "left").join(open_, ["job_id", "__active"], "left").join(count, "job_id", "left")
    waits = F.col("__active").isNotNull() & F.col("__first").isNull()
    outcome = F.when(F.col("__busy"), "run_active").when(waits & F.coalesce("__open", F.lit(False)), "review_open").when(waits, "no_first_version").otherwise("created")
    return joined.select("job_id", outcome.alias("outcome"), F.when(outcome == "created", F.coalesce("__n", F.lit(0)) + 1).alias("sequence"), F.when(outcome == "created", F.col("__active")).alias("archived"))


def experiment_of(experiment_id: Column) -> Column:
    """Rows from before experiments belong to the one called legacy."""
    return F.coalesce(F.nullif(experiment_id, F.lit("")), F.lit("legacy"))


def artifact_counts(jobs: DataFrame, runs: DataFrame, crops: DataFrame) -> DataFrame:
    """job_id, artifact_count: the total of the newest run that had any, else the entities with a crop. ``crops``: job_id, count."""
    latest = runs.filter("total > 0").groupBy("job_id").agg(F.max_by("total", F.struct("updated_at", "run_id")).alias("__total"))
    return jobs.select("job_id").join(latest, "job_id", "left").join(crops.withColumnRenamed("count", "__crops"), "job_id", "left").select("job_id", F.coalesce("__total", "__crops", F.lit(0)).alias("artifact_count"))


def open_sessions(jobs: DataFrame, sessions: DataFrame, versions: DataFrame) -> DataFrame:
    """job_id, outcome, session_id, target_version of the session that each job's review goes on in: an open one (a review by the model
    goes back to the human), else a new one for the version after the last. Jobs that aren't done are refused."""
    now = sessions.filter(F.col("status").isin(ACTIVE_SESSION)).groupBy("job_id").agg(F.max_by(F.struct("session_id", "status", "target_version"), F.struct("updated_at", "session_id")).alias("s"))
    last = versions.groupBy("job_id").agg(F.max("version").alias("__last"))
    joined = jobs.select("job_id", "status").join(now, "job_id", "left").join(last, "job_id", "left")
    outcome = F.when(~F.col("status").isin(DONE_JOB), "job_running").when(F.col("s.status") == "ai_review", "reopened").when(F.col("s").isNotNull(), "existing").otherwise("created")
    target = F.coalesce("s.target_version", F.coalesce("__last", F.lit(0)) + 1)
    return joined.select("job_id", outcome.alias("outcome"), F.when(outcome != "job_running", F.col("s.session_id")).alias("session_id"), F.when(outcome != "job_running", target).alias("target_version"))


def session_items(cohort: DataFrame, records: DataFrame, previous: DataFrame) -> DataFrame:
    """Items of a session over its fixed cohort (job_id, record_id, pos): unreviewed, or stale where the record is gone; and whether its
    relations changed since the version before. ``records``: job_id, record_id, relation_ids; ``previous``: job_id, record_id,
    relation_signature."""
    own = records.select("job_id", "record_id", signature(F.col("relation_ids")).alias("relation_signature"), F.lit(True).alias("__known"))
    old = previous.select("job_id", "record_id", F.col("relation_signature").alias("__old"))
    joined = cohort.join(own, ["job_id", "record_id"], "left").join(old, ["job_id", "record_id"], "left")
    stale = F.col("__known").isNull()
    sign = F.coalesce("relation_signature", F.lit(""))
    changed = ~stale & (F.coalesce("__old", F.lit("")) != "") & (sign != F.col("__old"))
    return joined.select("job_id", "record_id", "pos", F.when(stale, "stale").otherwise("unreviewed").alias("verdict"), sign.alias("relation_signature"), changed.alias("relation_changed"), stale.alias("stale"))


def reviewed_items(items: DataFrame, reviews: DataFrame) -> DataFrame:
    """Session items after a human's verdicts (record_id, verdict, failure_code, failure_reason), with ``outcome``: a failure's code and
    reason stay with failures alone; items of the cohort that are stale are refused; a conflict that is being resolved is resolved."""
    new = reviews.select("record_id", F.struct("verdict", "failure_code", "failure_reason").alias("__new"))
    joined = items.join(new, "record_id", "left")
    met = F.col("__new").isNotNull() & ~F.col("stale")
    failed = F.col("__new.verdict") == "failed"
    solved = met & (F.col("session_status") == "conflict_review") & (F.col("consensus_status") == "conflict")
    changes = {
        "verdict": F.when(met, F.col("__new.verdict")).otherwise(F.col("verdict")),
        "failure_code": F.when(met, F.when(failed, F.col("__new.failure_code"))).otherwise(F.col("failure_code")),
        "failure_reason": F.when(met, F.when(failed, F.col("__new.failure_reason")).otherwise("")).otherwise(F.col("failure_reason")),
        "consensus_status": F.when(solved, "human_resolved").otherwise(F.col("consensus_status")),
    }
    outcome = F.when(F.col("__new").isNull(), "kept").when(F.col("stale"), "stale").otherwise("reviewed")
    return joined.select(*(changes.get(c, F.col(c)).alias(c) for c in items.columns), outcome.alias("outcome"))


def field_reviews(fields: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields (record_id, key, value, status) after decisions (record_id, key, decision, value), and a revision for each: a correction
    sets the value (none: missing), a rejection asks for review, an acceptance keeps both."""
    new = reviews.select("record_id", "key", "decision", F.col("value").alias("__given"))
    joined = fields.join(new, ["record_id", "key"], "left")
    corrected = F.coalesce(F.col("decision") == "corrected", F.lit(False))
    after = F.when(corrected, F.col("__given")).otherwise(F.col("value"))
    status = F.when(F.col("decision") == "rejected", "needs_review").when(corrected, F.when(after.isNull(), "missing").otherwise("valid")).otherwise(F.coalesce("status", F.lit("valid")))
    updated = joined.select("record_id", "key", after.alias("value"), F.when(F.col("decision").isNull(), F.col("status")).otherwise(status).alias("status"), "decision")
    revisions = joined.filter("decision IS NOT NULL").select("record_id", "key", "decision", F.col("value").alias("before"), after.alias("after"))
    return updated, revisions


def relation_reviews(relations: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Relations (id, review_status) after reviews (id, status, reviewer, reason) and a revision for each; taking a review back clears
    when it was made."""
    new = reviews.select("id", F.col("status").alias("__to"), "reviewer", "reason")
    joined = relations.join(new, "id", "left")
    to = F.coalesce("__to", "review_status")
    updated = joined.select(*(to.alias(c) if c == "review_status" else F.col(c) for c in relations.columns), (F.col("__to").isNotNull() & (F.col("__to") != "unreviewed")).alias("reviewed"))
    revisions = joined.filter("__to IS NOT NULL").select("id", F.coalesce("review_status", F.lit("unreviewed")).alias("before"), F.col("__to").alias("after"), "reviewer", "reason")
    return updated, revisions


def swept(runs: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs and sessions after a restart. Kinds are swept in one pass: extraction goes on from where it was, rematching, verification
    and evaluation that were active fail, and a review by the model goes back to the human. ``runs``: kind, run_id, status."""
    kind, status = F.col("kind"), F.col("status")
    interrupted = F.when(kind == "rematch", status.isin(ACTIVE_REMATCH)).when(kind == "evaluation", status.isin(ACTIVE_EVALUATION)).otherwise(status.isin(ACTIVE_RUN))
    after = F.when(interrupted, F.when(kind == "extraction", "queued").otherwise("failed")).otherwise(status)
    return runs.withColumn("interrupted", interrupted).withColumn("status", after), sessions.withColumn("status", F.when(status == "ai_review", "in_progress").otherwise(status))


def cancelled(runs: DataFrame, tasks: DataFrame) -> DataFrame:
    """Rematch runs after a wish to cancel: ended ones stay as they are, others wait for their task to stop, or end at once where no task
    runs (run_id of ``tasks``)."""
    alive = tasks.select("run_id").distinct().withColumn("__alive", F.lit(True))
    joined = runs.join(alive, "run_id", "left")
    ended = F.col("status").isin(ENDED_REMATCH)
    return joined.select(*(F.when(ended, F.col(c)).when(F.col("__alive"), "cancelling").otherwise("cancelled").alias(c) if c == "status" else F.col(c) for c in runs.columns))


def apply_gate(runs: DataFrame, jobs: DataFrame, sessions: DataFrame, evaluations: DataFrame) -> DataFrame:
    """run_id, gate: whether a rematch preview may become the matching in force: it must be complete, no review or evaluation open, and
    made from the matching that is in force now; one applied before is done."""
    one = lambda rows, name: rows.select("job_id").distinct().withColumn(name, F.lit(True))
    joined = runs.join(jobs.select("job_id", F.coalesce("matching_version", F.lit(FIRST_MATCHING)).alias("__now")), "job_id").join(one(sessions.filter(F.col("status").isin(ACTIVE_SESSION)), "__open"), "job_id", "left").join(one(evaluations.filter(F.col("status").isin(ACTIVE_EVALUATION)), "__evaluated"), "job_id", "left")
    base = F.coalesce("base_version", F.lit(FIRST_MATCHING))
    gate = F.when(F.col("status") == "applied", "done").when(F.col("status") != "completed", "not_completed").when(F.col("__open"), "review_open").when(F.col("__evaluated"), "evaluation_open").when(base != F.col("__now"), "version_moved").otherwise("apply")
    return joined.select("run_id", "job_id", gate.alias("gate"))


def applied(current: DataFrame, baseline: DataFrame, candidate: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Rows in force after snapshots were applied: of jobs whose application went well the candidate's, of those where it failed the
    baseline's, of all others what is in force. ``outcomes``: job_id, applied (boolean). Each job's rows are replaced as a whole."""
    done = lambda good: outcomes.filter(F.col("applied") if good else ~F.col("applied")).select("job_id")
    parts = [current.join(outcomes.select("job_id"), "job_id", "left_anti"), candidate.join(done(True), "job_id", "left_semi"), baseline.join(done(False), "job_id", "left_semi")]
    return reduce(DataFrame.unionByName, parts)


def still_valid(runs: DataFrame, jobs: DataFrame) -> DataFrame:
    """run_id, valid: whether the matching that a run began with is still in force."""
    now = jobs.select("job_id", F.coalesce("matching_version", F.lit(FIRST_MATCHING)).alias("__now"))
    return runs.join(now, "job_id").select("run_id", (F.coalesce("matching_version", F.lit(FIRST_MATCHING)) == F.col("__now")).alias("valid"))


def queue_of_pages(pages: DataFrame, wants: list[str], share: float = 0.45, least: int = 80) -> DataFrame:
    """document_id, page, priority, place of the pages to read by OCR, best first: points for the kinds of reference still looked for
    (figure, plate, artifact) by the page's type, and its visual score; as many as ``share`` of the document's pages, ``least`` where
    it has them. ``pages``: document_id, page, page_type, visual_score, attempted, requested."""
    kind = F.col("page_type")
    points = F.lit(0.0)
    if "plate" in wants:
        points = points + F.when(kind == "color_plate", 8.0).when(kind == "color_visual", 5.0).otherwise(0.0)
    if "figure" in wants:
        points = points + F.when(kind.isin("monochrome_visual", "mixed_visual"), 6.0).otherwise(0.0)
    if "artifact" in wants:
        points = points + F.when(kind.isin("color_plate", "monochrome_visual", "mixed_visual"), 3.0).otherwise(0.0)
    size = pages.groupBy("document_id").agg(F.count("*").alias("__n")).withColumn("__most", F.when(F.col("__n") <= least, least).otherwise(F.least("__n", F.greatest(F.lit(least), F.ceil(F.col("__n") * share)))))
    open_ = pages.withColumn("__p", points).filter((F.col("__p") > 0) & ~F.col("attempted") & ~F.col("requested"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("priority"), "page"))
    ranked = open_.withColumn("priority", F.col("__p") + F.coalesce("visual_score", F.lit(0.0))).withColumn("place", place)
    return ranked.join(size, "document_id").filter(F.col("place") <= F.col("__most")).select("document_id", "page", "priority", "place")


def after_ocr(pages: DataFrame, read: DataFrame) -> DataFrame:
    """Pages with the references that OCR found on them; a colour page that names a plate is one. ``pages``: document_id, page,
    page_type, references; ``read``: document_id, page, found."""
    joined = pages.join(read, ["document_id", "page"], "left")
    every = F.array_sort(F.array_distinct(F.concat("references", F.coalesce("found", F.array().cast("array<string>")))))
    plate = F.col("found").isNotNull() & (F.col("page_type") == "color_visual") & F.exists(every, lambda r: r.startswith("plate:"))
    return joined.select(*(F.when(plate, "color_plate").otherwise(F.col(c)).alias(c) if c == "page_type" else every.alias(c) if c == "references" else F.col(c) for c in pages.columns))


def items_page(items: DataFrame, status: str | None, offset: int, limit: int) -> DataFrame:
    """A page of evaluation items with a status, by identifier and age, and the total."""
    kept = items.filter(F.col("match_status") == status) if status else items
    return kept.orderBy("artifact_id", "created_at", "item_id").offset(offset).limit(limit).crossJoin(kept.agg(F.count("*").alias("total")))  # a single row


def import_counts(rows: DataFrame) -> DataFrame:
    """dataset_id, counts of an import (row_count, valid_count, unkeyed_count, duplicate_count) and its warnings. ``rows``: dataset_id,
    key (null where a row has none)."""
    per_key = rows.groupBy("dataset_id", "key").agg(F.count("*").alias("n"))
    keyed = F.col("key").isNotNull()
    out = per_key.groupBy("dataset_id").agg(F.sum("n").alias("row_count"), F.coalesce(F.sum(F.when(keyed, F.col("n"))), F.lit(0)).alias("valid_count"), F.coalesce(F.sum(F.when(~keyed, F.col("n"))), F.lit(0)).alias("unkeyed_count"), F.coalesce(F.sum(F.when(keyed & (F.col("n") > 1), F.col("n"))), F.lit(0)).alias("duplicate_count"))
    warn = lambda c, name: F.when(F.col(c) > 0, F.concat(F.lit(f"{name}:"), F.col(c).cast("string")))
    return out.withColumn("warnings", F.array_compact(F.array(warn("unkeyed_count", "unkeyed"), warn("duplicate_count", "duplicates"))))


def request_totals(requests: DataFrame) -> DataFrame:
    """Per page what its model requests cost. A request of a part or a second try (chunk:part:1, chunk:retry:2) counts for its chunk's
    page; where the answer did not say how many tokens the prompt had, the estimate stands."""
    root = F.regexp_replace("chunk_id", r":(?:part|retry):.*$", "")
    return requests.withColumn("chunk", root).groupBy("document_id", "page", "chunk").agg(F.count("*").alias("request_count"), F.count_if(F.col("attempt") > 0).alias("retry_count"), F.count_if("truncated").alias("truncation_count"), F.sum(F.coalesce("prompt_tokens", "prompt_estimate")).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"), F.sum("http_ms").alias("llm_http_ms"))


def export_bundle(versions: DataFrame, runs: DataFrame, items: DataFrame, records: DataFrame) -> DataFrame:
    """A row per machine item of each version's run, with its record's fields; a record that is gone leaves them null."""
    named = versions.select("version_id", "version", F.col("machine_run_id").alias("run_id")).join(runs.select("run_id", F.col("status").alias("run_status")), "run_id")
    return named.join(items, "run_id").join(records, "record_id", "left")


def history_page(rows: DataFrame, at: str, tie: str, limit: int) -> DataFrame:
    """The newest rows, at most ``limit``."""
    return rows.orderBy(F.desc(at), tie).limit(limit)


def reading_order(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with ``place``, their place on the page from top to bottom and left to right."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("bbox.t", "bbox.l", "id")))


def first_of(rows: DataFrame, by: str, order: list[str], most: int = 200) -> DataFrame:
    """The first ``most`` rows of each list (the report shows no more) and how many there are. The count is an aggregate of its own."""
    total = rows.groupBy(by).agg(F.count("*").alias("total"))
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= most)
    return ranked.join(total, by)


def semantic_scores(results: DataFrame, judgments: DataFrame, fields: list[str]) -> DataFrame:
    """Field results (item_id, key, verdict, score, exact, method) with a model's judgment in place of the letters' ratio for free text:
    only where both sides have a value. A field that was to be judged and was not is an error: letters never stand in for meaning."""
    due = F.col("key").isin(fields) & F.col("verdict").isin("matched", "mismatched")
    given = judgments.select("item_id", "key", F.col("score").alias("__score"), F.col("matched").alias("__matched"))
    joined = results.join(given, ["item_id", "key"], "left")
    met = F.col("__matched").isNotNull()
    bad = due & (~met | ~F.coalesce(F.col("__score").between(0, 1), F.lit(False)))
    verdict = F.when(bad, F.raise_error(F.concat_ws(" ", F.lit("no judgment for"), F.col("item_id").cast("string"), F.col("key")))).when(due, F.when(F.col("__matched"), "matched").otherwise("mismatched")).otherwise(F.col("verdict"))
    changes = {"verdict": verdict, "score": F.when(due, F.col("__score")).otherwise(F.col("score")), "method": F.when(due, "semantic_llm").otherwise(F.col("method"))}
    return joined.select(*(changes.get(c, F.col(c)).alias(c) for c in results.columns))
