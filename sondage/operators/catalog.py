"""Catalog views: representatives, insights, paging, search and histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Weights of fields that have a value, in a representative's score.
FIELD_WEIGHTS = {"artifact_id": 3, "category": 4, "material": 6, "surface_color": 6, "texture": 6, "surface_treatment": 6, "measurements": 10, "morphological_description": 12, "figure_caption": 1}
DEFAULT_WEIGHT, OWN_PAGE, LONG_TEXT, LONG_TEXT_FROM = 2, 1, 9, 12
# Fields of a card's body, and fields that a caption alone can fill.
BODY = ["morphological_description", "measurements", "texture", "surface_color", "completeness"]
CAPTION_ONLY = ["artifact_id", "figure_caption", "category"]
CAPTION_PREFIX = r"^[\x{4e00}-\x{9fff}]{1,2}(?=[A-Za-z])"


def field_weight(key: Column) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for name, weight in FIELD_WEIGHTS.items():
        out = F.when(key == name, weight).otherwise(out)
    return out


def has_value(c: Column) -> Column:
    text = F.trim(F.coalesce(c, F.lit("")))
    return (text != "") & ~F.lower(text).isin("none", "null")


def record_scores(fields: DataFrame, evidence: DataFrame | None = None) -> DataFrame:
    """record_id, score from a long table record_id, key, value, own_page (whether text evidence stands on a page of the record).
    The service flavour also counts a record whose summary is long: ``evidence`` is record_id, summary."""
    score = field_weight(F.col("key")) + F.coalesce(F.col("own_page").cast("int"), F.lit(0)) * OWN_PAGE
    own = fields.filter(has_value(F.col("value"))).groupBy("record_id").agg(F.sum(score).alias("score"))
    if evidence is None:
        return own
    long = evidence.groupBy("record_id").agg(F.max(F.when(F.length("summary") >= LONG_TEXT_FROM, LONG_TEXT).otherwise(0)).alias("__long"))
    return own.join(long, "record_id", "full_outer").select("record_id", (F.coalesce("score", F.lit(0)) + F.coalesce("__long", F.lit(0))).alias("score"))


def caption_only_sparse(fields: Column) -> Column:
    """Whether a card (map of field values) has nothing but what a caption gives, and a caption or an identifier behind a tomb's
    name."""
    value = lambda k: fields[k]
    filled = F.map_keys(F.map_filter(fields, lambda _, v: has_value(v)))
    named = has_value(value("figure_caption")) | F.coalesce(F.trim(value("artifact_id")).rlike(CAPTION_PREFIX), F.lit(False))
    return (F.size(F.array_except(filled, F.array(*map(F.lit, CAPTION_ONLY)))) == 0) & named


def preview_cards(records: DataFrame) -> DataFrame:
    """The cards of the preview, one per entity, with ``place``, their order.

    ``records``: record_id, ord, entity_id, fields (map), own_keys (keys with text evidence on a page of the record), summary,
    n_pages (source and associated pages), crop_bound. Cards that only a caption fills are out; so are cards without a crop and
    without a body whose summary is short and that lie on one page. The best score stands for an entity, the first on ties, in
    the place of the entity's first card; it is shown if it, or any record of its entity, has a crop. Aggregates and a join: an
    entity with very many records is never gathered.
    """
    body = F.exists(F.array(*(has_value(F.col("fields")[k]) for k in BODY)), lambda x: x)
    short = (F.length(F.coalesce("summary", F.lit(""))) < LONG_TEXT_FROM) & (F.col("n_pages") <= 1)
    seen = records.filter(~caption_only_sparse(F.col("fields"))).filter(F.col("crop_bound") | body | ~short)
    own = F.coalesce("own_keys", F.array().cast("array<string>"))
    points = F.aggregate(F.map_keys(F.map_filter("fields", lambda _, v: has_value(v))), F.lit(0), lambda n, k: n + field_weight(k) + F.array_contains(own, k).cast("int") * OWN_PAGE)
    score = points + F.when(F.length(F.coalesce("summary", F.lit(""))) >= LONG_TEXT_FROM, LONG_TEXT).otherwise(0)
    keyed = seen.withColumn("score", score).withColumn("card", F.coalesce(F.concat(F.lit("entity:"), F.nullif("entity_id", F.lit(""))), F.concat(F.lit("record:"), "record_id")))
    best = keyed.groupBy("card").agg(F.max_by(F.struct("record_id", "entity_id", "score", "crop_bound"), F.struct("score", (-F.col("ord")).alias("o"))).alias("b"), F.min("ord").alias("place")).select("b.*", "place")
    crops = records.filter("crop_bound AND entity_id IS NOT NULL AND entity_id <> ''").select("entity_id").distinct().withColumn("__crop", F.lit(True))
    return best.join(crops, "entity_id", "left").filter(F.col("crop_bound") | F.coalesce("__crop", F.lit(False))).select("record_id", "entity_id", "score", "place")


def crop_bound_entities(records: DataFrame) -> DataFrame:
    """One row: how many entities (or records without one) have a record with a crop."""
    return records.filter("crop_bound").agg(F.count_distinct(F.coalesce(F.concat(F.lit("entity:"), F.nullif("entity_id", F.lit(""))), F.concat(F.lit("record:"), "record_id"))).alias("count"))


def representatives(records: DataFrame, crop_first: bool) -> DataFrame:
    """The record that stands for each entity, with ``place``, its rank in the output.

    ``records``: entity_id, record_id, score, ord, has_crop. The best score wins, the first in order on ties. The service
    flavour ranks all records and orders groups by their first record; the verification flavour (``crop_first``) ranks only
    records with a crop and orders by the winner. One aggregate with ``max_by``: no window, no gathering of an entity.
    """
    rows = records.filter("has_crop") if crop_first else records
    best = rows.groupBy("entity_id").agg(F.max_by(F.struct("record_id", "score", "ord"), F.struct("score", (-F.col("ord")).alias("o"))).alias("best"), F.min("ord").alias("first_ord"))
    return best.select("entity_id", F.col("best.record_id").alias("record_id"), F.col("best.score").alias("score"), (F.col("best.ord") if crop_first else F.col("first_ord")).alias("place"))


def newest_per_hash(rows: DataFrame, digest: str, order: str) -> DataFrame:
    """The newest row of each digest; rows without one all stay."""
    w = Window.partitionBy(digest).orderBy(F.desc(order))
    known = rows.filter(F.col(digest).isNotNull()).withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")
    return known.unionByName(rows.filter(F.col(digest).isNull()))


def page(rows: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """One page and the total, which a scalar subquery counts."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).offset(offset).limit(limit).crossJoin(total)  # the total is one row


def top_and_rest(rows: DataFrame, key: str, k: int, rest: str) -> DataFrame:
    """The k most frequent values with their place, and the sum of the others (where there are any) behind them. The top is a
    bounded sort and the rest a difference of sums, so the values are never ranked in one task."""
    counts = rows.groupBy(key).agg(F.count("*").alias("count"))
    top = counts.orderBy(F.desc("count"), key).limit(k).withColumn("place", F.row_number().over(Window.orderBy(F.desc("count"), key)))  # k rows at most
    total = rows.agg(F.count("*").alias("all"))
    left = total.crossJoin(top.agg(F.sum("count").alias("__top"))).select(F.lit(rest).alias(key), F.lit(k + 1).alias("place"), (F.col("all") - F.coalesce("__top", F.lit(0))).alias("count")).filter("count > 0")  # two single rows
    return top.select(key, "place", "count").unionByName(left)


def bucket_counts(rows: DataFrame, bucket: Column, last: str | None = None) -> DataFrame:
    """Bucket counts, the largest first, ``last`` after all others; code points order ties."""
    counts = rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("count"))
    end = F.col("bucket") == last if last else F.lit(False)
    return counts.orderBy(end, F.desc("count"), "bucket")


def zero_filled(counts: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Every requested or observed key, 0 where nothing was counted."""
    every = keys.select(key).unionByName(counts.select(key)).filter(F.col(key) > 0).distinct()
    return every.join(counts, key, "left").na.fill(0)


def completeness(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Per field how many rows have a value: one scan, one aggregate."""
    some = lambda c: F.count_if(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) != "")
    one = rows.agg(F.count("*").alias("total"), *(some(c).alias(c) for c in fields))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("count"), F.col("total").alias("total")) for c in fields))))


def search(rows: DataFrame, keyword: str, columns: list[str]) -> DataFrame:
    """Rows that hold the keyword, in any case, in one of the columns."""
    text = F.lower(F.concat_ws(" ", *(F.col(c).cast("string") for c in columns)))
    return rows.filter(F.contains(text, F.lit(keyword.strip().lower())))


def search_ids(rows: DataFrame, keyword: str, column: str) -> DataFrame:
    """As ``search``, but separators do not count."""
    tight = lambda c: F.regexp_replace(F.lower(c), r"[\s,.:;_\-/]+", "")
    return rows.filter(F.contains(tight(F.col(column)), tight(F.lit(keyword))))


def last_ascending(rows: DataFrame, order: str, n: int) -> DataFrame:
    return rows.orderBy(F.desc(order)).limit(n).orderBy(order)


def in_order_of(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows in the order of an id list (key, pos); ids without a row are dropped."""
    return rows.join(ids, key).orderBy("pos")


def weakest(metrics: DataFrame) -> DataFrame:
    return metrics.orderBy(F.coalesce("mean_score", F.lit(1.0)), "key")


def history(versions: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Versions with the previous value, the change, whether it is the latest, and the next number."""
    w = Window.partitionBy(key).orderBy(order)
    every = Window.partitionBy(key)
    return versions.withColumn("previous", F.lag(value).over(w)).withColumn("change", F.col(value) - F.col("previous")).withColumn("is_latest", F.col(order) == F.max(order).over(every)).withColumn("next_version", F.max(order).over(every) + 1)


def display_value(value: Column, raw: Column, derived: Column) -> Column:
    """Explicit value, else the raw one, else what is derived."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(some(value), some(raw), derived)


def crop_bound(primary: Column, thumb: Column) -> Column:
    """Whether a record has a crop; an empty id is none."""
    some = lambda c: F.coalesce(c, F.lit("")) != ""
    return some(primary) | some(thumb)


def drilled(rows: DataFrame, category: Column, material: Column, wanted_category: str | None, wanted_material: str | None, page: int | None) -> DataFrame:
    """Records of a category, of a material and on a page; what is not asked for does not narrow."""
    keep = F.lit(True)
    if wanted_category:
        keep = keep & (category == wanted_category)
    if wanted_material:
        keep = keep & (material == wanted_material)
    if page is not None:
        keep = keep & F.array_contains("source_pages", page)
    return rows.filter(keep)


def history_filter(jobs: DataFrame, report: str, all_reports: bool, query: str, status: str, text: Column) -> DataFrame:
    """Jobs of a report (by its compared name), or of all, with a status, whose text holds the query in any case."""
    from sondage.functions.text import report_name

    keep = (F.lit(all_reports) | (report_name(F.col("filename"), True) == report)) & (F.lit(status == "all") | (F.col("status") == status))
    wanted = query.strip().lower()
    return jobs.filter(keep & F.contains(F.lower(text), F.lit(wanted))) if wanted else jobs.filter(keep)


def report_view(report: DataFrame) -> DataFrame:
    """Percentages of a version's report: where a rate was not computed its fallback is the pass rate (for errors what is left of
    it); counts of the full run stand before those of the sample."""
    percent = lambda c: F.floor(c * 100 + 0.5).cast("long")
    rate = F.col("pass_rate")
    return report.select(
        "version", "sample_count", percent(F.coalesce("coverage", 1 - rate)).alias("error_coverage"), percent(F.coalesce("precision", rate)).alias("precision"), percent(F.coalesce("alignment", rate)).alias("alignment"),
        percent(F.col("review_load")).alias("review_load"), F.coalesce("full_pass_count", "pass_count").alias("passed"), F.coalesce("full_fail_count", "fail_count").alias("errors"), F.coalesce("full_uncertain_count", F.lit(0)).alias("uncertain"),
    )


def preview_page(primary: Column, color_pages: Column, text_pages: Column, record_pages: Column, other_pages: Column) -> Column:
    """The page to show: the primary one unless it is a colour plate; else the first that is none, of the text record's pages,
    the record's, then the others."""
    none = F.array().cast("array<int>")
    fine = F.filter(F.concat(*(F.coalesce(c, none) for c in (text_pages, record_pages, other_pages))), lambda p: (p > 0) & ~F.array_contains(color_pages, p))
    return F.when(~F.array_contains(color_pages, primary), primary).otherwise(F.coalesce(F.get(fine, F.lit(0)), primary))


def field_key(label: Column) -> Column:
    """A key for a field's label, null where its letters and digits do not begin with a letter (it then gets an invented one)."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(F.trim(label)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(plain.rlike("^[a-z]"), plain)


def numbered_keys(labels: DataFrame, by: str) -> DataFrame:
    """The labels' keys, made distinct: the second of one key ends in _2, the third in _3. ``labels``: by, ord, label."""
    keyed = labels.withColumn("base", field_key(F.col("label")))
    n = F.row_number().over(Window.partitionBy(by, "base").orderBy("ord"))
    return keyed.withColumn("key", F.when(n == 1, F.col("base")).otherwise(F.concat_ws("_", "base", n.cast("string")))).drop("base")


def item_search(items: DataFrame, results: DataFrame, query: str, key: str) -> DataFrame:
    """Evaluation items that hold a query: in their identifier (separators do not count), their pages, or the actual and expected
    values of one field or of all. ``results``: item_id, key, actual, expected."""
    wanted = query.strip().lower()
    if not wanted:
        return items
    holds = lambda c: F.contains(F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))), F.lit(wanted))
    tight = F.translate(F.regexp_replace(F.lower(F.trim(F.col("artifact_id"))), r"\s", ""), ":：,，", "")
    by_id = holds(F.col("artifact_id")) | F.contains(tight, F.translate(F.regexp_replace(F.lit(wanted), r"\s", ""), ":：,，", ""))
    by_page = F.exists("source_pages", holds)
    if key == "source_pages":
        return items.filter(by_page)
    if key == "artifact_id":
        return items.filter(by_id)
    hit = results.filter(holds(F.col("actual")) | holds(F.col("expected")))
    hit = hit if key == "all" else hit.filter(F.col("key") == key)
    marked = items.join(hit.select("item_id").distinct().withColumn("__hit", F.lit(True)), "item_id", "left")
    met = F.coalesce("__hit", F.lit(False))
    return marked.filter(met | by_id | by_page if key == "all" else met).drop("__hit")
