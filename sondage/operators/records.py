"""Records and their helpers: predicates, identifier repair, lookups, views and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sondage.functions.text import STRICT_ID, compact, guarded

# Fields that a caption alone can fill, and fields that do not make a record worth keeping.
CAPTION_FIELDS = ["artifact_id", "figure_caption", "figure_no", "figure_item_no", "plate_no", "plate_item_no", "context_id", "sequence_no"]
IDENTITY_FIELDS = ["artifact_id", "context_id", "sequence_no", "site_id"]
CAPTION_CUE = r"(?i)图|彩版|图版|彩图|fig|plate"
# Look-alikes of digits in OCR.
CONFUSED = ("IL|OQ", "11100")


def some(c: Column) -> Column:
    return F.coalesce(F.trim(c.cast("string")), F.lit("")) != ""


def caption_only(fields: DataFrame, with_cue: bool = False) -> DataFrame:
    """record_id, sparse: every filled field is one that a caption gives; the fusion flavour also wants a caption cue.
    ``fields``: record_id, key, value, quote."""
    known = fields.filter(some(F.col("value")))
    sparse = F.bool_and(F.col("key").isin(CAPTION_FIELDS))
    if with_cue:
        sparse = sparse & F.bool_or(F.coalesce(F.col("quote"), F.lit("")).rlike(CAPTION_CUE))
    return known.groupBy("record_id").agg(sparse.alias("sparse"))


def incomplete_context(artifact_id: Column, sequence: Column) -> Column:
    """A bare context such as M14 without a sequence."""
    return F.coalesce(F.upper(F.trim(artifact_id)).rlike(r"^[A-Z]{1,6}\d+[A-Z]?$"), F.lit(False)) & ~some(sequence)


def meaningful(fields: DataFrame, site_counts: bool) -> DataFrame:
    """record_id of records with a value beyond the ignored keys; extraction accepts a site alone, fusion does not."""
    ignored = [] if site_counts else ["site_id"]
    return fields.filter(some(F.col("value")) & ~F.col("key").isin(ignored)).select("record_id").distinct()


def changed_fields(old: DataFrame, new: DataFrame, keys: list[str], compared: list[str]) -> DataFrame:
    """Rows of ``new`` that differ from ``old`` in a compared column, for writing only those."""
    b = old.select(*keys, F.struct(*compared).alias("__old"))
    return new.join(b, keys, "left").filter(~F.struct(*compared).eqNullSafe(F.col("__old"))).drop("__old")


def displayed(category: Column, texture: Column, morphology: Column, evidence: Column, words: list[str]) -> Column:
    """struct<category, texture, morphology>: given values, else what the evidence says: the category is its first listed
    word, the texture what stands before 质/陶/石 with that word, the morphology the rest."""
    text = F.coalesce(evidence, F.lit(""))
    word = F.nullif(F.regexp_extract(text, f"({'|'.join(words)})", 1), F.lit(""))
    material = F.nullif(F.regexp_extract(text, r"([一-鿿]{0,4}(?:质|陶|石|铜|铁|玉|骨))", 1), F.lit(""))
    pick = lambda given, derived: F.when(some(given), given).otherwise(derived)
    return F.struct(pick(category, word).alias("category"), pick(texture, material).alias("texture"), pick(morphology, F.nullif(F.trim(text), F.lit(""))).alias("morphology"))


def repaired_ids(rows: DataFrame, text: str, least: int = 3) -> DataFrame:
    """The rows with ``repaired``: identifiers whose look-alikes of digits were read as digits.

    A variant is taken if it was seen as a strict identifier, or if its part before the colon was seen ``least`` times. Seen
    parts are an aggregate that variants are joined to. ``rows`` needs row_id.
    """
    raw = F.upper(F.regexp_replace(F.col(text), r"\s+", ""))
    fixed = F.concat(F.regexp_extract(raw, r"^([A-Z]{1,2}?)", 1), F.translate(F.regexp_replace(raw, r"^[A-Z]{1,2}?", ""), *CONFUSED))
    own = rows.withColumn("__raw", raw).withColumn("__fixed", fixed)
    strict = own.filter(F.col("__raw").rlike(f"^{STRICT_ID}$"))
    seen = strict.select(F.col("__raw").alias("__fixed")).distinct().withColumn("__seen", F.lit(True))
    parts = strict.groupBy(F.split("__raw", ":")[0].alias("__left")).agg(F.count("*").alias("__n"))
    joined = own.join(seen, "__fixed", "left").withColumn("__left", F.split("__fixed", ":")[0]).join(parts, "__left", "left")
    good = F.coalesce(F.col("__seen"), F.lit(False)) | (F.coalesce("__n", F.lit(0)) >= least) & F.col("__fixed").rlike(f"^{STRICT_ID}$")
    known = (F.col("__raw") != F.col("__fixed")) & F.coalesce(F.col("__seen"), F.lit(False))
    return joined.withColumn("repaired", F.when(known, F.col("__fixed")).when(F.col("__raw").rlike(f"^{STRICT_ID}$"), F.col("__raw")).when(good, F.col("__fixed"))).select(*rows.columns, "repaired")


def ids_compatible(a: Column, b: Column, units: int = 20) -> Column:
    """Equal strict identifiers, or a circled unit number that OCR ran into the stem: T0302 with unit 1 read as T03021."""
    left, right = F.split(F.upper(a), ":"), F.split(F.upper(b), ":")
    tail = F.coalesce(F.array_join(F.slice(left, 2, 9), ":"), F.lit("")) == F.coalesce(F.array_join(F.slice(right, 2, 9), ":"), F.lit(""))
    la, lb = left[0], right[0]
    longer, shorter = F.when(F.length(la) >= F.length(lb), la).otherwise(lb), F.when(F.length(la) >= F.length(lb), lb).otherwise(la)
    extra = F.substr(longer, F.length(shorter) + 1, F.lit(9)).try_cast("int")
    unit = longer.startswith(shorter) & (F.length(F.regexp_replace(shorter, r"\D", "")) >= 3) & extra.between(1, units)
    return tail & ((la == lb) | F.coalesce(unit, F.lit(False)))


def missing_colon(strict: Column, loose: Column) -> Column:
    """Whether a text without its colon is the identifier, for zero-padded left parts only: M022 for M02:2."""
    return F.split(strict, ":")[0].rlike(r"^[A-Za-z]+0\d") & (F.upper(F.replace(strict, F.lit(":"), F.lit(""))) == F.upper(loose))


def balanced_parentheses(c: Column) -> Column:
    n = lambda chars: F.length(c) - F.length(F.translate(c, chars, ""))
    return n("(（") == n(")）")


def last_visual_parenthesis(c: Column) -> Column:
    """The last closed parenthesis that names a figure or plate."""
    found = F.filter(F.regexp_extract_all(c, F.lit(r"[(（]([^()（）]*)[)）]"), F.lit(1)), lambda x: x.rlike(CAPTION_CUE))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def prose_measurements(c: Column) -> Column:
    """array<struct<name, amounts, unit>> of measurements in prose; several amounts may share the unit behind the last."""
    shape = r"((?:通高|残高|高|口径|底径|腹径|长|宽|厚|直径))\s*((?:\d+(?:\.\d+)?\s*[、~～—-]?\s*)+)\s*(厘米|毫米|米|cm|mm|m)"
    part = lambda k: F.regexp_extract_all(c, F.lit(shape), F.lit(k))
    return F.transform(F.arrays_zip(part(1).alias("n"), part(2).alias("a"), part(3).alias("u")), lambda x: F.struct(x["n"].alias("name"), F.regexp_extract_all(x["a"], F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)).alias("amounts"), x["u"].alias("unit")))


def scoped_paragraph(text: Column, own: Column) -> Column:
    """From a record's identifier to the next foreign one; null if the text does not name it."""
    at = F.position(own, text)
    tail = F.substr(text, at + F.length(own), F.lit(1_000_000_000))
    end = F.regexp_instr(tail, F.lit(r"[A-Z]{1,6}\d+[A-Z]?[:：]\d+"))
    return F.when(at > 0, F.concat(own, F.when(end > 0, F.substr(tail, F.lit(1), end - 1)).otherwise(tail)))


def display_id(c: Column) -> Column:
    return F.regexp_replace(c, r"\s*[,，:：]\s*", ":")


def byte_size(c: Column) -> Column:
    """1536 -> 1.5 KB."""
    unit = F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B")))
    for power, name in ((1, "KB"), (2, "MB"), (3, "GB")):
        text = F.concat(F.format_number(c / 1024**power, 1), F.lit(f" {name}"))
        unit = unit.when(c < 1024 ** (power + 1), text) if power < 3 else unit.otherwise(text)
    return unit


def remaining_seconds(share: Column, elapsed: Column) -> Column:
    """Time left, once 8 % and three seconds have passed."""
    return F.when((share >= 0.08) & (elapsed >= 3), F.ceil(elapsed / share - elapsed))


def latest_run(runs: DataFrame, filename_part: str) -> DataFrame:
    """The run to show for a file: active first, then verified, then the newest."""
    hit = runs.filter(F.contains(F.lower("filename"), F.lit(filename_part.lower())))
    rank = F.when(F.col("status").isin("queued", "running", "paused"), 0).when(F.col("verified"), 1).otherwise(2)
    return hit.orderBy(rank, F.desc("updated_at"), F.desc("created_at")).limit(1)


def identified(ids: DataFrame, catalog: DataFrame) -> DataFrame:
    """The first card of each identifier read from a picture, in the order they were read. ``ids``: pos, artifact_id."""
    first = catalog.groupBy("artifact_id").agg(F.min_by("record_id", "ord").alias("record_id"))
    order = ids.groupBy("artifact_id").agg(F.min("pos").alias("pos"))
    return order.join(first, "artifact_id").orderBy("pos")


def upload_ids(text: Column, most: int = 100) -> Column:
    """Identifiers of graves, pits and houses in an uploaded picture's text."""
    return F.slice(F.array_distinct(F.regexp_extract_all(F.upper(text), F.lit(r"((?:M|H|T)\d+[A-Z]?(?:[:：]\d+)+)"), F.lit(1))), 1, most)


def page_roles(pages: DataFrame, discovery: DataFrame) -> DataFrame:
    """Prepared pages with the discovered type; a blank page that turned out to have text is a document."""
    found = discovery.select("document_id", "page", F.col("page_type").alias("__type"))
    kind = F.coalesce("__type", F.lit("document"))
    return pages.join(found, ["document_id", "page"], "left").withColumn("page_type", F.when((kind == "blank") & some(F.col("text")), "document").otherwise(kind)).drop("__type")


def rebound(cached: DataFrame, blocks: DataFrame) -> DataFrame:
    """Cached evidence bound to the current blocks of its page: the first block that holds the quote, white space aside.
    ``cached``: evidence_id, document_id, page, quote; ``blocks``: document_id, page, region_id, ord, text."""
    tight = lambda c: F.regexp_replace(F.col(c), r"\s+", "")
    hits = cached.join(blocks, ["document_id", "page"]).filter(F.contains(tight("text"), tight("quote")))
    first = hits.groupBy("evidence_id").agg(F.min_by("region_id", "ord").alias("region_id"))
    return cached.join(first, "evidence_id", "left")


def hydrated(records: DataFrame, columns: list[str]) -> DataFrame:
    """Records with crop columns borrowed from the first sibling of their entity that has a crop; ids stay."""
    lender = records.filter(some(F.col(columns[0]))).groupBy(F.col("entity_id").alias("__e")).agg(F.min_by(F.struct(*columns), "ord").alias("__s"))
    joined = records.join(lender, F.col("entity_id") == F.col("__e"), "left")
    own = some(F.col(columns[0]))
    return joined.select(*[c for c in records.columns if c not in columns], *(F.when(own, F.col(c)).otherwise(F.col(f"__s.{c}")).alias(c) for c in columns))


def jobs_with_names(jobs: DataFrame, documents: DataFrame, limit: int) -> DataFrame:
    named = jobs.join(documents.select("document_id", "filename"), "document_id", "left").withColumn("filename", F.coalesce("filename", F.lit("")))
    return named.orderBy(F.desc("created_at")).limit(limit)


def color_pages(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """Pages that are colour plates by their type or by a region."""
    by_type = pages.filter("page_type = 'color_plate'").select("document_id", "page")
    return by_type.unionByName(regions.filter("kind = 'color_plate'").select("document_id", "page")).distinct()


def deletable(datasets: DataFrame, *users: DataFrame) -> DataFrame:
    """Datasets that nothing refers to."""
    for rows in users:
        datasets = datasets.join(rows.select("dataset_id").distinct(), "dataset_id", "left_anti")
    return datasets


def crop_repair(old: DataFrame, new: DataFrame) -> DataFrame:
    """new_id, crop: crops of an old run for regions of a new one at the same place (to 7 places); places that are not unique
    on either side are left alone."""
    place = [F.round(f"bbox.{c}", 7).alias(c) for c in "ltrb"]
    keys = ["page", "kind", *"ltrb"]

    def unique(rows: DataFrame, *columns: Column) -> DataFrame:
        return rows.select("page", "kind", *place, *columns).withColumn("__n", F.count("*").over(Window.partitionBy(*keys))).filter("__n = 1").drop("__n")

    return unique(new, F.col("id").alias("new_id")).join(unique(old, F.col("crop")), keys).select("new_id", "crop")


def text_regions(pages: DataFrame) -> DataFrame:
    """Text blocks as regions with ids by place; the place counts blocks whose box is not valid, which are left out."""
    from sondage.functions.geometry import valid

    rows = pages.select("job_id", "page", F.posexplode("blocks").alias("i", "block"))
    return rows.filter(valid(F.col("block.bbox"))).select("job_id", "page", F.concat_ws("_", F.lit("reg"), "job_id", F.col("page").cast("string"), F.col("i").cast("string")).alias("id"), F.lit("text").alias("kind"), "block.text", "block.bbox")


def normalised_outputs(regions: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Regions with valid boxes, and relations with both ends among them and defaults filled."""
    from sondage.functions.geometry import valid

    fine = regions.filter(valid(F.col("bbox")))
    ids = fine.select(F.col("id").alias("__id"))
    for end in ("source_region_id", "target_region_id"):
        relations = relations.join(ids, F.col(end) == F.col("__id"), "left_semi")
    return fine, relations.withColumn("relation_type", F.coalesce("relation_type", F.lit("related_to"))).withColumn("review_status", F.coalesce("review_status", F.lit("unreviewed")))


def page_text(pages: DataFrame, policy: str) -> DataFrame:
    """The text to use under an OCR policy (all, fallback, disabled) with what OCR and the file gave."""
    ocr, own = F.nullif(F.trim("ocr_text"), F.lit("")), F.nullif(F.trim("pdf_text"), F.lit(""))
    text = {"all": F.coalesce(ocr, own), "fallback": F.coalesce(own, ocr), "disabled": own}[policy]
    return pages.withColumn("text", F.coalesce(text, F.lit(""))).withColumn("needs_ocr", text.isNull() & F.lit(policy != "disabled"))


def replaced_fields(saved: DataFrame, built_in: DataFrame) -> DataFrame:
    """Template fields: built-in ones refreshed, saved instructions kept, the user's own fields behind them, in saved order."""
    a = saved.select("key", F.col("ord").alias("s_ord"), F.col("instruction").alias("s_instruction"), F.col("label").alias("s_label"))
    b = built_in.select("key", F.col("ord").alias("b_ord"), "instruction", "label")
    joined = b.join(a, "key", "full_outer")
    return joined.select("key", F.coalesce("label", "s_label").alias("label"), F.coalesce(F.nullif("s_instruction", F.lit("")), "instruction", "s_instruction").alias("instruction"), F.coalesce("s_ord", F.col("b_ord") + 10_000).alias("ord")).orderBy("ord", "key")


def workbook(items: DataFrame) -> dict[str, DataFrame]:
    """Summary, detail and one row per field result of a machine run, with the spreadsheet guard on texts."""
    failed = F.filter("field_results", lambda r: r["verdict"] == "failed")
    detail = items.select("record_id", "verdict", guarded(F.coalesce("reason", F.lit(""))).alias("reason"), F.array_join(F.transform(failed, lambda r: F.concat_ws(": ", r["field"], r["reason"])), "; ").alias("failures"))
    return {"summary": items.groupBy("verdict").agg(F.count("*").alias("count")), "detail": detail, "fields": items.select("record_id", F.inline("field_results"))}


def safe_path(key: Column) -> Column:
    """A relative object key, or an error if it leaves its folder."""
    bad = key.startswith("/") | key.rlike(r"(^|/)\.\.(/|$)") | F.contains(key, F.lit("\\"))
    return F.when(bad, F.raise_error(F.concat(F.lit("bad key: "), key))).otherwise(key)


def caption_signature(c: Column) -> Column:
    """What captions are compared by: their references, or all of their text."""
    from sondage.functions.text import figure_tokens

    own = F.array_sort(figure_tokens(c))
    return F.when(F.size(own) > 0, F.array_join(own, "|")).otherwise(compact(c))


def captions_compatible(a: Column, b: Column) -> Column:
    x, y = caption_signature(a), caption_signature(b)
    return (x == y) | (F.length(x) > 0) & (F.length(y) > 0) & (F.contains(x, y) | F.contains(y, x))


def upgrade(current: Column, new: Column) -> Column:
    """Whether a new value is better: there was none, or it holds the old one and says more."""
    return some(new) & (~some(current) | (F.contains(new, current) & (F.length(new) > F.length(current))))


def label_numbers(labels: DataFrame, numbers: DataFrame) -> DataFrame:
    """A text label's number: the label overlaps the number's column by 0.45 and ends from 0.04 inside to 0.14 above it."""
    from sondage.functions.geometry import axis_overlap

    pairs = labels.select("job_id", "page", F.col("id").alias("label_id"), F.col("bbox").alias("a")).join(numbers.select("job_id", "page", F.col("id").alias("number_id"), F.col("bbox").alias("b")), ["job_id", "page"])
    overlap, gap = axis_overlap(F.col("a.l"), F.col("a.r"), F.col("b.l"), F.col("b.r")), F.col("b.t") - F.col("a.b")
    fine = pairs.filter((overlap >= 0.45) & gap.between(-0.04, 0.14))
    return fine.groupBy("job_id", "page", "label_id").agg(F.max_by("number_id", F.struct(overlap.alias("o"), (-F.abs(gap)).alias("g"), "number_id")).alias("number_id"))


def plate_anchors(records: DataFrame, captions: DataFrame) -> DataFrame:
    """Pages with a colour plate to infer: named by a record's plate reference or by a caption, each (page, plate, item) once."""
    rows = records.select("job_id", "page", "plate_no", "item_no", F.lit(0).alias("rank")).unionByName(captions.select("job_id", "page", "plate_no", "item_no", F.lit(1).alias("rank")))
    return rows.filter("plate_no IS NOT NULL").groupBy("job_id", "page", "plate_no", "item_no").agg(F.min("rank").alias("rank"))
