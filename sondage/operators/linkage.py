"""Identifiers as OCR reads them, how well a hint fits a text, and what a record's links are merged from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.text import SPACE, discovery_id, fuzzy_score, nfkc, stable_hash
from sondage.operators.match import label_items
from sondage.operators.records import ids_compatible

# Shapes of identifiers, alone, inside a text, and as OCR spoils them at the start of a line.
IDENTIFIER = r"[A-Z]{1,6}\d+[A-Z]?:[A-Z]?\d+[A-Z]?"
EMBEDDED = r"(?iU)(?<![A-Z0-9])(?:[\x{4e00}-\x{9fff}]{1,2})?([A-Z]{1,6}\s*\d+[A-Z]?\s*[:：]\s*[A-Z]?\d+[A-Z]?)(?![A-Z0-9])"
SPOILT_LINE = r"(?i)^\s*([A-Z]{1,6}?)([0-9ILOQ|]+)([A-HJ-KM-NPR-Z]?)\s*[:：]\s*([A-Z]?)(\d+)([A-Z]?)\b"
LOST_T_LINE = r"(?i)^\s*1(\d{2,})([A-Z]?)\s*[:：]\s*([A-Z]?)(\d+)([A-Z]?)\b"
TOMB = r"^[\x{4e00}-\x{9fff}]{1,2}(?=[A-Z])"
LOOK_ALIKES = ("IL|OQ", "11100")
REFERENCE_HINT = r"(?i)^(?:图|彩图|彩版|图版|fig(?:ure)?\.?)\s*\d+(?:\s*[-–—:：]\s*\d+)*$"
ITEM_HINT = r"[:：\-–—\s][A-Za-z0-9]+\s*$"
# The order in which hints are tried, and the fields that evidence is shown from.
HINT_ORDER = ["figure_refs", "figure_item_nos", "caption_texts", "artifact_ids", "plate_refs", "aliases"]
DISPLAY_FIELDS = ["figure_caption", "artifact_id", "category"]
# The least score of a reference that stands in a text, and words that lead a description.
REFERENCE_FLOOR = 0.96
CATEGORY_LEAD = r"^[，,、:：\s]*([\x{4e00}-\x{9fff}A-Za-z0-9ⅣⅢⅡⅠ]{1,12})(?=[。．.；;，,、]|$)"
TEXTURE = r"((?:泥质|夹砂|夹炭|细泥|粗泥|硬陶)[\x{4e00}-\x{9fff}]{0,6}陶|[\x{4e00}-\x{9fff}]{0,4}(?:闪玉|玉|石|青铜|铜|铁))"


def repaired(c: Column, normal: bool = False) -> Column:
    """Normal text without the half parentheses that OCR sets around a circled unit: T0302(2:34, T03022):34."""
    text = F.coalesce(c if normal else nfkc(c), F.lit(""))
    return F.regexp_replace(F.regexp_replace(text, r"(?<=[A-Za-z0-9])\((?=\d{1,2}[:：])", ""), r"(?<=\d)\)(?=[:：])", "")


def _tight(c: Column) -> Column:
    return F.regexp_replace(F.translate(F.upper(F.regexp_replace(c, SPACE, "")), "：", ":"), TOMB, "")


def _embedded(text: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(EMBEDDED), F.lit(1)), _tight)
    return F.array_distinct(F.filter(found, lambda x: x.rlike(f"^{IDENTIFIER}$")))


def fusion_id(c: Column, normal: bool = False) -> Column:
    """Fusion flavour: upper case without spaces and tomb's name; of a longer label the one identifier it holds, else the label."""
    text = _tight(repaired(c, normal))
    inside = _embedded(text)
    return F.when(text.rlike(f"^{IDENTIFIER}$") | (F.size(inside) != 1), text).otherwise(F.get(inside, F.lit(0)))


def line_id(c: Column, normal: bool = False) -> Column:
    """The identifier that a text begins with, though digits be read as letters (MI:6) or a leading T as 1; '' for none."""
    text = repaired(c, normal)
    own = fusion_id(text, True)
    part = lambda shape, k: F.upper(F.regexp_extract(text, shape, k))
    strict = _tight(F.regexp_extract(text, rf"(?i)^\s*(?:[\x{{4e00}}-\x{{9fff}}]{{1,2}})?[A-Z]{{1,6}}\s*\d+[A-Z]?\s*[:：]\s*[A-Z]?\d+[A-Z]?\b", 0))
    spoilt = F.concat(part(SPOILT_LINE, 1), F.translate(part(SPOILT_LINE, 2), *LOOK_ALIKES), part(SPOILT_LINE, 3), F.lit(":"), *(part(SPOILT_LINE, k) for k in (4, 5, 6)))
    lost = F.concat(F.lit("T"), part(LOST_T_LINE, 1), part(LOST_T_LINE, 2), F.lit(":"), *(part(LOST_T_LINE, k) for k in (3, 4, 5)))
    whole = F.when(strict != "", strict).otherwise(own)
    found = F.when(whole.rlike(f"^{IDENTIFIER}$"), whole).when(text.rlike(SPOILT_LINE), spoilt).when(text.rlike(LOST_T_LINE), lost)
    return F.when(found.rlike(f"^{IDENTIFIER}$"), found).otherwise(F.lit(""))


def ids_in(c: Column, normal: bool = False) -> Column:
    """array<string>: all identifiers that a text holds, its line's spoilt one included."""
    text = repaired(c, normal)
    return F.filter(F.array_distinct(F.concat(_embedded(text), F.array(line_id(text, True)))), lambda x: x != "")


def id_score(expected: Column, observed: Column, normal: bool = False) -> Column:
    """1 if a text holds an identifier of another, compares with it but for a circled unit, or runs it together without its colon
    where a leading zero keeps it plain; else 0. Nothing in between, as M3:4 and M3:11 look alike."""

    def fits(p: Column) -> Column:
        close = F.exists(p["a"], lambda x: F.exists(p["b"], lambda y: ids_compatible(x, y)))
        run = lambda x: F.rlike(p["t"], F.concat(F.lit("(?<![A-Z0-9])"), F.replace(x, F.lit(":"), F.lit("")), F.lit("(?![A-Z0-9])")))
        return F.arrays_overlap(p["a"], p["b"]) | close | F.exists(p["a"], lambda x: x.rlike(r"^[A-Z]+0\d*:\d+$") & run(x))

    # through an array of one struct: functions over arrays cannot take normalised text from outside
    one = F.struct(ids_in(expected, normal).alias("a"), ids_in(observed, normal).alias("b"), F.upper(observed if normal else nfkc(observed)).alias("t"))
    return F.when(F.get(F.transform(F.array(one), fits), F.lit(0)), 1.0).otherwise(0.0)


def hint_text_score(kind: Column, hint: Column, text: Column, normal: bool = False) -> Column:
    """How well a hint fits a region's text, by its kind: item numbers agree or not, identifiers are strict, and a reference that
    stands in the text as written scores ``REFERENCE_FLOOR`` at least; all else is compared letter by letter."""
    h, t = (hint, text) if normal else (nfkc(hint), nfkc(text))
    items = F.arrays_overlap(label_items(h, True), label_items(t, True)).cast("double")
    score = fuzzy_score(discovery_id(h, True), discovery_id(t, True))
    tight = F.regexp_replace(F.lower(h), SPACE, "")
    shape = F.concat(F.array_join(F.transform(F.split(tight, ""), lambda c: F.concat(F.lit("\\Q"), c, F.lit("\\E"))), "\\s*"), F.when(tight.rlike(r"\d$"), F.lit(r"(?!\d)")).otherwise(F.lit("")))
    stands = (tight != "") & F.rlike(F.lower(t), shape)
    named = kind.isin("artifact_ids", "aliases") & (F.size(ids_in(h, True)) > 0)
    refers = kind.isin("figure_refs", "plate_refs") & stands
    return F.when(kind == "figure_item_nos", items).when(named, id_score(h, t, True)).when(refers, F.greatest(score, F.lit(REFERENCE_FLOOR))).otherwise(score)


def strong_hint(kind: Column, hint: Column, normal: bool = False) -> Column:
    """Whether a hint may name a region on any page: identifiers of three letters and digits, references in full or with an item."""
    text = F.trim(hint if normal else nfkc(hint))
    return F.when(kind == "artifact_ids", F.length(discovery_id(text, True)) >= 3).when(kind.isin("figure_refs", "plate_refs"), text.rlike(REFERENCE_HINT) | text.rlike(ITEM_HINT)).otherwise(F.lit(False))


def hint_method(kind: Column, page_gap: Column, of_caption: Column, window: int = 3) -> Column:
    """The method of a link that a hint made, from the region's kind, its distance, and whether a caption names it (numbers)."""
    item = (kind == "number") & F.coalesce(of_caption, F.lit(False))
    far = page_gap > window
    return F.when(item & far, "global_caption_item_fusion").when(item, "caption_item_identifier_fusion").when(far, "global_identifier_fusion").when(kind == "caption", "caption_first_identifier_fusion").otherwise("identifier_evidence_fusion")


def record_hints(records: DataFrame) -> DataFrame:
    """record_id, pos, kind, hint: the hints of each record in the order they are tried. ``records``: record_id, hints (map of kind
    to array)."""

    def of(kind: str) -> Column:
        return F.transform(F.coalesce(F.col("hints")[kind], F.array().cast("array<string>")), lambda h: F.struct(F.lit(kind).alias("kind"), h.alias("hint")))

    each = F.flatten(F.array(*map(of, HINT_ORDER)))
    return records.select("record_id", F.posexplode(F.filter(each, lambda x: F.trim(x["hint"]) != "")).alias("pos", "h")).select("record_id", "pos", "h.kind", "h.hint")


def crop_compatibility(expected: Column, candidates: Column, numbered: Column) -> Column:
    """Whether a crop may belong to a record, by the numbers found with the crop: true, false, or null where nothing tells.
    A page with numbers hands out no crop by nearness; a crop with a number goes to no record without one."""
    known, some = F.coalesce(expected.rlike(f"^{IDENTIFIER}$"), F.lit(False)), F.size(candidates) > 0
    fits = F.exists(candidates, lambda x: (x == expected) | ids_compatible(x, expected))
    return F.when(known & some, fits).when(some | numbered, F.lit(False))


def shown_thumbnails(records: DataFrame, regions: DataFrame) -> DataFrame:
    """Records whose thumbnail is null where its region is unknown, or approximate and without a crop."""
    fine = regions.filter("NOT (coalesce(approximate, false) AND coalesce(crop_object_key, '') = '')").select(F.col("id").alias("__id")).distinct()
    joined = records.join(fine, F.col("thumbnail_region_id") == F.col("__id"), "left")
    return joined.select(*(F.col("__id").alias(c) if c == "thumbnail_region_id" else F.col(c) for c in records.columns))


def ordered_union(*arrays: Column) -> Column:
    """All values in the order they come, each once; null arrays count as empty."""
    return F.array_distinct(F.concat(*(F.filter(F.coalesce(a, F.array().cast("array<string>")), lambda x: x.isNotNull()) for a in arrays)))


def evidence_union(a: Column, b: Column) -> Column:
    """Evidence (structs with page, region_id, quote) of both, the first of each (page, region, quote)."""
    both = F.concat(a, b)
    keys = F.transform(both, lambda e: F.struct(e["page"], e["region_id"], e["quote"]))
    return F.filter(both, lambda e, i: F.array_position(keys, F.struct(e["page"], e["region_id"], e["quote"])) == i + 1)


def merged_values(owners: DataFrame, followers: DataFrame) -> DataFrame:
    """Fields of records (record_id, key, value, evidence) with those of a fragment of theirs (owner_id, key, value, evidence):
    blanks are filled, the description goes on where it says something new, and evidence is united."""
    right = followers.select(F.col("owner_id").alias("record_id"), "key", F.col("value").alias("__v"), F.col("evidence").alias("__e"))
    joined = owners.join(right, ["record_id", "key"], "full_outer")
    own, more = F.trim(F.coalesce("value", F.lit(""))), F.trim(F.coalesce("__v", F.lit("")))
    longer = (F.col("key") == "morphological_description") & (own != "") & (more != "") & ~F.contains(own, more)
    value = F.when(own == "", F.col("__v")).when(longer, F.concat(own, more)).otherwise(F.col("value"))
    evidence = F.when(own == "", F.coalesce("__e", "evidence")).when(more == "", F.col("evidence")).otherwise(evidence_union(F.col("evidence"), F.col("__e")))
    return joined.select("record_id", "key", value.alias("value"), evidence.alias("evidence"))


def color_relations(pairs: DataFrame, version: str) -> DataFrame:
    """Relation rows of colour regions and the objects they show by their identifier. ``pairs``: job_id, color_region_id,
    artifact_region_id, score."""
    return pairs.select("job_id", stable_hash("rel", F.col("job_id"), F.lit("color_plate_of"), F.col("color_region_id"), F.col("artifact_region_id")).alias("id"), F.col("color_region_id").alias("source_region_id"), F.col("artifact_region_id").alias("target_region_id"), F.lit("color_plate_of").alias("relation_type"), F.round("score", 6).alias("score"), F.lit("exact_artifact_id_color_page").alias("method"), F.lit(version).alias("version"), F.lit("unreviewed").alias("review_status"))


def plate_relations(pairs: DataFrame, version: str) -> DataFrame:
    """Relation rows of texts and the plates they refer to by number and item. ``pairs``: job_id, text_region_id, color_region_id,
    plate_no, item_no, score."""
    key = stable_hash("rel", F.col("job_id"), F.lit("plate_reference_to_color"), F.col("text_region_id"), F.col("color_region_id"), F.col("plate_no").cast("string"), F.col("item_no").cast("string"))
    return pairs.select("job_id", key.alias("id"), F.col("text_region_id").alias("source_region_id"), F.col("color_region_id").alias("target_region_id"), F.lit("plate_reference_to_color").alias("relation_type"), F.round("score", 6).alias("score"), F.lit("exact_plate_item_reference").alias("method"), F.lit(version).alias("version"), F.lit("unreviewed").alias("review_status"))


def display_evidence(evidence: DataFrame) -> DataFrame:
    """record_id, region_id of the evidence to show: the first of the caption's, identifier's or category's field, else of the first
    field that has any. ``evidence``: record_id, key, field_ord, pos, region_id."""
    rank = F.lit(len(DISPLAY_FIELDS))
    for i, name in enumerate(DISPLAY_FIELDS):
        rank = F.when(F.col("key") == name, i).otherwise(rank)
    return evidence.groupBy("record_id").agg(F.min_by("region_id", F.struct(rank.alias("a"), "field_ord", "pos")).alias("region_id"))


def category_lead(c: Column) -> Column:
    """The short name that a description begins with; '' for none."""
    return F.regexp_extract(c, CATEGORY_LEAD, 1)


def texture_phrase(c: Column) -> Column:
    """The first phrase that says what a thing is made of; '' for none."""
    return F.regexp_extract(c, TEXTURE, 1)


def compact_view(records: DataFrame) -> DataFrame:
    """Records for lists: no model runs or relations, evidence without what only the detail view shows."""
    out = records.drop("model_run_ids", "relation_ids")
    return out.withColumn("text_evidence", F.transform(F.filter("text_evidence", lambda e: e["page"].isNotNull()), lambda e: F.struct(e["page"].alias("page"), F.coalesce(e["quote"], F.lit("")).alias("quote"), e["region_id"].alias("region_id"), F.coalesce(e["kind"], F.lit("text")).alias("kind"))))


def cache_key(parts: dict[str, Column]) -> Column:
    """Digest of a JSON object with its keys in order."""
    names = sorted(parts)
    quoted = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"'))
    body = F.concat_ws(", ", *(F.concat(F.lit(f'"{n}": '), quoted(parts[n])) for n in names))
    return F.sha2(F.concat(F.lit("{"), body, F.lit("}")), 256)


def duration_seconds(c: Column) -> Column:
    """Seconds of a rate limit's header: a number, or parts such as 1m30.5s; null for neither."""
    part = lambda unit, seconds: F.aggregate(F.regexp_extract_all(F.lower(c), F.lit(rf"([0-9]+(?:\.[0-9]+)?){unit}"), F.lit(1)), F.lit(0.0), lambda a, x: a + x.cast("double") * seconds)
    total = part("d", 86400) + part("h", 3600) + part("m", 60) + part("s", 1)
    number = F.when(c.rlike(r"^\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*$"), c.try_cast("double"))
    return F.coalesce(number, F.when(F.lower(c).rlike(r"[0-9](?:\.[0-9]+)?[dhms]"), total))


def retry_delay(retry_after: Column, reset: Column, attempt: Column) -> Column:
    """Seconds before the next try: what the answer asks for, else half a second doubled per try; 0.1 to 60."""
    asked = F.coalesce(F.nullif(duration_seconds(retry_after), F.lit(0.0)), F.nullif(duration_seconds(reset), F.lit(0.0)))
    return F.least(F.lit(60.0), F.greatest(F.lit(0.1), F.coalesce(asked, 0.5 * F.pow(F.lit(2.0), attempt))))


def output_tokens(candidates: Column, fields: Column, most: int) -> Column:
    """Tokens to ask for: 320 and, per candidate (one at least), 120 and 34 a field; 768 at least, ``most`` at most."""
    return F.least(F.lit(most), F.greatest(F.lit(768), 320 + F.greatest(F.lit(1), candidates) * (120 + 34 * fields))).cast("int")


def record_limit(fields: Column, most_tokens: int, most_records: int) -> Column:
    """Records that one answer may hold, by its tokens."""
    return F.greatest(F.lit(1), F.least(F.lit(most_records), F.greatest(F.lit(1), F.floor((F.lit(most_tokens) - 320) / (120 + 34 * fields))))).cast("int")


def worker_plan(machines: DataFrame) -> DataFrame:
    """OCR workers and threads for machines (name, cpus, memory_gb, cuda, model): light models run up to 8 workers, heavy ones 2,
    within memory and cores; small machines keep to three threads."""
    model = F.regexp_replace(F.lower(F.coalesce("model", F.lit(""))), r"[^\p{L}\p{N}]", "")
    cap = F.when(model.rlike("tiny|small|mobile|v4"), 8).when(model.rlike("medium|server|v5"), 2).otherwise(8)
    cores = F.greatest(F.lit(2), F.col("cpus") - F.when(F.col("cuda"), 2).otherwise(1))
    by_memory = F.greatest(F.lit(1), F.floor((F.col("memory_gb") - 3.0) / 1.2))
    by_cores = F.when(cap >= 8, F.greatest(F.lit(1), cores - 2)).otherwise(F.greatest(F.lit(1), F.floor(cores / 2)))
    workers = F.least(cap, by_memory, by_cores).cast("int")
    threads = F.least(F.lit(8), F.greatest(F.lit(1), F.floor(cores / F.col("workers")))).cast("int")
    out = machines.withColumn("workers", workers)
    return out.select("name", "workers", F.when(F.col("cpus") <= 4, F.least(threads, F.lit(3))).otherwise(threads).alias("threads"), F.least(F.lit(4), F.col("workers")).alias("discovery"), F.least(F.lit(16), F.greatest(F.lit(8), F.col("workers") * 4)).alias("batch"))
