"""What is read out of answers and pages: payloads unwrapped and checked, fields normalised, lines that wrap, and whose they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.text import nfkc
from sondage.operators.fuse import next_lines
from sondage.operators.records import balanced_parentheses

# How often an answer is unwrapped, the field an answer may be wrapped in, and punctuation that does not count.
UNWRAPPED, WRAPPER = 3, "output"
LOOSE = r"[\s,，。.;；:：、()（）\[\]【】]+"
UNITS = [("厘米", "cm"), ("毫米", "mm"), ("米", "m")]
# Lines that a paragraph or a caption may go on for, and how the next entry begins.
PARAGRAPH_LINES, CAPTION_LINES = 5, 3
NEXT_ENTRY = r"(?i)^\s*[A-Z]{1,6}\s*\d+[A-Z]?(?:\s*[:：]\s*[A-Z]?\d+[A-Z]?|[.\x{3002}、])"


def unfenced(c: Column) -> Column:
    """An answer without its code fence, and of text with more around it what stands between the outermost braces."""
    text = F.regexp_replace(F.trim(c), r"(?is)^```(?:json)?\s*|\s*```\s*$", "")
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.when(text.rlike(r"^[\[{]") | (inner == ""), text).otherwise(inner)


def json_object(c: Column) -> Column:
    """The JSON object that a model's answer holds, null where there is none."""
    text = unfenced(c)
    whole = F.when(F.try_parse_json(text).isNotNull(), text)
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    found = F.coalesce(whole, F.when(F.try_parse_json(inner).isNotNull(), inner))
    return F.when(found.startswith("{"), found)


def unwrapped(c: Column) -> Column:
    """An answer's object: up to three layers of text, list or wrapper are taken off; a list is a list of records."""

    def layer(text: Column) -> Column:
        listed = F.concat(F.lit('{"records": '), text, F.lit("}"))
        inner = F.get_json_object(text, f"$.{WRAPPER}")
        return F.when(text.startswith("["), listed).when(text.startswith("{") & inner.isNotNull(), unfenced(inner)).otherwise(text)

    return reduce(lambda x, _: layer(x), range(UNWRAPPED), unfenced(c))


def payload_outcome(raw: Column, schema: Column, chunk: Column) -> Column:
    """Whether an answer can be read: no_object, other_schema, other_chunk (where it names another than was asked), no_records, or
    read."""
    text = unwrapped(raw)
    at = lambda name: F.get_json_object(text, f"$.{name}")
    fine = F.coalesce(text.startswith("{"), F.lit(False)) & F.try_parse_json(text).isNotNull()
    return F.when(~fine, "no_object").when(at("schema_version").isNotNull() & (at("schema_version") != schema), "other_schema").when(at("chunk_id").isNotNull() & (at("chunk_id") != chunk), "other_chunk").when(~F.coalesce(at("records").startswith("["), F.lit(False)), "no_records").otherwise("read")


def unknown_keys(fields: Column, known: list[str]) -> Column:
    """Keys of a record's fields (a JSON object) that nobody asked for; a record that has any is refused."""
    return F.array_sort(F.array_except(F.coalesce(F.json_object_keys(fields), F.array().cast("array<string>")), F.array(*map(F.lit, known))))


def normalised_fields(rows: DataFrame) -> DataFrame:
    """Fields as they are kept: record_id, key, value, raw_value, status, refused. ``rows``: record_id, key, value, raw_value, status,
    typed (the value as its type reads it, null where it does not), grounded (how many quotes stand in the text).

    A value of another type is kept raw and null, for review; a value without a quote is to be reviewed; no value is missing;
    a null that calls itself valid refuses the record.
    """
    some, typed = F.col("value").isNotNull(), F.col("typed").isNotNull()
    status = F.when(~some & F.col("status").isNull(), "missing").when(some & (~typed | (F.col("grounded") == 0)), "needs_review").otherwise(F.col("status"))
    return rows.select("record_id", "key", F.when(some, F.col("typed")).alias("value"), F.when(some & ~typed, F.coalesce("raw_value", "value")).otherwise(F.col("raw_value")).alias("raw_value"), status.alias("status"), (~some & F.coalesce(F.col("status") == "valid", F.lit(False))).alias("refused"))


def verification_compact(c: Column, normal: bool = False) -> Column:
    """The verification flavour: lower case, three unit words as symbols, no white space and punctuation; '' for null."""
    text = F.lower(F.coalesce(c if normal else nfkc(c), F.lit("")))
    for word, unit in UNITS:
        text = F.replace(text, F.lit(word), F.lit(unit))
    return F.regexp_replace(text, LOOSE, "")


def chunk_rollup(blocks: DataFrame) -> DataFrame:
    """Per chunk (document_id, chunk) its ids in the order they come, sorted references, pages, and a hash of its text. ``blocks``:
    document_id, chunk, ord, page, text, ids, references."""
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("ord", c))), lambda x: x[c])
    out = blocks.groupBy("document_id", "chunk").agg(F.array_distinct(F.flatten(ordered("ids"))).alias("ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("references")))).alias("references"), F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.array_join(ordered("text"), "\n").alias("text"))
    return out.withColumn("content_hash", F.sha2("text", 256))


def wrapped(lines: DataFrame, starts: Column, ends: Column, most: int) -> DataFrame:
    """job_id, page, line_id, owner_id, hop: the lines that go on below each line where ``starts`` holds, at most ``most`` of them, up
    to one where ``ends`` does. Each hop is a join on the next line; the first owner of a line, by its hop, has it."""
    marked = lines.withColumn("starts", F.coalesce(starts, F.lit(False))).withColumn("ends", F.coalesce(ends, F.lit(False)))
    follow = next_lines(lines).select("job_id", "page", F.col("a_id").alias("at"), F.col("next_id").alias("to")).join(marked.filter("NOT ends").select("job_id", "page", F.col("line_id").alias("to")), ["job_id", "page", "to"])
    hop = marked.filter("starts").select("job_id", "page", F.col("line_id").alias("at"), F.col("line_id").alias("owner_id"))
    out = [hop.select("job_id", "page", F.col("at").alias("line_id"), "owner_id", F.lit(0).alias("hop"))]
    for n in range(1, most + 1):
        hop = hop.join(follow, ["job_id", "page", "at"]).select("job_id", "page", F.col("to").alias("at"), "owner_id")
        out.append(hop.select("job_id", "page", F.col("at").alias("line_id"), "owner_id", F.lit(n).alias("hop")))
    every = reduce(DataFrame.unionByName, out)
    return every.groupBy("job_id", "page", "line_id").agg(F.min(F.struct("hop", "owner_id")).alias("b")).select("job_id", "page", "line_id", "b.owner_id", "b.hop")


def artifact_owners(lines: DataFrame) -> DataFrame:
    """job_id, page, line_id, artifact_id: the object whose paragraph a line belongs to: its own identifier, or that of the line it
    goes on from. ``lines``: job_id, page, line_id, ord, bbox, text, artifact_id ('' for none)."""
    own = F.coalesce("artifact_id", F.lit("")) != ""
    found = wrapped(lines, own, own | F.col("text").rlike(NEXT_ENTRY), PARAGRAPH_LINES)
    return found.join(lines.select("job_id", "page", F.col("line_id").alias("owner_id"), "artifact_id"), ["job_id", "page", "owner_id"]).select("job_id", "page", "line_id", "artifact_id")


def completed_captions(lines: DataFrame) -> DataFrame:
    """job_id, page, line_id, text of lines with an open parenthesis, and of the up to three lines below that close it; a line that is
    not closed by then stays as it is."""
    open_ = ~balanced_parentheses(F.col("text"))
    chain = wrapped(lines.withColumn("text", F.coalesce("text", F.lit(""))), open_ & F.col("text").rlike(r"[(（][^()（）]*$"), F.col("text").rlike(NEXT_ENTRY), CAPTION_LINES)
    parts = chain.join(lines.select("job_id", "page", "line_id", "text"), ["job_id", "page", "line_id"])
    each = parts.groupBy("job_id", "page", "owner_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("hop", "text"))), lambda x: x["text"]).alias("texts"))  # a few lines each
    tries = F.transform(F.sequence(F.lit(1), F.size("texts")), lambda n: F.array_join(F.slice("texts", 1, n), ""))
    closed = F.get(F.filter(tries, balanced_parentheses), F.lit(0))
    return each.select("job_id", "page", F.col("owner_id").alias("line_id"), F.coalesce(closed, F.get("texts", F.lit(0))).alias("text"))


def primary_artifacts(records: DataFrame, regions: DataFrame, relations: DataFrame) -> DataFrame:
    """record_id, region_id of the drawing a record stands for: the one it names, else that of its saved relation, else the best relation
    (accepted, then by score) from a number that reads as its identifier. ``records``: record_id, page, primary_artifact_region_id,
    primary_relation_id, artifact_id; ``regions``: id, page, kind, artifact_id."""
    drawn = regions.filter("kind = 'artifact'").select(F.col("id").alias("target_region_id"))
    links = relations.filter("relation_type = 'number_of'").join(drawn, "target_region_id")
    saved = links.select(F.col("id").alias("primary_relation_id"), F.col("target_region_id").alias("__saved"))
    numbers = regions.filter("kind = 'number' AND coalesce(artifact_id, '') <> ''").select("page", "artifact_id", F.col("id").alias("source_region_id"))
    rank = F.struct((F.col("review_status") == "accepted").alias("a"), F.coalesce("score", F.lit(0.0)).alias("s"), F.col("target_region_id").alias("t"))
    named = numbers.join(links.filter("review_status <> 'rejected'"), "source_region_id").groupBy("page", "artifact_id").agg(F.max_by("target_region_id", rank).alias("__named"))
    joined = records.join(saved, "primary_relation_id", "left").join(named, ["page", "artifact_id"], "left")
    return joined.select("record_id", F.coalesce(F.nullif("primary_artifact_region_id", F.lit("")), "__saved", "__named").alias("region_id")).filter("region_id IS NOT NULL")


def calibration_examples(items: DataFrame, most: int = 300) -> DataFrame:
    """What a model is shown of the human's sample: verdicts, codes and reasons, cut to ``most`` characters. The profile that holds them
    stands by itself where no model can word it."""
    cut = lambda c, n=most: F.substring(F.coalesce(c, F.lit("")), 1, n).alias(c)
    return items.select("record_id", F.col("verdict").alias("human_verdict"), F.col("failure_code").alias("human_failure_code"), cut("failure_reason"), F.col("machine_verdict").alias("initial_machine_verdict"), cut("machine_reason"))


def calibration_profile(examples: DataFrame, instructions: DataFrame | None = None, most: int = 12) -> DataFrame:
    """One row: source, sample_size, instructions. A model's instructions (pos, text) count if any say something, the first twelve of
    them; else the profile is the sample's own."""
    size = examples.agg(F.count("*").alias("sample_size"))
    if instructions is None:
        return size.select(F.lit("deterministic_human_sample").alias("source"), "sample_size", F.array().cast("array<string>").alias("instructions"))
    said = instructions.filter(F.trim("text") != "").orderBy("pos").limit(most).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "text"))), lambda x: F.substring(x["text"], 1, 500)).alias("instructions"))
    one = size.crossJoin(said)  # two single rows
    return one.select(F.when(F.size("instructions") > 0, "model_human_calibration").otherwise("deterministic_human_sample").alias("source"), "sample_size", "instructions")
