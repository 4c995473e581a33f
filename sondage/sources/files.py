"""Scans: OCR tables, detector output, label files, human sheets, binaries; and guarded sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondage.functions import geometry as g
from sondage.functions.text import canonical_id, identifier

OCR_SCHEMA = "level int, page_num int, block_num int, par_num int, line_num int, word_num int, left double, top double, width double, height double, conf double, text string"
# Classes of the detector.
DETECTOR_KINDS = {0: "artifact", 1: "number", 2: "caption", 3: "grave_drawing", 4: "group"}
REGION_KINDS = ["text", "line_drawing", "color_plate", "artifact", "caption", "number", "group", "grave_drawing", "other"]


def ocr_lines(spark: SparkSession, path: str, width: int, height: int, least: float = 0.5) -> DataFrame:
    """Lines of an OCR word table: words of enough confidence by (page, block, paragraph, line), their text in word order, the
    union of their boxes in page coordinates and the mean confidence; ordered by top and left."""
    words = spark.read.schema(OCR_SCHEMA).csv(path, sep="\t", header=True, quote="").filter((F.col("conf") >= least * 100) & (F.trim("text") != ""))
    joined = lambda a, b: F.concat(a, F.when((a != "") & a.rlike(r"[\x00-\x7F]$") & b.rlike(r"^[\x00-\x7F]"), F.lit(" ")).otherwise(""), b)
    text = F.aggregate(F.sort_array(F.collect_list(F.struct("word_num", "text"))), F.lit(""), lambda a, w: joined(a, w["text"]))
    lines = words.groupBy("page_num", "block_num", "par_num", "line_num").agg(text.alias("text"), F.min("left").alias("l"), F.min("top").alias("t"), F.max(F.col("left") + F.col("width")).alias("r"), F.max(F.col("top") + F.col("height")).alias("b"), (F.avg("conf") / 100).alias("confidence"))
    box = g.box(F.col("l") / width, F.col("t") / height, F.least(F.lit(1.0), F.col("r") / width), F.least(F.lit(1.0), F.col("b") / height))
    return lines.select(F.col("page_num").alias("page"), "text", box.alias("bbox"), "confidence").orderBy("page", "bbox.t", "bbox.l")


def ocr_payload(rows: DataFrame, column: str, width: Column, height: Column) -> DataFrame:
    """Blocks of worker payloads: {"texts": [..], "boxes": [[l, t, r, b]..], "scores": [..]} in pixels."""
    shape = "struct<texts: array<string>, boxes: array<array<double>>, scores: array<double>>"
    parsed = rows.withColumn("__p", F.from_json(column, shape)).withColumn("__b", F.explode(F.arrays_zip("__p.texts", "__p.boxes", "__p.scores")))
    b = F.col("__b.boxes")
    return parsed.select(*[c for c in rows.columns if c != column], F.col("__b.texts").alias("text"), g.box(b[0] / width, b[1] / height, b[2] / width, b[3] / height).alias("bbox"), F.col("__b.scores").alias("confidence")).filter(F.trim("text") != "").orderBy("bbox.t", "bbox.l")


def detections(spark: SparkSession, path: str) -> DataFrame:
    """page, kind, bbox, confidence of detector JSON lines {"page", "predictions": [{"kind", "bbox", "confidence"}]}; anything
    that is no box, kind or confidence is an error."""
    shape = "page int, predictions array<struct<kind: string, bbox: array<double>, confidence: double>>"
    rows = spark.read.schema(shape).json(path).select("page", F.explode("predictions").alias("p"))
    p = F.col("p.bbox")
    rows = rows.select("page", F.col("p.kind").alias("kind"), g.box(p[0], p[1], p[2], p[3]).alias("bbox"), F.col("p.confidence").alias("confidence"))
    fine = g.valid(F.col("bbox")) & F.col("kind").isin(REGION_KINDS) & F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    return rows.withColumn("page", F.when(fine, F.col("page")).otherwise(F.raise_error(F.concat(F.lit("bad prediction: "), F.to_json(F.struct("kind", "bbox", "confidence"))))))


def label_boxes(spark: SparkSession, path: str) -> DataFrame:
    """page, kind, bbox of label files ``class cx cy w h``; the page is the number at the end of the file name; lines that do
    not read so are skipped."""
    rows = spark.read.text(path).select(F.regexp_extract("_metadata.file_name", r"(\d+)\.[^.]*$", 1).try_cast("int").alias("page"), F.split(F.trim("value"), r"\s+").alias("p"))
    n = [F.get("p", F.lit(i)).try_cast("double") for i in range(5)]
    clamp = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    kind = F.element_at(F.create_map(*(x for k, v in DETECTOR_KINDS.items() for x in (F.lit(k), F.lit(v)))), n[0].cast("int"))
    box = g.box(clamp(n[1] - n[3] / 2), clamp(n[2] - n[4] / 2), clamp(n[1] + n[3] / 2), clamp(n[2] + n[4] / 2))
    out = rows.filter(F.size("p") == 5).select("page", kind.alias("kind"), box.alias("bbox"))
    return out.filter(F.col("page").isNotNull() & F.col("kind").isNotNull() & g.valid(F.col("bbox")))


def human_sheet(spark: SparkSession, path: str, *, id_col: str | None = None, context_col: str | None = None, sequence_col: str | None = None) -> DataFrame:
    """Rows of a human sheet (CSV) with source_row, canonical_artifact_id and duplicate_key_count. Blank rows are skipped and
    rows without a key dropped; rows that share a key all stay. Row numbers come from one file read in order."""
    rows = spark.read.csv(path, header=True, multiLine=True).withColumn("source_row", F.monotonically_increasing_id() + 2)
    plain = [c for c in rows.columns if c != "source_row"]
    some = F.concat_ws("", *(F.trim(F.coalesce(F.col(c), F.lit(""))) for c in plain)) != ""
    key = identifier(F.col(id_col)) if id_col else canonical_id(F.col(context_col), F.col(sequence_col))
    keyed = rows.filter(some).withColumn("canonical_artifact_id", key).filter("canonical_artifact_id <> ''")
    return keyed.withColumn("duplicate_key_count", F.count("*").over(Window.partitionBy("canonical_artifact_id")))


def sheet_preview(spark: SparkSession, path: str, rows: int = 8) -> tuple[list[str], DataFrame]:
    """The header and the first rows of a sheet."""
    sheet = spark.read.csv(path, header=True, multiLine=True)
    return sheet.columns, sheet.limit(rows)


def assets(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """path, stem, asset_type of the files below a folder; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    rows = rows.withColumn("stem", F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1))
    plate = F.col("stem").rlike("^(?:彩版|彩图|图版|(?i:plate))")
    if known is None:
        return rows.withColumn("asset_type", F.when(plate, "color_plate").otherwise("other"))
    ids = known.select(F.col("canonical_artifact_id").alias("__id")).distinct()
    joined = rows.withColumn("__stem", identifier(F.col("stem"))).join(ids, F.col("__stem") == F.col("__id"), "left")
    return joined.withColumn("asset_type", F.when(plate, "color_plate").when(F.col("__id").isNotNull(), "artifact").otherwise("other")).drop("__id", "__stem")


def binaries(spark: SparkSession, path: str, most_bytes: int = 512 << 20) -> DataFrame:
    """path, length, sha256 of PDF files: too large, empty or wrongly marked files are rows with an error."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path)
    error = F.when(F.col("length") > most_bytes, "too large").when(F.col("length") == 0, "empty").when(F.substring(F.col("content"), 1, 5) != F.lit(b"%PDF-"), "no PDF")
    return rows.select("path", "length", F.sha2("content", 256).alias("sha256"), error.alias("error"))


def first_per_digest(uploads: DataFrame, stored: DataFrame) -> DataFrame:
    """Uploads whose content is not stored yet, each content once."""
    return uploads.join(stored.select("sha256"), "sha256", "left_anti").dropDuplicates(["sha256"])


def write_csv(rows: DataFrame, path: str) -> None:
    """With the spreadsheet guard on every text."""
    from sondage.functions.text import guarded

    rows.select(*(guarded(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes)).write.mode("overwrite").csv(path, header=True)
