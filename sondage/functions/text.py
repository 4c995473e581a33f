"""Identifiers, references, measurements and similarity as column expressions.

NFKC is no Spark function; ``nfkc`` is one Arrow function that leaves ASCII batches alone. Everything after it stays in
the JVM. Inputs known to be ASCII or normalised pass ``normal=True`` and skip it.
"""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Texts that count as no value.
EMPTY = ["", "-", "—", "－", "无", "none", "null", "nan"]
# Unit words and what they become, in this order.
UNIT_WORDS = [("厘米", "cm"), ("公分", "cm"), ("毫米", "mm"), ("米", "m")]
# Numerals in figure and plate numbers.
NUMERALS = "一二三四五六七八九十百零〇"
SPACE = r"(?U)\s+"


@lru_cache(maxsize=1)
def _nfkc():
    """One function for all plans, so a plan that asks for the same column twice computes it once."""

    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFKC", v))

    return F.pandas_udf(each, "string")


def nfkc(c: Column) -> Column:
    return _nfkc()(c)


def _normal(c: Column, normal: bool) -> Column:
    return c if normal else nfkc(c)


def clean_value(c: Column, normal: bool = False) -> Column:
    """Trimmed text, null for empty markers. Integral doubles are passed as text without a fraction by ``number_text``."""
    text = F.regexp_replace(_normal(c.cast("string"), normal), r"(?U)^\s+|\s+$", "")
    return F.when(~F.lower(text).isin(EMPTY), text)


def number_text(c: Column) -> Column:
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def identifier(c: Column, normal: bool = False) -> Column:
    """Evaluation flavour: colons count as commas, no spaces, no doubled or outer commas, upper case; '' for no value."""
    text = F.translate(F.coalesce(clean_value(c, normal), F.lit("")), "，：:", ",,,")
    return F.upper(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, SPACE, ""), ",+", ","), "^,|,$", ""))


def canonical_id(context: Column, sequence: Column, normal: bool = False) -> Column:
    return identifier(F.concat_ws(",", clean_value(context, normal), clean_value(sequence, normal)), True)


def report_name(c: Column, normal: bool = False) -> Column:
    name = F.regexp_replace(_normal(c, normal), r"(?U)^\s+|\s+$", "")
    return F.replace(F.lower(F.regexp_replace(F.regexp_replace(name, r"(?i)\.pdf$", ""), SPACE, "")), F.lit("ß"), F.lit("ss"))  # as case folding has it


def sampling_id(c: Column, normal: bool = False) -> Column:
    """Sampling flavour: as ``identifier``, but empty markers are kept as they are."""
    text = F.translate(F.coalesce(_normal(c.cast("string"), normal), F.lit("")), "，：:", ",,,")
    return F.upper(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, SPACE, ""), ",+", ","), "^,|,$", ""))


# The shape of an artifact identifier.
STRICT_ID = r"[A-Z]{1,6}\d+[A-Z]?(?::[A-Z]?\d+[A-Z]?)+"


def entity_id_text(c: Column, normal: bool = False) -> Column:
    """Entity flavour: one strict identifier, alone or embedded, in lower case; '' if there is none or more than one."""
    text = F.regexp_replace(F.upper(F.regexp_replace(F.coalesce(_normal(c, normal), F.lit("")), SPACE, "")), r"^[一-鿿]{1,2}(?=[A-Z])", "")
    inside = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<![A-Z0-9])(?:[一-鿿]{{1,2}})?({STRICT_ID})(?![A-Z0-9])"), F.lit(1)))
    return F.lower(F.when(text.rlike(f"^{STRICT_ID}$"), text).when(F.size(inside) == 1, F.element_at(inside, 1)).otherwise(F.lit("")))


def index_id(c: Column, normal: bool = False) -> Column:
    """Text-index flavour: upper case, keeps colons, trims outer punctuation."""
    return F.regexp_replace(F.upper(F.regexp_replace(F.translate(_normal(c, normal), "：", ":"), SPACE, "")), r"^[:,.;、，。；]+|[:,.;、，。；]+$", "")


def discovery_id(c: Column, normal: bool = False) -> Column:
    """Discovery flavour: letters and digits only. It makes different identifiers equal, so it serves recall alone."""
    return F.regexp_replace(F.lower(_normal(c, normal)), r"[^\p{L}\p{N}]+", "")


def compact(c: Column, normal: bool = False) -> Column:
    """Lower case, unit words as symbols, only digits, a-z, CJK and points; '' for no value."""
    text = F.lower(F.coalesce(clean_value(c, normal), F.lit("")))
    for word, unit in UNIT_WORDS:
        text = F.replace(text, F.lit(word), F.lit(unit))
    return F.regexp_replace(text, r"[^0-9a-z\x{4e00}-\x{9fff}.]+", "")


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="Float64")


def sequence_ratio(a: Column, b: Column) -> Column:
    """Matching-blocks ratio, in this order of arguments: it is not symmetric. Null in, null out."""
    return F.pandas_udf(_ratio, "double")(a, b)


def compact_similarity(a: Column, b: Column, exact_only: bool = False) -> Column:
    """Similarity of two compact texts: 1 if equal, 0 if one is empty, at least 0.9 if one holds the other, else the ratio.
    The ratio is asked only of the rest. ``exact_only`` gives null there, for plans that stay in the JVM."""
    la, lb = F.length(a), F.length(b)
    held = F.when((la == 0) & (lb == 0), 1.0).when((la == 0) | (lb == 0), 0.0).when(a == b, 1.0).when(F.contains(b, a) | F.contains(a, b), F.greatest(F.lit(0.9), F.least(la, lb) / F.greatest(la, lb)))
    if exact_only:
        return held
    rest = held.isNull()
    return F.coalesce(held, sequence_ratio(F.when(rest, a), F.when(rest, b)))


def text_similarity(actual: Column, expected: Column, normal: bool = False) -> Column:
    return compact_similarity(compact(actual, normal), compact(expected, normal))


def fuzzy_score(a: Column, b: Column) -> Column:
    """Hint flavour: 1 if equal, 0.94 if one of at least three characters holds the other, else the ratio."""
    short, held = F.least(F.length(a), F.length(b)), F.contains(a, b) | F.contains(b, a)
    quick = F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).when(a == b, 1.0).when((short >= 3) & held, 0.94)
    return F.coalesce(quick, sequence_ratio(F.when(quick.isNull(), a), F.when(quick.isNull(), b)))


NUMBER = r"\d+(?:\.\d+)?"


def measurements(c: Column, normal: bool = False) -> Column:
    """array<struct<amount decimal, unit string, micro long>> in order; the unit is null where none follows the number, and micro
    is the amount in millionths."""
    text = F.lower(F.coalesce(_normal(c.cast("string"), normal), F.lit("")))
    for word, unit in UNIT_WORDS[:3]:
        text = F.replace(text, F.lit(word), F.lit(unit))
    found = F.regexp_extract_all(text, F.lit(rf"({NUMBER}\s*(?:cm|mm|m)?)"), F.lit(1))
    amount = lambda m: F.regexp_extract(m, f"({NUMBER})", 1).cast("decimal(20,6)")
    return F.transform(found, lambda m: F.struct(amount(m).alias("amount"), F.nullif(F.regexp_extract(m, "([a-z]+)$", 1), F.lit("")).alias("unit"), (amount(m) * 1_000_000).cast("long").alias("micro")))


def in_cm(m: Column) -> Column:
    """The amount of a measurement in centimetres; without a unit as it stands."""
    unit = m["unit"]
    return F.when(unit == "mm", m["amount"] / 10).when(unit == "m", m["amount"] * 100).otherwise(m["amount"]).cast("decimal(26,8)")


def measurement_tokens(c: Column, normal: bool = False) -> Column:
    """Distinct amounts with unit, mm and m as cm."""
    plain = lambda v: F.regexp_replace(F.regexp_replace(v.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.array_sort(F.array_distinct(F.transform(measurements(c, normal), lambda m: F.concat(plain(in_cm(m)), F.when(m["unit"].isNotNull(), "cm").otherwise("")))))


def measurement_overlap(expected: Column, actual: Column) -> Column:
    """Share of expected measurements that find an actual one of their own, first come first served. Takes two columns of
    ``measurements``: units compare in cm, a missing unit compares bare numbers."""

    def millimetres(m: Column) -> Column:
        return m["micro"] * F.when(m["unit"] == "m", 1000).when(m["unit"] == "cm", 10).otherwise(1)

    def step(state: Column, e: Column) -> Column:
        fits = F.transform(state["left"], lambda a: F.when(a["unit"].isNotNull() & e["unit"].isNotNull(), a["mm"] == millimetres(e)).otherwise(a["micro"] == e["micro"]))
        at = F.array_position(fits, True)
        rest = F.filter(state["left"], lambda _, i: i + 1 != at)
        return F.struct(rest.alias("left"), (state["n"] + F.when(at > 0, 1).otherwise(0)).alias("n"), (state["of"] + 1).alias("of"))

    left = F.transform(actual, lambda a: F.struct(a["unit"].alias("unit"), a["micro"].alias("micro"), millimetres(a).alias("mm")))
    start = F.struct(left.alias("left"), F.lit(0).alias("n"), F.lit(0).alias("of"))
    return F.aggregate(expected, start, step, lambda s: F.when(s["of"] == 0, 0.0).otherwise(s["n"] / s["of"]))


# Words before a figure or plate number.
FIGURE_WORDS = r"(?:图|彩版|彩图|图版|figure|fig\.?|plate)"


def figure_tokens(c: Column, normal: bool = False) -> Column:
    """Distinct figure and plate references, without spaces, in lower case."""
    text = F.translate(F.regexp_replace(F.coalesce(_normal(c.cast("string"), normal), F.lit("")), SPACE, ""), "：，", ":,")
    item = f"[{NUMERALS}0-9A-Za-z-]+"
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"((?i){FIGURE_WORDS}{item}(?:[,.:]{item})*)"), F.lit(1)), F.lower))


def split_references(c: Column, normal: bool = False) -> Column:
    """struct<figures, plates>: references in order, each once."""
    text, item = F.coalesce(clean_value(c, normal), F.lit("")), rf"[{NUMERALS}0-9A-Za-z\-]+"
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"((?i)(?:彩版|彩图|图版|图|figure|fig\.?|plate)\s*{item}(?:\s*[,.:：，]\s*{item})*)"), F.lit(1)), F.trim))
    plate = lambda r: r.rlike(r"^(?i)(?:彩版|彩图|plate)")
    return F.struct(F.filter(found, lambda r: ~plate(r)).alias("figures"), F.filter(found, plate).alias("plates"))


def plate_keys(c: Column, normal: bool = False) -> Column:
    """Colour plate references in normal form, in order, each once."""
    found = F.regexp_extract_all(F.coalesce(clean_value(c, normal), F.lit("")), F.lit(r"(彩版[〇零一二三四五六七八九十百0-9O○\-]+(?:[,，][〇零一二三四五六七八九十百0-9]+)?)"), F.lit(1))
    return F.array_distinct(F.transform(found, reference_text))


def reference_text(c: Column) -> Column:
    """A reference with commas for colons, plain hyphens, no spaces and no outer stops."""
    return F.regexp_replace(F.regexp_replace(F.translate(c, "，：:－—", ",,,--"), SPACE, ""), r"^[.,;；]+|[.,;；]+$", "")


# The least score that counts as a match, by field.
THRESHOLDS = {"artifact_id": 1.0}
DEFAULT_THRESHOLD = 0.85


def compare_fields(rows: DataFrame, key: str, actual: str, expected: str, *, normal: bool = False, exact_only: bool = False) -> DataFrame:
    """``rows`` with verdict, score and exact in place of the actual and expected columns. An empty expectation is no label
    (not_applicable), an empty value is missing. ``exact_only`` scores 0 where the ratio would be asked.

    Each step is a projection of its own, so no text is made compact twice and generated code stays small.
    """
    kept = [c for c in rows.columns if c not in (actual, expected)]
    k, is_measure, is_figure = F.col(key), F.col(key) == "measurements", F.col(key) == "figure_caption"
    both = rows if normal else rows.withColumns({c: nfkc(F.col(c).cast("string")) for c in (actual, expected)})
    out = both.withColumns({"__a": compact(F.col(actual), True), "__e": compact(F.col(expected), True)})
    out = out.withColumns({
        "__em": F.when(is_measure, measurements(F.col(expected), True)),
        "__am": F.when(is_measure, measurements(F.col(actual), True)),
        "__ef": F.when(is_figure, figure_tokens(F.col(expected), True)),
        "__af": F.when(is_figure, figure_tokens(F.col(actual), True)),
    })
    measured, by_figure = F.coalesce(F.size("__em") > 0, F.lit(False)), F.coalesce(F.size("__ef") > 0, F.lit(False))
    score = F.when(measured, measurement_overlap(F.col("__em"), F.col("__am"))).when(by_figure, F.size(F.array_intersect("__ef", "__af")) / F.size("__ef")).otherwise(F.coalesce(compact_similarity(F.col("__a"), F.col("__e"), exact_only), F.lit(0.0)))
    least = F.when(is_measure & ~measured, 0.9).when(is_measure | by_figure, 1.0).when(k.isin(list(THRESHOLDS)), 1.0).otherwise(DEFAULT_THRESHOLD)
    out = out.withColumn("__score", score)
    verdict = F.when(F.length("__e") == 0, "not_applicable").when(F.length("__a") == 0, "missing").when(F.col("__score") >= least, "matched").otherwise("mismatched")
    out = out.withColumn("verdict", verdict)
    return out.select(*kept, "verdict", F.when(F.col("verdict").isin("not_applicable", "missing"), 0.0).otherwise(F.col("__score")).alias("score"), ((F.length("__a") > 0) & (F.col("__a") == F.col("__e"))).alias("exact"))


def stable_hash(prefix: str, *parts: Column, sep: str = ":", bits: int = 256) -> Column:
    """prefix_ and 24 hex digits of the digest of the parts."""
    text = F.concat_ws(sep, *parts)
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(text) if bits == 160 else F.sha2(text, bits), 1, 24))


def signature(ids: Column) -> Column:
    """Digest of a set of ids, '' for none."""
    own = F.array_sort(F.array_distinct(ids))
    return F.when(F.size(own) > 0, F.substring(F.sha2(F.array_join(own, "|"), 256), 1, 24)).otherwise("")


def token_estimate(c: Column) -> Column:
    """max(1, floor(ascii / 3.5 + others * 1.15) + 32)."""
    ascii_ = F.length(F.regexp_replace(c, r"[^\x00-\x7F]", ""))
    return F.greatest(F.lit(1), F.floor(ascii_ / 3.5 + (F.length(c) - ascii_) * 1.15) + 32)


def guarded(c: Column) -> Column:
    """Text that a spreadsheet would take for a formula gets an apostrophe before it."""
    return F.when(c.rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


# Material buckets in the order they are tried.
MATERIALS = [("玉|翡翠|玛瑙", "玉石"), ("陶|瓷", "陶瓷"), ("泥质|夹砂|夹炭|细泥|粗泥", "泥质 / 夹砂"), ("铜|青铜|金|银|铁", "金属"), ("骨|牙|角|贝", "骨牙贝"), ("石|岩|矿|燧", "石质"), ("木|竹|漆", "木竹漆")]


def bucket(c: Column, rules: list[tuple[str, str]], none: str, other: str) -> Column:
    """The first rule whose pattern the text holds."""
    text = F.trim(F.coalesce(c, F.lit("")))
    out = F.when(text == "", none)
    for pattern, name in rules:
        out = out.when(text.rlike(pattern), name)
    return out.otherwise(other)


def material(c: Column) -> Column:
    """The bucket of a material or texture."""
    return bucket(c, MATERIALS, "未记录", "其他材质")


def category(c: Column, most: int = 12, none: str = "未归类") -> Column:
    text = F.trim(F.coalesce(c, F.lit("")))
    return F.when((text != "") & (F.length(text) <= most), text).otherwise(none)


# Punctuation and what it becomes.
PUNCTUATION = ("，。：；（）", ",.:;()")
DATES = [r"(\d{4})年(\d{1,2})月(\d{1,2})日", r"(\d{4})[/.](\d{1,2})[/.](\d{1,2})"]


def _iso_dates(text: Column, pattern: str) -> Column:
    """Pads month and day by replacing from the loosest shape to the tightest; the calendar is not checked."""
    y, m, d = pattern.split("(")[1:]
    tails = [m.split(")", 1)[1], d.split(")", 1)[1]]
    mid = y.split(")", 1)[1]
    for mm, dd, to in ((r"(\d{2})", r"(\d{2})", "$1-$2-$3"), (r"(\d)", r"(\d{2})", "$1-0$2-$3"), (r"(\d{2})", r"(\d)", "$1-$2-0$3"), (r"(\d)", r"(\d)", "$1-0$2-0$3")):
        end = tails[1] if tails[1] else r"(?!\d)" if dd == r"(\d)" else ""
        text = F.regexp_replace(text, rf"(\d{{4}}){mid}{mm}{tails[0]}{dd}{end}", to)
    return text


def post_process(c: Column, rules: set[str]) -> Column:
    """Enabled rules in their fixed order: numerals, white space, punctuation, units, dates."""
    if "chinese_number_to_arabic" in rules:
        from sondage.functions.numerals import replace_prose_numbers

        c = replace_prose_numbers(c)
    if "space_removal" in rules:
        c = F.trim(F.regexp_replace(c, SPACE, " "))
    if "punctuation_normalization" in rules:
        c = F.translate(c, *PUNCTUATION)
    if "unit_standardization" in rules:
        c = F.regexp_replace(c, r"(?<=\d)\s*(?:厘米|公分)", " cm")
    if "date_formatting" in rules:
        for pattern in DATES:
            c = _iso_dates(c, pattern)
    return c


def typed_number(c: Column) -> Column:
    """Text that reads as a plain decimal becomes a number; exponents do not."""
    return F.when(F.trim(c).rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$"), F.trim(c).try_cast("double"))
