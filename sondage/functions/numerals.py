"""Numerals written in Chinese. Four readings are kept apart, because they accept different strings."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Digits and units.
DIGITS = {"零": 0, "〇": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
LABEL_DIGITS = "零一二三四五六七八九"
SMALL_UNITS = {"十": 10, "百": 100, "千": 1000}
LARGE_UNITS = {"万": 10_000, "亿": 100_000_000}


def _positional(text: str, digits: dict[str, int]) -> int:
    return int("".join(str(digits[c]) for c in text))


def _sections(text: str, digits: dict[str, int], small: dict[str, int]) -> int:
    """Value below a large unit: a digit counts for the unit after it, a unit without a digit counts once."""
    total = pending = 0
    for c in text:
        if c in digits:
            pending = digits[c]
        else:
            total, pending = total + (pending or 1) * small[c], 0
    return total + pending


def prose_number(text: str) -> int:
    """As runs of numerals in prose are read: positional without units, else by 万 and 亿. A large unit with nothing before
    it counts zero."""
    if not any(c in SMALL_UNITS or c in LARGE_UNITS for c in text):
        return _positional(text, DIGITS)
    total, begin = 0, 0
    for i, c in enumerate(text):
        if c in LARGE_UNITS:
            total += _sections(text[begin:i], DIGITS, SMALL_UNITS) * LARGE_UNITS[c]
            begin = i + 1
    return total + _sections(text[begin:], DIGITS, SMALL_UNITS)


def reference_number(text: str | None, *, traditional: bool = True) -> int | None:
    """As figure and plate numbers are read: ASCII digits, positional numerals, or with 十 and 百; null otherwise."""
    text = unicodedata.normalize("NFKC", text or "").strip()
    if not text:
        return None
    if text.isdigit():
        return int(text)
    digits = DIGITS | ({"兩": 2} if traditional else {})
    if all(c in digits for c in text):
        return _positional(text, digits)
    units = {"十": 10, "百": 100}
    return _sections(text, digits, units) if all(c in digits or c in units for c in text) else None


def label_number_column(c: Column) -> Column:
    """As sequence labels are read: one digit, or at most 99 around a single 十; null otherwise."""
    text = F.translate(c, "〇", "零")
    value = lambda x: F.position(x, F.lit(LABEL_DIGITS)) - 1
    shape = f"^([{LABEL_DIGITS}]?)十([{LABEL_DIGITS}]?)$"
    tens, ones = F.regexp_extract(text, shape, 1), F.regexp_extract(text, shape, 2)
    return F.when(text.rlike(f"^[{LABEL_DIGITS}]$"), value(text)).when(text.rlike(shape), F.when(tens == "", 1).otherwise(value(tens)) * 10 + F.when(ones == "", 0).otherwise(value(ones)))


def _udf(function, kind: str):
    return F.pandas_udf(lambda s: s.map(lambda v: None if v is None else function(v)).astype("Int64" if kind == "long" else object), kind)


def prose_number_column(c: Column) -> Column:
    return _udf(prose_number, "long")(c)


def reference_number_column(c: Column, *, traditional: bool = True) -> Column:
    """As figure and plate numbers are read: ASCII digits, positional numerals, or with 十 and 百; null otherwise. An expression,
    so it can be used on the elements of an array; ``c`` is normalised already."""
    digits = {k: v for k, v in DIGITS.items()} | ({"兩": 2} if traditional else {})
    letters = "".join(digits)
    value = lambda x: F.translate(x, letters, "".join(str(v) for v in digits.values())).cast("long")
    unit = lambda x: F.when(x == "十", 10).when(x == "百", 100)
    zero = F.lit(0).cast("long")
    step = lambda acc, x: F.when(unit(x).isNull(), F.struct(acc["total"].alias("total"), value(x).alias("pending"))).otherwise(F.struct((acc["total"] + F.when(acc["pending"] > 0, acc["pending"]).otherwise(1) * unit(x)).alias("total"), zero.alias("pending")))
    text = F.trim(c)
    summed = F.aggregate(F.split(text, ""), F.struct(zero.alias("total"), zero.alias("pending")), step, lambda acc: acc["total"] + acc["pending"])
    return F.when(text.rlike(r"^[0-9]{1,18}$"), text.cast("long")).when(text.rlike(f"^[{letters}]{{1,18}}$"), value(text)).when(text.rlike(f"^[{letters}十百]+$"), summed)


def replace_prose_numbers(c: Column) -> Column:
    """Every run of numerals, also inside words, becomes its number."""
    import re

    run = re.compile("[" + "".join(DIGITS) + "".join(SMALL_UNITS) + "".join(LARGE_UNITS) + "]+")

    def each(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else run.sub(lambda m: str(prose_number(m[0])), v))

    return F.pandas_udf(each, "string")(c)
