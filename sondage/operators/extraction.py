"""Extraction results: JSON salvage, normalisation, typed values, chunks, grounding and merging."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.functions.text import typed_number

# Short names in compact payloads and what they stand for, and status aliases.
SHORT = {"v": "value", "raw": "raw_value", "q": "quote", "rid": "region_id", "s": "status"}
STATUS = {"ok": "valid", "valid": "valid", "missing": "missing", "none": "missing", "review": "needs_review", "needs_review": "needs_review", "uncertain": "needs_review"}


def salvage(text: str | None) -> str | None:
    """The JSON value in a reply: fences off, trailing commas off, and what was cut off closed again. None if there is none."""
    text = re.sub(r"^\s*```(?:json)?\s*|\s*```\s*$", "", text or "").strip()
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if start < 0:
        return None
    text = text[start:]
    closers: list[str] = []
    string = escaped = False
    safe, kept = 0, []  # the last place where a value had ended, and what was open there
    for i, c in enumerate(text):
        if string:
            if escaped:
                escaped = False
            elif c == "\\":
                escaped = True
            elif c == '"':
                string = False
        elif c == '"':
            string = True
        elif c in "{[":
            closers.append("}" if c == "{" else "]")
        elif c in "}]":
            if not closers or closers.pop() != c:
                return None
            safe, kept = i + 1, list(closers)
            if not closers:
                break
        elif c == "," and closers:
            safe, kept = i, list(closers)
    cut = text[:safe] if safe else text
    for candidate in (cut + "".join(reversed(kept)), text + '"' * string + "".join(reversed(closers))):
        fixed = re.sub(r",(\s*[}\]])", r"\1", candidate)
        try:
            json.loads(fixed)
            return fixed
        except ValueError:
            continue
    return None


def salvage_column(c: Column) -> Column:
    return F.pandas_udf(lambda s: s.map(salvage), "string")(c)


def looks_cut(c: Column) -> Column:
    """Opening brackets without their closing ones."""
    n = lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    return (n("{") > n("}")) | (n("[") > n("]"))


def expanded(payload: Column, fields: list[str]) -> Column:
    """array of struct<key, value, raw_value, status> from a JSON object whose fields are full or compact objects, or bare
    values. Unknown fields are left out, missing ones are filled with status missing."""
    rows = []
    for f in fields:
        at = lambda *names: F.coalesce(*(F.get_json_object(payload, f"$.{f}.{n}") for n in names))  # noqa: B023, E731
        whole = F.get_json_object(payload, f"$.{f}")
        bare = F.when(~whole.startswith("{"), whole)
        value = F.coalesce(at("value", "v"), bare)
        raw = F.coalesce(at("raw_value", "raw"), value)
        status = F.lower(at("status", "s"))
        known = F.lit(None).cast("string")
        for alias, name in STATUS.items():
            known = F.when(status == alias, name).otherwise(known)
        final = F.when(value.isNull(), "missing").otherwise(F.coalesce(known, F.lit("valid")))
        rows.append(F.struct(F.lit(f).alias("key"), value.alias("value"), raw.alias("raw_value"), final.alias("status")))
    return F.array(*rows)


def coerced(value: Column, kind: str) -> Column:
    """struct<value, status>: a value that does not read as its type becomes null and is to be reviewed; the raw text stays
    with the caller."""
    text = F.trim(value)
    out = {"number": typed_number(text).cast("string"), "boolean": F.when(F.lower(text).isin("true", "false"), F.lower(text)), "date": F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text)}.get(kind, value)
    return F.struct(out.alias("value"), F.when(value.isNull(), "missing").when(out.isNull(), "needs_review").otherwise("valid").alias("status"))


def grounded(quote: str | None, text: str | None) -> str | None:
    """The slice of ``text`` that a quote stands for: white space, punctuation and width may differ."""
    if not quote or not text:
        return None
    if quote in text:
        return quote
    tight, places = [], []
    for i, c in enumerate(text):
        for n in unicodedata.normalize("NFKC", c):
            if n.isalnum():
                tight.append(n.lower())
                places.append(i)
    wanted = "".join(c.lower() for c in unicodedata.normalize("NFKC", quote) if c.isalnum())
    at = "".join(tight).find(wanted) if wanted else -1
    return text[places[at] : places[at + len(wanted) - 1] + 1] if at >= 0 else None


def grounded_column(quote: Column, text: Column, near: Column | None = None) -> Column:
    """``grounded`` as a column. A quote that stands as it is, or with other white space, punctuation or case, is found by
    expressions; only what is left and not ASCII, where width may differ, is asked of Python.

    A text may hold the words of a quote several times. Where it is known where the quote was taken from (``near``, from 1), what
    stands there or first behind it is the slice; else, or if there is none, the first one of the whole text."""
    letters = F.regexp_extract_all(quote, F.lit(r"([\p{L}\p{N}])"), F.lit(1))
    shape = F.concat(F.lit("(?iu)"), F.array_join(letters, r"[^\p{L}\p{N}]*"))
    found = lambda own: F.nullif(F.regexp_substr(own, shape), F.lit(""))
    loose = F.when(F.size(letters) > 0, found(text))
    quick = F.when((quote == "") | (text == ""), F.lit(None)).when(F.contains(text, quote), quote).otherwise(loose)
    if near is not None:
        behind = F.when((F.size(letters) > 0) & (near > 0), found(F.substr(text, near)))
        quick = F.coalesce(behind, quick)
    rest = quick.isNull() & (quote.rlike(r"[^\x00-\x7F]") | text.rlike(r"[^\x00-\x7F]"))
    slow = F.pandas_udf(lambda q, t: pd.Series([grounded(a, b) for a, b in zip(q, t, strict=True)], dtype=object), "string")
    return F.coalesce(quick, slow(F.when(rest, quote), F.when(rest, text)))


def candidate(text: Column, identifier: str, measure: str, descriptive: str) -> Column:
    """Segments worth asking about: an identifier, or a measurement and a descriptive word."""
    return F.coalesce(text.rlike(identifier) | (text.rlike(measure) & text.rlike(descriptive)), F.lit(False))


def eligible(pages: DataFrame) -> DataFrame:
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return pages.filter((F.col("status") == "ready") & no("needs_ocr") & no("discovery_only") & no("reference_index") & F.coalesce(F.col("semantic_text_source"), F.lit(True)))


def packed_segments(segments: DataFrame, most_chars: int = 1600, most_records: int = 10, overlap: int = 160) -> DataFrame:
    """document_id, page, chunk, text: segments of a page packed in order under both limits, each chunk after the first led
    by the end of the one before. A segment above the limit is halved until it fits."""

    def halves(text: str) -> list[str]:
        if len(text) <= most_chars:
            return [text]
        mid = len(text) // 2
        cut = max(text.rfind(x, most_chars // 4, mid) for x in ("\n", "。", ". ", " ")) + 1 or mid
        return halves(text[:cut]) + halves(text[cut:])

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        chunks: list[str] = []
        now, count = "", 0
        for text in (part for t in pdf.sort_values("ord", kind="stable")["text"] for part in halves(t or "")):
            if now and (len(now) + 1 + len(text) > most_chars or count >= most_records):
                chunks.append(now)
                now, count = now[-overlap:] if overlap and overlap + 1 + len(text) <= most_chars else "", 0
            now, count = f"{now}\n{text}" if now else text, count + 1
        if now:
            chunks.append(now)
        first = pdf.iloc[0]
        return pd.DataFrame({"document_id": [first["document_id"]] * len(chunks), "page": [first["page"]] * len(chunks), "chunk": range(len(chunks)), "text": chunks})

    return segments.groupBy("document_id", "page").applyInPandas(pack, "document_id string, page int, chunk int, text string")


def identity_key(artifact: Column, figure: Column, figure_item: Column, plate: Column, plate_item: Column, record: Column) -> Column:
    """What makes two partial records one: the artifact, else a figure item, else a plate item, else the record itself."""
    some = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    return F.coalesce(F.when(some(artifact), F.concat(F.lit("id:"), artifact)), F.when(some(figure) & some(figure_item), F.concat_ws(":", F.lit("figure"), figure, figure_item)), F.when(some(plate) & some(plate_item), F.concat_ws(":", F.lit("plate"), plate, plate_item)), F.concat(F.lit("record:"), record))


def merged_fields(rows: DataFrame) -> DataFrame:
    """Per (identity, key) the selected value, all distinct values and whether they conflict. ``rows``: identity, key, value,
    grounded, evidence_count, locator_count. The best candidate is grounded, has more evidence and locators, and is longer."""
    each = rows.filter("value IS NOT NULL AND value <> ''").groupBy("identity", "key", "value").agg(F.max("grounded").alias("grounded"), F.sum("evidence_count").alias("evidence"), F.sum("locator_count").alias("locators"))
    rank = F.struct("grounded", "evidence", "locators", F.length("value").alias("n"), "value")
    out = each.groupBy("identity", "key").agg(F.max_by("value", rank).alias("value"), F.array_sort(F.collect_set("value")).alias("candidates"))
    return out.withColumn("status", F.when(F.size("candidates") > 1, "needs_review").otherwise("valid"))


def link_hints(figure: Column, figure_item: Column, plate: Column, plate_item: Column, site: Column, sequence: Column) -> Column:
    """Strings that may name a record's pictures: the composed id, and number and item joined in three ways."""
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    joined = lambda a, b: [F.when(some(a).isNotNull() & some(b).isNotNull(), F.concat(a, F.lit(s), b)) for s in ("-", ":", " ")]
    return F.array_distinct(F.array_compact(F.array(F.when(some(site).isNotNull() & some(sequence).isNotNull(), F.concat_ws(":", site, sequence)), some(figure), some(plate), *joined(figure, figure_item), *joined(plate, plate_item))))


Model = Callable[[list[str]], list[str]]


def text_length_model(prompts: list[str]) -> list[str]:
    """Stands in for a model: its answer depends on the prompt alone."""
    return [json.dumps({"chars": len(p), "words": len(p.split())}) for p in prompts]


def ask(rows: DataFrame, key: str, prompt: str, model: Model = text_length_model, batch: int = 8) -> DataFrame:
    """key, answer of a model asked in batches; a batch that does not answer every prompt is an error, never a gap."""
    kind = dict(rows.dtypes)[key]

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            answers: list[str] = []
            for a in range(0, len(pdf), batch):
                own = pdf[prompt].iloc[a : a + batch].fillna("").tolist()
                got = model(own)
                if len(got) != len(own):
                    raise ValueError(f"{len(own)} prompts, {len(got)} answers")
                answers += got
            yield pd.DataFrame({key: pdf[key], "answer": answers})

    return rows.select(key, prompt).mapInPandas(each, f"`{key}` {kind}, answer string")
