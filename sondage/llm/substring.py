"""Substring dedup: repeated lines or paragraphs, and passages that start or end inside them.

Texts are cut into *units*, lines or paragraphs. A unit is normalised (A-Z lower-cased, white space to one space) and
hashed; digests are grouped over all documents; the earliest occurrence, by document id and place, stays, and the others
are removed by their original offsets.

A passage that begins in the middle of one line and ends in the middle of another holds few whole units or none. What such
passages share is found by the same steps over *windows* of ``size`` consecutive words. Digests of all windows would
outweigh the corpus, so a first pass finds where repeats can be: of each window it takes the anchor, the half-size window in
it with the smallest hash. Equal windows have equal anchors. Full windows are hashed only where their anchor occurs twice;
nothing is missed and nothing is taken on a hash of the half.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondage.llm._io import Scratch, bit_filter, runs, slot

#: Bases of two polynomials: a window's digest has 128 bits.
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_REMEMBERED = 100_000
_SPACE = " \t\n\x0b\x0c\r"
#: Parts that the windows of a very common anchor are dealt over.
SALTS = 32
#: Stands for a null id: after every other document.
LAST = (1 << 63) - 1
_known: dict[bytes, int] = {}


def word_hashes(raw: bytes) -> np.ndarray:
    """XXH64 of each word of a text in UTF-8."""
    words = raw.lower().split()
    if len(_known) > _REMEMBERED:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = xxhash.xxh64_intdigest(w)
    return np.fromiter(map(_known.__getitem__, words), dtype=np.uint64, count=len(words))


def windows(h: np.ndarray, size: int, base: np.uint64 = _BASES[0]) -> np.ndarray:
    """A polynomial hash, mixed, of each window of ``size`` words; built by doubling."""
    if len(h) < size:
        return np.zeros(0, dtype=np.uint64)
    out, have, power, span = None, 0, h, 1
    with np.errstate(over="ignore"):
        while span <= size:
            if size & span:
                if out is None:
                    out, have = power, span
                else:  # what is there so far, then a window of ``span`` words behind it
                    n = len(h) - have - span + 1
                    out, have = out[:n] * base + power[have : have + n], have + span
            n = len(power) - span
            power = power[:n] * base + power[span : span + n] if n > 0 else power[:0]
            base, span = base * base, span * 2
        out = out[: len(h) - size + 1]
        out = (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ out >> np.uint64(32)


def anchors(h: np.ndarray, size: int) -> np.ndarray:
    """Per window of ``size`` words the place of its anchor: of the half-size windows in it, the one with the smallest upper half
    of the hash, the first on ties. Equal windows have equal anchors."""
    own, run = windows(h, size // 2), size - size // 2 + 1
    n = len(own) - run + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    # places in the lower half; the least of each run by runs of doubled length
    low, span = own & np.uint64(0xFFFFFFFF00000000) | np.arange(len(own), dtype=np.uint64), 1
    while 2 * span <= run:
        low, span = np.minimum(low[:-span], low[span:]), 2 * span
    return (np.minimum(low[:n], low[run - span : run - span + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


_UNITS = {"line": re.compile(rb"[^\n]+"), "paragraph": re.compile(rb"(?:[^\n]|\n(?![\x20\x09\x0B-\x0D]*\n))+")}


def units_of(raw: bytes, unit: str, least_words: int) -> tuple[list[bytes], list[tuple[int, int]]]:
    """128-bit digests of a text's normalised units of at least ``least_words`` words, and their places in bytes without
    the white space around them."""
    digests, places = [], []
    for m in _UNITS[unit].finditer(raw):
        words = m[0].lower().split()
        if len(words) >= least_words:
            own = m[0].strip()
            begin = m.start() + m[0].index(own)
            digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
            places.append((begin, begin + len(own)))
    return digests, places


def _char_offsets(raw: bytes, begin: np.ndarray) -> np.ndarray:
    """Code points before each byte place."""
    if raw.isascii():
        return begin
    starts = np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)
    return np.r_[0, starts][begin]


def _own(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc and print, which tell documents apart and rank them, and the text: equal rows are one document."""
    text = F.col(f"`{text_col}`")
    return docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("print"), text.alias("text")).filter("text IS NOT NULL")


def _later(units: DataFrame) -> DataFrame:
    """doc, print, start, end, first_doc of the units (k1, k2, doc, print, start, end) that aren't the earliest of their
    digest. Digests are counted per task before they are dealt out, so a unit that most documents have is few rows."""
    first = F.min(F.struct("doc", "print", "start")).alias("first")
    owners = units.groupBy("k1", "k2").agg(first, F.count("*").alias("n")).filter("n > 1").select("k1", "k2", "first")
    return units.join(owners, ["k1", "k2"]).filter("struct(doc, print, start) <> first").select("doc", "print", "start", "end", F.col("first.doc").alias("first_doc"))


def repeated_units(own: DataFrame, scratch: Scratch, unit: str, least_words: int) -> DataFrame:
    """The repeated lines or paragraphs."""

    def cut(batches):
        for batch in batches:
            docs, prints = (batch.column(c).to_numpy() for c in (0, 1))
            for a, b in runs(batch.column(2)):
                digests, places, sizes = [], [], []
                for text in batch.column(2).slice(a, b - a).to_pylist():
                    raw = text.encode("utf-8", "surrogatepass")
                    found, where = units_of(raw, unit, least_words)
                    digests += found
                    sizes.append(len(found))
                    if found:
                        places.append(_char_offsets(raw, np.asarray(where, dtype=np.int64)))
                if digests:
                    k = np.frombuffer(b"".join(digests), dtype="<i8").reshape(-1, 2)
                    at = np.concatenate(places)
                    columns = (k[:, 0].copy(), k[:, 1].copy(), np.repeat(docs[a:b], sizes), np.repeat(prints[a:b], sizes), at[:, 0].copy(), at[:, 1].copy())
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=_UNIT_NAMES)

    units = scratch.table(own.mapInArrow(cut, _UNIT_SCHEMA), "line-units")
    return _later(units).distinct()  # equal rows say the same


_UNIT_SCHEMA = "k1 long, k2 long, doc long, print long, start long, end long"
_UNIT_NAMES = ["k1", "k2", "doc", "print", "start", "end"]


def word_spots(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where each word of a text begins and ends, in bytes."""
    edge = np.diff(_IS_SPACE[np.frombuffer(raw, dtype=np.uint8)], prepend=1, append=1)
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32]).astype(np.int8)


def repeated_windows(own: DataFrame, scratch: Scratch, size: int, common: int = 1000) -> DataFrame:
    """The repeated windows of ``size`` words.

    ``who`` is a hash that says which text a mark is of; texts that share it only have more places looked at. Windows meet in one
    shuffle, in which each is held against the first of its digest by a running window. Those of very common anchors are dealt
    by document as well, so no digest is one task's, and only the firsts of these parts meet again; equal windows have equal
    anchors, so a digest is dealt in one way.
    """
    own = own.withColumn("who", F.xxhash64("doc", "print"))

    def first_pass(batches):
        for batch in batches:
            who, texts = batch.column(0).to_numpy(), batch.column(1)
            for a, b in runs(texts):
                found, places, sizes = [], [], []
                for text in texts.slice(a, b - a).to_pylist():
                    h = word_hashes(text.encode("utf-8", "surrogatepass"))
                    p = np.unique(anchors(h, size))
                    sizes.append(len(p))
                    found.append(windows(h, size // 2)[p].view(np.int64) if len(p) else p)
                    places.append(p.astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(found), np.repeat(who[a:b], sizes), np.concatenate(places))], names=["h", "who", "place"])

    marks = scratch.table(own.select("who", "text").mapInArrow(first_pass, "h long, who long, place int"), "marks")
    partitions = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    common = max(common, marks.count() // (8 * partitions)) if common else 0  # the rows of an eighth of a partition
    # later copies of a whole text: a span each, if the text is long enough to have a mark; their windows needn't be looked at
    text, bound = F.col("text"), F.lit(_SPACE)
    whole = own.select(F.xxhash64(F.lit(1), text).alias("k1"), F.xxhash64(F.lit(2), text).alias("k2"), "doc", "print", (F.length(text) - F.length(F.ltrim(text, bound))).cast("long").alias("start"), F.length(F.rtrim(text, bound)).cast("long").alias("end"))
    copies = _later(whole).distinct().withColumn("who", F.xxhash64("doc", "print"))
    copies = scratch.table(copies.join(marks.select("who").distinct(), "who", "left_semi").drop("first_doc"), "copies")
    twice = marks.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h", (F.col("n") > common).alias("hot"))
    # a place below zero is that of a very common anchor
    where = scratch.table(marks.join(twice, "h").groupBy("who").agg(F.collect_set(F.when(F.col("hot"), -1 - F.col("place")).otherwise(F.col("place"))).alias("places")).join(copies.groupBy("who").agg(F.collect_set(F.struct("doc", "print")).alias("gone")), "who", "left"), "where")
    scratch.drop("marks")
    held = own.sparkSession.sparkContext.broadcast(bit_filter(where.select("who")))  # 4 MB: most texts have no repeats

    @F.pandas_udf("boolean")
    def met(who):
        own = slot(who.to_numpy())
        return type(who)(np.frombuffer(held.value, dtype=np.uint8)[own >> 3] >> (7 - (own & 7)) & 1 > 0)

    def second_pass(batches):
        for batch in batches:
            docs, prints = (batch.column(c).to_numpy() for c in (0, 1))
            for a, b in runs(batch.column(2), 1 << 18):
                for i, text, places in zip(range(a, b), batch.column(2).slice(a, b - a).to_pylist(), batch.column(3).slice(a, b - a), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    h = word_hashes(raw)
                    at = anchors(h, size)
                    known = places.values.to_numpy()
                    mark = np.zeros(len(h) + 1, dtype=np.int8)  # of each place: no repeat, a repeat, a very common one
                    mark[np.minimum(known[known >= 0], len(h))] = 1
                    mark[np.minimum(-1 - known[known < 0], len(h))] = 2
                    kind = mark[at]
                    s = np.flatnonzero(kind)  # only these can be repeated
                    if not len(s):
                        continue
                    begin, stop = word_spots(raw)
                    start, end = _char_offsets(raw, begin[s]), _char_offsets(raw, stop[s + size - 1])
                    salt = np.where(kind[s] == 2, 1 + (docs[i] ^ prints[i]) % SALTS, 0).astype(np.int32)
                    keys = [windows(h, size, base)[s].view(np.int64) for base in _BASES]
                    for a_ in range(0, len(s), 1 << 14):
                        part = slice(a_, min(a_ + (1 << 14), len(s)))
                        n = part.stop - a_
                        columns = (*(k[part] for k in keys), np.full(n, docs[i]), np.full(n, prints[i]), start[part], end[part], salt[part])
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*_UNIT_NAMES, "salt"])

    texts = own.filter(met("who")).join(where, "who").filter("gone IS NULL OR NOT array_contains(gone, struct(doc, print))").select("doc", "print", "text", "places")
    units = texts.mapInArrow(second_pass, _UNIT_SCHEMA + ", salt int")
    running = Window.partitionBy("k1", "k2", "salt").orderBy("doc", "print", "start").rowsBetween(Window.unboundedPreceding, 0)
    me = F.struct("doc", "print", "start")
    later, own = me != F.first(me).over(running), ["doc", "print", "start", "end"]  # the first of all is no later copy
    # what is first in its part of a common digest is judged again among the firsts of all parts, a few per digest
    open_ = F.when(~F.col("later"), F.struct("k1", "k2")).alias("open")
    judged = scratch.table(units.withColumn("later", later).filter("later OR salt > 0").select(*own, open_), "judged")
    firsts = judged.filter("open IS NOT NULL").select(*own, "open.k1", "open.k2")
    among = Window.partitionBy("k1", "k2").orderBy("doc", "print", "start").rowsBetween(Window.unboundedPreceding, 0)
    rest = firsts.withColumn("later", me != F.first(me).over(among)).filter("later").select(*own)
    return judged.filter("open IS NULL").select(*own).unionByName(rest).unionByName(copies.select(*own))


def _united(batches):
    """Windows of one document that overlap or touch as one span; rows come sorted, so ends rise with starts."""
    held = None  # the span that the next batch may go on with
    for batch in batches:
        columns = [batch.column(c).to_numpy() for c in range(4)]
        if held is not None:
            columns = [np.concatenate([[h], c]) for h, c in zip(held, columns, strict=True)]
        doc, print_, start, end = columns
        if not len(doc):
            continue
        begins = np.r_[0, np.flatnonzero((doc[1:] != doc[:-1]) | (print_[1:] != print_[:-1]) | (start[1:] > end[:-1])) + 1]
        stops = end[np.r_[begins[1:], len(doc)] - 1]
        held = (doc[begins[-1]], print_[begins[-1]], start[begins[-1]], stops[-1])
        if len(begins) > 1:
            own = begins[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[own], print_[own], start[own], stops[:-1])], names=["doc", "print", "start", "end"])
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in held], names=["doc", "print", "start", "end"])


def repeated_passages(docs: DataFrame, *, unit: str = "line", least_words: int = 10, size: int = 50, common: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, print, start, end, first_doc, unit: the spans (code points, end excluded) to remove so that every unit of at
    least ``least_words`` words, and every run of ``size`` words, stays only where it occurs first; first_doc is the document
    of a unit's first occurrence (null for spans of windows, which may have several).

    ``unit`` says of a row whether it is a line (or paragraph), a row each, or a ``window``: windows that overlap or touch are
    one row. The two kinds may overlap; ``remove_spans`` unites them. Documents without repeats have no row. Null and empty
    texts have no units. ``common`` says from how many occurrences on windows are dealt by document too, which changes no
    result. Rows equal in id and text are one document and have its spans once; rows that repeat an id with other
    texts are documents of their own, ranked by ``print``, a hash of the text; null ids rank after all others; an empty table
    gives no rows; other columns are not read.
    """
    with Scratch(docs.sparkSession, "substring") as scratch:
        own = _own(docs, id_col, text_col)
        lines = repeated_units(own, scratch, unit, least_words).select("doc", "print", "start", "end", "first_doc", F.lit(unit).alias("unit"))
        lost = repeated_windows(own, scratch, size, common)
        spans = lost.repartition("doc", "print").sortWithinPartitions("doc", "print", "start").mapInArrow(_united, "doc long, print long, start long, end long")
        null = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias("doc_id" if c == "doc" else c)
        return scratch.keep(lines.unionByName(spans.withColumns({"first_doc": F.lit(None).cast("long"), "unit": F.lit("window")})).select(null("doc"), "print", "start", "end", null("first_doc"), "unit"))


def remove_spans(docs: DataFrame, spans: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the spans of ``repeated_passages`` cut out of the text, and ``removed``: their original offsets, united
    where they overlap or touch (null where there are none). A column named removed is replaced; others may have any name."""
    docs = docs.drop("removed")
    names = docs.columns
    sorted_ = F.array_sort(F.collect_list(F.struct("start", "end")))
    # (spans so far, the open span) over sorted spans
    one = F.aggregate(
        sorted_,
        F.array().cast("array<struct<start:bigint,end:bigint>>"),
        lambda out, x: F.when((F.size(out) > 0) & (F.element_at(out, -1)["end"] >= x["start"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(out, F.array(x))),
    )
    by_doc = spans.groupBy(F.col("doc_id").alias("id"), "print").agg(one.alias("removed"))
    text = F.col(f"row.`{text_col}`")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("own_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("own_print"))
    joined = rows.join(by_doc, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_print") == F.col("print")), "left")
    # pieces between the spans: from each end (first 0) to the next start (last the whole text)
    starts = F.concat(F.transform("removed", lambda s: s["start"]), F.array(F.length(text).cast("long")))
    ends = F.concat(F.array(F.lit(0).cast("long")), F.transform("removed", lambda s: s["end"]))
    pieces = F.transform(F.arrays_zip(ends.alias("a"), starts.alias("b")), lambda z: F.substring(text, z["a"].cast("int") + 1, (z["b"] - z["a"]).cast("int")))
    cut = F.when(F.col("removed").isNull(), text).otherwise(F.array_join(pieces, ""))
    return joined.select(*(cut.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in names), "removed")
