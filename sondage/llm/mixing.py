"""Mixing sources to target weights by a low-discrepancy schedule.

Every source is a stream of its documents in shuffled (hashed) order, cut into blocks of equal numbers of words. Slot s of
the mix goes to the source in whose share of the unit interval the s-th van der Corput point falls, so every stretch of
the mix, however short, is close to the target weights. The n-th slot of a source takes its n-th block. The number of a
slot within its source follows from the digits of s alone, so slots are neither sorted nor gathered.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sondage.llm._io import Scratch

BITS = 40
#: Up to so many sources their plan is sent to all tasks; it is a row of a few numbers each.
FEW_SOURCES = 10_000
WORD = "[^\\x20\\x09-\\x0D]+"
_WORD = re.compile(WORD)
_REVERSED = np.array([int(f"{i:08b}"[::-1], 2) for i in range(256)], dtype=np.int64)


def van_der_corput(s: np.ndarray) -> np.ndarray:
    """The bits of s (below 2**40) in reverse: the s-th point, in units of 2**-40."""
    out = np.zeros_like(s)
    for k in range(BITS // 8):
        out |= _REVERSED[s >> 8 * k & 255] << BITS - 8 - 8 * k
    return out


def points_below(s: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many of the first s points lie below ``limit``.

    The first s numbers fall into one aligned run of 2**b numbers for each bit b of s. The points of a run are an even
    grid, shifted by the reversed upper bits.
    """
    total = np.zeros_like(s)
    for b in range(BITS):
        has = s >> b & 1
        if has.any():
            shift = van_der_corput(s >> b + 1 << b + 1)
            step = 1 << BITS - b
            total += has * np.clip(-((shift - limit) // step), 0, 1 << b)
    return total


def targets(sizes: list[int], weights: tuple[int, ...], share: tuple[int, int], most: int) -> list[float]:
    """Target of each source, in order: ``share`` (a fraction) of all sizes by repeating ``weights``; what exceeds
    ``most`` times a size is shared again by weight until nothing does. Exact until the last division."""
    num, den = share
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    rest, open_, out = sum(sizes) * num, set(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(w[i] for i in open_)
        over = {i for i in open_ if rest * w[i] > most * sizes[i] * den * total}
        if not over:
            for i in open_:
                out[i] = rest / float(den) * w[i] / total
            break
        for i in over:
            out[i] = float(most * sizes[i])
        rest -= sum(most * sizes[i] * den for i in over)
        open_ -= over
    return out


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """doc_id, source, size in words, and h, the place in the shuffled stream of the source."""
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(f":{seed}")))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col), F.lit("")).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.alias("h"))


def streamed(rows: DataFrame) -> DataFrame:
    """Adds ``at``: words of the source's stream before the document. A source is summed by 4096 slices of the hash, so no
    source, however large, is gathered in one task."""
    rows = rows.withColumn("slice", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    key = ["no_source", "source", "slice"]
    sums = rows.groupBy(*key).agg(F.sum("size").alias("n"))
    before = sums.select(*key, F.coalesce(F.sum("n").over(Window.partitionBy("no_source", "source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("size").over(Window.partitionBy(*key).orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("within", within).join(before, key).withColumn("at", F.col("before") + F.col("within")).drop("slice", "within", "before")


class Schedule:
    """The plan of a mix. It holds one entry per source; sources are a label with a closed list of values.

    ``sources``: (no_source, source, size) in weighing order.
    """

    def __init__(self, sources: list[tuple[bool, str, int]], *, weights=(5, 2, 1), share=(3, 2), most: int = 2, block: int = 128):
        self.sources, self.block = sources, block
        self.target = targets([s[2] for s in sources], tuple(weights), share, most)
        self.quota = [int(t) for t in self.target]  # whole words
        self.blocks = np.array([-(-q // block) for q in self.quota], dtype=np.int64)
        total = sum(self.target)
        edges = np.cumsum([0.0, *self.target]) / total if total else np.zeros(len(sources) + 1)
        self.edges = (edges * float(1 << BITS)).astype(np.int64)
        if total:
            self.edges[-1] = 1 << BITS
        self.slots = int(self.blocks.sum())

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(bool(n), s, i, size, t, q) for i, ((n, s, size), t, q) in enumerate(zip(self.sources, self.target, self.quota, strict=True))]
        return spark.createDataFrame(rows, "no_source boolean, source string, src int, source_size long, target double, quota long")

    def slot_table(self, spark: SparkSession) -> DataFrame:
        """slot, src, block: which block of which source each slot takes.

        Points beyond a source's quota of blocks are skipped; the few blocks that its points do not reach are appended.
        """
        edges, blocks = self.edges, self.blocks

        def deal(batches):
            for batch in batches:
                s = batch.column(0).to_numpy()
                src = np.searchsorted(edges, van_der_corput(s), side="right") - 1
                n = points_below(s, edges[src + 1]) - points_below(s, edges[src])
                keep = n < blocks[src]
                yield pa.RecordBatch.from_arrays([pa.array(s[keep]), pa.array(src[keep].astype(np.int32)), pa.array(n[keep])], names=["slot", "src", "block"])

        dealt = spark.range(self.slots).mapInArrow(deal, "slot long, src int, block long")
        ends = np.full(len(blocks), self.slots, dtype=np.int64)
        got = points_below(ends, edges[1:]) - points_below(ends, edges[:-1]) if len(blocks) else blocks
        missing = [(int(i), int(got[i]), int(blocks[i]) - 1) for i in np.flatnonzero(got < blocks)]
        if not missing:
            return dealt
        more = spark.createDataFrame(missing, "src int, a long, b long").select(F.col("src"), F.explode(F.sequence("a", "b")).alias("block"))
        return dealt.unionByName(more.select((F.lit(self.slots) + F.col("block")).alias("slot"), "src", "block"))


def spans(rows: DataFrame, block: int) -> DataFrame:
    """src, block, doc_id, at, size, copy, first, last: the words [first, last) of a document that fall into each block of
    its source's stream, which runs on into further copies of itself. ``rows`` needs src, source_size, quota, at, size."""
    copies = F.floor((F.col("quota") - F.col("at") + F.col("source_size") - 1) / F.col("source_size"))
    each = rows.filter((F.col("size") > 0) & (F.col("at") < F.col("quota"))).withColumn("copy", F.explode(F.sequence(F.lit(0), copies.cast("int") - 1)))
    each = each.withColumn("a", F.col("at") + F.col("copy") * F.col("source_size")).withColumn("b", F.least(F.col("a") + F.col("size"), F.col("quota")))
    cut = each.withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block))))
    first = F.greatest(F.col("a"), F.col("block") * block) - F.col("a")
    last = F.least(F.col("b"), (F.col("block") + 1) * block) - F.col("a")
    return cut.select("src", "block", "doc_id", "at", "size", "copy", first.alias("first"), last.alias("last"))


def plan_mix(docs: DataFrame, scratch: Scratch, *, id_col="doc_id", text_col="text", source_col="source", seed: str = "mix", **options) -> tuple[DataFrame, DataFrame, Schedule]:
    """(documents with src, source_size, target, quota, size, at; slots joined with spans; schedule)."""
    spark = docs.sparkSession
    rows = scratch.table(sized(docs, id_col, text_col, source_col, seed), "sized")
    found = rows.groupBy("no_source", "source").agg(F.sum("size").alias("n")).collect()
    schedule = Schedule(sorted((r["no_source"], r["source"], r["n"]) for r in found), **options)
    known = schedule.frame(spark)
    known = F.broadcast(known) if len(found) <= FEW_SOURCES else known
    placed = scratch.table(streamed(rows).join(known, ["no_source", "source"]), "placed")
    mixed = spans(placed, schedule.block).join(schedule.slot_table(spark), ["src", "block"])
    return placed, mixed, schedule


def taken(docs: DataFrame, **options) -> DataFrame:
    """Per document doc_id, size, source_size, target, taken, source: how many words the mix takes of it, copies counted.

    Null or empty texts have size 0 and are never taken; null sources are one source, after all others; repeated rows are
    documents of their own; an empty table gives no rows. Reruns agree: the order within a source is a hash of the id.
    """
    with Scratch(docs.sparkSession, "mixing") as scratch:
        placed, mixed, _ = plan_mix(docs, scratch, **options)
        words = mixed.groupBy("src", "at").agg(F.sum(F.col("last") - F.col("first")).alias("words"))
        # documents without words share their place with the next one
        out = placed.join(words, ["src", "at"], "left").select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("words", F.lit(0))).otherwise(0).cast("long").alias("taken"), F.when(~F.col("no_source"), F.col("source")).alias("source"))
        return scratch.keep(out)


def word_prefix(text: str, words: int) -> str:
    """The text up to the end of its n-th word."""
    end = next(islice(_WORD.finditer(text), words - 1, None), None) if words > 0 else None
    return text[: end.end()] if end else ""


def mix_documents(docs: DataFrame, *, id_col="doc_id", text_col="text", source_col="source", chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The mixed corpus with the columns of ``docs``, whatever their names: one row per copy taken; a copy of which only the
    first words are taken holds the text up to there. Documents that the mix takes nothing of, null and empty texts among
    them, are absent; an empty table gives no rows. Of rows that repeat id, source and size each is taken as often as one of
    them is in the plan, in the order of their texts' hashes."""
    own = taken(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options)
    names, key = docs.columns, ["id", "no_id", "source", "no_source", "size"]
    named = lambda df, id_, source, size, *more: df.select(F.coalesce(id_.cast("string"), F.lit("")).alias("id"), id_.isNull().alias("no_id"), F.coalesce(source, F.lit("")).alias("source"), source.isNull().alias("no_source"), size.alias("size"), *more).filter("size > 0")
    nth = lambda *order: F.row_number().over(Window.partitionBy(*key).orderBy(*order)).alias("nth")  # noqa: E731  rows of one id, mostly one
    counts = named(own, F.col("doc_id"), F.col("source"), F.col("size"), "taken").select(*key, "taken", nth(F.desc("taken"))).filter("taken > 0")
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = named(docs, F.col(f"`{id_col}`"), F.col(f"`{source_col}`"), size, F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.xxhash64(F.col(f"`{text_col}`")).alias("print"))
    joined = rows.select(*key, "row", nth("print")).join(counts, [*key, "nth"])
    copies = joined.withColumn("copy", F.explode(F.sequence(F.lit(0), F.floor((F.col("taken") - 1) / F.col("size")).cast("int"))))
    words = (F.col("taken") - F.col("copy") * F.col("size")).cast("long")
    rows = copies.select(*(F.col(f"row.`{c}`").alias(c) for c in names), F.when(words < F.col("size"), words).alias(f"words of {len(names)}"))
    at, chars = names.index(text_col), names.index(chars_col) if chars_col in names else None

    def cut(batches):
        for batch in batches:
            columns = batch.columns[: len(names)]
            cuts = {i: n for i, n in enumerate(batch.column(len(names)).to_pylist()) if n is not None}
            if cuts:  # one document per source at most
                texts = columns[at].to_pylist()
                for i, n in cuts.items():
                    texts[i] = word_prefix(texts[i], n)
                columns[at] = pa.array(texts, columns[at].type)
                if chars is not None:
                    sizes = columns[chars].to_pylist()
                    for i in cuts:
                        sizes[i] = len(texts[i])
                    columns[chars] = pa.array(sizes, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(cut, docs.schema)
