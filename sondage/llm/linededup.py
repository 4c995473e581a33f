"""Line dedup over levelled sorted runs of line hashes.

Batches come in ascending document order. The index holds *runs*: tables of distinct 128-bit line hashes, bucketed and
sorted by the whole hash. A batch's distinct hashes are dealt once into the same buckets and anti-joined with every run,
bucket by bucket, so no run is shuffled; hashes that no run has become a new run of level 0. ``fan_out`` runs of one level
are compacted into one of the next, bucket by bucket too, so the number of runs grows with the logarithm of the number of
batches.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sondage.llm._io import Scratch, runs

SPACE = b" \t\n\x0b\x0c\r"
#: Stands for a null id: after every other document.
LAST = (1 << 63) - 1


def keys_of(text: str | None, least: int) -> list[bytes | None]:
    """The hash of each line's key, None for keys of fewer than ``least`` code points."""
    out = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(SPACE).lower()  # bytes: only A-Z
        long = len(key) >= 4 * least or len(key) >= least and len(key.decode("utf-8", "surrogatepass")) >= least
        out.append(xxhash.xxh3_128_digest(key) if long else None)
    return out


def _who(doc_id: Column, text: Column) -> list[Column]:
    """doc and print: a row's rank, and a print of its text."""
    return [F.coalesce(doc_id.cast("long"), F.lit(LAST)).alias("doc"), F.xxhash64(text).alias("print")]


def line_table(docs: DataFrame, cuts: list[int], least: int) -> DataFrame:
    """doc, print, k1, k2, batch: the distinct keys of each text; batch b holds the ids above b of the ``cuts``."""
    cuts_ = np.asarray(cuts, dtype=np.int64)

    def split(batches):
        for batch in batches:
            ids, prints = (batch.column(c).to_numpy() for c in (0, 1))
            texts = batch.column(2)
            for a, b in runs(texts):
                keys, sizes = [], []
                for text in texts.slice(a, b - a).to_pylist():
                    own = set(keys_of(text, least))
                    own.discard(None)
                    keys += own
                    sizes.append(len(own))
                k = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
                doc = np.repeat(ids[a:b], sizes)
                yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(np.repeat(prints[a:b], sizes)), pa.array(k[:, 0].copy()), pa.array(k[:, 1].copy()), pa.array(np.searchsorted(cuts_, doc, side="left").astype(np.int32))], names=["doc", "print", "k1", "k2", "batch"])

    return docs.mapInArrow(split, "doc long, print long, k1 long, k2 long, batch int")


class LineIndex:
    """The levelled runs. Tables lie in the shared folder and go with the scratch folder."""

    def __init__(self, scratch: Scratch, fan_out: int = 2):
        self.scratch, self.fan_out = scratch, fan_out
        self.spark = scratch.spark
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.kept: list[str] = []

    def write(self, keys: DataFrame) -> str:
        """A bucketed, sorted table of what already lies in the index's buckets, or is dealt into them."""
        name = f"line_run_{uuid.uuid4().hex}"
        keys.write.bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").option("path", self.scratch.path(name)).option("compression", "zstd").saveAsTable(name)
        self.kept.append(name)
        return name

    def dealt(self, keys: DataFrame) -> DataFrame:
        """``keys`` in the index's buckets: one shuffle, of rows that partial aggregation has made distinct per task."""
        return keys.repartition(self.buckets, "k1", "k2")

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def mark(self, keys: DataFrame) -> DataFrame:
        """``keys``, dealt into the index's buckets, with ``seen``: whether a run has the hash. Runs share no hash, so at
        most one does."""
        hits = []
        for i, run in enumerate(self.runs()):
            hits.append(f"hit{i}")
            keys = keys.join(run.withColumn(hits[-1], F.lit(True)).hint("merge"), ["k1", "k2"], "left")
        return keys.withColumn("seen", F.coalesce(*map(F.col, hits), F.lit(False)) if hits else F.lit(False)).drop(*hits)

    def add(self, keys: DataFrame) -> None:
        """Adds hashes that no run has and that lie in the index's buckets."""
        level, name = 0, self.write(keys.select("k1", "k2"))
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(name)
            if len(self.levels[level]) < self.fan_out:
                return
            old, self.levels[level] = self.levels[level], []
            name = self.write(self.merged(old))
            for x in old:
                self.forget(x)
            level += 1

    def merged(self, names: list[str]) -> DataFrame:
        """The hashes of several runs, which share none: a merge of sorted buckets, without a shuffle."""
        join = lambda a, b: a.join(self.spark.table(b).hint("merge"), ["k1", "k2"], "full")
        return reduce(join, names[1:], self.spark.table(names[0]))

    def forget(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop(name)
        self.kept.remove(name)

    def close(self) -> None:
        for name in list(self.kept):
            self.forget(name)


def dropped_keys(docs: DataFrame, scratch: Scratch, *, least: int = 10, batches: int = 4, fan_out: int = 2) -> DataFrame:
    """doc, print, k1, k2: the keys whose lines a text loses, as its document isn't the first that holds them."""
    docs = docs.select(*_who(F.col("doc_id"), F.col("text")), "text")
    shares = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx("doc", shares, 1000)).first()[0] if shares else None  # a bounded sketch
    lines = scratch.table(line_table(docs, sorted(cuts or []), least), "lines", partition_by="batch")
    index, out = LineIndex(scratch, fan_out), []
    try:
        for b in range(batches):
            own = lines.filter(F.col("batch") == b).drop("batch")
            # per task first: a line that every document has is one row of each task
            first = own.groupBy("k1", "k2").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"))
            name = index.write(index.mark(index.dealt(first)))
            marks = index.spark.table(name)
            if b + 1 < batches:
                index.add(marks.filter(~F.col("seen")))
            # as plain files, not buckets: a line that most documents have is then a skewed join, which adaptive execution splits
            plain = index.spark.read.schema(marks.schema).parquet(scratch.path(name))
            twice = plain.filter(F.col("seen") | (F.col("owner") < F.col("last"))).select("k1", "k2", "seen", "owner")
            lost = own.join(twice, ["k1", "k2"]).filter(F.col("seen") | (F.col("doc") != F.col("owner"))).select("doc", "print", "k1", "k2")
            out.append(scratch.table(lost, f"lost-{b}"))
            index.forget(name)
    finally:
        index.close()
    return reduce(DataFrame.unionByName, out)


def dedup_lines(docs: DataFrame, *, least: int = 10, batches: int = 4, fan_out: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` with the kept text, and n_lines, n_dropped, kept_sha256.

    A line goes if another document with a smaller id holds its key: the line without white space at its ends and with
    A-Z lower-cased, if that has at least ``least`` code points. Null or empty text is one empty line and comes back as an
    empty text; rows that repeat an id count as one document; a null id counts as the largest; columns with the names of
    results are replaced, and all others, whatever their names, come back as they were; an empty table gives no rows.
    """
    docs = docs.drop("n_lines", "n_dropped", "kept_sha256")
    spark, names = docs.sparkSession, docs.columns
    with Scratch(spark, "lines") as scratch:
        lost = dropped_keys(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), scratch, least=least, batches=batches, fan_out=fan_out)
        # at most the lines of one text: the many rows without an id are told apart by it
        by_text = scratch.keep(lost.groupBy("doc", "print").agg(F.collect_set(F.struct("k1", "k2")).alias("lost")))
    # the row as one struct, so that no name of the input can clash
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), *_who(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")))
    joined = rows.join(by_text, ["doc", "print"], "left").select("row", "lost")
    at = names.index(text_col)

    def rewrite(batches_):
        for batch in batches_:
            row, lost_ = batch.column(0), batch.column(1)
            columns = [row.field(i) for i in range(len(names))]
            for a, b in runs(columns[at]):
                kept, lines_, dropped, digests = [], [], [], []
                for text, gone in zip(columns[at].slice(a, b - a).to_pylist(), lost_.slice(a, b - a), strict=True):
                    lines = left = (text or "").split("\n")
                    if gone.is_valid and len(gone):
                        gone = set(np.stack([gone.values.field(i).to_numpy() for i in (0, 1)], axis=1).astype("<i8").view("V16").ravel().tolist())
                        left = [line for line, key in zip(lines, keys_of(text, least), strict=True) if key not in gone]
                    kept.append("\n".join(left))
                    lines_.append(len(lines))
                    dropped.append(len(lines) - len(left))
                    digests.append(hashlib.sha256(kept[-1].encode("utf-8", "surrogatepass")).hexdigest())
                part = [c.slice(a, b - a) if i != at else pa.array(kept, pa.string()) for i, c in enumerate(columns)]
                yield pa.RecordBatch.from_arrays([*part, pa.array(lines_, pa.int64()), pa.array(dropped, pa.int64()), pa.array(digests, pa.string())], names=[*names, "n_lines", "n_dropped", "kept_sha256"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.mapInArrow(rewrite, f"{fields}, n_lines long, n_dropped long, kept_sha256 string")

