"""Near copies by SimHash, and by shingle similarity what its radius does not reach.

First come the links of operator 6: texts whose fingerprints differ in at most 4 bits. Such a ball holds only copies far above
similarity 0.9, and one of 16 bits has too many variants to list. So texts that these links leave apart are joined further:
banded fingerprints propose pairs, the shingle sets of both texts decide. For that a text has ``bands`` fingerprints, each over the least values of ``rows`` orders of its shingles;
two texts of similarity s share one with probability 1 - (1 - s**rows)**bands, 0.9996 at 0.8. Every pair that shares a
fingerprint and is not already tied by SimHash or verified links is verified on the whole shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm import simhash
from sondage.llm._io import Scratch
from sondage.llm.components import components

_HASH = xxhash.xxh64_intdigest
#: Parts that the pairs of one text are dealt over, so that the first of a large group is no hot key.
SALTS = 64


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def node_of(parts: list[bytes], seed: int = 42) -> int:
    """One number for all texts of equal words, as a signed long."""
    return int(np.uint64(_HASH(b" ".join(parts), seed)).view(np.int64))


def shingles_of(parts: list[bytes], words: int = 5, seed: int = 42) -> np.ndarray:
    """The distinct hashes of a text's shingles in order; a text of fewer words is one shingle, none has none."""
    if len(parts) <= words:
        return np.asarray([_HASH(b" ".join(parts), seed)] if parts else [], dtype=np.uint64)
    line = b" ".join(parts)
    end = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    first, last = [0, *(end[:-words] + 1).tolist()], end[words - 1 :].tolist()
    return np.unique(np.fromiter([_HASH(line[a:b], seed) for a, b in zip(first, last, strict=True)], dtype=np.uint64, count=len(first)))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared over all, of two sets of distinct shingles."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def banded(shingles: np.ndarray, bands: int, rows: int) -> list[int]:
    """A fingerprint per band, as signed longs; no shingles: none."""
    if not len(shingles):
        return []
    own = np.random.default_rng(17).integers(0, 1 << 63, size=bands * rows, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
    least = np.full(len(own), np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(shingles), 512):  # the rotation mixes upper bits in, which a product alone leaves out of the lower
        x = shingles[a : a + 512, None] * own[None, :]
        least = np.minimum(least, ((x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)).min(0))
    return [int(np.uint64(_HASH(part.tobytes(), i)).view(np.int64)) for i, part in enumerate(least.reshape(bands, rows))]


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """a, b of the ``pairs`` whose sets (node, n, own) are at least ``least`` similar."""
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    left = pairs.select("a", "salt").distinct().join(sets.select(F.col("node").alias("a"), F.col("own").alias("x")), "a")
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("own").alias("y")), "b").join(left, ["a", "salt"]).select("a", "b", "x", "y")

    def check(batches):
        for batch in batches:
            for a in range(0, len(batch), 64):
                part = batch.slice(a, 64)
                near = [similarity(np.frombuffer(p.as_buffer(), dtype=np.uint64), np.frombuffer(q.as_buffer(), dtype=np.uint64)) >= least for p, q in zip(part.column(2), part.column(3), strict=True)]
                yield part.select([0, 1]).filter(pa.array(near, pa.bool_()))

    return both.mapInArrow(check, "a long, b long")


def _links(members: DataFrame, sets: DataFrame, least: float, scratch: Scratch, roots: DataFrame) -> DataFrame:
    """``roots`` (node, root) after more links, which join all texts that verified pairs of ``members`` (key, node, n) join.

    First the members of a fingerprint are held against its first one, twice: the second time those that the first round
    left apart. Large groups of copies are then one component, so the pairs still apart can be listed in full. What roots tie
    already is no pair.
    """
    fits = lambda: F.least("n", "m") >= F.greatest("n", "m") * least - 1e-9
    done = None
    for step in ("first", "second", "rest"):
        own = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        own = scratch.table(own, f"rooted-{step}")
        apart = own.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
        own = scratch.table(own.join(apart.select("key", "lo"), "key"), f"apart-{step}")
        if step == "rest":
            other = own.select("key", F.col("node").alias("b"), F.col("root").alias("other"), F.col("n").alias("m"))
            pairs = own.join(other, "key").filter("node < b AND root <> other").filter(fits()).select(F.col("node").alias("a"), "b")
        else:
            rest = own if step == "first" else own.filter("root <> lo")
            heads = rest.groupBy("key").agg(F.min(F.struct("node", "n", "root")).alias("head")).select("key", F.col("head.node").alias("a"), F.col("head.n").alias("m"), F.col("head.root").alias("other"))
            pairs = own.join(heads, "key").filter("root <> other").filter(fits()).select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b"))
        pairs = pairs.distinct()
        if done is not None:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = scratch.table(pairs, f"pairs-{step}")
        good = scratch.table(_verified(pairs, sets, least), f"good-{step}")
        done = pairs if done is None else done.unionByName(pairs)
        with Scratch(members.sparkSession, "near-roots") as inner:
            roots = scratch.table(_joined(roots, good, inner), f"roots-{step}")
    return roots


def _joined(roots: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root after more links: only what they join is worked through again, as links between the roots there are."""
    root = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    named = links.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    merged = scratch.table(components(scratch.table(named.filter("a <> b").distinct(), "between"), scratch), "merged")
    known = roots.join(merged.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return known.unionByName(merged.join(roots.select("node"), "node", "left_anti").select("node", "root"))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, least: float = 0.8, bands: int = 20, rows: int = 5, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` without near copies: of all texts that SimHash links or pairs of shingle similarity ``least`` or more
    join, the row with the smallest id stays (a null id comes last).

    Texts of equal words, none included, are copies of each other; SimHash links are those of ``simhash`` (four-word shingles, 4
    bits); all other pairs are verified on their shingles.
    """
    spark, names, at = docs.sparkSession, docs.columns, docs.columns.index(text_col)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def mark(batches):
        for batch in batches:
            texts = batch.column(1)
            for a in range(0, len(batch), 256):
                nodes, fps, sizes, prints = [], [], [], []
                for t in texts.slice(a, 256).to_pylist():
                    parts = words_of(t)
                    shingles = shingles_of(parts, words, seed)
                    nodes.append(node_of(parts, seed))
                    fps.append(simhash.fingerprint(t, seed=seed))
                    sizes.append(len(shingles))
                    prints.append(banded(shingles, bands, rows))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, 256), pa.array(nodes, pa.int64()), pa.array(np.asarray(fps, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(prints, pa.list_(pa.int64()))], names=["doc_id", "node", "fp", "n", "keys"])

    def sets_of(batches):
        for batch in batches:
            for a in range(0, len(batch), 256):
                parts = [words_of(t) for t in batch.column(1).slice(a, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(p, seed) for p in parts], pa.int64()), pa.array([shingles_of(p, words, seed).tobytes() for p in parts], pa.binary())], names=["node", "own"])

    def named(batches):
        for batch in batches:
            nodes = [node_of(words_of(t), seed) for a in range(0, len(batch), 256) for t in batch.column(at).slice(a, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.int64())], names=[*names, "__node"])

    with Scratch(spark, "nearcopies") as scratch:
        marked = scratch.table(own.mapInArrow(mark, "doc_id long, node long, fp long, n long, keys array<long>"), "marked")
        first = scratch.table(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min("fp").alias("fp")), "first")
        with Scratch(spark, "near-simhash") as inner:
            parts = simhash.rooted_fingerprints(inner.table(first.select("fp").distinct(), "distinct"), 4, inner)
            parts = inner.table(first.select("node", "fp").join(parts, "fp").select("node", F.col("root").alias("part")), "parts")
            tops = parts.groupBy("part").agg(F.min("node").alias("root"), F.count("*").alias("c")).filter("c > 1")
            tied = scratch.table(parts.join(tops, "part").select("node", "root"), "tied")
        each = scratch.table(marked.select("node", "n", F.posexplode("keys").alias("band", "fp")).select(F.xxhash64("band", "fp").alias("key"), "node", "n").distinct(), "each")
        shared = each.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
        members = scratch.table(each.join(shared, "key"), "members")
        picked = members.select("node").distinct().join(first, "node").select(F.col("least").alias("doc_id"), "node")
        # one text per node: that of its smallest id, or without ids any
        texts = own.join(picked.select(F.col("doc_id").alias("__id")).distinct(), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
        sets = scratch.table(texts.mapInArrow(sets_of, "node long, own binary").join(members.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]), "sets")
        roots = _links(members, sets, least, scratch, tied)
        rooted = first.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        best = F.min_by(F.struct("node", "least"), F.struct(F.col("least").isNull(), "least", "node")).alias("best")
        chosen = scratch.keep(rooted.groupBy("root").agg(best).select(F.col("best.node").alias("__chosen"), F.col("best.least").alias("__least")))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    # by node and id, so that the copies of a text, which do not stay, meet in no one place
    left = docs.mapInArrow(named, f"{fields}, `__node` long").join(chosen, (F.col("__node") == F.col("__chosen")) & F.col(id_col).cast("long").eqNullSafe(F.col("__least")), "left_semi")
    by = F.struct(F.col(id_col).isNull(), F.col(id_col), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    return left.groupBy("__node").agg(F.min_by(F.struct(*names), by).alias("__row")).select("__row.*")
