"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within ``radius`` bits have a common variant within half the radius of both. Every distinct fingerprint
emits all such variants and they are shuffled; as all variants of one fingerprint that share their upper bits go to the
same place, only (upper bits, fingerprint) travels and the lower bits are varied on arrival. Fingerprints that meet in a
variant lie within the radius of each other, so a chain through them keeps every component and no pair need be listed.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm._io import Scratch
from sondage.llm.components import components

_HASH = xxhash.xxh64_intdigest


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """Bit set if in over half of the shingles' hashes; no words: 0."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    if len(parts) <= words:
        return _HASH(b" ".join(parts), seed)
    line = b" ".join(parts)
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    end = np.cumsum(size + 1) - 1
    first, last = (end - size)[: 1 - words].tolist(), end[words - 1 :].tolist()
    hashes = np.fromiter([_HASH(line[a:b], seed) for a, b in zip(first, last, strict=True)], dtype="<u8", count=len(first))
    ones = np.zeros(64, dtype=np.int64)
    for a in range(0, len(hashes), 255):  # sums of bits packed in bytes
        ones += np.unpackbits(hashes[a : a + 255].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of docs with doc_id, text."""

    def each(batches):
        for batch in batches:
            texts, out = batch.column(1), []
            for at in range(0, len(texts), 256):
                out += [fingerprint(t, words, seed) for t in texts.slice(at, 256).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(out, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.mapInArrow(each, "doc_id long, fp long")


def _flips(bits: int, most: int) -> np.ndarray:
    """Masks of ``bits`` bits with at most ``most`` set, fewest first."""
    out = [sum(1 << i for i in own) for n in range(most + 1) for own in combinations(range(bits), n)]
    return np.asarray(out, dtype=np.uint64)


def meetings(fps: np.ndarray, left: np.ndarray, bits: int, room: int = 1 << 21) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that are neighbours in some variant.

    The upper bits of all fps have been made equal; fps[i] has left[i] flips to spend on its lowest ``bits`` bits. Where
    the variants would outgrow ``room``, the next four bits are tried one value at a time, so memory stays bounded.
    """
    none = np.zeros(0, dtype=np.int64)
    if len(fps) < 2:
        return none, none
    per = np.cumsum([1, bits, bits * (bits - 1) // 2])
    if per[left].sum() > room and bits > 4:
        part, found = fps >> np.uint64(bits - 4) & np.uint64(15), [(none, none)]
        for value in range(16):
            rest = left - np.bitwise_count(part ^ np.uint64(value)).astype(np.int64)
            own = np.flatnonzero(rest >= 0)
            i, j = meetings(fps[own], rest[own], bits - 4, room)
            found.append((own[i], own[j]))
        i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    else:
        low, masks = fps & np.uint64((1 << bits) - 1), _flips(bits, 2)
        variants, owners = [], []
        for n in range(3):
            own = np.flatnonzero(left == n)
            variants.append((low[own, None] ^ masks[None, : per[n]]).ravel())
            owners.append(np.repeat(own, per[n]))
        v, o = np.concatenate(variants), np.concatenate(owners)
        by = np.argsort(v)
        v, o = v[by], o[by]
        same = v[1:] == v[:-1]
        i, j = o[:-1][same], o[1:][same]
    pairs = np.unique(np.minimum(i, j) * len(fps) + np.maximum(i, j))
    return pairs // len(fps), pairs % len(fps)


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over the links (i, j)."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        if (a == b).all():
            break
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root != (up := root[root])).any():
            root = up
    return root


def upper_bits(n: int, dense: int = 4096) -> int:
    """How many upper bits to shuffle on, so that about ``dense`` fingerprints meet in each of their values."""
    for k in range(8, 40):
        if n * (1 + k + k * (k - 1) // 2) <= dense << k:
            return k
    return 40


def fingerprint_links(fps: DataFrame, n: int, radius: int = 4) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that keep every component of the graph of pairs within
    ``radius`` (4 or 5: half of it is 2 flips). About a link per fingerprint and value of the upper bits where it meets another."""
    k = upper_bits(n)
    masks = _flips(k, 2)

    def emit(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for own in np.array_split(fp, max(1, len(fp) * len(masks) >> 18)):
                keys = (own >> np.uint64(64 - k))[:, None] ^ masks[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(own, len(masks)).view(np.int64))], names=["key", "fp"])

    def meet(key: int, fp: np.ndarray):
        fp = np.unique(fp).view(np.uint64)
        left = 2 - np.bitwise_count(fp >> np.uint64(64 - k) ^ np.uint64(key)).astype(np.int64)
        i, j = meetings(fp, left, 64 - k)
        near = np.bitwise_count(fp[i] ^ fp[j]) <= radius
        root = spanning(i[near], j[near], len(fp))
        own = np.flatnonzero(root != np.arange(len(fp)))
        return fp[own].view(np.int64), fp[root[own]].view(np.int64)

    def collide(batches):
        key, held = None, []
        for batch in batches:
            keys, fp = (batch.column(c).to_numpy() for c in (0, 1))
            cuts = np.flatnonzero(np.diff(keys)) + 1
            out = []
            for part, own in zip(np.split(keys, cuts), np.split(fp, cuts), strict=True):
                if not len(part):
                    continue
                if part[0] != key:
                    if len(held) and key is not None:
                        out.append(meet(key, np.concatenate(held)))
                    key, held = part[0], []
                held.append(own)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["a", "b"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in meet(key, np.concatenate(held))], names=["a", "b"])

    dealt = fps.select("fp").mapInArrow(emit, "key long, fp long").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(collide, "a long, b long")


def rooted_fingerprints(distinct: DataFrame, radius: int, scratch: Scratch) -> DataFrame:
    """The table ``distinct`` (fp: each once, and other columns) with root: one fingerprint per component."""
    links = scratch.table(fingerprint_links(distinct, distinct.count(), radius), "links")
    roots = scratch.table(components(links, scratch), "roots")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    return scratch.table(rooted, "rooted")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, radius: int = 4) -> DataFrame:
    """Per row doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of at most
    ``radius`` differing bits.

    Texts without words (null, empty) have fingerprint 0 and are linked like any other; repeated rows come back each;
    null ids are linked but name a component only if it has no other id (then null); an empty table gives no rows. Other
    columns are not read. ``radius`` is 4 or 5: the ball of half of it has two flips.
    """
    if radius not in (4, 5):
        raise ValueError("the balls have two flips, which meet within a radius of 4 or 5")
    with Scratch(docs.sparkSession, "simhash") as scratch:
        own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        marked = scratch.table(fingerprints(own, words, seed), "marked")
        distinct = scratch.table(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
        rooted = rooted_fingerprints(distinct, radius, scratch)
        first = scratch.table(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "first")
        named = scratch.table(rooted.select("fp", "root").join(first, "root").select("fp", "component_id"), "named")
        out = marked.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
        return scratch.keep(out)


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component, one row each.

    Of rows that repeat an id, the one with the smallest text hash stays. Rows without an id stay only where their
    component has no id.
    """
    own = near_duplicates(docs, id_col=id_col, text_col=text_col, **options)
    stay = own.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    left = docs.join(stay, F.col(id_col).cast("long").eqNullSafe(F.col("__id")), "left_semi")
    return left.withColumn("__h", F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))).groupBy(F.col(id_col).alias("__id")).agg(F.min_by(F.struct(*docs.columns), "__h").alias("__row")).select("__row.*")
