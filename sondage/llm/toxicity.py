"""Toxicity by a factorization machine over hashed terms.

The terms of a text are its distinct words and the beginnings of those words, hashed. The score is
sigmoid(b + sum of weights + sum over pairs of terms of the inner product of their factors), so a pair such as an insult
and the mention of a group weighs more, or less, than both alone. The sum over pairs is linear in the number of terms.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sondage.llm._io import Scratch

BUCKETS = 1 << 22
_TERM = re.compile(r"[^\W_]+")
#: Lengths of the word beginnings that are terms too.
PREFIXES = (4, 5, 6)


def words_of(text: str | None) -> set[str]:
    return set(_TERM.findall((text or "").lower()))


def buckets_of(word: str) -> list[int]:
    """The hashed terms of one word; a beginning ends in a hyphen so that it differs from the word."""
    return [zlib.crc32(t.encode("utf-8", "surrogatepass")) % BUCKETS for t in (word, *(word[:n] + "-" for n in PREFIXES if len(word) > n))]


class Machine:
    """A fitted machine: sorted buckets, and per bucket its weight and factors. Buckets not met in fitting count nothing."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, factors: np.ndarray, bias: float, remembered: int = 150_000):
        self.buckets, self.weights, self.factors, self.bias = buckets, weights, factors, bias
        self.remembered = remembered
        self._clear()

    def __getstate__(self):
        return (self.buckets, self.weights, self.factors, self.bias, self.remembered)

    def __setstate__(self, state):
        self.__init__(*state)

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, 2 + self.factors.shape[1]))

    def _learn(self, words: list[str]) -> None:
        """Rows (sum of weights, sum of squared factors, sum of factors) of words not met before."""
        own = [buckets_of(w) for w in words]
        flat = np.asarray([b for bs in own for b in bs], dtype=np.int64)
        at = np.searchsorted(self.buckets, flat) if len(self.buckets) else np.zeros(len(flat), np.int64)
        hit = at < len(self.buckets)
        hit[hit] = self.buckets[at[hit]] == flat[hit]
        rows = np.zeros((len(flat), self.table.shape[1]))
        v = self.factors[at[hit]].astype(np.float64)
        rows[hit, 0], rows[hit, 1], rows[hit, 2:] = self.weights[at[hit]], (v * v).sum(1), v
        begin = np.cumsum([0, *map(len, own[:-1])])
        first = len(self.known)
        while first + len(words) > len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[first : first + len(words)] = np.add.reduceat(rows, begin, axis=0)
        self.known.update(zip(words, range(first, first + len(words)), strict=True))

    def score(self, texts: list[str | None]) -> np.ndarray:
        sets = [words_of(t) for t in texts]
        if len(self.known) > self.remembered:
            self._clear()
        known = self.known
        if new := sorted({w for s in sets for w in s if w not in known}):
            self._learn(new)
        logit = np.full(len(texts), self.bias)
        full = [i for i, s in enumerate(sets) if s]
        if full:
            ids = [np.sort(np.fromiter(map(known.__getitem__, sets[i]), dtype=np.int64, count=len(sets[i]))) for i in full]
            sums = np.add.reduceat(self.table[np.concatenate(ids)], np.cumsum([0, *map(len, ids[:-1])]), axis=0)
            logit[full] += sums[:, 0] + 0.5 * ((sums[:, 2:] ** 2).sum(1) - sums[:, 1])
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def fit(rows: list[tuple[int, np.ndarray]], *, factors: int = 8, alone: int = 6, rounds: int = 12, rate: float = 0.2, paired_rate: float = 0.02, shrink: float = 0.005, decay: float = 1e-4, paired_decay: float = 1e-3, least: int = 3, least_paired: int = 20, seed: int = 0) -> Machine:
    """Fits by AdaGrad on (label, hashed terms), in batches of 32, over all terms of ``least`` texts or more.

    Weights are fitted ``alone`` and then with factors, so that factors learn what weights leave open. ``shrink`` draws
    weights to 0, as most terms tell nothing; terms of ``least_paired`` texts or more have factors, as with fewer texts a
    pair has too few to learn from.
    """
    if not rows or len({y for y, _ in rows}) < 2:
        bias = -50.0 if not rows or not rows[0][0] else 50.0
        return Machine(np.zeros(0, np.int64), np.zeros(0), np.zeros((0, factors)), bias)
    # tables over all buckets, 16 MB each, and a text at a time: what all texts hold together stands in memory once
    counts = np.zeros(BUCKETS, dtype=np.int32)
    for _, own in rows:
        counts[np.unique(own)] += 1
    buckets = np.flatnonzero(counts >= least)
    held = counts[buckets] >= least_paired
    index = np.full(BUCKETS, -1, dtype=np.int32)
    index[buckets] = np.arange(len(buckets), dtype=np.int32)
    docs = []
    for _, own in rows:
        place = index[own]
        docs.append(place[place >= 0])
    del counts, index
    y = np.asarray([float(v) for v, _ in rows])
    random = np.random.default_rng(seed)
    table = np.concatenate([np.zeros((len(buckets), 1)), random.normal(0, 0.01, (len(buckets), factors))], axis=1).astype(np.float32)
    past = np.full_like(table, 1e-2)
    bias = float(np.log(y.mean() / (1 - y.mean())))
    past_bias = 1e-4
    rates = np.asarray([rate] + [paired_rate] * factors, dtype=np.float32)
    table[~held, 1:] = 0
    for step in range(alone + rounds):
        order = random.permutation(len(docs))
        for a in range(0, len(order), 32):
            own = [i for i in order[a : a + 32] if len(docs[i])]
            if not own:
                continue
            sizes = [len(docs[i]) for i in own]
            flat, begin = np.concatenate([docs[i] for i in own]), np.cumsum([0, *sizes[:-1]])
            rows_ = table[flat]
            sums = np.add.reduceat(rows_, begin, axis=0)
            squares = np.add.reduceat((rows_[:, 1:] ** 2).sum(1), begin)
            logit = bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2).sum(1) - squares)
            wrong = 1 / (1 + np.exp(-np.clip(logit, -50, 50))) - y[own]
            each = np.repeat(wrong, sizes).astype(np.float32)[:, None]
            grad = np.empty_like(rows_)
            grad[:, 0] = each[:, 0]
            grad[:, 1:] = each * (np.repeat(sums[:, 1:], sizes, axis=0) - rows_[:, 1:])
            used, back = np.unique(flat, return_inverse=True)
            by = np.argsort(back, kind="stable")
            total = np.add.reduceat(grad[by], np.searchsorted(back[by], np.arange(len(used))), axis=0) / len(own)
            total[:, 0] += decay * table[used, 0]
            total[:, 1:] += paired_decay * table[used, 1:]
            total[~held[used] | (step < alone), 1:] = 0
            past[used] += total**2
            pace = 1 / np.sqrt(past[used])
            new = table[used] - rates * pace * total
            new[:, 0] = np.sign(new[:, 0]) * np.maximum(np.abs(new[:, 0]) - rate * shrink * pace[:, 0], 0)
            table[used] = new
            g = float(wrong.mean())
            past_bias += g * g
            bias -= rate * g / past_bias**0.5
    return Machine(buckets, table[:, 0].astype(np.float64), table[:, 1:], bias)


def train(docs: DataFrame, labels: DataFrame, scratch: Scratch, *, per_class: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> Machine:
    """Fits on at most ``per_class`` labelled documents of each class, those with the smallest hash of the id.

    That bound is the only one on documents: it keeps the fit in one executor's task. Where it samples one class more than
    the other, the bias is set back to the classes' share of all labels, so a score means the same at every size. Rows labelled twice take the larger label; null
    ids, labels and texts are left out of the fit.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg((F.max(label_col) > 0).cast("int").alias("y"))
    picked = [known.filter(F.col("y") == c).orderBy(F.xxhash64("id"), "id").limit(per_class) for c in (0, 1)]
    totals = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    shares = [min(per_class, totals.get(c, 0)) / totals[c] if totals.get(c) else 1.0 for c in (0, 1)]
    shift = float(np.log(shares[1] / shares[0]))
    sample = scratch.table(picked[0].unionByName(picked[1]), "sample")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").join(F.broadcast(sample), "id")

    def terms(batches):
        for batch in batches:
            ids, ys = batch.column(0), batch.column(1)
            found = [np.fromiter((b for w in sorted(words_of(t)) for b in buckets_of(w)), dtype=np.int32) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([ids, ys, pa.array([f.tobytes() for f in found], pa.binary())], names=["id", "y", "terms"])

    rows = scratch.table(texts.select("id", "y", "text").mapInArrow(terms, "id long, y int, terms binary"), "terms")

    def learn(batches):
        seen = {(i, y, x) for batch in batches for i, y, x in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)}  # repeated rows once
        machine = fit([(y, np.frombuffer(x, dtype=np.int32)) for _, y, x in sorted(seen)], **options)
        machine.bias -= shift
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(machine)], pa.binary())], names=["machine"])

    found = rows.coalesce(1).mapInArrow(learn, "machine binary").collect()
    return pickle.loads(found[0][0]) if found else fit([])


def score(docs: DataFrame, machine: Machine, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and the score of the whole text, 0 to 1. Null and empty texts score what the bias says; a column
    with the score's name is replaced; rows keep their number and order; an empty table gives no rows."""
    docs = docs.drop(score_col)
    held = docs.sparkSession.sparkContext.broadcast(machine)  # its size is bounded by the sample's terms
    names, at = docs.columns, docs.columns.index(text_col)

    def each(batches):
        for batch in batches:
            texts, out = batch.column(at), []
            for a in range(0, len(texts), 128):
                out.append(held.value.score(texts.slice(a, 128).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out) if out else np.zeros(0))], names=[*names, score_col])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(each, f"{fields}, `{score_col}` double")


def drop_toxic(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, **options) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, as they came."""
    with Scratch(docs.sparkSession, "toxicity") as scratch:
        machine = train(docs, labels, scratch, **options)
    name = "__score"
    return score(docs, machine, text_col=options.get("text_col", "text"), score_col=name).filter(F.col(name) < threshold).drop(name)
