"""Best-fit packing by minimum bin slack.

Per sequence, a bitset subset-sum over the lengths still available finds the fullest combination that holds the longest
piece left; the combination is taken as often as its lengths last. Pieces of one length are interchangeable, so the plan
needs only how many pieces have each length: at most ``capacity`` numbers, whatever the size of the corpus.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sondage.llm._io import Scratch
from sondage.llm.tokens import encoder


def fullest(room: int, left: dict[int, int], order: list[int]) -> dict[int, int]:
    """The combination of lengths with the largest sum of at most ``room``: length -> how many.

    Bit s of an integer says that some combination of the lengths seen so far sums to s. Lengths are tried from long to
    short, so short ones are kept for later sequences, and the search ends once ``room`` is met.
    """
    reach, steps, mask = 1, [], (1 << room + 1) - 1
    for length in order:
        if length > room or not left.get(length):
            continue
        n, times, before = min(left[length], room // length), 1, reach
        while n:
            take = min(times, n)
            reach |= reach << take * length & mask
            n -= take
            times *= 2
        if reach != before:
            steps.append((length, before))
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
        if n:
            chosen[length] = n
    return chosen


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how often, length -> how many) until every piece has a place."""
    left = {k: v for k, v in counts.items() if v}
    order, out = sorted(left, reverse=True), []
    while order:
        longest = order[0]
        left[longest] -= 1
        own = fullest(capacity - longest, left, order) if capacity > longest else {}
        left[longest] += 1
        own[longest] = own.get(longest, 0) + 1
        times = min(left[k] // n for k, n in own.items())
        for k, n in own.items():
            left[k] -= n * times
        out.append((times, own))
        order = [k for k in order if left[k]]
    return out


def places(patterns: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """Per length, rows (first rank, first sequence, pieces per sequence, offset of the first of them)."""
    rows, used, sequence = defaultdict(list), defaultdict(int), 0
    for times, own in patterns:
        offset = 0
        for length in sorted(own, reverse=True):
            rows[length].append((used[length], sequence, own[length], offset))
            used[length] += own[length] * times
            offset += own[length] * length
        sequence += times
    return {k: np.asarray(v, dtype=np.int64) for k, v in rows.items()}


def pieces_of(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """Encodes whole texts (null: empty), appends ``end_id``, cuts what is longer than ``capacity``.

    Beside the piece's columns come ``task`` and ``rank``: the task that made it and its number among that task's pieces
    of the same length. Written to a table once, they stay as they are.
    """
    end = np.asarray([end_id], dtype="<u4").tobytes()
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", *["ids"] * with_ids]

    def cut(batches):
        enc, task, seen = encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), 256):
                rows = []
                for doc_id, own in zip(ids[at : at + 256], enc.encode(texts.slice(at, 256).to_pylist()), strict=True):
                    own += end
                    for piece, begin in enumerate(range(0, len(own), 4 * capacity)):
                        part = own[begin : begin + 4 * capacity]
                        n = len(part) // 4
                        rows.append((doc_id, piece, begin // 4, n, zlib.crc32(part), task, int(seen[n]), *[part] * with_ids))
                        seen[n] += 1
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * with_ids]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long" + ", ids binary" * with_ids
    return docs.mapInArrow(cut, schema)


def pack_table(pieces: DataFrame, capacity: int) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces that has length, task and rank.

    Lengths are counted per task, summed to at most ``capacity`` numbers for the plan, and a running sum over tasks turns
    a rank within a task into a rank within the length. A length that a third of all pieces share is dealt by (task,
    length), never gathered. The plan has at most capacity * ln(capacity) rows or so, which each task gets.
    """
    per_task = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = places(plan(counts, capacity))
    before = per_task.select("task", "length", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    names = [c for c in pieces.columns if c not in ("task", "rank")]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            rank = rank + batch.column("before").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            by = np.argsort(length, kind="stable")
            values, first = np.unique(length[by], return_index=True)
            for value, own in zip(values, np.split(by, first[1:]), strict=True):
                rows = table[int(value)]
                row = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                r = rank[own] - row[:, 0]
                sequence[own] = row[:, 1] + r // row[:, 2]
                offset[own] = row[:, 3] + r % row[:, 2] * value
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in names)
    return pieces.join(before, ["task", "length"]).mapInArrow(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str, *, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Packs documents into as few sequences of at most ``capacity`` ids as minimum bin slack finds.

    Returns per piece doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if ``with_ids``, ids. Null or
    empty texts are pieces of one id; repeated rows are packed each; an empty table gives no rows; other columns are
    not read.
    """
    with Scratch(docs.sparkSession, "packing") as scratch:
        own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        pieces = scratch.table(pieces_of(own, vocabulary, capacity, end_id, with_ids), "pieces")
        return scratch.keep(pack_table(pieces, capacity))
