"""One-to-one assignment within a small group of boxes (one page), and a way to run it over very many small groups."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType


def per_group(rows: DataFrame, keys: list[str], order: list[str], each: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str) -> DataFrame:
    """``each`` over the columns of every group of ``keys``, in ``order``; it returns rows of ``schema``. Groups come many to an
    Arrow batch, so a group of a few rows costs no call of its own; only one group is held beyond its batch."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(StructType.fromDDL(schema))
    names = rows.columns

    def run(batches):
        def judged(part: pa.Table, cuts: list[int]) -> pa.RecordBatch:
            columns = {c: part[c].to_numpy() for c in names}
            out = [row for a, b in zip([0, *cuts], [*cuts, len(part)], strict=True) if b > a for row in each({c: x[a:b] for c, x in columns.items()})]
            return pa.RecordBatch.from_arrays([pa.array([row[i] for row in out], f.type) for i, f in enumerate(kind)], schema=kind)

        held = None
        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = part if held is None else pa.concat_tables([held, part])
            moved = np.zeros(max(0, len(part) - 1), dtype=bool)
            for key in keys:
                own = part[key].to_numpy()
                moved |= own[1:] != own[:-1]
            cuts = (np.flatnonzero(moved) + 1).tolist()
            last = cuts[-1] if cuts else 0
            held = part.slice(last)
            yield judged(part.slice(0, last), cuts[:-1])
        if held is not None:
            yield judged(held, [])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def greedy(pairs: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Pairs (score, left, right) taken best first; on ties the larger left, then the larger right goes first."""
    left, right, out = set(), set(), []
    for pair in sorted(pairs, reverse=True):
        if pair[1] not in left and pair[2] not in right:
            left.add(pair[1])
            right.add(pair[2])
            out.append(pair)
    return out


def optimal(scores: np.ndarray, least: float) -> list[tuple[int, int]]:
    """Rows and columns of the assignment with the largest total of (score - least) over pairs of at least ``least``.

    Shortest augmenting paths with potentials over the columns; every row also has a column of its own that stands for
    staying alone, so no row is forced into a bad pair.
    """
    scores = np.asarray(scores, dtype=np.float64)
    if not scores.size:
        return []
    rows, columns = scores.shape
    cost = np.full((rows, columns + rows), 1e6)
    cost[:, :columns] = np.where(scores >= least, 1 - scores, 1e6)
    cost[np.arange(rows), columns + np.arange(rows)] = 1 - least + 1e-9
    width = columns + rows
    owner = np.full(width, -1)
    row_price, column_price = np.zeros(rows), np.zeros(width)
    for row in range(rows):
        best, back, done = np.full(width, np.inf), np.full(width, -1), np.zeros(width, dtype=bool)
        at, free, reach = row, -1, 0.0
        visited = [(row, 0.0)]
        while free < 0:
            step = reach + cost[at] - row_price[at] - column_price
            better = ~done & (step < best - 1e-15)
            best[better] = step[better]
            back[better] = at
            open_ = np.where(done, np.inf, best)
            column = int(open_.argmin())
            reach, done[column] = float(open_[column]), True
            if owner[column] < 0:
                free = column
            else:
                at = int(owner[column])
                visited.append((at, reach))
        for r, dist in visited:
            row_price[r] += reach - dist
        column_price[done] += best[done] - reach
        column = free
        while True:  # hand each column on the path to the row that reached it
            r = int(back[column])
            previous = np.flatnonzero(owner == r)
            owner[column] = r
            if r == row:
                break
            column = int(previous[0])
    return sorted((int(owner[j]), j) for j in range(columns) if owner[j] >= 0 and scores[owner[j], j] >= least)
