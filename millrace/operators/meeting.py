"""Every query vector meets every row vector, in groups that tasks stream.

Queries are dealt into blocks and rows into shares; a group is one block and one share. A task
sorts a group so that its queries come first and the rows follow in the order of their keys. It
holds the block, meets the rows some thousands at a time, and keeps for each query the n best so
far. Neither the number of rows nor of queries changes what a task holds, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries of a block, rows of a share, and shares at most: beyond, they are larger, since each gives n rows a query.
BLOCK, SHARE, SHARES = 8192, 16_384, 48
#: Rows and queries that are multiplied at once.
ROWS, QUERIES = 4096, 512

_LAST = np.iinfo(np.int64).max


def dealt(queries: DataFrame, rows: DataFrame, n: int, total: int) -> DataFrame:
    """Both sides in groups, to be streamed by `met`: group, side (0: query), columns of the queries, key of the rows, v.

    queries: any columns and v, about n rows; rows: key and v, about total rows.
    """
    blocks, shares = max(1, -(-n // BLOCK)), max(1, min(SHARES, -(-total // SHARE)))
    part = lambda df, k: F.pmod(F.xxhash64(*df.columns), F.lit(k))
    every = lambda k: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(k - 1).cast("long")))
    q = queries.withColumn("block", part(queries, blocks)).withColumn("share", every(shares)).withColumn("side", F.lit(0))
    r = rows.withColumn("share", part(rows, shares)).withColumn("block", every(blocks)).withColumn("side", F.lit(1))
    both = q.unionByName(r, allowMissingColumns=True).withColumn("group", F.col("block") * shares + F.col("share"))
    both = both.select("group", "side", *(c for c in queries.columns if c != "v"), "key", "v")
    return both.repartition(2 * blocks * shares, "group").sortWithinPartitions("group", "side", "key")


class Best:
    """The n candidates of least cost, ties to the least number, for each of some queries."""

    def __init__(self, queries: int, n: int):
        self.n = n
        self.cost, self.number = (np.full((queries, n), _LAST, np.int64) for _ in range(2))
        self.count = np.zeros(queries, np.int64)

    def take(self, of: np.ndarray, number: np.ndarray, cost: np.ndarray) -> None:
        """Further candidates: query, number and cost."""
        touched = np.unique(of)
        i, r = np.nonzero(np.arange(self.n)[None, :] < self.count[touched, None])
        of, number, cost = (np.concatenate(x) for x in ((touched[i], of), (self.number[touched[i], r], number), (self.cost[touched[i], r], cost)))
        order = np.lexsort((number, cost, of))
        of, number, cost = of[order], number[order], cost[order]
        starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if of.size else np.zeros(0, int)
        rank = np.arange(of.size) - np.repeat(starts, np.diff(np.append(starts, of.size)))
        kept = rank < self.n
        self.cost[of[kept], rank[kept]], self.number[of[kept], rank[kept]] = cost[kept], number[kept]
        self.count[of[starts]] = np.minimum(np.diff(np.append(starts, of.size)), self.n)

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, r = np.nonzero(np.arange(self.n)[None, :] < self.count[:, None])
        return i, self.number[i, r], self.cost[i, r]


def _matrices(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The lists of each length: their places, a matrix of doubles, and whether a list holds a null."""
    flat, ends = column.values, column.offsets.to_numpy()
    values, size = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False), np.diff(ends)
    nulls = np.append(0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))) if flat.null_count else np.zeros(len(flat) + 1, np.int64)
    for dim in np.unique(size):
        at = np.flatnonzero(size == dim)
        yield at, values[ends[at][:, None] + np.arange(dim)[None, :]], nulls[ends[at + 1]] > nulls[ends[at]]


class _Group:
    def __init__(self, make: Callable, names: list[str], rows: int):
        self.make, self.names, self.rows, self.total = make, names, rows, 0
        self.asked: dict[int, list] = {}
        self.ready: dict[int, tuple] = {}
        self.waiting: dict[int, list] = {}
        self.keys: list[pa.Array] = []

    def ask(self, batch: pa.RecordBatch) -> None:
        for at, x, odd in _matrices(batch.column("v")):
            self.asked.setdefault(x.shape[1], []).append((batch.take(pa.array(at)), x, odd))

    def meet(self, batch: pa.RecordBatch) -> None:
        self.keys.append(batch.column("key"))
        for at, x, odd in _matrices(batch.column("v")):
            if x.shape[1] in self.asked:
                held = self.waiting.setdefault(x.shape[1], [])
                held.append((at + self.total, x, odd))
                if sum(len(h[0]) for h in held) >= self.rows:
                    self.flush(x.shape[1])
        self.total += batch.num_rows

    def flush(self, dim: int) -> None:
        if dim not in self.ready:
            asked, x, odd = zip(*self.asked[dim], strict=True)
            self.ready[dim] = (pa.Table.from_batches(asked), self.make(np.concatenate(x), np.concatenate(odd)))
        if held := self.waiting.pop(dim, None):
            number, x, odd = (np.concatenate(h) for h in zip(*held, strict=True))
            for lo in range(0, len(number), self.rows):
                self.ready[dim][1].meet(*(h[lo : lo + self.rows] for h in (number, x, odd)))

    def result(self) -> Iterator[pa.RecordBatch]:
        keys = pa.chunked_array(self.keys) if self.keys else None
        for dim in [*self.waiting]:
            self.flush(dim)
        for asked, state in self.ready.values():
            of, number, *found = state.found()
            asked = asked.drop_columns(["group", "side", "key", "v"]).take(pa.array(of))
            yield from pa.table([*asked.columns, keys.take(pa.array(number)), *found], names=self.names).combine_chunks().to_batches()


def met(pairs: DataFrame, make: Callable, schema: T.StructType, rows: int | None = None) -> DataFrame:
    """What the states that `make` makes for a group's queries (a matrix, and whether a row holds a null) find among its rows.

    A state has `meet(numbers, matrix, odd)` and `found()`: query, number of the row, further
    columns. The rows' numbers ascend with their keys. schema: the queries' columns, key and the
    further columns.
    """
    rows, names = rows or ROWS, schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state = None
        for batch in batches:
            if not batch.num_rows:
                continue
            group, side = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            cuts = [0, *(np.flatnonzero((np.diff(group) != 0) | (np.diff(side) != 0)) + 1).tolist(), len(group)]
            for lo, hi in zip(cuts, cuts[1:]):  # noqa: B905  neighbours
                if state is None or group[lo] != now:
                    if state:
                        yield from state.result()
                    now, state = group[lo], _Group(make, names, rows)
                (state.meet if side[lo] else state.ask)(batch.slice(lo, hi - lo))
        if state:
            yield from state.result()

    return pairs.mapInArrow(run, schema)
