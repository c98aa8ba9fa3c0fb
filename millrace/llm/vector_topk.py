"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into segments; a segment keeps its mean and its deviation. For two segments of
length m the inner product is at most m (mean mean' + dev dev'), which bounds the distance from
below and the score from above. Coarse segments are tried first, then fine ones, then the exact
integer product of what survives.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.meeting import Best, dealt, met

#: Numbers of segments, coarse to fine.
RESOLUTIONS = (4, 16)
#: Candidates and queries that are compared at once, and pairs of survivors.
CANDIDATES, QUERIES = 4096, 512
_PAIRS = 20_000


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id and v: floor(256 x) of each component as double, which holds it exactly whatever its size.

    Vectors that are null or empty of an id, or hold null or non-finite components, take no part.
    Repeated rows stay.
    """
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))

    def whole(c):  # from 2**52 on every double is an integer
        scaled = 256 * c.cast("double")
        return F.when(F.abs(scaled) < float(1 << 52), F.floor(F.when(F.abs(scaled) < float(1 << 52), scaled)).cast("double")).otherwise(scaled)

    return vectors.where(x.isNotNull() & F.col("vec_id").isNotNull()).where(finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """For each row sqrt(m) mean and sqrt(m) dev of its segments: products of these bound products of rows."""
    bounds = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)[:-1]
    m = np.diff(np.append(bounds, x.shape[1])).astype(np.float64)
    mean = np.add.reduceat(x, bounds, axis=1) / m
    square = np.add.reduceat(x * x, bounds, axis=1) / m
    dev = np.sqrt(np.maximum(square - mean * mean, 0))
    return np.concatenate([mean * np.sqrt(m), dev * np.sqrt(m)], axis=1)


def _products(q: np.ndarray, c: np.ndarray, largest: np.ndarray) -> np.ndarray:
    """Exact integer products of rows of q with rows of c, the nearest 64-bit number for those beyond; `largest` bounds each sum of absolute products."""
    out = np.zeros(len(q), np.int64)
    small, huge = largest < 2.0**53, largest >= 2.0**62
    whole = ~small & ~huge
    if small.all():
        return np.einsum("ij,ij->i", q, c).astype(np.int64)
    out[small] = np.einsum("ij,ij->i", q[small], c[small]).astype(np.int64)
    out[whole] = np.einsum("ij,ij->i", q[whole].astype(np.int64), c[whole].astype(np.int64))
    for i in np.flatnonzero(huge):
        p = sum(int(v) * int(w) for v, w in zip(q[i], c[i], strict=True))
        out[i] = min(max(p, -(1 << 63)), (1 << 63) - 1)
    return out


class Search:
    """The n best candidates of each query by integer product, of those that it has met so far."""

    def __init__(self, q: np.ndarray, n: int, queries: int):
        self.q, self.n, self.queries = q, n, queries
        self.levels = [statistics(q, s) for s in RESOLUTIONS] if q.shape[1] else []
        self.norm, self.most = np.sqrt((q * q).sum(axis=1)), np.abs(q).max(axis=1, initial=1)
        self.best = Best(len(q), n)

    def meet(self, number: np.ndarray, c: np.ndarray, _odd: np.ndarray) -> None:
        levels, norm = [statistics(c, s) for s in RESOLUTIONS] if self.levels else [], np.sqrt((c * c).sum(axis=1).max(initial=0))
        highest = c.shape[1] * np.abs(c).max(initial=1)
        for lo in range(0, len(self.q), self.queries):
            self._tile(slice(lo, lo + self.queries), number, c, levels, norm, highest)

    def _tile(self, rows: slice, number: np.ndarray, c: np.ndarray, levels: list[np.ndarray], norm: float, highest: float) -> None:
        q, n, largest, best = self.q[rows], self.n, highest * self.most[rows], self.best
        # a segment's deviation can be off by 1e-8 of its root mean square
        slack = 1e-7 * self.norm[rows] * norm + 1e-6
        coarse = self.levels[0][rows] @ levels[0].T if levels else np.zeros((len(q), len(c)))
        least = np.where(best.count[rows] == n, ~best.cost[rows, n - 1], -(1 << 63))  # the n-th best score is no less
        new = np.flatnonzero(best.count[rows] < n)
        if new.size and len(c) >= n:
            seeds = np.argpartition(-coarse[new], n - 1, axis=1)[:, :n].reshape(-1)
            of = np.repeat(new, n)
            least[new] = _products(q[of], c[seeds], largest[of]).reshape(-1, n).min(axis=1)
        # what is beyond the least 64-bit number counts as it
        floor = np.where(least == -(1 << 63), -np.inf, least - slack)
        alive = coarse >= floor[:, None]
        if levels and np.count_nonzero(alive) > alive.size / 10:
            alive &= self.levels[1][rows] @ levels[1].T >= floor[:, None]
            levels = []
        if np.count_nonzero(alive) > alive.size / 20 and largest.max(initial=0) < 2.0**53:
            exact = q @ c.T  # so many survive that a whole tile's exact products cost less
            if new.size and len(c) >= n:
                least[new] = np.partition(exact[new], -n, axis=1)[:, -n].astype(np.int64)
            i, j = np.divmod(np.flatnonzero(alive & (exact >= least[:, None])), len(c))
            best.take(i + rows.start, number[j], ~exact[i, j].astype(np.int64))  # ~ turns the order round for every 64-bit number
            return
        i, j = np.divmod(np.flatnonzero(alive), len(c))
        for at in range(0, len(i), _PAIRS):
            u, v = i[at : at + _PAIRS], j[at : at + _PAIRS]
            if levels:
                fine = np.einsum("ij,ij->i", self.levels[1][u + rows.start], levels[1][v]) >= floor[u]
                u, v = u[fine], v[fine]
            score = _products(q[u], c[v], largest[u])
            good = score >= least[u]
            best.take(u[good] + rows.start, number[v[good]], ~score[good])

    def found(self) -> tuple[np.ndarray, ...]:
        of, number, cost = self.best.all()
        own = _products(self.q, self.q, (self.q * self.q).sum(axis=1))
        return of, number, ~cost, (~cost == own[of]).astype(np.int64)


def exact_topk(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The k rows of the highest integer inner product with each query, ties to the smaller vec_id.

    Queries are the rows whose vec_id is divisible by `every`; candidates all rows of the same
    dimension but the query's own. Queries and candidates meet in groups that tasks stream
    (operators/meeting.py); a group yields k + 1 rows for each query, its own among
    them. Columns: query_id, rank from 1, vec_id, score. Rows that share an id with different
    vectors are queries of their own, each with ranks from 1; a repeated row is one query, and its
    repetitions are candidates. Scores beyond 64 bits count as the nearest 64-bit number, and tie. An empty
    table gives no row.
    """
    ready, chosen = quantised(vectors), F.pmod("vec_id", F.lit(every)) == 0
    total, n = vectors.select(F.count("*"), F.count(F.when(chosen, 1))).first()
    asked = ready.where(chosen).dropDuplicates()  # as few as one in `every`
    asked = asked.select(F.col("vec_id").alias("query_id"), F.xxhash64("vec_id", "v").alias("tag"), "v")
    rows, queries = CANDIDATES, QUERIES
    pairs = dealt(asked, ready.withColumnRenamed("vec_id", "key"), n, total)
    schema = T.StructType().add("query_id", "long").add("tag", "long").add("vec_id", "long").add("score", "long").add("like", "long")
    part = met(pairs, lambda q, _: Search(q, k + 1, queries), schema, rows)
    part = part.select("query_id", "tag", "vec_id", "score", F.when(F.col("vec_id") == F.col("query_id"), F.col("like")).otherwise(0).alias("own"))
    best = Window.partitionBy("query_id", "tag").orderBy(F.col("score").desc(), "vec_id")
    first = part.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    # of the rows that are like the query's own, the first is taken for it
    told = first.withColumn("owns", F.sum("own").over(Window.partitionBy("query_id", "tag").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)))
    kept = told.where("own = 0 or owns > 1").withColumn("rank", (F.col("n") - F.least("owns", F.lit(1))).cast("int"))
    return kept.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
