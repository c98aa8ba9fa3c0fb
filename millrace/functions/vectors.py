"""Distances between vectors and codecs for them. Smaller distances are closer."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def constant(vector: list[float]) -> Column:
    return F.array(*(F.lit(float(x)) for x in vector))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def euclidean(a: Column, b: Column) -> Column:
    gap = lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(F.zip_with(a, b, gap), F.lit(0.0), lambda s, x: s + x))


def cosine(a: Column, b: Column) -> Column:
    """1 - cos; 1 where a vector is zero."""
    both = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(both == 0, 1.0).otherwise(1.0 - dot(a, b) / both)


METRICS = {
    "L2": euclidean, "EUCLIDEAN": euclidean, "COSINE": cosine,
    "IP": lambda a, b: -dot(a, b), "DOTPRODUCT": lambda a, b: -dot(a, b), "DOT_PRODUCT": lambda a, b: -dot(a, b),
}


def distance(metric: str, a: Column, b: Column) -> Column:
    """By the metric's name; vectors of different lengths are infinitely far apart."""
    if metric.upper() not in METRICS:
        raise ValueError(f"unknown metric {metric}")
    return F.when(F.size(a) != F.size(b), float("inf")).otherwise(METRICS[metric.upper()](a, b))


#: Queries of a block product, and pairs whose distances are worked out at once.
_QUERIES, _PAIRS = 512, 20_000
_NULL, _LAST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _turned(cost: np.ndarray) -> np.ndarray:
    """Bits of doubles as integers in the doubles' order, and back."""
    return np.where(cost < 0, cost ^ _LAST, cost)


class Neighbours:
    """The n nearest of each query among the rows met so far, as `distance` and Spark's order tell: null first, NaN last, ties to the least number."""

    def __init__(self, metric: str, q: np.ndarray, nulls: np.ndarray, n: int):
        from ..operators.meeting import Best

        self.kind = {"L2": "L2", "EUCLIDEAN": "L2", "COSINE": "COSINE"}.get(metric, "IP")
        self.q, self.nulls, self.n, self.best = q, nulls, n, Best(len(q), n)
        self.plain, self.norm, self.odd = self._prepared(q, nulls)

    def _prepared(self, x: np.ndarray, nulls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows for block products, their norms, and the odd ones: null, zero, not finite or of extreme size. Odd rows meet all others exactly."""
        with np.errstate(all="ignore"):
            norm = np.sqrt((x * x).sum(axis=1))
            odd = nulls | ~((norm > 1e-70) & (norm < 1e70))
            plain, norm = np.where(odd[:, None], 0.0, x), np.where(odd, 1.0, norm)
            return plain / norm[:, None] if self.kind == "COSINE" else plain, norm, odd

    def _exact(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of the columns of a and b, their terms summed in the order of the components."""

        def total(terms) -> np.ndarray:
            out = np.zeros(a.shape[1])
            for t in terms:
                out += t
            return out

        with np.errstate(all="ignore"):
            if self.kind == "L2":
                return np.sqrt(total((x - y) * (x - y) for x, y in zip(a, b, strict=True)))
            dots = total(x * y for x, y in zip(a, b, strict=True))
            if self.kind == "IP":
                return -dots
            both = np.sqrt(total(x * x for x in a) * total(y * y for y in b))
            return np.where(both == 0, 1.0, 1.0 - dots / both)

    def meet(self, number: np.ndarray, c: np.ndarray, nulls: np.ndarray) -> None:
        plain, norm, odd = self._prepared(c, nulls)
        across, widest = np.ascontiguousarray(c.T), norm.max(initial=0)
        for lo in range(0, len(self.q), _QUERIES):
            rows = slice(lo, lo + _QUERIES)
            near, own = -(self.plain[rows] @ plain.T), self.norm[rows]
            if self.kind == "L2":  # squares, less the query's own
                near = 2 * near + (norm * norm)[None, :]
            near[:, odd], near[self.odd[rows]] = np.inf, np.inf
            slack = {"COSINE": np.full(len(own), 1e-9), "IP": 1e-9 * own * widest, "L2": 1e-9 * (own * own + widest * widest)}[self.kind]
            full = self.best.count[rows] == self.n
            cost = self.best.cost[rows, self.n - 1]
            with np.errstate(all="ignore"):
                far = _turned(cost).view(np.float64)
                limit = {"COSINE": far - 1, "IP": far, "L2": far * far - own * own}[self.kind] + slack
            limit = np.where(cost == _NULL, -np.inf, np.where(full & ~np.isnan(limit), limit, np.inf))
            new = np.flatnonzero(~full)
            if new.size and len(c) >= self.n:
                limit[new] = np.partition(near[new], self.n - 1, axis=1)[:, self.n - 1] + 2 * slack[new]
            alive = near <= limit[:, None]
            alive[:, odd], alive[self.odd[rows]] = True, True
            i, j = np.divmod(np.flatnonzero(alive), max(1, len(c)))
            mine = np.ascontiguousarray(self.q[rows].T)
            for at in range(0, len(i), _PAIRS):
                u, v = i[at : at + _PAIRS], j[at : at + _PAIRS]
                d = self._exact(across[:, v], mine[:, u]) + 0.0
                cost = np.where(np.isnan(d), _LAST - 1, _turned(d.view(np.int64)))
                self.best.take(u + lo, number[v], np.where(self.nulls[rows][u] | nulls[v], _NULL, cost))

    def found(self) -> tuple:
        of, number, cost = self.best.all()
        return of, number, pa.array(_turned(cost).view(np.float64), mask=cost == _NULL)


def int8_encode(v: Column) -> Column:
    """codes (0..255), least and step of a vector; a constant vector has step 0 and codes 0."""
    v = F.transform(v, lambda x: x.cast("double"))
    least, step = F.array_min(v), (F.array_max(v) - F.array_min(v)) / 255.0
    code = lambda x: F.when(step == 0, 0).otherwise(F.floor((x - least) / step + 0.5)).cast("int")
    return F.struct(F.transform(v, code).alias("codes"), least.alias("least"), step.alias("step"))


def int8_decode(e: Column) -> Column:
    return F.transform(e["codes"], lambda c: e["least"] + c * e["step"])


@F.pandas_udf(T.ArrayType(T.FloatType()))
def fp16_round_trip(v: pd.Series) -> pd.Series:
    """Each component as the nearest IEEE half, all of a batch in one cast; null vectors stay null."""
    there = v[v.notna()]
    if there.empty:
        return v
    halves = np.concatenate([np.asarray(x, np.float32) for x in there]).astype(np.float16).astype(np.float32)
    return pd.Series(np.split(halves, np.cumsum([len(x) for x in there])[:-1]), index=there.index, dtype=object).reindex(v.index)


def few_bit_encode(v: Column, bits: int = 4) -> Column:
    """Codes of `bits` bits between a vector's least and greatest component, two or more to a byte's room."""
    levels = float((1 << bits) - 1)
    v = F.transform(v, lambda x: x.cast("double"))
    least, step = F.array_min(v), (F.array_max(v) - F.array_min(v)) / levels
    return F.struct(F.transform(v, lambda x: F.when(step == 0, 0).otherwise(F.floor((x - least) / step + 0.5)).cast("tinyint")).alias("codes"), least.alias("least"), step.alias("step"))


@F.pandas_udf(T.BinaryType())
def float32_bytes(v: pd.Series) -> pd.Series:
    """A vector as little-endian 32-bit floats, one after another; null stays null."""
    return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())


def from_float32_bytes(payload: Column, dim: int) -> Column:
    """The vector that a payload of `dim` little-endian 32-bit floats holds; null for a null payload or one of another length."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def decoded(p: pd.Series) -> pd.Series:
        right = np.array([x is not None and len(x) == 4 * dim for x in p], bool)
        out = np.full(len(p), None, object)
        for i, row in zip(np.flatnonzero(right), np.frombuffer(b"".join(p[right]), "<f4").reshape(-1, dim), strict=True):
            out[i] = row
        return pd.Series(out)

    return decoded(payload)
