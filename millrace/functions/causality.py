"""Interval tree clocks as JSON text: causality between stamps of any number of replicas.

An identity is 0, 1 or [left, right]; a history is a number or [number, left, right], the number
counting for the whole interval and each half adding its own. A stamp is [identity, history].
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = [1, 0]


def _id(i):
    return i[0] if isinstance(i, list) and i[0] == i[1] and not isinstance(i[0], list) else i


def _split(i):
    if i == 0:
        return 0, 0
    if i == 1:
        return [1, 0], [0, 1]
    left, right = i
    if left == 0 or right == 0:
        a, b = _split(right if left == 0 else left)
        return ([0, a], [0, b]) if left == 0 else ([a, 0], [b, 0])
    return [left, 0], [0, right]


def _merge(a, b):
    if a == 0 or b == 0:
        return b if a == 0 else a
    if not isinstance(a, list) or not isinstance(b, list):
        raise ValueError("identities overlap")
    return _id([_merge(a[0], b[0]), _merge(a[1], b[1])])


def _parts(e):
    return e if isinstance(e, list) else [e, 0, 0]


def _lift(e, n):
    return [e[0] + n, *e[1:]] if isinstance(e, list) else e + n


def _least(e):
    return e[0] + min(_least(e[1]), _least(e[2])) if isinstance(e, list) else e


def _most(e):
    return e[0] + max(_most(e[1]), _most(e[2])) if isinstance(e, list) else e


def _normal(e):
    """The same history with the least of both halves in its root."""
    if not isinstance(e, list):
        return e
    n, left, right = e
    if left == right and not isinstance(left, list):
        return n + left
    low = min(_least(left), _least(right))
    return [n + low, _lift(left, -low), _lift(right, -low)]


def fork(stamp):
    a, b = _split(stamp[0])
    return [a, stamp[1]], [b, stamp[1]]


def before(a, b) -> bool:
    """Whether history a is within history b at every point of the interval."""
    if not isinstance(b, list):
        return _most(a) <= b
    if not isinstance(a, list):
        return a <= _least(b)
    return all(before(_lift(x, a[0]), _lift(y, b[0])) for x, y in zip(a[1:], b[1:], strict=True))


def union(a, b):
    """The least history that both are within."""
    if not isinstance(a, list) and not isinstance(b, list):
        return max(a, b)
    (n, l1, r1), (m, l2, r2) = _parts(a), _parts(b)
    if n > m:
        (n, l1, r1), (m, l2, r2) = (m, l2, r2), (n, l1, r1)
    return _normal([n, union(l1, _lift(l2, m - n)), union(r1, _lift(r2, m - n))])


def join(a, b):
    return [_merge(a[0], b[0]), union(a[1], b[1])]


def _fill(i, e):
    if i == 0 or not isinstance(e, list):
        return e
    if i == 1:
        return _most(e)
    n, left, right = e
    if i[0] == 1:
        right = _fill(i[1], right)
        return _normal([n, max(_most(left), _least(right)), right])
    if i[1] == 1:
        left = _fill(i[0], left)
        return _normal([n, left, max(_most(right), _least(left))])
    return _normal([n, _fill(i[0], left), _fill(i[1], right)])


def _grow(i, e):
    """The history with one event more, and what it costs in depth."""
    if not isinstance(e, list):
        if i == 1:
            return e + 1, 0
        grown, cost = _grow(i, [e, 0, 0])
        return grown, cost + 1000
    n, left, right = e
    a = _grow(i[0], left) if i[0] != 0 else None
    b = _grow(i[1], right) if i[1] != 0 else None
    if b is None or (a is not None and a[1] < b[1]):
        return [n, a[0], right], a[1] + 1
    return [n, left, b[0]], b[1] + 1


def event(stamp):
    """The stamp after an event of its own; an identity of 0 can have none."""
    i, e = stamp
    if i == 0:
        raise ValueError("no authority for an event")
    filled = _fill(i, e)
    return [i, filled if filled != e else _normal(_grow(i, e)[0])]


def _order(a: str, b: str) -> str | None:
    if a is None or b is None:
        return None
    x, y = json.loads(a)[1], json.loads(b)[1]
    return {(True, True): "equal", (True, False): "before", (False, True): "after", (False, False): "concurrent"}[before(x, y), before(y, x)]


def relation(a: Column, b: Column) -> Column:
    """before, after, equal or concurrent for two columns of stamps as JSON text."""

    @F.pandas_udf(T.StringType())
    def apply(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_order(p, q) for p, q in zip(x, y, strict=True)])

    return apply(a, b)
