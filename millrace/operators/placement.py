"""Placement of keys on a ring of tokens, replica plans, and slices of the hash space.

A ring is a small table of bounded size, at most MOST_POINTS points: what follows from it (owners,
replica lists, fallbacks) is worked out once for each point, and keys find their point by bisection.
"""

from __future__ import annotations

import hashlib
import itertools
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_POINTS = 100_000


def _points(ring: DataFrame) -> DataFrame:
    n = ring.count()
    if n > MOST_POINTS:
        raise ValueError(f"a ring of {n} points is too large")
    return ring


def _sorted_points(ring: DataFrame) -> list[tuple[int, str]]:
    return sorted((r["token"], r["peer"]) for r in _points(ring).select("token", "peer").collect())


def _place(hash_: str, tokens: list[int]) -> Column:
    """The number of the point that owns a hash: the least token at or above it, or the first; found by bisection in Arrow batches."""
    sorted_ = np.array(tokens, np.int64)

    @F.pandas_udf("int")
    def place(h: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(sorted_, h.to_numpy(np.int64), side="left") % max(1, len(sorted_))).astype(np.int32))

    return place(F.col(hash_).cast("long"))


def _onward(points: list[tuple[int, str]], n: int) -> list[list[str]]:
    """For every point the first n distinct peers from it clockwise, each list made from the next point's."""
    lists, after = [[]] * len(points), []
    for i in [*reversed(range(len(points)))] * 2:  # twice round, so that lists reach over the end
        peer = points[i][1]
        after = [peer, *(p for p in after if p != peer)][:n]
        lists[i] = after
    return lists


def _dealt(keys: DataFrame, hash_: str, points: list[tuple[int, str]], rows: list[tuple], schema: str) -> DataFrame:
    """keys joined with rows (place, ...) of the points that own them."""
    table = F.broadcast(keys.sparkSession.createDataFrame(rows, f"_place int, {schema}"))  # a row for each point and replica
    return keys.where(F.col(hash_).isNotNull()).withColumn("_place", _place(hash_, [t for t, _ in points])).join(table, "_place").drop("_place")


def owner(keys: DataFrame, hash_: str, ring: DataFrame) -> DataFrame:
    """keys with the peer that owns their hash: that of the least token at or above it, or the first. Keys without a hash have none and go."""
    points = _sorted_points(ring)
    return _dealt(keys, hash_, points, [(i, p) for i, (_, p) in enumerate(points)], "peer string")


def replicas(keys: DataFrame, key: str, hash_: str, ring: DataFrame, n: int) -> DataFrame:
    """The first n distinct peers clockwise from each key's hash: key, replica (from 0), peer."""
    points = _sorted_points(ring)
    rows = [(i, k, p) for i, peers in enumerate(_onward(points, n)) for k, p in enumerate(peers)]
    return _dealt(keys, hash_, points, rows, "replica int, peer string").select(key, "replica", "peer")


def preference(keys: DataFrame, key: str, hash_: str, ring: DataFrame, alive: list[str], n: int) -> DataFrame:
    """Primaries, with the next living peers as fallbacks for dead ones: key, place, peer, role.

    The list of a point is made once, not for each key: its living primaries, then the first living others.
    """
    points, up, rows = _sorted_points(ring), set(alive), []
    primaries = _onward(points, n)
    living = _onward([(t, p) for t, p in points if p in up], n + len(up)) if any(p in up for _, p in points) else []
    following, at = [], 0  # for every point the number of the first living point at or after it
    for _, p in points:
        following.append(at)
        at += p in up
    for i, mine in enumerate(primaries):
        first = [p for p in mine if p in up]
        rest = [p for p in living[following[i] % len(living)] if p not in mine] if living else []
        rows += [(i, k, p, "primary" if k < len(first) else "fallback") for k, p in enumerate([*first, *rest][:n])]
    return _dealt(keys, hash_, points, rows, "place int, peer string, role string").select(key, "place", "peer", "role")


def modula(keys: DataFrame, hash_: str, peers: list[str]) -> DataFrame:
    """keys with the peer of the hash's remainder by the number of peers, in their order."""
    table = F.array(*map(F.lit, peers))
    return keys.withColumn("peer", F.get(table, F.pmod(F.col(hash_), F.lit(len(peers))).cast("int")))


def ketama_points(spark: SparkSession, servers: list[tuple[str, int]], per_server: int = 160) -> DataFrame:
    """The continuum of weighted servers (name, weight): each MD5 of `name-i` gives four tokens of 32 bits, little-endian.

    A server's digests are as many as its share of the weights gives of per_server / 4 for each server, rounded down.
    """
    total, rows = sum(w for _, w in servers), []
    for name, weight in servers:
        for i in range(int(weight / total * (per_server / 4) * len(servers) + 1e-10)):
            rows += [(name, t) for t in struct.unpack("<4I", hashlib.md5(f"{name}-{i}".encode()).digest())]
    return spark.createDataFrame(rows, "peer string, token long")


def slice_owner(keys: DataFrame, hash_: str, slices: DataFrame) -> DataFrame:
    """keys with the peer whose half-open slice [low, high) holds their hash; slices: low, high, peer."""
    _points(slices)
    return keys.join(F.broadcast(slices), (F.col(hash_) >= F.col("low")) & (F.col(hash_) < F.col("high"))).drop("low", "high")


def random_slices(peers: list[str], space: int, weights: list[int] | None = None) -> list[tuple[int, int, str]]:
    """Slices that share the space out in the peers' order, evenly or by weight."""
    weights = weights or [1] * len(peers)
    ends = [0, *itertools.accumulate(weights)]
    cuts = [space * e // ends[-1] for e in ends]
    return [(cuts[i], cuts[i + 1], p) for i, p in enumerate(peers)]


def shaped_key(bucket: Column, key: Column, how: str = "bucket_key") -> Column:
    """What is hashed: the bucket and the key, or the bucket alone."""
    return F.concat_ws("/", bucket, key) if how == "bucket_key" else bucket


def coverage(ring: DataFrame) -> DataFrame:
    """Faults of a ring (rack, peer, token): tokens that two peers of a rack hold."""
    return ring.groupBy("rack", "token").agg(F.count_distinct("peer").alias("peers")).where("peers > 1")
