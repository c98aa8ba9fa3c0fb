import math
import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import vector_topk


def brute(rows, k=5, every=50):
    ready = []
    for n, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ready.append((n, i, [math.floor(256 * float(np.float32(x))) for x in v]))
    out, seen = [], set()
    for n, q, v in ready:
        if q % every or (q, tuple(v)) in seen:
            continue
        seen.add((q, tuple(v)))
        held = lambda x: max(min(x, 2**63 - 1), -(2**63))
        scored = sorted((-held(sum(a * b for a, b in zip(v, w, strict=True))), c) for m, c, w in ready if m != n and len(w) == len(v))[:k]
        out += [(q, r, c, -s) for r, (s, c) in enumerate(scored, 1)]
    return sorted(out)


def run(df, **k):
    return sorted(map(tuple, vector_topk.exact_topk(df, **k).select("query_id", "rank", "vec_id", "score").collect()))


def test_topk_by_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(24)]) for i in range(400)]
    rows += [(400 + i, rows[3][1]) for i in range(40)]  # ties
    rows += [(1000, None), (1001, [float("nan")] * 24), (1002, [None] * 24), (1003, [float("inf")] + [0.0] * 23), (None, [0.1] * 24), (1050, [0.0] * 24), (1051, [0.5] * 3), (1100, [0.25, -1.0, 9.0]), (1150, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    assert run(df) == brute(rows)
    monkeypatch.setattr(vector_topk, "CANDIDATES", 37)
    monkeypatch.setattr(vector_topk, "QUERIES", 3)
    assert run(df) == brute(rows)
    assert run(df.limit(0)) == []


def test_bounds_hold():
    rng = np.random.default_rng(0)
    x, y = rng.normal(0, 50, (20, 30)).round(), rng.normal(0, 50, (25, 30)).round()
    exact, last = x @ y.T, None
    for s in vector_topk.RESOLUTIONS:
        bound = vector_topk.statistics(x, s) @ vector_topk.statistics(y, s).T
        assert (bound >= exact - 1e-6).all()
        last = bound if last is None else last
    assert (vector_topk.statistics(x, 16) @ vector_topk.statistics(y, 16).T).mean() < last.mean()  # finer is tighter


def test_large_components_are_exact(spark):
    rows = [(0, [1e5, -2e5, 3.5]), (1, [1e5, 1e5, 0.1]), (2, [-1e5, 3e5, 0.2])]
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == brute(rows)
    rows = [(0, [1e6, 1.0]), (1, [1e6, 2.0]), (2, [1e6, -3.0])]
    assert run(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == brute(rows)
    assert brute(rows)[0] == (0, 1, 1, 65536000000131072)
    rng = random.Random(7)
    for size in (1e7, 1e9, 1e15, 1e30):
        rows = [(i, [rng.uniform(-size, size) for _ in range(6)]) for i in range(60)] + [(100, [1.0] * 6)]
        assert run(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) == brute(rows)


def test_only_the_own_row_is_no_candidate(spark, monkeypatch):
    rng = random.Random(3)
    some = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(20)]
    rows = [(rng.choice([0, 50, 100, 7, 8]), rng.choice(some)) for _ in range(80)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert run(df) == brute(rows)
    monkeypatch.setattr(vector_topk, "CANDIDATES", 7)
    assert run(df) == brute(rows)


def test_tiles_and_groups_change_nothing(spark, monkeypatch):
    from millrace.operators import meeting

    rng = random.Random(5)
    some = [[rng.gauss(0, 0.3) for _ in range(16)] for _ in range(150)]
    rows = [(10 * i, rng.choice(some)) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for name, value in (("BLOCK", 17), ("SHARE", 100)):
        monkeypatch.setattr(meeting, name, value)
    monkeypatch.setattr(vector_topk, "CANDIDATES", 50)
    monkeypatch.setattr(vector_topk, "QUERIES", 4)
    assert run(df) == brute(rows)


def test_nothing_is_broadcast(spark):
    """Queries were copied to every share and then broadcast: the driver held them as often as there are shuffle partitions."""
    df = spark.range(3000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda j: F.sin(F.col("id") * j).cast("float")).alias("embedding"))
    found = vector_topk.exact_topk(df)
    assert found.count() == 60 * 5
    found.collect()
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()
