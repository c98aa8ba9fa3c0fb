"""Latency histograms with geometric buckets, windowed percentiles, and failure suspicion."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 94


def offsets(n: int = BUCKETS) -> list[int]:
    """1, then each 6/5 of the one before, rounded down, and one more where that does not rise."""
    out = [1]
    while len(out) < n:
        out.append(max(out[-1] * 6 // 5, out[-1] + 1))
    return out


def bucket_of(value: Column) -> Column:
    """The last bucket whose offset is at most the value; the first for values below 1."""
    at = F.array(*(F.lit(o).cast("long") for o in offsets()))
    return F.greatest(F.size(F.filter(at, lambda o: o <= value)) - 1, F.lit(0))


def offset_of(bucket: Column) -> Column:
    return F.element_at(F.array(*(F.lit(o).cast("long") for o in offsets())), (bucket + 1).cast("int"))


def histogram(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by, bucket, offset, n): counts merge by addition."""
    out = rows.where(F.col(value).isNotNull()).groupBy(*(by or []), bucket_of(F.col(value)).alias("bucket")).agg(F.count("*").alias("n"))
    return out.withColumn("offset", offset_of(F.col("bucket")))


def merge(histograms: DataFrame, by: list[str] | None = None) -> DataFrame:
    return histograms.groupBy(*(by or []), "bucket", "offset").agg(F.sum("n").alias("n"))


def percentiles(hist: DataFrame, ps: list[float], by: list[str] | None = None) -> DataFrame:
    """For each p the offset of the first bucket whose running count reaches floor(count p); 0 where that is 0.

    The greatest number, 2**63 - 1, stands for a histogram with counts in its last bucket.
    """
    by = by or []
    w = Window.partitionBy(*by)
    run = hist.withColumn("total", F.sum("n").over(w)).withColumn("over", F.max("bucket").over(w) == BUCKETS - 1)
    run = run.withColumn("so_far", F.sum("n").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda p: F.when(F.bool_or("over"), 2**63 - 1).when(F.floor(F.max("total") * p) == 0, 0).otherwise(F.min(F.when(F.col("so_far") >= F.floor(F.col("total") * p), F.col("offset"))))
    return run.groupBy(*by).agg(*(at(p).cast("long").alias(f"p{p * 100:g}".replace(".", "_")) for p in ps))


def mean(hist: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of the offsets and count; the mean is infinite for a histogram with counts in its last bucket."""
    out = hist.groupBy(*(by or [])).agg((F.sum(F.col("n") * F.col("offset")) / F.sum("n")).alias("mean"), F.sum("n").alias("count"), F.max("bucket").alias("_last"))
    return out.withColumn("mean", F.when(F.col("_last") == BUCKETS - 1, float("inf")).otherwise(F.col("mean"))).drop("_last")


def maximum(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """The greatest value as a whole number; 2**63 - 1 where it falls into the last bucket. Partial results merge by their maximum."""
    out = rows.where(F.col(value).isNotNull()).groupBy(*(by or [])).agg(F.max(value).alias("max"))
    return out.withColumn("max", F.when(bucket_of(F.col("max")) == BUCKETS - 1, 2**63 - 1).otherwise(F.col("max").cast("long")))


def windowed(events: DataFrame, ts: str, value: str, every: str, ps: list[float], error: Column | None = None) -> DataFrame:
    """Counts, errors and exact percentiles of each window."""
    wrong = F.count(F.when(error, 1)) if error is not None else F.lit(0)
    q = F.percentile(value, F.array(*map(F.lit, ps)))
    out = events.groupBy(F.window(ts, every).alias("w")).agg(F.count("*").alias("n"), wrong.alias("errors"), q.alias("q"), F.max(value).alias("max"))
    return out.select(F.col("w.start").alias("start"), "n", "errors", *(F.col("q")[i].alias(f"p{p * 100:g}".replace(".", "_")) for i, p in enumerate(ps)), "max")


def suspicion(beats: DataFrame, node: str, ms: str, order: list[str], last_n: int, least_mean_ms: float = 0.0) -> DataFrame:
    """phi of each heartbeat as it arrives: the wait over ln 10 times the mean of the last n intervals before it."""
    w = Window.partitionBy(node).orderBy(*order)
    gap = F.col(ms) - F.lag(ms).over(w)
    with_gap = beats.withColumn("gap", gap)
    known = F.greatest(F.avg("gap").over(w.rowsBetween(-last_n, -1)), F.lit(least_mean_ms))
    return with_gap.withColumn("mean_gap", known).withColumn("phi", F.when(F.col("gap").isNull() | F.col("mean_gap").isNull() | (F.col("mean_gap") <= 0), 0.0).otherwise(F.col("gap") / (F.col("mean_gap") * math.log(10))))
