"""Streaming forms of the stateful parts: merges, expiry, windows and throttling."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def counters(ops: DataFrame, key: str, delta: str) -> DataFrame:
    """Running counter values by key; for update or complete mode."""
    return ops.groupBy(key).agg(F.sum(delta).alias("value"), F.count("*").alias("ops"))


def window_latency(events: DataFrame, ts: str, value: str, every: str, late: str) -> DataFrame:
    """Counts and approximate percentiles of each window, closed when the watermark passes it."""
    out = events.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w")).agg(F.count("*").alias("n"), F.percentile_approx(value, [0.5, 0.95, 0.99], 1000).alias("q"))
    return out.select(F.col("w.start").alias("start"), "n", *(F.col("q")[i].alias(f"p{p}") for i, p in enumerate((50, 95, 99))))


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str) -> DataFrame:
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def registers(writes: DataFrame, key: str, value: str, ts: str) -> DataFrame:
    """Last writer wins by key, kept in state: rows come out when a key's value changes."""

    def merge(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get if state.exists else None
        for f in frames:
            for t, v in zip(f["ts"], f["value"], strict=True):
                if best is None or (int(t), str(v)) > best:
                    best = (int(t), str(v))
        state.update(best)
        yield pd.DataFrame({"key": [k[0]], "ts": [best[0]], "value": [best[1]]})

    shaped = writes.select(F.col(key).cast("string").alias("key"), F.unix_micros(ts).alias("ts"), F.col(value).cast("string").alias("value"))
    return shaped.groupBy("key").applyInPandasWithState(merge, "key string, ts long, value string", "ts long, value string", "update", GroupStateTimeout.NoTimeout)


def reaper(tombstones: DataFrame, key: str, ts: str, age_ms: int, late: str) -> DataFrame:
    """Keys whose tombstone has not been renewed for age_ms of event time, as the watermark passes."""

    def expire(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"key": [k[0]], "last_ms": [last]})
            return
        last = state.get[0] if state.exists else 0
        for f in frames:
            last = max(last, int(f["ms"].max()))
        state.update((last,))
        state.setTimeoutTimestamp(max(last + age_ms, state.getCurrentWatermarkMs() + 1))

    shaped = tombstones.withWatermark(ts, late).select(F.col(key).cast("string").alias("key"), F.unix_millis(ts).alias("ms"), ts)
    return shaped.groupBy("key").applyInPandasWithState(expire, "key string, last_ms long", "last_ms long", "append", GroupStateTimeout.EventTimeTimeout)


def throttle(requests: DataFrame, key: str, ts: str, rate_per_s: float, burst: float) -> DataFrame:
    """Token buckets by key: each request with whether it was let through. Requests of a batch are taken in time order."""

    def admit(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, None)
        rows = pd.concat(list(frames)).sort_values("ms")
        passed = []
        for ms in rows["ms"]:
            tokens = min(burst, tokens + (0 if last is None else max(0, ms - last) / 1000 * rate_per_s))
            last = int(ms) if last is None else max(last, int(ms))
            passed.append(tokens >= 1)
            tokens -= passed[-1]
        state.update((float(tokens), last))
        yield pd.DataFrame({"key": k[0], "ms": rows["ms"].to_numpy(), "passed": passed})

    shaped = requests.select(F.col(key).cast("string").alias("key"), F.unix_millis(ts).alias("ms"))
    return shaped.groupBy("key").applyInPandasWithState(admit, "key string, ms long, passed boolean", "tokens double, last long", "append", GroupStateTimeout.NoTimeout)


def upsert_batches(stream: DataFrame, path: str, key: str, order: str, checkpoint: str):
    """foreachBatch sink: each micro-batch's last row of a key is written under its batch number, so a batch that runs twice writes the same."""

    def write(batch: DataFrame, number: int) -> None:
        batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), order).alias("r")).select("r.*").write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True)
