"""Queries of the streaming operators: a stream over the Parquet tables is run until it has taken all there is."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import stateful
from .registry import query, table


def shared(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, or a temporary one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="millrace-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def finished(stream: DataFrame, mode: str) -> DataFrame:
    """What the stream gives for all its input, as a table: each batch is a Parquet folder by its number.

    A batch that is run again takes its own place. In complete mode the last batch is the whole table.
    """
    spark, schema = stream.sparkSession, stream.schema
    out, written = shared(spark, "stream-out"), set()

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{number}")
        written.add(number)

    run = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", shared(spark, "stream")).trigger(availableNow=True).start()
    run.awaitTermination()
    wanted = sorted(written)[-1:] if mode == "complete" else sorted(written)
    return spark.read.schema(schema).parquet(*(f"{out}/{number}" for number in wanted)) if wanted else spark.createDataFrame([], schema)


def event_stream(spark, sf_dir):
    rows = spark.readStream.schema(table(spark, sf_dir, "events").schema).option("pathGlobFilter", "*events*").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


@query("SELECT user_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN -1 ELSE 1 END) AS BIGINT) AS value, count(*) AS ops FROM events GROUP BY 1")
def stream_counters(spark, sf_dir):
    ops = event_stream(spark, sf_dir).withColumn("delta", F.when(F.col("event_type") == "purchase", -1).otherwise(1))
    return finished(stateful.counters(ops, "user_id", "delta"), "complete")


@query("SELECT CAST(user_id AS VARCHAR) AS key, CAST(epoch_us(max(ts)) AS BIGINT) AS ts FROM events GROUP BY 1")
def stream_registers(spark, sf_dir):
    changes = finished(stateful.registers(event_stream(spark, sf_dir), "user_id", "event_type", "ts"), "update")
    return changes.groupBy("key").agg(F.max("ts").alias("ts"))


@query()
def stream_window_latency(spark, sf_dir):
    return finished(stateful.window_latency(event_stream(spark, sf_dir), "ts", "value", "1 day", "1 hour"), "append")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 6 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
  SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start_us, CAST(epoch_us(max(ts) + INTERVAL 6 HOUR) AS BIGINT) AS end_us, count(*) AS n FROM s GROUP BY user_id, s.n HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT mark FROM m)""")
def stream_sessions(spark, sf_dir):
    closed = finished(stateful.sessions(event_stream(spark, sf_dir), "user_id", "ts", "6 hours", "1 hour"), "append")
    return closed.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


@query()
def stream_throttle(spark, sf_dir):
    return finished(stateful.throttle(event_stream(spark, sf_dir), "user_id", "ts", 0.0001, 5.0), "append")


@query("""WITH e AS (SELECT user_id, ts FROM events WHERE event_type = 'error'), m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM e)
  SELECT CAST(user_id AS VARCHAR) AS key, CAST(epoch_us(max(ts)) // 1000 AS BIGINT) AS last_ms FROM e GROUP BY user_id HAVING epoch_us(max(ts)) // 1000 + 86400000 < (SELECT epoch_us(mark) // 1000 FROM m)""")
def stream_reaper(spark, sf_dir):
    return finished(stateful.reaper(event_stream(spark, sf_dir).where("event_type = 'error'"), "user_id", "ts", 86_400_000, "1 hour"), "append")
