"""Object stores as tables: reading, versions, transactional batches, scans, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def put_latest(versions: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The object that each key holds after all puts and deletes: the last one, if it is no tombstone (kind = 'delete')."""
    w = Window.partitionBy(*by).orderBy(*(F.col(c).desc() for c in order))
    return versions.withColumn("_n", F.row_number().over(w)).where("_n = 1 and kind <> 'delete'").drop("_n")


def reap(tombstones: DataFrame, ts: str, now: Column, age: str) -> tuple[DataFrame, DataFrame]:
    """Tombstones older than the age, and the rest."""
    old = F.col(ts) < now - F.expr(f"interval {age}")
    return tombstones.where(old), tombstones.where(~old)


def apply_batches(table: DataFrame, batches: DataFrame, order: list[str]) -> DataFrame:
    """All-or-nothing batches (txn, kind, key, value, abort, order...): those with an abort in them leave no trace."""
    aborted = batches.groupBy("txn").agg(F.bool_or("abort").alias("_a"))
    good = batches.join(aborted, "txn").where("not _a")
    w = Window.partitionBy("key").orderBy(*(F.col(c).desc() for c in order))
    last = good.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    kept = table.join(last.select("key"), "key", "left_anti").select("key", "value")
    return kept.unionByName(last.where("kind = 'put'").select("key", "value"))


def scan_prefix(objects: DataFrame, bucket: str, prefix: str) -> DataFrame:
    """Objects of a bucket whose key has the prefix; the condition reaches the Parquet scan."""
    return objects.where((F.col("bucket") == bucket) & F.col("key").startswith(prefix))


def buckets(objects: DataFrame) -> DataFrame:
    return objects.select("bucket").distinct()


def keys(objects: DataFrame, bucket: str) -> DataFrame:
    return objects.where(F.col("bucket") == bucket).select("key").distinct()


def fields(objects: DataFrame, value: str, schema: str) -> DataFrame:
    """JSON objects' fields as columns; objects that are no JSON object are left out."""
    return objects.withColumn("_f", F.from_json(value, schema)).where(F.try_parse_json(value).isNotNull() & F.trim(value).startswith("{")).select("*", "_f.*").drop("_f")


def save(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    rows.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def report(rows: DataFrame, path: str) -> None:
    """A CSV report with a header."""
    rows.write.mode("overwrite").option("header", True).csv(path)
