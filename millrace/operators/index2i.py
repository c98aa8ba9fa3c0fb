"""Secondary indexes: (bucket, index, value, key) rows, equality and inclusive ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entries(objects: DataFrame, bucket: str, key: str, indexes: dict[str, str]) -> DataFrame:
    """Index rows of objects: indexes maps an index's name (ending in _int or _bin) to its column.

    An _int value is an unsigned number as DECIMAL(20,0), others are text.
    """
    out = None
    for name, column in sorted(indexes.items()):
        number = F.col(column).try_cast("decimal(20,0)") if name.endswith("_int") else F.lit(None).cast("decimal(20,0)")
        part = objects.select(F.lit(bucket).alias("bucket"), F.lit(name).alias("index"), F.when(number >= 0, number).alias("number"), F.col(column).cast("string").alias("value"), F.col(key).cast("string").alias("key"))
        part = part.where(F.col("number").isNotNull() if name.endswith("_int") else F.col("value").isNotNull())
        out = part if out is None else out.unionByName(part)
    return out


def equal(table: DataFrame, index: str, value) -> DataFrame:
    """Keys with the value, in key order."""
    side = "number" if index.endswith("_int") else "value"
    return table.where((F.col("index") == index) & (F.col(side) == F.lit(value))).select("key").orderBy("key")


def between(table: DataFrame, index: str, low, high, most: int | None = None) -> DataFrame:
    """Keys with values in the range, both ends included, ordered by the value's length, the value, the key."""
    side = "number" if index.endswith("_int") else "value"
    found = table.where((F.col("index") == index) & F.col(side).between(low, high))
    order = ["number"] if side == "number" else [F.octet_length("value"), "value"]
    found = found.orderBy(*order, "key")
    return (found if most is None else found.limit(most)).select(F.col(side).alias("value"), "key")
