"""Load generators: keys and values of known distributions as DataFrames of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keys(spark: SparkSession, n: int, kind: str, space: int, seed: int = 1) -> DataFrame:
    """n keys below `space`: uniform, sequential, pareto (a fifth of the keys takes four fifths), normal, or fixed."""
    rows = spark.range(n)
    u = F.rand(seed)
    number = {
        "sequential": F.col("id") % space,
        "uniform": F.floor(u * space),
        "pareto": F.floor(F.least(F.pow(1.0 - u, F.lit(-1 / 1.16)) - 1.0, F.lit(space - 1.0))),
        "normal": F.greatest(F.least(F.floor(F.randn(seed) * (space / 6) + space / 2), F.lit(space - 1)), F.lit(0)),
        "fixed": F.lit(space),
    }[kind]
    return rows.select("id", number.cast("bigint").alias("key"))


def values(rows: DataFrame, kind: str, size: int, seed: int = 2) -> DataFrame:
    """rows with a value of fixed, uniform (up to size) or exponential (mean size) length."""
    u = F.rand(seed)
    n = {"fixed": F.lit(size), "uniform": F.floor(u * size) + 1, "exponential": F.ceil(-F.log(1.0 - u) * size)}[kind]
    return rows.withColumn("value", F.repeat(F.lit("x"), n.cast("int")))
