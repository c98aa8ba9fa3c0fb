"""MapReduce over objects: a chain of phases, each a DataFrame operation.

A datum is a row (bucket, key, value), value being JSON text. Map phases work on each row, reduce
phases on all; a phase can be kept, and the kept phases' rows come out with their phase's number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Phase = Callable[[DataFrame], DataFrame]


def object_value(d: DataFrame) -> DataFrame:
    return d.select("value")


def object_value_list(d: DataFrame) -> DataFrame:
    """The elements of arrays; other values as they are; null gives nothing."""
    is_array = F.col("value").startswith("[")
    parts = F.when(is_array, F.from_json("value", "array<string>")).otherwise(F.array("value"))
    return d.where(F.col("value").isNotNull() & (F.col("value") != "null")).select(F.explode(parts).alias("value"))


def extract_field(name: str) -> Phase:
    """The field of each JSON object, as text; null where it is missing."""
    return lambda d: d.select(F.get_json_object("value", f"$['{name}']").alias("value"))


def identity(d: DataFrame) -> DataFrame:
    return d


def reduce_count(d: DataFrame) -> DataFrame:
    return d.agg(F.count("*").cast("string").alias("value"))


def reduce_sum(d: DataFrame) -> DataFrame:
    """The sum of numbers: integers stay so unless one has a fraction; overflow and text are errors; null is skipped; 0 of nothing."""
    v = F.trim("value")
    wrong = v.isNotNull() & (v != "null") & F.when(v.isNotNull(), ~v.rlike(r"^-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$")).otherwise(False)
    whole = F.when(v != "null", v.rlike(r"^-?[0-9]+$"))
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("not a number: "), v)).cast("string")).when(v == "null", None).otherwise(v)
    d = d.select(checked.alias("v"), whole.alias("whole"))
    out = d.agg(F.coalesce(F.bool_and("whole"), F.lit(True)).alias("whole"), F.coalesce(F.sum(F.when(F.col("whole"), F.col("v").cast("bigint"))), F.lit(0)).alias("i"), F.coalesce(F.sum(F.when(~F.col("whole"), F.col("v").cast("double"))), F.lit(0.0)).alias("f"))
    return out.select(F.when(F.col("whole"), F.col("i").cast("string")).otherwise((F.col("i") + F.col("f")).cast("string")).alias("value"))


def json_rank(v: Column) -> Column:
    """null, false and true, numbers, strings, arrays, objects."""
    c = F.substring(F.trim(v), 1, 1)
    return F.when(v.isNull() | (v == "null"), 0).when(v.isin("true", "false"), 1).when(c == "[", 4).when(c == "{", 5).when(v.try_cast("double").isNotNull() & (c != '"'), 2).otherwise(3)


def reduce_sort(d: DataFrame) -> DataFrame:
    v = F.col("value")
    return d.orderBy(json_rank(v), F.when(json_rank(v) == 2, v.try_cast("double")), v)


def reduce_set_union(order: list[str] | None = None) -> Phase:
    """Distinct values in the order in which they first occur; order names the columns that give it."""

    def run(d: DataFrame) -> DataFrame:
        by = order or ["value"]
        return d.groupBy("value").agg(F.min(F.struct(*by)).alias("_first")).orderBy("_first").select("value", *(F.col(f"_first.{c}").alias(f"first_{c}") for c in (order or [])))

    return run


def link_walk(d: DataFrame, objects: DataFrame, bucket: str | None = None, tag: str | None = None) -> DataFrame:
    """The objects that the links of the data's objects point to; d has links, an array of (bucket, key, tag)."""
    links = d.select(F.explode("links").alias("l")).select("l.*")
    if bucket is not None:
        links = links.where(F.col("bucket") == bucket)
    if tag is not None:
        links = links.where(F.col("tag") == tag)
    return links.join(objects, ["bucket", "key"])


def walk_edges(edges: DataFrame, objects: DataFrame, tag: str | None = None) -> DataFrame:
    """The same over an edge table (source_bucket, source_key, bucket, key, tag), without arrays."""
    edges = edges if tag is None else edges.where(F.col("tag") == tag)
    return edges.join(objects, ["bucket", "key"])


@dataclass(frozen=True)
class Step:
    run: Phase
    keep: bool = False


def job(inputs: DataFrame, steps: list[Step]) -> DataFrame:
    """phase and value of every kept phase and of the last."""
    kept, d = [], inputs
    for n, s in enumerate(steps):
        d = s.run(d)
        if s.keep or n == len(steps) - 1:
            kept.append(d.select(F.lit(n).alias("phase"), F.col("value").cast("string").alias("value")))
    out = kept[0]
    for d in kept[1:]:
        out = out.unionByName(d)
    return out


class Functions:
    """Named map and reduce functions of the user: map functions take and give Arrow batches' pandas frames."""

    def __init__(self):
        self.named: dict[str, Phase] = {}

    def register_map(self, name: str, run, schema: str) -> None:
        self.named[name] = lambda d: d.mapInPandas(lambda frames: (run(f) for f in frames), schema)

    def register(self, name: str, run: Phase) -> None:
        self.named[name] = run

    def __getitem__(self, name: str) -> Phase:
        return self.named[name]


def numbered(d: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their place in an order, for tests of sorted output."""
    return d.withColumn("pos", F.row_number().over(Window.orderBy(*by)))
