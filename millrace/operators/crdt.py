"""Mergeable data types as aggregations over operation logs and states.

A merge is an aggregation that is commutative, associative and idempotent, so it combines on the
map side and a log may be read in any order and more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counter_states(ops: DataFrame, key: str, actor: str, delta: str) -> DataFrame:
    """Grow-only sums of each actor: (key, actor, pos, neg)."""
    d = F.col(delta)
    return ops.groupBy(F.col(key).alias("key"), F.col(actor).alias("actor")).agg(F.sum(F.when(d > 0, d).otherwise(0)).alias("pos"), F.sum(F.when(d < 0, -d).otherwise(0)).alias("neg"))


def counter_merge(states: DataFrame) -> DataFrame:
    """The greatest state of each actor."""
    return states.groupBy("key", "actor").agg(F.max("pos").alias("pos"), F.max("neg").alias("neg"))


def counter_value(states: DataFrame) -> DataFrame:
    return counter_merge(states).groupBy("key").agg((F.sum("pos") - F.sum("neg")).alias("value"))


def tagged(ops: DataFrame, order: list[str]) -> DataFrame:
    """Additions get a tag: the actor and its count so far. ops: key, element, actor, kind (add or remove), and order."""
    w = Window.partitionBy("key", "element", "actor").orderBy(*order)
    n = F.count(F.when(F.col("kind") == "add", 1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return ops.withColumn("tag", F.concat_ws(":", "actor", n.cast("string")))


def set_states(ops: DataFrame, order: list[str]) -> DataFrame:
    """(key, element, tag, kind): a removal removes every tag of its element that came before it."""
    t = tagged(ops, order)
    adds = t.where("kind = 'add'").select("key", "element", "tag", F.struct(*order).alias("at"))
    last = t.where("kind = 'remove'").groupBy("key", "element").agg(F.max(F.struct(*order)).alias("until"))
    removed = adds.join(last, ["key", "element"]).where(F.col("at") < F.col("until"))
    return adds.select("key", "element", "tag", F.lit("add").alias("kind")).unionByName(removed.select("key", "element", "tag", F.lit("remove").alias("kind")))


def set_value(states: DataFrame) -> DataFrame:
    """Elements with an added tag that no state has removed."""
    per_tag = states.groupBy("key", "element", "tag").agg(F.bool_or(F.col("kind") == "remove").alias("gone"))
    return per_tag.where("not gone").select("key", "element").distinct()


def delta_since(states: DataFrame, seq: str, acknowledged: int) -> DataFrame:
    """What a replica that acknowledged up to a sequence number still lacks."""
    return states.where(F.col(seq) > acknowledged)


def register_value(states: DataFrame, key: str, value: str, ts: str, actor: list[str]) -> DataFrame:
    """Last writer wins: the greatest (ts, actor, value); an unset actor loses to any."""
    order = F.struct(F.col(ts), *(F.coalesce(F.col(a).cast("string"), F.lit("")) for a in actor), F.col(value))
    return states.groupBy(F.col(key).alias("key")).agg(F.max_by(value, order).alias("value"), F.max(ts).alias("ts"))


def flag_value(states: DataFrame) -> DataFrame:
    """Enable wins: true where an enabling tag is left. states: key, tag, kind (enable or disable)."""
    per_tag = states.groupBy("key", "tag").agg(F.bool_or(F.col("kind") == "disable").alias("gone"))
    return per_tag.groupBy("key").agg(F.bool_or(~F.col("gone")).alias("value"))


def map_value(fields: DataFrame, values: dict[str, DataFrame]) -> DataFrame:
    """A map's fields (key, field, type, from set_value over their tags) with the merged value of each type as text.

    values maps a type to a DataFrame (key, field, value).
    """
    merged = None
    for kind, v in values.items():
        part = v.select("key", "field", F.lit(kind).alias("type"), F.col("value").cast("string").alias("value"))
        merged = part if merged is None else merged.unionByName(part)
    return fields.join(merged, ["key", "field", "type"], "left")


def cardinality(rows: DataFrame, key: list[str], member: str) -> DataFrame:
    """HyperLogLog estimates beside the exact counts; sketches of 2**14 registers merge by union."""
    sketches = rows.groupBy(*key).agg(F.hll_sketch_agg(member, 14).alias("sketch"), F.count_distinct(member).alias("exact"))
    return sketches.select(*key, F.hll_sketch_estimate("sketch").alias("estimate"), "exact")


def cardinality_union(sketches: DataFrame, sketch: str) -> DataFrame:
    return sketches.agg(F.hll_sketch_estimate(F.hll_union_agg(sketch)).alias("estimate"))


def clock(events: DataFrame, node: str, wall_ms: str, order: list[str]) -> DataFrame:
    """Hybrid logical stamps of a node's events: l is the greatest wall time so far, c counts events since l last rose."""
    w = Window.partitionBy(node).orderBy(*order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    with_l = events.withColumn("l", F.max(wall_ms).over(so_far))
    return with_l.withColumn("c", F.row_number().over(Window.partitionBy(node, "l").orderBy(*order)) - 1)


def clock_update(l: Column, c: Column, received_l: Column, received_c: Column, wall_ms: Column) -> tuple[Column, Column]:  # noqa: E741
    """A hybrid stamp (l, c) after a message: l is the greatest of the three times.

    c goes on from the counter of whichever stamp had that time, of the greater one if both had,
    and from 0 where the wall time is ahead.
    """
    new = F.greatest(l, received_l, wall_ms)
    ahead = [F.when(stamp == new, counter + 1) for stamp, counter in ((l, c), (received_l, received_c))]
    return new, F.coalesce(F.greatest(*ahead), F.lit(0))


def delta_join(states: DataFrame, delta: DataFrame) -> DataFrame:
    """The states of a set with a delta joined in; a delta that comes again, or whose tags are known, changes nothing."""
    return states.unionByName(delta).distinct()
