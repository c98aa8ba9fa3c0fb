"""Suggestion dictionaries: a table (dict, suggestion, score, payload)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(ops: DataFrame) -> DataFrame:
    """The dictionary after all operations: columns dict, suggestion, seq, score, incr, payload.

    A plain addition replaces score and payload; an increment adds to the score and keeps the
    payload unless it brings one.
    """
    last = ops.groupBy("dict", "suggestion").agg(F.coalesce(F.max(F.when(~F.col("incr"), F.col("seq"))), F.lit(-1)).alias("_from"))
    live = ops.join(last, ["dict", "suggestion"]).where(F.col("seq") >= F.col("_from"))
    return live.groupBy("dict", "suggestion").agg(F.sum("score").alias("score"), F.max_by("payload", F.when(F.col("payload").isNotNull(), F.col("seq"))).alias("payload"))


def near_prefix(candidate: Column, prefix: str, k: int = 1) -> Column:
    """Whether some beginning of the candidate is within k edits of the prefix, up to k leading characters being free."""
    hit = F.lit(not prefix)
    for end in range(max(len(prefix) - k, 0), len(prefix) + k + 1):
        for first in range(min(k, end) + 1):
            part = F.substring(candidate, first + 1, end - first)
            # a part that the candidate is too short for is told by another end
            hit = hit | ((F.length(part) == end - first) & F.levenshtein(part, F.lit(prefix)).between(0, k))
    return hit


def get(entries: DataFrame, prefix: str, fuzzy: bool = False, most: int = 5) -> DataFrame:
    """The best suggestions that begin with the prefix (within one edit, if fuzzy), by score, then bytes."""
    if fuzzy:
        entries = entries.where(near_prefix(F.col("suggestion"), prefix))
    else:
        entries = entries.where(F.col("suggestion").startswith(prefix))
    return entries.orderBy(F.col("score").desc(), "suggestion").limit(most)


def delete(entries: DataFrame, gone: DataFrame) -> DataFrame:
    return entries.join(gone, ["dict", "suggestion"], "left_anti")


def length(entries: DataFrame) -> DataFrame:
    return entries.groupBy("dict").agg(F.count("*").alias("n"))
