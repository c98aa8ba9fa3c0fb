"""Substring, regular-expression and approximate search over a text column."""

from __future__ import annotations

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def substring(rows: DataFrame, column: str, part: str) -> DataFrame:
    """Rows whose text contains the part; an empty part is in every text."""
    return rows.where(F.col(column).isNotNull() & F.col(column).contains(part))


def search_regex(rows: DataFrame, column: str, pattern: str, errors: int = 0) -> DataFrame:
    """Rows in which the pattern occurs, exactly or with at most `errors` edits."""
    return rows.where(T.matches(F.col(column), pattern)) if errors == 0 else approximate(rows, column, pattern, errors).drop("cost", "insertions", "deletions", "substitutions")


def approximate(rows: DataFrame, column: str, pattern: str, errors: int) -> DataFrame:
    """Rows in which the pattern occurs with at most `errors` edits, with the best match's edits.

    A plain pattern is tested first for one of its errors + 1 parts, which any match must contain
    whole; that test runs in the JVM. Only what passes goes to Python, in Arrow batches.
    """
    literal = pattern if not regex.search(r"[\\.^$*+?()\[\]{}|]", pattern) else None
    if literal:
        some = F.lit(False)
        for p in T.pieces(literal, errors) if len(literal) > errors else [""]:
            some = some | F.col(column).contains(p)
        rows = rows.where(some)
    source = f"(?b)(?:{pattern}){{e<={errors}}}"

    @F.pandas_udf("cost int, insertions int, deletions int, substitutions int")
    def best(t: pd.Series) -> pd.DataFrame:
        found = regex.compile(source)
        out = []
        for x in t:
            m = found.search(x) if x is not None else None
            s, i, d = m.fuzzy_counts if m else (None, None, None)
            out.append((s + i + d if m else None, i, d, s))
        return pd.DataFrame(out, columns=["cost", "insertions", "deletions", "substitutions"]).astype("Int32")

    return rows.withColumn("_match", best(F.col(column))).where("_match.cost is not null").select(*rows.columns, "_match.*")


def postings(rows: DataFrame, key: str, column: str) -> DataFrame:
    """Trigram postings: a row for each document and distinct trigram."""
    return rows.select(key, F.explode(T.trigrams(F.col(column))).alias("trigram"))


def candidates(posting: DataFrame, key: str, part: str) -> DataFrame:
    """Documents that hold all trigrams of the part, which has three characters at least."""
    wanted = sorted({part[i : i + 3] for i in range(len(part) - 2)})
    return posting.where(F.col("trigram").isin(wanted)).groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select(key)


def document_frequency(posting: DataFrame) -> DataFrame:
    return posting.groupBy("trigram").agg(F.count("*").alias("documents"))


def any_of(posting: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """Documents that hold one of the trigrams at least; none for an empty list."""
    return posting.where(F.col("trigram").isin(wanted) if wanted else F.lit(False)).select(key).distinct()


def preview(part: str, shown: int = 8) -> str:
    """The trigrams that a substring search would look up, the first few of them; a part under three characters is searched by a scan."""
    if len(part) < 3:
        return "<short-circuit: scan>"
    found = [f'"{part[i : i + 3]}"' for i in range(len(part) - 2)]
    return f"[{', '.join(found[:shown])}{', ...' if len(found) > shown else ''}]"
