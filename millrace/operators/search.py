"""Search over indexed rows: filters, projections, sorting, exact nearest neighbours, aggregation.

Commands are Python objects, not text: a filter is built from `num`, `tag`, `text` and `everything`
with &, | and ~, and becomes one Column.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scalars, vectors
from .meeting import dealt, met


class SearchError(ValueError):
    """A query that its index cannot answer."""


class UnknownField(SearchError):
    pass


class DimensionMismatch(SearchError):
    pass


@dataclass(frozen=True)
class Field:
    """kind is TEXT, NUMERIC or TAG; a TAG is parted by one separator character."""

    kind: str
    separator: str = ","
    since: int | None = None  # a field added later knows rows written from then on

    def __post_init__(self):
        if self.kind not in ("TEXT", "NUMERIC", "TAG"):
            raise SearchError(f"{self.kind} fields are not supported")
        if len(self.separator) != 1:
            raise SearchError("a separator is one character")


@dataclass(frozen=True)
class SearchIndex:
    """Rows with a key column, declared fields and at most one vector column; other columns can be returned, sorted and grouped."""

    name: str
    rows: DataFrame
    key: str
    fields: dict[str, Field] = field(default_factory=dict)
    vector: str | None = None
    dim: int | None = None
    metric: str = "L2"
    prefixes: tuple[str, ...] = ()
    written: str | None = None  # the column that orders writes

    def field(self, name: str, kind: str) -> Field:
        known = self.fields.get(name)
        if known is None:
            raise UnknownField(f"no field {name} in index {self.name}")
        if known.kind != kind:
            raise SearchError(f"{name} is {known.kind}, not {kind}")
        return known

    def add_field(self, name: str, kind: str, since: int | None = None) -> SearchIndex:
        """A TEXT or TAG field for rows written from `since` on; older rows are not filled in."""
        if kind not in ("TEXT", "TAG"):
            raise SearchError(f"{kind} cannot be added")
        return replace(self, fields={**self.fields, name: Field(kind, since=since)})

    def info(self) -> DataFrame:
        spark = self.rows.sparkSession
        shape = [("index", self.name), ("key", self.key), ("vector", self.vector or ""), ("metric", self.metric), ("prefixes", ",".join(self.prefixes))]
        shape += [(f"field:{n}", f.kind) for n, f in sorted(self.fields.items())]
        return spark.createDataFrame(shape, "property string, value string").unionByName(self.rows.agg(F.count("*").cast("string").alias("value")).select(F.lit("rows").alias("property"), "value"))


class Catalog:
    """Indexes by name."""

    def __init__(self):
        self.indexes: dict[str, SearchIndex] = {}

    def create(self, index: SearchIndex) -> SearchIndex:
        if index.name in self.indexes:
            raise SearchError(f"index {index.name} exists")
        self.indexes[index.name] = index
        return index

    def names(self) -> list[str]:
        return sorted(self.indexes)

    def drop(self, name: str, with_rows: bool = False) -> DataFrame | None:
        """Removes the index; with_rows gives the keys whose rows go with it."""
        if name not in self.indexes:
            raise SearchError(f"no index {name}")
        gone = self.indexes.pop(name)
        return gone.rows.select(gone.key) if with_rows else None

    def route(self, key: Column) -> Column:
        """The index that a written key feeds: the first by name of those whose prefix it has."""
        out = F.lit(None).cast("string")
        for name in reversed(self.names()):
            index = self.indexes[name]
            if index.prefixes:
                some = F.lit(False)
                for p in index.prefixes:
                    some = some | key.startswith(p)
                out = F.when(some, name).otherwise(out)
        return out


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last written row of each key; it replaces the whole row."""
    w = Window.partitionBy(key).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


class Filter:
    def __and__(self, other: Filter) -> Filter:
        return _Both(self, other, "and")

    def __or__(self, other: Filter) -> Filter:
        return _Both(self, other, "or")

    def __invert__(self) -> Filter:
        return _Not(self)

    def column(self, index: SearchIndex) -> Column:
        """The condition; false where a row lacks the field, so that ~ is the complement in the index."""
        raise NotImplementedError

    def describe(self) -> str:
        raise NotImplementedError


def _known(index: SearchIndex, f: Field, condition: Column) -> Column:
    if f.since is not None and index.written:
        condition = condition & (F.col(index.written) >= f.since)
    return scalars.held(condition)


@dataclass(frozen=True)
class everything(Filter):
    def column(self, index):
        return F.lit(True)

    def describe(self):
        return "ALL"


@dataclass(frozen=True)
class num(Filter):
    """A numeric range; ends are inclusive unless said to be open, and may be infinite."""

    name: str
    low: float = float("-inf")
    high: float = float("inf")
    open_low: bool = False
    open_high: bool = False

    def column(self, index):
        f = index.field(self.name, "NUMERIC")
        kind = dict(index.rows.dtypes)[self.name]
        x = F.col(self.name) if kind in ("tinyint", "smallint", "int", "bigint") else scalars.numeric(F.col(self.name))
        out = x.isNotNull()
        if self.low != float("-inf"):
            out = out & ((x > self.low) if self.open_low else (x >= self.low))
        if self.high != float("inf"):
            out = out & ((x < self.high) if self.open_high else (x <= self.high))
        return _known(index, f, out)

    def describe(self):
        return f"NUMERIC {self.name} {'(' if self.open_low else '['}{self.low} {self.high}{')' if self.open_high else ']'}"


@dataclass(frozen=True)
class tag(Filter):
    """Rows with one of the values, case-sensitive."""

    name: str
    values: tuple[str, ...]

    def column(self, index):
        f = index.field(self.name, "TAG")
        return _known(index, f, F.arrays_overlap(scalars.tags(F.col(self.name), f.separator), F.array(*map(F.lit, self.values))))

    def describe(self):
        return f"TAG {self.name} {{{'|'.join(self.values)}}}"


@dataclass(frozen=True)
class text(Filter):
    """Rows whose text contains the characters."""

    name: str
    part: str

    def column(self, index):
        f = index.field(self.name, "TEXT")
        return _known(index, f, F.col(self.name).contains(self.part))

    def describe(self):
        return f"SUBSTRING {self.name} {self.part!r}"


@dataclass(frozen=True)
class _Both(Filter):
    a: Filter
    b: Filter
    how: str

    def column(self, index):
        a, b = self.a.column(index), self.b.column(index)
        return a & b if self.how == "and" else a | b

    def describe(self):
        return f"({self.a.describe()} {self.how.upper()} {self.b.describe()})"


@dataclass(frozen=True)
class _Not(Filter):
    a: Filter

    def column(self, index):
        return ~self.a.column(index)

    def describe(self):
        return f"NOT {self.a.describe()}"


def _sorted(rows: DataFrame, index: SearchIndex, by: str, descending: bool) -> list[Column]:
    """Numbers as numbers when the column is numeric, else as bytes; rows that lack the value last either way; ties by key."""
    if by not in rows.columns:
        raise UnknownField(by)
    c = F.col(by)
    return [c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(index.key)]


def _shaped(rows: DataFrame, index: SearchIndex, order: list[Column], offset: int, limit: int | None, returns: list[str] | None, extra: tuple[str, ...] = ()) -> DataFrame:
    rows = rows.orderBy(*order)
    if offset:
        rows = rows.offset(offset)
    if limit is not None:
        rows = rows.limit(limit)
    if returns is not None:
        rows = rows.select(index.key, *extra, *(c for c in returns if c in rows.columns and c != index.key and c not in extra))
    return rows


def search(index: SearchIndex, where: Filter = everything(), sort: str | None = None, descending: bool = False, offset: int = 0, limit: int | None = None, returns: list[str] | None = None, no_content: bool = False) -> DataFrame:
    """Rows that match, sorted (by key if not said otherwise), then cut, then projected. Unknown names in returns are ignored."""
    rows = index.rows.where(where.column(index))
    order = _sorted(rows, index, sort, descending) if sort else [F.col(index.key)]
    return _shaped(rows, index, order, offset, limit, [] if no_content else returns)


def nearest(index: SearchIndex, query: list[float], k: int, where: Filter = everything(), metric: str | None = None, returns: list[str] | None = None, sort: str | None = None, descending: bool = False, offset: int = 0, limit: int | None = None, no_content: bool = False) -> DataFrame:
    """The exact k nearest of the rows that match, with their distance as __vec_score; ties by key.

    Those k rows are then sorted (by distance if not said otherwise), cut and projected.
    """
    if not index.vector:
        raise SearchError(f"index {index.name} has no vector")
    if k <= 0:
        raise SearchError("k must be positive")
    if index.dim is not None and len(query) != index.dim:
        raise DimensionMismatch(f"{len(query)} components, not {index.dim}")
    rows = index.rows.where(where.column(index) & F.col(index.vector).isNotNull())
    rows = rows.withColumn("__vec_score", vectors.distance(metric or index.metric, F.col(index.vector), vectors.constant(query)))
    order = [F.col("__vec_score"), F.col(index.key)]
    if sort:
        rows = rows.orderBy(*order).limit(k)
        order = _sorted(rows, index, sort, descending)
    else:
        left = max(k - offset, 0)
        limit = left if limit is None else min(limit, left)
    return _shaped(rows, index, order, offset, limit, [] if no_content else returns, () if no_content else ("__vec_score",))


def merge_hits(parts: list[DataFrame], key: str, score: str, k: int) -> DataFrame:
    """Hits of several searches: the best score of each key, and of those the k best."""
    all_hits = parts[0]
    for p in parts[1:]:
        all_hits = all_hits.unionByName(p)
    return all_hits.groupBy(key).agg(F.min(score).alias(score)).orderBy(score, key).limit(k)


def nearest_batch(index: SearchIndex, queries: DataFrame, query_key: str, query_vector: str, k: int, metric: str | None = None) -> DataFrame:
    """The exact k nearest of each row of queries: query_key, rank, key, __vec_score; ties by key.

    Queries and rows meet in groups that tasks stream (meeting.py): block products tell the pairs
    that may count, and these get their distances as `vectors.distance` gives them, bit for bit but for the sign of a zero.
    """
    metric, ready = (metric or index.metric).upper(), lambda v: F.transform(v, lambda x: x.cast("double")).alias("v")
    if metric not in vectors.METRICS:
        raise ValueError(f"unknown metric {metric}")
    q = queries.where(F.col(query_vector).isNotNull()).select(F.col(query_key).alias("_q"), ready(F.col(query_vector)))
    rows = index.rows.where(F.col(index.vector).isNotNull()).select(F.col(index.key).alias("key"), ready(F.col(index.vector)))
    schema = T.StructType([T.StructField("_q", q.schema["_q"].dataType), T.StructField(index.key, rows.schema["key"].dataType), T.StructField("__vec_score", T.DoubleType())])
    scored = met(dealt(q, rows, q.count(), rows.count()), lambda x, odd: vectors.Neighbours(metric, x, odd, k), schema)
    w = Window.partitionBy("_q").orderBy("__vec_score", index.key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnRenamed("_q", query_key)


@dataclass(frozen=True)
class Reduce:
    """COUNT, or SUM or AVG of a field, as a column named `name`."""

    kind: str
    name: str
    source: str | None = None

    def column(self) -> Column:
        if self.kind == "COUNT":
            return F.count("*").alias(self.name)
        x = F.col(self.source).try_cast("double") if self.source else None
        if self.kind == "SUM":
            return F.coalesce(F.sum(x), F.lit(0.0)).alias(self.name)
        if self.kind == "AVG":  # over all rows of the group, with a number or not
            return (F.coalesce(F.sum(x), F.lit(0.0)) / F.count("*")).alias(self.name)
        raise SearchError(f"no reducer {self.kind}")


def aggregate(index: SearchIndex, by: list[str], reduces: list[Reduce], offset: int = 0, limit: int | None = None) -> DataFrame:
    """Groups of all indexed rows in byte order of their keys; a missing field groups as the empty string."""
    if not by:
        raise SearchError("group by one field at least")
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in by]
    out = index.rows.groupBy(*keys).agg(*(r.column() for r in reduces)).orderBy(*by)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def explain(index: SearchIndex, where: Filter, k: int | None = None) -> str:
    """What a search does, in words: the filter's tree, and the neighbours sought."""
    where.column(index)
    top = f"KNN {k} {index.vector} {index.metric}\n  " if k else ""
    return f"{top}{where.describe()}"
