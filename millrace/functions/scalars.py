"""Scalar expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text that counts as a number; try_cast alone takes more, such as a trailing type letter.
_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def numeric(text: Column) -> Column:
    """The trimmed text as a finite double, else null."""
    t = F.trim(text.cast("string"))
    n = F.when(t.rlike(_NUMBER), t.try_cast("double"))
    return F.when(F.abs(n) < float("inf"), n)


def tags(text: Column, separator: str = ",") -> Column:
    """The trimmed parts of a tag field."""
    return F.transform(F.split(text.cast("string"), rf"\Q{separator}\E"), lambda x: F.trim(x))


def six_places(x: Column) -> Column:
    """A number as text with six decimals, null as 0."""
    return F.when(x.isNull(), "0").otherwise(F.printf(F.lit("%.6f"), x))


def held(condition: Column) -> Column:
    """A condition that is false where it is null, so that its negation keeps rows that lack the field."""
    return F.coalesce(condition, F.lit(False))


def pack_clock(physical: Column, logical: Column) -> Column:
    """A hybrid logical clock as one number that sorts as the pair does."""
    return F.shiftleft(physical.cast("long"), 16) + logical.cast("long")


def unpack_clock(stamp: Column) -> tuple[Column, Column]:
    return F.shiftrightunsigned(stamp, 16), stamp.bitwiseAND(65535)


def epoch(ts: str, unit: str) -> Column:
    """Whole SECONDs, MILLISECONDs or MICROSECONDs from 1970 on of a column with or without time zone."""
    return F.expr(f"timestampdiff({unit}, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{ts}`)")


def great_circle_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine distance in metres on a sphere of 6372797.560856 m."""
    u, v = F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return 2.0 * 6372797.560856 * F.asin(F.sqrt(u * u + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * v * v))


def slice_bounds(start: int, stop: int, length: Column) -> tuple[Column, Column]:
    """An inclusive range that may count from the end, as a start from 0 and a length of at least 0."""
    at = lambda n: F.lit(n) if n >= 0 else F.greatest(length + n, F.lit(0)) if n == start else length + n
    first, last = at(start), F.least(at(stop), length - 1)
    return first, F.greatest(last - first + 1, F.lit(0))
