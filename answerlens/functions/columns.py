"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rate(part: Column, total: Column, digits: int = 6) -> Column:
    """part / total rounded, 0 where total is not positive."""
    return F.when(total > 0, F.round(part / total, digits)).otherwise(F.lit(0.0))


def percent(part: Column, total: Column) -> Column:
    """100 * part / total to two digits, null where total is not positive."""
    return F.when(total > 0, F.round(100.0 * part / total, 2))


def terms(c: Column, sep: str = ",") -> Column:
    """A separated list as an array of trimmed, lower-cased, non-empty strings; null gives an empty array."""
    each = F.transform(F.split(F.coalesce(c, F.lit("")), sep), lambda x: F.lower(F.trim(x)))
    return F.filter(each, lambda x: x != "")


def label_or(c: Column, *others: Column, default: str = "unknown") -> Column:
    """The first of the columns that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(x), F.lit("")) for x in (c, *others)], F.lit(default))
