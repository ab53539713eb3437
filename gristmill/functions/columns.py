"""Small column helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_blank(c: Column | str) -> Column:
    """Whether a value is null or only spaces."""
    return F.trim(F.coalesce(as_column(c).cast("string"), F.lit(""))) == ""


def filled(c: Column | str, other: Column | str) -> Column:
    """``c``, or ``other`` where ``c`` is blank."""
    return F.when(is_blank(c), as_column(other)).otherwise(as_column(c))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def select_existing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Those of ``columns`` that ``df`` has."""
    return df.select(*[c for c in columns if c in df.columns])


def where_if_present(df: DataFrame, column: str, condition: Column) -> DataFrame:
    """Filter only where the column exists; older tables lack it."""
    return df.where(condition) if column in df.columns else df


def squeezed(c: Column | str) -> Column:
    """Runs of white space as one space, ends trimmed."""
    return F.trim(F.regexp_replace(as_column(c), r"(?U)\s+", " "))


def contains_any(c: Column | str, tokens: Iterable[str]) -> Column:
    """Whether a string holds any of the tokens."""
    found = F.lit(False)
    for token in tokens:
        found = found | as_column(c).contains(token)
    return found
