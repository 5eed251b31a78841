"""Missing and infinite values, ratios, label sets, null-safe joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)


def is_floating(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, FLOATING)


def missing(df: DataFrame, column: str) -> Column:
    """Null or NaN; only floating columns can hold NaN."""
    c = F.col(column)
    return c.isNull() | F.isnan(c) if is_floating(df, column) else c.isNull()


def infinite(df: DataFrame, column: str) -> Column:
    """Plus or minus infinity; false for null and NaN and for other types than floating."""
    return F.coalesce(F.abs(F.col(column)) == float("inf"), F.lit(False)) if is_floating(df, column) else F.lit(False)


def without_nan(df: DataFrame, column: str) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(column), F.col(column)) if is_floating(df, column) else F.col(column)


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0.0 if whole is zero."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def label_set(labels: Column, separator: str = "|") -> Column:
    """The sorted distinct non-null labels of a group as text."""
    return F.array_join(F.array_sort(F.collect_set(labels)), separator)


def count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def match_nulls(left: DataFrame, right: DataFrame, columns: list[str], how: str) -> DataFrame:
    """Join on columns with null equal to null; the right side's key columns don't come out.

    The null-safe equality is a key of an ordinary hash or sort-merge join.
    """
    renamed = right.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(columns)], *[c for c in right.columns if c not in columns])
    on = reduce(lambda a, b: a & b, [left[c].eqNullSafe(renamed[f"_k{i}"]) for i, c in enumerate(columns)])
    return left.join(renamed, on, how).drop(*[f"_k{i}" for i in range(len(columns))])


def display_hash(columns: list[str]) -> Column:
    """A 64-bit hash to show, never to decide by: nulls are marked, so a null doesn't vanish from it."""
    return F.xxhash64(*[e for c in columns for e in (F.col(c).isNull(), F.col(c))])
