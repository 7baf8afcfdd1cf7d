"""Small column expressions shared by the operators. Everything here stays inside whole-stage code generation."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The whitespace that stripping removes.
WHITESPACE = " \t\n\r\x0b\x0c"


def named(name: str) -> Column:
    """Column by its exact name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def folded(value: Column) -> Column:
    """Stripped and lower-cased text."""
    return F.lower(strip(value))


def squeezed(value: Column) -> Column:
    """Text as near-duplicates see it: stripped, inner whitespace collapsed, lower-cased."""
    return F.lower(F.regexp_replace(strip(value), r"\s+", " "))


def count_when(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def share(part: Column, whole: Column) -> Column:
    """part / whole, null when there is nothing to divide by."""
    return F.when(whole != 0, part.cast("double") / whole)


def finite(value: Column) -> Column:
    """The number, with NaN and the infinities as null: one kind of missing."""
    number = value.cast("double")
    return F.when(F.isnan(number) | (F.abs(number) == F.lit(float("inf"))), None).otherwise(number)


def any_of(conditions: Iterable[Column]) -> Column:
    result = F.lit(False)
    for condition in conditions:
        result = result | F.coalesce(condition, F.lit(False))
    return result


def cells(columns: Iterable[str], value=None, keep=None) -> Column:
    """Array of (column, value) structs over the named columns, optionally only the cells `keep(name)` accepts.

    Explode it to get one row per cell without a shuffle; with `keep` only the wanted cells leave the row.
    """
    value = value or (lambda name: named(name).cast("string"))
    items = []
    for name in columns:
        item = F.struct(F.lit(name).alias("column"), value(name).alias("value"))
        items.append(F.when(keep(name), item) if keep else item)
    array = F.array(*items)
    return F.filter(array, lambda item: item.isNotNull()) if keep else array


def record_key(columns: Iterable[str]) -> list[Column]:
    """Two independent 64-bit hashes of a whole record, nulls counted as values.

    Grouping on 16 bytes instead of the record keeps the shuffle narrow on wide tables. Null flags are hashed
    too, because the hash functions skip nulls and would equate (null, 'a') with ('a', null).
    """
    columns = list(columns)
    parts = [named(name) for name in columns] + [named(name).isNull() for name in columns]
    return [F.xxhash64(F.lit(salt), *parts).alias(f"record_{salt}") for salt in (1, 2)]


def broadcast_checked(df, limit: int = 1_000_000):
    """Broadcast hint only when the table really is small; otherwise Spark shuffles. Count must be cheap (a written or
    already aggregated table)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df
