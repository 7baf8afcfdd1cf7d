"""Repeatable randomness: every draw is a function of (seed, row key), so any engine can reproduce it and a lost
task recomputes the same rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int | str, *parts: Column) -> Column:
    """32 hex digits that depend only on the seed and the key parts."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[part.cast("string") for part in parts]))


def draw_number(hexed: Column, at: int = 1) -> Column:
    """Eight hex digits from position `at`, as a whole number below 2**32."""
    return F.conv(F.substring(hexed, at, 8), 16, 10).cast("long")


def draw_below(hexed: Column, limit, at: int = 1) -> Column:
    """A whole number from 0 to limit - 1."""
    return draw_number(hexed, at) % limit


def draw_unit(hexed: Column, at: int = 1) -> Column:
    """A number in [0, 1)."""
    return draw_number(hexed, at) / F.lit(4294967296.0)
