"""Rounding and edge casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(name: str, alias: str | None = None) -> Column:
    """Money leaves the engine as DOUBLE; inside it stays DECIMAL."""
    return F.col(name).cast("double").alias(alias or name)


def percent(part: Column, whole: Column, digits: int) -> Column:
    """Half-even percentage; an empty whole counts as 1."""
    return F.bround(part.cast("double") / F.greatest(whole, F.lit(1)).cast("double") * 100, digits)
