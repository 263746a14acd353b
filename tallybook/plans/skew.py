"""Joins of many rows per key with one row per key.

The adaptive skew join splits a hot key's rows over several tasks, but only if
both inputs of the join come straight from a shuffle.  A side that was grouped
or joined on the same key beforehand keeps that partitioning, gets no shuffle of
its own, and so switches the splitting off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_per_key(df: DataFrame, *keys: str) -> DataFrame:
    """Gives the one-row-per-key side its own shuffle, small next to the other side.

    The keys keep their values, but as new expressions: the planner then no
    longer sees that the rows are partitioned by them.
    """
    return df.withColumns({k: F.when(F.col(k).isNotNull(), F.col(k)) for k in keys})
