"""Rows ``skip+1 .. skip+n`` of a total order."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.plans.ordered import BLOCK, POS, range_blocks

DEEP_ROWS = 100_000
ROW_BITS = 33  # a position is the block number above the row number within the block


def slice_rows(
    df: DataFrame, order: Sequence[Column], skip: int, n: int, deep_rows: int = DEEP_ROWS, blocks: int | None = None
) -> DataFrame:
    """Near the front a top-k does it: each task keeps skip+n rows.

    Further back that would bring everything before the page into one task.
    There the rows are range-cut and sorted within their blocks; the block
    sizes, one number per block, say which rows of which blocks are meant.
    """
    if skip + n <= deep_rows:
        return df.orderBy(*order).offset(skip).limit(n)
    blocks = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = range_blocks(df, [], order, blocks)
    sizes = dict(cut.groupBy(BLOCK).count().collect())
    row = F.col(POS).bitwiseAND(2**ROW_BITS - 1)
    start, wanted = 0, []
    for block in sorted(sizes):
        low, high = max(skip - start, 0), min(skip + n - start, sizes[block])
        if low < high:
            wanted.append((F.col(BLOCK) == block) & (row >= low) & (row < high))
        start += sizes[block]
    kept = cut.where(reduce(or_, wanted) if wanted else F.lit(False))
    return kept.orderBy(POS).drop(BLOCK, POS)
