"""Top-n rows after a join that may drop some of them, without joining everything.

The newest rows are cut from the fact table first (a per-task top-k, no
shuffle) with some slack, and only those are joined.  If the join keeps enough
of them the answer is exact, because every row left out sorts after them.  If
not, the cut is made ten times as long, and only when it would be deep the whole
table is joined; nothing is lost either way.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.plans.durable import durable
from tallybook.plans.ordered import BROADCAST_ROWS
from tallybook.plans.slices import DEEP_ROWS, slice_rows

SLACK_ROWS = 100
WIDER = 10


def matching(table: DataFrame, key: str, few: DataFrame, few_key: str) -> DataFrame:
    """Rows of ``table`` whose key occurs in ``few``; a broadcast hint on ``few`` carries over.

    Looking up a few rows this way scans the table without shuffling it.
    """
    want = few.select(F.col(few_key).alias("_want")).distinct()
    return table.join(want, F.col(key) == F.col("_want"), "left_semi")


def newest_after_join(
    facts: DataFrame,
    order: Sequence[Column],
    n: int,
    enrich: Callable[[DataFrame, Callable[[DataFrame], DataFrame]], DataFrame],
    skip: int = 0,
) -> DataFrame:
    """Rows ``skip+1 .. skip+n`` of ``enrich(facts)`` in ``order``.

    ``enrich(rows, small)`` may drop rows but must keep the ordering columns and
    must not multiply rows.  ``small`` marks what has at most as many rows as
    ``rows``; it asks for a broadcast only if those are a cut of at most DEEP_ROWS.
    """
    need = skip + n
    if need > DEEP_ROWS:
        return slice_rows(enrich(facts, _as_it_is), order, skip, n)
    cut = need + SLACK_ROWS
    while cut <= DEEP_ROWS + SLACK_ROWS:
        head = durable(facts.orderBy(*order).limit(cut))
        found = durable(enrich(F.broadcast(head), F.broadcast))
        if found.count() >= need or head.count() < cut:
            return found.orderBy(*order).offset(skip).limit(n)
        cut *= WIDER
    return enrich(facts, _as_it_is).orderBy(*order).offset(skip).limit(n)


def _as_it_is(df: DataFrame) -> DataFrame:
    return df


def counted_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` of at most ``rows`` rows: a broadcast side if that is few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
