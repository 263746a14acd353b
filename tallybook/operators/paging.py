"""Pages over a total order.

``paginate`` is the 1-based offset page of the list views.  ``paginate_keyset``
starts after the last row seen, so page 1,000,000 costs the same as page 1.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.plans.slices import slice_rows


def newest_first() -> list[Column]:
    """The order of most lists; the id breaks ties."""
    return [F.col("created_at").desc(), F.col("id").desc()]


def paginate(df: DataFrame, order: Sequence[Column], page: int, per_page: int) -> DataFrame:
    return slice_rows(df, order, (page - 1) * per_page, per_page)


def page_meta(df: DataFrame, page: int, per_page: int, min_pages: int = 1) -> DataFrame:
    """One row of page counters.  ``min_pages=0`` is the log-list variant."""
    total = F.col("total")
    numbered = df.agg(F.count("*").alias("total")).select(
        "total",
        F.greatest(F.lit(min_pages), F.ceil(total / F.lit(per_page))).cast("long").alias("pages"),
    )
    some = total > 0
    has_prev = F.lit(page > 1) & some
    has_next = (F.lit(page) < F.col("pages")) & some
    start = F.lit((page - 1) * per_page)
    return numbered.select(
        F.lit(page).cast("long").alias("page"),
        F.lit(per_page).cast("long").alias("per_page"),
        "total",
        "pages",
        has_prev.alias("has_prev"),
        has_next.alias("has_next"),
        F.when(has_prev, F.lit(page - 1)).cast("long").alias("prev_num"),
        F.when(has_next, F.lit(page + 1)).cast("long").alias("next_num"),
        F.when(some, start + 1).otherwise(F.lit(0)).cast("long").alias("showing_from"),
        F.least(start + per_page, total).cast("long").alias("showing_to"),
    )


def _past(name: str, desc: bool, value: Any) -> Column:
    """Rows behind ``value`` in one ordering column; NULLs come first ascending and last descending."""
    column = F.col(name)
    if value is None:
        return F.lit(False) if desc else column.isNotNull()
    return (column < F.lit(value)) | column.isNull() if desc else column > F.lit(value)


def paginate_keyset(
    df: DataFrame, keys: Sequence[tuple[str, bool]], per_page: int, after: Sequence[Any] | None = None
) -> DataFrame:
    """``keys`` are (column, descending); ``after`` holds their values in the last row seen.

    NULL keys have a place like any other value, so the pages add up to the table.
    """
    if after is not None:
        steps = []
        for i, (name, desc) in enumerate(keys):
            same = [F.col(k).eqNullSafe(F.lit(v)) for (k, _), v in zip(keys[:i], after)]
            steps.append(reduce(and_, [*same, _past(name, desc, after[i])]))
        df = df.where(reduce(or_, steps))
    return df.orderBy(*[F.col(k).desc() if d else F.col(k).asc() for k, d in keys]).limit(per_page)
