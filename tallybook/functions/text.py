"""Text predicates.

Search is a case-insensitive literal substring: ``%`` and ``_`` in a term mean
themselves.  ``collation="UNICODE_CI_AI"`` also ignores accents.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"  # fixed value


def full_name(first: str = "first_name", last: str = "last_name") -> Column:
    return F.concat(F.col(first), F.lit(" "), F.col(last))


def has_term(text: Column, term: str, collation: str | None = None) -> Column:
    if collation:
        return F.contains(F.collate(text, collation), F.collate(F.lit(term), collation))
    return F.lower(text).contains(term.lower())


def search_any(
    df: DataFrame, exprs: Sequence[Column | str], term: str | None, collation: str | None = None
) -> DataFrame:
    """Rows where any expression contains the term; an empty term keeps all rows."""
    term = (term or "").strip()
    if not term:
        return df
    cols = [F.col(e) if isinstance(e, str) else e for e in exprs]
    return df.where(reduce(or_, [has_term(c, term, collation) for c in cols]))


def search_rows(df: DataFrame, cols: Sequence[str], term: str | None) -> DataFrame:
    """Rows whose cell texts, read as one line, contain the term."""
    term = (term or "").strip()
    if not term:
        return df
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in cols])
    return df.where(has_term(line, term))


def method_label(method: Column) -> Column:
    return F.replace(F.lower(method), F.lit("_"), F.lit(" "))
