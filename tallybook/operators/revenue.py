"""Revenue by calendar month."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.asof import add_months, date_lit, day, month_start
from tallybook.plans.totals import zero


def monthly_revenue(
    payments: DataFrame, as_of: str | date | datetime, months: int = 12, zero_fill: bool = True
) -> DataFrame:
    """Sum per month of payments dated from ``as_of`` minus ``months`` on.

    The raw form has no upper bound and can begin with a partial month.  The
    zero-filled form is exactly the last ``months`` calendar months.
    """
    today = day(as_of)
    since = date_lit(add_months(today, -months))
    month = F.trunc("payment_date", "month")
    sums = (
        payments.where(F.col("payment_date") >= since)
        .groupBy(month.alias("month_start"))
        .agg(F.sum("amount_paid").alias("monthly_total"))
    )
    if not zero_fill:
        return _labelled(sums)
    first, last = month_start(today, 1 - months), month_start(today)
    spine = payments.sparkSession.range(1).select(
        F.explode(
            F.sequence(date_lit(first), date_lit(last), F.expr("interval 1 month"))
        ).alias("month_start")
    )
    filled = spine.join(sums, "month_start", "left").withColumn(
        "monthly_total", F.coalesce("monthly_total", zero())
    )
    return _labelled(filled)


def _labelled(df: DataFrame) -> DataFrame:
    return df.select(
        F.year("month_start").alias("year"), F.month("month_start").alias("month"), "monthly_total"
    ).orderBy("year", "month")
