"""One-row figures and the status breakdown of the two dashboards."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.asof import date_lit, day
from tallybook.functions.money import percent
from tallybook.functions.status import status_expr
from tallybook.ledger import Ledger
from tallybook.plans.totals import zero, with_course, with_paid

STATUSES = ("fully_paid", "partially_paid", "unpaid")


def side_by_side(*one_row: DataFrame) -> DataFrame:
    """One-row figures as the columns of one row."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), one_row)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def _active(df: DataFrame, name: str) -> DataFrame:
    return df.agg(F.count_if("is_active").alias(name))


def admin_kpis(led: Ledger) -> DataFrame:
    staff = F.col("is_active") & (F.col("role") == "cashier")
    return side_by_side(
        _active(led.students, "total_students"),
        _active(led.courses, "total_courses"),
        led.payments.agg(F.coalesce(F.sum("amount_paid"), zero()).alias("total_payments")),
        led.users.agg(F.count_if(staff).alias("total_active_cashiers")),
    )


def system_stats(led: Ledger, as_of: str | date | datetime) -> DataFrame:
    since = F.col("payment_date") >= date_lit(day(as_of) - timedelta(days=30))
    return side_by_side(
        _active(led.students, "total_students"),
        _active(led.courses, "total_courses"),
        _active(led.users, "total_users"),
        led.payments.where(since).agg(F.count("*").alias("recent_payments")),
        led.logs.agg(F.count("*").alias("total_logs")),
    )


def payment_status_breakdown(led: Ledger, scope: str = "admin") -> DataFrame:
    """Count and percentage per status.

    ``admin`` wants student and course active; ``cashier`` keeps inactive
    courses.  Statuses nobody has are listed with 0.
    """
    students = led.students.where(F.col("is_active"))
    courses = led.courses
    if scope == "admin":
        courses = courses.where(F.col("is_active"))
    elif scope != "cashier":
        raise ValueError(f"unknown scope {scope!r}")
    # the inner join drops students before their payments are looked at
    rows = with_paid(with_course(students, courses, "inner"), led.payments)
    status = status_expr(F.col("total_paid"), F.col("course_price"), "admin_dash")
    counts = rows.agg(*[F.count_if(status == s).alias(s) for s in STATUSES], F.count("*").alias("n"))
    listed = F.explode(
        F.array(*[F.struct(F.lit(s).alias("payment_status"), F.col(s).alias("students")) for s in STATUSES])
    )
    return counts.select(listed.alias("x"), "n").select(
        "x.payment_status", "x.students", percent(F.col("x.students"), F.col("n"), 1).alias("percent")
    )
