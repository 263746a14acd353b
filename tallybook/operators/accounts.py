"""Student accounts: lists, balances, ledgers and their summaries."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.asof import date_lit, day, moment, ts_lit
from tallybook.functions.status import status_expr, status_filter
from tallybook.functions.text import full_name, search_any
from tallybook.ledger import Ledger
from tallybook.operators.paging import newest_first, page_meta, paginate
from tallybook.plans.durable import durable
from tallybook.plans.newest import counted_small, matching
from tallybook.plans.totals import zero, accounts, with_course, with_paid

PROFILE = (
    "id", "student_id", "first_name", "last_name", "email", "phone", "address", "course_id",
    "enrollment_date", "is_active",
)


def filter_student_state(students: DataFrame, state: str = "active") -> DataFrame:
    if state == "active":
        return students.where(F.col("is_active"))
    if state == "inactive":
        return students.where(~F.col("is_active"))
    if state == "all":
        return students
    raise ValueError(f"unknown student state {state!r}")


def filter_course(df: DataFrame, course_id: int | None, column: str = "course_id") -> DataFrame:
    return df if course_id is None else df.where(F.col(column) == F.lit(course_id))


def search_students(df: DataFrame, term: str | None, scope: str = "admin", collation: str | None = None):
    """``admin`` looks at number, full name and e-mail; ``cashier`` at both names
    on their own, number and e-mail (so "Ann Lee" finds nobody); ``quick`` at
    number and full name."""
    fields: dict[str, list[Column | str]] = {
        "admin": ["student_id", full_name(), "email"],
        "cashier": ["first_name", "last_name", "student_id", "email"],
        "quick": ["student_id", full_name()],
    }
    return search_any(df, fields[scope], term, collation)


def student_accounts(led: Ledger) -> DataFrame:
    """One row per student with course and total paid; course columns may be NULL."""
    return accounts(led).select(*PROFILE, "created_at", "course_name", "course_price", "total_paid")


def filter_payment_status(df: DataFrame, status: str | None, policy: str) -> DataFrame:
    """Status filter over account rows (``total_paid``, ``course_price``)."""
    if not status:
        return df
    return df.where(status_filter(F.col("total_paid"), F.col("course_price"), status, policy))


def account_badges(led: Ledger) -> DataFrame:
    paid, price = F.col("total_paid"), F.col("course_price")
    return student_accounts(led).select(
        "id", "course_price", "total_paid", status_expr(paid, price, "admin_badge").alias("badge")
    )


def _listed_students(led, state, term, course_id) -> DataFrame:
    return filter_course(search_students(filter_student_state(led.students, state), term), course_id)


def student_account_page(
    led: Ledger,
    page: int = 1,
    per_page: int = 10,
    state: str = "active",
    term: str | None = None,
    course_id: int | None = None,
    status: str | None = None,
) -> DataFrame:
    """One page of the filtered account list, newest students first.

    Without a status filter the page is cut from the students alone and only
    its few rows meet the payments; a status filter needs every total first.
    """
    students = _listed_students(led, state, term, course_id)
    if status:
        kept = filter_payment_status(
            student_accounts(led.with_tables(students=students)), status, "admin_list"
        )
        return paginate(kept, newest_first(), page, per_page)
    shown = durable(paginate(students, newest_first(), page, per_page))
    few = counted_small(shown, per_page)
    theirs = matching(led.payments, "student_id", few, "id")
    courses = matching(led.courses, "id", few, "course_id")
    rows = student_accounts(led.with_tables(students=shown, payments=theirs, courses=courses))
    return rows.orderBy(*newest_first())


def student_account_page_meta(
    led: Ledger,
    page: int = 1,
    per_page: int = 10,
    state: str = "active",
    term: str | None = None,
    course_id: int | None = None,
    status: str | None = None,
) -> DataFrame:
    students = _listed_students(led, state, term, course_id)
    if status:
        students = filter_payment_status(
            student_accounts(led.with_tables(students=students)), status, "admin_list"
        )
    return page_meta(students, page, per_page)


def student_stats(led: Ledger) -> DataFrame:
    """Head counts and fee totals over active students, in one pass."""
    active = F.col("is_active")
    sums = accounts(led).agg(
        F.count_if(active).alias("active_students"),
        F.count_if(~active).alias("inactive_students"),
        F.count("*").alias("total_students"),
        F.coalesce(F.sum(F.when(active, F.col("course_price"))), zero()).alias("total_fees"),
        F.coalesce(F.sum(F.when(active, F.col("total_paid"))), zero()).alias("total_collected"),
    )
    fees, got = F.col("total_fees"), F.col("total_collected")
    rate = F.when(fees > 0, got.cast("double") / fees.cast("double") * 100).otherwise(F.lit(0.0))
    return sums.select(
        "*", (fees - got).alias("outstanding_balance"), rate.alias("collection_rate")
    )


def pending_balances(led: Ledger) -> DataFrame:
    """Active students with a course who still owe, and how much.

    Owing is Σ(price - paid) per student.  A fan-out join would count the price
    once per payment, so the totals are joined, not the payments.
    """
    active = led.students.where(F.col("is_active"))
    rows = accounts(led.with_tables(students=active), "inner")
    return rows.where(F.col("course_price") > F.col("total_paid")).select(
        "id",
        "student_id",
        "course_price",
        "total_paid",
        (F.col("course_price") - F.col("total_paid")).alias("balance"),
    )


def pending_totals(led: Ledger) -> DataFrame:
    return pending_balances(led).agg(
        F.coalesce(F.sum("balance"), zero()).alias("total_pending_amount"),
        F.count("*").alias("pending_count"),
    )


def student_ledger(
    led: Ledger,
    term: str | None = None,
    course_id: int | None = None,
    status: str | None = None,
) -> DataFrame:
    """Active students with fee, paid, balance, latest payment and status.

    The latest payment is the greatest (created_at, id), so tied payments
    neither split the student's row nor double the sum.
    """
    students = led.students.where(F.col("is_active"))
    students = filter_course(search_students(students, term, "cashier"), course_id)
    latest = F.max(F.struct("created_at", "id", "amount_paid")).alias("latest")
    rows = accounts(led.with_tables(students=students), "left", latest)
    rows = filter_payment_status(rows, status, "cashier_list")
    fee = F.coalesce("course_price", zero())
    return rows.select(
        "id",
        F.col("student_id").alias("sid"),
        full_name().alias("name"),
        "course_name",
        fee.alias("total_fee"),
        "total_paid",
        F.greatest(zero(), fee - F.col("total_paid")).alias("balance"),
        F.col("latest.created_at").alias("latest_payment_date"),
        F.col("latest.amount_paid").alias("latest_payment_amount"),
        status_expr(F.col("total_paid"), F.col("course_price"), "cashier_list").alias("status"),
        "created_at",
    )


def ledger_summary(led: Ledger) -> DataFrame:
    """Counts over active students; students without a fee are only in the total."""
    active = led.students.where(F.col("is_active"))
    rows = accounts(led.with_tables(students=active))
    paid, price = F.col("total_paid"), F.col("course_price")
    counts = [
        F.count_if(F.coalesce(status_filter(paid, price, s, "cashier_list"), F.lit(False))).alias(name)
        for s, name in (("paid", "fully_paid"), ("partial", "partially_paid"), ("unpaid", "unpaid"))
    ]
    return rows.agg(*counts, F.count("*").alias("total_students"))


def account_balances(led: Ledger, ids: DataFrame | None = None, few: int | None = None) -> DataFrame:
    """Due, paid and signed balance; NULL balance where there is no price.

    ``ids`` (one column ``id``) limits the students before the payments are
    summed; ``few`` says how many there are at most, and they are broadcast if
    that is few enough.
    """
    students, payments, courses = led.students, led.payments, led.courses
    if ids is not None:
        want = ids.select(F.col("id").alias("_want"))
        want = want if few is None else counted_small(want, few)
        students = students.join(want, F.col("id") == F.col("_want"), "left_semi")
        payments = payments.join(want, F.col("student_id") == F.col("_want"), "left_semi")
    if few is not None:
        courses = matching(courses, "id", counted_small(students, few), "course_id")
    return with_course(with_paid(students, payments), courses).select(
        "id",
        F.col("student_id").alias("sid"),
        full_name().alias("name"),
        F.col("course_name").alias("course"),
        F.col("course_price").alias("total_due"),
        "total_paid",
        (F.col("course_price") - F.col("total_paid")).alias("balance"),
        "is_active",
    )


def _balances_of_few(led: Ledger, students: DataFrame, n: int) -> DataFrame:
    return account_balances(led, durable(students.select("id")), few=n)


def recent_students(led: Ledger, n: int = 5) -> DataFrame:
    """Balances of the n newest active students (highest id)."""
    newest = led.students.where(F.col("is_active")).orderBy(F.col("id").desc()).limit(n)
    return _balances_of_few(led, newest, n).orderBy(F.col("id").desc())


def quick_search(led: Ledger, term: str) -> DataFrame:
    """The best match (highest id) for a number or full-name search; active or not."""
    hit = search_students(led.students, term, "quick").orderBy(F.col("id").desc()).limit(1)
    return _balances_of_few(led, hit, 1)


def payment_form(led: Ledger, ids: DataFrame) -> DataFrame:
    """Balances of active students with the form's status, which tests 'nothing paid' first."""
    rows = account_balances(led, ids).where("is_active")
    status = (
        F.when(F.col("total_paid") == 0, "unpaid")
        .when(F.col("total_paid") >= F.col("total_due"), "paid")
        .otherwise("partial")
    )
    return rows.withColumn("status", status)


def billing_snapshot(led: Ledger, as_of: str | date | datetime, term: str) -> DataFrame:
    """Billing rows as they stood at ``as_of``: what was known by then counts."""
    at = ts_lit(moment(as_of))
    then = led.with_tables(
        students=led.students.where(F.col("created_at") <= at),
        payments=led.payments.where(F.col("created_at") <= at),
    )
    due, paid = F.coalesce("course_price", zero()), F.col("total_paid")
    balance = due - paid
    status = F.when(balance <= 0, "paid").when(paid > 0, "partial").otherwise("unpaid")
    return accounts(then).select(
        F.col("id").alias("student_id"),
        F.lit(term).alias("billing_term"),
        due.alias("total_due"),
        balance.alias("balance"),
        status.alias("status"),
        date_lit(day(as_of)).alias("billing_date"),
    )


def write_billing_snapshot(led: Ledger, as_of, term: str, path: str) -> None:
    """Replaces only the partition of this term."""
    (
        billing_snapshot(led, as_of, term)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("billing_term")
        .parquet(path)
    )
