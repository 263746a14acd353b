"""Payment lists, filters, collections and statements."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.asof import date_lit, day, in_month, on_day, ts_lit
from tallybook.functions.status import status_expr
from tallybook.functions.text import full_name, method_label
from tallybook.ledger import Ledger
from tallybook.operators.paging import newest_first
from tallybook.plans.newest import counted_small, matching, newest_after_join
from tallybook.plans.ordered import HOT_ROWS, Running, running_values
from tallybook.plans.skew import one_per_key
from tallybook.plans.totals import zero, paid_by_student, with_course


# ---- filters ---------------------------------------------------------------


def filter_payments_quick(df: DataFrame, choice: str, as_of: str | date | datetime) -> DataFrame:
    """Quick filters by calendar date; ``week``/``month`` reach back 7/30 days, inclusive."""
    paid_on, today = F.col("payment_date"), day(as_of)
    rules: dict[str, Column] = {
        "all": F.lit(True),
        "today": paid_on == date_lit(today),
        "week": paid_on >= date_lit(today - timedelta(days=7)),
        "month": paid_on >= date_lit(today - timedelta(days=30)),
        "cash": F.col("payment_method") == "cash",
    }
    return df.where(rules[choice])


def filter_payments(
    df: DataFrame,
    date_from: date | str | None = None,
    date_to: date | str | None = None,
    method: str | None = None,
    status: str | None = None,
    min_amount: float | None = None,
    max_amount: float | None = None,
    course_id: int | None = None,
) -> DataFrame:
    """Any mix of inclusive bounds.  Amounts compare with amounts and course ids
    with course ids; method names match with or without the underscore."""
    if date_from is not None:
        df = df.where(F.col("payment_date") >= date_lit(day(date_from)))
    if date_to is not None:
        df = df.where(F.col("payment_date") <= date_lit(day(date_to)))
    if method is not None:
        df = df.where(method_label(F.col("payment_method")) == method.lower().replace("_", " "))
    if status is not None:
        df = df.where(F.col("status") == status)
    if min_amount is not None:
        df = df.where(F.col("amount_paid") >= F.lit(str(min_amount)).cast("decimal(12,2)"))
    if max_amount is not None:
        df = df.where(F.col("amount_paid") <= F.lit(str(max_amount)).cast("decimal(12,2)"))
    if course_id is not None:
        df = df.where(F.col("course_id") == course_id)
    return df


# ---- lists -----------------------------------------------------------------


def _payer(students: DataFrame, *extra: str) -> DataFrame:
    return students.select(
        F.col("id").alias("_sid"),
        full_name().alias("student"),
        F.col("student_id").alias("student_number"),
        "course_id",
        *extra,
    )


def payment_lines(led: Ledger, courses: str = "left") -> DataFrame:
    """Payments with student and course; payments of unknown students are dropped."""
    who = with_course(_payer(led.students), led.courses, courses)
    p = led.payments
    return p.withColumnRenamed("student_id", "payer_id").join(
        who, F.col("payer_id") == who["_sid"], "inner"
    ).drop("_sid")


def export_payments(led: Ledger) -> DataFrame:
    """Report rows, newest first; the status compares this one payment with the price."""
    amount, price = F.col("amount_paid"), F.col("course_price")
    return (
        payment_lines(led)
        .orderBy(*newest_first())
        .select(
            F.col("created_at").alias("Date & Time"),
            F.col("student").alias("Student Name"),
            F.col("student_number").alias("Student ID"),
            F.col("course_name").alias("Course"),
            F.col("amount_paid").alias("Amount"),
            F.col("payment_method").alias("Method"),
            status_expr(amount, price, "per_payment").alias("Status"),
        )
    )


def _with_last_status(lines: DataFrame, totals: DataFrame) -> DataFrame:
    t = totals.withColumnRenamed("student_id", "_tid")
    rows = lines.join(t, F.col("payer_id") == t["_tid"], "inner")
    return rows.withColumn(
        "status",
        status_expr(
            F.col("total_paid"),
            F.col("course_price"),
            "last_payment",
            F.col("created_at") == F.col("last_paid_at"),
        ),
    )


def _last_paid() -> Column:
    return F.max("created_at").alias("last_paid_at")


def _history_columns(rows: DataFrame, users: DataFrame) -> DataFrame:
    u = users.select(F.col("id").alias("_uid"), F.col("name").alias("collector"))
    return rows.join(u, rows["collected_by"] == u["_uid"], "left").select(
        "id",
        "created_at",
        "student",
        "student_number",
        F.col("course_name").alias("course"),
        F.col("amount_paid").alias("amount"),
        F.col("payment_method").alias("method"),
        "status",
        "notes",
        F.col("collector").alias("collected_by"),
    )


def payment_history(led: Ledger) -> DataFrame:
    """Every payment with its status, notes and collector.

    Totals join the students first (one row each on both sides), so the
    payments themselves are shuffled once, on the student; a student with very
    many payments is split there by the adaptive skew join.
    """
    totals = paid_by_student(led.payments, _last_paid())
    who = with_course(_payer(led.students), led.courses)
    who = who.join(totals, who["_sid"] == totals["student_id"], "inner").drop("student_id")
    who = one_per_key(who, "_sid")
    p = led.payments.withColumnRenamed("student_id", "payer_id")
    rows = p.join(who, p["payer_id"] == who["_sid"], "inner").withColumn(
        "status",
        status_expr(
            F.col("total_paid"),
            F.col("course_price"),
            "last_payment",
            F.col("created_at") == F.col("last_paid_at"),
        ),
    )
    return _history_columns(rows, led.users)


def _enrich_few(led: Ledger, courses: str):
    """Looks up students, courses and totals of a few payments only."""

    def enrich(few: DataFrame, small) -> DataFrame:
        theirs = matching(led.payments, "student_id", few, "student_id")
        students = small(matching(led.students, "id", few, "student_id"))
        taken = matching(led.courses, "id", students, "course_id")
        lines = payment_lines(led.with_tables(payments=few, students=students, courses=taken), courses)
        return _with_last_status(lines, paid_by_student(theirs, _last_paid()))

    return enrich


def payment_history_page(led: Ledger, page: int = 1, per_page: int = 25) -> DataFrame:
    """A page of :func:`payment_history`, looking up only the rows near it."""
    rows = newest_after_join(
        led.payments, newest_first(), per_page, _enrich_few(led, "left"), skip=(page - 1) * per_page
    )
    users = matching(led.users, "id", counted_small(rows, per_page), "collected_by")
    return _history_columns(rows, users).orderBy(*newest_first())


def recent_payments_with_status(led: Ledger, n: int = 5) -> DataFrame:
    rows = newest_after_join(led.payments, newest_first(), n, _enrich_few(led, "inner"))
    return rows.orderBy(*newest_first()).select(
        "id",
        F.col("created_at").alias("time"),
        "student",
        F.col("amount_paid").alias("amount"),
        F.col("payment_method").alias("method"),
        "status",
    )


def recent_payments(led: Ledger, n: int = 5) -> DataFrame:
    """Newest payments whose student and collector are both known."""
    who = led.students.select(F.col("id").alias("_sid"), full_name().alias("student_name"))
    by = led.users.select(F.col("id").alias("_uid"), F.col("name").alias("cashier_name"))

    def enrich(p: DataFrame, small) -> DataFrame:
        rows = p.join(who, p["student_id"] == who["_sid"], "inner")
        return rows.join(matching(by, "_uid", p, "collected_by"), F.col("collected_by") == F.col("_uid"), "inner")

    return newest_after_join(led.payments, newest_first(), n, enrich).select(
        "id", "amount_paid", "payment_date", "created_at", "student_name", "cashier_name", "payment_method"
    )


def latest_payment(payments: DataFrame, ties: str = "one") -> DataFrame:
    """The last payment of each student: the greatest (created_at, id), or with
    ``ties="all"`` every payment made at the last instant."""
    if ties == "one":
        rest = [c for c in payments.columns if c not in ("created_at", "id", "student_id")]
        best = payments.groupBy("student_id").agg(
            F.max(F.struct("created_at", "id", *rest)).alias("last")
        )
        return best.select("student_id", "last.*").select(*payments.columns)
    if ties == "all":
        last = payments.groupBy(F.col("student_id").alias("_sid")).agg(F.max("created_at").alias("_at"))
        last = one_per_key(last, "_sid", "_at")
        same = (payments["student_id"] == last["_sid"]) & (payments["created_at"] == last["_at"])
        return payments.join(last, same, "left_semi")
    raise ValueError(f"unknown ties {ties!r}")


def student_statements(
    led: Ledger, ids: DataFrame | None = None, hot_rows: int = HOT_ROWS, blocks: int | None = None
) -> DataFrame:
    """Payments per student with running balance, total paid and balance.

    ``line`` 1 is the newest payment (payment_date, created_at, id descending).
    Students need a course and payments a known collector; the totals count
    only the payments listed.  ``balance_after`` is what was owed just after
    that payment.
    """
    students, payments = led.students, led.payments
    if ids is not None:
        want = ids.select(F.col("id").alias("_want"))
        students = students.join(want, F.col("id") == F.col("_want"), "left_semi")
        payments = payments.join(want, F.col("student_id") == F.col("_want"), "left_semi")
    by = led.users.select(F.col("id").alias("_uid"), F.col("name").alias("collected_by_name"))
    listed = payments.join(by, payments["collected_by"] == by["_uid"], "inner").drop("_uid")
    order = [F.col("payment_date").asc(), F.col("created_at").asc(), F.col("id").asc()]
    scanned = running_values(
        listed,
        ["student_id"],
        order,
        [
            Running("paid_to_date", "sum", F.col("amount_paid")),
            Running("nth", "count"),
            Running("total_paid", "sum", F.col("amount_paid"), whole=True),
            Running("n_payments", "count", whole=True),
        ],
        hot_rows,
        blocks,
        counted=payments,
    )
    who = one_per_key(with_course(_payer(students), led.courses, "inner"), "_sid")
    rows = scanned.join(who, scanned["student_id"] == who["_sid"], "inner")
    price = F.col("course_price")
    return rows.select(
        scanned["student_id"],
        "student",
        "student_number",
        "course_name",
        F.col("course_price").alias("total_fee"),
        (F.col("n_payments") - F.col("nth") + 1).alias("line"),
        F.col("id").alias("payment_id"),
        "payment_date",
        "amount_paid",
        "payment_method",
        "collected_by_name",
        (price - F.col("paid_to_date")).alias("balance_after"),
        "total_paid",
        (price - F.col("total_paid")).alias("balance"),
    )


# ---- sums ------------------------------------------------------------------


def _sum_count(amount: str, count: str) -> list[Column]:
    return [F.coalesce(F.sum("amount_paid"), zero()).alias(amount), F.count("*").alias(count)]


def collections_today(payments: DataFrame, as_of: str | date | datetime, by: Sequence[str] = ()) -> DataFrame:
    """Taken today by payment_date, over all collectors unless ``by`` groups them."""
    rows = payments.where(F.col("payment_date") == date_lit(day(as_of)))
    sums = _sum_count("total_collected", "payment_count")
    return rows.groupBy(*by).agg(*sums) if by else rows.agg(*sums)


def collections_month(
    payments: DataFrame, as_of: str | date | datetime, by: Sequence[str] = ("collected_by",)
) -> DataFrame:
    """Taken in the calendar month of ``as_of`` by payment_date, per collector."""
    rows = payments.where(in_month(F.col("payment_date"), day(as_of), date_lit))
    sums = _sum_count("total_monthly_collected", "monthly_payment_count")
    return rows.groupBy(*by).agg(*sums) if by else rows.agg(*sums)


def history_totals(payments: DataFrame, as_of: str | date | datetime) -> DataFrame:
    """Count and sum of all payments, and of today's and this month's by created_at."""
    at, today = F.col("created_at"), day(as_of)

    def total(rule: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(rule, F.col("amount_paid"))), zero()).alias(name)

    return payments.agg(
        F.count("*").alias("total_payments"),
        F.coalesce(F.sum("amount_paid"), zero()).alias("total_amount"),
        total(on_day(at, today), "todays_total"),
        total(in_month(at, today, ts_lit), "monthly_total"),
    )


def payment_method_mix(payments: DataFrame) -> DataFrame:
    """Whole-number percentages of cash, gcash and bank; other methods count in the base."""
    m = F.lower("payment_method")
    bucket = F.when(m == "cash", "cash").when((m == "gcash") | m.contains("maya"), "gcash")
    bucket = bucket.when(m.contains("bank"), "bank")
    n = payments.select(bucket.alias("b")).agg(
        *[F.count_if(F.col("b") == b).alias(b) for b in ("cash", "gcash", "bank")], F.count("*").alias("n")
    )
    one = F.explode(
        F.array(
            *[F.struct(F.lit(b).alias("method"), F.col(b).alias("payments")) for b in ("cash", "gcash", "bank")]
        )
    )
    share = F.bround(
        F.col("x.payments").cast("double") / F.greatest("n", F.lit(1)).cast("double") * 100, 0
    )
    return n.select(one.alias("x"), "n").select("x.method", "x.payments", share.cast("long").alias("percent"))


def collector_activity(led: Ledger) -> DataFrame:
    """Payments and amount per staff member, with the flag that blocks deletion."""
    sums = led.payments.groupBy("collected_by").agg(
        F.count("*").alias("n"), F.sum("amount_paid").alias("amount")
    )
    u = led.users
    return u.join(sums, u["id"] == sums["collected_by"], "left").select(
        "id",
        "name",
        "role",
        F.coalesce("n", F.lit(0)).alias("payments"),
        F.coalesce("amount", zero()).alias("amount_collected"),
        F.col("n").isNotNull().alias("has_payments"),
    )
