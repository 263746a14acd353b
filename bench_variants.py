"""Compares the chosen plan of some reports with the plan their text suggests.

Same settings as bench.py; prints one JSON line with seconds per variant.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tallybook import local_session  # noqa: E402
from tallybook.functions.status import status_expr  # noqa: E402
from tallybook.operators.accounts import student_ledger  # noqa: E402
from tallybook.operators.admission import admit_payments  # noqa: E402
from tallybook.operators.dashboard import payment_status_breakdown  # noqa: E402
from tallybook.operators.payments import latest_payment, payment_history, payment_lines, student_statements  # noqa: E402
from tallybook.operators.revenue import monthly_revenue  # noqa: E402
from tallybook.plans.totals import with_course  # noqa: E402
from tallybook.sources.fixtures import fixture_ledger  # noqa: E402


def breakdown_after_fanout(led):
    s = with_course(led.students.where("is_active"), led.courses.where("is_active"), "inner")
    p = led.payments.select(F.col("student_id").alias("_sid"), "amount_paid")
    rows = s.join(p, F.col("id") == F.col("_sid"), "left").groupBy("id", "course_price")
    paid = rows.agg(F.coalesce(F.sum("amount_paid"), F.lit(0)).alias("paid"))
    return paid.groupBy(status_expr(F.col("paid"), F.col("course_price"), "admin_dash").alias("s")).count()


def latest_by_window(led):
    w = Window.partitionBy("student_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return led.payments.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def history_by_window(led):
    w = Window.partitionBy("payer_id")
    rows = payment_lines(led)
    return rows.withColumns({"total_paid": F.sum("amount_paid").over(w), "last": F.max("created_at").over(w)})


VARIANTS = {
    "status_breakdown: payments summed first": lambda led: payment_status_breakdown(led),
    "status_breakdown: join first, then group": breakdown_after_fanout,
    "monthly_revenue": lambda led: monthly_revenue(led.payments, "2000-06-15"),
    "student_ledger": lambda led: student_ledger(led),
    "latest_payment: max of a struct": lambda led: latest_payment(led.payments),
    "latest_payment: row_number window": latest_by_window,
    "payment_history: totals joined": lambda led: payment_history(led),
    "payment_history: totals by window": history_by_window,
    "student_statements": lambda led: student_statements(led),
    "admit_payments": lambda led: admit_payments(led.payments, led.with_tables(payments=led.payments.where("false"))),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    led = fixture_ledger(local_session(cpus, cpus), sf_dir)

    def once(build) -> float:
        start = time.perf_counter()
        build(led).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    out = {}
    for name, build in VARIANTS.items():
        once(build)
        out[name] = round(statistics.median(once(build) for _ in range(5)), 3)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
