"""Stateful jobs as micro-batches of the batch operators.

A verdict here depends on everything before it, and one key may carry a third
of a batch.  Keyed state would put that key into one task; the batch operators
split it.  So each stretch of event time is judged by the batch operator, starting
from what the earlier ones left behind (:mod:`tallybook.streaming.order`); state
that can no longer matter is left out of what is carried on.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.ledger import Ledger
from tallybook.operators.admission import ACCEPTED, admit_against, open_accounts
from tallybook.operators.rates import match_within_validity, throttle
from tallybook.plans.durable import fresh_path
from tallybook.plans.skew import one_per_key
from tallybook.streaming.order import drain_in_order
from tallybook.streaming.tables import BatchTable, RunningSums, drain

MONEY = T.DecimalType(22, 2)


def _with(schema: T.StructType, *extra: T.StructField) -> T.StructType:
    return T.StructType([*schema.fields, *extra])


def admit_stream(
    payments: DataFrame,
    led: Ledger,
    base: str | None = None,
    compact: int = 20,
    ts: str = "created_at",
    late: timedelta = timedelta(days=1),
) -> DataFrame:
    """Admission of a stream of payments in the order of ``ts``; all verdicts so far.

    The open balances are taken from the ledger once, when the job is first
    started; a restart goes on from the same balances.
    """
    spark = payments.sparkSession
    base = base or fresh_path(spark, "admission")
    balances = BatchTable(spark, f"{base}/accounts", T.StructType([T.StructField("student_id", T.LongType()), T.StructField("open", MONEY)]))
    verdicts = BatchTable(spark, f"{base}/verdicts", _with(payments.schema, T.StructField("verdict", T.StringType())))
    spent = RunningSums(spark, f"{base}/spent", [T.StructField("student_id", T.LongType())], compact)

    def work(batch: DataFrame, number: int, until) -> None:
        if not balances.numbers():
            balances.write(open_accounts(led), 0)
        who = batch.select("student_id").distinct()
        accounts = balances.read().join(who, "student_id", "left_semi")
        so_far = spent.before(number, who)
        still = accounts.join(so_far, "student_id", "left").select(
            "student_id", (F.col("open") - F.coalesce("total", F.lit(0))).cast(MONEY).alias("open")
        )
        verdicts.write(admit_against(batch, still), number)
        accepted = verdicts.batch(number).where(F.col("verdict") == ACCEPTED)
        spent.add(accepted.groupBy("student_id").agg(F.sum("amount_paid").alias("total")), number)

    drain_in_order(payments, ts, late, work, base)
    return verdicts.read()


def throttle_stream(
    events: DataFrame,
    key: str,
    ts: str,
    id: str,
    min_gap: timedelta = timedelta(seconds=60),
    base: str | None = None,
    late: timedelta = timedelta(hours=1),
) -> DataFrame:
    """Throttled stream; all decisions so far.

    Only the last allowed event of each key, if it is younger than ``min_gap``,
    can still refuse anything: that is the whole state.
    """
    spark = events.sparkSession
    base = base or fresh_path(spark, "throttle")
    decided = BatchTable(spark, f"{base}/decided", _with(events.schema, T.StructField("allowed", T.BooleanType())))
    kind = T.StructType([T.StructField("_k", events.schema[key].dataType), T.StructField("_last", events.schema[ts].dataType)])
    clocks = BatchTable(spark, f"{base}/clocks", kind)

    def work(batch: DataFrame, number: int, until) -> None:
        clock = clocks.batch(number - 1)
        timed = batch.join(one_per_key(clock, "_k"), F.col(key).eqNullSafe(F.col("_k")), "left")
        soon = F.coalesce(F.col(ts) < F.col("_last") + F.lit(min_gap), F.lit(False))
        refused = timed.where(soon).select(*batch.columns, F.lit(False).alias("allowed"))
        rest = timed.where(~soon).select(*batch.columns)
        decided.write(throttle(rest, key, ts, id, min_gap).unionByName(refused), number)
        now = decided.batch(number).where("allowed").groupBy(F.col(key).alias("_k")).agg(F.max(ts).alias("_last"))
        now = now.unionByName(clock).groupBy("_k").agg(F.max("_last").alias("_last"))
        if until is not None:
            now = now.where(F.col("_last") > F.lit(until - min_gap))
        clocks.write(now, number)
        clocks.drop(before=number - 1)

    drain_in_order(events, ts, late, work, base)
    return decided.read()


def match_stream(
    line: DataFrame,
    keys: Sequence[str],
    code: str | None = None,
    ttl: timedelta = timedelta(minutes=10),
    base: str | None = None,
    late: timedelta = timedelta(hours=1),
) -> DataFrame:
    """Validity of attempts on a stream of issues and attempts (``is_issue``, ``supersedes``).

    Issues older than ``ttl`` cannot matter any more and are not carried on.
    """
    spark = line.sparkSession
    base = base or fresh_path(spark, "validity")
    shape = T.StructType([f for f in line.schema.fields if f.name != "is_issue"])
    issued = BatchTable(spark, f"{base}/issued", shape)
    tried = T.StructType(
        [f for f in shape.fields if f.name != "supersedes"]
        + [T.StructField("issue_id", line.schema["id"].dataType), T.StructField("valid", T.BooleanType())]
    )
    results = BatchTable(spark, f"{base}/results", tried)

    def work(batch: DataFrame, number: int, until) -> None:
        issues = issued.batch(number - 1).unionByName(batch.where("is_issue").select(*shape.names))
        results.write(match_within_validity(issues, batch.where("not is_issue"), keys, code, ttl), number)
        issued.write(issues if until is None else issues.where(F.col("ts") > F.lit(until - ttl)), number)
        issued.drop(before=number - 1)

    drain_in_order(line, "ts", late, work, base)
    return results.read()


def revenue_stream(payments: DataFrame, base: str | None = None, compact: int = 20) -> DataFrame:
    """Incremental revenue per calendar month: each batch adds its own month sums."""
    spark = payments.sparkSession
    base = base or fresh_path(spark, "revenue")
    sums = RunningSums(spark, base + "/sums", [T.StructField("month_start", T.DateType())], compact)

    def work(batch: DataFrame, number: int) -> None:
        month = F.trunc("payment_date", "month").cast("date").alias("month_start")
        sums.add(batch.groupBy(month).agg(F.sum("amount_paid").alias("total")), number)

    drain(payments, work, base)
    last = sums.parts.last()
    return sums.before(0 if last is None else last + 1).select("month_start", F.col("total").alias("monthly_total"))
