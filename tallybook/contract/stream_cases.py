"""Streaming forms: the driver's files as streams, run until drained."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.contract.activity_cases import _throttle_sql, issues_and_attempts
from tallybook.contract.registry import Inputs, case
from tallybook.contract.write_cases import ADMISSION_WITH, no_payments
from tallybook.sources.fixtures import SOURCES, as_ledger_table, driver_path, driver_schema
from tallybook.streaming.jobs import admit_stream, match_stream, revenue_stream, throttle_stream
from tallybook.plans.durable import fresh_path
from tallybook.streaming.tables import count_files, instant, parquet_stream, run_to_end
from tallybook.streaming.windows import (
    running_activity,
    running_collections,
    stream_activity,
    stream_collections,
    stream_valid_attempts,
)


def raw_stream(x: Inputs, name: str) -> DataFrame:
    path = driver_path(x.sf_dir, name)
    return parquet_stream(x.spark, path, driver_schema(x.spark, path))


def ledger_stream(x: Inputs, table: str) -> DataFrame:
    return as_ledger_table(raw_stream(x, SOURCES[table]), table)


FILE_ROWS = 1_000_000


def in_files(x: Inputs, name: str, ts: str, parts: int = 3, file_rows: int = FILE_ROWS) -> DataFrame:
    """A driver table as a stream of ``parts`` micro-batches.

    They follow the time of the rows, but every third row comes up to an hour late.
    A part is written as equally many files as the others and read at once: files of
    one part that came in different micro-batches would be days late.
    """
    raw = x.raw(name)
    path = fresh_path(x.spark, f"files-{name}")
    at = F.unix_seconds(instant(F.col(ts)))
    low, high, rows = raw.agg(F.min(at), F.max(at), F.count("*")).first()
    files = max(1, -(-rows // (parts * file_rows)))
    arrival = at + F.when(F.pmod(F.hash(*raw.columns), F.lit(3)) == 0, 3600).otherwise(0)
    part = F.least(F.lit(parts - 1), F.floor((arrival - F.lit(low)) / F.lit(max(1, (high - low) // parts + 1))))
    for number in range(parts):
        of_part = raw.where(F.coalesce(part, F.lit(0)) == number)
        of_part.repartition(files, *raw.columns).write.mode("append").parquet(path)
        for _ in range(files * (number + 1) - count_files(x.spark, path)):  # no file was written for no rows
            x.spark.createDataFrame([], raw.schema).coalesce(1).write.mode("append").parquet(path)
    return parquet_stream(x.spark, path, raw.schema, files)


# windows that the final watermark (latest event minus the delay) has passed
_DAYS = """
days as (
  select date_trunc('day', created_at)::timestamp as window_start, collected_by, amount_paid from payments
  where date_trunc('day', created_at) + interval 1 day <= (select max(created_at) from payments) - interval 1 day)"""


@case(
    "stream_collections",
    """select window_start, sum(amount_paid)::double as total_collected, count(*) as payment_count
from days group by window_start""",
    _DAYS,
)
def _(x):
    return run_to_end(stream_collections(ledger_stream(x, "payments")), "collections")


@case(
    "stream_collections_by_collector",
    """select window_start, collected_by, sum(amount_paid)::double as total_collected, count(*) as payment_count
from days group by window_start, collected_by""",
    _DAYS,
)
def _(x):
    return run_to_end(stream_collections(ledger_stream(x, "payments"), ["collected_by"]), "collections")


@case(
    "stream_activity",
    """, hop as (select time_bucket(interval 5 minute, created_at) - k * interval 5 minute as window_start, user_id
          from logs cross join range(12) r(k))
select window_start, count(*) as log_count, count(distinct user_id) as unique_users from hop
where window_start + interval 1 hour <= (select max(created_at) from logs) - interval 10 minute
group by window_start""",
)
def _(x):
    return run_to_end(stream_activity(ledger_stream(x, "logs")), "activity")


@case(
    "stream_collections_running",
    """select date_trunc('day', created_at)::timestamp as window_start, sum(amount_paid)::double as total_collected,
       count(*) as payment_count from payments group by 1""",
)
def _(x):
    return running_collections(as_ledger_table(in_files(x, SOURCES["payments"], "l_shipdate"), "payments"))


@case(
    "stream_activity_running",
    """, hop as (select time_bucket(interval 5 minute, created_at) - k * interval 5 minute as window_start, user_id
          from logs cross join range(12) r(k))
select window_start, count(*) as log_count, count(distinct user_id) as unique_users from hop group by window_start""",
)
def _(x):
    return running_activity(as_ledger_table(in_files(x, SOURCES["logs"], "ts"), "logs"), late="2 hours")


@case(
    "stream_valid_attempts",
    """select a.user_id, a.event_id as id, a.ts from events a where a.event_type = 'purchase'
  and exists (select 1 from events i where i.event_type = 'signup' and i.user_id = a.user_id and i.ts <= a.ts
              and a.ts < i.ts + interval 1 day)""",
)
def _(x):
    columns = ["user_id", F.col("event_id").alias("id"), "ts"]
    issues = raw_stream(x, "events").where("event_type = 'signup'").select(*columns)
    attempts = raw_stream(x, "events").where("event_type = 'purchase'").select(*columns)
    return run_to_end(stream_valid_attempts(issues, attempts, ["user_id"], "1 day", "1 hour"), "attempts")


@case("stream_throttle", _throttle_sql("1 hour"), recursive=True)
def _(x):
    events = in_files(x, "events", "ts").select("event_id", "user_id", "ts")
    return throttle_stream(events, "user_id", "ts", "event_id", timedelta(hours=1), late=timedelta(hours=2))


@case(
    "stream_match_within_validity",
    """, iss as (select user_id, event_id % 3 as code, ts, event_id as id, event_id % 2 = 0 as resend from events where event_type = 'signup'),
last_one as (
  select a.user_id, a.event_id as id, a.ts,
         (select max((i.ts, i.id)) from iss i where i.user_id = a.user_id and i.code = a.event_id % 3 and i.ts <= a.ts) as li,
         (select max((z.ts, z.id)) from iss z where z.user_id = a.user_id and z.resend and z.ts <= a.ts) as lz
  from events a where a.event_type = 'purchase')
select user_id, id, ts, coalesce(ts < li[1] + interval 1 day and (lz is null or li >= lz), false) as valid from last_one""",
)
def _(x):
    issues, attempts = issues_and_attempts(in_files(x, "events", "ts"))
    no = F.lit(False)
    line = issues.withColumn("is_issue", F.lit(True)).unionByName(
        attempts.withColumns({"supersedes": no, "is_issue": no})
    )
    return match_stream(line, ["user_id"], "code", timedelta(days=1), late=timedelta(hours=2)).drop("issue_id", "code")


@case(
    "stream_admit_payments",
    "select id, student_id, amount::double as amount_paid, verdict from judged",
    ADMISSION_WITH,
    recursive=True,
)
def _(x):
    payments = as_ledger_table(in_files(x, SOURCES["payments"], "l_shipdate"), "payments")
    judged = admit_stream(payments, no_payments(x.led))
    return judged.select("id", "student_id", "amount_paid", "verdict")


@case(
    "stream_monthly_revenue",
    "select date_trunc('month', payment_date)::date as month_start, sum(amount_paid)::double as monthly_total from payments group by 1",
)
def _(x):
    return revenue_stream(as_ledger_table(in_files(x, SOURCES["payments"], "l_shipdate"), "payments"))
