"""Activity log: lists, filters, statistics and retention; staff directory."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.asof import day, moment, on_day, ts_lit
from tallybook.functions.text import has_term, search_any
from tallybook.ledger import Ledger
from tallybook.operators.paging import newest_first
from tallybook.plans.newest import newest_after_join


def recent_activity(led: Ledger, n: int = 10) -> DataFrame:
    """Newest entries of known users, with the role the user has now."""
    u = led.users.select(F.col("id").alias("_uid"), F.col("name").alias("user_name"), F.col("role").alias("_now"))

    def enrich(rows: DataFrame, small) -> DataFrame:
        return rows.join(u, rows["user_id"] == u["_uid"], "inner")

    return newest_after_join(led.logs, newest_first(), n, enrich).select(
        "id", "action", "created_at", "user_name", F.col("_now").alias("role")
    )


def log_entries(led: Ledger) -> DataFrame:
    """All entries with the role logged at the time; unknown users have a NULL name."""
    u = led.users.select(F.col("id").alias("_uid"), F.col("name").alias("user_name"))
    rows = led.logs.join(u, led.logs["user_id"] == u["_uid"], "left")
    return rows.select(
        "id",
        "user_id",
        "action",
        "role",
        "created_at",
        "user_name",
        F.coalesce("user_name", F.lit("System")).alias("shown_name"),
    )


def log_roles(logs: DataFrame) -> DataFrame:
    return logs.where("role is not null and role <> ''").select("role").distinct().orderBy("role")


def search_logs(entries: DataFrame, term: str | None) -> DataFrame:
    return search_any(entries, ["user_name", "action", "role"], term)


def filter_logs(
    entries: DataFrame,
    role: str | None = None,
    action: str | None = None,
    period: str | None = None,
    as_of: str | date | datetime | None = None,
) -> DataFrame:
    """``login``/``logout`` match as substrings, other actions exactly.  ``today`` and
    ``yesterday`` are calendar days, ``week`` and ``month`` the last 7 and 30 days to the instant."""
    if role:
        entries = entries.where(F.col("role") == role)
    if action in ("login", "logout"):
        entries = entries.where(has_term(F.col("action"), action))
    elif action:
        entries = entries.where(F.col("action") == action)
    if period:
        at, today = F.col("created_at"), day(as_of)
        rules = {
            "today": on_day(at, today),
            "yesterday": on_day(at, today - timedelta(days=1)),
            "week": at >= ts_lit(moment(as_of) - timedelta(days=7)),
            "month": at >= ts_lit(moment(as_of) - timedelta(days=30)),
        }
        entries = entries.where(rules[period])
    return entries


def activity_stats(logs: DataFrame, as_of: str | date | datetime, approximate: bool = False) -> DataFrame:
    """Totals and distinct users, ever and today.

    Counting per user first makes both distinct counts plain sums over one row
    per user: a single shuffle, and a busy user is reduced before it.
    ``approximate`` skips that shuffle.
    """
    at = F.col("created_at")
    today = on_day(at, day(as_of))
    last_hour = at >= ts_lit(moment(as_of) - timedelta(hours=1))
    if approximate:
        return logs.agg(
            F.count("*").alias("total_logs"),
            F.count_if(today).alias("today_count"),
            F.count_if(last_hour).alias("recent_count"),
            F.approx_count_distinct("user_id").alias("unique_users"),
            F.approx_count_distinct(F.when(today, F.col("user_id"))).alias("unique_users_today"),
        )
    per_user = logs.groupBy("user_id").agg(
        F.count("*").alias("n"), F.count_if(today).alias("t"), F.count_if(last_hour).alias("h")
    )
    known = F.col("user_id").isNotNull()
    zero = F.lit(0)
    return per_user.agg(
        F.coalesce(F.sum("n"), zero).alias("total_logs"),
        F.coalesce(F.sum("t"), zero).alias("today_count"),
        F.coalesce(F.sum("h"), zero).alias("recent_count"),
        F.count("user_id").alias("unique_users"),
        F.count_if(known & (F.col("t") > 0)).alias("unique_users_today"),
    )


def retain_logs(logs: DataFrame, as_of: str | date | datetime, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(kept rows, one-row deleted_count).  Rows without a time are kept."""
    old = F.col("created_at") < ts_lit(moment(as_of) - timedelta(days=days))
    kept = logs.where(F.coalesce(~old, F.lit(True)))
    return kept, logs.where(old).agg(F.count("*").alias("deleted_count"))


def cashier_directory(users: DataFrame, state: str | None = None, term: str | None = None) -> DataFrame:
    rows = users.where(F.col("role") == "cashier")
    if state in ("active", "inactive"):
        rows = rows.where(F.col("is_active") == F.lit(state == "active"))
    rows = search_any(rows, ["name", "email"], term)
    return rows.select("id", "name", "email", "is_active", "created_at").orderBy(*newest_first())


def cashier_counts(users: DataFrame) -> DataFrame:
    return users.where(F.col("role") == "cashier").agg(
        F.count("*").alias("total"),
        F.count_if("is_active").alias("active"),
        F.count_if(~F.col("is_active")).alias("inactive"),
    )
