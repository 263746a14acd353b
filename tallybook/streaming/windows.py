"""Event-time windows: collection tiles and recent activity."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from datetime import timedelta
from math import gcd

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.streaming.tables import instant, run_updates, wall_time

# functions of this module go to the workers by value: they need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def stream_collections(
    payments: DataFrame, by: Sequence[str] = (), late: str = "1 day", size: str = "1 day", slide: str | None = None
) -> DataFrame:
    """Sum and count per window of created_at, optionally per collector.

    A window comes out once, when the watermark has passed its end; payments
    later than ``late`` are dropped.
    """
    span = F.window("at", size, slide)
    sums = (
        payments.withColumn("at", instant(F.col("created_at")))
        .withWatermark("at", late)
        .groupBy(span.alias("span"), *by)
        .agg(F.sum("amount_paid").alias("total_collected"), F.count("*").alias("payment_count"))
    )
    return sums.select(
        wall_time(F.col("span.start")).alias("window_start"), *by, "total_collected", "payment_count"
    )


#: Users of a window are kept in so many sets.
USER_BUCKETS = 32
#: Rows that a task packs at once.
PACK_ROWS = 1_000_000


def _micros(spark: SparkSession, text: str) -> int:
    return spark.sql(f"select interval {text}").first()[0] // timedelta(microseconds=1)


def _pane(at: Column, grid: int) -> Column:
    """Start of the pane, in microseconds.  Panes are so short that their rows fall into the same windows."""
    return F.unix_micros(at) - F.pmod(F.unix_micros(at), F.lit(grid))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one pane and bucket as one: their number, users and latest time."""

    def packed(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        users = ("user_id", "distinct", pc.CountOptions(mode="only_valid"))
        rows = pa.Table.from_batches(held).group_by(["pane", "bucket"]).aggregate([("at", "max"), ("at", "count"), users])
        return rows.select(["bucket", "at_max", "at_count", "user_id_distinct"]).rename_columns(["bucket", "at", "n", "users"]).to_batches()

    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= PACK_ROWS:
            yield from packed(held)
            held, count = [], 0
    if count:
        yield from packed(held)


def stream_activity(
    logs: DataFrame, size: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes", approximate: bool = False
) -> DataFrame:
    """Entries and distinct users per sliding window.

    The exact form packs the users of a pane into arrays before the windows
    multiply them, and keeps ``USER_BUCKETS`` lists of arrays per window instead of
    a state row per user and window; ``approximate`` keeps one sketch per window.
    """
    rows = logs.withColumn("at", instant(F.col("created_at")))
    span = F.window("at", size, slide).alias("span")
    if approximate:
        counts = rows.withWatermark("at", late).groupBy(span).agg(
            F.count("*").alias("log_count"), F.approx_count_distinct("user_id").alias("unique_users")
        )
    else:
        spark = logs.sparkSession
        pane = _pane(F.col("at"), gcd(_micros(spark, size), _micros(spark, slide)))
        bucket = F.pmod(F.xxhash64("user_id"), F.lit(USER_BUCKETS)).cast("int")
        placed = rows.where("at is not null").select("user_id", "at", pane.alias("pane"), bucket.alias("bucket"))
        kind = rows.schema["user_id"].dataType.simpleString()
        packs = placed.repartition("pane", "bucket").mapInArrow(_pack, f"bucket int, at timestamp, n long, users array<{kind}>")
        parts = packs.withWatermark("at", late).groupBy(span, "bucket").agg(
            F.sum("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("users")))).alias("users")
        )
        counts = parts.groupBy("span").agg(F.sum("n").alias("log_count"), F.sum("users").alias("unique_users"))
    return counts.select(wall_time(F.col("span.start")).alias("window_start"), "log_count", "unique_users")


def running_collections(
    payments: DataFrame, by: Sequence[str] = (), late: str = "1 day", size: str = "1 day", slide: str | None = None, path: str | None = None
) -> DataFrame:
    """:func:`stream_collections` as it stands now: today's sum as well as closed days."""
    return run_updates(stream_collections(payments, by, late, size, slide), ["window_start", *by], "collections", path)


def running_activity(
    logs: DataFrame, size: str = "1 hour", slide: str = "5 minutes", late: str = "10 minutes", path: str | None = None
) -> DataFrame:
    """:func:`stream_activity` as it stands now, the last hour included.

    The stream keeps entries per (pane, user), until the last window of the pane is
    ``late``; windows are summed up when they are read.  A user counts in a window with
    the first pane that lies in it, that is in the windows that begin after the user's
    pane before.
    """
    spark = logs.sparkSession
    length, step = _micros(spark, size), _micros(spark, slide)
    grid = gcd(length, step)
    wait = _micros(spark, late) + length - grid
    rows = logs.withColumn("at", instant(F.col("created_at"))).withWatermark("at", f"{wait} microseconds")
    per_user = rows.groupBy(F.window("at", f"{grid} microseconds").alias("span"), "user_id").agg(F.count("*").alias("n"))
    per_user = per_user.select(F.unix_micros("span.start").alias("pane"), "user_id", "n")
    now = run_updates(per_user, ["pane", "user_id"], "activity", path)
    earlier = F.lag("pane").over(Window.partitionBy("user_id").orderBy("pane"))
    before = F.greatest(F.coalesce(earlier, F.col("pane") - length), F.col("pane") - length)
    sums = now.withColumn("before", before).groupBy("pane", "before").agg(F.sum("n").alias("n"), F.count("user_id").alias("users"))
    last = F.col("pane") - F.pmod(F.col("pane"), F.lit(step))
    first = F.col("pane") - length + step - F.pmod(F.col("pane") - length, F.lit(step))
    begun = sums.select(F.explode(F.sequence(first, last, F.lit(step))).alias("start"), "before", "n", "users")
    new = F.when(F.col("start") > F.col("before"), F.col("users")).otherwise(0)
    counts = begun.groupBy("start").agg(F.sum("n").alias("log_count"), F.sum(new).alias("unique_users"))
    return counts.select(wall_time(F.timestamp_micros("start")).alias("window_start"), "log_count", "unique_users")


def stream_valid_attempts(
    issues: DataFrame, attempts: DataFrame, keys: Sequence[str], ttl: str = "10 minutes", late: str = "10 minutes"
) -> DataFrame:
    """Attempts with an issue of the same keys at most ``ttl`` older.

    A stream-stream semi join: each attempt comes out at most once, however
    many issues it matches.  Superseding issues need
    :func:`tallybook.streaming.jobs.match_stream`.
    """
    i = issues.select(*[F.col(k).alias(f"_{k}") for k in keys], instant(F.col("ts")).alias("issued"))
    a = attempts.withColumn("tried", instant(F.col("ts"))).withWatermark("tried", late)
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    within = [F.col("tried") >= F.col("issued"), F.col("tried") < F.col("issued") + F.expr(f"interval {ttl}")]
    rule = same[0]
    for c in [*same[1:], *within]:
        rule = rule & c
    return a.join(i.withWatermark("issued", late), rule, "left_semi").drop("tried")
