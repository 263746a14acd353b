"""Event-time order for jobs whose verdicts depend on what happened before.

Files do not arrive in the order of events.  Rows wait until the watermark (the
latest time seen less ``late``) has passed them and are then worked on together
with all others of that stretch, so the answer does not depend on how files fall
into batches.  Rows that come after the watermark has passed their time are kept
apart.  What still waits when the source is drained is worked on provisionally,
under the number of the next batch, which overwrites it when it comes.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.streaming.tables import BatchTable, drain

Work = Callable[[DataFrame, int, object], None]


def late_rows(spark: SparkSession, base: str, schema: T.StructType) -> DataFrame:
    """Rows of the job at ``base`` that came too late to be judged."""
    return BatchTable(spark, f"{base}/late", schema).read()


def drain_in_order(stream: DataFrame, ts: str, late: timedelta, work: Work, base: str) -> None:
    """Runs ``work(rows, number, until)`` for stretches of event time, in order.

    ``rows`` are those up to ``until`` (None: all) that no earlier call has seen;
    rows without a time go with the batch they come in.
    """
    spark, schema = stream.sparkSession, stream.schema
    waiting = BatchTable(spark, f"{base}/waiting", schema)
    late_table = BatchTable(spark, f"{base}/late", schema)
    marks = BatchTable(spark, f"{base}/marks", T.StructType([T.StructField("until", schema[ts].dataType)]))
    at = F.col(ts)

    def stretch(batch: DataFrame, number: int) -> None:
        known = marks.batch(number - 1).first()
        previous = known[0] if known else None
        pool = waiting.batch(number - 1)
        if previous is None:
            pool = pool.unionByName(batch)
            late_table.write(batch.limit(0), number)
        else:
            in_time = at.isNull() | (at > F.lit(previous))
            pool = pool.unionByName(batch.where(in_time))
            late_table.write(batch.where(~in_time), number)
        latest = pool.agg(F.max(at)).first()[0]
        until = max((t for t in (previous, latest - late if latest else None) if t is not None), default=None)
        ready = at.isNull() | (at <= F.lit(until)) if until is not None else at.isNull()
        waiting.write(pool.where(~ready), number)
        work(pool.where(ready), number, until)
        marks.write(spark.createDataFrame([(until,)], marks.schema), number)
        for table in (waiting, marks):
            table.drop(before=number - 1)

    drain(stream, stretch, base)
    last = marks.last()
    if last is not None:
        work(waiting.batch(last), last + 1, None)
