"""Master-data changes and key allocation."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.asof import moment, ts_lit
from tallybook.plans.ordered import HOT_ROWS, Running, running_values
from tallybook.plans.skew import one_per_key

STATE_ACTIONS = ("activate", "deactivate", "toggle")


def upsert_master(
    current: DataFrame,
    changes: DataFrame,
    key: str,
    as_of: str | date | datetime,
    hot_rows: int = HOT_ROWS,
    blocks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(new snapshot, one report row per changed key).

    ``changes`` has ``seq`` (unique), ``action`` (insert, update, activate,
    deactivate, toggle), the key and the value columns; a NULL value leaves the
    column alone.  Changes of one key apply in ``seq`` order: the last value
    given for a column wins, and the state is the last one set, flipped by the
    toggles after it.  The report says inserted, updated, unchanged or missing
    (changes of a key that neither exists nor is inserted).

    Each key's changes are reduced by partial aggregation, never listed or
    sorted: first the last set of each key (a maximum of ``seq``), then, with it
    joined to the changes, the toggles above it are counted beside the seq of
    each column's last write, and the values are fetched by those seqs.  Both summaries merge in any order, so a key with a third of all
    changes is reduced inside every task before anything moves.  ``hot_rows``
    and ``blocks`` are kept for callers; the reduction no longer needs them.
    """
    values = [c for c in changes.columns if c in current.columns and c not in (key, "is_active", "updated_at")]
    action, seq = F.col("action"), F.col("seq")
    sets = action.isin("insert", "activate", "deactivate")
    last_set = changes.groupBy(F.col(key).alias("_key")).agg(F.max(F.when(sets, seq)).alias("_last_set"))
    # one row per key: the build side of a hash join, its own shuffle so that the adaptive skew join can split hot keys
    rows = changes.join(one_per_key(last_set, "_key").hint("shuffle_hash"), F.col(key).eqNullSafe(F.col("_key")))
    writes = action.isin("insert", "update")
    after_last_set = F.col("_last_set").isNull() | (seq > F.col("_last_set"))
    # fixed-width summaries only, so that they aggregate in hash tables: the last set with its state in
    # the lowest bit, and the seq of each column's last write, whose value is fetched by that unique seq
    net = rows.groupBy("_key").agg(
        F.bool_or(action == "insert").alias("_insert"),
        F.max(F.when(sets, seq * 2 + (action != "deactivate").cast("long"))).alias("_set"),
        F.count_if((action == "toggle") & after_last_set).alias("_flips"),
        *[F.max(F.when(writes & F.col(c).isNotNull(), seq)).alias(f"_at_{c}") for c in values],
    ).withColumn("_state", F.col("_set") % 2 == 1)
    for c in values:
        written = changes.select(seq.alias(f"_seq_{c}"), F.col(c).alias(f"_new_{c}")).hint("shuffle_hash")
        net = net.join(written, F.col(f"_at_{c}") == F.col(f"_seq_{c}"), "left").drop(f"_at_{c}", f"_seq_{c}")
    had = current.withColumn("_had", F.lit(True))
    both = had.join(net.hint("shuffle_hash"), F.col(key) == F.col("_key"), "full_outer")
    exists, changed_key = F.col("_had").isNotNull(), F.col("_key").isNotNull()
    state = F.coalesce("_state", "is_active")
    state = F.when(F.col("_flips") % 2 == 1, ~state).otherwise(state)
    fresh = {c: F.coalesce(f"_new_{c}", c) for c in values}
    differs = ~state.eqNullSafe(F.col("is_active"))
    for c in values:
        differs = differs | ~fresh[c].eqNullSafe(F.col(c))
    outcome = (
        F.when(~exists & ~F.col("_insert"), "missing")
        .when(~exists, "inserted")
        .when(differs, "updated")
        .otherwise("unchanged")
    )
    at = ts_lit(moment(as_of))
    touched = changed_key & (~exists | differs)

    def column(c: str) -> Column:
        if c == key:
            return F.coalesce(c, "_key").alias(c)
        if c == "is_active":
            return F.when(changed_key, state).otherwise(F.col(c)).alias(c)
        if c == "updated_at":
            return F.when(touched, at).otherwise(F.col(c)).alias(c)
        if c == "created_at" and c not in values:
            return F.coalesce(F.col(c), at.cast(current.schema[c].dataType)).alias(c)
        return F.when(changed_key, fresh[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c)

    kept = both.where(exists | F.col("_insert"))
    snapshot = kept.select(*[column(c) for c in current.columns])
    report = both.where(changed_key).select(F.col("_key").alias(key), outcome.alias("outcome"))
    return snapshot, report


NUMBER_PATTERN = r"^STU-[0-9]{4}-[0-9]+$"  # fixed format STU-YYYY-#####


def allocate_student_ids(
    new: DataFrame,
    existing: DataFrame,
    year: str = "year",
    order: str = "seq",
    hot_rows: int = HOT_ROWS,
    blocks: int | None = None,
) -> DataFrame:
    """Adds ``student_id`` = STU-YYYY-##### to ``new``, continuing each year's numbers.

    Continues after the greatest *number* of the year; the greatest text would
    go back to 99999 once numbers get longer.
    """
    own = existing.where(F.col("student_id").rlike(NUMBER_PATTERN))
    top = own.groupBy(F.split_part("student_id", F.lit("-"), F.lit(2)).cast("int").alias("_year")).agg(
        F.max(F.split_part("student_id", F.lit("-"), F.lit(3)).cast("long")).alias("_top")
    )
    rows = running_values(new, [year], [F.col(order).asc()], [Running("_nth", "count")], hot_rows, blocks)
    rows = rows.join(one_per_key(top, "_year"), F.col(year) == F.col("_year"), "left")
    number = (F.coalesce("_top", F.lit(0)) + F.col("_nth")).cast("string")
    padded = F.lpad(number, F.greatest(F.lit(5), F.length(number)), F.lit("0"))
    return rows.select(
        *new.columns, F.concat(F.lit("STU-"), F.col(year).cast("string"), F.lit("-"), padded).alias("student_id")
    )
