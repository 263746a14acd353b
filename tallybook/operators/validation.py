"""Checks on incoming records, with the first failing reason per row.

A batch is judged as if its rows came one at a time in ``seq`` order: a row
loses to an earlier *accepted* row with the same key, not to a refused one.
Keys compare without regard to case.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.text import EMAIL_PATTERN
from tallybook.ledger import Ledger
from tallybook.plans.durable import durable
from tallybook.plans.skew import one_per_key

STUDENT_INSERT = (
    "student_id", "first_name", "last_name", "email", "phone", "address", "course_id", "enrollment_date",
)
STUDENT_UPDATE = ("first_name", "last_name", "email", "course_id", "enrollment_date")


def missing_any(fields: Sequence[str]) -> Column:
    return reduce(or_, [F.coalesce(F.col(f).cast("string"), F.lit("")) == "" for f in fields])


def first_come(rows: DataFrame, seq: str, keys: Sequence[str]) -> DataFrame:
    """The rows that win when each takes its keys on arrival and losers take none.

    A row that comes first for all of its keys wins for certain; rows sharing a
    key with a winner lose for certain.  Both are removed and the rest is looked
    at again, until nothing is left.  With one key a single round settles it;
    further rounds only see rows behind a refused one.
    """
    open_rows = durable(rows.select(seq, *keys))
    won: DataFrame | None = None
    while not open_rows.isEmpty():
        firsts = [open_rows.groupBy(k).agg(F.min(seq).alias(seq)) for k in keys]
        winners = durable(reduce(lambda a, b: a.join(b, seq, "inner"), firsts).select(seq, *keys))
        won = winners if won is None else won.unionByName(winners)
        for k in keys:
            open_rows = open_rows.join(winners.select(k), k, "left_anti")
        open_rows = durable(open_rows)
    return open_rows if won is None else won


def _known(df: DataFrame, value: Column, key: str, mark: str) -> DataFrame:
    """One row per existing key."""
    known = df.where(value.isNotNull()).groupBy(value.alias(key)).agg(F.lit(True).alias(mark))
    return one_per_key(known, key)


def _taken_earlier(df: DataFrame, won: DataFrame, key: str, mark: str) -> DataFrame:
    w = won.select(key, F.col("seq").alias("_won"))
    return df.join(w, key, "left").withColumn(mark, F.coalesce(F.col("_won") < F.col("seq"), F.lit(False))).drop("_won")


def _first_reason(rules: Sequence[tuple[str, Column]]) -> Column:
    out = F.when(rules[0][1], rules[0][0])
    for reason, rule in rules[1:]:
        out = out.when(rule, reason)
    return out.alias("reason")


def check_new_students(incoming: DataFrame, led: Ledger) -> DataFrame:
    """``incoming`` (with ``seq``) plus ``reason``; NULL means accepted.

    Order of the checks: required fields, student number taken, e-mail taken,
    e-mail format, course exists and is active.
    """
    rows = incoming.withColumns({"_number": F.lower("student_id"), "_mail": F.lower("email")})
    rows = rows.join(_known(led.students, F.lower("student_id"), "_number", "_has_number"), "_number", "left")
    rows = rows.join(_known(led.students, F.lower("email"), "_mail", "_has_mail"), "_mail", "left")
    rows = rows.join(_known(led.courses.where("is_active"), F.col("id"), "_course", "_open"),
                     F.col("course_id") == F.col("_course"), "left")
    no = F.lit(False)
    checked = durable(
        rows.withColumns(
            {
                "_missing": missing_any(STUDENT_INSERT),
                "_has_number": F.coalesce("_has_number", no),
                "_has_mail": F.coalesce("_has_mail", no),
                "_bad_mail": ~F.coalesce(F.col("email").rlike(EMAIL_PATTERN), no),
                "_closed": ~F.coalesce("_open", no),
            }
        ).drop("_course", "_open")
    )
    faults = F.col("_missing") | F.col("_has_number") | F.col("_has_mail") | F.col("_bad_mail") | F.col("_closed")
    won = first_come(checked.where(~faults), "seq", ["_number", "_mail"])
    judged = _taken_earlier(checked, won, "_number", "_number_gone")
    judged = _taken_earlier(judged, won, "_mail", "_mail_gone")
    return judged.select(
        *incoming.columns,
        _first_reason(
            [
                ("missing_field", F.col("_missing")),
                ("student_id_exists", F.col("_has_number") | F.col("_number_gone")),
                ("email_exists", F.col("_has_mail") | F.col("_mail_gone")),
                ("invalid_email", F.col("_bad_mail")),
                ("invalid_course", F.col("_closed")),
            ]
        ),
    )


def _mail_checks(incoming: DataFrame, current: DataFrame) -> DataFrame:
    """Marks e-mails held by another id, and by an earlier row of the batch for another id.

    An e-mail that the batch itself frees is not given out again in the same batch.
    """
    rows = incoming.withColumn("_mail", F.lower("email"))
    holder = (
        current.where("email is not null")
        .groupBy(F.lower("email").alias("_mail"))
        .agg(F.min("id").alias("_low"), F.max("id").alias("_high"))
    )
    rows = rows.join(one_per_key(holder, "_mail"), "_mail", "left")
    other = (F.col("_low") != F.col("id")) | (F.col("_high") != F.col("id"))
    return rows.withColumn("_has_mail", F.coalesce(other, F.lit(False))).drop("_low", "_high")


def _mail_race(checked: DataFrame, faults: Column) -> DataFrame:
    claims = checked.where(~faults).groupBy("_mail").agg(F.min(F.struct("seq", "id")).alias("_claim"))
    rows = checked.join(one_per_key(claims, "_mail"), "_mail", "left")
    lost = (F.col("_claim.seq") < F.col("seq")) & (F.col("_claim.id") != F.col("id"))
    return rows.withColumn("_mail_gone", F.coalesce(lost, F.lit(False))).drop("_claim")


def check_student_updates(incoming: DataFrame, led: Ledger) -> DataFrame:
    """Edits of active students: ``incoming`` (seq, id, fields) plus ``reason``."""
    no = F.lit(False)
    known = _known(led.students.where("is_active"), F.col("id"), "_known_id", "_found")
    rows = _mail_checks(incoming, led.students)
    rows = rows.join(known, F.col("id") == F.col("_known_id"), "left")
    rows = rows.join(_known(led.courses.where("is_active"), F.col("id"), "_course", "_open"),
                     F.col("course_id") == F.col("_course"), "left")
    checked = rows.withColumns(
        {
            "_unknown": ~F.coalesce("_found", no),
            "_missing": missing_any(STUDENT_UPDATE),
            "_bad_mail": ~F.coalesce(F.col("email").rlike(EMAIL_PATTERN), no),
            "_closed": ~F.coalesce("_open", no),
        }
    )
    faults = F.col("_unknown") | F.col("_missing") | F.col("_has_mail") | F.col("_bad_mail") | F.col("_closed")
    return _mail_race(checked, faults).select(
        *incoming.columns,
        _first_reason(
            [
                ("not_found", F.col("_unknown")),
                ("missing_field", F.col("_missing")),
                ("email_exists", F.col("_has_mail") | F.col("_mail_gone")),
                ("invalid_email", F.col("_bad_mail")),
                ("invalid_course", F.col("_closed")),
            ]
        ),
    )


def check_staff(incoming: DataFrame, users: DataFrame) -> DataFrame:
    """Staff rows (seq, id or NULL for a new one, name, email) plus ``reason``.

    Here the format is tested before the e-mail is looked up.
    """
    no = F.lit(False)
    nobody = F.lit(-1).cast("long")
    rows = _mail_checks(incoming.withColumn("id", F.coalesce("id", nobody - F.col("seq"))), users)
    checked = rows.withColumns(
        {
            "_missing": missing_any(("name", "email")),
            "_bad_mail": ~F.coalesce(F.col("email").rlike(EMAIL_PATTERN), no),
        }
    )
    faults = F.col("_missing") | F.col("_bad_mail") | F.col("_has_mail")
    return _mail_race(checked, faults).select(
        *[F.when(F.col("id") >= 0, F.col("id")).alias("id") if c == "id" else c for c in incoming.columns],
        _first_reason(
            [
                ("missing_field", F.col("_missing")),
                ("invalid_email", F.col("_bad_mail")),
                ("email_exists", F.col("_has_mail") | F.col("_mail_gone")),
            ]
        ),
    )


def split_judged(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted without the reason column, rejected with it)."""
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")
