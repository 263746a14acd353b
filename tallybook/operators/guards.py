"""Referential guards and foreign-key actions for batches of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.ledger import Ledger
from tallybook.plans.skew import one_per_key


def guard_course_changes(requests: DataFrame, led: Ledger) -> DataFrame:
    """``requests`` (course_id, action deactivate/delete) with decision, reason and count.

    Deactivating is refused while the course has active students, deleting while
    it has any.  Payments hang on students, so a course without students has no
    payments to protect and the student count settles a delete.
    """
    counts = (
        led.students.where("course_id is not null")
        .groupBy(F.col("course_id").alias("_cid"))
        .agg(F.count_if("is_active").alias("_active"), F.count("*").alias("_all"))
    )
    known = led.courses.select(F.col("id").alias("_known"))
    rows = requests.join(known, F.col("course_id") == F.col("_known"), "left")
    rows = rows.join(one_per_key(counts, "_cid"), F.col("course_id") == F.col("_cid"), "left")
    zero = F.lit(0)
    active, everyone = F.coalesce("_active", zero), F.coalesce("_all", zero)
    action = F.col("action")
    reason = (
        F.when(F.col("_known").isNull(), "not_found")
        .when((action == "deactivate") & (active > 0), "has_active_students")
        .when((action == "delete") & (everyone > 0), "has_students")
        .when(~action.isin("deactivate", "delete"), "unknown_action")
    )
    return rows.select(
        *requests.columns,
        reason.isNull().alias("allowed"),
        reason.alias("reason"),
        F.when(action == "deactivate", active).otherwise(everyone).alias("blocking_students"),
    )


def guard_cashier_changes(requests: DataFrame, led: Ledger) -> DataFrame:
    """``requests`` (user_id, action edit/delete) with decision and reason.

    Collectors with payments cannot be deleted; only cashiers can be edited.
    """
    taken = led.payments.groupBy(F.col("collected_by").alias("_by")).agg(F.count("*").alias("_n"))
    u = led.users.select(F.col("id").alias("_uid"), F.col("role").alias("_role"))
    rows = requests.join(u, F.col("user_id") == F.col("_uid"), "left")
    rows = rows.join(one_per_key(taken, "_by"), F.col("user_id") == F.col("_by"), "left")
    action, n = F.col("action"), F.coalesce("_n", F.lit(0))
    reason = (
        F.when(F.col("_uid").isNull(), "not_found")
        .when((action == "delete") & (n > 0), "has_payments")
        .when((action == "edit") & (F.col("_role") != "cashier"), "not_a_cashier")
        .when(~action.isin("edit", "delete"), "unknown_action")
    )
    return rows.select(
        *requests.columns, reason.isNull().alias("allowed"), reason.alias("reason"), n.alias("blocking_payments")
    )


# parent table -> (child table, its column, what a parent's deletion does to the child)
FOREIGN_KEYS = {
    "students": [("payments", "student_id", "cascade")],
    "courses": [("students", "course_id", "set_null")],
    "users": [("payments", "collected_by", "set_null"), ("logs", "user_id", "set_null")],
}


def cascade_deletes(keys: DataFrame, led: Ledger, table: str, policy: str | None = None) -> Ledger:
    """The ledger after deleting the rows of ``table`` whose ``id`` is in ``keys``.

    Payments go with their student; a student's course and the user of a
    payment or log entry become NULL.  ``policy`` (cascade or set_null)
    overrides the action for every child.  Rows that go by a cascade take
    their own children along, down to the last level.
    """
    tables = led.tables()
    out: dict[str, DataFrame] = {}

    def delete(parent: str, ids: DataFrame) -> None:
        gone = one_per_key(ids.select(F.col("id").alias("_gone")).distinct(), "_gone")
        out[parent] = out.get(parent, tables[parent]).join(gone, F.col("id") == F.col("_gone"), "left_anti")
        for child, column, action in FOREIGN_KEYS.get(parent, []):
            rows = out.get(child, tables[child])
            match = F.col(column) == F.col("_gone")
            if (policy or action) == "cascade":
                if child in FOREIGN_KEYS:
                    delete(child, rows.join(gone, match, "left_semi").select("id"))
                else:
                    out[child] = rows.join(gone, match, "left_anti")
            else:
                marked = rows.join(gone, match, "left")
                out[child] = marked.withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone")

    delete(table, keys)
    return led.with_tables(**out)
