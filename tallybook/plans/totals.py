"""Payments summed per student before any join.

Joining payments first and grouping afterwards gives the same numbers but moves
every payment row, with the student's columns attached, through a shuffle.
Grouping first sends one partial row per student and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.ledger import Ledger

def zero() -> Column:
    return F.lit(0).cast("decimal(12,2)")


def paid_by_student(payments: DataFrame, *extra: Column) -> DataFrame:
    return payments.groupBy("student_id").agg(F.sum("amount_paid").alias("total_paid"), *extra)


def with_paid(students: DataFrame, payments: DataFrame, *extra: Column) -> DataFrame:
    """Students with ``total_paid`` (0 without payments) and any extra aggregates."""
    paid = paid_by_student(payments, *extra).withColumnRenamed("student_id", "_sid")
    joined = students.join(paid, students["id"] == paid["_sid"], "left").drop("_sid")
    return joined.withColumn("total_paid", F.coalesce("total_paid", zero()))


def with_course(students: DataFrame, courses: DataFrame, how: str = "left") -> DataFrame:
    """Adds course_name, course_price and course_active."""
    c = courses.select(
        F.col("id").alias("_cid"),
        F.col("name").alias("course_name"),
        F.col("price").alias("course_price"),
        F.col("is_active").alias("course_active"),
    )
    return students.join(c, students["course_id"] == c["_cid"], how).drop("_cid")


def accounts(led: Ledger, how: str = "left", *extra: Column) -> DataFrame:
    return with_course(with_paid(led.students, led.payments, *extra), led.courses, how)
