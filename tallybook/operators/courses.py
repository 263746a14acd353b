"""Course lists, enrolment figures and rosters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.status import status_expr
from tallybook.ledger import Ledger
from tallybook.operators.accounts import filter_course
from tallybook.operators.dashboard import side_by_side
from tallybook.plans.ordered import HOT_ROWS, Running, running_values
from tallybook.plans.totals import zero, paid_by_student, with_course, with_paid

ROSTER_ORDER = ("last_name", "first_name", "id")


def active_course_options(courses: DataFrame) -> DataFrame:
    return courses.where("is_active").select("id", "name", "price").orderBy("name", "id")


def course_catalog(courses: DataFrame, sort: str = "default") -> DataFrame:
    """``default`` puts active courses first; the other sorts ignore the state."""
    orders = {
        "default": [F.col("is_active").desc(), F.col("name").asc()],
        "name": [F.lower("name").asc()],
        "price": [F.col("price").asc()],
        "date": [F.col("created_at").asc()],
    }
    return courses.orderBy(*orders[sort], F.col("id").asc())


def course_active_counts(led: Ledger) -> DataFrame:
    """Active students of every active course; courses without any stay, with 0."""
    counts = (
        led.students.where("is_active and course_id is not null")
        .groupBy("course_id")
        .agg(F.count("*").alias("n"))
    )
    courses = led.courses.where("is_active")
    return courses.join(counts, courses["id"] == counts["course_id"], "left").select(
        "id", "name", F.coalesce("n", F.lit(0)).alias("student_count")
    )


def top_courses(led: Ledger, n: int = 5) -> DataFrame:
    return (
        course_active_counts(led)
        .orderBy(F.col("student_count").desc(), F.col("id").asc())
        .limit(n)
        .select("id", F.col("name").alias("course_name"), F.col("student_count").alias("enrolled_count"))
    )


def course_stats(led: Ledger) -> DataFrame:
    """Enrolled students, revenue from them and the average per active course."""
    courses = led.courses.where("is_active")
    enrolled = course_active_counts(led).agg(
        F.coalesce(F.sum("student_count"), F.lit(0)).alias("total_students"),
        F.coalesce(F.bround(F.avg("student_count"), 1), F.lit(0.0)).alias("avg_students"),
    )
    students = with_course(led.students.where("is_active"), courses, "inner").select("id")
    paid = paid_by_student(led.payments)
    revenue = paid.join(students, paid["student_id"] == students["id"], "left_semi").agg(
        F.coalesce(F.sum("total_paid"), zero()).alias("total_revenue")
    )
    return side_by_side(enrolled, revenue)


def course_rosters(led: Ledger, course_id: int | None = None) -> DataFrame:
    """Active students of each course with total paid and Paid/Partial/Unpaid, one row each."""
    students = filter_course(led.students.where("is_active"), course_id)
    rows = with_paid(with_course(students, led.courses, "inner"), led.payments)
    return rows.select(
        "course_id",
        "course_name",
        "id",
        "student_id",
        "first_name",
        "last_name",
        "email",
        "course_price",
        "total_paid",
        status_expr(F.col("total_paid"), F.col("course_price"), "roster").alias("payment_status"),
    )


def course_roster_documents(
    led: Ledger,
    course_id: int | None = None,
    chunk: int = 1000,
    hot_rows: int = HOT_ROWS,
    blocks: int | None = None,
) -> DataFrame:
    """Nested documents: course name and an ordered array of students.

    A course can hold most of the students, so a document has at most ``chunk``
    of them and ``part`` numbers the documents of a course from 0; every
    student is in exactly one.
    """
    order = [F.col(c).asc() for c in ROSTER_ORDER]
    rows = running_values(
        course_rosters(led, course_id), ["course_id"], order, [Running("position", "count")], hot_rows, blocks,
        counted=filter_course(led.students, course_id),
    )
    part = F.floor((F.col("position") - 1) / F.lit(chunk)).cast("long")
    student = F.struct(
        "position", "id", "student_id", "first_name", "last_name", "email", "course_price",
        "total_paid", "payment_status",
    )
    return (
        rows.withColumn("part", part)
        .groupBy("course_id", "course_name", "part")
        .agg(F.sort_array(F.collect_list(student)).alias("students"))
    )


def write_roster_json(documents: DataFrame, path: str) -> None:
    documents.write.mode("overwrite").json(path)
