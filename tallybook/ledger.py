"""The bundle of the five input tables that most operators take."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Source = DataFrame | Callable[[], DataFrame] | None


class Ledger:
    """Tables are DataFrames, or functions that make one on first use."""

    TABLES = ("users", "courses", "students", "payments", "logs")

    def __init__(
        self,
        users: Source = None,
        courses: Source = None,
        students: Source = None,
        payments: Source = None,
        logs: Source = None,
    ):
        self._tables: dict[str, Source] = dict(zip(self.TABLES, (users, courses, students, payments, logs)))

    def _table(self, name: str) -> DataFrame:
        table = self._tables[name]
        if callable(table):
            table = self._tables[name] = table()
        if table is None:
            raise ValueError(f"this ledger has no {name}")
        return table

    @property
    def users(self) -> DataFrame:
        return self._table("users")

    @property
    def courses(self) -> DataFrame:
        return self._table("courses")

    @property
    def students(self) -> DataFrame:
        return self._table("students")

    @property
    def payments(self) -> DataFrame:
        return self._table("payments")

    @property
    def logs(self) -> DataFrame:
        return self._table("logs")

    @property
    def spark(self) -> SparkSession:
        return self.payments.sparkSession

    def tables(self) -> dict[str, DataFrame]:
        return {name: self._table(name) for name in self.TABLES}

    def with_tables(self, **tables: Source) -> "Ledger":
        return Ledger(**{**self._tables, **tables})
