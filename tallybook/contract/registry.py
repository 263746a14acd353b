"""Registered queries: a Spark callable and, where SQL can say it, an oracle text."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.ledger import Ledger
from tallybook.sources.fixtures import driver_table, fixture_ledger, oracle_ctes


@dataclass(frozen=True)
class Inputs:
    spark: SparkSession
    sf_dir: str

    @cached_property
    def led(self) -> Ledger:
        return fixture_ledger(self.spark, self.sf_dir)

    def raw(self, name: str) -> DataFrame:
        return driver_table(self.spark, self.sf_dir, name)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def money_as_double(df: DataFrame) -> DataFrame:
    """The engines' decimal sums differ in type, so money leaves as DOUBLE."""
    return df.select(
        *[
            F.col(f"`{f.name}`").cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else f"`{f.name}`"
            for f in df.schema.fields
        ]
    )


def case(name: str, sql: str | None = None, with_: str = "", recursive: bool = False):
    """Registers ``fn(Inputs)``; ``sql`` sees the five ledger tables (and ``with_``) as CTEs."""

    def register(fn: Callable[[Inputs], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: money_as_double(fn(Inputs(spark, sf_dir)))
        if sql is not None:
            extra = f",\n{with_}" if with_ else ""
            ORACLES[name] = f"with {'recursive ' if recursive else ''}{oracle_ctes()}{extra}\n{sql}"
        return fn

    return register
