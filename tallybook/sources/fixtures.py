"""The driver's star-schema tables seen as a ledger.

customer -> courses, orders -> students, supplier -> users, lineitem ->
payments, events -> logs.  The same expressions run in Spark and, as CTEs, in
the oracle engine.

A payment id is a pair of 31-bit linear hashes of the line.  Numbering the lines
of an order would need a window over all of it, which a stream cannot have and
which puts a very large order into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tallybook.ledger import Ledger
from tallybook.sources.schemas import SCHEMAS

PRIME = 2**31 - 1
LINE_FIELDS = (
    "l_orderkey",
    "l_partkey",
    "l_suppkey",
    "l_linenumber",
    "floor(l_extendedprice)",
    "year(l_shipdate) * 372 + month(l_shipdate) * 31 + day(l_shipdate)",
)
FACTORS = (
    (1532676821, 1180433513, 2009876411, 1390287417, 1724653933, 1289754661),
    (1876345027, 1412987633, 1109345219, 2045673913, 1567893247, 1943218579),
)


def _linear(factors: tuple[int, ...]) -> str:
    terms = [f"cast({f} as bigint) % {PRIME} * {k} % {PRIME}" for f, k in zip(LINE_FIELDS, factors)]
    return f"({' + '.join(terms)}) % {PRIME}"


LINE_ID = f"{_linear(FACTORS[0])} * {2**31} + {_linear(FACTORS[1])}"

SOURCES = {
    "courses": "customer",
    "students": "orders",
    "users": "supplier",
    "payments": "lineitem",
    "logs": "events",
}

COLUMNS: dict[str, dict[str, str]] = {
    "courses": {
        "id": "c_custkey",
        "name": "c_name",
        "price": "cast(greatest(c_acctbal, 0) * 30 as decimal(12,2))",
        "description": "c_mktsegment",
        "is_active": "c_mktsegment <> 'MACHINERY'",
        "created_at": "cast(date '2015-01-01' + cast(c_custkey % 3650 as int) as timestamp)",
    },
    "students": {
        "id": "o_orderkey",
        "student_id": "concat('STU-', year(o_orderdate), '-', lpad(concat('', o_orderkey), "
        "cast(greatest(7, length(concat('', o_orderkey))) as int), '0'))",
        "first_name": "split_part(o_orderpriority, '-', 2)",
        "last_name": "concat('Order', o_orderkey)",
        "email": "concat('s', o_orderkey, '@school.test')",
        "course_id": "case when o_orderpriority = '4-NOT SPECIFIED' then null else o_custkey end",
        "enrollment_date": "cast(o_orderdate as date)",
        "is_active": "o_orderstatus <> 'P'",
        "created_at": "o_orderdate",
    },
    "users": {
        "id": "s_suppkey",
        "name": "s_name",
        "email": "concat('u', s_suppkey, '@school.test')",
        "role": "case when s_suppkey % 10 = 0 then 'admin' else 'cashier' end",
        "is_active": "s_acctbal >= 0",
        "created_at": "cast(date '2020-01-01' + cast(s_suppkey % 3650 as int) as timestamp)",
    },
    "payments": {
        "id": LINE_ID,
        "student_id": "l_orderkey",
        "amount_paid": "cast(l_extendedprice as decimal(12,2))",
        "payment_method": "case l_returnflag when 'A' then 'cash' when 'N' then 'gcash' else 'bank_transfer' end",
        "payment_date": "cast(l_shipdate as date)",
        "collected_by": "l_suppkey",
        "notes": "l_linestatus",
        "created_at": "l_shipdate",
    },
    "logs": {
        "id": "event_id",
        "user_id": "user_id",
        "action": "event_type",
        "role": "case when user_id % 7 = 0 then null when user_id % 10 = 0 then 'admin' else 'cashier' end",
        "created_at": "ts",
    },
}


_SEEN: dict[tuple[str, str], T.StructType] = {}


def driver_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir}/{name}.parquet"


def driver_schema(spark: SparkSession, path: str) -> T.StructType:
    """The schema in the file footers, looked up once per application."""
    known = (spark.sparkContext.applicationId, path)
    if known not in _SEEN:
        _SEEN[known] = spark.read.parquet(path).schema
    return _SEEN[known]


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = driver_path(sf_dir, name)
    return spark.read.schema(driver_schema(spark, path)).parquet(path)


def as_ledger_table(raw: DataFrame, table: str) -> DataFrame:
    """Declared columns and types; columns the source lacks are NULL."""
    given = COLUMNS[table]
    return raw.selectExpr(
        *[
            f"cast({given.get(f.name, 'null')} as {f.dataType.simpleString()}) as {f.name}"
            for f in SCHEMAS[table].fields
        ]
    )


def fixture_ledger(spark: SparkSession, sf_dir: str) -> Ledger:
    def table(name: str):
        return lambda: as_ledger_table(driver_table(spark, sf_dir, SOURCES[name]), name)

    return Ledger(**{name: table(name) for name in SOURCES})


def oracle_ctes() -> str:
    """The five tables as a ``with`` list for the oracle engine."""
    parts = []
    for table, columns in COLUMNS.items():
        exprs = ", ".join(f"{e} as {name}" for name, e in columns.items())
        parts.append(f"{table} as (select {exprs} from {SOURCES[table]})")
    return ",\n".join(parts)
