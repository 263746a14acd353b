"""Runs registered queries in Spark and their oracle text in DuckDB and compares them."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set threads to 4")
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def rows_of(table, names) -> list[tuple]:
    cols = [table.column(n).to_pylist() for n in names]
    return sorted((tuple(plain(v) for v in r) for r in zip(*cols)), key=repr)


def compare(spark_table, oracle_table) -> str | None:
    """None if equal, else what differs."""
    a, b = sorted(spark_table.column_names), sorted(oracle_table.column_names)
    if a != b:
        return f"columns {a} != {b}"
    kinds = [
        f"{n}: {spark_table.schema.field(n).type} != {oracle_table.schema.field(n).type}"
        for n in a
        if str(spark_table.schema.field(n).type).replace("large_", "") != str(oracle_table.schema.field(n).type)
    ]
    if kinds:
        return "types " + "; ".join(kinds)
    x, y = rows_of(spark_table, a), rows_of(oracle_table, a)
    if len(x) != len(y):
        return f"{len(x)} rows != {len(y)} rows"
    for r, s in zip(x, y):
        if r != s:
            return f"{a}: {r} != {s}"
    return None
