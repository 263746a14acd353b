"""Reading and writing ledgers, and the report sinks."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.ledger import Ledger
from tallybook.sources.schemas import SCHEMAS, conform


def read_ledger(spark: SparkSession, folder: str, fmt: str = "parquet") -> Ledger:
    """``folder/<table>`` for each table, under the declared schema.

    Parquet resolves columns by name; CSV files need a header in schema order.
    """
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    return Ledger(
        **{t: reader.schema(s).format(fmt).load(f"{folder}/{t}") for t, s in SCHEMAS.items()}
    )


def read_ledger_jdbc(
    spark: SparkSession,
    url: str,
    key_bounds: Mapping[str, tuple[int, int]],
    partitions: int,
    properties: Mapping[str, str] | None = None,
) -> Ledger:
    """Parallel range reads on ``id``; ``key_bounds`` gives the id range of each table."""

    def load(table: str) -> DataFrame:
        low, high = key_bounds[table]
        raw = spark.read.jdbc(
            url,
            table,
            column="id",
            lowerBound=low,
            upperBound=high,
            numPartitions=partitions,
            properties=dict(properties or {}),
        )
        return conform(raw, table)

    return Ledger(**{t: load(t) for t in SCHEMAS})


def write_ledger(led: Ledger, folder: str, fmt: str = "parquet") -> None:
    for name, df in led.tables().items():
        writer = conform(df, name).write.mode("overwrite")
        (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(f"{folder}/{name}")


def table_counts(led: Ledger) -> DataFrame:
    counts = [
        df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in led.tables().items()
    ]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def write_report(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """The export sink: one file per task, with the report headers."""
    names = {c: c for c in df.columns}
    if fmt == "parquet":  # these characters are not allowed in Parquet column names
        names = {c: c.replace(" & ", "_").replace(" ", "_").lower() for c in df.columns}
    df = df.withColumnsRenamed(names)
    df.write.mode("overwrite").option("header", True).format(fmt).save(path)


def enrich_activity(actions: DataFrame, users: DataFrame) -> DataFrame:
    """Role given, else the user's role now, else ``unknown``; the time is the event's own."""
    u = users.select(F.col("id").alias("_uid"), F.col("role").alias("_role"))
    rows = actions.join(u, F.col("user_id") == F.col("_uid"), "left")
    return rows.withColumn("role", F.coalesce("role", "_role", F.lit("unknown"))).select(*actions.columns)


def append_activity(actions: DataFrame, users: DataFrame, path: str) -> None:
    (
        enrich_activity(actions, users)
        .withColumn("log_date", F.to_date("created_at"))
        .write.mode("append")
        .partitionBy("log_date")
        .parquet(path)
    )
