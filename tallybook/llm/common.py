"""Small helpers of the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

from tallybook.plans.durable import fresh_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: it cuts lineage and outlives executors."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; null is empty."""
    for value in column.cast(pa.binary()):
        yield value.as_py() or b""


class _Shipped:
    """Pickles as its value, by value: tasks get the value itself, whether or not they have this package."""

    def __init__(self, value):
        self.value = value

    def __reduce__(self):
        return cloudpickle.loads, (cloudpickle.dumps(self.value),)


def broadcast(spark: SparkSession, value) -> Broadcast:
    """Sends an object of bounded size to the tasks; workers keep it between tasks."""
    return spark.sparkContext.broadcast(_Shipped(value))
