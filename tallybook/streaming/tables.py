"""Stream sources, sinks and the tables that foreachBatch jobs keep.

Tables live in the shared folder.  Each micro-batch owns the partition
``batch=<id>`` and overwrites it, so a batch that is run again after a failure
leaves the same rows as one that ran once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.plans.durable import fresh_path


def _hadoop(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def count_files(spark: SparkSession, path: str) -> int:
    """The Parquet files in a folder."""
    fs, folder = _hadoop(spark, path)
    return sum(f.getPath().getName().endswith(".parquet") for f in fs.listStatus(folder))


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None):
    """A folder of files as a stream; a single file is read through its folder."""
    reader = spark.readStream.schema(schema)
    fs, at = _hadoop(spark, path)
    if fs.getFileStatus(at).isFile():
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def instant(ntz: Column) -> Column:
    """The UTC instant of a zone-less time; watermarks do not take zone-less columns."""
    return F.convert_timezone(F.lit("UTC"), F.current_timezone(), ntz).cast("timestamp")


def wall_time(ts: Column) -> Column:
    """Inverse of :func:`instant`."""
    return F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp_ntz"))


def run_to_end(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Append the stream's rows to Parquet until its source is drained; the rows written."""
    spark = stream.sparkSession
    base = path or fresh_path(spark, label)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{base}/rows")
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


def run_updates(stream: DataFrame, keys: Sequence[str], label: str, path: str | None = None) -> DataFrame:
    """The current state of an aggregation, windows that are still open included.

    Each micro-batch leaves the groups that it changed under its own number; a
    rerun overwrites them, and of each group the newest counts.
    """
    spark = stream.sparkSession
    base = path or fresh_path(spark, label)
    changed = BatchTable(spark, f"{base}/changed", T.StructType([*stream.schema, T.StructField("_batch", T.LongType())]))

    def work(batch: DataFrame, number: int) -> None:
        changed.write(batch.withColumn("_batch", F.lit(number)), number)

    drain(stream, work, base, "update")
    rest = [c for c in stream.columns if c not in keys]
    newest = changed.read().groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("now"))
    return newest.select(*keys, "now.*").select(*stream.columns)


def drain(stream: DataFrame, work: Callable[[DataFrame, int], None], base: str, mode: str = "append") -> None:
    """Run ``work`` on every micro-batch until the source is drained.

    A batch is cached while it is worked on; what is lost is read again from the source.
    """

    def cached(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            work(batch, number)
        finally:
            batch.unpersist()

    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(cached)
        .option("checkpointLocation", f"{base}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


class BatchTable:
    """Parquet rows by micro-batch."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType):
        self.spark, self.path, self.schema = spark, path, schema

    def write(self, rows: DataFrame, batch: int) -> None:
        typed = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        typed.write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def batch(self, number: int) -> DataFrame:
        return self.read(before=number + 1, from_=number)

    def numbers(self) -> list[int]:
        """The batches there are: one listing, no file is opened."""
        fs, folder = _hadoop(self.spark, self.path)
        if not fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in fs.listStatus(folder)]
        return sorted(int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))

    def last(self) -> int | None:
        return max(self.numbers(), default=None)

    def read(self, before: int | None = None, from_: int | None = None) -> DataFrame:
        """The rows of some batches; only their files are listed and opened."""
        wanted = [n for n in self.numbers() if (before is None or n < before) and (from_ is None or n >= from_)]
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/batch={n}" for n in wanted])

    def drop(self, before: int) -> None:
        """Removes batches that nothing reads any more."""
        for n in self.numbers():
            if n < before:
                fs, folder = _hadoop(self.spark, f"{self.path}/batch={n}")
                fs.delete(folder, True)


class RunningSums:
    """A sum per key over all micro-batches so far.

    Every batch adds one partition of differences; every ``compact``-th batch
    also stores the full sums, so a reader never goes back further than that.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[T.StructField], compact: int = 20):
        self.keys, self.compact = [k.name for k in keys], compact
        schema = T.StructType([*keys, T.StructField("total", T.DecimalType(22, 2))])
        self.parts = BatchTable(spark, f"{path}/parts", schema)
        self.full = BatchTable(spark, f"{path}/full", schema)

    def add(self, sums: DataFrame, batch: int) -> None:
        self.parts.write(sums, batch)
        if batch % self.compact == self.compact - 1:
            self.full.write(self._sums(batch + 1, batch + 1 - self.compact, None), batch)
            # the sums before and the differences since are kept: this batch may run again
            self.full.drop(before=batch - self.compact)
            self.parts.drop(before=batch + 1 - self.compact)

    def before(self, batch: int, only: DataFrame | None = None) -> DataFrame:
        """Sums over the batches below ``batch``, for the keys in ``only`` if given."""
        return self._sums(batch, batch // self.compact * self.compact, only)

    def _sums(self, batch: int, since: int, only: DataFrame | None) -> DataFrame:
        """The full sums stored just before ``since`` and the differences from there on."""
        rows = self.parts.read(before=batch, from_=since)
        if since:
            rows = rows.unionByName(self.full.read(before=since, from_=since - 1))
        if only is not None:
            rows = rows.join(only, self.keys, "left_semi")
        return rows.groupBy(*self.keys).agg(F.sum("total").cast("decimal(22,2)").alias("total"))
