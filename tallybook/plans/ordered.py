"""Ordered calculations per key that survive a key holding most of the rows.

``Window.partitionBy(key)`` puts each key in one task.  That is the right plan
for keys of ordinary size, so it is used for them.  Keys with more than
``hot_rows`` rows go another way: their rows are cut into range blocks on
(key, order), each block is scanned on its own, and what the earlier blocks of
the same key add up to is carried over.  A block has at most one key that began
in an earlier block (its first one), so the carry table has fewer rows than
there are blocks and can be broadcast whatever the size of the input.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.plans.durable import durable
from tallybook.plans.skew import one_per_key

HOT_ROWS = 1_000_000
BROADCAST_ROWS = 100_000
BLOCK_ROWS = 2_000_000
BLOCK = "_block"
POS = "_pos"


@dataclass(frozen=True)
class Running:
    """A running value: ``how`` is ``sum``, ``max`` or ``count`` of ``value``.

    With ``whole`` every row gets the value over all rows of its key.
    """

    name: str
    how: str
    value: Column | None = None
    whole: bool = False

    def aggregate(self, column: str) -> Column:
        return {"sum": F.sum, "count": F.count, "max": F.max}[self.how](F.col(column))

    def of_blocks(self, column: str) -> Column:
        return F.max(column) if self.how == "max" else F.sum(column)

    def joined(self, here: Column, before: Column) -> Column:
        if self.how == "max":  # greatest() skips NULLs but does not take structs
            return (
                F.when(before.isNull(), here)
                .when(here.isNull() | (before > here), before)
                .otherwise(here)
            )
        zero = F.lit(0)
        return F.when(before.isNull(), here).otherwise(F.coalesce(here, zero) + before)


@dataclass(frozen=True)
class HotKeys:
    """Keys with more rows than one task should hold: the keys, how many, their rows."""

    keys: DataFrame
    count: int
    rows: int

    def side(self) -> DataFrame:
        return F.broadcast(self.keys) if self.count <= BROADCAST_ROWS else self.keys

    def blocks(self) -> int:
        least = int(self.keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return max(least, -(-self.rows // BLOCK_ROWS))


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> HotKeys:
    """One key-only aggregation; the result has at most rows/hot_rows rows."""
    found = durable(
        df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows)
    )
    size = found.agg(F.count("*"), F.sum("_n")).first()
    return HotKeys(found.select(*keys), size[0], size[1] or 0)


@dataclass(frozen=True)
class Split:
    """Rows of ordinary keys; rows of hot keys (None if there are none) and their blocks."""

    cold: DataFrame
    hot: DataFrame | None = None
    blocks: int = 0
    few_keys: bool = True
    keys: HotKeys | None = None

    def hot_side(self) -> DataFrame:
        """The hot keys, as the small side of a join."""
        return self.keys.side()


def split_hot(
    df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS, counted: DataFrame | None = None
) -> Split:
    """Rows are counted in ``counted`` if given: a cheaper table with at least the rows of ``df``."""
    hot = hot_keys(df if counted is None else counted, keys, hot_rows)
    if hot.count == 0:
        return Split(df)
    h = hot.side().select(*[F.col(k).alias(f"_hot_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in keys]
    return Split(
        df.join(h, same, "left_anti"),
        df.join(h, same, "left_semi"),
        hot.blocks(),
        hot.count <= BROADCAST_ROWS,
        hot,
    )


def range_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[Column], blocks: int) -> DataFrame:
    """``df`` range-cut on (keys, order) with ``_block`` and ``_pos`` added.

    ``_pos`` grows with (keys, order) over the whole table.  The cut depends on
    a sample, so it is stored before anything reads these columns: a lost
    executor cannot lead to a second, different cut.
    """
    by = [*[F.col(k).asc() for k in keys], *order]
    cut = df.repartitionByRange(blocks, *by).sortWithinPartitions(*by)
    cut = cut.withColumn(POS, F.monotonically_increasing_id())
    return durable(cut.withColumn(BLOCK, F.shiftright(POS, 33)))


def scan_blocks(
    cut: DataFrame, keys: Sequence[str], running: Sequence[Running], few_keys: bool = False
) -> DataFrame:
    """Running values over rows that carry ``_block`` and ``_pos``.

    Inputs are the columns ``_in_<name>``; they are dropped from the result.
    """
    here = Window.partitionBy(*keys, BLOCK).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    plain = [c for c in cut.columns if not c.startswith("_in_")]
    whole, running = [r for r in running if r.whole], [r for r in running if not r.whole]
    scanned = cut.select(
        *plain,
        *[f"_in_{r.name}" for r in whole],
        *[r.aggregate(f"_in_{r.name}").over(here).alias(r.name) for r in running],
    )
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        cut.groupBy(*keys, BLOCK)
        .agg(*[r.aggregate(f"_in_{r.name}").alias(r.name) for r in running])
        .select(
            *[F.col(k).alias(f"_carry_{k}") for k in [*keys, BLOCK]],
            F.count("*").over(earlier).alias("_earlier"),
            *[r.of_blocks(r.name).over(earlier).alias(f"_before_{r.name}") for r in running],
        )
        .where("_earlier > 0")
    )
    same = [F.col(k).eqNullSafe(F.col(f"_carry_{k}")) for k in [*keys, BLOCK]]
    out = scanned.join(F.broadcast(carry), same, "left").select(
        *plain, *[r.joined(F.col(r.name), F.col(f"_before_{r.name}")).alias(r.name) for r in running]
    )
    if not whole:
        return out
    per_key = cut.groupBy(*[F.col(k).alias(f"_all_{k}") for k in keys]).agg(
        *[r.aggregate(f"_in_{r.name}").alias(r.name) for r in whole]
    )
    names = [f"_all_{k}" for k in keys]
    per_key = F.broadcast(per_key) if few_keys else one_per_key(per_key, *names)
    match = [F.col(k).eqNullSafe(F.col(f"_all_{k}")) for k in keys]
    return out.join(per_key, match, "inner").drop(*names)


def feed(df: DataFrame, running: Sequence[Running]) -> DataFrame:
    """Adds the ``_in_<name>`` columns that the scans read."""
    return df.select(
        "*", *[(F.lit(1) if r.value is None else r.value).alias(f"_in_{r.name}") for r in running]
    )


def running_values(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    running: Sequence[Running],
    hot_rows: int = HOT_ROWS,
    blocks: int | None = None,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Add running values per key in the given total order (current row included)."""
    split = split_hot(feed(df, running), keys, hot_rows, counted)
    w = Window.partitionBy(*keys).orderBy(*order)
    to_here = w.rowsBetween(Window.unboundedPreceding, 0)
    to_end = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = split.cold.select(
        *df.columns,
        *[r.aggregate(f"_in_{r.name}").over(to_end if r.whole else to_here).alias(r.name) for r in running],
    )
    if split.hot is None:
        return out
    cut = range_blocks(split.hot, keys, order, blocks or split.blocks)
    return out.unionByName(scan_blocks(cut, keys, running, split.few_keys).drop(BLOCK, POS))
