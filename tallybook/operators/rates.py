"""Rate limits and validity windows on keyed events."""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from datetime import timedelta
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.plans.durable import durable
from tallybook.plans.ordered import BLOCK, HOT_ROWS, POS, Running, range_blocks, running_values, split_hot

FOLD_ROWS = 10_000
FAN_IN = 8

# functions of this module go to the workers by value: they need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def throttle(
    events: DataFrame,
    key: str,
    ts: str,
    id: str,
    min_gap: timedelta = timedelta(seconds=60),
    fold_rows: int = FOLD_ROWS,
    blocks: int | None = None,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """``events`` plus ``allowed``: no allowed event of the key in the last ``min_gap``.

    Exactly ``min_gap`` later passes, and a refused event does not restart the
    clock, so the gap to the previous event does not decide.  Events at the same
    instant go by ``id``.  An event without a time is allowed and leaves the clock
    alone; without a gap everything is allowed.
    """
    if min_gap <= timedelta(0):
        return events.withColumn("allowed", F.lit(True))
    split = split_hot(events, [key], fold_rows)
    out = _throttle_cold(split.cold, key, ts, id, min_gap)
    if split.hot is None:
        return out
    n = blocks or split.blocks
    untimed = split.hot.where(F.col(ts).isNull()).withColumn("allowed", F.lit(True))
    timed = split.hot.where(F.col(ts).isNotNull())
    cut = range_blocks(timed, [key], [F.col(ts).asc(), F.col(id).asc()], n)
    return out.unionByName(untimed).unionByName(_throttle_hot(cut, key, ts, min_gap, n, fan_in, events.columns))


def _throttle_cold(rows: DataFrame, key: str, ts: str, id: str, gap: timedelta) -> DataFrame:
    columns = rows.columns
    at = rows.schema[ts].dataType
    per_key = rows.groupBy(F.col(key).alias("_key")).agg(
        F.array_sort(
            F.collect_list(F.struct(F.col(ts).alias("_ts"), F.col(id).alias("_id"), F.struct(*columns).alias("row")))
        ).alias("rows")
    )

    def step(acc: Column, x: Column) -> Column:
        ok = acc["last"].isNull() | (x["_ts"] >= acc["last"] + F.lit(gap))
        return F.struct(
            F.when(ok, x["_ts"]).otherwise(acc["last"]).alias("last"),
            F.concat(acc["ok"], F.array(ok)).alias("ok"),
        )

    start = F.struct(F.lit(None).cast(at).alias("last"), F.array().cast("array<boolean>").alias("ok"))
    folded = per_key.select("rows", F.aggregate("rows", start, step)["ok"].alias("ok"))
    one = folded.select(F.explode(F.arrays_zip("rows", "ok")).alias("x"))
    return one.select("x.rows.row.*", F.col("x.ok").alias("allowed"))


# ---- one key over many blocks ----------------------------------------------
#
# What a block does to the clock is a function "last allowed time before the
# block -> last allowed time after it".  It is kept as two arrays: the events
# that can be the first allowed one (those within one gap of the block's start,
# and the next) and, for each, the last event allowed after it.  Functions of
# neighbouring blocks compose into one, ``fan_in`` at a time, up to the whole
# key; walking back down gives every block the time it starts from.  All groups
# hold one block or ``fan_in`` functions, and the levels are log(blocks).  A
# function has at most as many entries as the key has distinct times in one gap,
# which bounds the memory of a task: use a smaller ``fan_in`` for very long gaps.


def _micros(ts: Column, kind: T.DataType) -> Column:
    """Microseconds on the column's own clock; any year, no time zone in between."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(ts)
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.extract(F.lit("SECOND"), ts)
    return F.unix_date(F.to_date(ts)) * F.lit(86_400_000_000) + (seconds * 1_000_000).cast("long")


def _distinct(entry: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Only the last of entries that end alike: a look-up takes the next entry, so it still finds that end."""
    keep = np.append(leave[1:] != leave[:-1], True)
    return entry[keep], leave[keep]


def block_function(times: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """(possible first allowed times, last allowed time after each)."""
    t = np.unique(times)
    follow = np.searchsorted(t, t + gap, "left")
    end = np.where(follow < len(t), follow, np.arange(len(t)))
    while True:
        further = end[end]
        if np.array_equal(further, end):
            break
        end = further
    entries = min(len(t), int(np.searchsorted(t, t[0] + gap, "left")) + 1)
    return _distinct(t[:entries], t[end[:entries]])


def after_blocks(last: np.ndarray, functions: Sequence[tuple[np.ndarray, np.ndarray]], gap: int) -> np.ndarray:
    """Last allowed time after the blocks, for each time before them."""
    for entry, leave in functions:
        i = np.searchsorted(entry, last + gap, "left")
        last = np.where(i < len(entry), leave[np.minimum(i, len(leave) - 1)], last)
    return last


def compose_blocks(functions: Sequence[tuple[np.ndarray, np.ndarray]], gap: int) -> tuple[np.ndarray, np.ndarray]:
    """One function for neighbouring blocks.

    Its entries are again those within one gap of the start and the next one;
    they lie in the first block, or in several if blocks are shorter than a gap.
    """
    limit = functions[0][0][0] + gap
    entries, leaves = [], []
    for j, (entry, leave) in enumerate(functions):
        n = int(np.searchsorted(entry, limit, "left")) + 1
        entries.append(entry[:n])
        leaves.append(after_blocks(leave[:n], functions[j + 1 :], gap))
        if n <= len(entry):
            break
    return _distinct(np.concatenate(entries), np.concatenate(leaves))


def decide_in_order(first: Sequence[bool], times: Sequence[int], starts: Sequence[int | None], last: int | None, gap: int):
    """Flags of rows in the order of (group, time), and the last allowed time; a group starts anew from its ``starts``.

    A loop over the rows: groups are often short, and a batch holds thousands of them.
    """
    flags = []
    for new, at, start in zip(first, times, starts, strict=True):
        if new:
            last = start
        allowed = last is None or at >= last + gap
        if allowed:
            last = at
        flags.append(allowed)
    return flags, last


def _throttle_hot(cut: DataFrame, key: str, ts: str, min_gap: timedelta, blocks: int, fan_in: int, columns):
    """Only a key that lies in several blocks needs their functions: a cut between blocks parts at most one key,
    so these are fewer than the blocks.  The others start without a clock.
    """
    gap = min_gap // timedelta(microseconds=1)
    kind = cut.schema[key].dataType
    function = T.StructType(
        [
            T.StructField("_key", kind),
            T.StructField("node", T.LongType()),
            T.StructField("entry", T.ArrayType(T.LongType())),
            T.StructField("leave", T.ArrayType(T.LongType())),
        ]
    )
    clock = T.StructType(
        [T.StructField("_key", kind), T.StructField("node", T.LongType()), T.StructField("last", T.LongType())]
    )

    def of_block(group: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        entry, leave = block_function(pdf["_at"].to_numpy(), gap)
        return pd.DataFrame({"_key": [group[0]], "node": [group[1]], "entry": [entry], "leave": [leave]})

    def read(pdf: pd.DataFrame):
        pdf = pdf.sort_values("node")
        pairs = [(np.asarray(e, "int64"), np.asarray(x, "int64")) for e, x in zip(pdf["entry"], pdf["leave"])]
        return pdf["node"].tolist(), pairs

    def compose(group: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        _, pairs = read(pdf)
        entry, leave = compose_blocks(pairs, gap)
        return pd.DataFrame({"_key": [group[0]], "node": [group[1]], "entry": [entry], "leave": [leave]})

    def walk(group: tuple[Any, ...], pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, pairs = read(pdf)
        start = pdf["last"].iloc[0]
        last = None if pd.isna(start) else int(start)
        before = []
        for entry, leave in pairs:
            before.append(last)
            if last is None:
                last = int(leave[0])
            else:
                last = int(after_blocks(np.array([last]), [(entry, leave)], gap)[0])
        return pd.DataFrame({"_key": group[0], "node": nodes, "last": pd.array(before, dtype="Int64")})

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            flags, last = decide_in_order(*(batch.column(c).to_pylist() for c in ("_first", "_at", "_last")), last, gap)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(flags, pa.bool_())], ["_row", "allowed"])

    at = _micros(F.col(ts), cut.schema[ts].dataType).alias("_at")
    span = cut.groupBy(F.col(key).alias("_parted")).agg(F.min(BLOCK).alias("_from"), F.max(BLOCK).alias("_to"))
    parted = F.broadcast(span.where("_from < _to").select("_parted"))
    leaves = cut.join(parted, F.col(key).eqNullSafe(F.col("_parted")), "left_semi")
    leaves = leaves.select(F.col(key).alias("_key"), F.col(BLOCK).alias("node"), at)
    levels = [durable(leaves.groupBy("_key", "node").applyInPandas(of_block, function))]
    n = blocks
    parent = F.floor(F.col("node") / F.lit(fan_in)).cast("long")
    while n > fan_in:
        up = levels[-1].withColumn("parent", parent).groupBy("_key", "parent").applyInPandas(compose, function)
        levels.append(durable(up))
        n = -(-n // fan_in)
    clocks: DataFrame | None = None
    for level in reversed(levels):
        rows = level.withColumn("parent", parent)
        if clocks is None:
            rows = rows.withColumn("last", F.lit(None).cast("long"))
        else:
            c = clocks.select(F.col("_key").alias("_k"), F.col("node").alias("_n"), "last")
            rows = rows.join(c, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("parent") == F.col("_n")), "inner")
            rows = rows.drop("_k", "_n")
        clocks = durable(rows.groupBy("_key", "parent").applyInPandas(walk, clock))
    c = clocks.select(F.col("_key").alias("_k"), F.col("node").alias("_n"), F.col("last").alias("_last"))
    # only places and times go through Python; the flags come back by place
    lean = cut.select(F.col(key).alias("_key"), F.col(BLOCK).alias("_node"), F.col(POS).alias("_row"), at)
    placed = lean.join(F.broadcast(c), F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_node") == F.col("_n")), "left")
    # the window deals and sorts the rows by (key, block, place); Python reads them in that order
    first = F.row_number().over(Window.partitionBy("_key", "_node").orderBy("_row")) == 1
    ordered = placed.select("_row", "_at", "_last", first.alias("_first"))
    flags = ordered.mapInArrow(decide, "_row long, allowed boolean")
    return cut.join(flags, F.col(POS) == F.col("_row"), "inner").select(*columns, "allowed")


def match_within_validity(
    issues: DataFrame,
    attempts: DataFrame,
    keys: Sequence[str],
    code: str | None = None,
    ttl: timedelta = timedelta(minutes=10),
    hot_rows: int = HOT_ROWS,
    blocks: int | None = None,
    uses: DataFrame | None = None,
) -> DataFrame:
    """``attempts`` (keys, code, ts, id) plus ``issue_id`` and ``valid``.

    An attempt is valid if an issue of the same key and code came at or before
    it, less than ``ttl`` ago, and no later *superseding* issue of the key (any
    code) has come by then.  The newest such issue has the best chance on both
    counts, so it alone decides: two running maxima, and no pairs of issues and
    attempts are formed.

    ``issues`` has the boolean ``supersedes``: a resend retires what came
    before it, a first request does not.  ``uses`` (keys, ts) are completed
    resets: each uses up all codes that its key was issued up to then.  An attempt
    at the very time of a use comes before it.
    """
    by_code = [*keys, code] if code else list(keys)
    shared = [*by_code, "ts", "id"]
    line = issues.select(*shared, F.lit(0).alias("_kind"), "supersedes").unionByName(
        attempts.select(*shared, F.lit(1).alias("_kind"), F.lit(False).alias("supersedes"))
    )
    if uses is not None:
        no_code = [F.lit(None).cast(attempts.schema[code].dataType).alias(code)] if code else []
        no_id = F.lit(None).cast(attempts.schema["id"].dataType).alias("id")
        line = line.unionByName(
            uses.select(*keys, *no_code, "ts", no_id, F.lit(2).alias("_kind"), F.lit(False).alias("supersedes"))
        )
    order = [F.col("ts").asc(), F.col("_kind").asc(), F.col("id").asc()]
    stamp = F.struct("ts", "id")
    issue = Running("_issue", "max", F.when(F.col("_kind") == 0, stamp))
    ends = [Running("_retired", "max", F.when((F.col("_kind") == 0) & F.col("supersedes"), stamp))]
    if uses is not None:
        ends.append(Running("_used", "max", F.when(F.col("_kind") == 2, F.col("ts"))))
    if code:
        line = running_values(line, by_code, order, [issue], hot_rows, blocks)
        line = running_values(line, keys, order, ends, hot_rows, blocks)
    else:
        line = running_values(line, keys, order, [issue, *ends], hot_rows, blocks)
    fresh = F.col("ts") < F.col("_issue.ts") + F.lit(ttl)
    current = F.col("_retired").isNull() | (F.col("_issue") >= F.col("_retired"))
    if uses is not None:
        current &= F.col("_used").isNull() | (F.col("_issue.ts") > F.col("_used"))
    return line.where("_kind = 1").select(
        *shared,
        F.col("_issue.id").alias("issue_id"),
        F.coalesce(fresh & current, F.lit(False)).alias("valid"),
    )
