"""Hard-negative mining over Hilbert-ordered candidate blocks with zone maps.

Rows are quantised (each component ``x`` becomes ``floor(256 * x)``), ordered
along a Hilbert curve over three fixed projections and cut into blocks of
``block_rows`` rows, stored as Parquet in that order.

The anchors are dealt in chunks of about ``chunk``, the blocks in slices of some
``SLICE_ROWS`` rows or more, as many as there are shuffle partitions for.  A task streams
the blocks of a slice past a chunk of anchors and keeps, per anchor and score window, the
first rows so far (``positives`` other rows of the anchor's label, then ``negatives``
of other labels with ``30 P <= 100 N <= 90 P`` for each positive of score ``P``):

* Each block has a zone map, per dimension the least and greatest component.  For an
  anchor ``a`` the inner product of any row of a block lies in ``[sum_d min(a_d lo_d,
  a_d hi_d), sum_d max(a_d lo_d, a_d hi_d)]`` (interval arithmetic).  A block that
  cannot reach the window, or the last score kept, is not scored for it.
* The other blocks are scored by exact integer products of matrices, some rows and
  windows at a time.  Only rows that reach the last score kept (ties too) are merged.

The pairs of an anchor and a row are quadratic by nature where the bounds leave no
block out; a task holds a chunk, what it keeps and one tile of scores, and gives
``positives * negatives`` rows an anchor at most.

Defined results: rows with a null label, a null vector, or a null or non-finite
component take no part.  Vectors of different lengths are compared as if padded
with zeros.  Labels of vec_ids divisible by 7 become ``(label + 1) % 10`` (SQL
remainder).  A null vec_id is never an anchor and ranks after every vec_id.
Repeated rows are separate rows (an anchor's own row is the only one left out
of its positives).  Fewer rows than asked give all of them; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

LAST = 2**63 - 1
#: Fixed values of the contract: the quantisation and the window of a negative, in percent of a positive's score.
SCALE, WINDOW = 256, (30, 90)
SCORES = "anchor long, positive long, rid long, vec_id long, score long"
#: Rows of a slice at least; rows and windows scored at once.
SLICE_ROWS, TILE = 8192, 1024


def quantised(rows: DataFrame) -> DataFrame:
    """rid, vec_id, label (shifted where vec_id % 7 = 0) and q, the quantised vector, of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rows.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        label.cast("int").alias("label"),
        F.transform("embedding", lambda x: F.floor(F.lit(SCALE) * x.cast("double")).cast("long")).alias("q"),
    )


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of points with ``d`` coordinates of ``bits`` bits each (Skilling's transpose form)."""
    x = cells.astype(np.uint64).copy()
    d = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = np.uint64(q - 1)
        for i in range(d):
            high = (x[:, i] & np.uint64(q)) != 0
            x[high, 0] ^= p
            low = ~high
            t = (x[low, 0] ^ x[low, i]) & p
            x[low, 0] ^= t
            x[low, i] ^= t
        q >>= 1
    for i in range(1, d):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), dtype=np.uint64)
    q = 1 << (bits - 1)
    while q > 1:
        t[(x[:, d - 1] & np.uint64(q)) != 0] ^= np.uint64(q - 1)
        q >>= 1
    x ^= t[:, None]
    index = np.zeros(len(x), dtype=np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            index = (index << np.uint64(1)) | ((x[:, i] >> np.uint64(b)) & np.uint64(1))
    return index


def _directions(dim: int, count: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((count, dim)) / np.sqrt(dim)


def blocks(rows: DataFrame, block_rows: int, bits: int = 10, seed: int = 7) -> DataFrame:
    """Candidates with block_id, stored in Hilbert order; vectors padded to one length."""
    dim = rows.select(F.max(F.size("q"))).first()[0] or 0
    rows = rows.withColumn("q", F.concat("q", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("q"))))
    typical = rows.select(F.avg(F.aggregate("q", F.lit(0.0), lambda s, x: s + F.abs(x)) / F.greatest(F.size("q"), F.lit(1)))).first()[0] or 1.0
    axes = _directions(max(dim, 1), 3, seed)

    def curve(frame: pd.DataFrame) -> pd.DataFrame:
        if frame.empty:
            return frame.assign(hkey=pd.Series([], dtype=np.int64))
        q = np.array(frame["q"].tolist(), dtype=np.float64).reshape(len(frame), -1)
        projected = q @ axes.T if q.shape[1] else np.zeros((len(frame), 3))
        unit = 0.5 + np.arctan(projected / (typical + 1e-9)) / np.pi
        cells = np.minimum((unit * (1 << bits)).astype(np.int64), (1 << bits) - 1)
        return frame.assign(hkey=hilbert(cells, bits).astype(np.int64))

    keyed = rows.withColumn("rid", F.monotonically_increasing_id()).mapInPandas(
        lambda it: map(curve, it), "vec_id long, label int, q array<long>, rid long, hkey long"
    )
    ordered = keyed.repartitionByRange("hkey", F.coalesce("vec_id", F.lit(LAST)), "rid").sortWithinPartitions(
        "hkey", F.coalesce("vec_id", F.lit(LAST)), "rid"
    )

    def number(frames):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), 0
        for frame in frames:
            at = np.arange(seen, seen + len(frame), dtype=np.int64)
            seen += len(frame)
            yield frame.drop(columns="hkey").assign(block_id=part * (1 << 32) + at // block_rows)

    return stored(ordered.mapInPandas(number, "vec_id long, label int, q array<long>, rid long, block_id long"), "negatives-blocks")


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices; by floats where those are exact."""
    largest = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if 0 <= largest < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


class _Tile:
    """Some windows (anchor, positive, w_lo, w_hi) and the first ``keep`` rows that each has met."""

    def __init__(self, q: np.ndarray, of: np.ndarray, anchor: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, keep: int, same: bool):
        self.q, self.of, self.anchor, self.label = q, of, anchor, label  # vectors, and per window its vector, anchor and label
        self.low, self.high, self.keep, self.same = low.copy(), high, keep, same
        self.plus, self.minus = np.maximum(q, 0), np.minimum(q, 0)
        self.kept = [np.zeros(0, np.int64)] * 4  # window, -score, vec_id, rid

    def meet(self, q: np.ndarray, starts: np.ndarray, rid: np.ndarray, vec: np.ndarray, label: np.ndarray) -> None:
        """Rows in blocks that begin at ``starts``."""
        least, most = np.minimum.reduceat(q, starts), np.maximum.reduceat(q, starts)
        below = (_products(self.plus, least) + _products(self.minus, most))[self.of]
        above = (_products(self.plus, most) + _products(self.minus, least))[self.of]
        read = (above >= self.low[:, None]) & (below <= self.high[:, None])
        rows = np.flatnonzero(np.repeat(read.any(0), np.diff(starts, append=len(q))))
        windows = np.flatnonzero(read.any(1))
        if not len(rows) or not len(windows):
            return
        vectors, of = np.unique(self.of[windows], return_inverse=True)
        score = _products(self.q[vectors], q[rows])[of]
        alike = self.label[windows][:, None] == label[rows]
        ok = (alike if self.same else ~alike) & (score >= self.low[windows][:, None]) & (score <= self.high[windows][:, None])
        ok &= self.anchor[windows][:, None] != rid[rows]
        w, r = np.nonzero(ok)
        if len(w):
            self._merge([windows[w], -score[w, r], vec[rows[r]], rid[rows[r]]])

    def _merge(self, found: list[np.ndarray]) -> None:
        held = [np.concatenate(pair) for pair in zip(self.kept, found, strict=True)]
        order = np.lexsort(held[::-1])
        held = [c[order] for c in held]
        heads = np.flatnonzero(np.diff(held[0], prepend=-1))
        place = np.arange(len(order)) - np.repeat(heads, np.diff(heads, append=len(order)))
        self.kept = [c[place < self.keep] for c in held]
        last = place == self.keep - 1
        self.low[held[0][last]] = -held[1][last]  # never below the window


class _Chunk:
    """The windows of a chunk of anchors, in tiles."""

    def __init__(self, keep: int, same: bool):
        self.keep, self.same, self.batches, self.tiles = keep, same, [], None

    def ask(self, batch: pa.RecordBatch) -> None:
        self.batches.append(batch)

    def _begin(self) -> None:
        held = pa.Table.from_batches(self.batches).combine_chunks()
        asks = held["windows"].chunk(0)
        q, rid, label = _matrix(held["q"].chunk(0)), held["rid"].to_numpy(), held["label"].to_numpy()
        owner = np.repeat(np.arange(len(asks)), pc.list_value_length(asks).to_numpy())
        flat = asks.flatten()
        self.positive, low, high = (flat.field(c).to_numpy() for c in ("positive", "w_lo", "w_hi"))
        self.anchor, self.tiles = rid[owner], []
        for at in range(0, len(owner), TILE):
            part = slice(at, at + TILE)
            vectors, of = np.unique(owner[part], return_inverse=True)
            self.tiles.append((at, _Tile(q[vectors], of, self.anchor[part], label[owner[part]], low[part], high[part], self.keep, self.same)))

    def meet(self, batch: pa.RecordBatch) -> None:
        if self.tiles is None:
            self._begin()
        q, block, rid, label = _matrix(batch.column("q")), *(batch.column(c).to_numpy() for c in ("block_id", "rid", "label"))
        vec = batch.column("vec_id").fill_null(LAST).to_numpy()
        for at in range(0, len(q), TILE):
            part = slice(at, at + TILE)
            starts = np.flatnonzero(np.diff(block[part], prepend=-1))
            for _, tile in self.tiles:
                tile.meet(q[part], starts, rid[part], vec[part], label[part])

    def found(self) -> pa.RecordBatch:
        """The rows kept, by SCORES."""
        columns = [np.concatenate(c) for c in zip(*((t.kept[0] + at, *t.kept[1:]) for at, t in self.tiles or []), strict=True)] or [np.zeros(0, np.int64)] * 4
        w, score, vec, rid = columns
        names = [c.split()[0] for c in SCORES.split(", ")]
        anchor, positive = (self.anchor[w], self.positive[w]) if len(w) else (w, w)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (anchor, positive, rid, vec, -score)], names)


def _matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return lists.flatten().to_numpy().reshape(len(lists), -1) if len(lists) else np.zeros((0, 0), np.int64)


def _scored(asks: DataFrame, cands: DataFrame, keep: int, same: bool, chunk: int) -> DataFrame:
    """Per slice of the blocks, the first ``keep`` rows of each window by (score desc, vec_id, rid).

    ``asks``: rid, label and q of an anchor and windows, an array of (positive, w_lo, w_hi);
    ``same``: rows of the anchor's label are wanted, else of other labels.
    """
    partitions = int(cands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(1, -(-asks.count() // chunk))
    slices = max(1, min(-(-partitions // chunks), cands.count() // SLICE_ROWS))
    number = F.pmod(F.xxhash64("rid"), F.lit(chunks))
    part = F.pmod(F.xxhash64("block_id"), F.lit(slices))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    first = asks.select(every(slices).alias("_slice"), number.alias("_chunk"), F.lit(-1).cast("long").alias("block_id"), "rid", F.lit(None).cast("long").alias("vec_id"), "label", "q", "windows")
    rest = cands.select(part.alias("_slice"), every(chunks).alias("_chunk"), "block_id", "rid", "vec_id", "label", "q", F.lit(None).cast(asks.schema["windows"].dataType).alias("windows"))
    dealt = first.unionByName(rest).withColumn("_group", F.col("_chunk") * slices + F.col("_slice")).drop("_chunk", "_slice")
    # the anchors of a group come before its blocks
    dealt = dealt.repartition(2 * chunks * slices, "_group").sortWithinPartitions("_group", "block_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, known = None, None
        for batch in batches:
            group, block = batch.column("_group").to_numpy(), batch.column("block_id").to_numpy()
            cuts = np.flatnonzero((np.diff(group) != 0) | (np.diff(block < 0) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(group)], strict=True):
                if a == b:
                    continue
                if group[a] != known:
                    if held:
                        yield held.found()
                    held, known = _Chunk(keep, same), group[a]
                if block[a] < 0:
                    held.ask(batch.slice(a, b - a))
                elif held.batches:  # a chunk may be dealt no anchor
                    held.meet(batch.slice(a, b - a))
        if held:
            yield held.found()

    return dealt.mapInArrow(run, SCORES).withColumn("vec_id", F.when(F.col("vec_id") != LAST, F.col("vec_id")))


def mine(rows: DataFrame, anchor_every: int = 100, positives: int = 5, negatives: int = 10, block_rows: int = 256, chunk: int = 8192) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (see the module)."""
    cands = blocks(quantised(rows), block_rows)
    anchors = stored(cands.where(F.col("vec_id") % anchor_every == 0).select("rid", "vec_id", "label", "q"), "negatives-anchors")
    every = F.array(F.struct(F.lit(-1).cast("long").alias("positive"), F.lit(-LAST).alias("w_lo"), F.lit(LAST).alias("w_hi")))
    found = _scored(anchors.select("rid", "label", "q", every.alias("windows")), cands, positives, True, chunk)
    best = Window.partitionBy("anchor").orderBy(F.desc("score"), F.coalesce("vec_id", F.lit(LAST)), "rid")
    pos = stored(found.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= positives), "negatives-positives")
    low, high = WINDOW
    windows = pos.select(
        "anchor",
        F.col("rid").alias("positive"),
        F.col("vec_id").alias("positive_id"),
        F.col("score").alias("positive_score"),
        F.expr(f"ceil({low} * score / 100)").cast("long").alias("w_lo"),
        F.expr(f"floor({high} * score / 100)").cast("long").alias("w_hi"),
    ).where(F.col("w_lo") <= F.col("w_hi"))
    asked = windows.groupBy(F.col("anchor").alias("rid")).agg(F.collect_list(F.struct("positive", "w_lo", "w_hi")).alias("windows"))
    found = _scored(stored(anchors.join(asked, "rid").select("rid", "label", "q", "windows"), "negatives-asks"), cands, negatives, False, chunk)
    firsts = Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), F.coalesce("vec_id", F.lit(LAST)), "rid")
    neg = found.withColumn("rank", F.row_number().over(firsts)).where(F.col("rank") <= negatives)
    return neg.join(windows, ["anchor", "positive"]).join(anchors.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor").select(
        "anchor_id",
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
