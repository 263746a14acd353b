"""SimHash near-deduplication by tiled exact comparison.

Distinct fingerprints are put into cells by the population counts of their four
16-bit parts, and cells into tiles of about ``tile`` fingerprints.  Two fingerprints
within the radius differ by at most the radius in the sum of the four counts'
differences, so only tiles of such cells are paired; within a pair all
fingerprints are compared by exclusive-or and bit counts.  A pair of tiles reports a
spanning forest of what it links, never all links.  Components grow by star
contraction, with a table in the shared folder after each round.

There are at most 17**4 cells, so their sizes may be broadcast.  The comparison is
exact, hence quadratic within neighbouring cells: see the README for its reach.

Defined results: null and empty texts, and texts of white space alone, have
fingerprint zero and are linked like others.  Texts of fewer words than a shingle
have one shingle, the whole sequence.  ``component_id`` is the least doc_id
reachable; null ids are passed over, and a component of null ids alone has a null
id.  Repeated rows are answered one by one.  Other columns may have any name.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SEED = 42
PIECE = 1 << 19
WHITE = re.compile(rb"[\x20\x09-\x0D]")
PARTS = 4
LINKS = "a long, b long"


def _word_runs(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about PIECE bytes at a time."""
    start = 0
    while start < len(data):
        gap = WHITE.search(data, start + PIECE)
        stop = gap.start() if gap else len(data)
        yield data[start:stop].split()  # of bytes: splits at [\x20\x09-\x0D]
        start = stop


def fingerprint(data: bytes, size: int) -> int:
    """64 bits, each set if it is set in over half of the shingles' hashes; A-Z count as a-z."""
    ones, count = np.zeros(64, np.int64), 0
    words: list[bytes] = []
    for run in _word_runs(data.lower()):  # of bytes: lowers A-Z only
        words += run
        fresh = len(words) - size + 1
        if fresh > 0:
            shingles = map(b" ".join, zip(*(words[i : fresh + i] for i in range(size)), strict=True))
            hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), np.uint64, fresh)
            bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
            count += fresh
            words = words[fresh:]
    if not count:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED) if words else 0
    return int(np.packbits(2 * ones > count, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a signed long) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py() or b"", size) for t in batch.column("text").cast(pa.binary())]
            signed = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), signed], ["doc_id", "fingerprint"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(run, "doc_id long, fingerprint long")


def forest(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what tile ``a`` and tile ``b`` (None: ``a`` itself) have within the radius: at most one per fingerprint."""
    nodes = a if b is None else np.concatenate([a, b])
    other, shift = (a, 0) if b is None else (b, len(a))
    label = np.arange(len(nodes))
    rows = max(1, (1 << 20) // max(1, len(other)))
    for start in range(0, len(a), rows):
        near = np.bitwise_count(a[start : start + rows, None] ^ other[None, :]) <= radius
        if b is None:
            near &= np.arange(len(a))[None, :] > np.arange(start, start + len(near))[:, None]
        for i in np.flatnonzero(near.any(axis=1)):
            met = label[np.append(np.flatnonzero(near[i]) + shift, start + i)]
            least = met.min()
            if (met != least).any():
                label[np.isin(label, np.unique(met))] = least
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for left, right in zip(batch.column("left"), batch.column("right"), strict=True):
                a = left.values.to_numpy().view(np.uint64)
                b = right.values.to_numpy().view(np.uint64) if right.is_valid else None
                found.append(forest(a, b, radius))
            if found:
                columns = [pa.array(np.concatenate(x).view(np.int64)) for x in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    return run


def _count(part: int) -> Column:
    bits = F.shiftrightunsigned("fingerprint", 16 * part).bitwiseAND(F.lit(0xFFFF))
    return F.bit_count(bits)


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of the part counts within the radius, one of each pair of opposites, without zero."""
    zero = (0,) * PARTS
    every = itertools.product(range(-radius, radius + 1), repeat=PARTS)
    return [s for s in every if sum(map(abs, s)) <= radius and s > zero]


def links(distinct: DataFrame, radius: int, tile: int = 2048) -> DataFrame:
    """Links (a, b) whose components are those of all fingerprints within the radius of each other."""
    places = [17**i for i in range(PARTS)]
    cell = sum((_count(i) * places[i] for i in range(PARTS)), F.lit(0)).cast("int")
    placed = distinct.select("fingerprint", cell.alias("cell"))
    sizes = placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / tile).cast("int").alias("tiles"))
    tiles = (
        placed.join(F.broadcast(sizes), "cell")
        .withColumn("no", F.pmod(F.xxhash64("fingerprint"), F.col("tiles")).cast("int"))
        .groupBy("cell", "no")
        .agg(F.collect_list("fingerprint").alias("tile"))
    )
    tiles = stored(tiles, "simhash-tiles")

    counts = [F.floor(F.col("cell") / place) % 17 for place in places]
    steps = F.array(*(F.array(*map(F.lit, s)) for s in _steps(radius)))
    moved = [c + F.col("step")[i] for i, c in enumerate(counts)]
    inside = F.lit(True)
    for m in moved:
        inside &= m.between(0, 16)
    near = tiles.withColumn("step", F.explode(steps)).where(inside)
    near = near.withColumn("to", sum((m * p for m, p in zip(moved, places, strict=True)), F.lit(0)).cast("int"))
    known = F.broadcast(sizes.withColumnRenamed("cell", "to"))
    near = near.join(known, "to").select(
        F.col("tile").alias("left"), "to", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("to_no")
    )
    # the later tiles of the same cell
    same = tiles.join(F.broadcast(sizes), "cell").where("no + 1 < tiles")
    same = same.select(
        F.col("tile").alias("left"), F.col("cell").alias("to"), F.explode(F.sequence(F.col("no") + 1, F.col("tiles") - 1)).alias("to_no")
    )
    facing = tiles.select(F.col("cell").alias("to"), F.col("no").alias("to_no"), F.col("tile").alias("right"))
    pairs = near.unionByName(same).join(facing, ["to", "to_no"]).select("left", "right")
    alone = tiles.where(F.size("tile") > 1).select(F.col("tile").alias("left"), F.lit(None).cast("array<long>").alias("right"))
    return pairs.unionByName(alone).mapInArrow(_compare(radius), LINKS)


def components(edges: DataFrame) -> DataFrame:
    """node and root (the least node of its component) of every node with a link, except the roots."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = stored(edges, "links")
    before = state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        # every larger neighbour moves to the least node around
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        # every smaller neighbour, and the node itself
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("least").alias("b"))
        edges = stored(small.distinct(), "links")
        after = state(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def near_groups(docs: DataFrame, size: int = 3, radius: int = 2, tile: int = 2048) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every row."""
    prints = stored(fingerprints(docs, size), "fingerprints")
    distinct = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"))
    distinct = stored(distinct, "simhash-distinct")
    roots = components(links(distinct, radius, tile))
    roots = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    first = roots.join(distinct, roots["node"] == distinct["fingerprint"]).groupBy("root").agg(F.min("first").alias("component_id"))
    known = roots.join(first, "root").select(F.col("node").alias("fingerprint"), "component_id")
    answer = distinct.join(known, "fingerprint", "left").select("fingerprint", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(answer, "fingerprint").select(
        "doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id"
    )


def near_kept(docs: DataFrame, size: int = 3, radius: int = 2) -> DataFrame:
    """The rows of ``docs`` whose id is that of their component, with all their columns."""
    kept = near_groups(docs, size, radius).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = kept.select(F.col("doc_id").alias("_kept_id")).distinct()
    return docs.join(kept.hint("merge"), docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")
