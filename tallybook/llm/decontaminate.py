"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Items are cut into windows of ``window`` words (a shorter item is one window), and
windows and texts into shingles of ``shingle`` words.  A text shares all shingles of
a window it contains, so the windows' shingles are ordered by how often they occur
in the texts and only the rarest, the necessary prefix for full overlap, is joined.
A window with a shingle that occurs nowhere is dropped.  Where a prefix meets a text
the window's place follows from the shingle's offset; it must lie inside the text, and
the words there must be the window's words.

The items' shingles are broadcast if counted to be at most ``small`` (16 bytes each),
else joined by a shuffle.  Hits are kept per text in arrays no longer than the text
has words (times the items that share a shingle).

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lowering A-Z.

Defined results: null has no words, and a text or item without words hits nothing.
Items that repeat an id count as one item with all its windows; null item ids are
left out of ``items``.  Rows that repeat a doc_id are told apart by their text and
answered one by one.  Other columns may have any name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed value: a word of lowered text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same for text whose A-Z are not lowered yet.
WORD_ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0))


def _shingles(words_: Column, size: int) -> Column:
    """Hashes of the runs of ``size`` words; none if there are fewer."""
    places = F.sequence(F.lit(1), F.size(words_) - size + 1)
    hashes = F.transform(places, lambda i: F.xxhash64(F.slice(words_, i, size)))
    return F.when(F.size(words_) >= size, hashes).otherwise(F.array().cast("array<long>"))


def item_windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """item_id, window number, its words, and per shingle: offset and hash (one row each)."""
    items = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    windows = items.select(
        "item_id",
        F.explode(F.transform(F.sequence(F.lit(1), F.size("words") - length + 1), lambda i: F.slice("words", i, length))).alias("words"),
    )
    windows = windows.distinct().withColumn("window", F.xxhash64("item_id", "words"))
    size = F.least(F.size("words"), F.lit(shingle))
    hashes = F.transform(F.sequence(F.lit(1), F.size("words") - size + 1), lambda i: F.xxhash64(F.slice("words", i, size)))
    return windows.select("item_id", "window", "words", size.alias("size"), F.posexplode(hashes).alias("offset", "hash"))


def _found(docs: DataFrame, parts: DataFrame, small: int) -> DataFrame:
    """Per text with any: the places of the items' shingles in it."""
    wanted = parts.select("hash", "size").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= small else wanted
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words"))
    sizes = sorted(r.size for r in parts.select("size").distinct().collect())  # 1 .. shingle at most
    by_size = [
        texts.select("doc_id", "text_hash", F.lit(s).alias("size"), F.posexplode(_shingles(F.col("words"), s)).alias("place", "hash"))
        for s in sizes
    ]
    rows = by_size[0]
    for more in by_size[1:]:
        rows = rows.unionByName(more)
    hits = rows.join(wanted, ["hash", "size"])
    return hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("place", "size", "hash")).alias("found"))


def _covered(spans: Column) -> Column:
    """How many places the spans (start, length) cover together."""
    start = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("reach"))

    def step(state: Column, span: Column) -> Column:
        end = span["start"] + span["length"]
        fresh = F.greatest(F.lit(0), end - F.greatest(state["reach"], span["start"]))
        return F.struct((state["covered"] + fresh).alias("covered"), F.greatest(state["reach"], end).alias("reach"))

    return F.aggregate(F.array_sort(spans), start, step, lambda s: s["covered"])


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shingle: int = 5, small: int = 1_000_000) -> DataFrame:
    """doc_id, text_hash, n_words, n_hit and the sorted items (as text) of every row."""
    docs = docs.select("doc_id", "text")
    parts = stored(item_windows(benchmark, window, shingle), "benchmark-windows")
    count = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_ANY_CASE)).cast("long")
    plain = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), count.alias("n_words"))
    if parts.isEmpty():
        return plain.select("*", F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("items"))
    found = stored(_found(docs, parts, small), "benchmark-found")

    often = found.select(F.explode("found.hash").alias("hash")).groupBy("hash").count()
    rare = F.min(F.struct("count", "offset", "hash", "size"))
    shingles = parts.groupBy("window").agg(F.count(F.lit(1)).alias("all"))
    prefixes = (
        parts.join(often, "hash")
        .groupBy("item_id", "window", "words")
        .agg(rare.alias("rarest"), F.count(F.lit(1)).alias("present"))
        .join(shingles, "window")
        .where(F.col("present") == F.col("all"))
        .select("item_id", F.col("words").alias("window_words"), "rarest.hash", "rarest.size", "rarest.offset")
    )

    # the words around each place; a window that holds the place lies within them.
    # One plan at every size: the texts are shuffled once, however small the other side is
    around = window - 1
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text", count.alias("n_words"))
    same = texts["doc_id"].eqNullSafe(found["doc_id"]) & (texts["text_hash"] == found["text_hash"])
    met = texts.join(found.hint("merge"), same, "left").select(texts["doc_id"], texts["text_hash"], "n_words", "found", F.when(F.col("found").isNotNull(), words(F.col("text"))).alias("words"))
    first = lambda f: F.greatest(F.lit(0), f["place"] - around)
    hits = F.transform(
        "found",
        lambda f: F.struct(f["hash"], f["size"], f["place"], first(f).alias("first"), F.slice("words", first(f) + 1, 2 * around + 1).alias("near")),
    )
    met = stored(met.select("doc_id", "text_hash", "n_words", hits.alias("hits")), "benchmark-met")

    start = F.col("hit.place") - F.col("offset")
    length = F.size("window_words")
    inside = (start >= 0) & (start + length <= F.col("n_words"))
    verified = (
        met.where("hits is not null")
        .select("doc_id", "text_hash", "n_words", F.explode("hits").alias("hit"))
        .select("*", F.col("hit.hash").alias("hash"), F.col("hit.size").alias("size"))
        .join(prefixes, ["hash", "size"])
        .where(inside)
        .where(F.slice("hit.near", F.greatest(F.lit(1), start - F.col("hit.first") + 1), length) == F.col("window_words"))
        .groupBy("doc_id", "text_hash")
        .agg(
            F.collect_set(F.struct(start.alias("start"), length.alias("length"))).alias("spans"),
            F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
        )
    )
    base = met.select("doc_id", "text_hash", "n_words")
    same = base["doc_id"].eqNullSafe(verified["doc_id"]) & base["text_hash"].eqNullSafe(verified["text_hash"])
    return base.join(verified, same, "left").select(
        base["doc_id"],
        base["text_hash"],
        "n_words",
        F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
    )


def report(found: DataFrame) -> DataFrame:
    """The counts and the digest of the items of each row."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def uncontaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` without a hit, with all their columns."""
    bad = contamination(docs, benchmark, **how).where("n_hit > 0")
    bad = bad.select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_text")).distinct()
    same = docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs["text"]) == bad["_bad_text"])
    return docs.join(bad.hint("merge"), same, "left_anti")
