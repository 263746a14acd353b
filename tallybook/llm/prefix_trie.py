"""A prefix trie of conversations, by truncation peeling.

A conversation of ``L`` turns passes the nodes of depth 0 (the root) to ``L``:
the distinct sequences of its first ``d`` turns.  Peeling works from the deepest
turn upwards: a node of depth ``d`` is what its members share once their turns
after ``d`` are stripped, so one grouping of (conversation, depth) rows by the
stripped sequence discovers every node of every depth at once, with its members,
its parent (the sequence stripped by one more turn) and the conversations that
end there.  Totals over a subtree (leaves, saved tokens) are peeled the same
way: each node is counted once, by its smallest member, and a member's counts
are summed from its deepest node up to ``d``; the subtree of a node is exactly
what its members count at ``d`` or deeper.  So no level waits for another and
there is no loop over depths.

A sequence is known by its depth and two sums, over its turns, of 63-bit hashes
of (place, role, text) under two different orders of the arguments, kept as
exact decimals: about 126 bits, so two different sequences share a key with a
chance of about n^2 / 2^126 for n nodes.

Rebuilding (the operator's ``base`` and ``shared`` parameters): conversation ``c``
takes the first ``h`` turns of conversation ``c - c % base`` (SQL remainder; all
of them if fewer, none if it does not exist), then its own turns after its first
``h``, where ``h`` is the unsigned CRC-32 of the decimal ``c`` modulo ``shared``.

Defined results: turns are ordered by ``turn`` with null first, ties by role and
text; a null role or text is empty.  Rows with a null ``conv_id`` take no part.
A conversation whose rebuilt form has no turns is a member of the root only.
Repeated rows are repeated turns.  An empty table gives no nodes; extra columns
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.plans.skew import one_per_key

from .common import stored

KEY = ["depth", "k1", "k2"]
NODES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role, text."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    return rows.withColumn("pos", F.row_number().over(order)).drop("turn")


def rebuilt(conversations: DataFrame, base: int = 100, shared: int = 6) -> tuple[DataFrame, DataFrame]:
    """(every conv_id with its rebuilt length, the rebuilt turns: conv_id, depth, role, text)."""
    turns = stored(_turns(conversations), "trie-turns")
    convs = turns.select("conv_id").distinct().select(
        "conv_id",
        (F.col("conv_id") - F.col("conv_id") % base).alias("_base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).alias("_h"),
    )
    lengths = turns.groupBy(F.col("conv_id").alias("_base")).agg(F.max("pos").alias("_n_base"))
    convs = convs.join(lengths, "_base", "left").withColumn("_took", F.least(F.coalesce("_n_base", F.lit(0)), F.col("_h")))
    # at most ``shared`` turns of a base go to at most ``base`` conversations
    head = convs.join(turns.withColumnRenamed("conv_id", "_base"), "_base").where(F.col("pos") <= F.col("_h"))
    head = head.select("conv_id", F.col("pos").alias("depth"), "role", "text")
    tail = turns.join(convs.select("conv_id", "_h", "_took"), "conv_id").where(F.col("pos") > F.col("_h"))
    tail = tail.select("conv_id", (F.col("pos") - F.col("_h") + F.col("_took")).alias("depth"), "role", "text")
    steps = stored(head.unionByName(tail), "trie-rebuilt")
    sizes = convs.select("conv_id").join(steps.groupBy("conv_id").agg(F.max("depth").alias("length")), "conv_id", "left")
    return sizes.select("conv_id", F.coalesce("length", F.lit(0)).cast("long").alias("length")), steps


def _hashed(a: Column, b: Column, c: Column) -> Column:
    return F.xxhash64(a, b, c).bitwiseAND(F.lit((1 << 63) - 1)).cast("decimal(38,0)")


def paths(sizes: DataFrame, steps: DataFrame) -> DataFrame:
    """One row per conversation and depth 0..length: conv_id, depth, length, the prefix key, the parent's key, last."""
    prefix = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    keyed = steps.select(
        "conv_id",
        "depth",
        F.length("text").cast("long").alias("last"),
        _hashed(F.col("depth"), F.col("role"), F.col("text")).alias("_t1"),
        _hashed(F.col("text"), F.col("depth"), F.col("role")).alias("_t2"),
    )
    keyed = keyed.withColumns({"k1": F.sum("_t1").over(prefix), "k2": F.sum("_t2").over(prefix)})
    keyed = keyed.withColumns({"p1": F.col("k1") - F.col("_t1"), "p2": F.col("k2") - F.col("_t2")}).drop("_t1", "_t2")
    zero, none = F.lit(0).cast("decimal(38,0)"), F.lit(None).cast("decimal(38,0)")
    roots = sizes.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("last"), zero.alias("k1"), zero.alias("k2"), none.alias("p1"), none.alias("p2"))
    return keyed.join(sizes, "conv_id").unionByName(roots.join(sizes, "conv_id"))


def trie(conversations: DataFrame, base: int = 100, shared: int = 6) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    sizes, steps = rebuilt(conversations, base, shared)
    rows = stored(paths(sizes, steps.withColumn("depth", F.col("depth").cast("long"))), "trie-paths")
    ends = F.array_join(F.array_sort(F.collect_list(F.when(F.col("length") == F.col("depth"), F.col("conv_id")))), ",")
    nodes = rows.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"),
        F.count(F.lit(1)).alias("n_convs"),
        F.first("p1").alias("p1"),
        F.first("p2").alias("p2"),
        F.first("last").alias("last"),
        F.sha2(ends, 256).alias("ends_sha256"),
    )
    nodes = stored(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    # each node counted once, by its smallest member; members add up what they count from their deepest node up
    counted = nodes.select(
        "conv_id",
        "depth",
        (F.col("n_children") == 0).cast("long").alias("_leaf"),
        ((F.col("n_convs") - 1) * F.col("last")).alias("_saved"),
    )
    below = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    peeled = rows.select("conv_id", "depth", *KEY[1:]).join(counted, ["conv_id", "depth"], "left").select(
        *KEY,
        F.sum(F.coalesce("_leaf", F.lit(0))).over(below).alias("_leaves"),
        F.sum(F.coalesce("_saved", F.lit(0))).over(below).alias("_saved"),
    )
    totals = peeled.groupBy(*KEY).agg(F.sum("_leaves").alias("n_leaves"), F.sum("_saved").alias("saved_tokens"))
    parents = nodes.select((F.col("depth") + 1).alias("_pd"), F.col("k1").alias("_p1"), F.col("k2").alias("_p2"), F.col("conv_id").alias("parent_conv_id"))
    same = (F.col("depth") == F.col("_pd")) & (F.col("p1") == F.col("_p1")) & (F.col("p2") == F.col("_p2"))
    out = nodes.join(one_per_key(totals, *KEY), KEY).join(parents, same, "left")
    return out.select(*[F.col(c).cast("long").alias(c) if c != "ends_sha256" else F.col(c) for c in NODES])
