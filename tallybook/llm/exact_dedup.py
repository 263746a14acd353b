"""Exact deduplication by combining in three stages, whatever the size of a group.

Rows are aggregated inside their task first, then by (digest, content, salt), then
by (digest, content): a group of any size arrives at the last stage as at most
``salts`` rows.  Every stage groups by the full content next to its digest, so two
contents of one digest are never merged.  Rows find their class by digest alone
unless a digest has several contents; for those digests they are matched by content.

Texts are equal if they are the same without the characters ``[\\x20\\x09-\\x0D]``.
Of equal texts the row with the most code points stays, then the smallest doc_id.

Defined results: null counts as empty, and so does a text of white space alone.  A
null ``doc_id`` comes after all others.  Rows that repeat a doc_id and a length count
as rows in ``group_size``; they are marked alike, so they stay or go together.
Columns other than ``doc_id`` and ``text`` are not touched and may have any name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Fixed value: the characters that do not count.
WHITE = r"[\x20\x09-\x0D]+"


def sha256(content: Column) -> Column:
    return F.sha2(content, 256)


def _keyed(docs: DataFrame, digest: Callable[[Column], Column], *more: Column) -> DataFrame:
    original = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        *more, F.col("doc_id").alias("doc_id"), F.length(original).alias("n"), F.regexp_replace(original, WHITE, "").alias("content")
    )
    return rows.withColumn("digest", digest(F.col("content")))


def _merged(rows: DataFrame, salts: int) -> DataFrame:
    """digest, content, best (rank of the row that stays) and size of each group."""
    best = F.struct((-F.col("n")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n"), F.lit(salts)))
        .groupBy("digest", "content", "salt")
        .agg(F.min(best).alias("best"), F.count(F.lit(1)).alias("size"))
    )
    return salted.groupBy("digest", "content").agg(F.min("best").alias("best"), F.sum("size").alias("size"))


def _classes(rows: DataFrame, docs: DataFrame, digest, salts: int) -> DataFrame:
    """``rows`` (with digest, content) and the columns best and size of their groups."""
    classes = stored(_merged(_keyed(docs, digest), salts).drop("content"), "exact-classes")
    several = classes.groupBy("digest").count().where("count > 1").select("digest")
    if several.isEmpty():
        return rows.join(classes, "digest")
    several = stored(several, "exact-several")
    alone = classes.join(several, "digest", "left_anti")
    by_content = _merged(_keyed(docs, digest).join(several, "digest", "left_semi"), salts)
    return rows.join(alone, "digest").unionByName(rows.join(by_content, ["digest", "content"]), allowMissingColumns=True)


def _stays() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("n") == -F.col("best.shorter"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = 32) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 (the digest) of every row."""
    return _classes(_keyed(docs, digest), docs, digest, salts).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("size").alias("group_size"),
        _stays().alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def exact_kept(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = 32) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = _keyed(docs, digest, F.struct(*docs.columns).alias("row"))
    return _classes(rows, docs, digest, salts).where(_stays()).select("row.*")
