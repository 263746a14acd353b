"""A corpus pipeline of text operators: each stage works on all that the one before kept.

Stages take and return the columns of ``documents``; the last returns the token digests.
Rows with null or empty texts have no language, so the first stage drops them; the
stages' other defined results are those of their operators.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallybook.llm import bpe, decontaminate, exact_dedup, langid, simhash
from tallybook.llm.common import stored, table


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier tells with a score of 0.5 or more."""
    return langid.accepted(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest, then first, of texts that are equal without white space."""
    return exact_dedup.exact_kept(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by 3-word fingerprints within two bits."""
    return simhash.near_kept(docs, size=3, radius=2)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten words in a row of a benchmark item."""
    return decontaminate.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def as_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts that are left."""
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language id", with_language),
    ("exact dedup", without_copies),
    ("simhash near dedup", without_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("byte bpe", as_tokens),
]

#: The classifier and the fingerprints' components have no SQL form; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
