"""The registered queries of the text operators, over whole tables and with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, exact_dedup, html_text, langid, negatives, packing, pii, prefix_trie, secret_scan, simhash, suffix_dedup
from .common import table


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.detect(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), with_text=False).drop("kept")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.report(found)


#: A conversation whose texts hold control strings.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return chat.digest(rows.unionByName(probe))


#: A key for demonstration; in production it is a secret of whoever runs the job.
PSEUDONYM_KEY = "not a secret"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.pseudonyms(table(spark, sf_dir, "documents"), PSEUDONYM_KEY))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), size=3, radius=2)


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=2, capacity=1024)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(table(spark, sf_dir, "embeddings"), anchor_every=100, positives=5, negatives=10)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"), base=100, shared=6)


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_text,
        op2_byte_bpe,
        op3_exact_dedup,
        op4_secret_scan,
        op5_language_id,
        op6_suffix_dedup,
        op7_decontaminate,
        op8_chat_format,
        op9_pii,
        op10_simhash,
        op11_best_fit_packing,
        op12_hard_negatives,
        op13_prefix_trie,
    )
}

EXACT_DEDUP_SQL = r"""
WITH t AS (
    SELECT doc_id, length(coalesce(text, '')) AS n,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
    FROM documents
)
SELECT doc_id,
       first_value(doc_id) OVER best AS keep_id,
       count(*) OVER (PARTITION BY content) AS group_size,
       doc_id = first_value(doc_id) OVER best AS kept,
       sha256(content) AS text_sha256
FROM t
WINDOW best AS (PARTITION BY content ORDER BY n DESC, doc_id)
"""

DECONTAMINATE_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents
), b AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), items AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest([w[i:i + least(len(w), 10) - 1] FOR i IN range(1, len(w) - least(len(w), 10) + 2)]) AS win
    FROM b WHERE len(w) > 0
), places AS (
    SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, (SELECT DISTINCT n FROM items)
), hits AS (
    SELECT p.doc_id, p.i, p.n, x.item_id
    FROM (SELECT doc_id, n, i, w[i:i + n - 1] AS win FROM places) p JOIN items x ON p.win = x.win AND p.n = x.n
), covered AS (
    SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hits) GROUP BY doc_id
), named AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""

HARD_NEGATIVES_SQL = r"""
WITH r AS (
    SELECT row_number() OVER () AS rid, vec_id,
           CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)
), a AS (
    SELECT rid AS a_rid, vec_id AS anchor_id, label AS a_label, q AS a_q FROM r WHERE vec_id % 100 = 0
), s AS (
    SELECT a_rid, anchor_id, a_label, rid, vec_id, label,
           CAST(coalesce(list_sum(list_transform(range(1, greatest(len(a_q), len(q)) + 1),
                                                 lambda i: coalesce(a_q[i], 0) * coalesce(q[i], 0))), 0) AS BIGINT) AS score
    FROM a CROSS JOIN r
), p AS (
    SELECT a_rid, anchor_id, rid AS p_rid, vec_id AS positive_id, score AS positive_score
    FROM s WHERE label = a_label AND rid <> a_rid
    QUALIFY row_number() OVER (PARTITION BY a_rid ORDER BY score DESC, vec_id NULLS LAST, rid) <= 5
), n AS (
    SELECT p.anchor_id, p.positive_id, p.positive_score, s.vec_id AS negative_id, s.score AS negative_score,
           row_number() OVER (PARTITION BY p.a_rid, p.p_rid ORDER BY s.score DESC, s.vec_id NULLS LAST, s.rid) AS rank
    FROM p JOIN s ON s.a_rid = p.a_rid AND s.label <> s.a_label
     AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
    QUALIFY rank <= 10
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
"""

ORACLES = {"op3_exact_dedup": EXACT_DEDUP_SQL, "op7_decontaminate": DECONTAMINATE_SQL, "op12_hard_negatives": HARD_NEGATIVES_SQL}
