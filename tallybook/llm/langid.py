"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of every labelled row inside the tasks; only
(language, bucket, count) cells leave them.  The log-probability matrix has
``2 ** bits`` rows and one column per language, at most ``max_languages``, so
the driver and the broadcast hold a bounded amount whatever the corpus size.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if no labelled row exists.  A null ``doc_id`` belongs to no
fold: such a row is never learned from and not held out.  Equal scores go to the
language that sorts first.  Repeated rows are predicted one by one.  Only
``doc_id``, ``text`` and ``lang`` are read, so other columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import broadcast, stored

BITS = 15
SIZES = (1, 2, 3)
PIECE = 1 << 20
LETTER = re.compile(r"[^\W\d_]")
MODEL_CELLS = "lang string, bucket int, n long"
PREDICTION = (StructField("lang_pred", StringType()), StructField("score", DoubleType()))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # 2 ** bits rows, one column per language
    prior: np.ndarray
    bits: int


def gram_counts(text: str, bits: int) -> np.ndarray:
    """How often each bucket occurs among the character n-grams of the whole text."""
    counts = np.zeros(1 << bits, np.int64)
    text = text.lower()
    overlap = max(SIZES) - 1
    for start in range(0, len(text), PIECE):
        piece = text[max(0, start - overlap) : start + PIECE]
        known = min(start, overlap)  # characters that the piece before has counted
        chars = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        mixed = np.zeros(len(chars) + 1, np.uint64)
        for size in SIZES:
            count = len(chars) - size + 1
            if count <= 0:
                break
            mixed = mixed[:count] * np.uint64(0x100000001B3) + chars[size - 1 :] + np.uint64(size)
            fresh = mixed[max(0, known - size + 1) :]
            counts += np.bincount(
                ((fresh * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits
            )
    return counts


def _count_batches(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
                name = lang.as_py()
                rows[name] = rows.get(name, 0) + 1
                counts = gram_counts(text.as_py() or "", bits)
                if name in sums:
                    sums[name] += counts
                else:
                    sums[name] = counts
        for name, counts in sums.items():
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([name] * (len(used) + 1), pa.string()),
                    pa.array(np.append(used, -1), pa.int32()),
                    pa.array(np.append(counts[used], rows[name]), pa.int64()),
                ],
                ["lang", "bucket", "n"],
            )

    return run


def fit(labelled: DataFrame, bits: int = BITS, smoothing: float = 0.5, max_languages: int = 100) -> Model:
    """A model of all rows (lang, text) whose lang is not null."""
    rows = labelled.select("lang", "text").where(F.col("lang").isNotNull())
    cells = rows.mapInArrow(_count_batches(bits), MODEL_CELLS).groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    cells = stored(cells, "langid-cells")
    names = [r.lang for r in cells.where("bucket = -1").select("lang").take(max_languages + 1)]
    if len(names) > max_languages:
        raise ValueError(f"more than {max_languages} languages; the matrix would not be small")
    table = cells.toArrow() if names else None
    languages = sorted(names)
    counts = np.zeros((1 << bits, len(languages)))
    documents = np.zeros(len(languages))
    if table is not None:
        column = np.array([languages.index(x) for x in table["lang"].to_pylist()])
        bucket = table["bucket"].to_numpy()
        n = table["n"].to_numpy()
        grams = bucket >= 0
        counts[bucket[grams], column[grams]] = n[grams]
        documents[column[~grams]] = n[~grams]
    weights = np.log((counts + smoothing) / (counts.sum(axis=0) + smoothing * (1 << bits)))
    return Model(languages, weights, np.log(documents / max(documents.sum(), 1)), bits)


def score_counts(model: Model, counts: list[np.ndarray]) -> np.ndarray:
    """Log likelihoods of some texts: their sparse counts times the matrix."""
    used = [np.flatnonzero(c) for c in counts]
    ends = np.cumsum([len(u) for u in used])
    bucket = np.concatenate(used)
    parts = np.concatenate([c[u] for c, u in zip(counts, used, strict=True)])[:, None] * model.weights[bucket]
    return np.add.reduceat(parts, np.concatenate([[0], ends[:-1]]), axis=0) + model.prior


def _predict_batches(shared, block: int = 64):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            names: list[str] = ["und"] * batch.num_rows
            scores = np.zeros(batch.num_rows)
            waiting: list[tuple[int, np.ndarray]] = []

            def settle(waiting, names, scores) -> None:
                if not waiting:
                    return
                log = score_counts(model, [c for _, c in waiting])
                best = log.argmax(axis=1)
                share = 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
                for (row, _), b, s in zip(waiting, best, share, strict=True):
                    names[row] = model.languages[b]
                    scores[row] = s
                waiting.clear()

            for row, value in enumerate(batch.column("text")):
                text = value.as_py()
                if model.languages and text and LETTER.search(text):
                    waiting.append((row, gram_counts(text, model.bits)))
                if len(waiting) == block:
                    settle(waiting, names, scores)
            settle(waiting, names, scores)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["row", "lang_pred", "score"],
            )

    return run


def predict(docs: DataFrame, model: Model, *keep) -> DataFrame:
    """lang_pred and score (posterior probability) of every row, next to the columns ``keep`` as struct ``row``."""
    shared = broadcast(docs.sparkSession, model)
    rows = docs.select(F.struct(*keep).alias("row"), F.col("text").alias("text"))
    schema = StructType([rows.schema["row"], *PREDICTION])
    return rows.mapInArrow(_predict_batches(shared), schema)


def fold(doc_id="doc_id", folds: int = 5):
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % folds


def detect(docs: DataFrame, folds: int = 5, **fitting) -> DataFrame:
    """Languages of all documents, learned from those outside fold 0: doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(fold(folds=folds) != 0), **fitting)
    held = F.coalesce(fold(folds=folds) == 0, F.lit(False)).alias("held_out")
    return predict(docs, model, "doc_id", held).select("row.*", "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.5, folds: int = 5, **fitting) -> DataFrame:
    """The rows whose text has a language, found with a score of ``least`` or more."""
    model = fit(docs.where(fold(folds=folds) != 0), **fitting)
    found = predict(docs, model, *docs.columns)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
