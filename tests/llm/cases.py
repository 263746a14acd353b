"""Small tables for the text operators: nulls, empties, long texts, ties, repeats and clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("row", "digest", "content", "salt", "best", "size", "fingerprint", "component_id", "words", "hits", "found", "text_hash", "lang_pred", "score", "id", "n", "_kept_id", "_bad_id")
PASSAGE = "the committee will publish its yearly report on river levels and flood defences before the end of the spring session in parliament"


def words(seed: int, count: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(count))


def documents() -> list[tuple]:
    long_text = words(7, 20_000)
    rows = [
        (1, None, "en", "s", None),
        (2, "", None, None, 0),
        (3, " \t\n\r\x0b\x0c ", "en", "s", 7),
        (None, "no id here " + words(1, 40), "en", "s", 50),
        (4, long_text, "en", "s", len(long_text)),
        (5, long_text + " one more end", "en", "s", 1),
        (6, words(2, 60), "en", "s", 1),
        (7, words(2, 60).replace(" ", "  "), "en", "s", 1),
        (8, words(2, 60), "fr", None, 1),
        (9, words(3, 30) + " " + PASSAGE + " " + words(4, 30), "en", "s", 1),
        (10, words(5, 30) + " " + PASSAGE.upper() + " " + words(6, 30), "en", "s", 1),
        (11, "ab", "en", "s", 2),
        (11, "ab", "en", "s", 2),
        (12, "été ÉTÉ naïve 漢字 token: abcdEFGH1234 " + "f0" * 20, "fr", "s", 2),
        (13, "x" * 5000, "en", "s", 2),
        (14, "la " * 400, "fr", "s", 2),
    ]
    return rows


def frame(spark, rows=None, clashes=True):
    """The documents as a DataFrame, with columns whose names operators also use."""
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    if clashes:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(f"own {c}") for c in CLASHES})
    return df
