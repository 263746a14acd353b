"""Best-fit packing: pieces against the tokenizer itself, valid sequences, and as few as sequential best fit."""

import bisect
import os
import zlib
from collections import defaultdict

import cases
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallybook.llm import packing
from tallybook.llm.queries import QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
VOCAB = public_tokenizers.path("byte_bpe_50k.json")


def expected_pieces(rows, capacity=1024, end_id=2):
    """(doc_id, piece, start, length, crc32) of every document, by hand."""
    tok = Tokenizer.from_file(VOCAB)
    out = []
    for doc_id, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, end_id]
        first = len(ids) % capacity or capacity
        bounds = [0, *range(first, len(ids), capacity), len(ids)]
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            out.append((doc_id, i, a, b - a, zlib.crc32(np.asarray(ids[a:b], dtype="<u4").tobytes())))
    return sorted(out, key=repr)


def best_fit_decreasing(lengths, capacity=1024):
    """Sequences used by sequential best fit on the pieces, longest first."""
    gaps, count = [], 0
    for length in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, length)
        if i < len(gaps):
            gap = gaps.pop(i) - length
        else:
            gap, count = capacity - length, count + 1
        if gap:
            bisect.insort(gaps, gap)
    return count


def assert_valid(rows, capacity=1024):
    by_seq = defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
    for places in by_seq.values():
        places.sort()
        at = 0
        for offset, length in places:
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_seq)


def test_query_packs_every_piece(spark):
    import duckdb

    docs = duckdb.sql(f"select doc_id, text from '{SF_DIR}/documents.parquet'").fetchall()
    rows = QUERIES["op11_best_fit_packing"](spark, SF_DIR).collect()
    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr)
    assert got == expected_pieces(docs)
    n = assert_valid(rows)
    assert n <= 1.05 * best_fit_decreasing([r.length for r in rows if r.length < 1024]) + 1 + sum(r.length == 1024 for r in rows)


def test_cut_keeps_the_first_piece_short():
    assert [p[:3] for p in packing.cut(list(range(2500)), 1024)] == [(0, 0, 452), (1, 452, 1024), (2, 1476, 1024)]
    assert [p[:3] for p in packing.cut(list(range(2048)), 1024)] == [(0, 0, 1024), (1, 1024, 1024)]
    assert [p[:3] for p in packing.cut([2], 1024)] == [(0, 0, 1)]


def test_edges(spark):
    rows = cases.frame(spark).withColumn("pid", F.lit("clash"))
    got = packing.pack(rows, VOCAB, capacity=64).collect()
    want = expected_pieces([(r[0], r[1]) for r in cases.documents()], capacity=64)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=repr) == want
    assert_valid(got, 64)
    assert packing.pack(cases.frame(spark, []), VOCAB).count() == 0


@pytest.mark.parametrize("lengths", [[5] * 700, [1023, *[1] * 300], list(range(1, 200)) * 3, [600, 600, 424, 424, 300, 300, 300]])
def test_best_fit_is_valid_and_tight(spark, lengths):
    """Equal pieces by the hundred (one hot length), one large and many tiny, mixed."""
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "pid long, length long")
    placed = {r.pid: r for r in packing.best_fit(items, 1024, salts=4).collect()}
    assert sorted(placed) == list(range(len(lengths)))
    rows = [type("R", (), {"sequence_id": p.sequence_id, "offset": p.offset, "length": lengths[p.pid]}) for p in placed.values()]
    assert assert_valid(rows) <= best_fit_decreasing(lengths) * 1.05 + 1


@pytest.mark.parametrize("lengths", [list(range(1, 1024)), [700, *[300] * 5, *[24] * 40, *[7] * 999], [(i * i * 37) % 1023 + 1 for i in range(3000)]])
def test_exactly_as_many_sequences_as_best_fit_decreasing(spark, lengths):
    """Also by a plan whose size does not depend on the lengths (before: a table and some joins a round)."""
    items = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "pid long, length long")
    placed = packing.best_fit(items, 1024, salts=4)
    assert placed._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2
    rows = [type("R", (), {"sequence_id": p.sequence_id, "offset": p.offset, "length": lengths[p.pid]}) for p in placed.collect()]
    assert len(rows) == len(lengths)
    assert assert_valid(rows) == best_fit_decreasing(lengths)


def test_parts_are_encoded_as_whole_texts():
    rng = np.random.default_rng(3)
    signs = [*"      ab'1.,\n\t\x1c\x85", " ", " ", "é", "世", "́", "<|endoftext|>", "'s", " 'll"]
    texts = ["", " ", "a", *("".join(rng.choice(signs, rng.integers(0, 50))) for _ in range(3000)), "a " * 50 + "b" * 90, "Été word, über. œuvre! ×a ÷b, naïve; ŋ? İ ǆ:"]
    tok = Tokenizer.from_file(VOCAB)
    with open(VOCAB, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    for _ in range(2):  # the second time from memory
        got = [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)]
        assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    assert max(map(len, encoder._memo)) <= packing.SHORT


def test_words_are_encoded_once_whatever_signs_follow():
    """Parts end before signs and around line ends (before: a word with each sign and next line was a part of its own)."""
    words, signs = [f"w{'abcdefghij'[i % 10]}{'klmno'[i // 10]}" for i in range(50)], [",", ".", ";", ":", "!", "?", ")", "...", "###", "\n", ".\n"]
    rng = np.random.default_rng(4)
    lines = ["Start " + " ".join(w + s + (w if s[-1] == "\n" else "") for w in words for s in signs)]
    odd = [*"  \n\nab'1.,\t\r\x1c#(-)é世", " ", "'s", "don't", "<|endoftext|>", "<|", "²"]
    texts = [*lines, "", "\n", "a.\nb", "a.\n", "a.\n b", "a<|endoftext|> b, c.", *("".join(rng.choice(odd, rng.integers(0, 40))) for _ in range(3000))]
    tok = Tokenizer.from_file(VOCAB)
    with open(VOCAB, encoding="utf-8") as f:
        encoder = packing.Encoder(f.read())
    encoder.encode(lines)
    assert len(encoder._memo) <= 2 * len(words) + len(signs)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in encoder.encode(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
