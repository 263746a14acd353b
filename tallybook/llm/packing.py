"""Packing token pieces into sequences by best fit, longest first, over length classes.

A document's ids (its tokenizer's, then an end id) are cut only when longer than
a sequence: into ``capacity``-token pieces, of which the first takes the rest and
may be shorter.  Full pieces fill a sequence alone.  The other pieces are placed
by best fit decreasing, a length class at a time:

* Lengths and gap sizes are whole numbers up to ``capacity``, so all that best
  fit asks of the corpus is the histogram of its lengths: ``capacity`` rows at
  most, whatever the corpus.  Sequences that took the same lengths in the same
  order are one range of numbers with one gap.
* The classes go longest first.  Each fills the ranges of the smallest gap that is
  not below its length, as many pieces a sequence as fit, then those of the next
  gap; what finds no gap opens new sequences.  That is what sequential best fit does
  with equal pieces one by one: the gap a piece leaves, if it still fits, is the
  smallest.  A class parts at most two ranges, and a gap that is filled falls
  below half, so there are few runs (length, ranks, sequences, offset), in all
  at most some ``capacity * log2(capacity)``.
* The pieces of a length are ranked, all lengths at once, and the run that
  holds a piece's rank gives its sequence and offset.  Ranks come from counts per
  (length, salt), so a length held by a third of all pieces is numbered by many tasks.

Texts are split at single spaces between characters that are no white space, between ASCII letters
and signs (but apostrophes) and around single line ends, where the byte-level pre-tokenizer always
splits as well; no token goes across.  The different parts of many texts are found together, and
what the tokenizer gave short ones is remembered.  Words of Latin letters and runs of signs are given
to its model as its pre-tokenizer writes them.  A text that holds one of its added tokens is not split.

Defined results: a null text is empty, so its document is the end id alone; a
null ``doc_id`` stays null; repeated rows are packed as separate documents.
``sequence_id`` is any number shared by the pieces of one sequence; ``offset`` is
gapless from 0 inside it.  An empty table gives no rows.  Columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast, stored

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
RUNS = "length long, first_rank long, n long, sequence long, per long, first_offset long"
SALTS = 64
#: Characters whose parts are looked up at once.
SLICE_CHARS = 1 << 24
#: Longest part (bytes) of a text whose ids a worker remembers, and how many it remembers in each of two generations.
SHORT, REMEMBERED = 40, 400_000
#: White space of Python holds all that the pre-tokenizer knows, and more.
#: What the pre-tokenizer leaves whole: letters of Latin scripts, signs (an apostrophe may go with letters).
WORD = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]*)([!-&(-/:-@\[-`{-~]*)")
SPLIT, BESIDE = re.compile(r" (?<=\S )(?=\S)"), re.compile(r" (?:\s|(?<=\s ))")
#: Bytes of no UTF-8 text; they stand before each part, which has a space before it or has none.
SPACED, JOINED = b"\xff", b"\xfe"
#: Kinds of bytes: visible ASCII, of it letters and signs; line ends.
LETTER, SIGN, VISIBLE, LINE = 1, 2, 4, 8
KINDS = np.zeros(256, np.uint8)
KINDS[0x21:0x7F] = VISIBLE | SIGN
KINDS[[*b"0123456789'"]] = VISIBLE
KINDS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = VISIBLE | LETTER
KINDS[0x0A] = LINE


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.tobytes())


def cut(ids: Sequence[int], capacity: int) -> list[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids; only the first piece may be shorter."""
    whole = np.asarray(ids, dtype="<u4")
    first = len(whole) % capacity or min(capacity, len(whole))
    bounds = [0, *range(first, len(whole) + 1, capacity)] if len(whole) else [0]
    return [(i, a, b - a, _crc(whole[a:b])) for i, (a, b) in enumerate(zip(bounds, bounds[1:]))]


def parts(text: str) -> tuple[str, bytes]:
    """The text cut at spaces, which are left out, so that no token goes across: single ones with no other white space beside.
    The first part, and the others with ``SPACED`` before each."""
    if BESIDE.search(text):
        first, *others = SPLIT.split(text)
        return first, b"".join([SPACED + part.encode() for part in others])
    first, space, others = text.partition(" ")
    return first, SPACED + others.encode().replace(b" ", SPACED) if space else b""


def cut_further(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parts cut between letters and signs and around line ends between visible characters, with ``JOINED`` before each; where they were cut."""
    kinds = KINDS[data]
    if len(kinds) < 3:
        return data, np.zeros(0, np.int64)
    cut = np.zeros(len(kinds), bool)
    cut[1:] = (kinds[:-1] & LETTER > 0) & (kinds[1:] & SIGN > 0)
    lines = np.flatnonzero(kinds[1:-1] == LINE) + 1
    lines = lines[(kinds[lines - 1] & kinds[lines + 1] & VISIBLE) > 0]
    cut[lines] = cut[lines + 1] = True
    at = np.flatnonzero(cut)
    return np.insert(data, at, JOINED[0]), at


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``count`` of them, one run behind the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


class Encoder:
    """Ids of whole texts, by a tokenizer that is asked once for a part it saw lately.

    Ids of short parts are remembered in two generations of about REMEMBERED:
    a full one becomes the older, and what is used again moves to the younger.
    """

    def __init__(self, vocabulary: str):
        self.vocabulary = vocabulary
        self._tokenizer = self._model = self._signs = self._added = None
        self._memo: dict[bytes, bytes] = {}
        self._older: dict[bytes, bytes] = {}

    def _library(self):
        if self._tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
            from tokenizers import Tokenizer, pre_tokenizers

            self._tokenizer = Tokenizer.from_str(self.vocabulary)
            self._model = self._tokenizer.model
            self._added = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
            # how the byte-level pre-tokenizer writes each byte that these words hold
            byte_level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            letters = ["\n", *(chr(c) for c in range(0x20, 0x2B0))]
            self._signs = {c: byte_level.pre_tokenize_str(c)[0][0] for c in letters}
        return self._tokenizer

    def _ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for at in range(0, len(texts), 1000):  # an encoding of the library holds some 100 bytes a token
            out += [np.array(e.ids, "<u4").tobytes() for e in self._library().encode_batch_fast(texts[at : at + 1000], add_special_tokens=False)]
        return out

    def _encoded(self, new: list[bytes]) -> list[bytes]:
        """The ids of each part; words and signs go to the model straight away, as pre-tokenized."""
        written, of_written, match = self._signs, self._of_written, WORD.fullmatch
        out, rest, spaced = [], [], SPACED[0]
        signs: dict[str, bytes] = {"": b""}
        line = of_written(written["\n"])
        for part in new:
            text = part[1:].decode()
            space = written[" "] if part[0] == spaced else ""
            found = match(text)
            if found and text:
                word, after = found.groups()
                if word:
                    ids = of_written(space + (word if word.isascii() else "".join([written[c] for c in word])))
                    if after:
                        if after not in signs:
                            signs[after] = of_written(after)
                        ids += signs[after]
                    out.append(ids)
                else:
                    out.append(of_written(space + after))
            elif text == "\n" and not space:
                out.append(line)
            else:
                rest.append(len(out))
                out.append(f" {text}" if space else text)
        for i, ids in zip(rest, self._ids([out[i] for i in rest])):
            out[i] = ids
        return out

    def _of_written(self, written: str) -> bytes:
        """The model's ids of what the pre-tokenizer leaves whole."""
        ids = [t.id for t in self._model.tokenize(written)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, little-endian unsigned 32-bit."""
        self._library()
        split = [(t, b"") if any(token in t for token in self._added) else parts(t) for t in texts]
        firsts = self._ids([first for first, _ in split])
        data, further = cut_further(np.frombuffer(b"".join([others for _, others in split]), np.uint8))
        begins = np.flatnonzero(data >= JOINED[0])
        offsets = pa.py_buffer(np.append(begins, len(data)))
        each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(begins), [None, offsets, pa.py_buffer(data)]).dictionary_encode()
        of_text = np.cumsum([0, *(len(others) for _, others in split)])
        bounds = np.searchsorted(begins, of_text + np.searchsorted(further, of_text)).tolist()
        known = self._known(each.dictionary.to_pylist())
        ids, sizes = np.frombuffer(b"".join(known), "<u4"), np.fromiter(map(len, known), np.int64, len(known)) // 4
        at, which = np.cumsum(sizes) - sizes, each.indices.to_numpy()
        out = []
        for first, a, b in zip(firsts, bounds, bounds[1:]):
            of = which[a:b]
            out.append(first + ids[spread(at[of], sizes[of])].tobytes())
        return out

    def _known(self, different: list[bytes]) -> list[bytes]:
        """The ids of each part, from memory or the tokenizer."""
        if len(self._memo) >= REMEMBERED:
            self._memo, self._older = {}, self._memo
        out = list(map(self._memo.get, different))
        new = []
        for i in [i for i, ids in enumerate(out) if ids is None]:
            out[i] = self._older.get(different[i])
            if out[i] is None:
                new.append(i)
            else:
                self._memo[different[i]] = out[i]
        for i, ids in zip(new, self._encoded([different[i] for i in new])):
            out[i] = ids
            if len(different[i]) <= SHORT:
                self._memo[different[i]] = ids
        return out


def tokenized(docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (unsigned, of little-endian uint32 ids)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = broadcast(docs.sparkSession, Encoder(f.read()))  # a vocabulary: of bounded size

    def run(batches):
        encode = shared.value.encode
        end = end_id.to_bytes(4, "little")
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            # an encoding keeps token strings too: encode a bounded number of characters at once
            start = 0
            while start < len(texts):
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars + len(texts[stop] or "") <= SLICE_CHARS):
                    chars += len(texts[stop] or "")
                    stop += 1
                out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
                for doc_id, encoded in zip(ids[start:stop], encode([t or "" for t in texts[start:stop]])):
                    for row in cut(np.frombuffer(encoded + end, "<u4"), capacity):
                        for k, v in zip(out, (doc_id, *row)):
                            out[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types)], list(out))
                start = stop

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECES)


def runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit decreasing of so many pieces of each length: (length, first_rank, n, sequence, per, first_offset).

    The ``n`` pieces of the length from ``first_rank`` on go to the sequences from ``sequence`` on,
    ``per`` to each, behind the first ``first_offset`` tokens.
    """
    gaps: list[int] = []  # sizes of gaps there are, ascending
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)  # per gap (first sequence, number of sequences)
    out, opened = [], 0

    def leave(gap: int, first: int, n: int) -> None:
        if gap and n:
            if not ranges[gap]:
                bisect.insort(gaps, gap)
            ranges[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                first, n = ranges[gap].pop()
                if not ranges[gap]:
                    gaps.pop(at)
            else:
                gap, first, n = capacity, opened, -(-left // (capacity // length))
                opened += n
            per = gap // length
            filled = min(n, left // per)
            if filled:
                out.append((length, rank, filled * per, first, per, capacity - gap))
                leave(gap - per * length, first, filled)
                rank, left, first, n = rank + filled * per, left - filled * per, first + filled, n - filled
            if n and left:  # fewer than one sequence takes
                out.append((length, rank, left, first, per, capacity - gap))
                leave(gap - left * length, first, 1)
                left, first, n = 0, first + 1, n - 1
            leave(gap, first, n)
    return out


def best_fit(items: DataFrame, capacity: int, salts: int = SALTS) -> DataFrame:
    """``items`` (pid unique, 1 <= length <= capacity; read several times) with sequence_id and offset."""
    # full pieces get negative numbers, the others those of the plan
    full = items.where(F.col("length") == capacity).withColumns({"sequence_id": -1 - F.col("pid"), "offset": F.lit(0).cast("long")})
    open_ = items.where(F.col("length") < capacity).withColumn("_salt", F.pmod(F.xxhash64("pid"), F.lit(salts)))
    counts = open_.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n"))  # at most capacity x salts rows
    totals = dict(counts.groupBy("length").agg(F.sum("_n")).collect())  # at most ``capacity`` rows
    plan = items.sparkSession.createDataFrame(runs(totals, capacity), RUNS).withColumnRenamed("length", "_length")
    ahead = counts.withColumn("_ahead", F.sum("_n").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("pid")) - 1
    ranked = open_.withColumn("_within", within).join(F.broadcast(ahead), ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_ahead") + F.col("_within"))
    in_run = (F.col("_length") == F.col("length")) & (F.col("_rank") >= F.col("first_rank")) & (F.col("_rank") < F.col("first_rank") + F.col("n"))
    placed = ranked.join(F.broadcast(plan), in_run).withColumn("_at", F.col("_rank") - F.col("first_rank"))
    placed = placed.withColumns(
        {
            "sequence_id": F.col("sequence") + F.expr("_at div per"),
            "offset": F.col("first_offset") + F.col("_at") % F.col("per") * F.col("length"),
        }
    )
    return full.unionByName(placed.select(*full.columns))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = stored(tokenized(docs, tokenizer_path, end_id, capacity).withColumn("pid", F.monotonically_increasing_id()), "pack-pieces")
    return best_fit(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame) -> Column:
    """The number of sequences of a packing (an aggregate)."""
    return F.count_distinct("sequence_id")
