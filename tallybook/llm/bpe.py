"""Byte-level BPE by dynamic programming over prefixes.

A byte string has one BPE encoding, and so has each of its prefixes.  The store
holds, for every prefix of a piece, the last token of that encoding.  It is the
one token ending there which the encoding of the bytes before it accepts as a
neighbour: two tokens are neighbours in some encoding exactly if encoding their
joint bytes gives the two of them again.  Appending bytes therefore only adds
entries, and an edit changes entries from its place on until the store agrees
with the old one for as many prefixes as the longest token has bytes.

A text is cut by the split pattern first; each match is a piece of its own.

Defined results: a null or empty text has no tokens.  Ids without a token raise
``KeyError`` when decoded; invalid UTF-8 cannot occur in a Spark string.  Only
``doc_id`` and ``text`` are read; repeated rows are encoded one by one.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast

MEMO_PIECES = 400_000
MEMO_CHARS = 40
LONG_CHARS = 1 << 20
TOKENS = "doc_id long, ids array<int>"
TEXTS = "doc_id long, text binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a rank file (base64 and rank per line); a vocabulary, so of bounded size."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Ranks, the last merge of every token and the neighbour test."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        self._pairs: dict[tuple[int, int], bool] = {}
        halves = {t: self._halves(t) for t in ranks}
        # tokens whose own bytes encode otherwise occur only as whole pieces
        split_up = {t for t, h in halves.items() if h is None}
        #: All endings of tokens, with the token's id, or -1 for what is not a token by itself.
        self.endings = {t[i:]: -1 for t in ranks for i in range(len(t))}
        self.endings.update((t, rank) for t, rank in ranks.items() if t not in split_up)
        halves = {t: h for t, h in halves.items() if h}
        #: Whether no token is merged before its parts; then ranks tell the order of all merges.
        self.ordered = all(ranks[t] > max(map(ranks.__getitem__, h)) for t, h in halves.items())
        self._ends = {ranks[t]: self._spine(t, halves, 1) for t in halves}
        self._starts = {ranks[t]: self._spine(t, halves, 0) for t in halves}
        for t in ranks:
            if len(t) == 1:
                self._ends[ranks[t]] = self._starts[ranks[t]] = [(t, float("inf"))]

    def merged(self, data: bytes, down_to: int = 1) -> list[bytes]:
        """The encoding of a few bytes by its definition: merge the pair of least rank, leftmost first."""
        parts = [data[i : i + 1] for i in range(len(data))]
        none = float("inf")
        while len(parts) > down_to:
            rank, at = min((self.ranks.get(a + b, none), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _halves(self, token: bytes) -> tuple[bytes, ...] | None:
        """What the last merge of the token joins; () for one byte, None if its bytes encode otherwise."""
        if len(token) == 1:
            return ()
        parts = self.merged(token, 2)
        return tuple(parts) if len(parts) == 2 else None

    def _spine(self, token: bytes, halves: dict, side: int) -> list[tuple[bytes, float]]:
        """The parts at one side of the token, smallest first, each with the rank of the merge that takes it up."""
        spine, until = [], float("inf")
        while token:
            spine.append((token, until))
            until = self.ranks[token]
            token = halves[token][side] if token in halves else b""
        return spine[::-1]

    def neighbours(self, left: int, right: int) -> bool:
        """Whether no merge joins the two while their bytes are encoded together."""
        known = self._pairs.get((left, right))
        if known is None:
            known = self._pairs[left, right] = self._apart(left, right)
        return known

    def _apart(self, left: int, right: int) -> bool:
        if not self.ordered:
            a, b = self.tokens[left], self.tokens[right]
            return self.merged(a + b) == [a, b]
        ends, starts, ranks = self._ends[left], self._starts[right], self.ranks
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = ends[i], starts[j]
            rank = ranks.get(a + b)
            # of equal ranks the leftmost merge comes first
            if rank is not None and rank < a_until and rank <= b_until:
                return False
            if a_until <= b_until:
                if i + 1 == len(ends):
                    return True
                i += 1
            else:
                j += 1

    def forget(self) -> None:
        self._pairs.clear()


class PrefixStore:
    """One piece and the last token of each of its prefixes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []
        self.append(data)

    def _last_token(self, end: int) -> int:
        v, data, last = self.vocabulary, self.data, self.last
        endings, pairs = v.endings, v._pairs
        start = end - 1
        while start >= 0:
            token = endings.get(data[start:end])
            if token is None:
                break
            if token >= 0:
                if start == 0:
                    return token
                before = last[start - 1]
                apart = pairs.get((before, token))
                if apart or apart is None and v.neighbours(before, token):
                    return token
            start -= 1
        raise KeyError(f"no token for byte {data[end - 1]}")

    def append(self, data: bytes) -> None:
        self.data += data
        for end in range(len(self.last) + 1, len(self.data) + 1):
            self.last.append(self._last_token(end))

    def replace(self, start: int, stop: int, data: bytes) -> int:
        """Puts ``data`` for the bytes from ``start`` to ``stop``; returns how many prefixes were worked out anew."""
        old = self.last[stop:]
        self.data = self.data[:start] + data + self.data[stop:]
        del self.last[start:]
        same = 0
        first_old = start + len(data)
        for end in range(start + 1, len(self.data) + 1):
            self.last.append(self._last_token(end))
            before = end - 1 - first_old
            same = same + 1 if before >= 0 and old[before] == self.last[-1] else 0
            if same >= self.vocabulary.longest:
                self.last += old[before + 1 :]
                return end - start
        return len(self.data) - start

    def ids(self) -> list[int]:
        out, end = [], len(self.data)
        while end:
            out.append(self.last[end - 1])
            end -= len(self.vocabulary.tokens[out[-1]])
        return out[::-1]


class Encoder:
    """Texts to ids and back.

    Ids of short pieces are remembered in two generations of at most MEMO_PIECES:
    a full one becomes the older, and what is used again moves to the younger.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.pattern = pattern
        self._memo: dict[str, tuple[int, ...]] = {}
        self._older: dict[str, tuple[int, ...]] = {}

    def piece(self, text: str) -> tuple[int, ...]:
        ids = self._older.get(text)
        if ids is None:
            data = text.encode()
            token = self.vocabulary.ranks.get(data)
            ids = (token,) if token is not None else tuple(PrefixStore(self.vocabulary, data).ids())
        if len(text) <= MEMO_CHARS:
            if len(self._memo) >= MEMO_PIECES:
                self._older, self._memo = self._memo, {}
                self.vocabulary.forget()
            self._memo[text] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        if len(text) <= LONG_CHARS:
            pieces = regex.findall(self.pattern, text)
        else:  # one at a time
            pieces = (match[0] for match in regex.finditer(self.pattern, text))
        for piece in pieces:
            ids += self._memo.get(piece) or self.piece(piece)
        return ids

    def decode(self, ids) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


def _shared(docs: DataFrame, ranks_path: str, pattern: str):
    """The encoder as a broadcast: a fixed vocabulary; workers keep it, and what it remembers, between tasks."""
    return broadcast(docs.sparkSession, Encoder(read_ranks(ranks_path), pattern))


def _ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the token ids of each whole text."""
    shared = _shared(docs, ranks_path, pattern)

    def run(batches):
        for batch in batches:
            lists = [shared.value.encode(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lists, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _ids_and_texts(docs).mapInArrow(run, TOKENS)


def decode(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the bytes of each list of ids."""
    shared = _shared(tokens, ranks_path, "")

    def run(batches):
        for batch in batches:
            texts = [shared.value.decode(ids.as_py() or ()) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, TEXTS)


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes and decodes each text in one task: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    shared = _shared(docs, ranks_path, pattern)

    def run(batches):
        encoder = shared.value
        written = {i: str(i) for i in encoder.vocabulary.tokens}
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                ids = encoder.encode(text.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(written.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(encoder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), *(pa.array(x, pa.string()) for x in (ids_sha, text_sha))],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _ids_and_texts(docs).mapInArrow(run, DIGESTS)
