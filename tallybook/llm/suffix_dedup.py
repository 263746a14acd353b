"""Removal of repeated byte strings over a whole corpus, by Burrows-Wheeler intervals.

A byte is removed if a string of ``length`` bytes that covers it also starts earlier:
in a document of a smaller id, or earlier in the same document.

Equal strings are brought together by content.  Each window of ``length`` bytes has
an anchor, the least hash of its ``GRAM``-byte strings; equal windows have equal
anchors.  Consecutive windows with one anchor form a segment.

1. Segments' anchors are counted; where an anchor occurs once no window repeats, so
   its segment is left out.  Anchors repeated in a batch send one row to the count.
2. The remaining segments are cut out of the texts.  Of equal segments in a batch one
   goes on; the others repeat it whole.
   An anchor of more than ``HOT`` segments (up to four times as many, if that is at most 1/32 of what a task gets)
   would fill a task: its segments go on window by window, dealt by a hash of the whole window, and equal windows are compared as they are.
   The hot anchors are known by ``HOT_BITS`` bits, so others may go with them; as all windows
   of an anchor go the same way, the result does not depend on it.
3. Segments of the other anchors meet by anchor in a task, in order, in blocks of about ``BLOCK`` bytes.  A block's
   suffixes are sorted by at least ``length`` symbols, and from the Burrows-Wheeler
   transform the common prefixes of neighbours are derived by breadth-first backward
   extension: intervals of strings of l + 1 bytes end where the common prefix is l.  It
   stops at ``length``: neighbours without a value share ``length`` bytes or more.
   In each such class all but the earliest window are removed.

Tasks hold a portion of their rows: ``PORTION`` bytes of texts when marking, ``HELD`` bytes of different segments when
cutting, the rows of an anchor when counting and a block when comparing.  Spark sorts for the last two and can spill.
From the count on there are as many tasks as give each about ``TASK`` segments, if the session has fewer.

Defined results: a null or empty text, or one shorter than ``length``, loses nothing.  A
null ``doc_id`` comes after all others.  Rows that repeat a doc_id with another text are
ordered by a hash of the text (of 32 bits); full repeats are one document and keep what it keeps.
Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

GRAM = 24
BLOCK = 1 << 17
CHUNK = 1 << 18
LONGEST_RUN = 1024
LAST_ID = (1 << 63) - 1
HOT = 1024
HOT_BITS = 18
PORTION = 1 << 25
HELD = 3 << 23
ROWS = 1 << 14
RUN_BYTES = 64
TASK = 1 << 17

COUNT_BITS = 12
MARKS = "anchor long, salt int, weight int, id long, text_hash int, place long"
FLAGGED = "anchor long, id long, text_hash int, place long, kinds int"
SEGMENTS = "anchor long, id long, text_hash int, start int, count int, segment binary"
RUNS = "id long, text_hash int, start int, count int"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _batch(names: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "string": pa.string()}
    fields = [c.split() for c in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def anchors(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The mixed hashes of all GRAM-byte strings; for each start of a window, the least of those in it."""
    gram = min(GRAM, length)
    mixed, size = data.astype(np.uint64) + np.uint64(1), 1
    while size < gram:
        step = min(size, gram - size)
        mixed = mixed[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * size) + mixed[step:]
        mixed ^= mixed >> np.uint64(29)
        size += step
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    least, width, size = mixed, length - gram + 1, 1
    while size < width:
        step = min(size, width - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    return mixed.view(np.int64), least.view(np.int64)


def segments_of(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """Anchor, text number, start and number of windows of each segment, whether its anchor occurs twice in it, and a hash of all of it."""
    found: list[tuple[np.ndarray, ...]] = []
    group: list[int] = []
    held = 0

    def settle() -> None:
        nonlocal group, held
        if group:
            data = np.frombuffer(b"".join(texts[i] for i in group), np.uint8)
            sizes = np.array([len(texts[i]) for i in group])
            begins = np.cumsum(sizes) - sizes
            mixed, least = anchors(data, length)
            inside = np.zeros(len(least) + 1, bool)
            owner = np.repeat(np.arange(len(group)), sizes)[: len(least)]
            place = np.arange(len(least)) - begins[owner]
            inside[:-1] = place + length <= sizes[owner]
            new = inside[:-1].copy()
            new[1:] &= (least[1:] != least[:-1]) | ~inside[:-2] | (place[1:] % LONGEST_RUN == 0)
            starts = np.flatnonzero(new)
            stops = np.flatnonzero(new | ~inside[:-1])
            ends = np.append(stops, len(least))[np.searchsorted(stops, starts, side="right")]
            grams = ends - starts + length - min(GRAM, length)
            first = np.cumsum(grams) - grams
            each = np.arange(grams.sum()) + np.repeat(starts - first, grams)
            times = np.add.reduceat(mixed[each] == np.repeat(least[starts], grams), first, dtype=np.int64) if len(first) else first
            whole = np.add.reduceat(mixed[each], first, dtype=np.int64) if len(first) else first
            found.append((least[starts], np.array(group)[owner[starts]], place[starts], ends - starts, times > 1, whole))
        group, held = [], 0

    for number, text in enumerate(texts):
        if len(text) >= length:
            group.append(number)
            held += len(text)
            if held >= CHUNK:
                settle()
    settle()
    if not found:
        return tuple(np.zeros(0, np.int64) for _ in range(6))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in portions of about ``PORTION`` bytes of text."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        number = (np.cumsum(sizes) - sizes) // PORTION
        edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a)


def _mark(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _portions(batches):
            texts = [t.as_py() or b"" for t in batch.column("text").cast(pa.binary())]
            anchor, owner, start, count, twice, whole = segments_of(texts, length)
            _, first, back, times = np.unique(anchor, return_index=True, return_inverse=True, return_counts=True)
            lead = np.zeros(len(anchor), bool)
            lead[first] = True
            salt = np.where(lead, 0, 1 + np.arange(len(anchor)) % 1000)
            # how many different segments the anchor has in the batch, at its first one; and whether it repeats
            kinds = np.bincount(back[np.unique(whole, return_index=True)[1]], minlength=len(first))
            weight = np.where(lead, kinds[back], 0) << 1 | (times[back] > 1) | (twice > 0)
            ids, hashes = (batch.column(c).to_numpy()[owner] for c in ("id", "text_hash"))
            yield _batch(MARKS, [anchor, salt, weight, ids, hashes, start << COUNT_BITS | count])

    return run


def _flagged(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    held = pa.Table.from_batches(batches)
    column = {c: held[c].to_numpy() for c in held.column_names}
    repeated = column["weight"] & 1 > 0
    lead = column["salt"] == 0
    _, back, times = np.unique(column["anchor"][lead], return_inverse=True, return_counts=True)
    repeated[lead] |= times[back] > 1
    column["kinds"] = np.zeros(held.num_rows, np.int64)  # segments of the anchor, equal ones of a batch counted once
    column["kinds"][lead] = np.bincount(back, column["weight"][lead] >> 1)[back]
    return _batch(FLAGGED, [column[c.split()[0]][repeated] for c in FLAGGED.split(", ")])


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of anchor; those of the last one are held until it ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows:
            anchor = batch.column("anchor").to_numpy()
            if not held or held[-1].column("anchor")[0].as_py() != anchor[-1]:
                last = int(np.searchsorted(anchor, anchor[-1]))
                yield _flagged([*held, batch.slice(0, last)])
                held, batch = [], batch.slice(last)
            held.append(batch)
    if held:
        yield _flagged(held)


class _Distinct:
    """Segments met so far with their earliest place; whatever comes second is a run to remove."""

    def __init__(self):
        self.first: dict[bytes, tuple] = {}
        self.runs: list[tuple] = []

    def add(self, segment: bytes, place: tuple) -> int:
        """place: (id, text_hash, start, count, anchor).  The bytes that are held more."""
        known = self.first.get(segment)
        if known is None or place < known:
            self.first[segment] = place
        if known is None:
            return len(segment)
        if known[:3] == place[:3]:
            return 0
        self.runs.append(max(known, place))
        return RUN_BYTES


def _joined(runs: list[tuple]) -> list[tuple]:
    """Runs (id, text_hash, start, count) with those that touch joined."""
    out: list[tuple] = []
    for doc, text_hash, start, count in sorted(runs):
        if out and out[-1][:2] == (doc, text_hash) and start <= out[-1][2] + out[-1][3]:
            known = out[-1]
            out[-1] = (doc, text_hash, known[2], max(known[3], start + count - known[2]))
        else:
            out.append((doc, text_hash, start, count))
    return out


def _rows_of(runs: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Runs as rows without a segment: what needs no comparison any more is spread by its place."""
    if runs:
        yield _batch(SEGMENTS, list(zip(*((hash(r[:3]), *r, None) for r in _joined(runs)), strict=True)))


def _windows(hot: list[tuple], length: int) -> Iterator[pa.RecordBatch]:
    """The windows of (anchor, id, text_hash, start, count, segment) one by one, in order of anchor, which equal windows share."""
    windows = _Distinct()

    def rows() -> Iterator[pa.RecordBatch]:
        # a count of 0 tells a window of a hot anchor
        lead = [(np.uint64(xxhash.xxh64_intdigest(w)).view(np.int64), *p[:3], 0, w) for w, p in windows.first.items()]
        if lead:
            yield _batch(SEGMENTS, list(zip(*lead, strict=True)))
        yield from _rows_of(windows.runs)
        windows.__init__()

    for _, doc, text_hash, start, count, segment in sorted(hot, key=lambda row: row[0]):
        for i in range(count):
            windows.add(segment[i : i + length], (doc, text_hash, start + i, 1))
        if len(windows.first) + len(windows.runs) >= ROWS:
            yield from rows()
    yield from rows()


def _cut(length: int):
    def given(distinct: _Distinct, hot: set[int]) -> Iterator[pa.RecordBatch]:
        lead, spread = [], []
        for segment, place in distinct.first.items():
            if place[4] in hot:
                spread.append((place[4], *place[:4], segment))
                continue
            lead.append((place[4], *place[:4], segment))
            if len(lead) >= ROWS:
                yield _batch(SEGMENTS, list(zip(*lead, strict=True)))
                lead = []
        if lead:
            yield _batch(SEGMENTS, list(zip(*lead, strict=True)))
        yield from _rows_of([p[:4] for p in distinct.runs])
        yield from _windows(spread, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distinct, held, hot = _Distinct(), 0, set()
            rows = (batch.column("text").cast(pa.binary()), batch.column("found"), batch.column("id").to_pylist(), batch.column("text_hash").to_pylist())
            for text, places, doc, text_hash in zip(*rows, strict=True):
                data = text.as_py()
                anchor, place, spread = (places.values.field(c).to_numpy(zero_copy_only=False) for c in ("anchor", "place", "hot"))
                starts, counts = place >> COUNT_BITS, place & (1 << COUNT_BITS) - 1
                hot.update(anchor[spread].tolist())
                for start, count, key in zip(starts.tolist(), counts.tolist(), anchor.tolist(), strict=True):
                    held += distinct.add(data[start : start + count + length - 1], (doc, text_hash, start, count, key))
                    if held >= HELD:
                        yield from given(distinct, hot)
                        distinct, held = _Distinct(), 0
            yield from given(distinct, hot)

    return run


def suffix_order(symbols: np.ndarray, length: int, width: int = 9) -> tuple[np.ndarray, int, np.ndarray]:
    """Starts of all suffixes, sorted by at least ``length`` symbols of ``width`` bits each.

    Each round sorts only the suffixes that are not alone yet.  Also a number of symbols below ``length`` that the
    rounds came by, and whether each place differs from the one before it within so many.
    """
    n = len(symbols)
    size = 63 // width
    padded = np.concatenate([symbols, np.zeros(size, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(size):
        key = key << width | padded[i : i + n]
    order = np.argsort(key)
    key = key[order]
    heads = np.concatenate([[True], key[1:] != key[:-1]])
    ranked, before = 0, np.arange(n) == 0
    bits = (n + 1).bit_length()
    times = 63 // bits  # as many ranks as fit, of the suffixes size, 2 * size ... further on
    while size < length:
        ranked, before = size, heads
        place = np.maximum.accumulate(np.where(heads, np.arange(1, n + 1), 0))
        rank = np.zeros(n + times * size, np.int64)
        rank[order] = place
        todo = np.flatnonzero(~(heads & np.append(heads[1:], True)))
        start, key = order[todo], place[todo]
        for part in range(1, times):
            key = key << bits | rank[start + part * size]
        sorting = np.argsort(key)
        key = key[sorting]
        order[todo] = start[sorting]
        heads = heads.copy()
        heads[todo[1:]] = key[1:] != key[:-1]
        size *= times
    return order, ranked, before


def shared_prefixes(symbols: np.ndarray, order: np.ndarray, length: int, ranked: int, heads: np.ndarray) -> np.ndarray:
    """For each place of the order whether its suffix shares ``length`` symbols, none of them 0, with the one before it.

    ``heads`` tells the places that differ from the one before within ``ranked`` symbols: the extension begins with the
    intervals of all strings of as many.  Places whose suffix meets a 0 within ``length`` symbols have no meaning.
    """
    n = len(symbols)
    transform = symbols[order - 1].astype(np.uint16)
    back = np.zeros(n, np.int64)  # place of the suffix that is one symbol longer
    back[np.argsort(transform, kind="stable")] = np.arange(n)

    known = np.append(heads, True)
    low = np.flatnonzero(heads)
    high = np.append(low[1:], n)
    for _ in range(ranked, length):  # all intervals hold strings of as many symbols
        alone = high - low == 1
        one = low[alone]
        lows = back[one[transform[one] > 0]]
        highs = lows + 1
        low, size = low[~alone], (high - low)[~alone]
        if len(low):
            # the places of each larger interval, by symbol; of one symbol they stay together and in order
            which = np.repeat(np.arange(len(low)), size)
            place = np.arange(len(which)) + np.repeat(low - (np.cumsum(size) - size), size)
            key = which << 9 | transform[place]
            sorting = np.argsort(key, kind="stable")
            key, to = key[sorting], back[place[sorting]]
            heads = np.flatnonzero(np.diff(key, prepend=-1))
            tails = np.append(heads[1:], len(key)) - 1
            real = key[heads] & 511 > 0
            lows = np.concatenate([lows, to[heads[real]]])
            highs = np.concatenate([highs, to[tails[real]] + 1])
        new = ~known[highs]
        low, high = lows[new], highs[new]
        if not len(low):
            break
        known[high] = True
    return ~known[:n]


def _late_in_block(segments: list[bytes], ranks: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which places of the joined segments begin a window that also starts earlier, by (rank of the document, start);
    the segments' begins and sizes."""
    sizes = np.array([len(s) for s in segments])
    symbols = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int64) + 1
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    symbols[begins + sizes] = 0
    order, ranked, heads = suffix_order(symbols, length)
    same = shared_prefixes(symbols, order, length, ranked, heads)
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    place = np.arange(len(symbols)) - begins[owner]
    whole = place + length <= sizes[owner]
    ordered_whole = whole[order]
    same[1:] &= ordered_whole[1:] & ordered_whole[:-1]
    same[0] = False
    classes = np.cumsum(~same) - 1
    when = (ranks[owner] << 32) + starts[owner] + place
    earliest = np.minimum.reduceat(when[order], np.flatnonzero(~same))
    late = np.zeros(len(symbols), bool)
    late[order] = when[order] > earliest[classes]
    late &= whole
    return late, begins, sizes


def repeats_in_block(segments: list[bytes], ranks: np.ndarray, starts: np.ndarray, length: int) -> list[np.ndarray]:
    """Per segment, which of its windows also start earlier, by (rank of the document, start)."""
    late, begins, sizes = _late_in_block(segments, ranks, starts, length)
    return [late[b : b + size] for b, size in zip(begins, sizes, strict=True)]


def _late_runs(first: dict[bytes, tuple], length: int) -> list[tuple]:
    """Runs (id, text_hash, start, count) of the windows of a block's segments that also start earlier."""
    documents = {d: i for i, d in enumerate(sorted({p[:2] for p in first.values()}))}
    places = list(first.values())
    ranks = np.array([documents[p[:2]] for p in places])
    starts = np.array([p[2] for p in places])
    late, begins, _ = _late_in_block(list(first), ranks, starts, length)
    # a segment ends with a place that is not late, so no run goes across
    edges = np.flatnonzero(np.diff(late, prepend=False, append=False)).reshape(-1, 2)
    owner = np.searchsorted(begins, edges[:, 0], side="right") - 1
    start = starts[owner] + edges[:, 0] - begins[owner]
    return [(*places[i][:2], a, n) for i, a, n in zip(owner.tolist(), start.tolist(), (edges[:, 1] - edges[:, 0]).tolist(), strict=True)]


def _compare(length: int):
    """Rows come in order of anchor, so that a block can end where an anchor ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distinct, windows, held, last = _Distinct(), _Distinct(), 0, None
        found: list[tuple] = []

        def settle() -> None:
            nonlocal distinct, windows, held
            found.extend(p[:4] for d in (distinct, windows) for p in d.runs)
            if distinct.first:
                found.extend(_late_runs(distinct.first, length))
            distinct, windows, held = _Distinct(), _Distinct(), 0

        for batch in batches:
            direct = batch.column("segment").is_null()
            yield batch.filter(direct).select([c.split()[0] for c in RUNS.split(", ")])
            rest = batch.filter(pc.invert(direct)).to_pydict()
            for anchor, doc, text_hash, start, count, segment in zip(*(rest[c.split()[0]] for c in SEGMENTS.split(", ")), strict=True):
                if held >= BLOCK and anchor != last:
                    settle()
                    if len(found) >= ROWS:
                        yield _batch(RUNS, list(zip(*_joined(found), strict=True)))
                        found.clear()
                last = anchor
                if count:
                    held += distinct.add(segment, (doc, text_hash, start, count, anchor))
                else:
                    held += windows.add(segment, (doc, text_hash, start, 1))
        settle()
        if found:
            yield _batch(RUNS, list(zip(*_joined(found), strict=True)))

    return run


def _finish(length: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, runs in zip(batch.column("doc_id"), batch.column("text").cast(pa.binary()), batch.column("runs"), strict=True):
                data = text.as_py() or b""
                kept, removed, spans, reach = [], 0, 0, 0
                if runs.is_valid:
                    start, count = (runs.values.field(c).to_numpy(zero_copy_only=False) for c in ("start", "count"))
                    for i in np.argsort(start, kind="stable"):
                        a, b = int(start[i]), int(start[i]) + int(count[i]) + length - 1
                        if a > reach or not spans:
                            kept.append(data[reach:a])
                            spans += 1
                            removed += b - a
                        else:
                            removed += max(0, b - reach)
                        reach = max(reach, b)
                kept = b"".join([*kept, data[reach:]])
                rows.append((doc.as_py(), len(data), removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
            if rows:
                yield _batch(RESULT, list(zip(*rows, strict=True)))

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("id"),
        F.hash("text").alias("text_hash"),
        F.col("text").alias("text"),
    )


def _repeated(rows: DataFrame, length: int) -> DataFrame:
    """The marks of all segments whose anchor occurs more than once."""
    marks = rows.drop("doc_id").mapInArrow(_mark(length), MARKS).repartition("anchor", "salt").sortWithinPartitions("anchor")
    return stored(marks.mapInArrow(_flag, FLAGGED), "suffix-flagged")


def _tasks(flagged: DataFrame) -> tuple[int, int]:
    """How many tasks share the segments, so that each gets about ``TASK`` at most; how many segments each gets."""
    count = flagged.count()
    tasks = max(int(flagged.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-count // TASK))
    return tasks, count // tasks


def _by_text(rows: DataFrame, tasks: int) -> DataFrame:
    return rows.repartition(tasks, "id", "text_hash")


def _pieces(texts: DataFrame, flagged: DataFrame, length: int, hot: int) -> DataFrame:
    """``texts``: dealt by ``_by_text``."""
    tasks, each = _tasks(flagged)
    hot = max(hot, min(4 * hot, each // 32))
    bucket = F.col("anchor").bitwiseAND((1 << HOT_BITS) - 1).cast("int")
    buckets = flagged.where(F.col("kinds") > hot).select(bucket.alias("bucket")).distinct()  # at most 2 ** HOT_BITS rows
    flagged = flagged.join(F.broadcast(buckets), bucket == F.col("bucket"), "left")
    place = F.struct("anchor", "place", F.col("bucket").isNotNull().alias("hot"))
    per_text = _by_text(flagged.select("id", "text_hash", place.alias("place")), tasks)
    per_text = per_text.groupBy("id", "text_hash").agg(F.collect_set("place").alias("found"))
    return texts.join(per_text, ["id", "text_hash"]).mapInArrow(_cut(length), SEGMENTS)


def pieces(rows: DataFrame, length: int, hot: int) -> DataFrame:
    """What has to be compared, by ``anchor``: segments, windows of anchors with more than ``hot`` segments, known runs."""
    flagged = _repeated(rows, length)
    return _pieces(_by_text(rows, _tasks(flagged)[0]), flagged, length, hot)


def remove_repeats(docs: DataFrame, length: int = 100, with_text: bool = True, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the bytes kept of every row."""
    # one shuffle of the texts serves both joins, so both take all of its columns
    rows = _rows(docs)
    flagged = _repeated(rows, length)
    tasks, _ = _tasks(flagged)
    texts = _by_text(rows, tasks)
    runs = _pieces(texts, flagged, length, hot).repartition(tasks, "anchor").sortWithinPartitions("anchor").mapInArrow(_compare(length), RUNS)
    runs = _by_text(runs, tasks).groupBy("id", "text_hash").agg(F.collect_set(F.struct("start", "count")).alias("runs"))
    return texts.join(runs, ["id", "text_hash"], "left").mapInArrow(_finish(length, with_text), RESULT)
