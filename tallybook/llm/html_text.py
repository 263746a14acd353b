"""Main text of web pages: structure where the markup tells, host suffix arrays where it doesn't.

A page is parsed into blocks.  Markup decides most of them: blocks inside ``article`` or
``main`` are the text; menus, headers, footers, sidebars, notices, adverts, forms and
reader comments are known by their elements, roles and class names.  Blocks of pages
without ``article`` and ``main`` that no name gives away are open.

The token streams of whole pages are compared per host: runs of ``window`` tokens or more
that occur on distinct pages of one host may be boilerplate.  Covered tokens are taken out
of open blocks, and their unique runs stay.  Then the markup is checked: what it places
inside ``article`` or ``main`` stays, as articles that share passages must stay whole.

Pages travel in groups of about ``GROUP`` characters, compressed together.  A host may hold
any share of the pages: streams are cut into segments of windows with one anchor (the least
hash of ``GRAM`` tokens in a row), and equal windows meet by a key of (host, anchor):

1. A group sends its different keys, sorted, ``KEY_BITS`` bits each, in ranges (buckets), and
   gets back one bit per key: whether other pages have it too, and whether it is hot (more
   than ``hot`` different segments).  Keys that clash in these bits are only sent in vain.
2. Of the keys on several pages it sends each different segment once, as text behind its
   host, and gets back one bit per window.  A bucket's task sorts the suffixes of its
   distinct segments, in blocks of whole anchors, and finds the windows of distinct pages.
   The segments of a hot key go window by window, dealt by a hash of the whole window.
3. The group's answers mark the covered tokens of its pages.

Defined results: a null or empty html has an empty text.  Pages with a null url or
without a host form one host.  Rows that repeat a page in all of page_id, url and html
are one page.  Character references are decoded, incomplete ones as browsers do.
Other columns may have any name.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from html.parser import HTMLParser
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .suffix_dedup import suffix_order

# Elements and names of the markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_TEXT = frozenset("audio button canvas form head iframe math noscript object select script style svg template textarea title video".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html"}
SIDE = frozenset("aside dialog footer menu nav".split())
SIDE_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
SIDE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner menu nav navbar navigation breadcrumb breadcrumbs"
    " sidebar footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup share sharing social related"
    " recommended comment comments disqus reply replies respond widget pagination pager login search toolbar masthead topbar".split()
)
HEADER_NAMES = frozenset(["header", "masthead"])
#: These hold even around an ``article``.
OUTER_SIDE = frozenset("comment comments disqus reply replies respond related recommended".split())
NAME_PART = re.compile(r"[^0-9a-zA-Z]+|(?<=[a-z])(?=[A-Z])")

HOT = 1024
#: Tokens of a block.
BLOCK = 1 << 14
#: Tokens of an anchor: so many in a row are seldom alike by chance.
GRAM = 4
#: Characters of html in a group of pages.
GROUP = 1 << 22
KEY_BITS = 44
MIX = np.uint64(0x9E3779B97F4A7C15)

MAIN, OPEN, REJECTED = 0, 1, 2
PARSED = "batch long, pages binary"
KEYS = "batch long, bucket int, keys binary, weights binary"
FOUND = "batch long, bucket int, shared binary, hot binary"
PACKED = "batch long, bucket int, texts binary, on binary, several binary, singles int, shared binary, hot binary"
COVERED = "batch long, bucket int, repeated binary, shared binary, hot binary"
SEGMENTS = "host string, anchor long, tokens string"
RESULT = "page_id long, url string, text string, n_chars long, n_repeated long"


@lru_cache(4096)
def _names(*given: str) -> frozenset[str]:
    return frozenset(x.lower() for text in given for x in NAME_PART.split(text))


@lru_cache(4096)
def _kind(tag: str, given: str, ident: str, role: str, inside: bool) -> str:
    """What an element does, by its class, id and role, and whether it is inside ``article`` or ``main``."""
    names = _names(given, ident)
    if tag in NO_TEXT:
        return "none"
    if names & OUTER_SIDE and tag not in ("html", "body"):
        return "outer"
    if tag in ("article", "main"):
        return "main"
    if tag in ("html", "body"):
        return "text"
    if tag in SIDE or role.lower() in SIDE_ROLES:
        return "outer"
    if names & (SIDE_NAMES - HEADER_NAMES) or not inside and (tag == "header" or names & HEADER_NAMES):
        return "side"
    return "text"


class _Page(HTMLParser):
    """Blocks of a page with their zones."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[int, str]] = []
        self.open: list[tuple[str, str]] = []  # element and what it does: text, none, side, outer, main
        self.parts: list[str] = []
        self.hidden = 0  # open elements without text

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(self.parts).split())
            self.parts = []
            if text:
                self.blocks.append((self.zone(), text))

    def zone(self) -> int:
        kinds = [k for _, k in self.open]
        if "main" in kinds:
            last = len(kinds) - 1 - kinds[::-1].index("main")
            outside, inside = kinds[:last], kinds[last:]
            return REJECTED if "outer" in outside or {"side", "outer"} & set(inside) else MAIN
        return REJECTED if {"side", "outer"} & set(kinds) else OPEN

    def kind(self, tag: str, attrs: dict) -> str:
        inside = any(k == "main" for _, k in self.open)
        return _kind(tag, attrs.get("class") or "", attrs.get("id") or "", attrs.get("role") or "", inside)

    def updatepos(self, i, j):
        """Lines are not counted."""
        return j

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self.flush()
        if tag in CLOSES_P:
            self.close_to("p", until=("article", "div", "section", "td", "li", "blockquote", "main", "aside", "body"))
        if tag == "li":
            self.close_to("li", until=("ul", "ol", "menu"))
        if tag in ("br", "td", "th", "img", "hr"):
            self.parts.append(" ")
        if tag not in VOID:
            kind = self.kind(tag, dict(attrs))
            self.hidden += kind == "none"
            self.open.append((tag, kind))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.close_to(tag)

    def close_to(self, tag: str, until: tuple[str, ...] = ()) -> None:
        for place in range(len(self.open) - 1, -1, -1):
            name = self.open[place][0]
            if name == tag:
                self.flush_if_block(place)
                self.hidden -= sum(k == "none" for _, k in self.open[place:])
                del self.open[place:]
                return
            if name in until:
                return

    def flush_if_block(self, place: int) -> None:
        if any(t in BLOCKS for t, _ in self.open[place:]):
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def blocks_of(html: str) -> list[tuple[int, str]]:
    """(zone, text) of each block in page order."""
    page = _Page()
    page.feed(html)
    page.close()
    page.flush()
    return page.blocks


def host_of(url: str | None) -> str:
    try:
        return urlsplit(url or "").hostname or ""
    except ValueError:
        return ""


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=3)


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + _codec().compress(data, asbytes=True)


def _opened(data: bytes) -> bytes:
    return _codec().decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def _packed_numbers(numbers: np.ndarray) -> bytes:
    """64-bit numbers by byte planes: those of small numbers' high bytes take no space."""
    return _packed(numbers.astype("<i8", copy=False).view(np.uint8).reshape(-1, 8).T.tobytes())


def _opened_numbers(data: bytes) -> np.ndarray:
    return np.frombuffer(_opened(data), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel()


def _batch(names: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    fields = [c.split() for c in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups of parsed pages, numbered by task and place in it."""
    number = TaskContext.get().partitionId() << 32
    rows: list[tuple] = []
    held = 0

    def group() -> pa.RecordBatch:
        kinds = {"page_id": pa.int64(), "page_hash": pa.int64(), "url": pa.string(), "host": pa.string(), "zones": pa.list_(pa.int8()), "blocks": pa.string()}
        pages = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.values(), strict=True)], list(kinds))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pages.schema, options=pa.ipc.IpcWriteOptions(compression=_codec())) as out:
            out.write_batch(pages)
        return _batch(PARSED, [[number], [sink.getvalue().to_pybytes()]])

    for batch in batches:
        for page_id, page_hash, url, html in zip(*(batch.column(c) for c in ("page_id", "page_hash", "url", "html")), strict=True):
            html, url = html.as_py() or "", url.as_py()
            found = blocks_of(html)
            # white space in blocks is single spaces
            rows.append((page_id.as_py(), page_hash.as_py(), url, host_of(url), [z for z, _ in found], "\n".join(b for _, b in found)))
            held += len(html)
            if held >= GROUP:
                yield group()
                number, rows, held = number + 1, [], 0
    if rows:
        yield group()


def _mixed(numbers: np.ndarray) -> np.ndarray:
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        numbers = (numbers ^ numbers >> np.uint64(shift)) * np.uint64(factor)
    return numbers ^ numbers >> np.uint64(31)


OF_BYTE, OF_PLACE = _mixed(np.arange(1, 513, dtype=np.uint64) * MIX).reshape(2, 256)
#: Tokens hashed at once.
CHUNK = 1 << 14


def _begins(text: bytes) -> np.ndarray:
    """Where each token begins in a text with one space behind each, and where the text ends."""
    return np.concatenate([[0], np.flatnonzero(np.frombuffer(text, np.uint8) == 32) + 1])


def _hashed(text: bytes, begins: np.ndarray) -> np.ndarray:
    """Hashes of the tokens.  They choose anchors and keys; what is repeated is judged by the tokens themselves."""
    data, out = np.frombuffer(text, np.uint8), np.zeros(len(begins) - 1, np.uint64)
    for at in range(0, len(out), CHUNK):
        of = begins[at : at + CHUNK + 1]
        first = of[:-1] - of[0]
        place = np.minimum(np.arange(of[-1] - of[0]) - np.repeat(first, np.diff(of)), 255)
        out[at : at + CHUNK] = np.add.reduceat(OF_BYTE[data[of[0] : of[-1]]] * OF_PLACE[place], first)
    return _mixed(out)


def _host_hash(host: str) -> int:
    return xxhash.xxh64_intdigest(host.encode("utf-8", "replace"))


def _least_grams(values: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``GRAM`` tokens from each place on; of each window the least of them."""
    size = min(GRAM, window)
    grams = np.zeros(max(0, len(values) - size + 1), np.uint64)
    for step in range(size):
        grams = (grams + values[step : step + len(grams)]) * MIX
    grams ^= grams >> np.uint64(29)
    whole = max(0, len(values) - window + 1)
    return grams, np.min([grams[step : step + whole] for step in range(window - size + 1)], axis=0)


class _Group:
    """A group of pages with the segments of its tokens: ``page``, ``start`` (over all tokens of the group), ``count`` of
    windows and ``back``, the place of its key among the ``keys``, which lie in buckets from ``bounds`` on."""

    def __init__(self, packed: bytes, window: int, buckets: int):
        self.pages = pa.ipc.open_stream(packed).read_next_batch()
        self.hosts = self.pages.column("host").to_pylist()
        self.texts = self.pages.column("blocks").to_pylist()
        self.hashes = self.pages.column("page_hash").to_numpy()
        # the tokens that are compared within a host: those of all blocks
        self.sizes = np.array([t.count(" ") + t.count("\n") + 1 if t else 0 for t in self.texts])
        self.text = "".join([f"{t} " for t in self.texts if t]).replace("\n", " ").encode()
        self.begins = _begins(self.text)
        values = _hashed(self.text, self.begins)
        n = len(values)
        owner = np.repeat(np.arange(len(self.texts)), self.sizes)
        place = np.arange(n) - (np.cumsum(self.sizes) - self.sizes)[owner]
        grams, least = _least_grams(values, window)
        inside = (place + window <= self.sizes[owner])[: len(least)]
        new = inside.copy()
        new[1:] &= (least[1:] != least[:-1]) | ~inside[:-1] | (place[1 : len(least)] == 0)
        self.start = np.flatnonzero(new)
        stops = np.flatnonzero(new | ~inside)
        ends = np.append(stops, len(least))[np.searchsorted(stops, self.start, side="right")]
        self.count = ends - self.start
        self.page = owner[self.start]
        salts = np.array([_host_hash(h) for h in self.hosts], np.uint64)
        keys = (least[self.start] * MIX + salts[self.page]) >> np.uint64(64 - KEY_BITS)
        self.keys, self.back = np.unique(keys.astype(np.int64), return_inverse=True)
        self.bounds = np.searchsorted(self.keys * buckets >> KEY_BITS, np.arange(buckets + 1))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(grams, dtype=np.uint64)])
        #: alike for equal segments
        self.whole = sums[ends + window - min(GRAM, window)] - sums[self.start]

    def between(self, first: int, last: int) -> str:
        """The tokens from the first on, before the last."""
        return self.text[self.begins[first] : self.begins[last] - 1].decode()

    def weights(self) -> np.ndarray:
        """Of each key twice the number of its different segments, and 1 more if it is on distinct pages."""
        order = np.lexsort((self.whole, self.back))
        back, whole, page = self.back[order], self.whole[order], np.unique(self.hashes, return_inverse=True)[1][self.page[order]]
        heads = np.flatnonzero(np.diff(back, prepend=-1))
        different = np.diff(back, prepend=-1) > 0
        different[1:] |= whole[1:] != whole[:-1]
        kinds = np.add.reduceat(different.astype(np.int64), heads)
        return kinds << 1 | (np.minimum.reduceat(page, heads) != np.maximum.reduceat(page, heads))

    def bits(self, found: list[dict], name: str) -> np.ndarray:
        """One boolean per segment, from the bits of the keys in each bucket."""
        of_key = np.zeros(len(self.keys), bool)
        for f in found:
            a, b = self.bounds[f["bucket"] : f["bucket"] + 2]
            if f[name]:
                of_key[a:b] = _opened_bits(f[name], b - a)
        return of_key[self.back]


def _packed_bits(bits: np.ndarray) -> bytes:
    return np.packbits(bits).tobytes() if bits.any() else b""


def _opened_bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool) if data else np.zeros(n, bool)


def _keys(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, pages in zip(batch.column("batch").to_pylist(), batch.column("pages"), strict=True):
                group = _Group(pages.as_py(), window, buckets)
                if len(group.keys):
                    weights, rows = group.weights(), []
                    for bucket in np.flatnonzero(np.diff(group.bounds)).tolist():
                        a, b = group.bounds[bucket : bucket + 2]
                        rows.append((number, bucket, _packed_numbers(np.diff(group.keys[a:b], prepend=0)), _packed_numbers(weights[a:b])))
                    yield _batch(KEYS, list(zip(*rows, strict=True)))

    return run


def _count(hot: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = defaultdict(list)
        for batch in batches:
            for number, bucket, keys, weights in zip(*(batch.column(c).to_pylist() for c in ("batch", "bucket", "keys", "weights")), strict=True):
                met[bucket].append((number, keys, weights))
        for bucket, rows in met.items():
            keys = [np.cumsum(_opened_numbers(k)) for _, k, _ in rows]
            weights = np.concatenate([_opened_numbers(w) for _, _, w in rows])
            _, back = np.unique(np.concatenate(keys), return_inverse=True)
            # a group has each key once
            shared = (np.bincount(back) > 1) | (np.bincount(back, weights & 1) > 0)
            often = shared & (np.bincount(back, weights >> 1) > hot)
            ends = np.cumsum([len(k) for k in keys])
            answers = [(number, back[end - len(k) : end]) for (number, _, _), k, end in zip(rows, keys, ends.tolist(), strict=True)]
            yield _batch(FOUND, list(zip(*((number, bucket, _packed_bits(shared[b]), _packed_bits(often[b])) for number, b in answers), strict=True)))

    return run


@dataclass
class _Contents:
    """Different texts of a bucket, their numbers of windows, a page of each, and which are on several pages."""

    place: dict[str, int] = field(default_factory=dict)
    counts: list[int] = field(default_factory=list)
    on: list[int] = field(default_factory=list)
    several: set[int] = field(default_factory=set)

    def add(self, text: str, count: int, page: int) -> int:
        i = self.place.setdefault(text, len(self.on))
        if i == len(self.on):
            self.on.append(page)
            self.counts.append(count)
        elif self.on[i] != page:
            self.several.add(i)
        return i


def _sent(group: _Group, found: list[dict], window: int, buckets: int) -> tuple[dict[int, tuple[_Contents, _Contents]], list[tuple]]:
    """What a group sends by bucket, segments and single windows of hot keys, and the places of these:
    (start, count, bucket, whether single, number among its kind)."""
    out: dict[int, tuple[_Contents, _Contents]] = defaultdict(lambda: (_Contents(), _Contents()))
    places = []
    shared, hot = group.bits(found, "shared"), group.bits(found, "hot")
    bucket_of = np.searchsorted(group.bounds, group.back, side="right") - 1
    columns = (group.start, group.count, group.page, bucket_of, hot)
    hosts, hashes = group.hosts, group.hashes.tolist()
    for start, count, page, bucket, single in zip(*(c[shared].tolist() for c in columns), strict=True):
        # neither a host nor a token holds a tab or a new line
        if single:
            for at in range(start, start + count):
                text = f"{hosts[page]}\t{group.between(at, at + window)}"
                bucket = xxhash.xxh64_intdigest(text) % buckets
                places.append((at, 1, bucket, True, out[bucket][1].add(text, 1, hashes[page])))
        else:
            text = f"{hosts[page]}\t{group.between(start, start + count + window - 1)}"
            places.append((start, count, bucket, False, out[bucket][0].add(text, count, hashes[page])))
    return out, places


def _send(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, pages, found in zip(batch.column("batch").to_pylist(), batch.column("pages"), batch.column("found"), strict=True):
                found = found.as_py()
                out, _ = _sent(_Group(pages.as_py(), window, buckets), found, window, buckets)
                bits = {f["bucket"]: (f["shared"], f["hot"]) for f in found}
                rows = []
                # the answers to the keys go along, so that the last step gets all answers at once
                for bucket in sorted(out.keys() | {b for b, (shared, _) in bits.items() if shared}):
                    segments, singles = out[bucket]
                    several = np.zeros(len(segments.on) + len(singles.on), bool)
                    several[[*segments.several, *(len(segments.on) + i for i in singles.several)]] = True
                    texts = _packed("\n".join([*segments.place, *singles.place]).encode())
                    on = _packed_numbers(np.array([*segments.on, *singles.on], np.int64))
                    rows.append((number, bucket, texts, on, _packed_bits(several), len(singles.on), *bits.get(bucket, (b"", b""))))
                if rows:
                    yield _batch(PACKED, list(zip(*rows, strict=True)))

    return run


def _texts(packed: bytes) -> list[str]:
    text = _opened(packed).decode()
    return text.split("\n") if text else []


def _unpacked(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, singles in zip(batch.column("texts").to_pylist(), batch.column("singles").to_pylist(), strict=True):
                rows = []
                for i, text in enumerate(texts := _texts(texts)):
                    host, tokens = text.split("\t")
                    single = i >= len(texts) - singles
                    anchor = xxhash.xxh64_intdigest(text) if single else int(_least_grams(_hashed(data := f"{tokens} ".encode(), _begins(data)), window)[1][0])
                    rows.append((host, anchor - (1 << 63), tokens))
                if rows:
                    yield _batch(SEGMENTS, list(zip(*rows, strict=True)))

    return run


def repeated_windows(segments: list[np.ndarray], low: np.ndarray, high: np.ndarray, window: int) -> list[np.ndarray]:
    """Per segment, which of its windows occur on distinct pages; low and high are the least and greatest page of each segment."""
    sizes = np.array([len(s) for s in segments])
    used, codes = np.unique(np.concatenate(segments), return_inverse=True)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    symbols = np.zeros(int((sizes + 1).sum()), np.int64)
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    place = np.arange(len(symbols)) - begins[owner]
    symbols[place < sizes[owner]] = codes + 1
    order, _, _ = suffix_order(symbols, window, max(1, int(len(used)).bit_length()))
    whole = place + window <= sizes[owner]
    padded = np.concatenate([symbols, np.zeros(window, np.int64)])
    same = whole[order].copy()
    same[1:] &= whole[order[:-1]]
    same[0] = False
    for step in range(window):
        same[1:] &= padded[order[1:] + step] == padded[order[:-1] + step]
    heads = np.flatnonzero(~same)
    least = np.minimum.reduceat(low[owner][order], heads)
    most = np.maximum.reduceat(high[owner][order], heads)
    repeated = np.zeros(len(symbols), bool)
    repeated[order] = (least != most)[np.cumsum(~same) - 1]
    repeated &= whole
    return [repeated[b : b + size] for b, size in zip(begins, sizes, strict=True)]


class _Met:
    """Different texts of a task with the least and greatest page of each."""

    def __init__(self):
        self.place: dict[str, int] = {}
        self.low: list[int] = []
        self.high: list[int] = []

    def add(self, texts: list[str], on: list[int], several: list[bool]) -> np.ndarray:
        """The numbers of the texts."""
        low, high, numbers = self.low, self.high, []
        for text, page, many in zip(texts, on, several, strict=True):
            i = self.place.setdefault(text, len(low))
            numbers.append(i)
            if i == len(low):
                low.append(page)
                high.append(page)
            elif page < low[i]:
                low[i] = page
            elif page > high[i]:
                high[i] = page
            if many:  # on more pages than the one that is named
                low[i], high[i] = -(1 << 63), (1 << 63) - 1
        return np.array(numbers, np.int64)

    def pages(self) -> tuple[np.ndarray, np.ndarray]:
        return np.array(self.low, np.int64), np.array(self.high, np.int64)


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each ``first`` on, ``count`` of them, one run behind the other."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _marks(met: _Met, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each window of the segments, one behind the other, is on distinct pages; the segments' first ones and numbers of windows."""
    hosts, texts = zip(*(text.split("\t") for text in met.place), strict=True) if met.place else ((), ())
    sizes = np.array([t.count(" ") + 1 for t in texts], np.int64)
    salts, host = np.unique(np.array([_host_hash(h) for h in hosts], np.uint64), return_inverse=True)
    data = "".join([f"{t} " for t in texts]).encode()
    token_begins = _begins(data)
    begins = np.cumsum(sizes) - sizes
    counts = sizes - window + 1
    first = np.cumsum(counts) - counts
    marks = np.zeros(int(counts.sum()), bool)
    if not len(sizes):
        return marks, first, counts
    # all windows of a segment have the anchor of its first one
    keys = _least_grams(_hashed(data, token_begins), window)[1][begins] * MIX + salts[host]
    tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(token_begins) - 1, [None, pa.py_buffer(token_begins), pa.py_buffer(data)])
    # equal for equal tokens of one host only
    values = tokens.dictionary_encode().indices.to_numpy().astype(np.int64) * len(salts) + np.repeat(host, sizes)
    low, high = met.pages()
    order = np.argsort(keys)
    held = np.cumsum(sizes[order]) // BLOCK
    parts = np.flatnonzero(keys[order[1:]] != keys[order[:-1]]) + 1  # a block ends where an anchor does
    parts = parts[np.diff(held[parts], prepend=0) > 0]
    for block in np.split(order, parts):
        segments = [values[b : b + n] for b, n in zip(begins[block].tolist(), sizes[block].tolist(), strict=True)]
        for i, mark in zip(block.tolist(), repeated_windows(segments, low[block], high[block], window), strict=True):
            marks[first[i] : first[i] + counts[i]] = mark[: counts[i]]
    return marks, first, counts


def _find_repeats(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, singles, rows = _Met(), _Met(), []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in batch.schema.names), strict=True):
                number, bucket, texts, on, several, n_single, shared, hot = row
                texts, on = _texts(texts), _opened_numbers(on).tolist()
                several = _opened_bits(several, len(on)).tolist()
                whole = len(texts) - n_single
                numbers = segments.add(texts[:whole], on[:whole], several[:whole])
                rows.append((number, bucket, numbers, singles.add(texts[whole:], on[whole:], several[whole:]), shared, hot))
        if rows:
            marks, first, counts = _marks(segments, window)
            low, high = singles.pages()
            out = []
            for number, bucket, numbers, of_singles, shared, hot in rows:
                repeated = np.concatenate([marks[_spread(first[numbers], counts[numbers])], (low != high)[of_singles]])
                out.append((number, bucket, _packed_bits(repeated), shared, hot))
            yield _batch(COVERED, list(zip(*out, strict=True)))

    return run


def covered_tokens(group: _Group, found: list[dict], window: int, buckets: int) -> np.ndarray:
    """Which tokens of a group the answers of all buckets cover."""
    out, places = _sent(group, found, window, buckets)
    begins = np.zeros(int(group.sizes.sum()) + window, bool)
    if places:
        repeated = {f["bucket"]: f["repeated"] for f in found}
        answers, first = [], {}
        at = 0
        for bucket, kinds in out.items():
            counts = np.array([n for kind in kinds for n in kind.counts], np.int64)
            first[bucket] = at + np.cumsum(counts) - counts
            answers.append(_opened_bits(repeated.get(bucket), int(counts.sum())))
            at += len(answers[-1])
        marks = np.concatenate(answers)
        start, count = (np.array(c, np.int64) for c in list(zip(*places, strict=True))[:2])
        of = np.array([first[b][i + (len(out[b][0].on) if single else 0)] for _, _, b, single, i in places], np.int64)
        begins[_spread(start, count)] = marks[_spread(of, count)]
    covered = np.zeros(len(begins), bool)
    for step in range(window):
        covered[step:] |= begins[: len(begins) - step]
    return covered[: int(group.sizes.sum())]


def assemble(zones: list[int], blocks: list[str], covered: np.ndarray) -> str:
    """The text of a page whose compared tokens are ``covered`` or not by repeated runs."""
    if MAIN in zones:
        return "\n\n".join(b for z, b in zip(zones, blocks, strict=True) if z == MAIN)
    out, at = [], 0
    for zone, block in zip(zones, blocks, strict=True):
        tokens = block.split()
        kept = [t for t, c in zip(tokens, covered[at : at + len(tokens)].tolist(), strict=True) if not c]
        at += len(tokens)
        if zone == OPEN and kept:
            out.append(" ".join(kept))
    return "\n\n".join(out)


def _assemble(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pages, answers in zip(batch.column("pages"), batch.column("answers"), strict=True):
                group = _Group(pages.as_py(), window, buckets)
                covered = covered_tokens(group, answers.as_py() or [], window, buckets)
                ends = np.cumsum(group.sizes)
                each = [covered[a:b] for a, b in zip((ends - group.sizes).tolist(), ends.tolist(), strict=True)]
                rows = zip(group.pages.column("zones").to_pylist(), group.texts, each, strict=True)
                texts = [assemble(zones, text.split("\n") if zones else [], c) for zones, text, c in rows]
                ids, urls = (group.pages.column(c) for c in ("page_id", "url"))
                yield _batch(RESULT, [ids, urls, texts, [len(t) for t in texts], [int(c.sum()) for c in each]])

    return run


def _buckets(df: DataFrame) -> int:
    """As many as the session has partitions in a shuffle."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _with_answers(parsed: DataFrame, answers: DataFrame, name: str, how: str) -> DataFrame:
    """The groups with all answers of the buckets; all columns, so that the groups are shuffled once for all joins."""
    per_group = answers.groupBy(F.col("batch").alias("_batch")).agg(F.collect_list(F.struct(*answers.columns[1:])).alias(name))
    return parsed.join(per_group, parsed["batch"] == F.col("_batch"), how).select(*parsed.columns, name)


def _packed_segments(parsed: DataFrame, window: int, hot: int) -> DataFrame:
    """What is compared, a row per group and bucket."""
    buckets = _buckets(parsed)
    keys = parsed.mapInArrow(_keys(window, buckets), KEYS).repartitionById(buckets, "bucket")
    return _with_answers(parsed, keys.mapInArrow(_count(hot), FOUND), "found", "inner").mapInArrow(_send(window, buckets), PACKED)


def segments_of(parsed: DataFrame, window: int, hot: int) -> DataFrame:
    """What is compared by (host, anchor): segments, and windows of hot keys with a hash in place of the anchor."""
    return _packed_segments(parsed, window, hot).mapInArrow(_unpacked(window), SEGMENTS)


def main_text(pages: DataFrame, window: int = 8, hot: int = HOT) -> DataFrame:
    """page_id, url, text, n_chars and n_repeated (compared tokens that other pages of the host share) of every row."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.xxhash64("page_id", "url", "html").alias("page_hash"), "url", "html"
    )
    # parsed and shuffled once for the keys, the segments and the texts; the inner join infers this filter,
    # and with it in all three the plans are the same
    parsed = rows.mapInArrow(_parse, PARSED).where("batch is not null").repartition("batch")
    buckets = _buckets(pages)
    covered = _packed_segments(parsed, window, hot).repartitionById(buckets, "bucket").mapInArrow(_find_repeats(window), COVERED)
    return _with_answers(parsed, covered, "answers", "left").mapInArrow(_assemble(window, buckets), RESULT)
