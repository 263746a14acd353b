"""Nulls, empty and long texts, ties, repeats, empty tables, clashing names, and the operators' own interfaces."""

import functools
import random
import re
import tracemalloc
from collections import Counter

import brute_text
import cases
import hypothesis.strategies as st
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from pyspark.sql import functions as F

import corpus_pipeline
from tallybook.llm import automaton, bpe, chat, decontaminate, exact_dedup, html_text, langid, pii, secret_scan, simhash, suffix_dedup

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.frame(spark)


@pytest.fixture(scope="module")
def nothing(spark):
    return cases.frame(spark, [])


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)


def of(df):
    return Counter(tuple(r) for r in df.collect())


@functools.cache
def library():
    return tiktoken.Encoding("known", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@functools.cache
def scanner():
    return secret_scan.scanner()


# exact dedup


def exact_by_hand(rows):
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault("".join(c for c in t or "" if c not in " \t\n\r\x0b\x0c"), []).append((-len(t or ""), d is None, d or 0, d))
    out = Counter()
    for d, t, *_ in rows:
        members = groups["".join(c for c in t or "" if c not in " \t\n\r\x0b\x0c")]
        best = min(members)
        out[(d, best[3], len(members), (d, -len(t or "")) == (best[3], best[0]))] += 1
    return out


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.pmod(F.xxhash64(c), F.lit(2)).cast("string")])
def test_exact_groups_compare_content(docs, digest):
    """With a digest of two values only the contents keep groups apart."""
    got = exact_dedup.exact_groups(docs, digest=digest, salts=3).drop("text_sha256")
    assert of(got) == exact_by_hand(cases.documents())


def test_exact_kept_keeps_columns(docs, nothing):
    kept = exact_dedup.exact_kept(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {3, None, 4, 5, 7, 9, 10, 11, 12, 13, 14}
    assert exact_dedup.exact_groups(nothing).count() == exact_dedup.exact_kept(nothing).count() == 0


# decontamination


def test_contamination_edges(spark, docs, nothing):
    benchmark = [(1, cases.PASSAGE), (2, "ab"), (3, None), (4, ""), (5, "été été naïve"), (None, "no id here"), (1, "la la la la la la"), (6, "la la la la la la")]
    items = spark.createDataFrame(benchmark, "item_id long, text string").withColumn("words", F.lit(1))
    for small in (1_000_000, 0):  # by broadcast and by shuffle
        got = decontaminate.report(decontaminate.contamination(docs, items, small=small))
        assert got.count() == len(cases.documents())
        windows = brute_text.windows([t for _, t in benchmark], 10)
        for r in got.collect():
            texts = [t for d, t, *_ in cases.documents() if d == r.doc_id]
            words, places = brute_text.hit_places(texts[0], windows)
            assert (r.n_words, r.n_hit, r.contaminated) == (len(words), len(places), bool(places)), r
        assert {r.doc_id: r.n_items for r in got.collect()}[14] == 2
    clean = {d for d, t, *_ in cases.documents() if not brute_text.holds(t, windows)}
    assert {r.doc_id for r in decontaminate.uncontaminated(docs, items).collect()} == clean
    assert {1, 2, 3, 6, 7, 8} <= clean and clean.isdisjoint({9, 10, 11, 14, None})
    assert decontaminate.uncontaminated(docs, items).columns == docs.columns
    assert decontaminate.contamination(nothing, items).count() == 0
    none = decontaminate.report(decontaminate.contamination(docs, items.limit(0))).agg(F.sum("n_hit"), F.count("n_items")).first()
    assert tuple(none) == (0, len(cases.documents()))


# SimHash


def test_near_groups_edges(docs, nothing):
    got = simhash.near_groups(docs, 3, 2).collect()
    assert len(got) == len(cases.documents())
    by_id = {r.doc_id: r for r in got}
    assert {by_id[d].fingerprint for d in (1, 2, 3)} == {"0" * 16}
    assert {by_id[d].component_id for d in (1, 2, 3)} == {1}
    assert by_id[None].component_id is None
    assert by_id[6].component_id == by_id[7].component_id == by_id[8].component_id == 6
    kept = simhash.near_kept(docs)
    assert kept.columns == docs.columns
    assert {None, 1, 4, 6, 9} <= {r.doc_id for r in kept.collect()}
    assert simhash.near_groups(nothing).count() == simhash.near_kept(nothing).count() == 0


@pytest.mark.parametrize("piece", [1, 7, 1 << 19])
def test_fingerprints_do_not_depend_on_pieces(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    for _, text, *_ in cases.documents():
        text = (text or "")[:3000]
        assert simhash.fingerprint(text.encode(), 3) == brute_text.print_of(text, 3)


@pytest.mark.parametrize("tile", [3, 50])
def test_links_and_components_are_exact(spark, tile):
    rng = random.Random(tile)
    prints = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(30):
            prints.add(at)
            at ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64) if rng.random() < 0.6 else 0)
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fingerprint long").repartition(4)
    roots = {r.node: r.root for r in simhash.components(simhash.links(frame, 2, tile)).collect()}
    parent = {p: p for p in signed}

    def top(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for i, a in enumerate(signed):
        for b in signed[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    assert {p: roots.get(p, p) for p in signed} == {p: top(p) for p in signed}


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 200)}


# suffix dedup


def test_repeats_of_edges(docs, nothing):
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    rows = sorted(((d, (t or "").encode()) for d, t, *_ in cases.documents() if d is not None and d != 11), key=lambda x: x[0])
    rows += [(11, b"ab"), (None, cases.documents()[3][1].encode())]
    for d, (size, removed, spans, kept) in brute_text.repeats(rows, 100).items():
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, bytes(got[d].kept)) == (size, removed, spans, kept), d
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_a_common_line_with_other_neighbours_is_spread(spark, docs):
    """No key takes a piece of every document, and removal does not depend on which anchors count as hot."""
    line = "a line of more than twenty-four and fewer than a hundred bytes"
    rows = [(i, f"{cases.words(2 * i, 20)} {line} {cases.words(2 * i + 1, 20)}") for i in range(200)]
    rows += [(i + 200, rows[i][1][60:]) for i in range(5)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    keys = suffix_dedup.pieces(suffix_dedup._rows(frame), 100, 20).where("segment is not null").groupBy("anchor").count()
    assert keys.agg(F.max("count")).first()[0] <= 20
    expected = brute_text.repeats([(d, t.encode()) for d, t in rows], 100)
    for r in suffix_dedup.remove_repeats(frame, hot=20).collect():
        assert (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) == expected[r.doc_id]
    assert of(suffix_dedup.remove_repeats(docs, hot=0)) == of(suffix_dedup.remove_repeats(docs))


def segment_rows(n, count):
    """Segments that differ, in order of anchor, in batches of 500; every fifth anchor has two, which share their first windows."""
    rng = np.random.default_rng(5)
    texts = rng.integers(97, 123, (n, 150), dtype=np.uint8)
    texts[5::5, :120] = texts[4:-1:5, :120]
    anchor = np.arange(n) - (np.arange(n) % 5 == 0) * (np.arange(n) > 0)
    for i in range(0, n, 500):
        part = range(i, i + 500)
        columns = [anchor[part], part, [7] * len(part), [0] * len(part), [count] * len(part), [texts[k].tobytes()[: count + 99 if count else 100] for k in part]]
        yield suffix_dedup._batch(suffix_dedup.SEGMENTS, columns)


def held_at_most(task, batches):
    """MB that a task holds at most beside Arrow's while its output is used up, and the rows of that."""
    batches = list(batches)
    tracemalloc.start()
    try:
        rows = sum(batch.num_rows for batch in task(iter(batches)))
        return tracemalloc.get_traced_memory()[1] / 1e6, rows
    finally:
        tracemalloc.stop()


def test_suffix_tasks_hold_a_portion_of_their_rows():
    """Many times the rows of a task don't take several times the memory."""
    compare = [held_at_most(suffix_dedup._compare(100), segment_rows(n, 51)) for n in (3000, 60_000)]
    assert [rows for _, rows in compare] == [599, 11_999]
    assert compare[1][0] < 2 * compare[0][0]

    names = [c.split()[0] for c in suffix_dedup.MARKS.split(", ")]

    def marks(n):
        for i in range(0, n, 2000):
            each = np.arange(i, i + 2000)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((each // 2, each * 0, each * 0 + 2, each, each * 0, each), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64()), strict=True)], names)

    flag = [held_at_most(suffix_dedup._flag, marks(n)) for n in (20_000, 200_000)]
    assert [rows for _, rows in flag] == [20_000, 200_000]
    assert flag[1][0] < 2 * flag[0][0]


@pytest.mark.parametrize("spread", [False, True])
def test_suffix_segments_are_cut_in_portions(spread, monkeypatch):
    """A batch of many segments is given back in portions; windows of hot anchors too."""
    monkeypatch.setattr(suffix_dedup, "HELD", 1 << 18, raising=False)
    monkeypatch.setattr(suffix_dedup, "ROWS", 1 << 11, raising=False)
    text = np.random.default_rng(1).integers(97, 123, 40 * 10_000, dtype=np.uint8).tobytes().decode()
    texts = [text[i : i + 40_000] for i in range(0, len(text), 40_000)]
    found = [[{"anchor": 1000 * d + s, "place": s << suffix_dedup.COUNT_BITS | 40, "hot": spread} for s in range(0, 39_000, 40)] for d in range(len(texts))]
    kind = pa.list_(pa.struct([("anchor", pa.int64()), ("place", pa.int64()), ("hot", pa.bool_())]))
    columns = [pa.array(texts), pa.array(found, kind), pa.array(range(len(texts)), pa.int64()), pa.array([0] * len(texts), pa.int32())]
    batch = pa.RecordBatch.from_arrays(columns, ["text", "found", "id", "text_hash"])
    given = list(suffix_dedup._cut(100)(iter([batch])))
    assert max(b.num_rows for b in given) <= (1 << 11) + 40
    assert sum(b.num_rows for b in given) == 975 * len(texts) * (40 if spread else 1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", min_size=3, max_size=40), min_size=1, max_size=8), st.integers(3, 9))
def test_intervals_find_all_late_windows(texts, length):
    segments = [t.encode() for t in texts if len(t) >= length]
    if not segments:
        return
    late = suffix_dedup.repeats_in_block(segments, np.arange(len(segments)), np.zeros(len(segments), int), length)
    seen = set()
    for segment, flags in zip(segments, late, strict=True):
        for i in range(len(segment)):
            part = segment[i : i + length]
            assert flags[i] == (len(part) == length and part in seen)
            seen.add(part)


# byte BPE


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab the\n\t é漢0123!?'sre="), max_size=80))
def test_encoding_is_that_of_the_library(encoder, text):
    ids = encoder.encode(text)
    assert ids == library().encode_ordinary(text)
    assert encoder.decode(ids) == text.encode()


def test_long_texts_are_split_one_match_at_a_time(encoder, monkeypatch):
    text = cases.words(3, 300) + "  \n 12 été"
    whole = encoder.encode(text)
    monkeypatch.setattr(bpe, "LONG_CHARS", 10)
    assert encoder.encode(text) == whole


def test_prefix_store_appends_and_edits(encoder):
    rng = random.Random(4)
    for _ in range(60):
        data = bytes(rng.choice(b"abcdeinorst") for _ in range(rng.randint(1, 400)))
        store = bpe.PrefixStore(encoder.vocabulary, data[:10])
        store.append(data[10:])
        assert store.ids() == bpe.PrefixStore(encoder.vocabulary, data).ids()
        a = rng.randint(0, len(data))
        b = rng.randint(a, min(len(data), a + 6))
        new = bytes(rng.choice(b"abcdeinorst") for _ in range(rng.randint(0, 5)))
        store.replace(a, b, new)
        whole = bpe.PrefixStore(encoder.vocabulary, data[:a] + new + data[b:])
        assert (store.data, store.last) == (whole.data, whole.last)


def test_edit_stops_where_the_store_agrees(encoder):
    vocabulary = bpe.Vocabulary({t: r for t, r in encoder.vocabulary.ranks.items() if len(t) <= 6})
    data = cases.words(1, 3000).replace(" ", "").encode()
    store = bpe.PrefixStore(vocabulary, data)
    assert store.replace(50, 51, b"q") < 200
    assert store.last == bpe.PrefixStore(vocabulary, data[:50] + b"q" + data[51:]).last


def test_unordered_ranks_fall_back_to_the_definition():
    ranks = {bytes([b]): b for b in range(97, 101)} | {b"bc": 200, b"ab": 201, b"abc": 150, b"abcd": 300}
    vocabulary = bpe.Vocabulary(ranks)
    assert not vocabulary.ordered
    known = tiktoken.Encoding("odd", pat_str=r"[a-d]+", mergeable_ranks=ranks | {bytes([b]): 1000 + b for b in range(256) if not 97 <= b <= 100}, special_tokens={})
    for text in ("abcd", "abab", "bcbcabcdd", "aabbccdd"):
        assert bpe.PrefixStore(vocabulary, text.encode()).ids() == known.encode_ordinary(text)


def test_tokens_round_trip_edges(docs, nothing):
    tokens = bpe.encode(docs, RANKS, public_tokenizers.PATTERN)
    texts = bpe.decode(tokens, RANKS)
    assert Counter((r.doc_id, bytes(r.text)) for r in texts.collect()) == Counter((d, (t or "").encode()) for d, t, *_ in cases.documents())
    assert {r.doc_id: r.ids for r in tokens.collect()}[1] == []
    assert bpe.round_trip(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


# secrets


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "apikey", "api_key", "Secret", "passWORD", ":", "=", " ", '"', "'", "AKIA", "ABCDEFGH12", "0123456789abcdef", "abc", "é", "\n", "zz9", "deadbeef", "ſecret", "eyJabcdefghij.", "ghp_" + "a" * 36]), max_size=20))
def test_base_spans_are_those_of_the_patterns(parts):
    text = "".join(parts)
    assert [s for s in scanner().spans(text.encode()) if s[0] in ("assign", "access", "hex")] == brute_text.secrets(text)


def test_more_kinds_and_edges(docs, nothing):
    scan = secret_scan.scanner()
    text = "é -----BEGIN RSA PRIVATE KEY----- ghp_" + "Z" * 36 + " eyJhbGci.eyJzdWIi.sig-_9"
    assert [s[0] for s in scan.spans(text.encode())] == ["pem", "github", "jwt"]
    assert scan.spans(text.encode())[0] == ("pem", 2, 33)
    got = {r.doc_id: r for r in secret_scan.digest(secret_scan.find_secrets(docs)).collect()}
    assert got[1].spans == got[2].spans == "" and (got[12].n_assign, got[12].n_hex) == (1, 1)
    assert secret_scan.digest(secret_scan.find_secrets(nothing)).count() == 0


def test_automaton_is_minimal():
    same = automaton.compile_rules([("ab|ab", False)], anywhere=False)
    assert len(same.table) == len(automaton.compile_rules([("ab", False)], anywhere=False).table) == 4 * 256


# language


def test_language_edges(docs, nothing):
    got = {r.doc_id: r for r in langid.detect(docs).collect()}
    assert [got[d].lang_pred for d in (1, 2, 3)] == ["und"] * 3 and got[1].score == 0
    assert not got[None].held_out
    kept = langid.accepted(docs)
    assert kept.columns == docs.columns and {1, 2, 3}.isdisjoint(r.doc_id for r in kept.collect())
    assert langid.detect(nothing).count() == langid.accepted(nothing).count() == 0
    assert {r.lang_pred for r in langid.detect(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.fit(docs.withColumn("lang", F.col("doc_id").cast("string")), max_languages=3)


def test_gram_counts_do_not_depend_on_pieces(monkeypatch):
    text = "Fünf Öfen " * 50
    whole = langid.gram_counts(text, 10)
    monkeypatch.setattr(langid, "PIECE", 7)
    assert (langid.gram_counts(text, 10) == whole).all() and whole.sum() == 3 * 500 - 3


# chat


def merging(turns):
    """A template that rewrites: only the last assistant text stays."""
    return "".join(f"<{r}>{t}" for i, (r, t) in enumerate(turns) if r != "assistant" or i == len(turns) - 1)


ODD = ["</s>", "\\", "[INST] x [/INST]", "<<s>", "a\\<s>\n", "", "<\\s>", "A", "B", "<s>user\nhi</s>"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "", "to\\ol\n"]), st.sampled_from(ODD)), max_size=9), st.integers(1, 4), st.sampled_from([0, 1, None]))
def test_pieces_read_back(turns, block, context):
    pieces = list(chat.rendered(turns, chat.instruct, context, block))
    whole = "".join(p.piece for p in pieces)
    assert whole == chat.instruct(turns) and chat.read_back(whole) == turns
    assert [chat.unescape(p.piece[p.text_start : p.text_end]) for p in pieces] == [t for _, t in turns]
    assert not any(p.rewrites for p in pieces)


def test_rewriting_templates_are_told():
    turns = [("user", "a"), ("assistant", "b"), ("user", "c")]
    assert [p.rewrites for p in chat.rendered(turns, merging, None, 64)] == [False, False, True]


def test_templates_that_look_far_back_are_told_by_default(spark):
    """Numbering goes on past a block, and a cut to the last 100 turns is told."""
    rows = [(1, i, "user", str(i)) for i in range(130)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = [r[2:] for r in rows]

    def numbered(turns):
        return "".join(f"{i}. {text}\n" for i, (_, text) in enumerate(turns))

    def last(turns):
        return "".join(f"<{text}>" for _, text in turns[-100:])

    pieces = sorted(chat.format_turns(frame, numbered).collect(), key=lambda p: p.position)
    assert "".join(p.piece for p in pieces) == numbered(turns) and not any(p.rewrites for p in pieces)
    pieces = sorted(chat.format_turns(frame, last).collect(), key=lambda p: p.position)
    assert [p.rewrites for p in pieces] == [i >= 100 for i in range(130)]


def test_turns_with_nulls(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "x"), (None, None, "user", "y"), (1, 1, "assistant", None), (2, 5, "assistant", "</s>")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(1))
    pieces = chat.format_turns(frame).collect()
    assert Counter((p.conv_id, p.position, p.role) for p in pieces) == Counter([(1, 0, ""), (1, 1, "assistant"), (1, 2, "assistant"), (None, 0, "user"), (2, 0, "assistant")])
    masked = [p for p in pieces if p.conv_id == 2][0]
    assert masked.in_loss and chat.unescape(masked.piece[masked.text_start : masked.text_end]) == "</s>"
    assert {r.conv_id: r.n_turns for r in chat.digest(frame).collect()} == {1: 3, None: 1, 2: 1}
    assert chat.digest(frame.limit(0)).count() == chat.format_turns(frame.limit(0)).count() == 0


# pages

PAGE = """<html><body class="with-sidebar"><header><h1>Site</h1></header><nav>Home</nav><div class="cookie-notice">We use cookies</div>
<div class="layout sidebar-left"><article><header><h1>The  title</h1></header><p>One &amp; two<b>three</b><br>four<p>Five<script>x("</p>")</script>
<div class="ad-slot">Buy</div><form><p>Mail</p></form><footer>by us</footer></article><aside>Side</aside>
<section id="comments"><article class="comment"><p>First!</p></article></section></div><footer>&copy;</footer></body></html>"""


def test_structure_of_a_page():
    assert [b for z, b in html_text.blocks_of(PAGE) if z == html_text.MAIN] == ["The title", "One & twothree four", "Five"]
    assert html_text.blocks_of("") == [] and html_text.blocks_of("<p") in ([], [(1, "<p")])


def test_pages_without_structure_lose_what_their_host_repeats(spark):
    menu = "home about us contact imprint privacy terms jobs press help"
    rows = [(i, f"http://h.example/{i}", f"<div>{menu}</div><div>{cases.words(i, 30)}</div>") for i in range(6)]
    rows += [(7, "http://other.example/", f"<div>{menu}</div>"), (8, None, None), (None, "::[", ""), (9, "http://h.example/9", PAGE), (0, *rows[0][1:])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))
    got = {r.page_id: r for r in html_text.main_text(pages.repartition(5)).collect()}
    assert len(html_text.main_text(pages).collect()) == len(rows)
    for i in range(6):
        assert got[i].text == cases.words(i, 30) and got[i].n_repeated == 10
    assert got[7].text == menu and got[8].text == got[None].text == ""
    assert got[9].text.startswith("The title\n\nOne")
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_articles_are_compared_too_and_stay_whole(spark):
    """Runs that articles of one host share are found like those around them; the markup keeps them in the text."""
    shared, menu = cases.words(90, 20), cases.words(91, 9)
    rows = [(i, f"http://h.example/{i}", f"<nav>{menu}</nav><article><p>{cases.words(i, 15)}</p><p>{shared if i < 2 else cases.words(50 + i, 20)}</p></article>") for i in range(4)]
    got = {r.page_id: r for r in html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    assert [got[i].n_repeated for i in range(4)] == [29, 29, 9, 9]
    assert all(got[i].text == f"{cases.words(i, 15)}\n\n{shared if i < 2 else cases.words(50 + i, 20)}" for i in range(4))


def test_a_common_byline_with_other_words_is_spread(spark):
    """No (host, anchor) takes a segment of every page, and the texts do not depend on which ones count as hot."""
    rows = [(i, f"http://h.example/{i}", f"<div>{cases.words(2 * i, 12)} © h.example {cases.words(2 * i + 1, 12)}</div>") for i in range(200)]
    rows += [(i + 200, "http://h.example/x", rows[i][2].replace("<div>", "<div>more ")) for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    parsed = pages.selectExpr("page_id", "page_id page_hash", "url", "html").mapInArrow(html_text._parse, html_text.PARSED)
    keys = html_text.segments_of(parsed, 8, 20).where("tokens is not null").groupBy("host", "anchor").count()
    assert keys.agg(F.max("count")).first()[0] <= 20
    plain = of(html_text.main_text(pages, hot=10**9))
    assert of(html_text.main_text(pages, hot=20)) == of(html_text.main_text(pages, hot=0)) == plain
    assert sum(r[4] > 0 for r in plain) == 6


def test_covered_tokens_are_those_of_windows_on_distinct_pages(spark):
    """Also where a segment that several pages share has a window in common with another one of its first page (missed before)."""
    rng = random.Random(5)
    rows = []
    for i in range(150):
        said = ["\u2003".join(rng.choices("abcd", k=rng.randint(9, 14))) if rng.random() < 0.5 else cases.words(rng.randint(0, 40), 12) for _ in range(4)]
        rows.append((i, f"http://h{i % 3}.example/{i}", "".join(f"<p>{t}</p>" for t in [*said, said[0] + " " + said[1]])))
    tokens = {i: html.replace("<p>", " ").replace("</p>", " ").split() for i, _, html in rows}
    on = {}
    for i, t in tokens.items():
        for j in range(len(t) - 7):
            on.setdefault((i % 3, *t[j : j + 8]), set()).add(i)
    pages = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, html string").repartition(3)
    for got in (html_text.main_text(pages), html_text.main_text(pages, hot=5)):
        for r in got.collect():
            t = tokens[r.page_id]
            covered = {k for j in range(len(t) - 7) if len(on[(r.page_id % 3, *t[j : j + 8])]) > 1 for k in range(j, j + 8)}
            assert (r.n_repeated, r.text.split()) == (len(covered), [w for k, w in enumerate(t) if k not in covered])


def test_the_comparison_of_pages_moves_little(spark):
    """Pages, keys and segments of a host that repeats a third of its text together stay below what the pages take (before: 3 times as much)."""
    rows = [(i, f"http://h.example/{i}", f"<main><p>{cases.words(i, 200)}</p><p>{cases.words(-1 - i % 40, 100)}</p></main>") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    parsed = pages.selectExpr("page_id", "page_id page_hash", "url", "html").mapInArrow(html_text._parse, html_text.PARSED)
    keys = parsed.mapInArrow(html_text._keys(8, 4), html_text.KEYS)
    moved = [parsed, keys, html_text._packed_segments(parsed, 8, 1024)]
    sizes = [df.select(F.sum(sum(F.length(c) for c, kind in df.dtypes if kind == "binary"))).first()[0] for df in moved]
    assert sum(sizes) < sum(len(r[2]) for r in rows)
    assert moved[2].count() <= 4 and all(r.n_repeated >= 100 for r in html_text.main_text(pages).collect())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=3, max_size=20), min_size=1, max_size=6))
def test_repeated_windows_are_those_on_distinct_pages(segments):
    pages = np.arange(len(segments))
    marks = html_text.repeated_windows([np.array(s) for s in segments], pages, pages, 3)
    on = {}
    for i, s in enumerate(segments):
        for j in range(len(s) - 2):
            on.setdefault(tuple(s[j : j + 3]), set()).add(i)
    for s, mark in zip(segments, marks, strict=True):
        assert mark.tolist() == [len(on.get(tuple(s[j : j + 3]), ())) > 1 for j in range(len(s))]


# the pipeline


def test_pipeline_edges(spark, nothing, tmp_path):
    items = spark.createDataFrame([(1, cases.PASSAGE)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (cases.frame(spark), nothing):
        docs = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == start.columns, name
        left = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()}
        assert left == (set() if start is nothing else {None, 4, 7, 11, 12, 13, 14} | ({5} & left))


# personal data


PRIVATE = [
    "mail Bob.Smith+x@mail.example.com, then bob.smith+x@MAIL.example.com",
    "call +1 (555) 123-4567 or +1 5551234567, card 4111111111111111",
    "4111-1111-1111-1111 5500 0000 0000 0004 4111111111111112",
    "ssn 123-45-6789 and 000-12-3456, 666-12-3456, 899-99-9999",
    "ip 10.0.255.1 300.1.1.1 1.2.3.4.5",
    "on 1999-12-31 or 31.12.1999, 12/31/1999, 2001-02-30, 1699-12-31",
    None,
    "",
    "no digits",
    "+3 (804) 294-3850 4944339490429605 12 ende",
    "été 4944339490429605 " * 500,
]


def test_pseudonyms_stay_in_their_format(spark):
    rows = [(i, t, "own") for i, t in enumerate(PRIVATE)] + [(None, PRIVATE[1], "own"), (1, PRIVATE[1], "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, finds string")
    new = pii.pseudonyms(docs, "key")
    got = {r.doc_id: r for r in new.collect()}
    assert new.count() == len(rows) and got[None].text == got[1].text
    assert [(f.kind, f.value) for f in got[5].finds] == [("date", d) for d in ("1999-12-31", "31.12.1999", "12/31/1999")]
    assert got[6].text is None and got[7].text == "" and got[8].text == "no digits"
    assert "300.1.1.1 1.2.3.4.5" in got[4].text and "000-12-3456, 666-12-3456" in got[3].text
    assert got[2].text.endswith(" 4111111111111112")
    values = {}
    for r in got.values():
        for f in r.finds:
            assert f.value != f.pseudonym and f.value not in r.text
            if f.kind != "email":
                assert len(f.value) == len(f.pseudonym) or f.kind == "ip"
                assert re.sub(r"\d", "9", f.value) == re.sub(r"\d", "9", f.pseudonym) or f.kind == "ip"
            plain = [re.sub(r"\D", "", v) if f.kind in ("card", "phone") else v.lower() for v in (f.value, f.pseudonym)]
            assert values.setdefault((f.kind, plain[0]), plain[1]) == plain[1]
            assert f.kind != "card" or brute_text.luhn(plain[1])
    day = {f.pseudonym[:4] + f.pseudonym[5:7] + f.pseudonym[8:] if f.pseudonym[4] == "-" else None for f in got[5].finds}
    assert len(day - {None}) == 1
    back = {r.doc_id: r.text for r in pii.restore(new.select("doc_id", "text"), "key").collect()}
    assert all(back[i] == t for i, t in enumerate(PRIVATE) if i != 0)
    other = {r.doc_id: r.text for r in pii.pseudonyms(docs, "other").collect()}
    assert other[1] != got[1].text
    assert pii.report(pii.pseudonyms(docs.limit(0), "key")).count() == 0
    with pytest.raises(ValueError):
        pii.pseudonyms(docs, "")


def test_networks_are_permutations(spark):
    pairs = spark.range(7 * 11).select((F.col("id") % 7).alias("x"), F.floor(F.col("id") / 7).alias("y"))
    new = pairs.select("x", "y", pii._permuted(F.col("x"), F.col("y"), F.lit(7), F.lit(11), "k", "t", False).alias("p"))
    back = pii._permuted(F.col("p.x"), F.col("p.y"), F.lit(7), F.lit(11), "k", "t", True)
    rows = new.select("*", back.alias("q")).collect()
    assert len({tuple(r.p) for r in rows}) == 77 and all(tuple(r.q) == (r.x, r.y) for r in rows)


@pytest.mark.parametrize("length", [5, 40, 100, 200])
def test_suffixes_are_sorted_once_alone_no_more(length, monkeypatch):
    """The order is that of the first symbols; later rounds sort only what is tied, and the extension begins at their depth."""
    rng = np.random.default_rng(length)
    base = rng.integers(1, 5, 150)
    symbols = np.concatenate([rng.integers(1, 256, 3000), base, [0], base[20:], [0], base[:130], [0]])
    sorted_at_once = []
    argsort = np.argsort
    monkeypatch.setattr(suffix_dedup.np, "argsort", lambda a, **kw: sorted_at_once.append(len(a)) or argsort(a, **kw))
    order, ranked, heads = suffix_dedup.suffix_order(symbols, length)
    keys = [tuple(symbols[i : i + length]) for i in order]
    assert sorted(order.tolist()) == list(range(len(symbols)))
    assert keys == sorted(keys)
    assert (0 < ranked < length) == (length > 7)
    assert heads.tolist() == [i == 0 or keys[i][:ranked] != keys[i - 1][:ranked] for i in range(len(keys))]
    assert sum(sorted_at_once) < len(symbols) + 4 * 500
