"""Registered text queries against their SQL, or against plain Python, over the whole small tables."""

import hashlib
import html
import os
import re
import zlib

import brute_text
import duckdb
import oracle
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tallybook.llm import bpe
from tallybook.llm.queries import ORACLES, QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


def sha(data) -> str:
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text, lang from '{SF_DIR}/documents.parquet' order by doc_id").fetchall()


def answers(spark, name):
    return {r[0]: r for r in QUERIES[name](spark, SF_DIR).collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    got = QUERIES[name](spark, SF_DIR).toArrow()
    want = oracle.connect(SF_DIR).sql(ORACLES[name]).to_arrow_table()
    assert oracle.compare(got, want) is None


def test_html_text(spark):
    got = answers(spark, "op1_html_text")
    pages = duckdb.sql(f"select page_id, html from '{SF_DIR}/pages.parquet'").fetchall()
    assert len(got) == len(pages)
    for page_id, source in pages:
        article = re.search("(?s)<article>(.*?)(</article>|$)", source)[1]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>|<br>", article)]
        text = "\n\n".join(b for b in blocks if b)
        assert (got[page_id].text, got[page_id].n_chars) == (text, len(text))


def test_byte_bpe(spark, docs):
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    known = tiktoken.Encoding("known", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = answers(spark, "op2_byte_bpe")
    for doc_id, text, _ in docs:
        ids = known.encode_ordinary(text or "")
        assert tuple(got[doc_id])[1:] == (len(ids), sha(" ".join(map(str, ids))), sha(text or ""))


def test_secret_scan(spark, docs):
    got = answers(spark, "op4_secret_scan")
    for doc_id, text, _ in docs:
        spans = brute_text.secrets(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = tuple(sum(s[0] == k for s in spans) for k in ("assign", "access", "hex"))
        assert tuple(got[doc_id])[1:5] == (*counts, sha(joined))


def test_language_id_on_held_out_rows(spark, docs):
    got = answers(spark, "op5_language_id")
    held = [(d, lang) for d, _, lang in docs if zlib.crc32(str(d).encode()) % 5 == 0]
    assert {d for d, r in got.items() if r.held_out} == {d for d, _ in held}
    right = sum(got[d].lang_pred == lang for d, lang in held)
    assert right >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_suffix_dedup(spark, docs):
    got = answers(spark, "op6_suffix_dedup")
    want = brute_text.repeats([(d, (t or "").encode()) for d, t, _ in docs], 100)
    for doc_id, (size, removed, spans, kept) in want.items():
        assert tuple(got[doc_id])[1:] == (size, removed, spans, sha(kept))


def test_chat_format(spark):
    got = answers(spark, "op8_chat_format")
    rows = duckdb.sql(f"select conv_id, role, text from '{SF_DIR}/conversations.parquet' order by conv_id, turn").fetchall()
    rows += [(-7, role, "</s>[INST] ok [/INST]") for role in ("user", "assistant")]
    for conv in {r[0] for r in rows}:
        turns = [(role, text or "") for c, role, text in rows if c == conv]
        loss = "".join(t for role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for role, t in turns)
        assert tuple(got[conv])[1:5] == (len(turns), sha(whole), len(loss), sha(loss))
        assert got[conv].formatted_chars > sum(len(t) for _, t in turns)


def test_pii(spark, docs):
    """Planted values go, and equal ones become equal ones; the rest of the text stays."""
    got = answers(spark, "op9_pii")
    forms = {
        "email": r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+",
        "phone": r"\+\d \(\d{3}\) \d{3}-\d{4}",
        "card": r"(?<!\d)\d{16}(?!\d)",
        "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)",
    }
    for kind, form in forms.items():
        known = {}
        for doc_id, text, _ in docs:
            before, after = re.findall(form, text or ""), re.findall(form, got[doc_id].text or "")
            assert len(before) == len(after)
            real = [kind != "card" or brute_text.luhn(a) for a in before]
            for a, b, private in zip(before, after, real, strict=True):
                assert (a != b) == private and known.setdefault(a, b) == b
            assert getattr(got[doc_id], f"n_{kind}") == sum(real)
        assert len(set(known.values())) == len(known)
    every = "|".join(forms.values())
    assert all(re.split(every, t or "") == re.split(every, got[d].text or "") for d, t, _ in docs)


def test_simhash(spark, docs):
    got = answers(spark, "op10_simhash")
    for doc_id, (print_, component) in brute_text.near_groups([(d, t or "") for d, t, _ in docs], 3, 2).items():
        assert tuple(got[doc_id])[1:] == (f"{print_:016x}", component)


def test_pipeline(spark, docs):
    """Each stage against plain Python on what the stage before kept."""
    table = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = table.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language id", "exact dedup", "simhash near dedup", "benchmark decontamination", "byte bpe"]

    kept = stages["language id"](spark, table, SF_DIR)
    assert kept.columns == columns
    texts = {r.doc_id: r.text for r in kept.collect()}
    assert set(texts) == {d for d, t, _ in docs if t and any(c.isalpha() for c in t)}

    kept = stages["exact dedup"](spark, kept, SF_DIR)
    best = {}
    for d, t in sorted(texts.items(), key=lambda x: (-len(x[1]), x[0])):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), d)
    texts = {d: texts[d] for d in best.values()}
    assert {r.doc_id: r.text for r in kept.collect()} == texts

    kept = stages["simhash near dedup"](spark, kept, SF_DIR)
    texts = {d: texts[d] for d, (_, c) in brute_text.near_groups(sorted(texts.items()), 3, 2).items() if d == c}
    assert {r.doc_id: r.text for r in kept.collect()} == texts

    kept = stages["benchmark decontamination"](spark, kept, SF_DIR)
    items = duckdb.sql(f"select text from '{SF_DIR}/benchmark.parquet'").fetchall()
    windows = brute_text.windows([t for (t,) in items], 10)
    texts = {d: t for d, t in texts.items() if not brute_text.holds(t, windows)}
    assert kept.columns == columns
    assert {r.doc_id: r.text for r in kept.collect()} == texts

    last = {r.doc_id: r.decoded_sha256 for r in stages["byte bpe"](spark, kept, SF_DIR).collect()}
    assert last == {d: sha(t) for d, t in texts.items()}
    assert {r.doc_id: r.decoded_sha256 for r in corpus_pipeline.run(spark, SF_DIR).collect()} == last
