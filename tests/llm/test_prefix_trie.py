"""The conversation prefix trie against a brute-force trie of tuples."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tallybook.llm import prefix_trie
from tallybook.llm.queries import QUERIES

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, base=100, shared=6):
    convs = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            convs[conv_id].append((turn is not None, turn or 0, role or "", text or ""))
    ordered = {c: [(r, t) for _, _, r, t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, own in ordered.items():
        h = zlib.crc32(str(c).encode()) % shared
        head = ordered.get(c - int(math.fmod(c, base)), [])[:h]
        built[c] = head + own[h:]
    nodes = defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
    children = Counter(p[:-1] for p in nodes if p)
    out = []
    for p, members in nodes.items():
        sub = [q for q in nodes if q[: len(p)] == p]
        ends = sorted(c for c in members if len(built[c]) == len(p))
        out.append(
            (
                min(members),
                len(p),
                min(nodes[p[:-1]]) if p else None,
                len(members),
                children[p],
                sum(children[q] == 0 for q in sub),
                sum((len(nodes[q]) - 1) * (len(q[-1][1]) if q else 0) for q in sub),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*prefix_trie.NODES).collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{SF_DIR}/conversations.parquet'").fetchall()
    assert got(QUERIES["op13_prefix_trie"](spark, SF_DIR)) == brute(rows)


EDGES = [
    # base 100 shares its first turns; 101..105 take some of them
    *[(100, t, "user" if t % 2 == 0 else "assistant", f"base turn {t}") for t in range(6)],
    *[(c, t, "user", f"own {c} {t}") for c in (101, 102, 103, 104, 105) for t in range(4)],
    (106, 0, "user", "base turn 0"),  # a copy of the first turn of 100
    (107, None, None, None),  # a turn without place, role or text
    (107, 1, "user", ""),
    (108, 0, "user", "same"),
    (108, 0, "user", "same"),  # a repeated row
    (None, 0, "user", "no conversation"),
    (250, 0, "system", "x" * 10000),  # a long text; base 200 does not exist
    (250, 1, "user", "tie"),
    (251, 0, "system", "x" * 10000),
    (251, 1, "user", "tie"),
    (7, 3, "user", "é漢"),
    (-7, 0, "user", "negative id"),
]


@pytest.mark.parametrize("base,shared", [(100, 6), (10, 3), (1, 1)])
def test_edges(spark, base, shared):
    df = spark.createDataFrame(EDGES, SCHEMA).withColumns({"depth": F.lit("clash"), "k1": F.lit(1), "pos": F.lit(2), "length": F.lit(3)})
    assert got(prefix_trie.trie(df, base, shared)) == brute(EDGES, base, shared)


def test_empty(spark):
    assert prefix_trie.trie(spark.createDataFrame([], SCHEMA)).count() == 0
