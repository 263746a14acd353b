"""Secrets in texts, found by one combined deterministic automaton.

The signs of all rules are compiled into one minimised table that reads every
byte of a text once and tells which rules may match.  Only for those the spans follow
from an automaton of the rule's base form, leftmost first and as long as possible; matches that are
too short still use up their bytes and are dropped afterwards.

Rules after the base ones add spans of other kinds and leave the base spans as
they are.  Spans count code points, the end is exclusive.

Defined results: a null or empty text has no spans.  Equal starts are ordered by
the order of the rules.  Only ``doc_id`` and ``text`` are read; repeated rows are
scanned one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton, compile_rules
from .common import broadcast


@dataclass(frozen=True)
class Rule:
    kind: str
    sign: str  # what every match that counts contains
    base: str  # what uses up bytes
    least: str  # the same, long enough to count
    fold: bool = False
    base_rule: bool = True


ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]"""
JWT = r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"
PEM = "-----BEGIN ([A-Z]+ )*PRIVATE KEY-----"
#: The base kinds with their patterns and least lengths, then kinds of public key formats.
RULES = (
    Rule("assign", ASSIGN, ASSIGN + "+", ASSIGN + "{8,}", fold=True),
    Rule("access", "AKIA[A-Z0-9]", "AKIA[A-Z0-9]+", "AKIA[A-Z0-9]{12,}"),
    Rule("hex", "[0-9a-f]{32}", "[0-9a-f]+", "[0-9a-f]{32,}"),
    Rule("github", "gh[opsu]_", "gh[opsu]_[A-Za-z0-9]+", "gh[opsu]_[A-Za-z0-9]{36,}", base_rule=False),
    Rule("jwt", "eyJ", JWT, JWT, base_rule=False),
    Rule("pem", "-----BEGIN ", PEM, PEM, base_rule=False),
)
SPANS = "array<struct<kind:string,start:long,end:long>>"


@dataclass(frozen=True)
class Scanner:
    rules: tuple[Rule, ...]
    combined: Automaton
    bases: list[Automaton]
    leasts: list[Automaton]

    def kinds(self, data: bytes) -> list[int]:
        """Numbers of the rules that accept somewhere: the one pass over the bytes."""
        table, first, state = self.combined.table, self.combined.first_accepting, self.combined.start
        seen = set()
        for byte in data:
            state = table[state + byte]
            if state >= first:
                seen.add(state)
        return sorted({rule for s in seen for rule in self.combined.accepts[s]})

    def spans(self, data: bytes) -> list[tuple[str, int, int]]:
        """kind, start and end in code points, by start and then by rule."""
        found = []
        for number in self.kinds(data):
            found += ((start, number, end) for start, end in self._spans_of(number, data))
        if not found:
            return []
        found.sort()
        ascii_only = data.isascii()
        place = (lambda at: at) if ascii_only else (lambda at: len(data[:at].decode()))
        return [(self.rules[n].kind, place(a), place(b)) for a, n, b in found]

    def _spans_of(self, number: int, data: bytes) -> Iterator[tuple[int, int]]:
        base, least = self.bases[number], self.leasts[number]
        opening = {b for b in range(256) if base.table[base.start + b] != base.dead}
        at = 0
        while at < len(data):
            if data[at] in opening:
                end = longest(base, data, at)
                if end > at:
                    if longest(least, data, at) == end:
                        yield at, end
                    at = end
                    continue
            at += 1


def longest(automaton: Automaton, data: bytes, at: int) -> int:
    """Where the longest match that begins at ``at`` ends; ``at`` if there is none."""
    table, state, dead, accepts = automaton.table, automaton.start, automaton.dead, automaton.first_accepting
    end = at
    for place in range(at, len(data)):
        state = table[state + data[place]]
        if state == dead:
            break
        if state >= accepts:
            end = place + 1
    return end


def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(
        rules,
        compile_rules([(r.sign, r.fold) for r in rules], anywhere=True),
        [compile_rules([(r.base, r.fold)], anywhere=False) for r in rules],
        [compile_rules([(r.least, r.fold)], anywhere=False) for r in rules],
    )


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and the spans (kind, start, end) of every whole text."""
    shared = broadcast(docs.sparkSession, scanner(rules))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column("text").cast(pa.binary()):
                spans = shared.value.spans(text.as_py() or b"")
                rows.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], ["doc_id", "spans"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return ids.mapInArrow(run, f"doc_id long, spans {SPANS}")


def joined(spans):
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(kinds: list[str]):
    return lambda span: span["kind"].isin(kinds)


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts of the base kinds, the digest of their spans and all spans as text."""
    base = [r.kind for r in rules if r.base_rule]
    counts = [F.size(F.filter("spans", _of_kind([k]))).cast("long").alias(f"n_{k}") for k in base]
    base_spans = F.filter("spans", _of_kind(base))
    return found.select(
        "doc_id", *counts, F.sha2(joined(base_spans), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )


