"""Byte automata: small regexes to one minimised transition table.

Rules are written in a regex subset: literals, escapes (``\\.``, ``\\xHH``), classes,
groups, ``|`` and the repeats ``? * + {m} {m,} {m,n}``.  ``compile_rules`` builds a
nondeterministic automaton by Thompson's construction, makes it deterministic by
subset construction and minimises it by partition refinement.  States are byte
rows of one flat transition list, ordered so that every accepting state has a
number of at least ``first_accepting``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

REPEAT = re.compile(r"[?*+]|\{(\d+)(,?)(\d*)\}")


class _Parser:
    """Adds the fragments of a rule to a list of states: (byte set or None, targets)."""

    def __init__(self, source: str, fold: bool, states: list):
        self.source, self.at, self.fold, self.states = source, 0, fold, states

    def state(self) -> int:
        self.states.append([])
        return len(self.states) - 1

    def link(self, a: int, b: int, over: frozenset[int] | None = None) -> None:
        self.states[a].append((over, b))

    def choice(self) -> tuple[int, int]:
        start, end = self.state(), self.state()
        while True:
            a, b = self.sequence()
            self.link(start, a)
            self.link(b, end)
            if self.source[self.at : self.at + 1] != "|":
                return start, end
            self.at += 1

    def sequence(self) -> tuple[int, int]:
        start = end = self.state()
        while self.at < len(self.source) and self.source[self.at] not in "|)":
            from_ = self.at
            a, b = self.atom()
            m = REPEAT.match(self.source, self.at)
            if m:
                to = self.at
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(m[0], (None, None))
                if low is None:
                    low = int(m[1])
                    high = int(m[3]) if m[3] else None if m[2] else low
                parts = [(a, b)]
                for _ in range(max(low, high or 0, 1) - 1):
                    self.at = from_
                    parts.append(self.atom())
                assert self.at <= to
                self.at = m.end()
                if high is None:
                    self.link(parts[-1][1], parts[-1][0])
                stop = self.state()
                for i, (x, y) in enumerate(parts):
                    self.link(end, x)
                    if i >= low:
                        self.link(end, stop)
                    end = y
                self.link(end, stop)
                end = stop
            else:
                self.link(end, a)
                end = b
        return start, end

    def atom(self) -> tuple[int, int]:
        c = self.source[self.at]
        if c == "(":
            self.at += 1
            pair = self.choice()
            assert self.source[self.at] == ")"
            self.at += 1
            return pair
        bytes_ = self.char_class() if c == "[" else self.single()
        if self.fold:
            bytes_ = bytes_ | {b ^ 32 for b in bytes_ if chr(b).isascii() and chr(b).isalpha()}
        a, b = self.state(), self.state()
        self.link(a, b, frozenset(bytes_))
        return a, b

    def single(self) -> set[int]:
        c = self.source[self.at]
        self.at += 1
        if c == "\\":
            c = self.source[self.at]
            self.at += 1
            if c == "x":
                self.at += 2
                return {int(self.source[self.at - 2 : self.at], 16)}
        return {ord(c)}

    def char_class(self) -> set[int]:
        self.at += 1
        negated = self.source[self.at] == "^"
        self.at += negated
        found: set[int] = set()
        while self.source[self.at] != "]":
            low = self.single()
            if self.source[self.at] == "-" and self.source[self.at + 1] != "]":
                self.at += 1
                low = set(range(min(low), max(self.single()) + 1))
            found |= low
        self.at += 1
        return set(range(256)) - found if negated else found


@dataclass(frozen=True)
class Automaton:
    """``table[state + byte]`` is the next state; states are multiples of 256."""

    table: list[int]
    start: int
    first_accepting: int
    accepts: dict[int, tuple[int, ...]]  # accepting state -> numbers of its rules
    dead: int  # the state that nothing leaves, -1 if there is none


def compile_rules(rules: list[tuple[str, bool]], anywhere: bool) -> Automaton:
    """One automaton for all rules (regex, whether letters match in either case).

    ``anywhere``: a rule may begin at any byte, and what has been accepted does
    not end the scan.
    """
    states: list = []
    root = len(states)
    states.append([])
    ends: dict[int, int] = {}
    for number, (source, fold) in enumerate(rules):
        parser = _Parser(source, fold, states)
        a, b = parser.choice()
        assert parser.at == len(source), source
        states[root].append((None, a))
        ends[b] = number

    def closed(seed) -> frozenset[int]:
        found, todo = set(seed), list(seed)
        while todo:
            for over, to in states[todo.pop()]:
                if over is None and to not in found:
                    found.add(to)
                    todo.append(to)
        return frozenset(found)

    # bytes that no rule tells apart share their transitions
    sets = {over for edges in states for over, _ in edges if over is not None}
    like: dict = {}
    for b in range(256):
        like.setdefault(tuple(b in x for x in sets), []).append(b)
    groups = list(like.values())
    group_of = {b: g for g, members in enumerate(groups) for b in members}
    over_groups = {x: {group_of[b] for b in x} for x in sets}

    first = closed([root])
    numbers = {first: 0}
    rows: list[list[int]] = []
    order = [first]
    for current in order:
        moves: list[set[int]] = [set(first) if anywhere else set() for _ in groups]
        for s in current:
            for over, to in states[s]:
                if over is not None:
                    for g in over_groups[over]:
                        moves[g].add(to)
        row, made = [], {}
        for targets in moves:
            key = frozenset(targets)
            if key not in made:
                made[key] = closed(key)
            nxt = made[key]
            if nxt not in numbers:
                numbers[nxt] = len(order)
                order.append(nxt)
            row.append(numbers[nxt])
        rows.append(row)
    accepted = [tuple(sorted({ends[s] for s in x if s in ends})) for x in order]

    block = {a: i for i, a in enumerate(sorted(set(accepted)))}
    part = [block[a] for a in accepted]
    while True:  # states stay together while their rows lead into the same blocks
        signature: dict = {}
        refined = [signature.setdefault((p, tuple(part[t] for t in row)), len(signature)) for p, row in zip(part, rows, strict=True)]
        if len(signature) == len(set(part)):
            break
        part = refined
    part = refined
    by_part = {p: i for i, p in reversed(list(enumerate(part)))}  # a state for each block
    ranked = sorted(by_part, key=lambda p: (bool(accepted[by_part[p]]), p))
    place = {p: i for i, p in enumerate(ranked)}
    table = [place[part[rows[by_part[p]][group_of[b]]]] * 256 for p in ranked for b in range(256)]
    accepts = {place[p] * 256: accepted[by_part[p]] for p in ranked if accepted[by_part[p]]}
    dead = next((p * 256 for p in range(len(ranked)) if p * 256 not in accepts and set(table[p * 256 : p * 256 + 256]) == {p * 256}), -1)
    return Automaton(table, place[part[0]] * 256, min(accepts, default=len(table)), accepts, dead)
