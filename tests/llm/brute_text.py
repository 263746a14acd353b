"""Plain versions of the text operators."""

import re

import numpy as np
import xxhash

SECRETS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def secrets(text):
    found = [
        (m.start(), order, m.end(), kind)
        for order, (kind, pattern, group, least) in enumerate(SECRETS)
        for m in pattern.finditer(text)
        if len(m[group]) >= least
    ]
    return [(kind, a, b) for a, _, b, kind in sorted(found)]


def repeats(rows, length):
    """doc_id -> size, removed bytes, spans, bytes kept; rows in order of doc_id."""
    seen, out = set(), {}
    for doc_id, data in rows:
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - length + 1):
            part = data[i : i + length]
            if part in seen:
                gone[i : i + length] = True
            seen.add(part)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out[doc_id] = (len(data), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), kept)
    return out


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def print_of(text, size):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    shingles = [" ".join(tokens[i : i + size]) for i in range(len(tokens) - size + 1)] or [" ".join(tokens)] * bool(tokens)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_groups(rows, size, radius):
    """doc_id -> fingerprint and least doc_id reachable."""
    prints = {d: print_of(t, size) for d, t in rows}
    parent = {d: d for d in prints}

    def top(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(prints)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = top(a), top(b)
                parent[max(x, y)] = min(x, y)
    return {d: (prints[d], top(d)) for d in ids}


def windows(texts, size):
    found = set()
    for text in texts:
        tokens = WORD.findall(lowered(text or ""))
        n = min(size, len(tokens))
        found |= {tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1)} if n else set()
    return found


def hit_places(text, found):
    tokens = WORD.findall(lowered(text or ""))
    places = set()
    for n in {len(w) for w in found}:
        for i in range(len(tokens) - n + 1):
            if tuple(tokens[i : i + n]) in found:
                places |= set(range(i, i + n))
    return tokens, places


def holds(text, found):
    return bool(hit_places(text, found)[1])


def luhn(digits: str) -> bool:
    doubled = [int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))]
    return sum(doubled) % 10 == 0
