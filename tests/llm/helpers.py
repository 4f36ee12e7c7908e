"""Brute-force twins of the operators, written without their code."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import defaultdict

SPACE = re.compile(rb"[^\x20\x09-\x0D]+")
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(text, width):
    words = SPACE.findall((text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def components(sets, num=8, den=10):
    """Least key of each key's component, links being set similarities of num / den."""
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and den * len(x & y) >= num * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {k: find(k) for k in sets}


def lines(rows, min_chars, width):
    """{(doc_id, line_no): set of character shingles} of lines that are compared."""
    out = {}
    for doc_id, text in rows:
        for i, line in enumerate((text or "").split("\n") if text is not None else []):
            t = line.replace("\t", " ").replace("\r", " ").strip(" ").lower()
            if len(t) >= min_chars:
                out[doc_id, i] = frozenset(t[j : j + width] for j in range(max(1, len(t) - width + 1)))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        n = int(c) * (2 if i % 2 else 1)
        total += n // 10 + n % 10
    return total % 10 == 0


RULES = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s, d: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s, d: all(int(p) <= 255 for p in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s, d: 14 <= len(d) <= 19 and luhn(d)),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s, d: 10 <= len(d) <= 15),
]


def personal(text):
    """Base spans as the query lists them."""
    found = []
    for k, (kind, pattern, passes) in enumerate(RULES):
        for m in re.finditer(pattern, text or ""):
            if passes(m[0], re.sub("[^0-9]", "", m[0])):
                found.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found))


def contamination(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        words = WORD.findall((text or "").encode().lower())
        for i in range(max(1, len(words) - size + 1)) if words else []:
            windows[tuple(words[i : i + size])].add(item)
    lengths = {len(w) for w in windows}
    out = {}
    for doc_id, text in docs:
        words = WORD.findall((text or "").encode().lower())
        hit, named = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                owners = windows.get(tuple(words[i : i + n]))
                if owners:
                    hit.update(range(i, i + n))
                    named |= {str(x) for x in owners if x is not None}
        out[doc_id] = (len(words), len(hit), sorted(named))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
