"""Plain Python versions of what the operators must return."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from fractions import Fraction

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text: str | None, k: int) -> frozenset:
    w = WORD.findall((text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def components(docs: list[tuple[int, str | None]], k: int, threshold: float) -> dict[int, int]:
    ratio = Fraction(threshold).limit_denominator(1000)
    sets = [(i, shingles(t, k)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[n + 1 :]:
            if a and b and len(a & b) >= ratio * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i, _ in docs}


def contamination(docs: list, items: list, window: int = 10) -> dict:
    windows = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(FOLD))
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[p : p + n])].add(str(item))
    sizes = sorted({len(g) for g in windows})
    out = {}
    for i, text in docs:
        w = ALNUM.findall((text or "").translate(FOLD))
        hit, found = set(), set()
        for p in range(len(w)):
            for n in sizes:
                if (g := tuple(w[p : p + n])) in windows and len(g) == n:
                    hit.update(range(p, p + n))
                    found |= windows[g]
        out[i] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit))
    return out


def kept_words(docs: list, window: int) -> dict:
    words = {i: WORD.findall(t or "") for i, t in docs}
    count = Counter(tuple(w[p : p + window]) for w in words.values() for p in range(len(w) - window + 1))
    out = {}
    for i, w in words.items():
        gone = {q for p in range(len(w) - window + 1) if count[tuple(w[p : p + window])] > 1 for q in range(p, p + window)}
        out[i] = (len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone))
    return out


BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def secrets(text: str | None) -> list[tuple[int, int, str, int]]:
    return sorted((m.start(), rank, kind, m.end()) for rank, (kind, p, group, least) in enumerate(BASE) for m in p.finditer(text or "") if len(m.group(group)) >= least)
