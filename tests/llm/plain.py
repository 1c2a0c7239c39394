"""Plain one-document-at-a-time versions of the operators, to compare with."""

from __future__ import annotations

import hashlib
import re

SPACES = r"[^\x20\x09-\x0D]+"
LETTERS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingles(text: str, k: int) -> frozenset:
    words = re.findall(SPACES, lower(text))
    if len(words) < k:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def components(nodes, links) -> dict:
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_duplicates(texts: dict, k: int, numerator: int, denominator: int = 100) -> dict:
    sets = {d: shingles(t, k) for d, t in texts.items()}
    ids = sorted(sets)
    links = [
        (a, b)
        for i, a in enumerate(ids)
        for b in ids[i + 1 :]
        if sets[a] and sets[b] and denominator * len(sets[a] & sets[b]) >= numerator * len(sets[a] | sets[b])
    ]
    return components(ids, links)


def deduplicated_lines(texts: dict, shortest: int = 10) -> dict:
    keys = {d: [(line, lower(line.strip(" \t\n\x0b\x0c\r"))) for line in (t or "").split("\n")] for d, t in texts.items()}
    holders: dict = {}
    for d, lines in keys.items():
        for _, key in lines:
            holders.setdefault(key, set()).add(d)
    return {
        d: "\n".join(x for x, k in lines if len(k) < shortest or len(holders[k]) < 2 or d == min(holders[k]))
        for d, lines in keys.items()
    }


def contamination(texts: dict, items: dict, window: int = 13) -> dict:
    """doc_id -> (words, words hit, items)."""
    windows = {}
    for item, text in items.items():
        words = re.findall(LETTERS, lower(text))
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(item)
    out = {}
    for d, text in texts.items():
        words = re.findall(LETTERS, lower(text))
        hit, found = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                owners = windows.get(tuple(words[i : i + n]))
                if owners:
                    hit.update(range(i, i + n))
                    found |= owners
        out[d] = (len(words), len(hit), found)
    return out


def secrets(text: str) -> list[tuple[int, str, int]]:
    """The base spans as (start, kind, end)."""
    text = text or ""
    found = []
    assign = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), "assign", m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 8]
    found += [(m.start(), "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda s: (s[0], ["assign", "access", "hex"].index(s[1])))


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
