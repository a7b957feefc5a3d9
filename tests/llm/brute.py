"""Plain reference implementations, one document or pair at a time."""

from __future__ import annotations

import re

WORD = re.compile("[^\x20\x09-\x0d]+")


def ascii_lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingles(text: str | None, k: int) -> set:
    found = WORD.findall(ascii_lower(text or ""))
    if not found:
        return set()
    return {tuple(found[i : i + k]) for i in range(max(1, len(found) - k + 1))}


def groups(nodes, links) -> dict:
    """Smallest node of each node's component."""
    parent = {x: x for x in nodes}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {x: root(x) for x in nodes}


def jaccard(rows, k: int, num: int, den: int) -> dict:
    """id -> (set size, component) for (id, text) rows."""
    sets = {i: shingles(t, k) for i, t in rows}
    ids = sorted(sets)
    posting: dict = {}
    for i in ids:
        for s in sets[i]:
            posting.setdefault(s, []).append(i)
    links = []
    for i in ids:
        shared: dict = {}
        for s in sets[i]:
            for j in posting[s]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        links += [(i, j) for j, n in shared.items() if den * n >= num * (len(sets[i]) + len(sets[j]) - n)]
    at = groups(ids, links)
    return {i: (len(sets[i]), at[i]) for i in ids}
