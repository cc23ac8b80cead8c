"""Plain single-machine versions of the operators, for small tables."""

from __future__ import annotations

import re

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def lower(text: str) -> str:
    return text.translate(_LOWER)


def shingles(text: str | None) -> frozenset:
    words = BLANK.findall(lower(text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def find(parent: dict, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def near_groups(docs: list[tuple[int, str | None]], percent: int = 75) -> dict[int, tuple[int, int]]:
    """doc_id: (n_shingles, component_id), from all pairs."""
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}
    ids = sorted(sets)
    where: dict = {}
    for i in ids:
        near: dict = {}
        for s in sets[i]:
            for j in where.get(s, ()):
                near[j] = near.get(j, 0) + 1
            where.setdefault(s, []).append(i)
        for j, n in near.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(parent, i), find(parent, j)))
                parent[b] = a
    return {i: (len(sets[i]), find(parent, i)) for i in ids}


def line_tokens(line: str) -> frozenset:
    """Five words in a row, or the whole line if it has fewer."""
    words = BLANK.findall(lower(line))
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4)))


def later_lines(docs: list[tuple[int, str | None]], percent: int = 75) -> dict[tuple[int, int], tuple[int, int]]:
    """(doc_id, line): the first earlier line with equal words or similar tokens."""
    lines = []
    for i, text in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        for n, line in enumerate((text or "").split("\n")):
            words = tuple(BLANK.findall(lower(line)))
            if words:
                lines.append(((i, n), words, line_tokens(line)))
    seen: dict = {}
    where: dict = {}
    out = {}
    for at, words, tokens in lines:
        best = seen.get(words)
        near: dict = {}
        for t in tokens:
            for other, size in where.get(t, ()):
                near[other, size] = near.get((other, size), 0) + 1
        for (other, size), n in near.items():
            if 100 * n >= percent * (size + len(tokens) - n) and (best is None or other < best):
                best = other
        if best is not None:
            out[at] = best
        if words not in seen:
            seen[words] = at
            for t in tokens:
                where.setdefault(t, []).append((at, len(tokens)))
    return out


_LICENSE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def license_base(text: str | None) -> tuple[int, int, int | None, int | None, str]:
    words = _LICENSE_WORD.findall(lower(text or ""))
    starts, labels = [], set()
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        parts = phrase.split()
        for i in range(len(words) - len(parts) + 1):
            if words[i:i + len(parts)] == parts:
                starts.append(i)
                labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))
