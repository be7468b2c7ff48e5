"""Plain definitions of the operators' results, for small inputs."""

from __future__ import annotations

import hashlib
import re

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def word_dedup(rows: list[tuple[int | None, str | None]], window: int) -> list[tuple]:
    """``(id, n_words, n_removed, kept)`` by definition."""
    first: dict[tuple, float] = {}
    split = [(float("inf") if i is None else i, i, PLAIN.findall(t or "")) for i, t in rows]
    for order, _, words in split:
        for at in range(len(words) - window + 1):
            key = tuple(words[at:at + window])
            first[key] = min(order, first.get(key, order))
    out = []
    for order, i, words in split:
        gone = set()
        for at in range(len(words) - window + 1):
            if first[tuple(words[at:at + window])] < order:
                gone.update(range(at, at + window))
        out.append((i, len(words), len(gone), " ".join(w for n, w in enumerate(words) if n not in gone)))
    return out


def byte_dedup(rows: list[tuple[int | None, str | None]], window: int) -> list[tuple]:
    """``(id, n_bytes, n_removed, n_spans, kept)`` by definition."""
    count: dict[bytes, int] = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, text in texts:
        for at in range(len(text) - window + 1):
            count[text[at:at + window]] = count.get(text[at:at + window], 0) + 1
    out = []
    for i, text in texts:
        gone = [False] * len(text)
        for at in range(len(text) - window + 1):
            if count[text[at:at + window]] > 1:
                gone[at:at + window] = [True] * window
        spans = sum(g and not (n and gone[n - 1]) for n, g in enumerate(gone))
        out.append((i, len(text), sum(gone), spans, bytes(b for b, g in zip(text, gone) if not g)))
    return out


def shingles(text: str | None, n: int = 5) -> frozenset:
    words = PLAIN.findall(lower(text or ""))
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k:k + n]) for k in range(len(words) - n + 1))


def components(links: list[tuple[int, int]], nodes: int) -> list[int]:
    """The smallest node of each node's component."""
    root = list(range(nodes))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(x) for x in range(nodes)]
