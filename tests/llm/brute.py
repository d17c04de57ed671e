"""Plain versions of the operators, to hold the jobs against."""

from __future__ import annotations

import collections
import hashlib
import math
import re

import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def contamination(docs: list[tuple], items: list[tuple], window: int = 13) -> dict:
    grams: dict[tuple, set] = collections.defaultdict(set)
    for item, text in items:
        words = WORD.findall((text or "").translate(LOWER))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            grams[tuple(words[i : i + size])].add("null" if item is None else str(item))
    sizes = {len(g) for g in grams}
    out = {}
    for key, text in docs:
        words = WORD.findall((text or "").translate(LOWER))
        hit, found = [False] * len(words), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if own := grams.get(tuple(words[i : i + size])):
                    hit[i : i + size] = [True] * size
                    found |= own
        n = sum(hit)
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[key] = (len(words), n, len(found), digest, n > 0 and 20 * n >= len(words))
    return out


def fingerprint(text: str | None) -> int:
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(docs: list[tuple]) -> list[tuple]:
    """(doc_id, fingerprint, component_id) of every row."""
    prints = [fingerprint(t) for _, t in docs]
    root = {p: p for p in prints}

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    different = sorted(root)
    for i, a in enumerate(different):
        for b in different[:i]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least: dict = {}
    for (key, _), p in zip(docs, prints):
        if key is not None:
            least[find(p)] = min(key, least.get(find(p), key))
    return [(key, f"{p:016x}", least.get(find(p))) for (key, _), p in zip(docs, prints)]


def repeats(texts: list[bytes], length: int) -> list[tuple]:
    """(bytes, removed, spans, digest) of every text."""
    count = collections.Counter(x[i : i + length] for x in texts for i in range(len(x) - length + 1))
    out = []
    for x in texts:
        mark = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if count[x[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        kept = bytes(b for b, m in zip(x, mark) if not m)
        spans = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        out.append((len(x), sum(mark), spans, hashlib.sha256(kept).hexdigest()))
    return out


def marginal(word: bytes, log: dict[bytes, float]) -> float:
    word = b" " + word
    alpha = [1.0] + [0.0] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            if word[start:end] in log:
                alpha[end] += alpha[start] * math.exp(log[word[start:end]])
    return math.log(alpha[-1])
