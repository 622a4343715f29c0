"""Plain Python versions of the operators, for small tables."""

import hashlib
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def substring_dedup(rows, window=50):
    seen = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        if i is not None:
            for a in range(len(w) - window + 1):
                k = tuple(w[a : a + window])
                seen[k] = min(seen.get(k, i), i)
    out = []
    for i, w in split:
        keep = [True] * len(w)
        for a in range(len(w) - window + 1):
            if i is not None and seen[tuple(w[a : a + window])] < i:
                keep[a : a + window] = [False] * window
        kept = " ".join(x for x, k in zip(w, keep) if k)
        out.append((i, len(w), len(w) - sum(keep), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def fingerprint(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    bits = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for k in range(64):
            bits[k] += h >> k & 1
    return sum(1 << k for k in range(64) if bits[k] * 2 > len(shingles))


def simhash_groups(rows, distance=4):
    fp = [fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (fp[a] ^ fp[b]).bit_count() <= distance:
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, f"{fp[k]:016x}", least.get(find(k))) for k, (i, _) in enumerate(rows)]
