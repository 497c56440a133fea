"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return SPACE.findall(lower(text))


def shingles(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def near(docs, k, num, den):
    """id -> (number of shingles, smallest id reachable)."""
    sets = {d: shingles(t, k) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for d in sorted(sets):
        shared = Counter(o for s in sets[d] for o in where.get(s, ()))
        for o, both in shared.items():
            if den * both >= num * (len(sets[d]) + len(sets[o]) - both):
                a, b = root(d), root(o)
                parent[max(a, b)] = min(a, b)
        for s in sets[d]:
            where.setdefault(s, []).append(d)
    return {d: (len(sets[d]), root(d)) for d in sets}


def repeats(docs, length):
    """id -> (bytes, removed, runs, digest of what is left)."""
    seen, out = set(), {}
    for d, text in sorted(docs, key=lambda x: x[0]):
        b = (text or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def segments(scores):
    """First, last and sum of the best run, then of the best left and right of it, and so on."""
    out, todo = [], [(0, len(scores))]
    while todo:
        a, b = todo.pop()
        best, run, start = (0.0, a, a), 0.0, a
        for i in range(a, b):
            if run <= 0:
                run, start = 0.0, i
            run += scores[i]
            if run > best[0]:
                best = (run, start, i + 1)
        if best[0] > 0:
            out.append((best[1], best[2] - 1, best[0]))
            todo += [(a, best[1]), (best[2], b)]
    return out


def trigrams(text, places):
    """Place -> count of the letter trigrams, words parted by one blank; bytes from 128 on are letters."""
    low = [b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in text.encode()]
    out, cap = Counter(), (1 << 32) - 1
    for a, b, c in zip(low, low[1:], low[2:]):
        if (a, b) == (32, 32) or (b, c) == (32, 32):
            continue
        code = (a * 0x9E3779B1 ^ b * 0x85EBCA77 * 0x2545F491 ^ c * 0xC2B2AE3D * 0x6C8E9CF5) & cap
        code = (code ^ code >> 15) * 0x846CA68B & cap
        out[(code >> 8) % places] += 1
    return out
