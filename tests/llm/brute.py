"""Plain versions of the operators, one document or pair at a time."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash

WORDS = re.compile("[^\x20\x09-\x0D]+")
BENCH = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return WORDS.findall(text or "")


def base_quality(text):
    text = text or ""
    w = words(text)
    count = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered, seen, dup = set(), set(), 0
    for i in range(len(w) - 4):
        if count[tuple(w[i:i + 5])] > 1:
            covered |= set(range(i, i + 5))
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def repeats(docs, window=50):
    """docs: (id, text) rows; gives (n_words, n_removed, kept words) in their order."""
    first = {}
    for key, text in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        w = words(text)
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i:i + window]), key)
    out = []
    for key, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if key is not None and first[tuple(w[i:i + window])] < key:
                gone[i:i + window] = [True] * window
        out.append((len(w), sum(gone), " ".join(a for a, g in zip(w, gone) if not g)))
    return out


def fingerprint(text):
    w = words(low(text))
    shingles = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles)) if shingles else 0


def groups(prints, distance=4):
    """Smallest place reachable of each fingerprint."""
    a = np.array(prints, np.uint64)
    up = list(range(len(a)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= distance).tolist():
            p, q = top(i), top(j)
            up[max(p, q)] = min(p, q)
    return [top(i) for i in range(len(a))]


def contamination(text, items, window=10):
    """items: (id, text) rows; gives (n_words, hit words, item ids)."""
    patterns = defaultdict(set)
    for item, t in items:
        w = BENCH.findall(low(t))
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if w else ():
            patterns[tuple(w[i:i + n])].add(item)
    w, hit, found = BENCH.findall(low(text)), set(), set()
    for n in {len(p) for p in patterns}:
        for i in range(len(w) - n + 1):
            if tuple(w[i:i + n]) in patterns:
                hit |= set(range(i, i + n))
                found |= patterns[tuple(w[i:i + n])]
    return len(w), len(hit), found


def base_scores(docs):
    """(id, text) rows; gives (held out, n_tokens, n_known, N, base score)."""
    held = [key is not None and zlib.crc32(str(key).encode()) % 5 == 1 for key, _ in docs]
    tokens = [[*words(low(text)), None] for _, text in docs]
    c = Counter(t for h, ts in zip(held, tokens) if not h for t in ts)
    n, v = sum(c.values()), len(c)
    return [(h, len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts)) for h, ts in zip(held, tokens)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()
