"""Plain versions of the operators, for small fixtures."""

import collections
import hashlib
import re

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = str.maketrans(UP, LOW)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def near(rows, k=4, pct=85):
    """doc_id -> (set size, smallest linked id)."""
    sets = {}
    for d, x in rows:
        w = words((x or "").translate(FOLD))
        sets[d] = frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    up = {d: d for d in sets}

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b]):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {d: (len(sets[d]), find(d)) for d in sets}


def kept_words(rows, n=13):
    """doc_id -> (words, kept words)."""
    w = {d: words(x) for d, x in rows}
    first = {}
    for d in sorted(w):
        for i in range(len(w[d]) - n + 1):
            first.setdefault(tuple(w[d][i : i + n]), d)
    out = {}
    for d, x in w.items():
        gone = [False] * len(x)
        for i in range(len(x) - n + 1):
            if first[tuple(x[i : i + n])] < d:
                gone[i : i + n] = [True] * n
        out[d] = (x, [a for a, g in zip(x, gone, strict=True) if not g])
    return out


def sha(words_):
    return hashlib.sha256(" ".join(words_).encode()).hexdigest()


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def contained(docs, items, k=5):
    """{(doc, item)} with at least 0.8 of the item's shingles in the document."""
    def grams(w, n):
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}

    out = {}
    for i, x in items:
        w = license_words(x)
        if not w:
            continue
        n = min(k, len(w))
        own = grams(w, n)
        for d, y in docs:
            shared = len(own & grams(license_words(y), n))
            if 5 * shared >= 4 * len(own):
                out[d, i] = (len(own), shared)
    return out


def token_counts(texts):
    c = collections.Counter()
    for t in texts:
        c.update(words((t or "").translate(FOLD)))
        c[None] += 1
    return c
