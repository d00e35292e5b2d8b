"""Plain Python versions of the operators' results."""

import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return WORD.findall(text or "")


def base_counts(text):
    w = words(text)
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = set()
    for i in range(len(w) - 4):
        if grams[tuple(w[i : i + 5])] > 1:
            covered.update(range(i, i + 5))
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def line_dedup(docs, run=3):
    """docs: list of (id, text) with distinct ids -> {id: text}."""
    seen, out = {}, {}
    numbered = {}
    for k, t in docs:
        lines = (t or "").split("\n")
        numbered[k] = (lines, [i for i, x in enumerate(lines) if WORD.search(x)])
    for k in sorted(numbered):
        lines, own = numbered[k]
        gone = set()
        for p in range(len(own) - run + 1):
            key = tuple(lines[i] for i in own[p : p + run])
            if key in seen:
                gone.update(own[p : p + run])
            else:
                seen[key] = (k, p)
        out[k] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def substring_dedup(docs, width=50):
    """{id: (n_words, kept words)}."""
    first, out = {}, {}
    for k, t in sorted(docs):
        w = words(t)
        keep = [True] * len(w)
        here = [tuple(w[i : i + width]) for i in range(len(w) - width + 1)]
        for i, x in enumerate(here):
            if first.get(x, k) < k:
                keep[i : i + width] = [False] * width
        for x in here:
            first.setdefault(x, k)
        out[k] = (len(w), [a for a, b in zip(w, keep) if b])
    return out


def shingles(text, width=5):
    w = words((text or "").translate(LOWER))
    if len(w) >= width:
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    return frozenset([tuple(w)] if w else [])


def components(docs, percent=75):
    """{id: (size, smallest linked id)}."""
    sets = {k: shingles(t) for k, t in docs}
    holders = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            holders[g].append(k)
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, s in sets.items():
        common = Counter(o for g in s for o in holders[g] if o > k)
        for o, n in common.items():
            if 100 * n >= percent * (len(s) + len(sets[o]) - n):
                a, b = sorted((find(k), find(o)))
                parent[b] = a
    return {k: (len(s), find(k)) for k, s in sets.items()}
