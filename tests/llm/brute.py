"""Plain versions of the operators' contracts, for small inputs."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def shingles(text, size=5):
    w = words((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def near_dup(docs, percent=75):
    """{doc_id: (n_shingles, component)} of (doc_id, text) rows."""
    sets = {d: shingles(t) for d, t in docs}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    having = {}
    for d, s in sets.items():
        for x in s:
            having.setdefault(x, []).append(d)
    tried = set()
    for group in having.values():
        for i, a in enumerate(group):
            for b in group[i + 1 :]:
                if (a, b) in tried:
                    continue
                tried.add((a, b))
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    up[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}
