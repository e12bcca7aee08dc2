"""Plain single-process versions that the tests hold the operators against."""

import re

ASCII_LOWER = {k: k + 32 for k in range(65, 91)}


def shingles(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(ASCII_LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def components(nodes, links):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def near_duplicates(rows, width, num, den):
    """{doc_id: (size, component)} of (doc_id, text) rows with distinct ids."""
    sets = {i: shingles(t, width) for i, t in rows}
    ids = sorted(i for i in sets if sets[i])
    by = {}
    for i in ids:
        for s in sets[i]:
            by.setdefault(s, []).append(i)
    links = set()
    for i in ids:
        near = {j for s in sets[i] for j in by[s] if j > i}
        for j in near:
            x = len(sets[i] & sets[j])
            if den * x >= num * (len(sets[i]) + len(sets[j]) - x):
                links.add((i, j))
    comp = components(ids, links)
    return {i: (len(sets[i]), comp.get(i, i)) for i, _ in rows}
