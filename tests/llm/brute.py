"""Plain single-process versions of the operators, for the tests."""

import re
from collections import defaultdict

_LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOW))
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def components(rows, size=3, num=90, den=100):
    """id -> (set size, smallest id reachable), all pairs compared."""
    sets = {d: shingles(t, size) for d, t in rows}
    ids = sorted(sets)
    parent = {d: d for d in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y:
                common = len(x & y)
                if den * common >= num * (len(x) + len(y) - common):
                    lo, hi = sorted((root(a), root(b)))
                    parent[hi] = lo
    return {d: (len(sets[d]), root(d)) for d in ids}


def edit_distance_within(item, text):
    """The least edit distance of ``item`` to any substring of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (c != t))
    return min(row)


def groups(pairs):
    out = defaultdict(list)
    for k, v in pairs:
        out[k].append(v)
    return out
