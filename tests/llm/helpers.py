"""Plain Python versions of what the operators do."""

from __future__ import annotations

import collections
import re

FOLDER = "/root/testdata/sf0.001"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(_LOWER))
    if len(found) >= words:
        return frozenset(tuple(found[k : k + words]) for k in range(len(found) - words + 1))
    return frozenset([tuple(found)] if found else [])


def components(rows, words, percent):
    """Of each id the size of its set and the least id it is linked with, by comparing all that share a shingle."""
    sets = {i: shingles(x, words) for i, x in rows}
    holders = collections.defaultdict(list)
    for i in sorted(sets):
        for s in sets[i]:
            holders[s].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sorted(sets):
        shared = collections.Counter(j for s in sets[i] for j in holders[s] if j < i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def documents(spark, *rows):
    """Rows of doc_id and text in a table with further columns whose names operators use themselves."""
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, score string, bin string, n int")
