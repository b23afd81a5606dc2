"""Plain versions of what the operators compute, for small inputs."""

import re
from collections import defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text, k):
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def classes(nodes, links):
    """Smallest reachable node of each node."""
    low = {n: n for n in nodes}

    def find(n):
        while low[n] != n:
            low[n] = low[low[n]]
            n = low[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        low[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_links(sets, percent):
    """All pairs of ids whose sets are similar; every pair that shares a shingle is looked at."""
    where = defaultdict(list)
    by_set = defaultdict(list)
    for i, s in sets.items():
        by_set[s].append(i)
    links = {(min(x), i) for s, x in by_set.items() if s for i in x if i != min(x)}
    distinct = {min(x): s for s, x in by_set.items() if s}
    for i, s in distinct.items():
        for x in s:
            where[x].append(i)
    common = defaultdict(int)
    for x in where.values():
        for i, a in enumerate(x):
            for b in x[i + 1 :]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(distinct[a]) + len(distinct[b]) - n):
            links.add((a, b))
    return links
