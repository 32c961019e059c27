"""Plain versions of the operators, for small inputs."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def roots(nodes, links):
    """Smallest reachable node of every node."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for node in sorted(nodes):
        if node in out:
            continue
        waiting = [node]
        while waiting:
            x = waiting.pop()
            if x not in out:
                out[x] = node
                waiting += near[x]
    return out


def shingles(text, n=5):
    w = words(ascii_lower(text))
    if not w:
        return set()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}


def components(texts, percent=80):
    """(n_shingles, component id) by id for texts by id."""
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    found = roots(sets, links)
    return {i: (len(s), found[i]) for i, s in sets.items()}
