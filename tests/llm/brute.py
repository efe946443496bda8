"""Plain Python statements of what the operators compute."""

import hashlib
import re

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def closure(nodes, links):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, k):
    w = tokens((text or "").translate(UPPER))
    if len(w) < k:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def near(docs, k, percent):
    sets = {d: shingles(t, k) for d, t in docs}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:] if sets[a] and sets[b]
             and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    found = closure(ids, links)
    return {d: (len(sets[d]), found[d], found[d] == d) for d in ids}


def passages(docs, window):
    first, out = {}, {}
    for d, text in sorted(docs):
        w = tokens(text)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            if first.setdefault(key, d) < d:
                gone[i:i + window] = [True] * window
        out[d] = (len(w), sum(gone), sha(" ".join(t for t, g in zip(w, gone) if not g)))
    return out


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def lines(docs, least):
    seen, out = [], {}
    for d, text in sorted(docs):
        own = (text or "").split("\n")
        kept = []
        for line in own:
            if not tokens(line):
                kept.append(line)
                continue
            gone = any(line == x or (min(len(line), len(x)) >= least and abs(len(line) - len(x)) <= 1 and edits(line, x) <= 1)
                       for x in seen)
            seen.append(line)
            if not gone:
                kept.append(line)
        out[d] = (len(own), len(own) - len(kept), "\n".join(kept))
    return out
