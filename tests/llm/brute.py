"""Plain versions of the operators' contracts."""

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))


def jaccard_components(rows, k=4, percent=85):
    sets = {}
    for i, t in rows:
        w = words(lowered(t))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            common = len(x & y)
            if x and y and 100 * common >= percent * (len(x) + len(y) - common):
                u, v = find(a), find(b)
                root[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), find(i)) for i in sets}


def substring_dedup(rows, length):
    first = {}
    docs = [(i, words(t)) for i, t in rows]
    for i, w in docs:
        if i is not None:
            for j in range(len(w) - length + 1):
                key = tuple(w[j : j + length])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, w in docs:
        gone = set()
        if i is not None:
            for j in range(len(w) - length + 1):
                if first[tuple(w[j : j + length])] < i:
                    gone.update(range(j, j + length))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def contamination(docs, items, shingle=5, percent=80):
    best = {}
    for i, t in docs:
        w = words((t or "").lower())
        for j, b in items:
            v = words((b or "").lower())
            n, k = len(v), min(len(v), shingle)
            if not n:
                continue
            own = [tuple(v[x : x + k]) for x in range(n - k + 1)]
            starts = {max(0, min(pos - at, len(w) - n)) for pos in range(len(w) - k + 1) for at, s in enumerate(own) if tuple(w[pos : pos + k]) == s}
            for start in sorted(starts):
                x = w[start : start + n]
                there = Counter(tuple(x[y : y + k]) for y in range(len(x) - k + 1))
                shared = sum((there & Counter(own)).values())
                union = sum(there.values()) + len(own) - shared
                if 100 * shared >= percent * union and ((i, j) not in best or shared / union > best[i, j][1] / best[i, j][2]):
                    best[i, j] = (start, shared, union)
    return {(i, j, *v) for (i, j), v in best.items()}


def repetition(text):
    w, lines, seen = words(text), 0, set()
    times = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + d for i in range(len(w) - 2) if times[tuple(w[i : i + 3])] > 1 for d in range(3)}
    for line in (text or "").split("\n"):
        if WORD.search(line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(covered)
