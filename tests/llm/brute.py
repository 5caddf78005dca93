"""Plain versions of the operators, for small inputs."""

import collections
import hashlib
import re

LUHN = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingles(text):
    w = words(lower(text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def components(rows):
    """doc_id, size and component of (doc_id, text) rows."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def removed(rows, n=35):
    """n_words, n_removed and digest of each row."""
    every = [words(t) for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + n]) for w in every for i in range(len(w) - n + 1))
    out = []
    for (d, _), w in zip(rows, every):
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


def personal(text):
    """Counts and digest of the base spans."""
    text, spans = text or "", []
    kinds = ("email", "ip", "card", "phone")
    patterns = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")
    for k, p in enumerate(patterns):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m.group())
            if k == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if k == 2 and not (12 <= len(d) <= 19 and sum(LUHN[int(c)] if i % 2 else int(c) for i, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if k == 3 and not 9 <= len(d) <= 15:
                continue
            spans.append((m.start(), k, m.end()))
    shown = ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*(sum(1 for s in spans if s[1] == k) for k in range(4)), hashlib.sha256(shown.encode()).hexdigest()), shown


def phrases(text, base):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    found = [(i, label) for p, label in base for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in found]
    return len(w), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))
