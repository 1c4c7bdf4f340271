"""Plain versions of the operators, for small tables."""

import hashlib
import itertools
import re

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def raw(text):
    return (text or "").encode("utf-8", "surrogatepass")


def words(text):
    return WORD.findall(raw(text).translate(LOWER))


def roots(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingles(text):
    w = words(text)
    k = min(5, len(w))
    return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()


def similar(docs):
    """{id: (size, component)}"""
    sets = {i: shingles(t) for i, t in docs}
    pairs = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    root = roots(sets, pairs)
    return {i: (len(s), root[i]) for i, s in sets.items()}


def removed(docs, length=100):
    """{id: (bytes, removed, spans, sha256 of the rest)}"""
    seen, out = set(), {}
    for i, t in sorted(docs):
        b = raw(t)
        covered = bytearray(len(b))
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            if s in seen:
                covered[p : p + length] = b"\1" * length
            seen.add(s)
        runs = sum(1 for k, c in enumerate(covered) if c and (k == 0 or not covered[k - 1]))
        out[i] = len(b), sum(covered), runs, hashlib.sha256(bytes(x for x, c in zip(b, covered, strict=True) if not c)).hexdigest()
    return out


def secrets(text):
    t = text or ""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)
