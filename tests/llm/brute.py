"""Plain versions of the contracts, for small tables."""

import hashlib
import itertools
import re
from collections import Counter

import xxhash

NONALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANKLESS = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text) -> str:
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def contamination(texts, items, window=13):
    tests = {}
    for i, t in items:
        w = NONALNUM.findall(lower(t))
        if w:
            tests.setdefault(i, []).extend([tuple(w[k : k + window]) for k in range(len(w) - window + 1)] if len(w) >= window else [tuple(w)])
    out = []
    for t in texts:
        w = NONALNUM.findall(lower(t))
        hit, found = set(), set()
        for i, windows in tests.items():
            for x in windows:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit.update(range(k, k + len(x)))
                        found.add(str(i))
        out.append((len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def fingerprint(text):
    w = BLANKLESS.findall(lower(text))
    if not w:
        return 0
    pieces = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    codes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in pieces]
    return sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))


def linked(prints, distance=2):
    """Least position reachable, for a list of fingerprints."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= distance:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(prints))]


def near_copies(texts, similarity=0.8):
    """Least position reachable over all pairs of texts whose five-word sets are similar, and those pairs."""
    sets = []
    for t in texts:
        w = BLANKLESS.findall(lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root, pairs = list(range(len(sets))), []

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            same = len(sets[i] & sets[j])
            if sets[i] == sets[j] or (1 + similarity) * same >= similarity * (len(sets[i]) + len(sets[j])) - 1e-9 > 0:
                pairs.append((j, i))
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))], pairs


def spans(text):
    text = text or ""
    case = lambda w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w)
    words = "|".join(case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile(rf"({words})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def rule_counts(text):
    text = text or ""
    w = BLANKLESS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if BLANKLESS.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
    often, inside = Counter(windows), set()
    for k, x in enumerate(windows):
        if often[x] > 1:
            inside.update(range(k, k + 8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def stripped(texts, length=200):
    raws = [(t or "").encode() for t in texts]
    often = Counter(r[k : k + length] for r in raws for k in range(len(r) - length + 1))
    out = []
    for r in raws:
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if often[r[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((len(r), sum(gone), runs, sha(bytes(x for x, g in zip(r, gone, strict=True) if not g))))
    return out
