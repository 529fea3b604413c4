"""Plain-Python versions of the corpus operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def components(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


def op1(docs, shingle=3):
    import xxhash

    fp = {}
    for i, text in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(_LOWER))
        parts = [b" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in parts]
        fp[i] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = components(fp, ((a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 2))
    return {(i, f"{fp[i]:016x}", root[i]) for i in fp}


def op2(docs, items, size=10):
    cut = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(_LOWER))
    owners = defaultdict(set)
    for item, text in items:
        words = cut(text)
        for k in range(len(words) - min(size, len(words)) + 1 if words else 0):
            owners[tuple(words[k : k + size])].add(item)
    out = set()
    for i, text in docs:
        words, hit, found = cut(text), set(), set()
        for n in {len(w) for w in owners}:
            for k in range(len(words) - n + 1):
                if (w := tuple(words[k : k + n])) in owners:
                    hit.update(range(k, k + n))
                    found |= owners[w]
        out.add((i, len(words), len(hit), len(found), sha(",".join(sorted(map(str, found)))), bool(hit)))
    return out


def op8(docs, length=20, least=3):
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: line.strip(blank).encode().translate(_LOWER).decode()
    held = defaultdict(set)
    for i, text in docs:
        for line in (text or "").split("\n"):
            held[key(line)].add(i)
    out = set()
    for i, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= length and len(held[key(x)]) >= least and max(held[key(x)]) != i)]
        out.add((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    return out


def op10(docs, size=35):
    cut = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t or "")
    seen = Counter(tuple(w[k : k + size]) for _, t in docs for w in [cut(t)] for k in range(len(w) - size + 1))
    out = []
    for i, text in docs:
        words = cut(text)
        gone = {j for k in range(len(words) - size + 1) if seen[tuple(words[k : k + size])] > 1 for j in range(k, k + size)}
        out.append((i, len(words), len(gone), sha(" ".join(w for j, w in enumerate(words) if j not in gone))))
    return out


def op6(vectors, threshold=0.93):
    import numpy as np

    unit = {}
    for i, v, label in vectors:
        x = np.array([np.nan if c is None else c for c in v or ()], float)
        if label is not None and x.size and np.isfinite(x).all() and x.any():
            unit[i] = (label, x.size, x / np.linalg.norm(x))
    linked = [(a, b) for a in unit for b in unit if a < b and unit[a][:2] == unit[b][:2] and unit[a][2] @ unit[b][2] >= threshold]
    root = components([i for i, _, _ in vectors], linked)
    n = Counter(x for pair in linked for x in pair)
    return {(i, n[i], root[i], root[i] == i) for i, _, _ in vectors}


def _luhn(number):
    each = [int(c) for c in reversed(number)]
    return (sum(each[::2]) + sum(d * 2 - 9 * (d > 4) for d in each[1::2])) % 10 == 0


def op3(docs):
    """Base spans only: (doc_id, counts, digest, base spans)."""
    count = lambda s: sum(c in "0123456789" for c in s)
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= count(s) <= 19 and _luhn(re.sub("[^0-9]", "", s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= count(s) <= 15),
    }
    out = {}
    for i, text in docs:
        found = [(k, m.start(), m.end()) for k, (pattern, ok) in rules.items() for m in re.finditer(pattern, text or "") if ok(m[0])]
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in found)
        n = Counter(k for k, _, _ in found)
        out[i] = (n["email"], n["ip"], n["card"], n["phone"], sha(base), base)
    return out


def op4(docs):
    rules = (
        ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    )
    out = {}
    for i, text in docs:
        found = sorted((m.start(), r, k, m.end()) for r, (k, pattern, ok) in enumerate(rules) for m in re.finditer(pattern, text or "", re.ASCII) if ok(m))
        base = ",".join(f"{k}:{a}:{b}" for a, _, k, b in found)
        n = Counter(k for _, _, k, _ in found)
        out[i] = (n["assign"], n["access"], n["hex"], sha(base), base)
    return out


def near_copies(docs, shingle=5, similarity=0.8):
    """Smallest doc_id of each document's group."""
    sets = {}
    for i, text in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(_LOWER))
        sets[i] = {tuple(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))} if words else set()
    alike = lambda a, b: a == b or bool(a and b) and len(a & b) >= similarity * len(a | b) - 1e-9
    return components(sets, ((a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])))
