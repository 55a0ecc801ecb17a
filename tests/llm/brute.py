"""Plain reference versions of the operators, one text at a time."""

import hashlib
import re
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return WORD.findall(t or "")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def line_dedup(rows):
    keyed = [(d, [(x, ascii_lower(x.strip(" \t\n\x0b\x0c\r"))) for x in (t or "").split("\n")]) for d, t in rows]
    where = {}
    for d, ls in keyed:
        for _, k in ls:
            if len(k) >= 10:
                where.setdefault(k, set()).add(d)
    order = lambda d: (d is not None, d or 0)
    out = []
    for d, ls in keyed:
        kept = [x for x, k in ls if not (len(where.get(k, ())) > 1 and min(where[k], key=order) != d)]
        out.append((d, len(ls), len(ls) - len(kept), sha("\n".join(kept))))
    return out


def suffix_dedup(rows, length):
    seen, out = set(), []
    for d, t in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i:i + length]
            if w in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i, x in enumerate(gone) if x and (not i or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    return out


def simhash(t, n=3):
    w = words(ascii_lower(t))
    if not w:
        return 0
    sh = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] or [" ".join(w)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(n, pairs):
    up = list(range(n))

    def find(a):
        while up[a] != a:
            up[a] = up[up[a]]
            a = up[a]
        return a
    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def contaminated(docs, items, least=0.8):
    out = {}
    for i, text in items:
        w = words(ascii_lower(text))
        if not w:
            continue
        k = min(5, len(w))
        item = Counter(tuple(w[a:a + k]) for a in range(len(w) - k + 1))
        m = len(w) - k + 1
        for d, t in docs:
            v = words(ascii_lower(t))
            g = [tuple(v[a:a + k]) for a in range(len(v) - k + 1)]
            best = None
            for s in range(len(g)):
                window = Counter(g[s:s + m])
                common = sum(min(n, item[x]) for x, n in window.items())
                j = common / (m + len(g[s:s + m]) - common)
                if j >= least and (best is None or j > best[0]):
                    best = (j, s)
            if best:
                out[(d, i)] = (round(best[0], 9), best[1])
    return out
