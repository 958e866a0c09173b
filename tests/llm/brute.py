"""Plain versions of the operators, straight from their definitions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WS = " \t\n\x0b\x0c\r"
GAP = re.compile(r"[\x20\x09-\x0D]+")
INF = 2**63 - 1


def words(text):
    return [w for w in GAP.split(text or "") if w]


def sha(text):
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def line_dedup(docs):
    own = defaultdict(set)
    key = lambda line: lower(line.strip(WS))
    at = lambda i: INF if i is None else i
    for i, t in docs:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                own[key(line)].add(at(i))
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 10 and len(own[key(x)]) > 1 and min(own[key(x)]) != at(i))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def substring_dedup(docs, k):
    split = [words(t) for _, t in docs]
    seen = Counter(tuple(w[i : i + k]) for w in split for i in range(len(w) - k + 1))
    out = []
    for (i, _), w in zip(docs, split, strict=True):
        gone = {q for p in range(len(w) - k + 1) if seen[tuple(w[p : p + k])] > 1 for q in range(p, p + k)}
        out.append((i, len(w), len(gone), " ".join(x for q, x in enumerate(w) if q not in gone)))
    return out


def measures(text):
    w = words(text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    repeat = {q for p in range(len(w) - 2) if seen[tuple(w[p : p + 3])] > 1 for q in range(p, p + 3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeat)


def secrets(text):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(k, a, b) for a, _, k, b in sorted(found)]


def fingerprint(text, size=4):
    w = words(lower(text or ""))
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + size]).encode(), 42) for i in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_duplicates(docs, tau=4):
    prints = [fingerprint(t) for _, t in docs]
    lead = list(range(len(docs)))

    def find(a):
        while lead[a] != a:
            a = lead[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= tau:
                lead[find(a)] = find(b)
    least = {}
    for n, (i, _) in enumerate(docs):
        least[find(n)] = min(least.get(find(n), INF), INF if i is None else i)
    given = lambda v: None if v == INF else v
    return [(i, format(prints[n], "016x"), given(least[find(n)])) for n, (i, _) in enumerate(docs)]


def payload(text):
    data = (text or "").encode()
    return data + b"\xff" * (576 if not data else -len(data) % 576)


def crc(data):
    return zlib.crc32(data)
