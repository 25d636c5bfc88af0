"""Plain Python versions of the corpus operators, for small tables."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text, size=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i: i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def jaccard_components(docs):
    """{key: (set size, component)} for (key, text) pairs."""
    sets = {k: shingles(t) for k, t in docs}
    up = {k: k for k in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and both:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in keys}


def remove_repeats(docs, length=400):
    """{key: (bytes, removed, spans, digest)} for (key, text) pairs."""
    raw = [(k, (t or "").encode()) for k, t in docs]
    times = collections.Counter(b[i: i + length] for _, b in raw for i in range(len(b) - length + 1))
    out = {}
    for k, b in raw:
        gone = set()
        for i in range(len(b) - length + 1):
            if times[b[i: i + length]] > 1:
                gone.update(range(i, i + length))
        spans = sum(1 for i in gone if i - 1 not in gone)
        rest = bytes(x for i, x in enumerate(b) if i not in gone)
        out[k] = (len(b), len(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


KEYWORD = "(?:%s)" % "|".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c + "?" for c in w)
                              for w in ("password", "passwd", "secret", "token", "api_key"))
ASSIGN = re.compile(KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def contaminated(docs, items, least=0.8):
    """{(doc, item): similarity} over all item-sized windows of five-word shingles."""
    tok = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    bag = lambda w: collections.Counter(tuple(w[i: i + 5]) for i in range(len(w) - 4))
    out = {}
    for d, t in docs:
        w = tok(t)
        for i, x in items:
            v = tok(x)
            if len(v) < 5:
                if v and any(w[p: p + len(v)] == v for p in range(len(w))):
                    out[d, i] = 1.0
                continue
            if len(w) < 5:
                continue
            b, best = bag(v), 0.0
            for p in range(max(1, len(w) - len(v) + 1)):
                c = bag(w[p: p + len(v)])
                both = sum((b & c).values())
                best = max(best, both / (sum(b.values()) + sum(c.values()) - both))
            if best >= least:
                out[d, i] = best
    return out


def shards(rows, limit):
    """{key: prefix} for (key, 60-bit hash, bytes): the shortest prefix that fits or holds one hash."""
    out = {}
    for k, h, _ in rows:
        for depth in range(61):
            own = [(x, b) for _, x, b in rows if x >> (60 - depth) == h >> (60 - depth)]
            if sum(b for _, b in own) <= limit or len({x for x, _ in own}) == 1:
                out[k] = format(h >> (60 - depth), f"0{depth}b") if depth else ""
                break
    return out
