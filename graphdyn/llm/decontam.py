"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact check.

A text's words are runs of letters and digits, lower-cased. An item of n words
is compared with every window of n words (the whole text if shorter). A window's
64-bit SimHash adds its five-word shingles, each as often as it occurs. Items
are indexed by the 8 bytes of their fingerprints, each byte with all its
neighbours in up to two bits: two fingerprints within ``RADIUS`` = 23 bits
differ in at most two bits in one of 8 bytes, so the index returns all of them.
(At similarity 0.8 the mean distance is 10 with a deviation of 3.) What it
returns is verified by the exact weighted Jaccard similarity of the shingle
multisets, sum of minima over sum of maxima, at least ``SIMILARITY``.

Windows without any shingle of an item of their size have similarity 0 and are
not fingerprinted. Items travel in blocks of about ``BLOCK_BYTES`` of text,
so that the driver holds one block's texts at a time; the documents are scanned
once for all blocks and never shuffled.

An item of fewer than five words is one shingle of its own length and is looked
up in all windows of so many words. Very long texts are searched whole.

Edge cases: null or empty texts and items match nothing, nor do empty tables;
equal items each match; of equally similar windows the first is reported;
repeated documents each get their matches; other columns pass through, and one
named like the result moves the result to a fresh name.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphdyn.llm.common import Sent, bound_batches, fresh, n_bytes
from graphdyn.llm.words import PUNCT, chunks, shingles, words

SIZE = 5
SIMILARITY = 0.8
RADIUS = 23
BLOCK_BYTES = 8 << 20
_U = np.uint64
_BYTE_BITS = np.array([bin(i).count("1") for i in range(256)], np.uint8)
_NEAR = _BYTE_BITS[np.arange(256)[:, None] ^ np.arange(256)[None, :]] <= RADIUS // 8


def _lower(texts) -> list[bytes]:
    return [b"" if t is None or t != t else t.lower().encode("utf-8", "surrogatepass") for t in texts]


def simhash(h: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints (bytes) of the windows of ``n`` shingles in ``h``."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32) * 2 - 1
    run = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=run[1:])
    return np.packbits(run[n:] - run[:-n] > 0, axis=1)


def similarity(a: Counter, b: Counter) -> float:
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both)


class Index:
    """Benchmark items by size, with their fingerprints' byte neighbourhoods."""

    def __init__(self, keys: list, texts: list):
        self.keys = keys
        raw = _lower(texts)
        w, first = words(raw, PUNCT) if raw else (np.empty(0, _U), np.zeros(1, int))
        self.bags = {}
        short: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        by_size, found = defaultdict(list), []
        for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
            if b - a >= SIZE:
                h = shingles(w[a:b], SIZE)
                self.bags[i] = Counter(h.tolist())
                by_size[len(h)].append((i, simhash(h, len(h))[0]))
                found += [(x, len(h)) for x in self.bags[i]]
            elif b > a:
                short[b - a][int(shingles(w[a:b], b - a)[0])].append(i)
        #: Words of an item: (hashes in order, items per hash).
        self.short = {n: (np.array(sorted(own), _U), [own[x] for x in sorted(own)]) for n, own in short.items()}
        self.prints = {n: (np.array([i for i, _ in rows]), np.array([p for _, p in rows]))
                       for n, rows in by_size.items()}
        # near[n][k, v]: the items of size n whose byte k is within two bits of v
        self.near = {n: _NEAR[p.T].transpose(0, 2, 1) for n, (_, p) in self.prints.items()}
        pairs = sorted(set(found))
        self.shingle = np.array([x for x, _ in pairs], _U)
        self.size = np.array([n for _, n in pairs], np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.shingle >> _U(44)] = True

    def _hits(self, h: np.ndarray) -> np.ndarray:
        """Positions in ``h`` that hold a shingle of some item."""
        at = np.flatnonzero(self.maybe[h >> _U(44)])
        if not len(at) or not len(self.shingle):
            return at[:0]
        place = np.minimum(np.searchsorted(self.shingle, h[at]), len(self.shingle) - 1)
        return at[self.shingle[place] == h[at]]

    def _windows(self, h: np.ndarray, hits: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
        """(item, window start) within the radius, for windows of size n around hits."""
        n_doc = min(n, len(h))
        starts = np.unique((hits[:, None] - np.arange(n_doc)[None, :]).ravel())
        starts = starts[(starts >= 0) & (starts + n_doc <= len(h))]
        items, prints = self.prints[n]
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > n_doc) + 1):
            part = simhash(h[run[0]: run[-1] + n_doc], n_doc)[run - run[0]]
            found = np.zeros((len(run), len(items)), bool)
            for k in range(8):
                found |= self.near[n][k][part[:, k]]
            row, col = np.nonzero(found)
            far = _BYTE_BITS[part[row] ^ prints[col]].sum(1)
            ok = far <= RADIUS
            yield from zip(items[col[ok]].tolist(), run[row[ok]].tolist())

    def _short(self, w: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(words, places, hash numbers) of windows that are a short item."""
        out = []
        for n, (hashes, _) in self.short.items():
            h = shingles(w, n)
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            at = np.flatnonzero(hashes[place] == h)
            out.append((n, at, place[at]))
        return out

    def short_matches(self, found, i: int, j: int) -> list[tuple[int, float, int, int]]:
        """The short items in words i to j - 1, each at its first place."""
        out: dict[int, tuple[int, float, int, int]] = {}
        for n, at, which in found:
            for k in range(np.searchsorted(at, i), np.searchsorted(at, j - n + 1)):
                for item in self.short[n][1][which[k]]:
                    out.setdefault(item, (item, 1.0, int(at[k]) - i, n))
        return list(out.values())

    def match(self, h: np.ndarray, hits: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first word, words) of each item's best window in one text."""
        if not len(hits):
            return []
        lo = np.searchsorted(self.shingle, h[hits], "left")
        hi = np.searchsorted(self.shingle, h[hits], "right")
        at = np.repeat(hits, hi - lo)
        size = np.concatenate([self.size[a:b] for a, b in zip(lo, hi)])
        best: dict[int, tuple[float, int]] = {}
        for n in np.unique(size).tolist():
            n_doc = min(n, len(h))
            for item, start in self._windows(h, np.unique(at[size == n]), n):
                s = similarity(self.bags[item], Counter(h[start: start + n_doc].tolist()))
                if s >= SIMILARITY and (s, -start) > best.get(item, (0.0, 0)):
                    best[item] = (s, -start)
        return [(i, s, -start, min(self.bags[i].total(), len(h)) + SIZE - 1)
                for i, (s, start) in sorted(best.items())]

    def search(self, texts) -> Iterator[list[tuple[int, float, int, int]]]:
        raw = _lower(texts)
        for a, b in chunks(raw):
            w, first = words(raw[a:b], PUNCT)
            h = shingles(w, SIZE)
            hits, found = self._hits(h), self._short(w)
            for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
                end = max(i, j - SIZE + 1)
                own = hits[np.searchsorted(hits, i): np.searchsorted(hits, end)] - i
                yield sorted(self.match(h[i:end], own) + self.short_matches(found, i, j))


def _blocks(items: DataFrame, text: str, key: str) -> Iterator[Index]:
    """One index per block of items; only one block's texts are on the driver at a time."""
    total = items.agg(F.sum(n_bytes(F.col(text)) + 64)).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    block = F.pmod(F.xxhash64(F.col(key), F.col(text)), F.lit(n))
    rows = items.select(block.alias("b"), F.col(key).alias("k"), F.col(text).alias("t"))
    for b in range(n):
        part = sorted(rows.filter(F.col("b") == b).collect(), key=lambda r: (r["k"] is None, r["k"]))
        yield Index([r["k"] for r in part], [r["t"] for r in part])


def added(docs: DataFrame) -> list[str]:
    return fresh(docs, "matches")


def find(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text",
         item_key: str = "item_id") -> DataFrame:
    """``docs`` and, under a fresh name (``added``), an array of matches.

    A match is (item, similarity, first_word, n_words) for each item with a
    window in the text, at its most similar window (the first of equals).
    """
    bound_batches(docs.sparkSession)
    name, = added(docs)
    kind = dict(items.dtypes)[item_key]
    match = f"array<struct<item:{kind},similarity:double,first_word:long,n_words:long>>"
    sent = [Sent(docs.sparkSession, index) for index in _blocks(items, item_text, item_key)]
    schema = ", ".join([f"`{n}` {k}" for n, k in docs.dtypes] + [f"`{name}` {match}"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found: list[list[dict]] = [[] for _ in range(len(pdf))]
            for shared in sent:
                keys = shared.value.keys
                for own, matches in zip(found, shared.value.search(pdf[text])):
                    own += [{"item": keys[i], "similarity": s, "first_word": f, "n_words": n} for i, s, f, n in matches]
            yield pdf.assign(**{name: found})

    return docs.mapInPandas(run, schema)


def clean(docs: DataFrame, items: DataFrame, text: str = "text", item_text: str = "text",
          item_key: str = "item_id") -> DataFrame:
    """The documents without a window of a benchmark item."""
    name, = added(docs)
    return find(docs, items, text, item_text, item_key).filter(F.size(name) == 0).select(docs.columns)
