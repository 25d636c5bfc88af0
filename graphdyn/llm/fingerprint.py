"""Document fingerprints: one-permutation MinHash, densified, packed to low-order bits.

A text's distinct five-word shingles are hashed once. The upper bits of a hash
name its bin, and a bin keeps its least hash, so one pass fills all ``BINS`` bins.
An empty bin takes the value of a full one by optimal densification: each bin has
a random order of all bins, the same for every text, and takes the first full bin
in it. So two texts agree in a bin with the probability of their Jaccard
similarity J, whatever their sizes.

Of each bin ``BITS`` low-order bits are stored, drawn from the value and the bin's
number (values copied between bins would otherwise agree or differ together).
Unequal values agree in b bits by chance with probability c = 2^-b, so bins agree
with probability J + (1 - J) c; ``likeness`` solves this for J: (share - c) / (1 - c),
not below 0. Its standard error is sqrt(share (1 - share) / BINS) / (1 - c), 0.023 at most.

``fingerprints`` is one scan without a shuffle. ``edit_report`` also meets each text
with the next one by key: sampled keys cut the table into key ranges, rows are
sorted within a range, and a range's first row (the splitter itself) is sent to the
range before it too. Nothing but splitters passes the driver, and a task holds one
batch of rows.

Edge cases: null, empty and blank texts have the fingerprint '' (likeness 1 to each
other, 0 to others); texts of one to four words are one shingle; very long texts are
read whole; null keys come first, rows of one key are ordered by the text's md5, so
equal rows are interchangeable; the only row is its own next; an empty table gives
an empty result; columns named like a result move the result to a fresh name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphdyn.llm.common import bound_batches, fresh, partitions, unit_hash
from graphdyn.llm.words import chunks, encode, mix, shingle_sets

BINS, BITS, SIZE = 512, 4, 5
#: Sampled keys per shuffle partition, and key ranges per shuffle partition.
SAMPLE, RANGES = 100, 4
_U = np.uint64


class Sketcher:
    """Makes and compares the fingerprints of many texts; built in the task, as its tables are large."""

    def __init__(self, bins: int = BINS, bits: int = BITS):
        if bins & (bins - 1) or bins < 8 or bits not in (1, 2, 4, 8):
            raise ValueError("bins must be a power of two from 8, bits 1, 2, 4 or 8")
        self.bins, self.bits = bins, bits
        self.shift = _U(64 - (bins - 1).bit_length())
        #: order[k, j]: place of bin j in the order of bin k.
        self.order = (mix(np.arange(bins * bins, dtype=_U) + _U(1 << 32)) >> _U(32)).astype(np.uint32).reshape(bins, bins)
        self.salt = mix(np.arange(bins, dtype=_U) + _U(1 << 40))
        field = np.arange(256)[:, None] >> np.arange(0, 8, bits)[None, :] & (1 << bits) - 1
        #: Per byte of the exclusive or of two fingerprints, how many bins agree.
        self.agree = (field == 0).sum(1).astype(np.int32)

    def values(self, shingles: np.ndarray) -> np.ndarray:
        """One value per bin from the sorted distinct hashes of a text that has any."""
        bin_ = (shingles >> self.shift).astype(np.int64)
        # hashes are in order, so a bin's first is its least
        first = np.flatnonzero(np.diff(bin_, prepend=-1))
        full, out = bin_[first], np.empty(self.bins, _U)
        out[full] = shingles[first]
        if len(full) < self.bins:
            held = np.zeros(self.bins, bool)
            held[full] = True
            empty = np.flatnonzero(~held)
            out[empty] = out[full[self.order[empty[:, None], full[None, :]].argmin(1)]]
        return out

    def pack(self, values: np.ndarray) -> np.ndarray:
        """The fingerprint's bytes from its bin values."""
        low = (mix(values ^ self.salt) & _U((1 << self.bits) - 1)).astype(np.uint8).reshape(-1, 8 // self.bits)
        return np.bitwise_or.reduce(low << np.arange(0, 8, self.bits, dtype=np.uint8), axis=1)

    def sketch(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(fingerprints as rows of bytes, which texts have words)."""
        out, some = np.zeros((len(texts), self.bins * self.bits // 8), np.uint8), np.zeros(len(texts), bool)
        for a, b in chunks(texts):
            for i, s in enumerate(shingle_sets(texts[a:b], SIZE), a):
                if len(s):
                    out[i], some[i] = self.pack(self.values(s)), True
        return out, some

    def likeness(self, a: np.ndarray, b: np.ndarray, some_a: np.ndarray, some_b: np.ndarray) -> np.ndarray:
        """Estimated Jaccard similarities, row by row."""
        share = self.agree[a ^ b].sum(1) / self.bins
        chance = 2.0 ** -self.bits
        found = np.maximum(0.0, (share - chance) / (1 - chance))
        return np.where(some_a & some_b, found, (some_a == some_b).astype(float))


def _hex(prints: np.ndarray, some: np.ndarray) -> list[str]:
    return [row.tobytes().hex() if s else "" for row, s in zip(prints, some)]


def added(docs: DataFrame) -> list[str]:
    return fresh(docs, "fingerprint")


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (), bins: int = BINS,
                 bits: int = BITS) -> DataFrame:
    """``keep`` columns of ``docs`` and the fingerprint in hex under a fresh name (``added``)."""
    bound_batches(docs.sparkSession)
    (name,), (t,) = added(docs), fresh(docs, "t")
    rows = docs.select(*dict.fromkeys(keep), F.col(text).alias(t))
    schema = [f"`{n}` {k}" for n, k in rows.drop(t).dtypes] + [f"`{name}` string"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketcher = Sketcher(bins, bits)
        for pdf in batches:
            yield pdf.drop(columns=t).assign(**{name: _hex(*sketcher.sketch(encode(pdf[t])))})

    return rows.mapInPandas(run, ", ".join(schema))


def likeness(a: Column, b: Column, bits: int = BITS) -> Column:
    """Likeness of two hex fingerprints of four bits a bin or fewer, as a column expression."""
    if bits not in (1, 2, 4):
        raise ValueError("bits must be 1, 2 or 4")
    # per pair of hex digits the number of agreeing bins
    worth = [sum((x >> k) % (1 << bits) == 0 for k in range(0, 4, bits)) for x in range(16)]
    table = F.array(*(F.lit(w) for w in worth))
    digit = lambda c, i: F.conv(F.substring(c, i, F.lit(1)), 16, 10).cast("int")
    agree = F.aggregate(F.sequence(F.lit(1), F.length(a)), F.lit(0), lambda n, i: n + F.element_at(
        table, digit(a, i).bitwiseXOR(digit(b, i)) + 1))
    chance = 2.0 ** -bits
    share = agree / (F.length(a) * (4 // bits))
    both = (F.length(a) > 0) & (F.length(b) > 0)
    return F.when(both, F.greatest(F.lit(0.0), (share - chance) / (1 - chance))).otherwise(
        (F.length(a) == F.length(b)).cast("double"))


# --- each text and the next one ---------------------------------------------

def _splitters(rows: DataFrame, n: int, p: int) -> list[tuple]:
    """Keys (none, k, name) of rows that cut the table into about equal ranges, in order; a bounded sample."""
    drawn = rows.filter(unit_hash("ranges", F.concat_ws(":", "k", F.hex("name"))) < SAMPLE * p / max(1, n))
    keys = sorted((not r["none"], r["k"], bytes(r["name"])) for r in drawn.select("none", "k", "name").distinct().collect())
    want = min(RANGES * p, len(keys))
    return [keys[i] for i in sorted({len(keys) * j // want for j in range(want)})] if want else []


def laid_out(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(slot, border, k, none, name, t), sorted in partitions, so that each row is followed by its next.

    A slot is a key range. Its last row, marked as border, is the first of the range
    after it, and for the last range the first of all; border rows are only looked at.
    """
    p = partitions(docs)
    t, k = F.coalesce(F.col(text), F.lit("")), F.col(key).cast("long")
    rows = docs.select(F.coalesce(k, F.lit(0)).alias("k"), k.isNull().alias("none"), F.unhex(F.md5(t)).alias("name"),
                       t.alias("t"))
    key_of = F.struct(~F.col("none"), "k", "name")
    least, n = rows.agg(F.min(key_of), F.count(F.lit(1))).first()
    if not n:
        return rows.select(F.lit(0).alias("slot"), F.lit(False).alias("border"), "k", "none", "name", "t")
    first = (least[0], least[1], bytes(least[2]))
    cuts = [c for c in _splitters(rows, n, p) if c > first]
    literal = lambda c: F.struct(F.lit(c[0]), F.lit(c[1]).cast("long"), F.lit(c[2]))
    at = F.array(literal(first), *(literal(c) for c in cuts))
    # the first range starts with the first row of all, so every range starts with a row that exists
    # binary search: how many range starts are not above the key
    halves = F.array(*(F.lit(1 << i) for i in reversed(range((len(cuts) + 1).bit_length()))))
    slot = F.aggregate(halves, F.lit(0), lambda found, step: F.when(
        F.get(at, found + step - 1) <= key_of, found + step).otherwise(found)) - 1
    placed = rows.withColumn("own", slot)
    starts = key_of == F.element_at(at, F.col("own") + 1)
    before = F.pmod(F.col("own") - 1, F.lit(len(cuts) + 1)).cast("int")
    place = lambda s, border: F.struct(s.alias("slot"), F.lit(border).alias("border"))
    places = F.when(starts, F.array(place(F.col("own"), False), place(before, True))).otherwise(
        F.array(place(F.col("own"), False)))
    out = placed.withColumn("place", F.explode(places)).select("place.slot", "place.border", "k", "none", "name", "t")
    return out.repartition(p, "slot").sortWithinPartitions("slot", "border", F.desc("none"), "k", "name")


def edit_report(docs: DataFrame, text: str = "text", key: str = "doc_id", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) per document.

    The edited text is the text with its last half (rounded down, in code points)
    replaced by the first as many code points, or all, of the next document.
    """
    bound_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketcher, held = Sketcher(bins, bits), None
        for pdf in batches:
            if pdf.empty:
                continue
            slot, border, texts = pdf["slot"].tolist(), pdf["border"].tolist(), pdf["t"].tolist()
            keys = [None if none else k for none, k in zip(pdf["none"], pdf["k"])]
            prints, some = sketcher.sketch(encode(texts))
            rows = list(zip(slot, border, keys, texts, prints, some))
            if held is not None:
                rows.insert(0, held)
            held = rows[-1]
            pairs = [(a, b) for a, b in zip(rows, rows[1:]) if not a[1] and a[0] == b[0]]
            if not pairs:
                continue
            edited = [a[3][: len(a[3]) - len(a[3]) // 2] + b[3][: len(a[3]) // 2] for a, b in pairs]
            raw = encode(edited)
            changed, words = sketcher.sketch(raw)
            own, next_ = np.array([a[4] for a, _ in pairs]), np.array([b[4] for _, b in pairs])
            has, next_has = np.array([a[5] for a, _ in pairs]), np.array([b[5] for _, b in pairs])
            out = pd.DataFrame({
                "k": pd.array([a[2] for a, _ in pairs], "Int64"), "n_chars": [len(a[3]) for a, _ in pairs],
                "edited_sha256": [hashlib.sha256(x).hexdigest() for x in raw],
                "fingerprint": _hex(own, has), "edited_fingerprint": _hex(changed, words),
                "near_edited": sketcher.likeness(own, changed, has, words),
                "near_next": sketcher.likeness(own, next_, has, next_has)})
            yield out

    found = laid_out(docs, text, key).mapInPandas(
        run, "k long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
             " near_edited double, near_next double")
    return found.withColumn("k", F.col("k").cast(kind)).withColumnRenamed("k", key)
