"""Hard-negative mining: rotated one-bit codes, stored alignments, deterministic intervals.

Vectors become integers (floor(256 x)); a score is an integer inner product. Each
row's vector v is rotated (signs and Walsh-Hadamard rounds, the same for all) to y
and coded by the signs of y: the unit vector b of the code has the stored alignment
a = <y, b>. What is left, y - a b, is coded the same way again (``LEVELS`` codes);
the rest r is orthogonal to the last code, and only its length is stored.

For an anchor q, rotated and rounded to ``PLANES`` bits a component, the products
<q, b> follow from popcounts of bit planes and codes, up to the known rounding. So

    score = sum of a_l <q, b_l> + <q, r>,   |<q, r>| <= |r| sqrt(|q|^2 - <q, b_last>^2)

by Cauchy-Schwarz: an interval that holds the score for certain, nothing is left to
chance. (With four codes it is about a fifth of |q||v| to each side; vectors of 64
nearly independent components leave more than half of all rows within it.) Rows whose interval lies below what the ``k``-th best lower bound already
guarantees, or outside an asked band, are dropped; the others are scored as integers.

Layout: rows are dealt into stripes and anchors into blocks, both of bounded size;
each (stripe, block) pair is one task's group, and per anchor only its best few
rows of a stripe go on. Two passes: positives (best of the same label), then
negatives (best of other labels within a band per positive).

Edge cases: rows with a null key, label or vector, or any null or non-finite
component take no part; equal rows (key, label, vector) count once, different rows
of one key each count; ties go to the smaller key; only vectors of one length are
compared; empty vectors have score 0; an anchor without rows in a band has no rows
in the result; a score beyond 64 bits is an error; other columns are not read; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphdyn.llm.common import bound_batches, partitions
from graphdyn.llm.words import mix
from graphdyn.session import cut_lineage

LEVELS, PLANES, ROUNDS = 4, 6, 3
#: Rows of a stripe and anchors of a block.
STRIPE, LEAST_STRIPE, BLOCK = 1 << 16, 1 << 11, 1 << 13
#: Numbers of one tile of estimates.
TILE = 1 << 19
_U = np.uint64


# --- codes ------------------------------------------------------------------

def rotate(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` rotated, padded to a power of two."""
    n, d = x.shape
    size = 1 << max(0, d - 1).bit_length() if d > 1 else 1
    y = np.zeros((n, size))
    y[:, :d] = x
    for r in range(ROUNDS):
        y *= np.where(mix(np.arange(size, dtype=_U) + _U(1000 * r + 1)) & _U(1), 1.0, -1.0)
        step = 1
        while step < size:
            z = y.reshape(n, size // (2 * step), 2, step)
            a, b = z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]
            y = np.stack([a, b], axis=2).reshape(n, size)
            step *= 2
        y /= np.sqrt(size)
    return y


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits of each row as 64-bit words."""
    packed = np.packbits(bits, axis=1, bitorder="little")
    packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
    return packed.view(_U)


class Codes:
    """Codes (level, row, word), alignments (level, row) and the rest's length of some rows."""

    def __init__(self, x: np.ndarray, levels: int = LEVELS):
        y = rotate(x.astype(float))
        self.size = y.shape[1]
        self.norm = np.sqrt((y * y).sum(1))
        code, align = [], []
        for _ in range(levels):
            bits = y >= 0
            a = np.abs(y).sum(1) / np.sqrt(self.size)
            y = y - (a / np.sqrt(self.size))[:, None] * np.where(bits, 1.0, -1.0)
            code.append(_words(bits))
            align.append(a)
        self.code, self.align = np.array(code), np.array(align)
        self.rest = np.sqrt((y * y).sum(1))


class Query:
    """Anchors as bit planes, ready to be held against codes."""

    def __init__(self, x: np.ndarray, planes: int = PLANES):
        y = rotate(x.astype(float))
        self.size, self.norm = y.shape[1], np.sqrt((y * y).sum(1))
        self.low = y.min(1)
        self.step = np.maximum((y.max(1) - self.low) / ((1 << planes) - 1), 1e-300)
        u = np.rint((y - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        near = self.low[:, None] + self.step[:, None] * u
        self.total = near.sum(1)
        self.off = np.abs(y - near).sum(1) / np.sqrt(self.size)
        self.plane = np.array([_words((u >> k) & 1 > 0) for k in range(planes)])

    def products(self, code: np.ndarray, rows: slice) -> np.ndarray:
        """<q, b> of anchors ``rows`` and all codes, up to ``off``."""
        ones = np.bitwise_count(code).sum(1, dtype=np.int64)
        hit = np.zeros((rows.stop - rows.start, len(code)), np.int32)
        for k, plane in enumerate(self.plane):
            for w in range(code.shape[1]):
                both = np.bitwise_count(plane[rows, w][:, None] & code[None, :, w])
                hit += both.astype(np.int32) << k
        got = 2 * (self.low[rows, None] * ones[None, :] + self.step[rows, None] * hit) - self.total[rows, None]
        return got / np.sqrt(self.size)

    def intervals(self, codes: Codes, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) score of each anchor with each coded row, as whole numbers."""
        mid, wide = 0.0, 0.0
        for code, align in zip(codes.code, codes.align):
            t = self.products(code, rows)
            mid = mid + t * align[None, :]
            wide = wide + self.off[rows, None] * align[None, :]
        t = np.maximum(0.0, np.abs(t) - self.off[rows, None])
        side = np.sqrt(np.maximum(0.0, self.norm[rows, None] ** 2 - t * t))
        # room for rounding in the floating-point sums
        slack = 1e-9 * self.norm[rows, None] * codes.norm[None, :] + 1e-6
        wide = wide + side * codes.rest[None, :] + slack
        return np.ceil(mid - wide), np.floor(mid + wide)


class Scorer:
    """Integer inner products of anchors with kept rows; raises where one may exceed 64 bits."""

    def __init__(self, q: np.ndarray, x: np.ndarray):
        most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, x.shape[1])
        if most >= 2.0 ** 62:
            raise ValueError("an inner product may exceed 64 bits")
        # sums of whole numbers below 2^53 are exact in floating point, in any order
        kind = float if most < 2.0 ** 52 else np.int64
        self.q, self.x = q.astype(kind), x.astype(kind)

    def tile(self, rows: slice, kept: list[np.ndarray]) -> Iterator[np.ndarray]:
        """Per anchor of the tile the scores of its kept rows."""
        # where much is kept, one product of the whole tile costs less than gathering rows
        full = None
        if self.x.dtype == float and 8 * sum(map(len, kept)) > len(kept) * len(self.x):
            full = self.q[rows] @ self.x.T
        for i, at in enumerate(kept):
            s = full[i, at] if full is not None else self.x[at] @ self.q[rows.start + i]
            yield np.rint(s).astype(np.int64)


# --- search within one (stripe, block) ---------------------------------------

def _least_kept(low: np.ndarray, k: int) -> float:
    """What the k-th best row scores at least."""
    return -np.inf if len(low) <= k else np.partition(low, len(low) - k)[len(low) - k]


class Stripe:
    """Rows of one length with their codes, unpacked from a group's frame."""

    def __init__(self, pdf: pd.DataFrame, dim: int):
        pdf = pdf.sort_values(["id", "same"])
        self.id, self.label = pdf["id"].to_numpy(np.int64), pdf["label"].to_numpy(np.int64)
        self.same = pdf["same"].to_numpy(np.int64)
        self.x = _vectors(pdf, dim)
        self.code, self.align, self.rest, self.norm = _unpack_codes(pdf)

    def take(self, at: np.ndarray) -> Codes:
        part = Codes.__new__(Codes)
        part.code, part.align = self.code[:, at], self.align[:, at]
        part.rest, part.norm = self.rest[at], self.norm[at]
        return part


def _vectors(pdf: pd.DataFrame, dim: int) -> np.ndarray:
    if not dim:
        return np.zeros((len(pdf), 0), np.int64)
    raw = pdf["v"].tolist()
    widths = {len(b) // dim for b in raw}
    if len(widths) == 1:
        return np.frombuffer(b"".join(raw), f"<i{widths.pop()}").reshape(-1, dim)
    return np.array([np.frombuffer(b, f"<i{len(b) // dim}") for b in raw], np.int64)


def _unpack_codes(pdf: pd.DataFrame) -> tuple[np.ndarray, ...]:
    code = np.frombuffer(b"".join(pdf["code"]), _U).reshape(len(pdf), LEVELS, -1).transpose(1, 0, 2)
    real = np.frombuffer(b"".join(pdf["align"]), np.float64).reshape(len(pdf), LEVELS + 2)
    return code, real[:, :LEVELS].T, real[:, LEVELS], real[:, LEVELS + 1]


def _tiles(n: int, m: int) -> Iterator[slice]:
    step = max(1, TILE // max(1, m))
    for a in range(0, n, step):
        yield slice(a, min(n, a + step))


def _best(score: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores; rows are in order of their keys, so the first of equals wins."""
    return np.lexsort((at, -score))[:k]


def _positives(anchors: pd.DataFrame, rows: pd.DataFrame, k: int) -> Iterator[tuple]:
    for dim, own in anchors.groupby("dim"):
        found = rows[rows["dim"] == dim]
        if not len(found):
            continue
        stripe = Stripe(found, dim)
        for label, part in own.groupby("label"):
            at = np.flatnonzero(stripe.label == label)
            if not len(at):
                continue
            q, codes = _vectors(part, dim), stripe.take(at)
            query, ids, same = Query(q), part["id"].tolist(), part["same"].to_numpy(np.int64)
            scorer = Scorer(q, stripe.x[at])
            for tile in _tiles(len(part), len(at)):
                low, high = query.intervals(codes, tile)
                kept = []
                for i, lo, hi in zip(range(tile.start, tile.stop), low, high):
                    other = (stripe.same[at] != same[i]) | (stripe.id[at] != ids[i])
                    kept.append(np.flatnonzero(other & (hi >= _least_kept(lo[other], k))))
                for i, keep, s in zip(range(tile.start, tile.stop), kept, scorer.tile(tile, kept)):
                    for j in _best(s, keep, k):
                        row = at[keep[j]]
                        yield ids[i], int(same[i]), int(stripe.id[row]), int(stripe.same[row]), int(s[j])


def _negatives(anchors: pd.DataFrame, rows: pd.DataFrame, k: int, low_share: int, high_share: int) -> Iterator[tuple]:
    for dim, own in anchors.groupby("dim"):
        found = rows[rows["dim"] == dim]
        if not len(found):
            continue
        stripe = Stripe(found, dim)
        every = stripe.take(np.arange(len(found)))
        q, query = _vectors(own, dim), Query(_vectors(own, dim))
        ids, same, label = own["id"].tolist(), own["same"].tolist(), own["label"].to_numpy(np.int64)
        # low_share * p <= 100 * score <= high_share * p in whole numbers
        wanted = [[(p, -(-low_share * p["score"] // 100), high_share * p["score"] // 100) for p in each]
                  for each in own["positives"]]
        scorer = Scorer(q, stripe.x)
        for tile in _tiles(len(own), len(found)):
            lows, highs = query.intervals(every, tile)
            kept = []
            for i, lo, hi in zip(range(tile.start, tile.stop), lows, highs):
                other, keep = stripe.label != label[i], np.zeros(len(found), bool)
                for _, a, b in wanted[i]:
                    if a <= b:
                        sure = other & (lo >= a) & (hi <= b)
                        keep |= other & (hi >= max(a, _least_kept(lo[sure], k))) & (lo <= b)
                kept.append(np.flatnonzero(keep))
            for i, at, s in zip(range(tile.start, tile.stop), kept, scorer.tile(tile, kept)):
                order = np.lexsort((at, -s))
                at, s = at[order], s[order]
                for p, a, b in wanted[i]:
                    first, stop = np.searchsorted(-s, -b, "left"), np.searchsorted(-s, -a, "right")
                    for j in range(first, min(stop, first + k)):
                        yield (ids[i], same[i], p["id"], p["same"], p["score"],
                               int(stripe.id[at[j]]), int(stripe.same[at[j]]), int(s[j]))


# --- frames -------------------------------------------------------------------

def coded(rows: DataFrame, key: str, label: Column, vector: str) -> DataFrame:
    """(id, label, dim, same, v, code, align) of the rows that take part, each distinct row once.

    ``same`` tells rows of one key apart; v holds whole numbers of 2, 4 or 8 bytes.
    """
    x = F.transform(F.col(vector), lambda c: c.cast("double"))
    fine = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(256 * c))
    distinct = rows.select(F.col(key).cast("long").alias("id"), label.cast("long").alias("label"),
                           F.when(fine, whole).alias("x")).dropna().distinct()
    distinct = distinct.withColumn("same", F.xxhash64("label", "x"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for dim, part in pdf.groupby(pdf["x"].map(len)):
                x = np.array(part["x"].tolist(), np.int64).reshape(len(part), dim)
                codes = Codes(x)
                most = np.abs(x).max(1, initial=0)
                real = np.concatenate([codes.align, [codes.rest, codes.norm]]).T
                yield pd.DataFrame({
                    "id": part["id"], "label": part["label"], "dim": dim, "same": part["same"],
                    "v": [r.astype("<i2" if m < 1 << 15 else "<i4" if m < 1 << 31 else "<i8").tobytes()
                          for r, m in zip(x, most)],
                    "code": [c.tobytes() for c in codes.code.transpose(1, 0, 2)], "align": [r.tobytes() for r in real]})

    return distinct.mapInPandas(run, "id long, label long, dim int, same long, v binary, code binary, align binary")


def _dealt(rows: DataFrame, anchors: DataFrame, stripes: int, blocks: int):
    """Both sides keyed by (stripe, block), every pair of them once."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda n, seed: F.pmod(F.xxhash64("id", "same", F.lit(seed)), F.lit(n)).cast("int")
    left = anchors.withColumn("block", place(blocks, 1)).withColumn("stripe", every(stripes))
    right = rows.withColumn("stripe", place(stripes, 2)).withColumn("block", every(blocks))
    return left.groupBy("stripe", "block").cogroup(right.groupBy("stripe", "block"))


def mine(rows: DataFrame, key: str, label: Column, vector: str, is_anchor: Column, n_positives: int = 5,
         n_negatives: int = 10, low_share: int = 30, high_share: int = 90) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``is_anchor`` is an expression over the column ``id``, the key. For each anchor
    and each of its ``n_positives`` best rows of the same label: the ``n_negatives``
    best rows of other labels that score low_share to high_share % of the positive.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    p = partitions(rows)
    table = cut_lineage(coded(rows, key, label, vector))
    anchors = table.filter(is_anchor).drop("code", "align")
    n, n_anchors = table.count(), anchors.count()
    stripes = max(1, -(-n // STRIPE), min(2 * p, n // LEAST_STRIPE))
    blocks = max(1, -(-n_anchors // BLOCK))

    def positives(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = list(_positives(a, b, n_positives)) if len(a) and len(b) else []
        return pd.DataFrame(found, columns=["id", "same", "positive", "positive_same", "score"])

    best = _dealt(table, anchors, stripes, blocks).applyInPandas(
        positives, "id long, same long, positive long, positive_same long, score long")
    order = Window.partitionBy("id", "same").orderBy(F.desc("score"), "positive", "positive_same")
    best = best.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n_positives)
    # at most n_positives per anchor
    held = best.groupBy(F.col("id").alias("i"), F.col("same").alias("s")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("positive").alias("id"), F.col("positive_same").alias("same"), "score"))).alias("positives"))
    asked = cut_lineage(anchors.join(held, (F.col("id") == F.col("i")) & (F.col("same") == F.col("s"))).drop("i", "s"))

    def negatives(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = list(_negatives(a, b, n_negatives, low_share, high_share)) if len(a) and len(b) else []
        return pd.DataFrame(found, columns=["anchor_id", "same", "positive_id", "positive_same", "positive_score",
                                            "negative_id", "negative_same", "negative_score"])

    found = _dealt(table, asked, stripes, blocks).applyInPandas(
        negatives, "anchor_id long, same long, positive_id long, positive_same long, positive_score long,"
                   " negative_id long, negative_same long, negative_score long")
    order = Window.partitionBy("anchor_id", "same", "positive_id", "positive_same").orderBy(
        F.desc("negative_score"), "negative_id", "negative_same")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n_negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
