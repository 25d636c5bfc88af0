"""Hard-negative mining against plain loops, and what its intervals promise."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphdyn.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, n_positives=5, n_negatives=10):
    """The same search by loops over (key, label, vector) rows."""
    fine = []
    for k, label, v in rows:
        if k is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (k, label, tuple(math.floor(256 * float(np.float32(x))) for x in v))
        if row not in fine:
            fine.append(row)
    out = []
    for a in fine:
        if a[0] % 100:
            continue
        score = lambda r: sum(x * y for x, y in zip(a[2], r[2]))
        others = [r for r in fine if r != a and len(r[2]) == len(a[2])]
        pos = sorted((-score(r), r[0]) for r in others if r[1] == a[1])[:n_positives]
        neg = sorted((-score(r), r[0]) for r in others if r[1] != a[1])
        for ps, p in pos:
            found = [(s, k) for s, k in neg if 30 * -ps <= 100 * -s <= 90 * -ps][:n_negatives]
            out += [(a[0], p, i + 1, k, -ps, -s) for i, (s, k) in enumerate(found)]
    return sorted(out)


def mined(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("id", F.lit("x")).withColumn("score", F.lit(1))
    got = negatives.mine(df, "vec_id", F.col("label"), "embedding", F.col("id") % 100 == 0).collect()
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got)


def vectors(n, dim, seed=3, spread=0.6):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(4, dim))
    out = centre[rng.integers(0, 4, n)] + spread * rng.normal(size=(n, dim))
    return (out / np.linalg.norm(out, axis=1)[:, None]).astype(np.float32)


@pytest.mark.parametrize("dim", [3, 64])
def test_mining_matches_plain_loops(spark, dim, monkeypatch):
    monkeypatch.setattr(negatives, "STRIPE", 150)
    monkeypatch.setattr(negatives, "BLOCK", 2)
    rng = random.Random(dim)
    x = vectors(600, dim)
    rows = [(i, rng.randrange(3), [float(c) for c in v]) for i, v in enumerate(x)]
    rows[40:50] = [(i, 1, rows[7][2]) for i in range(40, 50)]  # equal vectors, so ties
    rows += [rows[0], rows[100], (700, None, rows[1][2]), (800, 1, None), (None, 1, rows[2][2]),
             (900, 1, [None] * dim), (1000, 0, [float("nan")] * dim), (1100, 2, [float("inf")] * dim),
             (1200, 1, []), (1201, 1, []), (1202, 0, []), (1300, 7, rows[3][2]), (5, 2, rows[9][2]),
             (1400, 1, [-c for c in rows[11][2]]), (1500, 1, [0.0] * dim), (1600, 0, [1.0] * (dim + 1))]
    want = plain(rows)
    assert want and mined(spark, rows) == want


def test_wide_numbers_and_empty_tables(spark):
    rows = [(i, i % 2, [float((i * 7919 + j * 104729) % 1000 - 500) * 1e3 for j in range(5)]) for i in range(120)]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, rows[:0]) == [] and mined(spark, rows[:1]) == [] and mined(spark, rows[1:5]) == []
    huge = [(i, 0, [1e30, 1.0]) for i in (0, 1)]
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, huge)


@pytest.mark.parametrize("dim", [1, 5, 64, 100])
def test_intervals_hold_every_score(dim):
    rng = np.random.default_rng(dim)
    x = np.concatenate([np.floor(256 * vectors(300, dim)), rng.integers(-9, 9, (50, dim)), np.zeros((1, dim))]).astype(np.int64)
    exact = x @ x.T
    for levels in (1, 2, 4):
        low, high = negatives.Query(x).intervals(negatives.Codes(x, levels), slice(0, len(x)))
        assert (low <= exact).all() and (exact <= high).all()
    assert np.allclose(negatives.rotate(x.astype(float)) @ negatives.rotate(x.astype(float)).T, exact)


def test_intervals_drop_rows_of_other_clusters():
    x = np.floor(256 * vectors(2000, 64, spread=0.05)).astype(np.int64)
    low, high = negatives.Query(x[:20]).intervals(negatives.Codes(x), slice(0, 20))
    kept = [(h >= negatives._least_kept(lo, 5)).mean() for lo, h in zip(low, high)]
    assert np.mean(kept) < 0.4
