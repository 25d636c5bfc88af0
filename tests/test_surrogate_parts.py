"""Surrogates by parts: the exchange does not grow with their number, and any cut gives the same models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import signals_frame
from graphdyn.operators import blocks, moments, surrogate


@pytest.fixture(scope="module")
def recordings():
    rng = np.random.default_rng(5)
    return {("a", "A"): rng.normal(size=(6, 900)), ("b", "B"): rng.normal(size=(6, 731))}


def _shuffled(spark):
    return spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()


def test_exchange_does_not_grow_with_the_surrogates(spark, basis):
    rng = np.random.default_rng(6)
    sig = signals_frame(spark, {("a", "A"): rng.normal(size=(6, 9000))}).localCheckpoint()
    written = {}
    for n in (5, 50):
        before = _shuffled(spark)
        null = surrogate.surrogate_null(sig, basis, 6, P=2, K=1, length=300, step=300, n_surrogates=n, n_omega=8)
        assert null.count() == n
        written[n] = _shuffled(spark) - before
    assert written[50] < 2 * written[5]


def test_scattered_offsets_send_few_copies_of_the_samples(spark):
    """Every part of a recording needs all of it, so the parts are few."""
    n = 1_200_000
    graph = spark.createDataFrame([([0.9, 1.1], [0.6, 0.8, 0.8, -0.6])], "lam array<double>, u array<double>")
    sig = spark.range(n).selectExpr("'a' as subject_id", "'A' as grp", "cast(id % 2 as int) as channel",
                                    "id div 2 as t", "randn(3) as value").localCheckpoint()
    stats = moments.recording_stats(sig, 2).withColumns({"P": F.lit(2), "K": F.lit(1)}).localCheckpoint()

    def copies(**cut):
        rows = surrogate.surrogate_models(sig, stats, graph, 2, 30, length=5000, step=5000, p_max=2,
                                          shift=blocks.hashed_shift(1), **cut)
        before = _shuffled(spark)
        assert rows.select("surrogate").distinct().count() == 30
        return (_shuffled(spark) - before) / (8 * n)

    assert copies() < copies(n_parts=8) - 2


@pytest.mark.parametrize("shift", [None, lambda s, c: 17 * s + 5 * c, lambda s, c: -(3 * s + c)])
def test_any_cut_gives_the_same_models(spark, recordings, basis, shift):
    sig = signals_frame(spark, recordings)
    stats = moments.recording_stats(sig, 6).withColumns({"P": F.lit(2), "K": F.lit(1)})
    shift = shift or blocks.hashed_shift(3)

    def models(**cut):
        rows = surrogate.surrogate_models(sig, stats, basis, 6, 4, length=60, step=25, p_max=2, shift=shift, **cut).collect()
        h, a = {}, {}
        for r in rows:
            key = r.subject_id, r.surrogate
            h.setdefault(key, []).extend(np.reshape(r.h, (-1, 4)).tolist())
            if r.a is not None:
                a[key] = a.get(key, 0) + np.array([r.n_obs, r.s1, *r.a])
        return {k: sorted(v) for k, v in h.items()}, a, len(rows)

    h, a, _ = models()
    for cut in (dict(size=17), dict(size=17, n_parts=20, held=20_000), dict(size=64, n_parts=3, held=1)):
        other, b, n = models(**cut)
        assert h.keys() == other.keys() and n > 8
        for key in h:
            np.testing.assert_allclose(other[key], h[key], rtol=1e-8, atol=1e-10)
            np.testing.assert_allclose(b[key], a[key], rtol=1e-9, atol=1e-8)
