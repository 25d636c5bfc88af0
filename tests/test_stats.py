import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphdyn.functions import special as sp
from graphdyn.operators import stats


def test_tail_functions_known_values():
    assert sp.t_quantile(0.975, 34) == pytest.approx(2.032, abs=5e-4)
    assert sp.t_quantile(0.975, 30) == pytest.approx(2.042, abs=5e-4)
    assert sp.t_quantile(0.025, 30) == pytest.approx(-2.042, abs=5e-4)
    # one degree of freedom has the closed form 1 - 2 atan(t) / pi, two 1 - t / sqrt(2 + t^2)
    assert sp.t_two_sided(1.0, 1) == pytest.approx(0.5, rel=1e-12)
    assert sp.t_two_sided(3.0, 2) == pytest.approx(1 - 3 / math.sqrt(11), rel=1e-12)
    assert sp.t_two_sided(60.0, 5) == pytest.approx(2.36e-8, rel=0.05)
    assert sp.norm_two_sided(1.959964) == pytest.approx(0.05, abs=1e-7)
    assert sp.norm_quantile([0.975])[0] == pytest.approx(1.959964, abs=1e-6)
    assert sp.chi2_1_tail(3.841459) == pytest.approx(0.05, abs=1e-7)


def test_exact_rank_sum_by_enumeration():
    from itertools import combinations
    n1, n2 = 4, 5
    us = [sum(c) - n1 * (n1 + 1) / 2 for c in combinations(range(1, n1 + n2 + 1), n1)]
    for u in range(10, 21):
        want = min(1.0, 2 * np.mean([x >= u for x in us]))
        assert sp.mann_whitney_exact(u, n1, n2) == pytest.approx(want, rel=1e-12)
        assert sp.mann_whitney_exact(u, n2, n1) == pytest.approx(want, rel=1e-12)


def _frame(spark, a, b, metric="m"):
    rows = [(metric, "A", float(v)) for v in a] + [(metric, "B", float(v)) for v in b]
    return spark.createDataFrame(rows, "metric string, grp string, value double").repartition(4)


def test_mann_whitney_with_hot_ties(spark):
    rng = np.random.default_rng(0)
    a = np.where(rng.random(60) < 0.4, 0.0, rng.normal(size=60))
    b = np.where(rng.random(50) < 0.4, 0.0, rng.normal(size=50) + 0.5)
    df = _frame(spark, a, b).unionByName(_frame(spark, b, a, "swapped"))
    got = {r.metric: r for r in stats.mann_whitney(df).collect()}
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert got["m"].u_stat == pytest.approx(u)
    assert got["swapped"].u_stat == pytest.approx(3000 - u)
    _, n = np.unique(np.concatenate([a, b]), return_counts=True)
    var = 3000 / 12 * (111 - (n ** 3 - n).sum() / (110 * 109))
    z = (abs(u - 1500) - 0.5) / math.sqrt(var)
    assert got["m"].p_value == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-9)
    assert got["m"].effect_r == pytest.approx(-z / math.sqrt(110), rel=1e-6)


def test_welch_and_student(spark):
    a, b = [1.0, 2.0, 4.0, 3.5], [2.0, 5.0, 6.5, 7.0, 8.0]
    w = stats.two_group_test(_frame(spark, a, b), ["metric"]).first()
    va, vb = np.var(a, ddof=1) / 4, np.var(b, ddof=1) / 5
    assert w.t_stat == pytest.approx((np.mean(a) - np.mean(b)) / math.sqrt(va + vb))
    assert w.df == pytest.approx((va + vb) ** 2 / (va ** 2 / 3 + vb ** 2 / 4))
    s = stats.two_group_test(_frame(spark, a, b), ["metric"], kind="student").first()
    assert s.df == 7 and 0 < s.p_value < 0.1
    assert w.cohens_d == pytest.approx((np.mean(a) - np.mean(b))
                                       / (math.sqrt((np.var(a) + np.var(b)) / 2) + 1e-10))


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.2, None, 0.005]
    df = spark.createDataFrame([("f", k, v) for k, v in enumerate(p)],
                               "family string, k int, p_value double")
    out = stats.fdr_bh(df, ["family"]).orderBy("k").toPandas()
    np.testing.assert_allclose(out.p_adjusted, [0.025, 0.05, 0.05, 0.2, np.nan, 0.025])
    assert out.n_reject.unique().tolist() == [4]


def test_chi2_yates(spark):
    rows = [("A", True)] * 9 + [("A", False)] * 3 + [("B", True)] * 4 + [("B", False)] * 8
    r = stats.chi2_2x2(spark.createDataFrame(rows, "grp string, is_time_varying boolean")).first()
    want = 24 * (abs(9 * 8 - 3 * 4) - 12) ** 2 / (12 * 12 * 13 * 11)
    assert r.chi2 == pytest.approx(want) and r.p_value == pytest.approx(sp.chi2_1_tail(want))


def test_shared_band_edge_counts_twice(spark):
    from graphdyn.functions.scalars import bands_of
    df = spark.createDataFrame([(0.2,), (4.0,), (9.0,), (30.0,), (40.0,), (41.0,)], "f double")
    got = [r[0] for r in df.orderBy("f").select(bands_of("f")).collect()]
    assert got == [[], ["delta", "theta"], ["alpha"], ["beta", "gamma"], ["gamma"], []]


def test_confidence_interval(spark):
    df = spark.createDataFrame([("A", float(v)) for v in range(10)], "grp string, value double")
    r = stats.t_confidence_interval(df, ["grp"]).first()
    sem = np.std(range(10), ddof=1) / math.sqrt(10)
    assert r.ci_margin == pytest.approx(2.262157 * sem, rel=1e-6)
    assert r.ci_lower == pytest.approx(4.5 - r.ci_margin)
    assert stats.sem_band(df, ["grp"]).select(F.col("upper")).first()[0] == pytest.approx(
        4.5 + np.std(range(10)) / math.sqrt(10))


def test_adjustment_of_large_families_equals_the_windowed_one(spark):
    rng = np.random.default_rng(6)
    rows = [("a" if i % 4 else None if i % 8 else "b", i, None if i % 50 == 7 else round(float(rng.beta(0.3, 1)), 3))
            for i in range(900)]
    df = spark.createDataFrame(rows, "fam string, id int, p_value double").repartition(7)
    for family in (["fam"], []):
        flat = df if family else df.withColumn("one", F.lit(1))
        want = {r.id: (r.p_adjusted, r.reject, r.n_reject) for r in stats.fdr_bh(flat, family or ["one"]).collect()}
        found = stats.fdr_bh_large(df, family).collect()
        got = {r.id: (r.p_adjusted, r.reject, r.n_reject) for r in found}
        assert len(found) == 900 and got.keys() == want.keys()
        for k, (p, reject, n) in want.items():
            assert got[k][0] == (None if p is None else pytest.approx(p, rel=1e-12))
            assert got[k][1:] == (reject, n)
