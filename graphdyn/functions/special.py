"""Tail probabilities and quantiles as vectorised Pandas UDFs.

Spark has no t or normal distribution functions. The statistics themselves
are computed JVM-side; only the finished statistic columns (one row per test)
pass through these small helpers.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _lgamma(x):
    return np.vectorize(math.lgamma, otypes=[float])(x)


def _erfc(x):
    return np.vectorize(math.erfc, otypes=[float])(x)


def _beta_fraction(a, b, x, steps=300):
    """Continued fraction of the incomplete beta function, modified Lentz."""
    tiny = 1e-300

    def guard(v):
        return np.where(np.abs(v) < tiny, tiny, v)

    c = np.ones_like(x)
    d = 1.0 / guard(1.0 - (a + b) * x / (a + 1.0))
    f = d.copy()
    for m in range(1, steps + 1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d = 1.0 / guard(1.0 + even * d)
        c = guard(1.0 + even / c)
        f = f * d * c
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 / guard(1.0 + odd * d)
        c = guard(1.0 + odd / c)
        step = d * c
        f = f * step
        if np.all(np.abs(step - 1.0) < 1e-15):
            break
    return f


def beta_inc(a, b, x):
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    out = np.full(x.shape, np.nan)
    ok = (a > 0) & (b > 0) & (x >= 0) & (x <= 1)
    out[ok & (x == 0)] = 0.0
    out[ok & (x == 1)] = 1.0
    mid = ok & (x > 0) & (x < 1)
    if mid.any():
        aa, bb, xx = a[mid], b[mid], x[mid]
        flip = xx > (aa + 1) / (aa + bb + 2)
        pa, pb, px = np.where(flip, bb, aa), np.where(flip, aa, bb), np.where(flip, 1 - xx, xx)
        front = np.exp(_lgamma(pa + pb) - _lgamma(pa) - _lgamma(pb)
                       + pa * np.log(px) + pb * np.log1p(-px)) / pa
        val = front * _beta_fraction(pa, pb, px)
        out[mid] = np.where(flip, 1.0 - val, val)
    return out


def t_two_sided(t, df):
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    with np.errstate(invalid="ignore", divide="ignore"):
        x = np.where(np.isinf(t), 0.0, df / (df + t * t))
    return beta_inc(df / 2.0, 0.5, x)


def t_quantile(p, df):
    """Quantile of Student's t by bisection on the two-sided tail."""
    p, df = np.broadcast_arrays(np.asarray(p, float), np.asarray(df, float))
    tail = 2.0 * np.minimum(p, 1.0 - p)
    lo, hi = np.zeros(p.shape), np.full(p.shape, 1.0)
    for _ in range(200):
        grow = t_two_sided(hi, df) > tail
        if not grow.any():
            break
        hi = np.where(grow, hi * 2.0, hi)
    for _ in range(80):
        mid = 0.5 * (lo + hi)
        above = t_two_sided(mid, df) > tail
        lo, hi = np.where(above, mid, lo), np.where(above, hi, mid)
    out = np.where(p < 0.5, -1.0, 1.0) * 0.5 * (lo + hi)
    return np.where((df > 0) & (p > 0) & (p < 1), out, np.nan)


def norm_two_sided(z):
    return _erfc(np.abs(np.asarray(z, float)) / math.sqrt(2.0))


def norm_quantile(p):
    inv = NormalDist().inv_cdf
    return np.array([inv(v) if 0 < v < 1 else
                     (math.inf if v == 1 else -math.inf if v == 0 else math.nan)
                     for v in np.asarray(p, float)])


def chi2_1_tail(x):
    """Upper tail of chi-square with one degree of freedom."""
    return _erfc(np.sqrt(np.maximum(np.asarray(x, float), 0.0) / 2.0))


def mann_whitney_exact(u_max, n1, n2):
    """Two-sided exact p of U for samples without ties.

    The counts of U are the coefficients of a Gaussian binomial, built one
    factor (1 - q^(n2+a)) / (1 - q^a) at a time.
    """
    n1, n2 = min(n1, n2), max(n1, n2)
    counts = np.zeros(n1 * n2 + 1)
    counts[0] = 1.0
    for a in range(1, n1 + 1):
        nxt = counts.copy()
        if n2 + a < len(counts):
            nxt[n2 + a:] -= counts[:-(n2 + a)]
        for r in range(a):
            nxt[r::a] = np.cumsum(nxt[r::a])
        counts = nxt
    tail = counts[int(math.ceil(u_max)):].sum() / counts.sum()
    return min(1.0, 2.0 * tail)


def _nullable(values) -> pd.Series:
    return pd.Series(values).where(pd.notna(values), None).astype("float64")


@F.pandas_udf(DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return _nullable(t_two_sided(t.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def t_critical(p: pd.Series, df: pd.Series) -> pd.Series:
    return _nullable(t_quantile(p.to_numpy(float), df.to_numpy(float)))


@F.pandas_udf(DoubleType())
def norm_p_value(z: pd.Series) -> pd.Series:
    return _nullable(norm_two_sided(z.to_numpy(float)))


@F.pandas_udf(DoubleType())
def norm_ppf(p: pd.Series) -> pd.Series:
    return _nullable(norm_quantile(p.to_numpy(float)))


@F.pandas_udf(DoubleType())
def chi2_p_value(x: pd.Series) -> pd.Series:
    return _nullable(chi2_1_tail(x.to_numpy(float)))


@F.pandas_udf(DoubleType())
def mann_whitney_p(u: pd.Series, n1: pd.Series, n2: pd.Series, tie_term: pd.Series) -> pd.Series:
    """Exact for small samples without ties, else the corrected normal tail."""
    out = []
    for uu, a, b, ties in zip(u.to_numpy(float), n1.to_numpy(), n2.to_numpy(),
                              tie_term.to_numpy(float)):
        a, b = int(a), int(b)
        if math.isnan(uu) or a == 0 or b == 0:
            out.append(math.nan)
            continue
        u_max = max(uu, a * b - uu)
        if ties == 0 and min(a, b) <= 8:
            out.append(mann_whitney_exact(u_max, a, b))
            continue
        n = a + b
        var = a * b / 12.0 * ((n + 1) - ties / (n * (n - 1.0)))
        if var <= 0:
            out.append(1.0)
            continue
        out.append(min(1.0, math.erfc((u_max - a * b / 2.0 - 0.5) / math.sqrt(2.0 * var))))
    return _nullable(np.array(out))
