"""graph autoregression models from lag moments: fit, stability, scores, selection.

Everything here works on model-sized rows, one per (subject, scope, order).
The small dense systems are solved row by row inside Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphdyn.operators.moments import (
    KEY, pane_blocks, pane_moments, recording_lengths, recording_stats, restandardised_stats,
    sum_moments)
from graphdyn.operators.prep import split_points
from graphdyn.schema import RIDGE

MODEL_FIELDS = ("P int, K int, h array<double>, rho double, n_obs bigint, rss double,"
                " r2 double, mse double, bic double")


class LagMoments:
    """A_j(p, q) of a batch of models of one order, with counts and sums."""

    def __init__(self, a, order: int, n_obs, s1):
        side = order + 1
        self.a = np.asarray(a, float).reshape(len(n_obs), -1, side, side)
        self.n_obs, self.s1 = np.asarray(n_obs, float), np.asarray(s1, float)

    def system(self, P: int, K: int):
        """Gram matrices (batch, m, m) and right-hand sides (batch, m), m = P (K + 1)."""
        p = np.repeat(np.arange(1, P + 1), K + 1)
        k = np.tile(np.arange(K + 1), P)
        gram = self.a[:, k[:, None] + k[None, :], p[:, None], p[None, :]]
        return gram, self.a[:, k, p, 0]

    def score(self, h, P: int, K: int):
        """RSS, R2, MSE, BIC of one-step predictions, without another data pass."""
        gram, rhs = self.system(P, K)
        yy = self.a[:, 0, 0, 0]
        fitted = (h * rhs).sum(axis=1)
        rss = np.maximum(0.0, yy - 2 * fitted + np.einsum("bi,bij,bj->b", h, gram, h))
        tss = yy - self.s1 ** 2 / self.n_obs
        mse = rss / self.n_obs
        bic = self.n_obs * np.log(mse + 1e-10) + P * (K + 1) * np.log(self.n_obs)
        return rss, 1.0 - rss / (tss + 1e-10), mse, bic


def fit_coefficients(m: LagMoments, P: int, K: int, ridge: float = RIDGE) -> np.ndarray:
    gram, rhs = m.system(P, K)
    return np.linalg.solve(gram + ridge * np.eye(rhs.shape[1]), rhs[:, :, None])[:, :, 0]


def fit_nested(m: LagMoments, P: int, k_grid, ridge: float = RIDGE) -> dict[int, np.ndarray]:
    """Coefficients for every K of one order P from a single factorisation.

    All K share the samples from P on, so with the unknowns in order of k a smaller
    K's system is a leading block of the largest one's. The Cholesky factor, its
    inverse and the forward substitution are nested in the same way; each K only
    substitutes back. (Orders P are not nested: a smaller one sums over more samples.)
    """
    k_max = max(k_grid)
    gram, rhs = m.system(P, k_max)
    order = np.arange(P * (k_max + 1)).reshape(P, k_max + 1).T.ravel()       # by k, then p
    gram, rhs = gram[:, order[:, None], order[None, :]], rhs[:, order]
    low = np.linalg.inv(np.linalg.cholesky(gram + ridge * np.eye(len(order))))
    forward = np.einsum("bij,bj->bi", low, rhs)
    out = {}
    for k in k_grid:
        n = P * (k + 1)
        h = np.einsum("bji,bj->bi", low[:, :n, :n], forward[:, :n])
        out[k] = h.reshape(-1, k + 1, P).transpose(0, 2, 1).reshape(-1, n)
    return out


def normal_residual(m: LagMoments, h, P: int, K: int, ridge: float = RIDGE) -> np.ndarray:
    """Largest error of the ridge system (G + ridge) h = v, as a share of the largest |v|."""
    gram, rhs = m.system(P, K)
    gap = np.einsum("bij,bj->bi", gram, h) + ridge * h - rhs
    return np.abs(gap).max(axis=1) / np.maximum(np.abs(rhs).max(axis=1), 1e-300)


def spectral_radius(h, lam, P: int, K: int) -> np.ndarray:
    """Largest companion root over the graph modes, one P x P block per model and mode."""
    powers = np.asarray(lam)[None, :] ** np.arange(K + 1)[:, None]
    taps = np.asarray(h).reshape(-1, P, K + 1) @ powers              # batch, P, mode
    if P == 1:
        roots = np.abs(taps)
    else:
        comp = np.zeros((len(taps), len(lam), P, P))
        comp[:, :, 0, :] = taps.transpose(0, 2, 1)
        comp[:, :, np.arange(1, P), np.arange(P - 1)] = 1.0
        roots = np.abs(np.linalg.eigvals(comp))
    roots = np.where(np.isfinite(roots), roots, -1.0).reshape(len(taps), -1).max(axis=1)
    return np.where(roots < 0, np.nan, roots)


def _null_model(P, K):
    return (P, K, None, None, None, None, None, None, None)


def _fit_batch(train, P, K, lam, score_on=None, h=None):
    """Model rows of one batch; a batch with a singular system is redone one by one.

    ``h`` are coefficients already at hand.
    """
    target = train if score_on is None else score_on
    try:
        h = fit_coefficients(train, P, K) if h is None else h
        rho = spectral_radius(h, lam, P, K)
    except np.linalg.LinAlgError:
        if len(train.a) == 1:
            return [_null_model(P, K)]
        side = train.a.shape[-1] - 1

        def one(m, x):
            return LagMoments(m.a[x:x + 1], side, m.n_obs[x:x + 1], m.s1[x:x + 1])

        return [_fit_batch(one(train, x), P, K, lam, one(target, x))[0]
                for x in range(len(train.a))]
    return [(P, K, hh, *map(float, (r,)), int(n), *map(float, rest)) for hh, r, n, *rest in
            zip(h, rho, target.n_obs, *target.score(h, P, K))]


def with_lambdas(df: DataFrame, basis: DataFrame, by: str | None = None) -> DataFrame:
    if by is None:
        return df.withColumn("lam", basis.select("lam").scalar())
    return df.join(basis.select(by, "lam"), by)


def fit_models(moments: DataFrame, basis: DataFrame, *, by: str | None = None,
               extra=()) -> DataFrame:
    """One model per moment row; the row needs a column K.

    Columns: keys, scope (lti or tv), window_idx, P, K, h, rho, n_obs, rss, r2,
    mse, bic.
    """
    keys = [*KEY, *extra, "window_idx"]
    types = dict(moments.dtypes)
    rows = with_lambdas(moments, basis, by)
    cols = [*keys, *(f.split()[0] for f in MODEL_FIELDS.split(", "))]

    def run(batches):
        for pdf in batches:
            pdf["_g"] = [np.asarray(x).tobytes() for x in pdf["lam"]]
            out = []
            for (P, K, _), part in pdf.groupby(["P", "K", "_g"], sort=False):
                m = LagMoments(np.stack(part["a"].to_numpy()), P, part["n_obs"], part["s1"])
                models = _fit_batch(m, P, K, part["lam"].iloc[0])
                out += [(*k, *row) for k, row in
                        zip(part[keys].itertuples(index=False, name=None), models)]
            yield pd.DataFrame(out, columns=cols)

    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    fitted = rows.mapInPandas(run, f"{schema}, {MODEL_FIELDS}")
    return fitted.select(
        *KEY, *extra, F.when(F.col("window_idx") < 0, "lti").otherwise("tv").alias("scope"),
        *[c for c in cols if c not in (*KEY, *extra)])


def lti_models(models: DataFrame, rho_limit: float = 1.0) -> DataFrame:
    return models.filter((F.col("scope") == "lti") & (F.col("rho") < rho_limit))


def tv_models(models: DataFrame, length: int, step: int, rho_limit: float = 0.99) -> DataFrame:
    """Stable window models with their sample span."""
    start = F.col("window_idx") * step
    return (models.filter((F.col("scope") == "tv") & (F.col("rho") < rho_limit))
            .withColumn("start_idx", start).withColumn("end_idx", start + length))


# -- model selection ----------------------------------------------------------

def model_grid(signals: DataFrame, basis: DataFrame, n_channels: int, p_grid, k_grid, *,
               by: str | None = None, val_scaling: str = "train", pane: int = 1024,
               rho_limit: float = 1.0) -> DataFrame:
    """Every (P, K) fitted on the first 70 % and scored on the next 15 %.

    One pass over the samples at the largest P serves the whole grid. Cells
    that cannot be fitted stay as rows with NULL results. ``val_scaling``:
    ``train`` scales the validation span by the training stats, ``reference``
    by the stats of the already standardised training span. ``residual`` is the
    relative error of a cell's normal equations.
    """
    p_grid, k_grid = sorted(p_grid), sorted(k_grid)
    p_max, k_max = p_grid[-1], k_grid[-1]
    pane = max(pane, p_max + 1)
    until, end = split_points(F.col("n_samples"))
    lengths = recording_lengths(signals)
    train = recording_stats(signals, n_channels, until, lengths)
    if val_scaling == "train":
        val = train
    elif val_scaling == "reference":
        val = restandardised_stats(signals, train, until, n_channels)
    else:
        raise ValueError(f"unknown val_scaling {val_scaling!r}")
    stats = train.select(*KEY, F.lit("train").alias("split"), until.alias("n_samples"), "mu", "sd") \
        .unionByName(val.select(*KEY, F.lit("val").alias("split"), (end - until).alias("n_samples"),
                                "mu", "sd"))
    rows = signals.join(lengths.select("subject_id", "n_samples"), "subject_id").filter(F.col("t") < end).select(
        *KEY, "channel", "value",
        F.when(F.col("t") < until, "train").otherwise("val").alias("split"),
        F.when(F.col("t") < until, F.col("t")).otherwise(F.col("t") - until).alias("t"))
    blocks = pane_blocks(rows, stats, basis, pane, p_max,
                         F.array(*[F.lit(p) for p in p_grid]), by, extra=("split",))
    parts = pane_moments(blocks, k_max, pane, grid=True, extra=("split",))
    sums = sum_moments(parts, [*KEY, "split", "part", "P"])

    # model-sized from here on: pack the two splits of a subject side by side
    packed = sums.groupBy(*KEY).agg(F.collect_list(
        F.struct("split", "part", "P", "n_obs", "s1", "a")).alias("m"))
    # a subject too short for any cell keeps its (empty) grid
    rows = with_lambdas(train.select(*KEY).join(packed, KEY, "left"), basis, by)
    cols = [*KEY, *(f.split()[0] for f in MODEL_FIELDS.split(", ")), "residual"]

    def merged(found, split, p):
        """(a, n_obs, s1) of one split at order p, or None when it is too short."""
        tail = found.get((split, "tail", p))
        if tail is None:
            return None
        a = np.asarray(tail["a"]).reshape(-1, p + 1, p + 1)
        n_obs, s1 = tail["n_obs"], tail["s1"]
        rest = found.get((split, "whole", p_max))
        if rest is not None:
            b = np.asarray(rest["a"]).reshape(-1, p_max + 1, p_max + 1)
            a = a + b[:, :p + 1, :p + 1]
            n_obs, s1 = n_obs + rest["n_obs"], s1 + rest["s1"]
        return a, n_obs, s1

    def batch(parts, p):
        a, n_obs, s1 = zip(*parts)
        return LagMoments(np.stack(a), p, n_obs, s1)

    def run(batches):
        for pdf in batches:
            pdf["_g"] = [np.asarray(x).tobytes() for x in pdf["lam"]]
            out = []
            for _, part in pdf.groupby("_g", sort=False):
                lam = part["lam"].iloc[0]
                ids = list(zip(part["subject_id"], part["grp"]))
                found = [{(e["split"], e["part"], e["P"]): e for e in ([] if m is None else m)}
                         for m in part["m"]]
                for p in p_grid:
                    pairs = [(merged(f, "train", p), merged(f, "val", p)) for f in found]
                    ok = [x for x, (tr, va) in enumerate(pairs) if tr is not None and va is not None]
                    if ok:
                        tr = batch([pairs[x][0] for x in ok], p)
                        va = batch([pairs[x][1] for x in ok], p)
                        try:
                            nested = fit_nested(tr, p, k_grid)
                        except np.linalg.LinAlgError:
                            nested = {}
                    for k in k_grid:
                        cells = dict.fromkeys(range(len(ids)), (*_null_model(p, k), None))
                        if ok:
                            fitted = _fit_batch(tr, p, k, lam, va, nested.get(k))
                            h = [np.full(p * (k + 1), np.nan) if f[2] is None else f[2] for f in fitted]
                            off = normal_residual(tr, np.stack(h), p, k)
                            cells |= {x: (*f, None if np.isnan(r) else float(r)) for x, f, r in zip(ok, fitted, off)}
                        out += [(*ids[x], *cells[x]) for x in range(len(ids))]
            yield pd.DataFrame(out, columns=cols)

    grid = rows.mapInPandas(run, f"subject_id string, grp string, {MODEL_FIELDS}, residual double")
    stable = F.coalesce((F.col("rho") < rho_limit) & ~F.isnan("rho"), F.lit(False))
    return grid.withColumn("stable", stable).withColumn("success", F.col("bic").isNotNull())


def select_model(grid: DataFrame, fallback=(5, 2)) -> DataFrame:
    """Lowest BIC among the stable cells; K before P on ties; else the fallback."""
    best = F.min_by(F.struct("P", "K", "bic"), F.when(
        F.col("stable"), F.struct("bic", "K", "P")))
    pick = grid.groupBy(*KEY).agg(best.alias("b"), F.max("stable").alias("any"))
    ok = F.col("any")
    return pick.select(
        *KEY, F.when(ok, F.col("b.P")).otherwise(F.lit(fallback[0])).alias("P"),
        F.when(ok, F.col("b.K")).otherwise(F.lit(fallback[1])).alias("K"),
        F.when(ok, F.col("b.bic")).alias("best_bic"), (~ok).alias("is_fallback"))


def selection_matrix(grid: DataFrame, p_grid, value: str = "bic") -> DataFrame:
    """K x P pivot of one score; unstable cells are NULL."""
    shown = F.when(F.col("stable"), F.col(value))
    out = (grid.withColumn("_v", shown).groupBy(*KEY, "K")
           .pivot("P", list(p_grid)).agg(F.first("_v")))
    for p in p_grid:
        out = out.withColumnRenamed(str(p), f"P{p}")
    return out


# -- coefficients over windows --------------------------------------------------

def coefficient_variation(tv: DataFrame) -> DataFrame:
    """Mean, sd and cv of every coefficient over the windows of a subject."""
    return (tv.select(*KEY, F.posexplode("h").alias("coef", "v")).groupBy(*KEY, "coef")
            .agg(F.avg("v").alias("h_mean"), F.stddev_pop("v").alias("h_std"))
            .withColumn("h_cv", F.col("h_std") / (F.abs("h_mean") + 1e-8)))


def global_coefficient_cv(tv: DataFrame) -> DataFrame:
    return coefficient_variation(tv).groupBy(*KEY).agg(F.avg("h_cv").alias("global_coeff_cv"))


def window_summary(tv: DataFrame) -> DataFrame:
    return tv.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_windows"), F.avg("r2").alias("tv_r2_mean"),
        F.stddev_pop("r2").alias("tv_r2_std"), F.avg("rho").alias("tv_rho_mean"),
        F.stddev_pop("rho").alias("tv_rho_std"))
