"""Transfer functions G(omega, lambda) and their comparison over windows.

Whole analyses evaluate a model row as arrays (``surface_pass``) and keep one
distance per window and mergeable sums per cell, so no surface is ever a table.
Where the surface itself is the result, a model row is expanded by two
generators and reduced again in the same stage. The whole-recording model
travels next to each window model on the model-sized row, which replaces a
surface-sized join.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphdyn.functions.scalars import with_freq_grid
from graphdyn.operators.graph_var import with_lambdas
from graphdyn.operators.moments import KEY
from graphdyn.session import sized, spread

MODEL_KEY = [*KEY, "scope", "window_idx"]


def _taps(h: str, P: str, K: str) -> Column:
    """H_p(lambda) for every mode: array over modes of arrays over p."""
    width = F.col(K) + 1

    def at_mode(lam):
        def at_lag(p):
            return F.aggregate(
                F.sequence(F.lit(0), F.col(K)), F.lit(0.0),
                lambda acc, k: acc + F.get(F.col(h), (p * width + k).cast("int"))
                * F.pow(lam, k))
        return F.transform(F.sequence(F.lit(0), F.col(P) - 1), at_lag)

    return F.transform("lam", at_mode)


def _denominator(taps: Column, p_max: int) -> tuple[Column, Column]:
    """Real and imaginary part of 1 - sum_p H_p e^{-i omega p}."""
    def term(p, trig):
        return F.coalesce(F.get(taps, F.lit(p - 1)), F.lit(0.0)) * F.get(trig, F.lit(p - 1))

    re, im = F.lit(1.0), F.lit(0.0)
    for p in range(1, p_max + 1):
        re = re - term(p, F.col("_cos"))
        im = im + term(p, F.col("_sin"))
    return re, im


def _guarded(re: Column, im: Column, guard: str) -> tuple[Column, Column]:
    size = F.hypot(re, im)
    if guard == "add":
        return F.when(size < 1e-3, re + 1e-3).otherwise(re), im
    if guard == "rescale":
        # the tiny offset keeps an exact zero finite
        scale = F.when(size < 1e-3, 1e-3 / (size + 1e-10)).otherwise(1.0)
        return re * scale, im * scale
    if guard in {"fail", "none"}:
        return re, im
    raise ValueError(f"unknown guard {guard!r}")


def _expand(rows: DataFrame, keep, taps: dict[str, Column], n_omega: int, fs: float,
            p_max: int, guard: str) -> DataFrame:
    """Model rows to (keep, omega_idx, freq_hz, mode, lambda, <name>_re, <name>_im)."""
    lags = F.sequence(F.lit(1), F.lit(p_max))
    rows = spread(rows, *keep)
    grid = with_freq_grid(rows.withColumns({f"_h_{n}": c for n, c in taps.items()}), n_omega, fs) \
        .withColumns({"_cos": F.transform(lags, lambda p: F.cos(F.col("omega") * p)),
                      "_sin": F.transform(lags, lambda p: F.sin(F.col("omega") * p))})
    zipped = F.arrays_zip("lam", *[f"_h_{n}" for n in taps])
    cells = grid.select(*keep, "omega_idx", "omega", "freq_hz", "_cos", "_sin",
                        F.posexplode(zipped).alias("mode", "z"))
    out = [*keep, "omega_idx", "omega", "freq_hz", "mode", F.col("z.lam").alias("lambda")]
    for n in taps:
        re, im = _guarded(*_denominator(F.col(f"z._h_{n}"), p_max), guard)
        out += [re.alias(f"{n}_re"), im.alias(f"{n}_im")]
    return cells.select(*out)


def transfer_function(models: DataFrame, basis: DataFrame, *, n_omega: int = 128,
                      fs: float = 100.0, guard: str = "add", p_max: int = 20,
                      by: str | None = None, extra=()) -> DataFrame:
    """One row per (model, omega, mode): re, im, mag, phase (NULL exactly at a pole).

    ``guard`` near a pole: ``add`` shifts the denominator, ``rescale`` lifts
    its magnitude to 1e-3, ``fail`` drops a model that comes closer than 1e-6
    or gains more than 1000, ``none`` does nothing.
    """
    key = [*KEY, *extra, "scope", "window_idx"]
    rows = with_lambdas(models, basis, by)
    cells = _expand(rows, key, {"d": _taps("h", "P", "K")}, n_omega, fs, p_max, guard)
    re, im = F.col("d_re"), F.col("d_im")
    if guard == "fail":
        low = cells.groupBy(*key).agg(F.min(F.hypot(re, im)).alias("m"))
        ok = low.filter((F.col("m") >= 1e-6) & (1 / (F.col("m") + 1e-10) <= 1000)).select(*key)
        cells = cells.join(ok, key, "left_semi")
    power = re * re + im * im
    finite = power > 0
    return cells.select(
        *key, "omega_idx", "omega", "freq_hz", "mode", "lambda",
        F.when(finite, re / power).alias("re"), F.when(finite, -im / power).alias("im"),
        F.when(finite, 1 / F.sqrt(power)).alias("mag"),
        F.when(finite, F.atan2(-im, re)).alias("phase"))


def paired_models(tv: DataFrame, lti: DataFrame, basis: DataFrame, by: str | None = None,
                  extra=()) -> DataFrame:
    """Each window model beside its whole-recording model (h0, P0, K0) and the eigenvalues."""
    key = [*KEY, *extra]
    one = sized(lti.select(*key, F.col("h").alias("h0"), F.col("P").alias("P0"),
                           F.col("K").alias("K0")))
    return with_lambdas(tv.select(*key, "window_idx", "h", "P", "K").join(one, key), basis, by)


def paired_surface(tv: DataFrame, lti: DataFrame, basis: DataFrame, *, n_omega: int = 128,
                   fs: float = 100.0, guard: str = "add", p_max: int = 20,
                   by: str | None = None, extra=()) -> DataFrame:
    """Window gain beside the whole-recording gain: g_tv and g_lti per cell.

    The join is between model rows on the subject; both surfaces are then
    produced from the same row.
    """
    key = [*KEY, *extra]
    rows = paired_models(tv, lti, basis, by, extra)
    cells = _expand(rows, [*key, "window_idx"],
                    {"w": _taps("h", "P", "K"), "l": _taps("h0", "P0", "K0")},
                    n_omega, fs, p_max, guard)
    return cells.select(
        *key, "window_idx", "omega_idx", "freq_hz", "mode", "lambda",
        *[F.when(F.hypot(f"{n}_re", f"{n}_im") > 0, 1 / F.hypot(f"{n}_re", f"{n}_im")).alias(g)
          for n, g in (("w", "g_tv"), ("l", "g_lti"))])


def gains(h, P: int, K: int, lam, omega, guard: str):
    """|G| of one model on the grid (omega, mode) as an array; NaN exactly at a pole."""
    taps = np.vander(lam, K + 1, increasing=True) @ np.reshape(h, (P, K + 1)).T
    den = 1 - np.exp(-1j * np.outer(omega, np.arange(1, P + 1))) @ taps.T
    size = np.abs(den)
    if guard == "add":
        size = np.where(size < 1e-3, np.abs(den + 1e-3), size)
    elif guard == "rescale":
        size = np.where(size < 1e-3, size * (1e-3 / (size + 1e-10)), size)
    elif guard not in {"fail", "none"}:
        raise ValueError(f"unknown guard {guard!r}")
    return np.divide(1.0, size, out=np.full(size.shape, np.nan), where=size > 0)


def gains_of_many(h, P: int, K: int, lam, omega, guard: str):
    """``gains`` of several models of one order: an array (omega, model, mode)."""
    taps = np.reshape(h, (-1, P, K + 1)) @ np.vander(lam, K + 1, increasing=True).T
    flat = taps.transpose(1, 0, 2).reshape(P, -1)
    angle = np.outer(omega, np.arange(1, P + 1))
    re, im = 1 - np.cos(angle) @ flat, np.sin(angle) @ flat
    size = np.sqrt(re * re + im * im)
    small = size < 1e-3
    if guard == "add":
        size[small] = np.hypot(re[small] + 1e-3, im[small])
    elif guard == "rescale":
        size[small] *= 1e-3 / (size[small] + 1e-10)
    elif guard not in {"fail", "none"}:
        raise ValueError(f"unknown guard {guard!r}")
    out = np.divide(1.0, size, out=np.full(size.shape, np.nan), where=size > 0)
    return out.reshape(len(omega), len(taps), len(lam))


def surface_pass(rows: DataFrame, *, n_omega: int = 128, guard: str = "add", extra=(),
                 surface: bool = True) -> DataFrame:
    """One pass over model rows (``paired_models``), evaluated as arrays.

    Rows with ``window_idx``: that window's mean squared distance ``msd``.
    Other rows (only with ``surface``): per (omega, mode) the count, mean and
    centred square sum of the window gains of one Arrow batch, and the LTI gain.
    Both kinds come from the same evaluation; write the result before using
    ``pass_msd`` and ``pass_stats`` on it.
    """
    key = [*KEY, *extra]
    kinds = {"subject_id": "string", "grp": "string", "surrogate": "int"}
    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + (
        ", window_idx long, msd double, lam array<double>, g_lti array<double>, n array<long>,"
        " mean array<double>, m2 array<double>")
    omega = np.arange(n_omega) * (np.pi / (n_omega - 1))

    def run(batches):
        for pdf in batches:
            out = []
            for name, part in pdf.groupby(key, sort=False):
                first = part.iloc[0]
                lam = np.asarray(first["lam"])
                base = gains(first["h0"], first["P0"], first["K0"], lam, omega, guard)
                n = np.zeros(base.shape, np.int64)
                mean, m2 = np.zeros(base.shape), np.zeros(base.shape)
                for row in part.itertuples(index=False):
                    g = gains(row.h, row.P, row.K, lam, omega, guard)
                    gap = (g - base) ** 2
                    seen = ~np.isnan(gap)
                    out.append((*name, row.window_idx, gap[seen].mean() if seen.any() else None,
                                *[None] * 5))
                    ok = ~np.isnan(g)
                    n += ok
                    step = np.where(ok, g - mean, 0.0)
                    mean += step / np.maximum(n, 1)
                    m2 += step * np.where(ok, g - mean, 0.0)
                if surface:
                    out.append((*name, None, None, lam, base.ravel(), n.ravel(), mean.ravel(), m2.ravel()))
            if out:
                yield pd.DataFrame(out, columns=[*key, "window_idx", "msd", "lam", "g_lti", "n", "mean", "m2"]
                                   ).astype({"window_idx": "Int64"})

    # by window, so a subject with many windows is many tasks
    return spread(rows, *key, "window_idx").mapInPandas(run, schema)


def window_distances(rows: DataFrame, *, n_omega: int = 128, guard: str = "add") -> DataFrame:
    """Window models packed in ``h`` against ``h0``: (keys, surrogate, n, n_valid, total).

    ``n`` counts the windows, ``total`` adds up the mean squared distances of the
    ``n_valid`` ones that have any.
    """
    omega = np.arange(n_omega) * (np.pi / (n_omega - 1))
    cols = [*KEY, "surrogate", "n", "n_valid", "total"]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                lam, m = np.asarray(row.lam), row.P * (row.K + 1)
                base = gains(row.h0, row.P, row.K, lam, omega, guard)
                h, valid, total = np.reshape(row.h, (-1, m)), 0, 0.0
                for k in range(0, len(h), 64):
                    gap = (gains_of_many(h[k:k + 64], row.P, row.K, lam, omega, guard) - base[:, None]) ** 2
                    seen = ~np.isnan(gap)
                    cells = seen.sum(axis=(0, 2))
                    some = cells > 0
                    valid += int(some.sum())
                    total += float((np.where(seen, gap, 0.0).sum(axis=(0, 2))[some] / cells[some]).sum())
                out.append((row.subject_id, row.grp, row.surrogate, len(h), valid, total))
            yield pd.DataFrame(out, columns=cols)

    return rows.mapInPandas(run, "subject_id string, grp string, surrogate int, n long, n_valid long, total double")


def pass_msd(parts: DataFrame, extra=()) -> DataFrame:
    return parts.filter("window_idx is not null").select(*KEY, *extra, "window_idx", "msd")


def pass_stats(parts: DataFrame, n_omega: int = 128, fs: float = 100.0, extra=()) -> DataFrame:
    """The columns of ``surface_stats``, from the partial sums."""
    key = [*KEY, *extra]
    cells = parts.filter("window_idx is null").select(*key, "lam", F.posexplode(
        F.arrays_zip("g_lti", "n", "mean", "m2")).alias("cell", "z"))
    modes = F.size("lam")
    mode = (F.col("cell") % modes).cast("int")
    cells = cells.select(*key, F.floor(F.col("cell") / modes).cast("int").alias("omega_idx"),
                         mode.alias("mode"), F.get("lam", mode).alias("lambda"), "z.*")
    mean = F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    spread_ = F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean")) / F.sum("n") - mean * mean
    out = cells.groupBy(*key, "omega_idx", "mode").agg(
        F.first("lambda").alias("lambda"), F.max("g_lti").alias("g_lti"), mean.alias("tv_mean"),
        F.greatest(spread_, F.lit(0.0)).alias("tv_var"), F.sum("n").alias("n_windows"))
    hz = F.col("omega_idx") * F.lit(float(fs) / (2 * (n_omega - 1)))
    return out.select(*key, "omega_idx", "mode", hz.alias("freq_hz"), "lambda",
                      F.when(~F.isnan("g_lti"), F.col("g_lti")).alias("g_lti"), "tv_mean",
                      F.sqrt("tv_var").alias("tv_std"), "tv_var", "n_windows")


def mean_msd(windows: DataFrame, extra=()) -> DataFrame:
    return windows.groupBy(*KEY, *extra).agg(
        F.avg("msd").alias("global_msd"), F.count(F.lit(1)).alias("n_windows"))


def join_surfaces(tf: DataFrame) -> DataFrame:
    """The same pairing as a join of two surfaces held in one table."""
    lti = tf.filter("scope = 'lti'").select(*KEY, "omega_idx", "mode",
                                            F.col("mag").alias("g_lti"))
    tv = tf.filter("scope = 'tv'").withColumnRenamed("mag", "g_tv")
    return tv.join(lti, [*KEY, "omega_idx", "mode"])


# -- reductions of the paired surface --------------------------------------------

def surface_stats(paired: DataFrame, extra=()) -> DataFrame:
    """Mean, sd and variance over windows at each (omega, mode)."""
    return (paired.groupBy(*KEY, *extra, "omega_idx", "mode").agg(
        F.first("freq_hz").alias("freq_hz"), F.first("lambda").alias("lambda"),
        F.first("g_lti").alias("g_lti"), F.avg("g_tv").alias("tv_mean"),
        F.stddev_pop("g_tv").alias("tv_std"), F.var_pop("g_tv").alias("tv_var"),
        F.count(F.lit(1)).alias("n_windows")))


def msd_per_window(paired: DataFrame, extra=()) -> DataFrame:
    d = F.col("g_tv") - F.col("g_lti")
    return paired.groupBy(*KEY, *extra, "window_idx").agg(F.avg(d * d).alias("msd"))


def global_msd(paired: DataFrame, extra=()) -> DataFrame:
    return mean_msd(msd_per_window(paired, extra), extra)


def marginals(paired: DataFrame) -> DataFrame:
    """Per-mode and per-frequency means, and the sd over windows of the window means.

    Both margins of every window come from one pass with grouping sets.
    """
    per_window = paired.groupingSets(
        [[F.col("subject_id"), F.col("grp"), F.col("window_idx"), F.col("mode")],
         [F.col("subject_id"), F.col("grp"), F.col("window_idx"), F.col("omega_idx")]],
        F.col("subject_id"), F.col("grp"), F.col("window_idx"), F.col("mode"),
        F.col("omega_idx"),
    ).agg(F.avg("g_tv").alias("g_tv"), F.avg("g_lti").alias("g_lti"))
    axis = F.when(F.col("mode").isNotNull(), "mode").otherwise("freq")
    return (per_window.withColumn("axis", axis)
            .withColumn("idx", F.coalesce("mode", "omega_idx"))
            .groupBy(*KEY, "axis", "idx")
            .agg(F.avg("g_lti").alias("g_lti"), F.avg("g_tv").alias("tv_mean"),
                 F.stddev_pop("g_tv").alias("tv_std")))


def tf_cv(surface: DataFrame, threshold: float = 0.1) -> DataFrame:
    """Mean of sd / (mean + 1e-8) over the surface; above the threshold = varying."""
    cv = F.avg(F.col("tv_std") / (F.col("tv_mean") + 1e-8))
    return surface.groupBy(*KEY).agg(cv.alias("mean_cv")).withColumn(
        "cv_time_varying", F.col("mean_cv") > threshold)


def confidence_band(surface: DataFrame) -> DataFrame:
    """mean +- 1.96 sd / sqrt(W) per cell, and whether the LTI gain lies outside."""
    margin = 1.96 * F.col("tv_std") / F.sqrt("n_windows")
    lo, hi = F.col("tv_mean") - margin, F.col("tv_mean") + margin
    return (surface.withColumn("ci_lower", lo).withColumn("ci_upper", hi)
            .withColumn("outside", (F.col("g_lti") < F.col("ci_lower"))
                        | (F.col("g_lti") > F.col("ci_upper"))))


def mode_confidence_band(paired: DataFrame) -> DataFrame:
    """The band of the per-mode line: window means over frequency, sd over windows."""
    line = paired.groupBy(*KEY, "window_idx", "mode").agg(
        F.avg("g_tv").alias("tv"), F.avg("g_lti").alias("lti"))
    out = line.groupBy(*KEY, "mode").agg(
        F.first("lti").alias("g_lti"), F.avg("tv").alias("tv_mean"),
        F.stddev_pop("tv").alias("tv_std"), F.count(F.lit(1)).alias("n_windows"))
    return confidence_band(out)


def surface_summary(surface: DataFrame, extra=()) -> DataFrame:
    """Per subject: mean variance over windows and the share outside the band."""
    return confidence_band(surface).groupBy(*KEY, *extra).agg(
        F.avg("tv_var").alias("global_variance"),
        F.avg(F.col("outside").cast("double")).alias("outside_ci_fraction"))
