"""Scalar column functions. All are built-in Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphdyn.schema import BANDS, FISHER_CLIP, SD_FLOOR, Z_CLIP


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def nan_to_num(x) -> Column:
    """NULL, NaN and both infinities become 0."""
    x = _c(x)
    bad = x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(x)


def nan_to_null(x) -> Column:
    x = _c(x)
    return F.when(~F.isnan(x), x)


def clip(x, lo: float, hi: float) -> Column:
    return F.greatest(F.least(_c(x), F.lit(float(hi))), F.lit(float(lo)))


def fisher_z(r) -> Column:
    return F.atanh(clip(r, -FISHER_CLIP, FISHER_CLIP))


def fisher_z_inv(z) -> Column:
    return F.tanh(_c(z))


def floored_sd(sd) -> Column:
    sd = _c(sd)
    return F.when(sd < SD_FLOOR, F.lit(SD_FLOOR)).otherwise(sd)


def zscore_value(x, mu, sd) -> Column:
    """(x - mu) / max(sd, floor), NaN to 0, clipped."""
    z = (_c(x) - _c(mu)) / floored_sd(sd)
    return F.when(z.isNull() | F.isnan(z), F.lit(0.0)).otherwise(clip(z, -Z_CLIP, Z_CLIP))


# -- identifiers ------------------------------------------------------------

def file_stem(path) -> Column:
    base = F.regexp_extract(_c(path), r"([^/]+)$", 1)
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def subject_id_from_path(path, rule: str = "strip") -> Column:
    """Subject id of a recording path.

    ``strip``  file stem without the recording prefix and suffixes
    ``bids``   first directory that starts with ``sub-``, else the stem
    ``stem``   plain stem
    """
    stem = file_stem(path)
    if rule == "strip":
        # Decorations removed from a file stem.
        for token in ("s6_", "_rs-hep_eeg", "_rs_eeg"):
            stem = F.replace(stem, F.lit(token), F.lit(""))
        return stem
    if rule == "bids":
        part = F.regexp_extract(_c(path), r"(?:^|/)(sub-[^/]*)", 1)
        return F.when(part != "", part).otherwise(stem)
    if rule == "stem":
        return stem
    raise ValueError(f"unknown rule {rule!r}")


def group_from_path(path, labels=("AD", "HC"), depth: int = 1) -> Column:
    """Label contained in the upper-cased name of the enclosing directory, else NULL.

    With ``depth`` > 1 the next outer directories are tried in turn.
    """
    parts = F.split(_c(path), "/")
    found = []
    for level in range(depth):
        name = F.upper(F.get(parts, F.size(parts) - 2 - level))
        hit = F.lit(None).cast("string")
        for label in reversed(labels):
            hit = F.when(name.contains(label.upper()), F.lit(label)).otherwise(hit)
        found.append(hit)
    return F.coalesce(*found)


# -- labels and verdicts (fixed values: words and thresholds) ----------------------------------------------------

def significance_stars(p) -> Column:
    p = _c(p)
    return (F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("ns"))


def effect_label(d) -> Column:
    a = F.abs(_c(d))
    return F.when(a < 0.5, "small").when(a < 0.8, "medium").otherwise("large")


def direction_label(mean_a, mean_b, a: str = "A", b: str = "B") -> Column:
    return F.when(_c(mean_a) > _c(mean_b), f"{a} > {b}").otherwise(f"{b} > {a}")


def significant_only(df: DataFrame, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    return df.filter(F.col(p) < alpha)


def trends_only(df: DataFrame, p: str = "p_value", alpha: float = 0.05,
                limit: float = 0.10) -> DataFrame:
    return df.filter((F.col(p) >= alpha) & (F.col(p) < limit))


def similarity_verdict(r, jaccard) -> Column:
    r, jac = _c(r), _c(jaccard)
    return (F.when((r > 0.7) & (jac > 0.5), "SIMILAR")
            .when(r > 0.5, "MODERATE").otherwise("DIFFERENT"))


def overlap_verdict(jaccard) -> Column:
    jac = _c(jaccard)
    return F.when(jac > 0.5, "Good").when(jac > 0.3, "OK").otherwise("Low")


def validation_verdict(mean_a, mean_b) -> Column:
    a, b = _c(mean_a), _c(mean_b)
    return (F.when((a > 0.5) & (b > 0.5), "VALIDATED")
            .when((a > 0.3) & (b > 0.3), "MODERATE").otherwise("WEAK"))


def groups_differ(r) -> Column:
    return _c(r) < 0.5


def metric_verdicts(r, cosine, jaccard, frobenius) -> dict[str, Column]:
    """One label per metric and the overall call on a pair of graphs."""
    r, cos, jac, fro = _c(r), _c(cosine), _c(jaccard), _c(frobenius)

    def label(flag):
        return F.when(flag, "DIFFERENT").otherwise("SIMILAR")

    return {
        "verdict_r": label(r < 0.7),
        "verdict_cosine": label(cos < 0.8),
        "verdict_jaccard": label(jac < 0.5),
        "verdict_frobenius": label(fro > 0.3),
        "verdict_overall": label(~((r > 0.7) & (jac > 0.5))),
    }


def boundary_flags(p, k, p_grid, k_grid) -> dict[str, Column]:
    p, k = _c(p), _c(k)
    return {
        "p_at_lower": p == min(p_grid),
        "p_at_upper": p == max(p_grid),
        "k_at_lower": k == min(k_grid),
        "k_at_upper": k == max(k_grid),
    }


# -- frequency axis ---------------------------------------------------------

def with_freq_grid(df: DataFrame, n_omega: int, fs) -> DataFrame:
    """Repeats each row for omega on [0, pi], both ends included.

    Adds omega_idx, omega and freq_hz; ``fs`` is a number or a column.
    """
    rate = F.lit(float(fs)) if isinstance(fs, (int, float)) else fs
    return (df.withColumn("omega_idx", F.explode(F.sequence(F.lit(0), F.lit(n_omega - 1))))
            .withColumn("omega", F.col("omega_idx") * F.lit(math.pi / (n_omega - 1)))
            .withColumn("freq_hz", F.col("omega") * rate / F.lit(2 * math.pi)))


def bands_of(freq) -> Column:
    """Array of the bands that hold a frequency; shared ends give two bands."""
    f = _c(freq)
    hits = [F.when((f >= lo) & (f <= hi), F.lit(name)) for name, lo, hi in BANDS]
    return F.array_compact(F.array(*hits))


def resolve_sparsity(spec, mean_subject_sparsity: float | None = None) -> float | None:
    """Target edge fraction: a number in (0, 1], a named rule, or None for dense."""
    if spec is None:
        return None
    if isinstance(spec, str):
        if spec.strip().lower() not in {"match_subject", "subject_mean", "mean_subject"}:
            raise ValueError(f"unrecognised sparsity rule {spec!r}")
        if mean_subject_sparsity is None:
            raise ValueError("the mean subject sparsity is not known yet")
        return mean_subject_sparsity
    value = float(spec)
    if not 0 < value <= 1:
        raise ValueError("sparsity must lie in (0, 1]")
    return value
