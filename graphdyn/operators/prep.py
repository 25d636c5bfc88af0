"""Signal preparation on the long table (subject_id, grp, channel, t, value): spans, windows, panes, lags.

What works on whole blocks of samples (fill, reference, z-score, filter, shift) is in ``blocks``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphdyn.session import sized

KEY = ["subject_id", "grp"]


def recording_lengths(signals: DataFrame) -> DataFrame:
    """Recording length per subject: last sample index + 1."""
    return signals.groupBy("subject_id").agg((F.max("t") + 1).alias("n_samples"))


def checked_channels(signals: DataFrame, n_channels: int) -> DataFrame:
    """``signals``, failing on a channel outside 0..n_channels-1.

    ``plans.cohort.channel_compatibility`` rejects such recordings beforehand.
    """
    c = F.col("channel")
    stray = F.raise_error(F.concat(F.lit(f"channel outside 0..{n_channels - 1}: "), c.cast("string")))
    return signals.withColumn("channel", F.when((c >= 0) & (c < n_channels), c).otherwise(
        stray.cast("int")))


def split_points(T: Column) -> tuple[Column, Column]:
    """Sample indices that end the training and the validation span."""
    return F.floor(F.lit(0.70) * T), F.floor(F.lit(0.85) * T)


def temporal_split(signals: DataFrame) -> DataFrame:
    """Adds ``split``: train, val, or NULL for the unused rest."""
    train, val = split_points(F.col("n_samples"))
    return (signals.join(sized(recording_lengths(signals)), "subject_id")
            .withColumn("split", F.when(F.col("t") < train, "train")
                        .when(F.col("t") < val, "val")).drop("n_samples"))


def sliding_windows(signals: DataFrame, length: int, step: int) -> DataFrame:
    """Rows repeated for each full window that holds them.

    Windows start at sample 0; one that would pass the end is not formed.
    """
    joined = signals.join(sized(recording_lengths(signals)), "subject_id")
    last = F.floor((F.col("n_samples") - length) / step)
    first_w = F.greatest(F.lit(0), F.floor((F.col("t") - length) / step) + 1)
    last_w = F.least(F.floor(F.col("t") / step), last)
    return (joined.filter((F.col("n_samples") >= length) & (first_w <= last_w))
            .withColumn("window_idx", F.explode(F.sequence(first_w, last_w)))
            .withColumn("start_idx", F.col("window_idx") * step)
            .withColumn("end_idx", F.col("start_idx") + length).drop("n_samples"))


def resample_mean(signals: DataFrame, fs_old: float, fs_new: float) -> DataFrame:
    """Bucket means at the new rate; a no-op when the rates agree.

    This is block averaging, not Fourier resampling.
    """
    if fs_old == fs_new:
        return signals
    bucket = F.floor(F.col("t") * F.lit(fs_new / fs_old))
    return (signals.groupBy(*KEY, "channel", bucket.alias("t"))
            .agg(F.avg("value").alias("value")))


def bandpass_taps(low: float, high: float, fs: float, half: int) -> list[float]:
    """Symmetric windowed-sinc band-pass taps h[-half..half], Hamming window."""
    def lowpass(fc, m):
        x = 2 * fc / fs
        return x if m == 0 else math.sin(math.pi * x * m) / (math.pi * m)
    return [(lowpass(high, m) - lowpass(low, m))
            * (0.54 + 0.46 * math.cos(math.pi * m / max(1, half)))
            for m in range(-half, half + 1)]


def halo_panes(signals: DataFrame, pane: int, before: int, after: int = 0) -> DataFrame:
    """Rows repeated into each pane whose extended span holds them.

    Pane p covers [p*pane, (p+1)*pane) plus ``before`` samples ahead of it and
    ``after`` behind it. ``home`` marks the row's own pane. Panes keep every
    order-dependent step local to a bounded stretch of one recording.
    """
    own = F.floor(F.col("t") / pane)
    low = F.greatest(F.lit(0), F.floor((F.col("t") - after) / pane))
    return (signals.withColumn("pane", F.explode(F.sequence(
        low, F.floor((F.col("t") + before) / pane))))
        .withColumn("home", F.col("pane") == own))


def lagged(signals: DataFrame, order: int, pane: int = 4096) -> DataFrame:
    """Adds lag_1..lag_order of each channel; NULL where the earlier sample is absent."""
    out = halo_panes(signals, pane, order)
    w = Window.partitionBy("subject_id", "channel", "pane").orderBy("t")
    for p in range(1, order + 1):
        # by sample index, not by row: the p-th earlier row may be an older sample
        out = out.withColumn(f"lag_{p}", F.max("value").over(w.rangeBetween(-p, -p)))
    return out.filter("home").drop("pane", "home")
