"""Signal preparation in block form: one row per (subject, block) with all channels as one array.

Gap filling, reference, z-score, filter and circular shift work on the same
blocks of ``SIZE`` samples, so a chain of them gathers the samples once: the
long table is dealt out by (subject, block) with a halo for the filter, and all
steps run where a block is filled. Channel statistics need a look at all blocks
before the scaling step; that first pass fills the same exchange's blocks again
and sends back three numbers a channel. Nothing sample-sized is written.

Blocks are bounded by (SIZE + halo) x channels. Lengths and statistics reach them
as one small row per (subject, block), so that no recording is a single join key.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphdyn.operators.prep import checked_channels, halo_panes
from graphdyn.schema import SD_FLOOR, Z_CLIP
from graphdyn.session import spread

KEY = ["subject_id", "grp"]
#: Samples of a block.
SIZE = 4096
_BLOCK = "subject_id string, grp string, block long, n_samples long, first long, width int, x array<double>"


def fill(pdf: pd.DataFrame, n_channels: int, first: int, stop: int) -> np.ndarray:
    """Channels x samples first..stop-1; absent, null and non-finite cells are 0."""
    x = np.zeros((n_channels, stop - first))
    if len(pdf):
        x[pdf["channel"].to_numpy(), pdf["t"].to_numpy() - first] = pdf["value"].to_numpy(float)
    return np.nan_to_num(x, nan=0.0, posinf=0.0, neginf=0.0)


def referenced(x: np.ndarray, reference) -> np.ndarray:
    """``x`` less the mean of all channels (``average``, ``REST``) or of a list of channels."""
    if reference is None:
        return x
    if isinstance(reference, str):
        if reference.upper() not in {"AVERAGE", "REST"}:
            raise ValueError(f"unknown reference {reference!r}")
        return x - x.mean(axis=0)
    return x - x[list(reference)].mean(axis=0)


def scaled(x: np.ndarray, mu: np.ndarray, sd: np.ndarray) -> np.ndarray:
    z = (x - np.asarray(mu)[:, None]) / np.maximum(sd, SD_FLOOR)[:, None]
    return np.clip(np.nan_to_num(z, nan=0.0, posinf=Z_CLIP, neginf=-Z_CLIP), -Z_CLIP, Z_CLIP)


def filtered(x: np.ndarray, taps: np.ndarray) -> np.ndarray:
    """Each channel convolved with the taps, valid part only.

    Long kernels go through the FFT of the whole block: blocks overlap by the
    kernel's length, so the circular part of the product is never looked at
    (overlap-save).
    """
    n, m = x.shape[1], len(taps)
    if m < 64:
        return np.stack([np.convolve(row, taps, mode="valid") for row in x])
    size = 1 << (n - 1).bit_length()
    y = np.fft.irfft(np.fft.rfft(x, size, axis=1) * np.fft.rfft(taps, size), size, axis=1)
    return y[:, m - 1:n]


def block_marks(lengths: DataFrame, size: int = SIZE) -> DataFrame:
    """One row per (subject, block) from one row per subject; other columns stay on it."""
    return spread(lengths.withColumn("block", F.explode(F.sequence(
        F.lit(0).cast("long"), F.floor((F.col("n_samples") - 1) / size)))), *KEY, "block")


def recording_spans(signals: DataFrame) -> DataFrame:
    return signals.groupBy(*KEY).agg((F.max("t") + 1).alias("n_samples"))


def _cells(signals: DataFrame, n_channels: int, size: int, halo: int) -> DataFrame:
    rows = checked_channels(signals, n_channels)
    if halo:
        rows = halo_panes(rows, size, halo, halo)
    else:
        rows = rows.withColumn("pane", F.floor(F.col("t") / size))
    return rows.select(*KEY, F.col("pane").alias("block"), F.col("channel").cast("int").alias("channel"),
                       F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("value"))


def _grouped(cells: DataFrame, marks: DataFrame):
    return marks.groupBy(*KEY, "block").cogroup(cells.groupBy(*KEY, "block"))


def _span(mark, size: int, halo: int) -> tuple[int, int]:
    """The samples a block sees: its own and the halo, within the recording."""
    start = int(mark["block"]) * size
    return max(0, start - halo), int(min(mark["n_samples"], start + size + halo))


def channel_moments(cells: DataFrame, marks: DataFrame, n_channels: int, size: int, halo: int, reference) -> DataFrame:
    """(subject, grp, n_samples, mu, sd) over each channel's filled and referenced samples.

    Blocks send count, mean and squared deviations; these are centred again on
    the channel's mean, so a large offset costs no digits.
    """
    def run(mark: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(mark):
            return pd.DataFrame(columns=["subject_id", "grp", "n_samples", "channel", "n", "m", "m2"])
        row = mark.iloc[0]
        first, stop = _span(row, size, halo)
        start = int(row["block"]) * size
        x = referenced(fill(pdf, n_channels, first, stop), reference)[:, start - first:][:, :size]
        m = x.mean(axis=1)
        return pd.DataFrame({"subject_id": row["subject_id"], "grp": row["grp"], "n_samples": row["n_samples"],
                             "channel": range(n_channels), "n": x.shape[1], "m": m,
                             "m2": ((x - m[:, None]) ** 2).sum(axis=1)})

    parts = _grouped(cells, marks).applyInPandas(
        run, "subject_id string, grp string, n_samples long, channel int, n long, m double, m2 double")
    own = Window.partitionBy(*KEY, "n_samples", "channel")
    mean = F.sum(F.col("n") * F.col("m")).over(own) / F.sum("n").over(own)
    centred = parts.withColumn("mu", mean)
    far = F.col("m") - F.col("mu")
    per = centred.groupBy(*KEY, "n_samples", "channel").agg(
        F.first("mu").alias("mu"), F.sqrt(F.sum(F.col("m2") + F.col("n") * far * far) / F.sum("n")).alias("sd"))
    return per.groupBy(*KEY, "n_samples").agg(F.array_sort(F.collect_list(F.struct("channel", "mu", "sd"))).alias("s")).select(
        *KEY, "n_samples", F.col("s.mu").alias("mu"), F.col("s.sd").alias("sd"))


def prepare(signals: DataFrame, n_channels: int, *, reference=None, standardise: bool = False,
            taps: Sequence[float] | None = None, stats: DataFrame | None = None, size: int = SIZE) -> DataFrame:
    """Fill, reference, z-score and filter, in this order: (subject_id, grp, block, n_samples, first, width, x).

    ``x`` holds ``width`` samples from ``first`` on, channel after channel. With
    ``standardise`` channels are scaled by ``stats`` (subject_id, grp, n_samples, mu, sd),
    by default those of the referenced signal itself. The filter is zero-phase with
    an odd number of taps and zeros outside the recording.
    """
    halo = 0 if taps is None else len(taps) // 2
    h = None if taps is None else np.asarray(taps, float)
    cells = _cells(signals, n_channels, size, halo)
    if standardise and stats is None:
        stats = channel_moments(cells, block_marks(recording_spans(signals), size), n_channels, size, halo, reference)
    marks = block_marks(stats if standardise else recording_spans(signals), size)

    def run(mark: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(mark):
            # only a halo reaches beyond the last block
            return pd.DataFrame(columns=["subject_id", "grp", "block", "n_samples", "first", "width", "x"])
        row = mark.iloc[0]
        first, stop = _span(row, size, halo)
        start, end = int(row["block"]) * size, int(min(row["n_samples"], (row["block"] + 1) * size))
        x = referenced(fill(pdf, n_channels, first, stop), reference)
        if standardise:
            x = scaled(x, row["mu"], row["sd"])
        if h is not None:
            x = filtered(np.pad(x, ((0, 0), (halo - (start - first), halo - (stop - end)))), h)
        return pd.DataFrame({"subject_id": row["subject_id"], "grp": row["grp"], "block": row["block"],
                             "n_samples": row["n_samples"], "first": start, "width": end - start, "x": [x.ravel()]})

    return _grouped(cells, marks).applyInPandas(run, _BLOCK)


#: Zero crossings of the interpolation kernel on each side.
ZEROS = 10


def resample_rates(fs_old: float, fs_new: float) -> tuple[int, int]:
    """(up, down) of a rational rate change."""
    ratio = Fraction(fs_new).limit_denominator(10_000) / Fraction(fs_old).limit_denominator(10_000)
    return ratio.numerator, ratio.denominator


def resample_taps(up: int, down: int) -> list[float]:
    """Low-pass kernel at ``up`` times the old rate, cut off at the lower of both Nyquist frequencies; sums to ``up``."""
    wide = max(up, down)
    k = np.arange(-ZEROS * wide, ZEROS * wide + 1)
    h = np.sinc(k / wide) * (0.54 + 0.46 * np.cos(np.pi * k / (ZEROS * wide)))
    return (up * h / h.sum()).tolist()


def resample(signals: DataFrame, n_channels: int, fs_old: float, fs_new: float, size: int = SIZE) -> DataFrame:
    """Block rows at the new rate: y[m] = sum over j of h[m down - j up] x[j], zeros outside the recording.

    Each output sample meets one branch of the kernel's polyphase bank, so nothing is
    computed at the intermediate rate. A block makes the output samples whose place
    on the old time axis it holds; the halo is half a kernel.
    """
    up, down = resample_rates(fs_old, fs_new)
    if up == down:
        return prepare(signals, n_channels, size=size)
    h = np.asarray(resample_taps(up, down))
    half = len(h) // 2
    halo = -(-half // up)
    cells = _cells(signals, n_channels, size, halo)
    marks = block_marks(recording_spans(signals), size)

    def run(mark: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if len(mark):
            row = mark.iloc[0]
            first, stop = _span(row, size, halo)
            start, end = int(row["block"]) * size, int(min(row["n_samples"], (row["block"] + 1) * size))
            # outputs m with start <= m down / up < end
            low, high = -(-start * up // down), -(-end * up // down)
        if not len(mark) or low == high:
            return pd.DataFrame(columns=["subject_id", "grp", "block", "n_samples", "first", "width", "x"])
        m = np.arange(low, high)
        j = -((half - m * down) // up)
        reach = 2 * half // up + 1
        k = m[:, None] * down - (j[:, None] + np.arange(reach)) * up + half
        bank = np.where((k >= 0) & (k < len(h)), h[np.clip(k, 0, len(h) - 1)], 0.0)
        edge = halo + reach
        x = np.pad(fill(pdf, n_channels, first, stop), ((0, 0), (edge, edge)))
        seen = np.lib.stride_tricks.sliding_window_view(x, reach, axis=1)[:, j - first + edge]
        y = np.einsum("cmr,mr->cm", seen, bank)
        return pd.DataFrame({"subject_id": row["subject_id"], "grp": row["grp"], "block": row["block"],
                             "n_samples": -(-int(row["n_samples"]) * up // down), "first": low, "width": high - low,
                             "x": [y.ravel()]})

    return _grouped(cells, marks).applyInPandas(run, _BLOCK)


def to_rows(blocks: DataFrame, *extra: str) -> DataFrame:
    """The long table (subject_id, grp, channel, t, value) of block rows; ``extra`` columns stay."""
    return blocks.select(*KEY, *extra, "first", "width", F.posexplode("x").alias("at", "value")).select(
        *KEY, *extra, F.floor(F.col("at") / F.col("width")).cast("int").alias("channel"),
        (F.col("first") + F.col("at") % F.col("width")).alias("t"), "value")


def dense_grid(signals: DataFrame, n_channels: int, size: int = SIZE) -> DataFrame:
    """Every (subject, channel, t) cell present; gaps are 0, stray channels an error."""
    return to_rows(prepare(signals, n_channels, size=size))


def hashed_shift(seed: int = 0):
    """Offsets drawn from a hash of (seed, surrogate, subject, channel)."""
    return lambda surrogate, channel: F.xxhash64(F.lit(seed), surrogate, F.col("subject_id"), channel)


def shift_pieces(blocks: DataFrame, n_surrogates: int, pane: int, halo: int, shift) -> DataFrame:
    """Circularly shifted channels, cut into the pieces that land in each pane: (keys, surrogate, pane, n_samples, c, o, v).

    ``shift(surrogate, channel)`` is a column expression, taken modulo the recording's
    length. Pane p sees its ``pane`` samples and ``halo`` samples ahead of them; ``o``
    is a piece's place in it.
    """
    n = F.floor(F.size("x") / F.col("width")).cast("int")
    offsets = F.transform(F.sequence(F.lit(1), F.lit(n_surrogates)), lambda s: F.transform(
        F.sequence(F.lit(0), n - 1), lambda c: F.pmod(shift(s, c).cast("long"), F.col("n_samples"))))
    ready = blocks.withColumn("shifts", F.flatten(offsets))

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x, total = np.asarray(row.x).reshape(-1, row.width), int(row.n_samples)
                at = (np.asarray(row.shifts).reshape(n_surrogates, len(x)) + row.first) % total
                out = []
                for s, c in np.ndindex(at.shape):
                    split = min(row.width, total - int(at[s, c]))
                    for base, part in ((int(at[s, c]), x[c, :split]), (0, x[c, split:])):
                        end = base + len(part)
                        if end == base:
                            continue
                        for p in range(base // pane, min((end - 1 + halo) // pane, (total - 1) // pane) + 1):
                            low = p * pane - halo
                            lo, hi = max(base, low), min(end, (p + 1) * pane)
                            if lo < hi:
                                out.append((s + 1, p, c, lo - low, part[lo - base:hi - base]))
                if out:
                    s, p, c, o, v = zip(*out)
                    yield pd.DataFrame({"subject_id": row.subject_id, "grp": row.grp, "surrogate": s, "pane": p,
                                        "n_samples": total, "c": c, "o": o, "v": v})

    return ready.mapInPandas(run, "subject_id string, grp string, surrogate int, pane long, n_samples long, c int, o int,"
                                  " v array<double>")


def circular_shift(blocks: DataFrame, n_surrogates: int, shift, size: int = SIZE) -> DataFrame:
    """Surrogates in block form: every channel rolled by its own offset, one more key ``surrogate``."""
    pieces = shift_pieces(blocks, n_surrogates, size, 0, shift)

    def run(key, pdf):
        n, start = int(pdf["n_samples"].iat[0]), int(key[3]) * size
        width = min(size, n - start)
        x = np.zeros((int(pdf["c"].max()) + 1, width))
        for c, o, v in zip(pdf["c"], pdf["o"], pdf["v"]):
            x[c, o:o + len(v)] = v
        return pd.DataFrame({"subject_id": key[0], "grp": key[1], "surrogate": key[2], "block": key[3], "n_samples": n,
                             "first": start, "width": width, "x": [x.ravel()]})

    return pieces.groupBy(*KEY, "surrogate", "pane").applyInPandas(run, _BLOCK.replace("block long", "surrogate int, block long"))


def block_sums(blocks: DataFrame, *extra: str) -> DataFrame:
    """Per (subject, extra, channel): n, total, energy (sum of squares), first (at t = 0) and weighted (sum of x t)."""
    types = dict(blocks.dtypes)
    columns = ["subject_id", *extra, "channel", "n", "total", "energy", "first", "weighted"]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                x = np.asarray(row.x).reshape(-1, row.width)
                t = row.first + np.arange(row.width)
                out.append(pd.DataFrame({
                    "subject_id": row.subject_id, **{e: getattr(row, e) for e in extra}, "channel": range(len(x)),
                    "n": row.width, "total": x.sum(axis=1), "energy": (x * x).sum(axis=1),
                    "first": x[:, 0] if row.first == 0 else np.nan, "weighted": x @ t.astype(float)})[columns])
            if out:
                yield pd.concat(out)

    kinds = "".join(f"`{e}` {types[e]}, " for e in extra)
    parts = blocks.mapInPandas(run, f"subject_id string, {kinds}channel int, n long, total double, energy double,"
                                    " first double, weighted double")
    return parts.groupBy("subject_id", *extra, "channel").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum("energy").alias("energy"),
        F.max(F.nanvl("first", F.lit(None).cast("double"))).alias("first"), F.sum("weighted").alias("weighted"))
