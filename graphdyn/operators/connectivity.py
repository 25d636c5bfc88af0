"""Correlation graphs per subject and the thresholding rules.

Edges are an upper-triangle long table (i < j). A graph has n(n-1)/2 rows,
where n is the channel count of the montage; that bound is what makes a
window per graph safe. The sample axis is unbounded and is only ever touched
by mergeable partial sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphdyn.functions.scalars import nan_to_num
from graphdyn.operators.prep import checked_channels
from graphdyn.session import bound_batches

_PARTIAL = ("subject_id string, grp string, n bigint, ci array<int>, cj array<int>,"
            " mi array<double>, mj array<double>, cij array<double>,"
            " cii array<double>, cjj array<double>")
#: Samples of one subject that are folded into one partial state.
BLOCK = 1024
#: Bytes of states that a task merges blocks into before it sends them on.
HELD = 64 << 20


def to_frames(signals: DataFrame, n_channels: int) -> DataFrame:
    """Long samples to blocks (subject, block, cells) of ``BLOCK`` samples; absent cells are 0.

    A channel outside 0..n_channels-1 is an error.
    """
    known = checked_channels(signals, n_channels)
    cell = F.struct((F.col("t") % BLOCK).cast("int").alias("o"), F.col("channel").cast("int").alias("c"),
                    nan_to_num("value").alias("v"))
    return known.groupBy("subject_id", "grp", F.floor(F.col("t") / BLOCK).alias("block")).agg(
        F.collect_list(cell).alias("cells"), F.lit(n_channels).alias("n_channels"))


class Comoments:
    """Count, channel means and centred co-moments of the samples seen so far."""

    def __init__(self, x: np.ndarray):
        self.n, self.mean = len(x), x.mean(axis=0)
        d = x - self.mean
        self.c = d.T @ d

    def add(self, other: Comoments) -> None:
        """Merge disjoint samples; the shift between both means enters once."""
        n = self.n + other.n
        d = other.mean - self.mean
        self.c += other.c + np.outer(d, d) * (self.n * other.n / n)
        self.mean, self.n = self.mean + d * (other.n / n), n

    def pairs(self) -> tuple:
        i, j = np.triu_indices(len(self.mean), 1)
        var = np.diag(self.c)
        return (self.n, i.astype(np.int32), j.astype(np.int32), self.mean[i], self.mean[j], self.c[i, j], var[i], var[j])


def _block_samples(row) -> np.ndarray:
    if not hasattr(row, "o"):
        return np.stack(row.x)
    seen, at = np.unique(row.o, return_inverse=True)
    x = np.zeros((len(seen), row.n_channels))
    x[at, row.c] = row.v
    return x


def _partial_comoments(batches):
    """One row per subject and task, merged over the task's blocks; states are sent on when they fill ``HELD``."""
    def send():
        rows = [(*key, *state.pairs()) for key, state in held.items()]
        held.clear()
        return pd.DataFrame(rows, columns=["subject_id", "grp", "n", "ci", "cj", "mi", "mj", "cij", "cii", "cjj"])

    held: dict[tuple, Comoments] = {}
    size = 0
    for pdf in batches:
        for row in pdf.itertuples(index=False):
            key, state = (row.subject_id, row.grp), Comoments(_block_samples(row))
            if key in held:
                held[key].add(state)
                continue
            held[key] = state
            size += state.c.nbytes
            if size > HELD:
                size = 0
                yield send()
    if held:
        yield send()


def block_moments(frames: DataFrame) -> DataFrame:
    """One partial state per (subject, task) of frames: arrays over the channel pairs.

    Blocks reach Python as plain arrays, in batches bounded by bytes: as structs, each cell
    would be an object of its own, and a batch counted in rows holds a whole task's.
    """
    key = ["subject_id", "grp"]
    bound_batches(frames.sparkSession)
    if "cells" in frames.columns:
        rows = frames.select(*key, "n_channels", F.col("cells.o").alias("o"), F.col("cells.c").alias("c"),
                             F.col("cells.v").alias("v"))
    else:
        rows = frames.groupBy(*key, F.floor(F.col("t") / BLOCK).alias("block")).agg(
            F.collect_list("x").alias("x")).drop("block")
    return rows.mapInPandas(_partial_comoments, _PARTIAL)


def pair_moments(frames: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Centred second-order sums of every channel pair (i < j) per subject.

    Columns n, mi, mj, cij, cii, cjj. Samples are gathered in blocks of
    ``BLOCK`` per subject, each folded into centred co-moments, and a task merges its
    blocks of a subject: one shuffle of the samples and one of n(n-1)/2 rows per
    subject and task, whatever the number of blocks; no per-sample pair is ever
    emitted. The merge re-centres the blocks on
    the overall mean before it adds them, so a large offset costs no precision.

    ``frames`` has (subject_id, grp, t, x array) or the blocks of ``to_frames``.

    ``lengths`` (subject_id, n_samples) counts the samples of sparse
    recordings: a sample without any cell is an all-zero frame.
    """
    partial = block_moments(frames)
    key = ["subject_id", "grp", "i", "j"]
    rows = partial.select(
        "subject_id", "grp", "n",
        F.inline(F.arrays_zip("ci", "cj", "mi", "mj", "cij", "cii", "cjj"))) \
        .withColumnsRenamed({"ci": "i", "cj": "j"})
    # one row per state and pair; the aggregation below reuses this partitioning
    whole = Window.partitionBy(*key)
    n = F.col("n")
    total = F.sum("n").over(whole)
    rows = rows.withColumns({"ti": F.sum(n * F.col("mi")).over(whole) / total,
                             "tj": F.sum(n * F.col("mj")).over(whole) / total})
    di, dj = F.col("mi") - F.col("ti"), F.col("mj") - F.col("tj")
    out = rows.groupBy(*key).agg(
        F.sum("n").alias("n"), F.first("ti").alias("mi"), F.first("tj").alias("mj"),
        F.sum(F.col("cij") + n * di * dj).alias("cij"),
        F.sum(F.col("cii") + n * di * di).alias("cii"),
        F.sum(F.col("cjj") + n * dj * dj).alias("cjj"))
    if lengths is None:
        return out
    out = out.join(lengths.select("subject_id", F.col("n_samples").alias("_n")), "subject_id")
    gap = n * (F.col("_n") - n) / F.col("_n")
    return out.select(
        *key, F.col("_n").alias("n"), (F.col("mi") * n / F.col("_n")).alias("mi"),
        (F.col("mj") * n / F.col("_n")).alias("mj"),
        (F.col("cij") + F.col("mi") * F.col("mj") * gap).alias("cij"),
        (F.col("cii") + F.col("mi") * F.col("mi") * gap).alias("cii"),
        (F.col("cjj") + F.col("mj") * F.col("mj") * gap).alias("cjj"))


def pearson_edges(frames: DataFrame, absolute: bool = True,
                  lengths: DataFrame | None = None) -> DataFrame:
    """Correlation of every channel pair; undefined values become 0."""
    power = F.col("cii") * F.col("cjj")
    r = F.when(power > 0, F.col("cij") / F.sqrt(power)).otherwise(0.0)
    r = F.greatest(F.least(nan_to_num(r), F.lit(1.0)), F.lit(-1.0))
    return pair_moments(frames, lengths).select(
        "subject_id", "grp", "i", "j", (F.abs(r) if absolute else r).alias("w"))


# -- thresholds -------------------------------------------------------------

def _kept_count(sparsity: float, total):
    """k = max(1, floor(kappa E))."""
    return F.greatest(F.lit(1), F.floor(F.lit(sparsity) * total)).cast("long")


def keep_flag(rule: str, keys, w: str, sparsity: float = 0.15, value: float = 0.0):
    """Boolean column of one thresholding rule within the graph named by ``keys``.

    ``proportional``  w strictly above the (k+1)-th largest; all w > 0 if k = E
    ``ge_kplus1``     w at or above the (k+1)-th largest
    ``ge_k``          w at or above the k-th largest
    ``strict_kplus1`` w strictly above the (k+1)-th largest, k not raised to 1
    ``value``         w above a constant
    """
    if rule == "value":
        return F.col(w) > value
    whole = Window.partitionBy(*keys)
    falling = whole.orderBy(F.col(w).desc())
    total = F.count(F.lit(1)).over(whole)
    if rule == "proportional":
        k = _kept_count(sparsity, total)
        at_least = F.count(F.lit(1)).over(
            falling.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return F.when(k < total, at_least <= k).otherwise(F.col(w) > 0)
    k = F.floor(F.lit(sparsity) * total).cast("long")
    if rule == "ge_kplus1":
        return F.when(k > 0, F.rank().over(falling) <= F.least(k + 1, total)).otherwise(False)
    if rule == "ge_k":
        return F.rank().over(falling) <= F.greatest(k, F.lit(1))
    if rule == "strict_kplus1":
        at_least = F.count(F.lit(1)).over(
            falling.rangeBetween(Window.unboundedPreceding, Window.currentRow))
        return at_least <= k
    raise ValueError(f"unknown rule {rule!r}")


def threshold(edges: DataFrame, rule: str = "proportional", *, keys=("subject_id",),
              w: str = "w", sparsity: float = 0.15, value: float = 0.0) -> DataFrame:
    """Adds ``keep`` and the thresholded weight ``w_kept``; no edge is dropped."""
    out = edges.withColumn("keep", keep_flag(rule, list(keys), w, sparsity, value))
    return out.withColumn("w_kept", F.when(F.col("keep"), F.col(w)).otherwise(0.0))
