"""Pane blocks and lag moments: the sufficient statistics of a graph autoregression model.

A model predicts x[t] from L^k x[t-p], p = 1..P, k = 0..K. All it needs is

    A_j(p, q) = sum_t  x[t-p]' L^j x[t-q],    0 <= p, q <= P,  0 <= j <= 2K,

because every Gram entry is A_{k+k'}(p, p') and every right-hand side is
A_k(p, 0). The sums merge over time, so a recording is cut into blocks (each
read with P samples of halo), every block is reduced on its own, and totals are
plain sums:

* for the whole recording and its sliding windows a block adds up its share of
  every scope it touches (``window_moments``); running sums between the scopes'
  borders make overlapping windows cheap,
* a (P, K) grid takes sub-blocks of the same arrays (``pane_moments``).

A scope that starts at sample s sums over t >= s + P only. In a grid, with
c = P mod pane and d = P // pane, this means: leave out the first d panes and
the first c rows of pane d. So a pane gives up to two arrays per order P,
``whole`` and ``tail``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphdyn.functions.scalars import nan_to_num, zscore_value
from graphdyn.operators.prep import checked_channels, halo_panes
from graphdyn.schema import SD_FLOOR, Z_CLIP
from graphdyn.session import bound_batches, sized

KEY = ["subject_id", "grp"]


def recording_lengths(signals: DataFrame) -> DataFrame:
    """(subject_id, grp, n_samples), written out so that joins know its size."""
    return sized(signals.groupBy(*KEY).agg((F.max("t") + 1).alias("n_samples")))


def recording_stats(signals: DataFrame, n_channels: int, span: Column | None = None,
                    lengths: DataFrame | None = None) -> DataFrame:
    """Per subject: n_samples and the arrays mu, sd over channels, absent cells counting as 0.

    ``span`` (a column in n_samples, e.g. 70 % of it) limits the reference to leading
    samples. Aggregations with map-side combine; no cell is materialised.
    """
    x = nan_to_num(F.col("value"))
    aggs = [F.count(F.lit(1)).alias("n"), F.avg(x).alias("m"), F.var_pop(x).alias("v")]
    if span is None:
        # lengths come out of the same pass
        per = signals.groupBy(*KEY, "channel").agg((F.max("t") + 1).alias("_last"), *aggs)
        per = per.withColumn("n_samples", F.max("_last").over(Window.partitionBy(*KEY)))
        n_ref = F.col("n_samples").cast("double")
    else:
        lengths = recording_lengths(signals) if lengths is None else lengths
        base = signals.join(lengths, KEY).filter(F.col("t") < span)
        per = base.groupBy(*KEY, "n_samples", "channel").agg(*aggs)
        n_ref = span.cast("double")
    # mean and variance after adding (N - n) zeros to n samples
    share = F.col("n") / n_ref
    per = per.select(
        *KEY, "n_samples", F.col("channel").cast("int").alias("channel"),
        (F.col("m") * share).alias("mu"),
        F.sqrt(share * (F.col("v") + F.col("m") * F.col("m") * (1 - share))).alias("sd"))
    return _channel_arrays(per, n_channels)


def _channel_arrays(per: DataFrame, n_channels: int) -> DataFrame:
    """Rows per channel to arrays over channels 0..n-1."""
    packed = checked_channels(per, n_channels).groupBy(*KEY, "n_samples").agg(F.map_from_entries(F.collect_list(F.struct(
        "channel", F.struct("mu", "sd").alias("s")))).alias("s"))
    ids = F.sequence(F.lit(0), F.lit(n_channels - 1))

    def pick(field):
        return F.transform(ids, lambda c: F.coalesce(F.element_at("s", c)[field], F.lit(0.0)))

    return packed.select(*KEY, "n_samples", pick("mu").alias("mu"), pick("sd").alias("sd"))


def restandardised_stats(signals: DataFrame, stats: DataFrame, span: Column,
                         n_channels: int) -> DataFrame:
    """Channel stats of the leading span after it was standardised by ``stats``."""
    def at(name):
        return F.get(name, F.col("channel").cast("int"))

    stats = sized(stats)
    cells = signals.join(stats.select("subject_id", "n_samples", "mu", "sd"), "subject_id") \
        .filter(F.col("t") < span)
    z = zscore_value(nan_to_num(F.col("value")), at("mu"), at("sd"))
    per = cells.groupBy("subject_id", "channel").agg(
        F.count(F.lit(1)).alias("n"), F.avg(z).alias("m"), F.var_pop(z).alias("v"))
    grid = stats.select(*KEY, "n_samples", F.posexplode(F.arrays_zip("mu", "sd")).alias("channel", "s"))
    share = F.coalesce(F.col("n"), F.lit(0)) / span.cast("double")
    gap = zscore_value(F.lit(0.0), F.col("s.mu"), F.col("s.sd"))
    m, v = F.coalesce("m", F.lit(0.0)), F.coalesce("v", F.lit(0.0))
    mean = share * m + (1 - share) * gap
    var = share * (v + (m - mean) * (m - mean)) + (1 - share) * (gap - mean) * (gap - mean)
    both = grid.join(per, ["subject_id", "channel"], "left").select(
        *KEY, "n_samples", "channel", mean.alias("mu"), F.sqrt(var).alias("sd"))
    return _channel_arrays(both, n_channels)


def identity_stats(signals: DataFrame, n_channels: int) -> DataFrame:
    """Stats that leave the values as they are (mu 0, sd 1)."""
    lengths = signals.groupBy(*KEY).agg((F.max("t") + 1).alias("n_samples"))
    return lengths.select(*KEY, "n_samples", F.array_repeat(F.lit(0.0), n_channels).alias("mu"),
                          F.array_repeat(F.lit(1.0), n_channels).alias("sd"))


def pane_blocks(signals: DataFrame, stats: DataFrame, basis: DataFrame, pane: int, halo: int,
                orders=None, by: str | None = None, extra=()) -> DataFrame:
    """One row per (subject, block of ``pane`` samples): cells, scaling, graph basis.

    ``basis`` has lam and u, one row per graph; ``by`` names the column that
    picks a subject's graph (None: the single graph serves all). ``orders`` is
    an array column of P, or a table (subject_id, orders). A block is bounded
    by (pane + halo) x channels; the gathering shuffle is the only one over
    the samples. ``extra`` are further key columns, e.g. a data split.
    """
    key = [*KEY, *extra]
    cells = halo_panes(signals, pane, halo)
    offset = (F.col("t") - F.col("pane") * pane + halo).cast("int")
    blocks = cells.groupBy(*key, "pane").agg(
        F.collect_list(F.struct(F.col("channel").cast("int").alias("c"), offset.alias("o"),
                                nan_to_num(F.col("value")).alias("v"))).alias("cells"))
    return with_context(blocks, stats, basis, pane, halo, orders, by, extra)


def with_context(blocks: DataFrame, stats: DataFrame, basis: DataFrame, pane: int, halo: int,
                 orders=None, by: str | None = None, extra=(), complete: bool = False) -> DataFrame:
    """Join scaling, graph and model orders onto block rows.

    A pane without any sample still counts (its zeros are scaled like all
    others), so the panes are listed from the recording lengths; that list is
    partitioned like the blocks, which are not shuffled again. ``complete``
    says that the blocks already cover every pane.
    """
    key = [*KEY, *extra]
    bound_batches(blocks.sparkSession)
    cells = blocks.select(*key, "pane", F.col("cells.c").alias("c"),
                          F.col("cells.o").alias("o"), F.col("cells.v").alias("v"))
    scale = stats.select(*[c for c in key if c in stats.columns], "n_samples", "mu", "sd")
    if complete:
        out = cells.join(scale, [c for c in key if c in stats.columns])
    else:
        panes = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_samples") - 1) / pane))
        every = scale.withColumn("pane", F.explode(panes))
        out = every.join(cells, [*key, "pane"], "left")
    if isinstance(orders, DataFrame):
        out = out.join(orders.select("subject_id", "orders"), "subject_id")
    elif orders is not None:
        out = out.withColumn("orders", orders)
    form = ["lam", "u"] if "u" in basis.columns else ["gi", "gj", "gv"]
    if by is None:
        one = basis.select(F.struct(*form)).scalar()
        out = out.withColumn("_b", one).withColumns({c: F.col(f"_b.{c}") for c in form}).drop("_b")
    else:
        out = out.join(basis.select(by, *form), by)
    start = F.col("pane") * pane
    return (out.filter(start < F.col("n_samples")).withColumn("start", start)
            .withColumn("rows", F.least(F.lit(pane), F.col("n_samples") - start).cast("int"))
            .withColumn("halo", F.lit(halo)))


def block_matrix(row, standardise: bool = True) -> np.ndarray:
    """(halo + rows) x channels matrix of one block; gaps are 0 before scaling.

    Halo rows ahead of the recording stay in the matrix but are never summed.
    """
    x = np.zeros((row.halo + row.rows, len(row.mu)))
    if row.v is None:
        pass
    elif len(row.v) and isinstance(row.v[0], (list, np.ndarray)):
        for c, o, piece in zip(row.c, row.o, row.v):
            piece = piece[:max(0, len(x) - o)]
            x[o:o + len(piece), c] = piece
    else:
        o = np.asarray(row.o)
        inside = o < len(x)
        x[o[inside], np.asarray(row.c)[inside]] = np.asarray(row.v)[inside]
    if standardise:
        x = (x - row.mu) / np.maximum(row.sd, SD_FLOOR)
        x = np.clip(np.nan_to_num(x, nan=0.0, posinf=Z_CLIP, neginf=-Z_CLIP), -Z_CLIP, Z_CLIP)
    return x


def packed_laplacian(lap: DataFrame, by: str = "grp") -> DataFrame:
    """One row per graph: the non-zero cells (gi, gj, gv) of its Laplacian (by, i, j, v).

    It serves as ``basis`` where only powers of the graph are asked for: the size of
    the graph's edges, not of an eigenbasis, travels with each block.
    """
    cells = lap.filter("v <> 0").groupBy(by).agg(F.collect_list(F.struct("i", "j", "v")).alias("e"))
    return cells.select(by, F.col("e.i").alias("gi"), F.col("e.j").alias("gj"), F.col("e.v").alias("gv"))


def graph_powers(row, x: np.ndarray, k_max: int) -> list[np.ndarray]:
    """x, L x, .., L^k x for the rows of ``x``, by the power recurrence along the graph's edges."""
    i, j, v = np.asarray(row.gi), np.asarray(row.gj), np.asarray(row.gv, float)
    order = np.argsort(i, kind="stable")
    i, j, v = i[order], j[order], v[order]
    first = np.flatnonzero(np.diff(i, prepend=-1))
    out = [x]
    for _ in range(k_max):
        y = np.zeros_like(x)
        if len(i):
            # sums over the edges of each node, which lie side by side
            y[:, i[first]] = np.add.reduceat(out[-1][:, j] * v, first, axis=1)
        out.append(y)
    return out


def _spectral_sums(row, x, k_max, top):
    """A function (p, first, stop) -> A_j(., .) from the graph's modes."""
    s = mode_matrix(row, x)
    lam_pow = np.asarray(row.lam)[None, :] ** np.arange(2 * k_max + 1)[:, None]
    lags = np.stack([s[row.halo - p:len(s) - p] for p in range(top + 1)])

    def sums(p, i, j):
        v = lags[:p + 1, i:j].transpose(2, 0, 1)              # mode, p, t
        return np.tensordot(lam_pow, v @ v.transpose(0, 2, 1), axes=(1, 0))
    return sums


def _edge_sums(row, x, k_max, top):
    """The same from powers of the graph: A_j pairs L^a x and L^b x with a + b = j."""
    lags = [np.stack([y[row.halo - p:len(y) - p] for p in range(top + 1)]) for y in graph_powers(row, x, k_max)]

    def sums(p, i, j):
        flat = [y[:p + 1, i:j].reshape(p + 1, -1) for y in lags]
        return np.stack([flat[n // 2] @ flat[n - n // 2].T for n in range(2 * k_max + 1)])
    return sums


def mode_matrix(row, x: np.ndarray) -> np.ndarray:
    n = x.shape[1]
    return x @ np.asarray(row.u).reshape(n, n).T


def _reduce_panes(keys, k_max, pane, grid, standardise):
    cols = [*keys, "n_samples", "pane", "P", "part", "n_obs", "s1", "a"]

    def stretches(rows):
        """(first row, panes, rows per pane): the full panes of a block, then the rest."""
        full = rows // pane
        if full:
            yield 0, full, pane
        if rows % pane:
            yield full * pane, 1, rows % pane

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                x = block_matrix(row, standardise)
                s = mode_matrix(row, x)
                n = x.shape[1]
                lam_pow = np.asarray(row.lam)[None, :] ** np.arange(2 * k_max + 1)[:, None]
                head = (*(getattr(row, k) for k in keys), row.n_samples)
                orders = sorted(int(p) for p in row.orders)
                lags = np.stack([s[row.halo - p:len(s) - p] for p in range(orders[-1] + 1)])
                sums = x[row.halo:].sum(axis=1)
                begin = row.start // pane
                # a grid starts once, at pane 0; windows may start at any pane
                lead = grid and begin == 0
                whole = [] if lead else orders[-1:] if grid else orders
                tail = [] if grid and begin > 0 else orders
                for at, count, size in stretches(row.rows):
                    span = slice(at, at + count * size)
                    cube = lags[:, span].reshape(len(lags), count, size, n) \
                        .transpose(3, 1, 0, 2)                          # mode, pane, p, t
                    s1 = sums[span].reshape(count, size)
                    for part, ps in (("whole", whole), ("tail", tail)):
                        for p in ps:
                            skip = 0 if part == "whole" else p % pane
                            if (part == "tail" and skip == 0) or skip >= size:
                                continue
                            v = cube[:, :, :p + 1, skip:]
                            gamma = v @ v.transpose(0, 1, 3, 2)         # mode, pane, p, q
                            a = np.tensordot(lam_pow, gamma, axes=(1, 0))
                            a = a.transpose(1, 0, 2, 3).reshape(count, -1)
                            total = s1[:, skip:].sum(axis=1)
                            out += [(*head, begin + at // pane + c, p, part, (size - skip) * n,
                                     float(total[c]), a[c]) for c in range(count)]
            if out:
                yield pd.DataFrame(out, columns=cols)
    return run


def pane_moments(blocks: DataFrame, k_max: int, pane: int, *, grid: bool = False,
                 standardise: bool = True, extra=()) -> DataFrame:
    """Lag moments of every pane: (keys, n_samples, pane, P, part, n_obs, s1, a).

    A block may hold several panes; in a grid it must be one pane.
    """
    keys = [*KEY, *extra]
    types = dict(blocks.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    return blocks.mapInPandas(
        _reduce_panes(keys, k_max, pane, grid, standardise),
        f"{schema}, n_samples bigint, pane bigint, P int, part string, n_obs bigint, s1 double,"
        " a array<double>")


#: Samples per block of window moments.
BLOCK = 1024


def sum_moments(parts: DataFrame, keys) -> DataFrame:
    """Element-wise sum of the moment arrays of each key.

    Partial sums combine on the map side per (key, element), so a key that
    owns most of the panes is merged by many tasks.
    """
    flat = parts.select(*keys, F.posexplode(
        F.concat(F.array(F.col("n_obs").cast("double"), F.col("s1")), "a")).alias("e", "x"))
    sums = flat.groupBy(*keys, "e").agg(F.sum("x").alias("x"))
    rows = sums.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("e", "x"))).alias("r"))
    x = F.col("r.x")
    return rows.select(*keys, F.get(x, F.lit(0)).cast("bigint").alias("n_obs"),
                       F.get(x, F.lit(1)).alias("s1"),
                       F.slice(x, 3, F.size(x) - 2).alias("a"))


def _window_parts(keys, k_max, length, step, standardise):
    cols = [*keys, "window_idx", "P", "n_obs", "s1", "a"]

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                x = block_matrix(row, standardise)
                n = x.shape[1]
                head = tuple(getattr(row, k) for k in keys)
                orders = sorted(int(p) for p in row.orders)
                lag_sums = (_spectral_sums if hasattr(row, "u") else _edge_sums)(row, x, k_max, orders[-1])
                sums = np.concatenate([[0.0], np.cumsum(x[row.halo:].sum(axis=1))])
                last = (row.n_samples - length) // step if row.n_samples >= length else -1
                first = max(0, (row.start - length) // step + 1)
                wins = range(first, min(last, (row.start + row.rows - 1) // step) + 1)
                for p in orders:
                    # targets of a scope: all but its first p samples, within this block
                    spans = [(-1, p - row.start, row.rows)]
                    spans += [(w, w * step + p - row.start, w * step + length - row.start) for w in wins]
                    spans = [(w, max(0, i), min(row.rows, j)) for w, i, j in spans]
                    spans = [(w, i, j) for w, i, j in spans if i < j]
                    cuts = sorted({c for _, i, j in spans for c in (i, j)})
                    place = {c: k for k, c in enumerate(cuts)}
                    running = np.zeros((len(cuts), (2 * k_max + 1) * (p + 1) ** 2))
                    for k, (i, j) in enumerate(zip(cuts, cuts[1:]), 1):
                        running[k] = running[k - 1] + lag_sums(p, i, j).ravel()
                    out += [(*head, w, p, (j - i) * n, float(sums[j] - sums[i]),
                             running[place[j]] - running[place[i]]) for w, i, j in spans]
            if out:
                yield pd.DataFrame(out, columns=cols)
    return run


def window_moments(blocks: DataFrame, k_max: int, length: int, step: int, *,
                   standardise: bool = True, extra=()) -> DataFrame:
    """Totals per scope: window_idx -1 is the whole recording, 0.. the full windows.

    A block adds up its share of every window it touches before anything is
    shuffled: one row per (window, block), T / step + 2 T / block rows a
    recording whatever the length and step have in common.
    """
    keys = [*KEY, *extra]
    types = dict(blocks.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys)
    parts = blocks.mapInPandas(
        _window_parts(keys, k_max, length, step, standardise),
        f"{schema}, window_idx bigint, P int, n_obs bigint, s1 double, a array<double>")
    return sum_moments(parts, [*keys, "window_idx", "P"])


def graph_var_moments(signals: DataFrame, basis: DataFrame, n_channels: int, *, orders, k_max: int,
                      p_max: int, length: int, step: int, by: str | None = None,
                      stats: DataFrame | None = None, standardise: bool = True) -> DataFrame:
    """Whole-recording and window moments of a cohort in one pass over the samples.

    ``basis`` is a packed eigenbasis or a ``packed_laplacian``.
    """
    if stats is None:
        stats = (recording_stats if standardise else identity_stats)(signals, n_channels)
    blocks = pane_blocks(signals, stats, basis, BLOCK, p_max, orders, by)
    return window_moments(blocks, k_max, length, step, standardise=standardise)


# -- node-level outputs of the same blocks ------------------------------------

def graph_fourier_transform(signals: DataFrame, basis: DataFrame, n_channels: int, *,
                            pane: int = 1024, by: str | None = None,
                            stats: DataFrame | None = None) -> DataFrame:
    """s_t = U' x_t as rows (subject_id, grp, t, mode, s)."""
    standardise = stats is not None
    if stats is None:
        stats = identity_stats(signals, n_channels)
    blocks = pane_blocks(signals, stats, basis, pane, 0, by=by)

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                s = mode_matrix(row, block_matrix(row, standardise))
                yield pd.DataFrame({
                    "subject_id": row.subject_id, "grp": row.grp,
                    "t": row.start + np.arange(len(s)), "s": list(s)})

    vec = blocks.mapInPandas(run, "subject_id string, grp string, t bigint, s array<double>")
    return vec.select(*KEY, "t", F.posexplode("s").alias("mode", "s"))


def graph_var_features(signals: DataFrame, basis: DataFrame, n_channels: int, P: int, K: int, *,
                   pane: int = 1024, by: str | None = None,
                   stats: DataFrame | None = None) -> DataFrame:
    """Design rows, from an eigenbasis or a ``packed_laplacian``: target y = x[t, channel] and f[(p-1)(K+1)+k] = (L^k x[t-p])[channel]."""
    standardise = stats is not None
    if stats is None:
        stats = identity_stats(signals, n_channels)
    blocks = pane_blocks(signals, stats, basis, pane, P, by=by)

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x = block_matrix(row, standardise)
                n = x.shape[1]
                if hasattr(row, "u"):
                    u = np.asarray(row.u).reshape(n, n)
                    shifted = [x @ ((u.T * np.asarray(row.lam) ** k) @ u) for k in range(K + 1)]
                else:
                    shifted = graph_powers(row, x, K)
                first = row.halo + max(0, P - row.start)
                if first >= len(x):
                    continue
                f = np.stack([shifted[k][first - p:len(x) - p]
                              for p in range(1, P + 1) for k in range(K + 1)], axis=-1)
                t = row.start + np.arange(first - row.halo, row.rows)
                yield pd.DataFrame({
                    "subject_id": row.subject_id, "grp": row.grp, "t": np.repeat(t, n),
                    "channel": np.tile(np.arange(n, dtype=np.int32), len(t)),
                    "y": x[first:].ravel(), "f": list(f.reshape(-1, f.shape[-1]))})

    return blocks.mapInPandas(
        run, "subject_id string, grp string, t bigint, channel int, y double, f array<double>")
