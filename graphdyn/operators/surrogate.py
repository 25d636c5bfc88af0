"""Surrogate test for time variation.

A surrogate is never stored: the blocks of a recording travel to *parts*, stretches
of the surrogates' time axis, and a part builds its stretch of every surrogate from
the blocks that reach it. A block goes to a part once, however many surrogates need
it there, so the exchange holds ``PARTS`` + 1 copies of the samples at most (little
more than one where offsets are short), whatever the number of surrogates. Only where
the blocks of a part would fill more than ``HELD`` bytes does each surrogate get parts
of its own, and the exchange a copy per surrogate.

A part fits its windows on the spot and leaves their coefficients, packed, and its
share of the surrogate's whole-recording moments. Distances follow from these.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphdyn.operators import blocks
from graphdyn.operators.graph_var import LagMoments, _fit_batch, fit_models, lti_models, with_lambdas
from graphdyn.operators.moments import KEY, recording_stats, sum_moments
from graphdyn.operators.transfer import window_distances
from graphdyn.session import bound_batches, cut_lineage, sized, spread

#: Bytes of samples that a part may hold.
HELD = 256 << 20
#: Parts of a recording, unless ``HELD`` asks for more. Each is a copy of the samples in the exchange and in its sort.
PARTS = 4
#: Windows of one row of coefficients.
PACKED = 4096


def surrogate_blocks(signals: DataFrame, stats: DataFrame, n_channels: int, n_surrogates: int, pane: int,
                     halo: int, seed: int = 0, shift=None, size: int = blocks.SIZE) -> DataFrame:
    """Standardised, circularly shifted panes: (keys, surrogate, pane, cells).

    Each channel of each surrogate moves by ``shift`` modulo its length: a
    function of the columns (surrogate, channel), by default a hash of (seed,
    surrogate, subject, channel). A block of samples is cut into the pieces that
    land in each pane; a pane collects one or two per channel and block.
    """
    ready = blocks.prepare(signals, n_channels, standardise=True, stats=stats, size=size)
    pieces = blocks.shift_pieces(ready, n_surrogates, pane, halo, shift or blocks.hashed_shift(seed))
    return pieces.groupBy(*KEY, "surrogate", "pane").agg(
        F.collect_list(F.struct("c", "o", "v")).alias("cells"))


def _plan(stats: DataFrame, n_channels: int, offsets, halo: int, size: int, n_parts: int, held: int) -> DataFrame:
    """Per subject: ``span``, the samples of a part, and ``together``, whether it serves all surrogates."""
    n, cell = F.col("n_samples"), 8 * n_channels
    most = max(size, held // 2 // cell // size * size)
    span = F.least(F.lit(most), F.greatest(F.lit(min(16 * size, most)), F.ceil(n / n_parts / size) * size))

    def furthest(inside, distance):
        return F.array_max(F.transform(offsets, lambda o: F.when(inside(o), distance(o)).otherwise(0)))

    # offsets lead back or, beyond half a recording, ahead
    reach = furthest(lambda o: 2 * o < n, lambda o: o) + furthest(lambda o: 2 * o >= n, lambda o: n - o)
    planned = stats.withColumn("span", span.cast("long")).withColumn("reach", reach)
    need = F.least(n, F.col("span") + halo + F.col("reach") + 2 * size) * cell
    return sized(planned.select(*KEY, "P", "K", "span", (need <= held).alias("together")))


def _route(n_surrogates: int, halo: int):
    """Each channel of a block with the parts (0 or the surrogate's number, place) that it reaches."""
    cols = ["subject_id", "grp", "n_samples", "P", "K", "span", "c", "first", "x", "offsets", "part", "place"]

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                x, total, span = np.asarray(row.x).reshape(-1, row.width), int(row.n_samples), int(row.span)
                offsets = np.asarray(row.offsets).reshape(n_surrogates, len(x))
                out = []
                for c in range(len(x)):
                    # a block that passes the end of the recording goes on at its start
                    at = (offsets[:, c] + row.first) % total
                    begin = np.concatenate([at, np.zeros_like(at)])
                    end = np.concatenate([np.minimum(at + row.width, total), at + row.width - total])
                    which = np.tile(np.arange(1, n_surrogates + 1), 2)[end > begin]
                    begin, end = begin[end > begin], end[end > begin]
                    low = begin // span
                    count = np.minimum((end - 1 + halo) // span, (total - 1) // span) - low + 1
                    place = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
                    part = np.zeros_like(place) if row.together else np.repeat(which, count)
                    part, place = np.unique(np.stack([part, place]), axis=1)
                    out.append((row.subject_id, row.grp, total, row.P, row.K, span, c, row.first, x[c], offsets[:, c],
                                part, place))
                yield pd.DataFrame(out, columns=cols)
    return run


def _parts(batches):
    """The rows of each part, from sorted batches."""
    key, held, last = [*KEY, "part", "place"], [], None
    for pdf in batches:
        for name, rows in pdf.groupby(key, sort=False):
            if held and name != last:
                yield pd.concat(held)
                held = []
            last = name
            held.append(rows)
    if held:
        yield pd.concat(held)


def _stretch(store: dict, c: int, at: int, out: np.ndarray, total: int, size: int) -> None:
    """Fill ``out`` with channel ``c`` from sample ``at`` on, going on at 0 after the last one."""
    done = 0
    while done < len(out):
        block = store[c, at // size * size]
        piece = block[at % size:][:len(out) - done]
        out[done:done + len(piece)] = piece
        done += len(piece)
        at = (at + len(piece)) % total


def _pane_sums(x, u, powers, P, whole, i, j):
    """Moments (n_obs, s1, a) of the targets from ``whole`` on and of the windows ``i`` to ``j``.

    Places count from the pane's sample P on. The running sums are cut where a span begins or ends.
    """
    m, side = x.shape[1] - P, P + 1
    s = u @ x
    cuts = np.unique(np.concatenate([i, j, [whole, m]]))
    flat = np.zeros((len(cuts), 1 + len(powers) * side * side))
    flat[1:, 0] = np.add.reduceat(x.sum(axis=0)[P:], cuts[:-1])
    a = flat[:, 1:].reshape(len(cuts), len(powers), side, side)
    for p in range(side):
        for q in range(p, side):
            pair = powers @ (s[:, P - p:P - p + m] * s[:, P - q:P - q + m])
            a[1:, :, p, q] = a[1:, :, q, p] = np.add.reduceat(pair, cuts[:-1], axis=1).T
    running = np.cumsum(flat, axis=0)
    begin, end = np.append(i, whole), np.append(j, m)
    sums = running[np.searchsorted(cuts, end)] - running[np.searchsorted(cuts, begin)]
    return (end - begin) * len(x), sums[:, 0], sums[:, 1:]


_MODELS = ("subject_id string, grp string, surrogate int, P int, K int, h array<double>, n_obs bigint, s1 double,"
           " a array<double>")


def _fit_parts(n_surrogates: int, length: int, step: int, halo: int, size: int, rho_tv: float):
    """Per surrogate of a part: coefficients ``h`` of its stable windows one after another, and its moments."""
    cols = [f.split()[0] for f in _MODELS.split(", ")]

    def run(batches):
        for rows in _parts(batches):
            row = rows.iloc[0]
            total, span, P, K = int(row["n_samples"]), int(row["span"]), int(row["P"]), int(row["K"])
            lam = np.asarray(row["lam"])
            n = len(lam)
            u, powers = np.asarray(row["u"]).reshape(n, n), lam[None, :] ** np.arange(2 * K + 1)[:, None]
            store = {(c, first): np.asarray(x) for c, first, x in zip(rows["c"], rows["first"], rows["x"])}
            offsets = {c: np.asarray(o) for c, o in zip(rows["c"], rows["offsets"])}
            start = int(row["place"]) * span
            last = (total - length) // step if total >= length > P else -1
            for number in [int(row["part"])] if row["part"] else range(1, n_surrogates + 1):
                found, lti = [], [0, 0.0, 0.0]
                for at in range(start, min(total, start + span), size):
                    stop = min(total, at + size)
                    x = np.zeros((n, halo + stop - at))
                    lead = min(at, halo)
                    for c in range(n):
                        source = (at - lead - int(offsets[c][number - 1])) % total
                        _stretch(store, c, source, x[c, halo - lead:], total, size)
                    # windows whose last sample lies here
                    w = np.arange(max(0, -((length - 1 - at) // step)), min(last, (stop - length) // step) + 1)
                    i = w * step - at + halo
                    whole = max(at, P) - at + halo - P
                    if whole >= x.shape[1] - P:
                        continue
                    n_obs, s1, a = _pane_sums(x, u, powers, P, whole, i, i + length - P)
                    found.append((n_obs[:-1], s1[:-1], a[:-1]))
                    lti = [lti[0] + n_obs[-1], lti[1] + s1[-1], lti[2] + a[-1]]
                if not lti[0]:
                    continue
                n_obs, s1, a = (np.concatenate(z) for z in zip(*found))
                out = []
                for k in range(0, max(1, len(a)), PACKED):
                    b = slice(k, k + PACKED)
                    models = _fit_batch(LagMoments(a[b], P, n_obs[b], s1[b]), P, K, lam) if len(a) else []
                    stable = [m[2] for m in models if m[3] is not None and m[3] < rho_tv]
                    share = (int(lti[0]), float(lti[1]), lti[2]) if k == 0 else (None, None, None)
                    out.append((row["subject_id"], row["grp"], number, P, K,
                                np.concatenate(stable) if stable else np.empty(0), *share))
                yield pd.DataFrame(out, columns=cols).astype({"n_obs": "Int64"})
    return run


def surrogate_models(signals: DataFrame, stats: DataFrame, basis: DataFrame, n_channels: int, n_surrogates: int, *,
                     length: int, step: int, p_max: int, shift, rho_tv: float = 0.99, size: int | None = None,
                     n_parts: int | None = None, held: int | None = None) -> DataFrame:
    """Window coefficients and moments of all surrogates by part: (keys, surrogate, P, K, h, n_obs, s1, a).

    ``stats`` has the orders P and K (``p_max`` at most) beside the scaling.
    """
    size, halo = size or blocks.SIZE, max(length, p_max)
    bound_batches(signals.sparkSession)
    ids = F.sequence(F.lit(0), F.lit(n_channels - 1))
    offsets = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(n_surrogates)), lambda s: F.transform(
        ids, lambda c: F.pmod(shift(s, c).cast("long"), F.col("n_samples")))))
    plan = _plan(stats, n_channels, offsets, halo, size, n_parts or PARTS, held or HELD)
    ready = blocks.prepare(signals, n_channels, standardise=True, stats=stats, size=size).join(plan, KEY)
    routed = ready.withColumn("offsets", offsets).mapInPandas(
        _route(n_surrogates, halo), "subject_id string, grp string, n_samples long, P int, K int, span long, c int,"
        " first long, x array<double>, offsets array<long>, part array<int>, place array<long>")
    key = [*KEY, "part", "place"]
    rows = routed.select(*KEY, "n_samples", "P", "K", "span", "c", "first", "x", "offsets",
                         F.inline(F.arrays_zip("part", "place")))
    rows = spread(rows, *key).sortWithinPartitions(*key).withColumn(
        "_b", basis.select(F.struct("lam", "u")).scalar()).withColumns({"lam": F.col("_b.lam"), "u": F.col("_b.u")})
    return rows.drop("_b").mapInPandas(_fit_parts(n_surrogates, length, step, halo, size, rho_tv), _MODELS)


def surrogate_null(signals: DataFrame, basis: DataFrame, n_channels: int, *, P: int | None = None,
                   K: int | None = None, orders: DataFrame | None = None, p_max: int | None = None,
                   k_max: int | None = None, length: int, step: int, n_surrogates: int = 200,
                   seed: int = 0, min_windows: int = 5, rho_lti: float = 1.0, rho_tv: float = 0.99,
                   n_omega: int = 128, guard: str = "add", shift=None) -> DataFrame:
    """Null distribution of the global MSD: (subject_id, grp, surrogate, global_msd, n_windows).

    Either one P and K for all, or ``orders`` (subject_id, P, K) with the largest
    values ``p_max`` and ``k_max`` among them. Unstable surrogates and those
    with too few stable windows are left out. Each channel of each surrogate moves
    by ``shift`` (a function of the columns surrogate and channel, by default
    hashed) modulo its length.
    """
    if (orders is None) != (P is not None and K is not None):
        raise ValueError("give either P and K or a table of orders")
    stats = recording_stats(signals, n_channels)
    if orders is None:
        p_max, stats = P, stats.withColumns({"P": F.lit(P), "K": F.lit(K)})
    else:
        stats = stats.join(orders.select("subject_id", "P", "K"), "subject_id")
    models = cut_lineage(surrogate_models(
        signals, sized(stats), basis, n_channels, n_surrogates, length=length, step=step, p_max=p_max,
        shift=shift or blocks.hashed_shift(seed), rho_tv=rho_tv))
    key = [*KEY, "surrogate"]
    whole = sum_moments(models.filter("n_obs is not null"), [*key, "P", "K"]).withColumn("window_idx", F.lit(-1).cast("long"))
    lti = sized(lti_models(fit_models(whole, basis, extra=("surrogate",)), rho_lti).select(
        *key, F.col("h").alias("h0")))
    rows = with_lambdas(models.select(*key, "P", "K", "h").join(lti, key), basis)
    parts = window_distances(rows, n_omega=n_omega, guard=guard)
    return parts.groupBy(*key).agg(
        F.try_divide(F.sum("total"), F.sum("n_valid")).alias("global_msd"), F.sum("n").alias("n_windows")).filter(
        F.col("n_windows") >= min_windows)


def tv_test(null: DataFrame, observed: DataFrame, outside: DataFrame, *, alpha: float = 0.05,
            min_valid: int = 50, plus_one: bool = False) -> DataFrame:
    """p = share of the null at or above the observed MSD; decision by either test.

    With at least ``min_valid`` surrogates: p < alpha or more than 5 % of the
    surface outside its band; else more than 10 % outside.
    """
    obs = observed.select(*KEY, F.col("global_msd").alias("observed_msd"))
    hit = (F.col("global_msd") >= F.col("observed_msd")).cast("double")
    valid = F.count("global_msd")
    p = F.avg(hit) if not plus_one else (F.sum(hit) + 1) / (valid + 1)
    tested = (obs.join(null.select("subject_id", "global_msd"), "subject_id", "left")
              .groupBy(*KEY).agg(F.first("observed_msd").alias("observed_msd"),
                                 valid.alias("n_valid"),
                                 F.when(valid >= min_valid, p).alias("p_value_msd")))
    out = tested.join(outside.select("subject_id", "outside_ci_fraction"), "subject_id")
    frac, pv = F.col("outside_ci_fraction"), F.col("p_value_msd")
    return out.withColumn("is_time_varying", F.when(
        pv.isNotNull(), (pv < alpha) | (frac > 0.05)).otherwise(frac > 0.10))


def simple_tv_decision(msd="global_msd", outside="outside_ci_fraction"):
    return (F.col(msd) > 1e-4) | (F.col(outside) > 0.10)
