"""Registered queries: signal preparation, graph autoregression models, transfer functions, cohort statistics.

Most run on the ledger signals (16 subjects, 7 channels, T grows with the
tables) over the ring graph of 7 channels, whose spectrum has a closed form,
with P = 2, K = 1, windows of 100 samples and steps of 50.
"""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from graphdyn.functions import scalars as fn
from graphdyn.operators import blocks as bl
from graphdyn.operators import graph_var as gv
from graphdyn.operators import graphs as gr
from graphdyn.operators import moments as mo
from graphdyn.operators import prep
from graphdyn.operators import stats as st
from graphdyn.operators import surrogate as su
from graphdyn.operators import transfer as tr
from graphdyn.plans import cohort
from graphdyn.plans import oracle_parts as o
from graphdyn.plans.catalog import query
from graphdyn.plans.network_queries import (
    _ARCS, _GRAPH, _KSUBJ, _NORM, N1, _binar, _distance_sql, _graph)
from graphdyn.schema import PRESETS, Preset
from graphdyn.session import cut_lineage
from graphdyn.sources import fixtures as fx

N, P, K, LEN, STEP, OMEGA = fx.LEDGER_CHANNELS, 2, 1, 100, 50, 32


def _ring(spark):
    lap = gr.normalised_from_edges(fx.ring_edges(spark, N), "graph_id")
    return gr.packed_basis(gr.graph_fourier_basis(lap, "graph_id"), "graph_id")


def _dense(spark, d):
    return bl.dense_grid(fx.signals_ledger(spark, d), N)


def _models(spark, d):
    return cohort.fit_cohort(fx.signals_ledger(spark, d), _ring(spark), N, length=LEN, step=STEP,
                             P=P, K=K)


def _split(spark, d):
    m = cut_lineage(_models(spark, d))
    return gv.tv_models(m, LEN, STEP), gv.lti_models(m)


def _paired(spark, d):
    tv, lti = _split(spark, d)
    return tr.paired_surface(tv, lti, _ring(spark), n_omega=OMEGA, p_max=P)


def _surface(spark, d):
    return tr.surface_stats(_paired(spark, d))


def _pass(spark, d):
    """Window distances and surface sums from one evaluation of the models."""
    tv, lti = _split(spark, d)
    parts = cut_lineage(tr.surface_pass(tr.paired_models(tv, lti, _ring(spark)), n_omega=OMEGA))
    return tr.pass_msd(parts), tr.pass_stats(parts, OMEGA)


# -- preparation ----------------------------------------------------------------------

@query("subject_id grp channel:i t:l value:r6", f"""WITH {o.EVENTS}, {o.dense('ev', 5)}
SELECT * FROM grid""")
def dense_grid(spark, d):
    return bl.dense_grid(fx.signals_events(spark, d), fx.EVENT_CHANNELS)


@query("subject_id grp channel:i t:l value:r6", f"""WITH {o.SHIP}
SELECT subject_id, grp, channel, t // 7 AS t, avg(value) AS value FROM ship GROUP BY ALL""")
def resample(spark, d):
    return prep.resample_mean(fx.signals_shipments(spark, d), 7.0, 1.0)


_UP, _DOWN = bl.resample_rates(100.0, 64.0)
_KERNEL = bl.resample_taps(_UP, _DOWN)
_LONG = prep.bandpass_taps(0.5, 40.0, 256.0, 330)


@query("subject_id grp channel:i t:l value:r3", f"""WITH {o.LEDGER},
span AS (SELECT subject_id, max(t) + 1 AS n_samples FROM led GROUP BY ALL),
taps AS (SELECT unnest(range({len(_KERNEL)})) - {len(_KERNEL) // 2} AS k, unnest([{', '.join(repr(v) for v in _KERNEL)}]) AS h),
part AS (SELECT l.subject_id, l.grp, l.channel, (l.t * {_UP} + k) // {_DOWN} AS t, sum(h * value) AS value
         FROM led l JOIN taps ON (l.t * {_UP} + k) % {_DOWN} = 0 AND l.t * {_UP} + k >= 0 GROUP BY ALL),
ticks AS (SELECT DISTINCT l.subject_id, l.grp, unnest(range((n_samples * {_UP} + {_DOWN} - 1) // {_DOWN})) AS t
          FROM led l JOIN span USING (subject_id))
SELECT k.subject_id, k.grp, c.range AS channel, k.t, coalesce(p.value, 0.0) AS value
FROM ticks k CROSS JOIN range(7) c LEFT JOIN part p
  ON p.subject_id = k.subject_id AND p.t = k.t AND p.channel = c.range""")
def resample_rational(spark, d):
    """100 Hz to 64 Hz through a polyphase bank with anti-alias cut-off."""
    return bl.to_rows(bl.resample(fx.signals_ledger(spark, d), N, 100.0, 64.0))


@query("subject_id grp channel:i n:l total:r3 energy:r1", f"""WITH {o.LEDGER},
span AS (SELECT subject_id, max(t) + 1 AS n_samples FROM led GROUP BY ALL),
taps AS (SELECT unnest(range(661)) - 330 AS k, unnest([{', '.join(repr(v) for v in _LONG)}]) AS h),
y AS (SELECT l.subject_id, l.grp, l.channel, l.t + k AS t, any_value(n_samples) AS n, sum(h * value) AS v
      FROM led l CROSS JOIN taps JOIN span ON span.subject_id = l.subject_id AND l.t + k >= 0 AND l.t + k < n_samples
      GROUP BY ALL)
SELECT subject_id, grp, channel, any_value(n) AS n, sum(v) AS total, sum(v * v) / 1e6 AS energy FROM y GROUP BY ALL""")
def bandpass_fir_published(spark, d):
    """The published band at 256 Hz needs 661 taps; blocks are convolved by overlap-save."""
    x = bl.block_sums(bl.prepare(fx.signals_ledger(spark, d), N, taps=_LONG))
    grp = F.when(F.col("subject_id").cast("int") < fx.LEDGER_SUBJECTS // 2, "A").otherwise("B")
    return x.withColumn("grp", grp).withColumn("energy", F.col("energy") / 1e6)


_TAPS = prep.bandpass_taps(0.5, 40.0, 100.0, 10)


@query("subject_id grp channel:i t:l value:r3", f"""WITH {o.LEDGER_DENSE},
taps AS (SELECT unnest(range(21)) AS k, unnest([{', '.join(repr(v) for v in _TAPS)}]) AS h)
SELECT g.subject_id, g.grp, g.channel, g.t, sum(h * coalesce(x.value, 0)) AS value
FROM grid g CROSS JOIN taps LEFT JOIN grid x ON x.subject_id = g.subject_id
  AND x.channel = g.channel AND x.t = g.t - k + 10 GROUP BY ALL""")
def bandpass_fir(spark, d):
    return bl.to_rows(bl.prepare(fx.signals_ledger(spark, d), N, taps=_TAPS))


@query("kind subject_id channel:i n:l total:r5 energy:r1", f"""WITH {o.LEDGER_DENSE},
car AS (
  SELECT 'average' AS kind, *, value - avg(value) OVER (PARTITION BY subject_id, t) AS v FROM grid
  UNION ALL SELECT 'named', *, value - avg(CASE WHEN channel IN (1, 3) THEN value END)
    OVER (PARTITION BY subject_id, t) FROM grid)
SELECT kind, subject_id, channel, count(*) AS n, sum(v) AS total, sum(v * v) / 1e6 AS energy
FROM car GROUP BY ALL""")
def common_average_reference(spark, d):
    out = None
    for kind, ref in (("average", "average"), ("named", [1, 3])):
        p = bl.block_sums(bl.prepare(fx.signals_ledger(spark, d), N, reference=ref)).withColumn("kind", F.lit(kind))
        out = p if out is None else out.unionByName(p)
    return out.withColumn("energy", F.col("energy") / 1e6)


@query("subject_id grp channel:i t:l value:r6", f"""WITH {o.LEDGER_Z}
SELECT subject_id, grp, channel, t, x AS value FROM zs""")
def zscore(spark, d):
    return bl.to_rows(bl.prepare(fx.signals_ledger(spark, d), N, standardise=True))


@query("subject_id split n:l t_min:l t_max:l total:r4", f"""WITH {o.LEDGER_DENSE}
SELECT subject_id, CASE WHEN t < floor(0.70::DOUBLE * n_samples) THEN 'train'
       WHEN t < floor(0.85::DOUBLE * n_samples) THEN 'val' END AS split,
       count(*) AS n, min(t) AS t_min, max(t) AS t_max, sum(value) AS total
FROM grid GROUP BY ALL""")
def temporal_split(spark, d):
    return prep.temporal_split(_dense(spark, d)).groupBy("subject_id", "split").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("t_min"), F.max("t").alias("t_max"),
        F.sum("value").alias("total"))


@query("subject_id window_idx:l start_idx:l end_idx:l n:l total:r4", f"""WITH {o.LEDGER},
span AS (SELECT subject_id, max(t) + 1 AS n_samples FROM led GROUP BY ALL),
wins AS (SELECT subject_id, unnest(range((n_samples - 100) // 50 + 1)) AS window_idx
         FROM span WHERE n_samples >= 100)
SELECT w.subject_id, window_idx, window_idx * 50 AS start_idx, window_idx * 50 + 100 AS end_idx,
       count(*) AS n, sum(value) AS total
FROM wins w JOIN led l ON l.subject_id = w.subject_id AND l.t >= window_idx * 50
  AND l.t < window_idx * 50 + 100 GROUP BY ALL""")
def sliding_windows(spark, d):
    w = prep.sliding_windows(fx.signals_ledger(spark, d), LEN, STEP)
    return w.groupBy("subject_id", "window_idx", "start_idx", "end_idx").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


@query("subject_id surrogate:i channel:i n:l first:r6 weighted:r3", f"""WITH {o.LEDGER_Z},
rolled AS (SELECT z.subject_id, channel, s.range AS surrogate, x,
                  (t + 31 * channel + 177 * s.range) % n_samples AS t
           FROM zs z CROSS JOIN range(1, 4) s)
SELECT subject_id, surrogate, channel, count(*) AS n, max(CASE WHEN t = 0 THEN x END) AS first,
       sum(x * t) AS weighted FROM rolled GROUP BY ALL""")
def circular_shift_surrogate(spark, d):
    z = bl.prepare(fx.signals_ledger(spark, d), N, standardise=True)
    return bl.block_sums(bl.circular_shift(z, 3, lambda s, c: 31 * c + 177 * s), "surrogate")


@query("subject_id surrogate:i channel:i n:l total:r4 energy:r3 first:r6 weighted:r1", f"""WITH {o.LEDGER_DENSE},
car AS (SELECT *, value - avg(value) OVER (PARTITION BY subject_id, t) AS v FROM grid),
st AS (SELECT subject_id, channel, avg(v) AS mu, stddev_pop(v) AS sd FROM car GROUP BY ALL),
zc AS (SELECT c.subject_id, c.n_samples, c.channel, c.t, greatest(-10.0, least(10.0, (v - mu) / greatest(sd, 1e-8))) AS x
       FROM car c JOIN st USING (subject_id, channel)),
taps AS (SELECT unnest(range(21)) AS k, unnest([{', '.join(repr(v) for v in _TAPS)}]) AS h),
fir AS (SELECT g.subject_id, g.n_samples, g.channel, g.t, sum(h * coalesce(z.x, 0)) AS y
        FROM zc g CROSS JOIN taps LEFT JOIN zc z ON z.subject_id = g.subject_id AND z.channel = g.channel
          AND z.t = g.t - k + 10 GROUP BY ALL),
rolled AS (SELECT subject_id, channel, s.range AS surrogate, y, (t + 31 * channel + 177 * s.range) % n_samples AS t
           FROM fir CROSS JOIN range(1, 3) s)
SELECT subject_id, surrogate, channel, count(*) AS n, sum(y) AS total, sum(y * y) AS energy,
       max(CASE WHEN t = 0 THEN y END) AS first, sum(y * t) AS weighted FROM rolled GROUP BY ALL""")
def preparation_chain(spark, d):
    """Fill, average reference, z-score, filter and shift in one chain: the samples are gathered once."""
    x = bl.prepare(fx.signals_ledger(spark, d), N, reference="average", standardise=True, taps=_TAPS)
    return bl.block_sums(bl.circular_shift(x, 2, lambda s, c: 31 * c + 177 * s), "surrogate")


@query("subject_id channel:i t:l value:r6 lag_1:r6 lag_2:r6", f"""WITH {o.LEDGER}
SELECT subject_id, channel, t, value,
       CASE WHEN lag(t, 1) OVER w = t - 1 THEN lag(value, 1) OVER w END AS lag_1,
       CASE WHEN lag(t, 1) OVER w = t - 2 THEN lag(value, 1) OVER w
            WHEN lag(t, 2) OVER w = t - 2 THEN lag(value, 2) OVER w END AS lag_2
FROM led WINDOW w AS (PARTITION BY subject_id, channel ORDER BY t)""")
def lag_join(spark, d):
    return prep.lagged(fx.signals_ledger(spark, d), 2, pane=256)


# -- model pieces -----------------------------------------------------------------------

@query("subject_id t:l energy:r6 smoothness:r6", f"""WITH {o.LEDGER_Z}, {o.lap('zs')}
SELECT subject_id, t, sum(x * x) AS energy, sum(x * lx) AS smoothness FROM shifted GROUP BY ALL""")
def graph_fourier_transform(spark, d):
    """Signal energy and smoothness x'Lx from the spectral coefficients."""
    sig, ring = fx.signals_ledger(spark, d), _ring(spark)
    s = mo.graph_fourier_transform(sig, ring, N, stats=mo.recording_stats(sig, N))
    lam = ring.select(F.posexplode("lam").alias("mode", "lambda"))
    e = F.col("s") * F.col("s")
    return s.join(lam, "mode").groupBy("subject_id", "t").agg(
        F.sum(e).alias("energy"), F.sum(e * F.col("lambda")).alias("smoothness"))


@query("subject_id channel:i t:l y:r6 f1:r6 f2:r6 f3:r6 f4:r6", f"""WITH {o.LEDGER_Z},
{o.lap('zs')}, {o.FEATURES} SELECT * FROM feat WHERE t >= 2""")
def graph_var_features(spark, d):
    sig = fx.signals_ledger(spark, d)
    f = mo.graph_var_features(sig, _ring(spark), N, P, K, stats=mo.recording_stats(sig, N))
    return f.select("subject_id", "channel", "t", "y",
                    *[F.col("f")[k].alias(f"f{k + 1}") for k in range(4)])


_KEY = "subject_id, grp, window_idx"
_GRAM = (f"{o.LEDGER_Z}, {o.lap('zs')}, {o.FEATURES}, {o.scopes(LEN, STEP)},"
         f" {o.gram(4, _KEY)}")


@query("subject_id window_idx:l n_obs:l s1:r6 yy:r6 g11:r6 g12:r6 g13:r6 g14:r6 g22:r6 g23:r6 g24:r6"
       " g33:r6 g34:r6 g44:r6 v1:r6 v2:r6 v3:r6 v4:r6", f"WITH {_GRAM} SELECT * FROM gram")
def graph_var_moments(spark, d):
    return _moment_cells(mo.graph_var_moments(
        fx.signals_ledger(spark, d), _ring(spark), N, orders=F.array(F.lit(P)), k_max=K, p_max=P, length=LEN, step=STEP))


@query("subject_id window_idx:l n_obs:l s1:r6 yy:r6 g11:r6 g12:r6 g13:r6 g14:r6 g22:r6 g23:r6 g24:r6"
       " g33:r6 g34:r6 g44:r6 v1:r6 v2:r6 v3:r6 v4:r6", f"WITH {_GRAM} SELECT * FROM gram")
def graph_var_moments_on_edges(spark, d):
    """The same moments from powers of the graph along its edges; no eigenbasis is made or sent."""
    lap = gr.normalised_from_edges(fx.ring_edges(spark, N), "graph_id")
    return _moment_cells(mo.graph_var_moments(
        fx.signals_ledger(spark, d), mo.packed_laplacian(lap, "graph_id"), N, orders=F.array(F.lit(P)), k_max=K, p_max=P,
        length=LEN, step=STEP))


def _moment_cells(m):
    def a(j, p, q):
        return F.col("a")[j * 9 + p * 3 + q]

    order = [(p, k) for p in (1, 2) for k in (0, 1)]
    cells = {f"g{x + 1}{y + 1}": a(order[x][1] + order[y][1], order[x][0], order[y][0])
             for x in range(4) for y in range(x, 4)}
    cells |= {f"v{x + 1}": a(order[x][1], order[x][0], 0) for x in range(4)}
    return m.select("subject_id", "window_idx", "n_obs", "s1", a(0, 0, 0).alias("yy"),
                    *[c.alias(n) for n, c in cells.items()])


_M = o.ledger_models(LEN, STEP)
_H = ", ".join(f"h{k} AS h{k}" for k in range(1, 5))


def _flat(models):
    return models.select("*", *[F.col("h")[k].alias(f"h{k + 1}") for k in range(4)])


@query("subject_id h1:r6 h2:r6 h3:r6 h4:r6", f"WITH {_M} SELECT * FROM models WHERE scope = 'lti'")
def graph_var_fit(spark, d):
    return _flat(_models(spark, d).filter("scope = 'lti'"))


@query("subject_id window_idx:l rho:r6", f"WITH {_M} SELECT * FROM models")
def spectral_radius(spark, d):
    return _models(spark, d)


@query("subject_id window_idx:l n_obs:l rss:r6 r2:r6 mse:r6 bic:r6", f"WITH {_M} SELECT * FROM models")
def graph_var_evaluate(spark, d):
    return _models(spark, d)


@query("subject_id grp h1:r6 h2:r6 h3:r6 h4:r6 rho:r6 n_obs:l rss:r6 r2:r6 bic:r6",
       f"WITH {_M} SELECT * FROM models WHERE scope = 'lti' AND rho < 1.0")
def fit_lti(spark, d):
    return _flat(gv.lti_models(_models(spark, d)))


@query("subject_id grp window_idx:l start_idx:l end_idx:l h1:r6 h2:r6 h3:r6 h4:r6 rho:r6 r2:r6 bic:r6",
       f"""WITH {_M} SELECT *, window_idx * {STEP} AS start_idx, window_idx * {STEP} + {LEN} AS end_idx
FROM models WHERE scope = 'tv' AND rho < 0.99""")
def fit_tv(spark, d):
    return _flat(gv.tv_models(_models(spark, d), LEN, STEP))


_COEF = f"""{_M},
long AS (SELECT subject_id, grp, unnest([0, 1, 2, 3]) AS coef, unnest([h1, h2, h3, h4]) AS v
         FROM models WHERE scope = 'tv' AND rho < 0.99),
cv AS (SELECT subject_id, grp, coef, avg(v) AS h_mean, stddev_pop(v) AS h_std,
       stddev_pop(v) / (abs(avg(v)) + 1e-8) AS h_cv FROM long GROUP BY ALL)"""


@query("subject_id coef:i h_mean:r6 h_std:r6 h_cv:r4", f"WITH {_COEF} SELECT * FROM cv")
def coefficient_variation(spark, d):
    return gv.coefficient_variation(gv.tv_models(_models(spark, d), LEN, STEP))


@query("subject_id global_coeff_cv:r4", f"""WITH {_COEF}
SELECT subject_id, avg(h_cv) AS global_coeff_cv FROM cv GROUP BY ALL""")
def global_coefficient_cv(spark, d):
    return gv.global_coefficient_cv(gv.tv_models(_models(spark, d), LEN, STEP))


# -- grid and selection ---------------------------------------------------------------

def _grid_sql() -> str:
    """P in {1, 2} x K in {0, 1}: four solved systems per subject, scored on the validation rows."""
    base = f"""{o.LEDGER_DENSE},
tr AS (SELECT subject_id, channel, avg(value) AS mu, stddev_pop(value) AS sd FROM grid
       WHERE t < floor(0.70::DOUBLE * n_samples) GROUP BY ALL),
zt AS (SELECT subject_id || '|train' AS subject_id, grp, n_samples, channel, t,
         greatest(-10.0, least(10.0, (value - mu) / greatest(sd, 1e-8))) AS x
       FROM grid JOIN tr USING (subject_id, channel) WHERE t < floor(0.70::DOUBLE * n_samples)
       UNION ALL
       SELECT subject_id || '|val', grp, n_samples, channel,
         t - CAST(floor(0.70::DOUBLE * n_samples) AS BIGINT),
         greatest(-10.0, least(10.0, (value - mu) / greatest(sd, 1e-8)))
       FROM grid JOIN tr USING (subject_id, channel) WHERE t >= floor(0.70::DOUBLE * n_samples)
         AND t < floor(0.85::DOUBLE * n_samples)),
{o.lap('zt')}, {o.FEATURES}"""
    picks = {(1, 0): ["f1"], (1, 1): ["f1", "f2"], (2, 0): ["f1", "f3"],
             (2, 1): ["f1", "f2", "f3", "f4"]}
    parts = []
    for (p, k), cols in picks.items():
        n = len(cols)
        ren = ", ".join(f"{c} AS f{x + 1}" for x, c in enumerate(cols))
        tag = f"p{p}k{k}"
        h = [f"h{x}" for x in range(1, n + 1)]
        taps = {(1, 0): ("h1", "0"), (1, 1): ("h1 + h2 * lam", "0"), (2, 0): ("h1", "h2"),
                (2, 1): ("h1 + h2 * lam", "h3 + h4 * lam")}[(p, k)]
        hr = " + ".join(f"t.{a} * v.v{x + 1}" for x, a in enumerate(h))
        hgh = " + ".join(f"t.h{a} * t.h{b} * v.g{min(a, b)}{max(a, b)}"
                         for a in range(1, n + 1) for b in range(1, n + 1))
        inner = (f"WITH src AS (SELECT subject_id, grp, y, {ren} FROM feat WHERE t >= {p}), "
                 f"{o.gram(n, 'subject_id, grp', 'src')}, {o.solve(n, 'subject_id, grp')} "
                 f"SELECT * FROM sol")
        parts.append(f"""{tag} AS ({inner}),
{tag}r AS (SELECT subject_id, max(CASE WHEN a * a + 4 * b >= 0 THEN
    greatest(abs(a + sqrt(a * a + 4 * b)), abs(a - sqrt(a * a + 4 * b))) / 2 ELSE sqrt(-b) END) AS rho
  FROM (SELECT subject_id, {taps[0]} AS a, {taps[1]} AS b FROM {tag} CROSS JOIN lams) GROUP BY ALL),
{tag}s AS (SELECT replace(t.subject_id, '|train', '') AS subject_id, t.grp, {p} AS P, {k} AS K,
    rho, v.n_obs, v.yy - 2 * ({hr}) + ({hgh}) AS rss, v.yy - v.s1 * v.s1 / v.n_obs AS tss,
    {n} AS width
  FROM {tag} t JOIN {tag} v ON v.subject_id = replace(t.subject_id, '|train', '|val')
  JOIN {tag}r r ON r.subject_id = t.subject_id WHERE t.subject_id LIKE '%|train')""")
    lams = ("lams AS (SELECT range AS mode, 1 - cos(2 * pi() * ((range + 1) // 2) / 7) AS lam"
            " FROM range(7))")
    union = " UNION ALL ".join(f"SELECT * FROM p{p}k{k}s" for p, k in picks)
    return (f"{base}, {lams}, {', '.join(parts)}, model_grid AS (SELECT *, rss / n_obs AS mse,"
            f" 1 - rss / (tss + 1e-10) AS r2, n_obs * ln(rss / n_obs + 1e-10) + width * ln(n_obs)"
            f" AS bic, rho < 1.0 AS stable FROM ({union}))")


_GRID = _grid_sql()
_PICK = f"""{_GRID}, ranked AS (SELECT *, row_number() OVER (PARTITION BY subject_id
  ORDER BY bic, K, P) AS rn FROM model_grid WHERE stable), picked AS (SELECT * FROM ranked WHERE rn = 1)"""


def _grid(spark, d):
    return gv.model_grid(fx.signals_ledger(spark, d), _ring(spark), N, (1, 2), (0, 1))


@query("subject_id grp P:i K:i rho:r6 n_obs:l rss:r6 r2:r6 mse:r6 bic:r6 stable:b",
       f"WITH {_GRID} SELECT * FROM model_grid")
def model_grid(spark, d):
    return _grid(spark, d)


def _published_grid(spark, d):
    full = PRESETS["qc"]
    return gv.model_grid(fx.signals_ledger(spark, d), _ring(spark), N, full.p_grid, full.k_grid)


@query("subject_id grp P:i K:i rho:r6 n_obs:l rss:r6 r2:r6 mse:r6 bic:r6 stable:b")
def model_grid_published(spark, d):
    """All 100 cells of the published grid; ``model_grid`` is the part that SQL can solve."""
    return _published_grid(spark, d)


@query("subject_id grp P:i K:i n_obs:l residual:r6 fitted:b", f"""WITH {o.LEDGER},
span AS (SELECT subject_id, grp, max(t) + 1 AS n FROM led GROUP BY ALL)
SELECT subject_id, grp, p.range AS P, k.range AS K,
       7 * (CAST(floor(0.85::DOUBLE * n) AS BIGINT) - CAST(floor(0.70::DOUBLE * n) AS BIGINT) - p.range) AS n_obs,
       0.0 AS residual, true AS fitted FROM span CROSS JOIN range(1, 21) p CROSS JOIN range(5) k""")
def model_grid_normal_equations(spark, d):
    """Every cell of the published grid solves its normal equations on all its rows."""
    return _published_grid(spark, d).withColumn("fitted", F.col("h").isNotNull())


@query("subject_id grp P:i K:i best_bic:r6", f"""WITH {_PICK}
SELECT *, bic AS best_bic FROM picked""")
def select_model(spark, d):
    return gv.select_model(_grid(spark, d))


@query("subject_id K:i P1:r6 P2:r6", f"""WITH {_GRID}
SELECT subject_id, K, max(CASE WHEN P = 1 AND stable THEN bic END) AS P1,
       max(CASE WHEN P = 2 AND stable THEN bic END) AS P2 FROM model_grid GROUP BY ALL""")
def bic_matrix(spark, d):
    return gv.selection_matrix(_grid(spark, d), (1, 2))


@query("subject_id P:i K:i p_at_lower:b p_at_upper:b k_at_lower:b k_at_upper:b", f"""WITH {_PICK}
SELECT *, P = 1 AS p_at_lower, P = 2 AS p_at_upper, K = 0 AS k_at_lower, K = 1 AS k_at_upper
FROM picked""")
def boundary_flags(spark, d):
    s = gv.select_model(_grid(spark, d))
    return s.select("*", *[c.alias(n) for n, c in
                           fn.boundary_flags("P", "K", (1, 2), (0, 1)).items()])


_ORDERS = f"""{_PICK},
long AS (SELECT grp, 'P' AS name, P AS v FROM picked UNION ALL SELECT grp, 'K', K FROM picked),
freq AS (SELECT grp, name, v, row_number() OVER (PARTITION BY grp, name ORDER BY count(*) DESC, v)
         AS rn FROM long GROUP BY grp, name, v)"""


@query("grp name n:l mean:r6 std:r6 lo:i hi:i most_frequent:i", f"""WITH {_ORDERS}
SELECT l.grp, l.name, count(*) AS n, avg(l.v) AS mean, stddev_samp(l.v) AS std, min(l.v) AS lo,
       max(l.v) AS hi, any_value(f.v) AS most_frequent
FROM long l JOIN freq f ON f.grp = l.grp AND f.name = l.name AND f.rn = 1 GROUP BY ALL""")
def model_order_summary(spark, d):
    return st.model_order_summary(cut_lineage(gv.select_model(_grid(spark, d))))


@query("grp P:i K:i n:l", f"WITH {_PICK} SELECT grp, P, K, count(*) AS n FROM picked GROUP BY ALL")
def model_order_histogram(spark, d):
    return st.model_order_histogram(gv.select_model(_grid(spark, d)))


@query("metric n_a:l n_b:l t_stat:r6 df:r6", f"""WITH {_ORDERS},
{o.two_groups('long', 'name', 'v')} SELECT name AS metric, *, {o.STUDENT} FROM gm""")
def model_order_test(spark, d):
    return st.model_order_test(gv.select_model(_grid(spark, d)), p_values=False)


# -- transfer functions -----------------------------------------------------------------

_S = re.sub(r"\b(led|models|tf|paired) AS \(", r"\1 AS MATERIALIZED (", o.ledger_surfaces())


@query("subject_id scope window_idx:l omega_idx:i mode:i re:r6 im:r6 mag:r6 phase:r6",
       f"""WITH {_S}
SELECT *, dre / (dre*dre + dim*dim) AS re, -dim / (dre*dre + dim*dim) AS im,
       1 / sqrt(dre*dre + dim*dim) AS mag, atan2(-dim, dre) AS phase FROM tf WHERE scope = 'lti'""")
def transfer_function(spark, d):
    return tr.transfer_function(gv.lti_models(_models(spark, d)), _ring(spark), n_omega=OMEGA,
                                p_max=P)


@query("guard n:l mag_sum:r4", f"""WITH {_S}
SELECT unnest(['add', 'rescale', 'fail']) AS guard, count(*) AS n,
       sum(1 / sqrt(dre*dre + dim*dim)) AS mag_sum FROM tf WHERE scope = 'lti'""")
def transfer_guards(spark, d):
    """No pole is near here, so the three guards must agree."""
    lti, ring = cut_lineage(gv.lti_models(_models(spark, d))), _ring(spark)
    out = None
    for g in ("add", "rescale", "fail"):
        part = tr.transfer_function(lti, ring, n_omega=OMEGA, p_max=P, guard=g).agg(
            F.count(F.lit(1)).alias("n"), F.sum("mag").alias("mag_sum")).withColumn("guard", F.lit(g))
        out = part if out is None else out.unionByName(part)
    return out


@query("subject_id window_idx:l omega_idx:i mode:i g_tv:r6 g_lti:r6", f"WITH {_S} SELECT * FROM paired")
def lti_tv_join(spark, d):
    m = cut_lineage(_models(spark, d))
    both = gv.lti_models(m).unionByName(gv.tv_models(m, LEN, STEP).drop("start_idx", "end_idx"))
    return tr.join_surfaces(tr.transfer_function(both, _ring(spark), n_omega=OMEGA, p_max=P))


@query("subject_id omega_idx:i mode:i freq_hz:r6 lambda:r6 g_lti:r6 tv_mean:r6 tv_std:r6 tv_var:r6"
       " n_windows:l", f"WITH {_S} SELECT *, lam AS lambda FROM surface".replace(
           "lam AS lambda", 'lam AS "lambda"'))
def compare_tf_surface(spark, d):
    return _surface(spark, d)


@query("subject_id window_idx:l msd:r6", f"WITH {_S} SELECT * FROM msd")
def msd_per_window(spark, d):
    return tr.msd_per_window(_paired(spark, d))


@query("subject_id grp global_msd:r6 n_windows:l global_variance:r6 outside_ci_fraction:r6",
       f"WITH {_S} SELECT * FROM gmsd JOIN extent USING (subject_id, grp)")
def compare_tf(spark, d):
    windows, surface = _pass(spark, d)
    return tr.mean_msd(windows).join(tr.surface_summary(surface), ["subject_id", "grp"])


@query("subject_id axis idx:i g_lti:r6 tv_mean:r6 tv_std:r6", f"""WITH {_S},
pw AS (SELECT subject_id, 'mode' AS axis, window_idx, mode AS idx, avg(g_tv) AS v, avg(g_lti) AS l
       FROM paired GROUP BY ALL UNION ALL
       SELECT subject_id, 'freq', window_idx, omega_idx, avg(g_tv), avg(g_lti) FROM paired GROUP BY ALL)
SELECT subject_id, axis, idx, avg(l) AS g_lti, avg(v) AS tv_mean, stddev_pop(v) AS tv_std
FROM pw GROUP BY ALL""")
def tf_marginals(spark, d):
    return tr.marginals(_paired(spark, d))


@query("subject_id mean_cv:r6 cv_time_varying:b", f"""WITH {_S}
SELECT subject_id, avg(tv_std / (tv_mean + 1e-8)) AS mean_cv,
       avg(tv_std / (tv_mean + 1e-8)) > 0.1 AS cv_time_varying FROM surface GROUP BY ALL""")
def tf_cv(spark, d):
    return tr.tf_cv(_surface(spark, d))


@query("subject_id omega_idx:i mode:i ci_lower:r6 ci_upper:r6", f"WITH {_S} SELECT * FROM band")
def tv_confidence_band(spark, d):
    return tr.confidence_band(_surface(spark, d))


@query("subject_id mode:i tv_mean:r6 tv_std:r6 ci_lower:r6 ci_upper:r6", f"""WITH {_S},
line AS (SELECT subject_id, window_idx, mode, avg(g_tv) AS tv FROM paired GROUP BY ALL)
SELECT subject_id, mode, avg(tv) AS tv_mean, stddev_pop(tv) AS tv_std,
       avg(tv) - 1.96 * stddev_pop(tv) / sqrt(count(*)) AS ci_lower,
       avg(tv) + 1.96 * stddev_pop(tv) / sqrt(count(*)) AS ci_upper FROM line GROUP BY ALL""")
def mode_confidence_band(spark, d):
    return tr.mode_confidence_band(_paired(spark, d))


# -- surrogate test and decisions ---------------------------------------------------------

def _offset(s, c):
    """Offsets of the checked surrogates: a formula that SQL can repeat."""
    return (s * 7919 + c * 104729) % 1009 * (c + 1)


_OFFSET = "((s.range * 7919 + channel * 104729) % 1009 * (channel + 1))"


@query("subject_id grp surrogate:i global_msd:r6 n_windows:l",
       f"WITH {o.LEDGER_Z} SELECT * FROM {o.surrogate_null(20, _OFFSET)}")
def surrogate_null(spark, d):
    return su.surrogate_null(fx.signals_ledger(spark, d), _ring(spark), N, P=P, K=K, length=LEN,
                             step=STEP, n_surrogates=20, n_omega=OMEGA, shift=_offset)


@query("subject_id grp surrogate:i global_msd:r6 n_windows:l")
def surrogate_null_published(spark, d):
    """200 hashed surrogates at the orders selected per subject, on the published frequency grid."""
    sig, ring, pre = fx.signals_ledger(spark, d), _ring(spark), PRESETS["subject"]
    orders = cut_lineage(gv.select_model(_grid(spark, d)))
    return su.surrogate_null(sig, ring, N, orders=orders, p_max=5, k_max=2, length=LEN, step=STEP,
                             n_omega=pre.n_omega, guard=pre.guard)


_NULLISH = f"""{_S},
tv AS (SELECT g.subject_id, g.grp, global_msd AS observed_msd, outside_ci_fraction,
         (SELECT count(*) FROM msd m WHERE m.subject_id = g.subject_id) AS n_valid,
         (SELECT avg(CAST(m.msd >= g.global_msd AS DOUBLE)) FROM msd m
          WHERE m.subject_id = g.subject_id) AS p_value_msd
       FROM gmsd g JOIN extent USING (subject_id))"""


@query("subject_id observed_msd:r6 n_valid:l p_value_msd:r6 outside_ci_fraction:r6 is_time_varying:b",
       f"""WITH {_NULLISH}
SELECT *, p_value_msd < 0.05 OR outside_ci_fraction > 0.05 AS is_time_varying FROM tv""")
def tv_test(spark, d):
    """The decision rule on a known null: the subject's own window distances."""
    windows, surface = _pass(spark, d)
    null = windows.withColumnRenamed("msd", "global_msd")
    return su.tv_test(null, tr.mean_msd(windows), tr.surface_summary(surface), min_valid=10)


@query("subject_id simple:b", f"""WITH {_S}
SELECT subject_id, global_msd > 1e-4 OR outside_ci_fraction > 0.10 AS simple
FROM gmsd JOIN extent USING (subject_id)""")
def simple_tv_decision(spark, d):
    windows, surface = _pass(spark, d)
    both = tr.mean_msd(windows).join(tr.surface_summary(surface), ["subject_id", "grp"])
    return both.withColumn("simple", su.simple_tv_decision())


@query("subject_id grp P:i K:i duration:r6 lti_r2:r6 lti_bic:r6 lti_rho:r6 n_windows:l global_msd:r6"
       " global_variance:r6 global_coeff_cv:r4 outside_ci_fraction:r6 p_value_msd:r6"
       " is_time_varying:b", f"""WITH {_COEF},
{o.surfaces()}, nulls AS MATERIALIZED {o.surrogate_null(60, _OFFSET)},
pv AS (SELECT subject_id, CASE WHEN count(n.global_msd) >= 50 THEN avg(CAST(n.global_msd >= g.global_msd AS DOUBLE)) END
       AS p_value_msd FROM gmsd g LEFT JOIN nulls n USING (subject_id) GROUP BY subject_id)
SELECT m.subject_id, m.grp, 2 AS P, 1 AS K, n_samples / 100.0 AS duration, r2 AS lti_r2, bic AS lti_bic,
  rho AS lti_rho, n_windows, global_msd, global_variance, global_coeff_cv, outside_ci_fraction, p_value_msd,
  CASE WHEN p_value_msd IS NOT NULL THEN p_value_msd < 0.05 OR outside_ci_fraction > 0.05
       ELSE outside_ci_fraction > 0.10 END AS is_time_varying
FROM models m JOIN gmsd USING (subject_id) JOIN extent USING (subject_id) JOIN pv USING (subject_id)
JOIN (SELECT subject_id, avg(h_cv) AS global_coeff_cv FROM cv GROUP BY ALL) USING (subject_id)
JOIN span USING (subject_id) WHERE scope = 'lti'""")
def subject_test(spark, d):
    """Whole subject analysis with a surrogate null (60 surrogates, offsets by formula)."""
    pre = Preset((1, 2), (0, 1), 1.0, 1.0, 0.99, (2, 1), "add", OMEGA, 5)
    return cohort.subject_test(fx.signals_ledger(spark, d), _ring(spark), N, length=LEN, step=STEP,
                               preset=pre, P=P, K=K, n_surrogates=60, shift=_offset)


@query("subject_id grp P:i K:i duration:r6 lti_r2:r6 lti_bic:r6 lti_rho:r6 n_windows:l global_msd:r6"
       " global_variance:r6 global_coeff_cv:r4 outside_ci_fraction:r6 p_value_msd:r6"
       " is_time_varying:b")
def subject_test_published(spark, d):
    """The published settings: orders selected per subject from 8 x 4 cells, 200 surrogates, 128 frequencies."""
    return cohort.subject_test(fx.signals_ledger(spark, d), _ring(spark), N, length=LEN, step=STEP, n_surrogates=200)


@query("subject_id grp P:i K:i duration:r6 lti_r2:r6 lti_bic:r6 lti_rho:r6 n_windows:l global_msd:r6"
       " global_variance:r6 global_coeff_cv:r4 outside_ci_fraction:r6 is_time_varying:b", f"""WITH {_COEF},
{o.surfaces()}
SELECT m.subject_id, m.grp, 2 AS P, 1 AS K, n_samples / 100.0 AS duration, r2 AS lti_r2, bic AS lti_bic,
  rho AS lti_rho, n_windows, global_msd, global_variance, global_coeff_cv, outside_ci_fraction,
  outside_ci_fraction > 0.10 AS is_time_varying
FROM models m JOIN gmsd USING (subject_id) JOIN extent USING (subject_id)
JOIN (SELECT subject_id, avg(h_cv) AS global_coeff_cv FROM cv GROUP BY ALL) USING (subject_id)
JOIN span USING (subject_id) WHERE scope = 'lti'""")
def subject_summary(spark, d):
    """The same summary without surrogates, so that every column has a closed check."""
    pre = Preset((1, 2), (0, 1), 1.0, 1.0, 0.99, (2, 1), "add", OMEGA, 5)
    return cohort.subject_test(fx.signals_ledger(spark, d), _ring(spark), N, length=LEN, step=STEP,
                               preset=pre, P=P, K=K)


@query("metric u_stat:r6 p_value:r6", f"""WITH {_COEF},
{o.surfaces()},
sub AS MATERIALIZED (SELECT subject_id, m.grp, global_msd, global_variance, global_coeff_cv, outside_ci_fraction
  FROM models m JOIN gmsd USING (subject_id) JOIN extent USING (subject_id)
  JOIN (SELECT subject_id, avg(h_cv) AS global_coeff_cv FROM cv GROUP BY ALL) USING (subject_id)
  WHERE scope = 'lti'),
met AS (SELECT grp, 'global_msd' AS metric, global_msd AS value FROM sub
  UNION ALL SELECT grp, 'global_variance', global_variance FROM sub
  UNION ALL SELECT grp, 'global_coeff_cv', global_coeff_cv FROM sub
  UNION ALL SELECT grp, 'outside_ci_fraction', outside_ci_fraction FROM sub),
tied AS (SELECT metric, sum(c * c * c - c) AS ties FROM (
  SELECT metric, value, CAST(count(*) AS DOUBLE) AS c FROM met GROUP BY metric, value) GROUP BY metric),
u AS MATERIALIZED (SELECT metric, sum(CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5
  ELSE 0 END) AS u_stat, (SELECT count_if(grp = 'A') FROM sub) AS n_a, (SELECT count_if(grp = 'B') FROM sub) AS n_b
  FROM met a JOIN met b USING (metric) WHERE a.grp = 'A' AND b.grp = 'B' GROUP BY metric)
SELECT metric, u_stat, CASE WHEN ties = 0
  THEN {o.rank_tail('greatest(u_stat, n_a * n_b - u_stat)', 'n_a', 'n_b')}
  ELSE {o.normal_rank_tail('greatest(u_stat, n_a * n_b - u_stat)', 'n_a', 'n_b', 'ties')} END AS p_value
FROM u JOIN tied USING (metric)""")
def subject_group_tests(spark, d):
    """Rank tests of the groups on the subject table: exact without ties, else the corrected normal tail."""
    return cohort.group_comparison(cut_lineage(subject_summary(spark, d)))["metrics"]


# -- quality control ------------------------------------------------------------------------

_QC = Preset((1, 2), (0, 1), 0.95, 0.15, 0.35, (2, 1), "fail", OMEGA, 10, 0.0005)


def _facts(spark, d):
    sig = fx.signals_ledger(spark, d)
    m = cut_lineage(_models(spark, d))
    chosen = m.filter("scope = 'lti'").select("subject_id")
    return cut_lineage(cohort.qc_facts(sig, m, chosen, _ring(spark), n_channels=N, length=LEN,
                                       step=STEP, preset=_QC, p_max=P, n_omega=OMEGA))


_GATE = f"""{_M},
nw AS (SELECT subject_id, count(*) AS n_windows FROM models WHERE scope = 'tv' AND rho < 0.35 GROUP BY ALL),
facts AS (SELECT m.subject_id, m.grp, rho AS lti_rho, r2 AS lti_r2, coalesce(n_windows, 0) AS n_windows
          FROM models m LEFT JOIN nw USING (subject_id) WHERE scope = 'lti'),
gate AS (SELECT *, CASE WHEN lti_rho >= 0.15 THEN 'LTI_unstable' WHEN lti_r2 < 0.0005 THEN 'Low_R2'
           WHEN n_windows < 10 THEN 'Too_few_stable_windows' ELSE 'Completed' END AS reason FROM facts),
qlog AS (SELECT *, CASE WHEN reason = 'Completed' THEN 'SUCCESS' ELSE 'REJECT' END AS status,
  CASE reason WHEN 'LTI_unstable' THEN 'rho=' || format('{{:.4f}}', lti_rho)
    WHEN 'Low_R2' THEN 'R2=' || format('{{:.4f}}', lti_r2)
    WHEN 'Too_few_stable_windows' THEN 'n=' || n_windows
    ELSE 'R2=' || format('{{:.3f}}', lti_r2) END AS detail_1,
  CASE reason WHEN 'LTI_unstable' THEN 'threshold=0.15' WHEN 'Low_R2' THEN 'threshold=0.0005'
    WHEN 'Too_few_stable_windows' THEN 'threshold=10'
    ELSE 'rho=' || format('{{:.3f}}', lti_rho) END AS detail_2,
  CASE WHEN reason = 'Completed' THEN 'n_win=' || n_windows ELSE '' END AS detail_3 FROM gate)"""


@query("subject_id grp status reason detail_1 detail_2 detail_3", f"WITH {_GATE} SELECT * FROM qlog")
def qc_gate(spark, d):
    return cohort.qc_gate(_facts(spark, d), _QC)


@query("grp status reason n:l share_pct:r6", f"""WITH {_GATE},
tot AS (SELECT grp, count(*) AS total FROM qlog GROUP BY grp)
SELECT grp, status, reason, count(*) AS n, 100.0 * count(*) / any_value(total) AS share_pct
FROM qlog JOIN tot USING (grp) GROUP BY ALL""")
def qc_report(spark, d):
    return cohort.qc_report(cut_lineage(cohort.qc_gate(_facts(spark, d), _QC)))


@query("grp n:l lti_rho_mean:r6 lti_rho_std:r6 lti_r2_min:r6 lti_r2_max:r6 n_windows_mean:r6",
       f"""WITH {_GATE}
SELECT grp, count(*) AS n, avg(lti_rho) AS lti_rho_mean, stddev_pop(lti_rho) AS lti_rho_std,
       min(lti_r2) AS lti_r2_min, max(lti_r2) AS lti_r2_max, avg(n_windows) AS n_windows_mean
FROM qlog WHERE status = 'SUCCESS' GROUP BY grp""")
def qc_quality(spark, d):
    f = _facts(spark, d)
    return cohort.qc_quality(f, cohort.qc_gate(f, _QC))


# -- cohort statistics ------------------------------------------------------------------------

def _summary(spark, d):
    """Per-subject metrics of the cohort, written once."""
    tv, lti = _split(spark, d)
    parts = cut_lineage(tr.surface_pass(tr.paired_models(tv, lti, _ring(spark)), n_omega=OMEGA))
    chosen = lti.select("subject_id", F.col("bic").alias("best_bic"))
    return cut_lineage(cohort.group_summary_rows(
        fx.signals_ledger(spark, d), lti, tv, tr.pass_msd(parts),
        cut_lineage(tr.pass_stats(parts, OMEGA)), chosen))


_SUM = f"""{_S},
ws AS (SELECT subject_id, count(*) AS nw, avg(r2) AS tv_r2_mean, stddev_pop(r2) AS tv_r2_std,
         avg(rho) AS tv_rho_mean, stddev_pop(rho) AS tv_rho_std
       FROM models WHERE scope = 'tv' AND rho < 0.99 GROUP BY ALL),
cvs AS (SELECT subject_id, avg(tv_std / (tv_mean + 1e-8)) AS mean_cv FROM surface GROUP BY ALL),
summ AS (SELECT m.subject_id, m.grp, 7 AS n_channels, n_samples / 100.0 AS duration, 2 AS best_P,
  1 AS best_K, bic AS best_bic, r2 AS lti_r2, rho AS lti_rho, bic AS lti_bic, tv_r2_mean, tv_r2_std,
  tv_rho_mean, tv_rho_std, nw AS n_windows, global_msd AS mean_msd, mean_cv
  FROM models m JOIN ws USING (subject_id) JOIN cvs USING (subject_id) JOIN gmsd USING (subject_id)
  JOIN span USING (subject_id) WHERE scope = 'lti'),
mets AS (SELECT subject_id, grp, unnest(['lti_r2', 'lti_rho', 'lti_bic', 'tv_r2_mean', 'tv_rho_mean',
  'mean_msd', 'mean_cv']) AS metric, unnest([lti_r2, lti_rho, lti_bic, tv_r2_mean, tv_rho_mean,
  mean_msd, mean_cv]) AS value FROM summ)"""


def _metrics(spark, d):
    return st.unpivot_metrics(_summary(spark, d), cohort.GROUP_METRICS)


@query("subject_id grp n_channels:l duration:r6 best_P:i best_K:i best_bic:r6 lti_r2:r6 lti_rho:r6"
       " lti_bic:r6 tv_r2_mean:r6 tv_r2_std:r6 tv_rho_mean:r6 tv_rho_std:r6 n_windows:l mean_msd:r6"
       " mean_cv:r6", f"WITH {_SUM} SELECT * FROM summ")
def group_summary_rows(spark, d):
    return _summary(spark, d)


_GM = o.two_groups("mets", "metric")


@query("metric n_a:l mean_a:r6 std_a:r6 n_b:l mean_b:r6 std_b:r6 t_stat:r6 df:r6 cohens_d:r6",
       f"""WITH {_SUM}, {_GM}
SELECT *, {o.WELCH}, (mean_a - mean_b) / (sqrt((std_a*std_a + std_b*std_b) / 2) + 1e-10) AS cohens_d
FROM gm""")
def welch_t(spark, d):
    return st.two_group_test(_metrics(spark, d), ["metric"], p_values=False)


@query("metric t_stat:r6 df:r6", f"WITH {_SUM}, {_GM} SELECT *, {o.STUDENT} FROM gm")
def student_t(spark, d):
    return st.two_group_test(_metrics(spark, d), ["metric"], kind="student", p_values=False)


@query("metric d_population:r6 d_sample:r6 d_inside:r6 d_plain:r6", f"""WITH {_SUM}, {_GM}
SELECT metric, (mean_a - mean_b) / (sqrt((std_a*std_a + std_b*std_b) / 2) + 1e-10) AS d_population,
  (mean_a - mean_b) / (sqrt((sd_a*sd_a + sd_b*sd_b) / 2) + 1e-10) AS d_sample,
  (mean_a - mean_b) / sqrt((std_a*std_a + std_b*std_b) / 2 + 1e-10) AS d_inside,
  (mean_a - mean_b) / sqrt((std_a*std_a + std_b*std_b) / 2) AS d_plain FROM gm""")
def cohens_d(spark, d):
    return st.group_moments(_metrics(spark, d), ["metric"]).select(
        "metric", st.cohens_d(0).alias("d_population"), st.cohens_d(1).alias("d_sample"),
        st.cohens_d(0, "inside").alias("d_inside"), st.cohens_d(0, "none").alias("d_plain"))


@query("grp metric n:l mean:r6 std:r6 sem:r6", f"""WITH {_SUM}
SELECT grp, metric, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std,
       stddev_samp(value) / sqrt(count(*)) AS sem FROM mets GROUP BY ALL""")
def t_confidence_interval(spark, d):
    return st.t_confidence_interval(_metrics(spark, d), ["grp", "metric"])


@query("grp metric mean:r6 lower:r6 upper:r6", f"""WITH {_SUM}
SELECT grp, metric, avg(value) AS mean, avg(value) - stddev_pop(value) / sqrt(count(*)) AS lower,
       avg(value) + stddev_pop(value) / sqrt(count(*)) AS upper FROM mets GROUP BY ALL""")
def sem_band(spark, d):
    return st.sem_band(_metrics(spark, d), ["grp", "metric"])


@query("metric n_a:l n_b:l u_stat:r6", f"""WITH {_SUM},
pairs AS (SELECT a.metric, CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5
          ELSE 0 END AS win FROM mets a JOIN mets b USING (metric) WHERE a.grp = 'A' AND b.grp = 'B'),
n AS (SELECT metric, count_if(grp = 'A') AS n_a, count_if(grp = 'B') AS n_b FROM mets GROUP BY metric)
SELECT metric, n_a, n_b, (SELECT sum(win) FROM pairs p WHERE p.metric = n.metric) AS u_stat FROM n""")
def mann_whitney(spark, d):
    return st.mann_whitney(_metrics(spark, d), p_values=False)


@query("metric u_stat:r6 p_value:r6", f"""WITH {_SUM},
pairs AS (SELECT a.metric, CASE WHEN a.value > b.value THEN 1.0 WHEN a.value = b.value THEN 0.5
          ELSE 0 END AS win FROM mets a JOIN mets b USING (metric) WHERE a.grp = 'A' AND b.grp = 'B'),
u AS MATERIALIZED (SELECT n.metric, n_a, n_b, sum(win) AS u_stat FROM pairs JOIN (
       SELECT metric, count_if(grp = 'A') AS n_a, count_if(grp = 'B') AS n_b FROM mets GROUP BY metric) n
       USING (metric) GROUP BY ALL)
SELECT metric, u_stat, {o.rank_tail('greatest(u_stat, n_a * n_b - u_stat)', 'n_a', 'n_b')} AS p_value FROM u""")
def mann_whitney_exact(spark, d):
    """The exact tail, against a count over all placements of the smaller group's ranks."""
    return st.mann_whitney(_metrics(spark, d))


@query("metric u_stat:r6 p_value:r6 effect_r:r6")
def mann_whitney_p(spark, d):
    return st.mann_whitney(_metrics(spark, d))


@query("metric t_stat:r6 df:r6 p_value:r6 significant:b", f"""WITH {_SUM},
{o.two_groups('mets', 'metric')},
wt AS (SELECT metric, {o.WELCH} FROM gm), pv AS (SELECT *, {o.t_tail()} AS p_value FROM wt)
SELECT *, p_value < 0.05 AS significant FROM pv""")
def p_values(spark, d):
    return st.two_group_test(_metrics(spark, d), ["metric"])


_FLAG = f"{_SUM}, fl AS (SELECT grp, mean_msd > 0.0032 AS f FROM summ)"


def _flagged(spark, d):
    return _summary(spark, d).withColumn("is_time_varying", F.col("mean_msd") > 0.0032)


@query("a_tv:l a_lti:l b_tv:l b_lti:l chi2:r6", f"""WITH {_FLAG},
t AS (SELECT count_if(grp = 'A' AND f) AS a_tv, count_if(grp = 'A' AND NOT f) AS a_lti,
             count_if(grp = 'B' AND f) AS b_tv, count_if(grp = 'B' AND NOT f) AS b_lti FROM fl),
u AS (SELECT *, a_tv + a_lti + b_tv + b_lti AS n, unnest([a_tv, a_lti, b_tv, b_lti]) AS ob,
  unnest([(a_tv+a_lti)*(a_tv+b_tv), (a_tv+a_lti)*(a_lti+b_lti), (b_tv+b_lti)*(a_tv+b_tv),
          (b_tv+b_lti)*(a_lti+b_lti)]) AS ex FROM t)
SELECT a_tv, a_lti, b_tv, b_lti, CASE WHEN min(ex) > 0 THEN sum(pow(abs(ob - ex / n)
  - least(0.5::DOUBLE, abs(ob - ex / n)), 2) / (ex / n)) END AS chi2 FROM u GROUP BY ALL""")
def chi2_2x2(spark, d):
    return st.chi2_2x2(_flagged(spark, d), p_values=False)


@query("grp n:l n_tv:l share_tv:r6", f"""WITH {_FLAG}
SELECT grp, count(*) AS n, count_if(f) AS n_tv, count_if(f) / count(*) AS share_tv
FROM fl GROUP BY grp""")
def tv_proportion(spark, d):
    return st.tv_proportion(_flagged(spark, d))


@query("grp i:i j:i p_value:r6 p_adjusted:r6 reject:b n_reject:l", f"""WITH {o.EDGES}, {o.BINARIZE},
pv AS (SELECT grp, i, j, rank() OVER (PARTITION BY grp ORDER BY w_full DESC)
              / count(*) OVER (PARTITION BY grp) / 4.0 AS p_value FROM binar),
adj AS (SELECT a.grp, a.i, a.j, a.p_value, least(1.0, min(b.p_value * 2016 / b.r)) AS p_adjusted
  FROM pv a JOIN (SELECT grp, p_value, count(*) OVER (PARTITION BY grp ORDER BY p_value) AS r FROM pv) b
    ON b.grp = a.grp AND b.p_value >= a.p_value GROUP BY ALL)
SELECT *, p_adjusted <= 0.25 AS reject, count_if(p_adjusted <= 0.25) OVER (PARTITION BY grp) AS n_reject
FROM adj""")
def fdr_bh(spark, d):
    """Adjusts the empirical tail shares of the consensus edges of each group."""
    w = Window.partitionBy("grp")
    p = _binar(spark, d).withColumn("p_value", F.rank().over(w.orderBy(F.col("w_full").desc()))
                                    / F.count(F.lit(1)).over(w) / 4)
    return st.fdr_bh(p, ["grp"], alpha=0.25)


@query("l_orderkey:l l_linenumber:i p_adjusted:r6 reject:b n_reject:l", """WITH p AS (
  SELECT l_orderkey, l_linenumber, exp(-(l_extendedprice - 901.0) / 9000.0) AS p_value FROM lineitem),
r AS (SELECT *, p_value * count(*) OVER () / row_number() OVER (ORDER BY p_value) AS ratio FROM p),
a AS (SELECT *, least(1.0, min(ratio) OVER (ORDER BY p_value DESC)) AS p_adjusted FROM r)
SELECT *, p_adjusted <= 0.05 AS reject, count_if(p_adjusted <= 0.05) OVER () AS n_reject FROM a""")
def fdr_bh_one_family(spark, d):
    """One family of all order lines: the sort, the ranks and the reverse scan are distributed."""
    p = fx.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.exp(-(F.col("l_extendedprice") - 901.0) / 9000.0).alias("p_value"))
    return st.fdr_bh_large(p)


_CURVES = f"""{_S},
cm AS (SELECT subject_id, grp, mode, avg(g_lti) AS l, avg(tv_mean) AS t FROM surface GROUP BY ALL),
cf AS (SELECT subject_id, grp, omega_idx, any_value(freq_hz) AS freq_hz, avg(g_lti) AS l,
       avg(tv_mean) AS t FROM surface GROUP BY ALL),
bymode AS (SELECT subject_id, grp, mode, 'LTI' AS model_type, l AS value FROM cm
           UNION ALL SELECT subject_id, grp, mode, 'TV', t FROM cm),
byfreq AS (SELECT subject_id, grp, omega_idx, 'LTI' AS model_type, l AS value FROM cf
           UNION ALL SELECT subject_id, grp, omega_idx, 'TV', t FROM cf)"""


@query("model_type mode:i t_stat:r6 df:r4 cohens_d:r6", f"""WITH {_CURVES},
{o.two_groups('bymode', 'model_type, mode')}
SELECT *, {o.WELCH}, (mean_a - mean_b) / (sqrt((std_a*std_a + std_b*std_b) / 2) + 1e-10) AS cohens_d
FROM gm""")
def pointwise_tests(spark, d):
    return st.two_group_test(st.subject_curves(_surface(spark, d), "mode"), ["model_type", "mode"],
                             p_values=False)


@query("model_type mode:i p_value:r6 p_adjusted:r6 reject:b n_reject:l", f"""WITH {_CURVES},
{o.two_groups('bymode', 'model_type, mode')},
wt AS MATERIALIZED (SELECT model_type, mode, {o.WELCH} FROM gm),
pv AS MATERIALIZED (SELECT model_type, mode, {o.t_tail()} AS p_value FROM wt),
rk AS (SELECT model_type, p_value, count(*) OVER (PARTITION BY model_type ORDER BY p_value) AS r,
         count(*) OVER (PARTITION BY model_type) AS n FROM pv),
adj AS (SELECT a.model_type, a.mode, a.p_value, least(1.0, min(b.p_value * b.n / b.r)) AS p_adjusted
        FROM pv a JOIN rk b ON b.model_type = a.model_type AND b.p_value >= a.p_value GROUP BY ALL)
SELECT *, p_adjusted <= 0.05 AS reject, count_if(p_adjusted <= 0.05) OVER (PARTITION BY model_type) AS n_reject
FROM adj""")
def pointwise_stats(spark, d):
    return st.pointwise_stats(st.subject_curves(_surface(spark, d), "mode"))


_BANDS = "(VALUES ('delta', 0.5, 4.0), ('theta', 4.0, 8.0), ('alpha', 8.0, 13.0), ('beta', 13.0, 30.0)," \
         " ('gamma', 30.0, 40.0)) AS b(band, lo, hi)"


@query("band model_type mean_a:r6 std_a:r6 mean_b:r6 std_b:r6 t_stat:r6 cohens_d:r6", f"""WITH {_CURVES},
bv AS (SELECT subject_id, grp, band, avg(l) AS l, avg(t) AS t FROM cf
       JOIN {_BANDS} ON freq_hz >= lo AND freq_hz <= hi GROUP BY ALL),
bl AS (SELECT subject_id, grp, band, 'LTI' AS model_type, l AS value FROM bv
       UNION ALL SELECT subject_id, grp, band, 'TV', t FROM bv),
{o.two_groups('bl', 'band, model_type')}
SELECT *, {o.WELCH}, (mean_a - mean_b) / sqrt((std_a*std_a + std_b*std_b) / 2 + 1e-10) AS cohens_d
FROM gm""")
def band_stats(spark, d):
    return st.band_stats(_surface(spark, d), p_values=False)


@query("subject_id band n:l f_min:r6 f_max:r6", f"""WITH {_CURVES}
SELECT subject_id, band, count(*) AS n, min(freq_hz) AS f_min, max(freq_hz) AS f_max FROM cf
JOIN {_BANDS} ON freq_hz >= lo AND freq_hz <= hi GROUP BY ALL""")
def band_of_freq(spark, d):
    line = _surface(spark, d).select("subject_id", "omega_idx", "freq_hz").distinct()
    return line.withColumn("band", F.explode(fn.bands_of("freq_hz"))).groupBy(
        "subject_id", "band").agg(F.count(F.lit(1)).alias("n"), F.min("freq_hz").alias("f_min"),
                                  F.max("freq_hz").alias("f_max"))


@query("subject_id omega_idx:i omega:r6 freq_hz:r6", f"""WITH {o.LEDGER}
SELECT s.subject_id, range AS omega_idx, range * pi() / 127 AS omega,
       range * pi() / 127 * (n / 10.0) / (2 * pi()) AS freq_hz
FROM (SELECT subject_id, max(t) + 1 AS n FROM led GROUP BY ALL) s CROSS JOIN range(128)""")
def freq_grid(spark, d):
    """One grid per subject, with a sample rate of T / 10."""
    n = prep.recording_lengths(fx.signals_ledger(spark, d))
    return fn.with_freq_grid(n, 128, F.col("n_samples") / 10)


@query("grp model_type omega_idx:i n:l mean:r6 std:r6 sem:r6", f"""WITH {_CURVES}
SELECT grp, model_type, omega_idx, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std,
       stddev_samp(value) / sqrt(count(*)) AS sem FROM byfreq GROUP BY ALL""")
def mode_averaged_response(spark, d):
    return st.mode_averaged_response(_surface(spark, d))


@query("grp model_type mode:i n:l mean:r6 std:r6 sem:r6", f"""WITH {_CURVES}
SELECT grp, model_type, mode, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS std,
       stddev_samp(value) / sqrt(count(*)) AS sem FROM bymode GROUP BY ALL""")
def graph_mode_response(spark, d):
    return st.graph_mode_response(_surface(spark, d))


@query("model_type mode:i cohens_d:r6", f"""WITH {_CURVES}, {o.two_groups('bymode', 'model_type, mode')}
SELECT model_type, mode, (mean_a - mean_b) / (sqrt((sd_a*sd_a + sd_b*sd_b) / 2) + 1e-10) AS cohens_d
FROM gm""")
def mode_effect_sizes(spark, d):
    return st.mode_effect_sizes(_surface(spark, d))


@query("omega_idx:i mode:i lti_a:r6 lti_b:r6 tv_a:r6 tv_b:r6 lti_diff:r6 tv_diff:r6", f"""WITH {_S},
g AS (SELECT omega_idx, mode, avg(g_lti) FILTER (grp = 'A') AS lti_a,
  avg(g_lti) FILTER (grp = 'B') AS lti_b, avg(tv_mean) FILTER (grp = 'A') AS tv_a,
  avg(tv_mean) FILTER (grp = 'B') AS tv_b FROM surface GROUP BY ALL)
SELECT *, lti_a - lti_b AS lti_diff, tv_a - tv_b AS tv_diff FROM g""")
def group_surface_diff(spark, d):
    return st.group_surface_diff(_surface(spark, d))


# -- full analyses on data-driven graphs ---------------------------------------------------------

@query("grp i:i j:i g:r6", f"WITH {_distance_sql(_KSUBJ)} SELECT * FROM dist_graph")
def group_network(spark, d):
    """Recordings to the final group graph in one call."""
    return cohort.group_network(fx.frames_embeddings(spark, d), fx.channel_layout(spark, N1))


def _group_graph_sql() -> str:
    """Node form on each group's own graph: (L x) by a join with the Laplacian cells."""
    return f"""{_GRAPH}, {_ARCS}, {_NORM}, {o.dense('f1', 64)}, {o.ZSCORE},
lxs AS (SELECT z.subject_id, z.t, l.i AS channel, sum(l.v * z.x) AS lx
        FROM zs z JOIN nlap l ON l.grp = z.grp AND l.j = z.channel GROUP BY ALL),
shifted AS (SELECT z.*, lx FROM zs z JOIN lxs USING (subject_id, t, channel)),
feat AS (SELECT subject_id, grp, n_samples, channel, t, x AS y, lag(x, 1) OVER w AS f1,
                lag(lx, 1) OVER w AS f2
         FROM shifted WINDOW w AS (PARTITION BY subject_id, channel ORDER BY t)),
{o.scopes(200, 100, 1)}, {o.gram(2, _KEY)}, {o.solve(2, _KEY)},
scored AS (SELECT *, yy - 2 * (h1 * v1 + h2 * v2)
           + (h1 * h1 * g11 + 2 * h1 * h2 * g12 + h2 * h2 * g22) AS rss FROM sol)
SELECT *, 1 - rss / (yy - s1 * s1 / n_obs + 1e-10) AS r2,
       n_obs * ln(rss / n_obs + 1e-10) + 2 * ln(n_obs) AS bic FROM scored"""


@query("subject_id grp window_idx:l n_obs:l h1:r6 h2:r6 r2:r6 bic:r6", f"WITH {_group_graph_sql()}")
def models_on_group_graphs(spark, d):
    """Embedding channels as signals on each group's own consensus graph."""
    basis = cohort.group_bases(_graph(spark, d))
    m = cohort.fit_cohort(fx.signals_embeddings(spark, d), basis, N1, length=200, step=100,
                          P=1, K=1, by="grp")
    return m.select("*", *[F.col("h")[k].alias(f"h{k + 1}") for k in range(2)])


@query("metric t_stat:r6 p_value:r6 cohens_d:r6")
def qc_cohort(spark, d):
    """Grid, selection, gates and group statistics of the ledger cohort."""
    pre = Preset((1, 2), (0, 1), 0.95, 0.95, 0.95, (1, 1), "fail", OMEGA, 10, -1.0)
    return cohort.qc_cohort(fx.signals_ledger(spark, d), _ring(spark), N, length=LEN, step=STEP,
                            preset=pre)["group_stats"]


_GATED = _GATE + ",\n" + o.surfaces().replace(
    "(scope = 'lti' AND rho < 1.0) OR (scope = 'tv' AND rho < 0.99)",
    "subject_id IN (SELECT subject_id FROM qlog WHERE status = 'SUCCESS')"
    " AND ((scope = 'lti' AND rho < 0.15) OR (scope = 'tv' AND rho < 0.35))") + _CURVES.split(_S, 1)[1]


@query("part k1 k2 k3 v1:r6 v2:r6", f"""WITH {_GATED},
tot AS (SELECT grp, count(*) AS total FROM qlog GROUP BY grp),
md AS ({o.two_groups('bymode', 'model_type, mode').removeprefix('gm AS (').removesuffix(')')}),
mw AS MATERIALIZED (SELECT model_type, mode, {o.WELCH} FROM md),
bv AS (SELECT subject_id, grp, band, avg(l) AS l, avg(t) AS t FROM cf
       JOIN {_BANDS} ON freq_hz >= lo AND freq_hz <= hi GROUP BY ALL),
bl AS (SELECT subject_id, grp, band, 'LTI' AS model_type, l AS value FROM bv
       UNION ALL SELECT subject_id, grp, band, 'TV', t FROM bv),
{o.two_groups('bl', 'band, model_type')}
SELECT 'report' AS part, grp AS k1, status AS k2, reason AS k3, 100.0 * count(*) / any_value(total) AS v1, count(*) AS v2
FROM qlog JOIN tot USING (grp) GROUP BY grp, status, reason
UNION ALL SELECT 'quality', grp, '', '', avg(lti_r2), avg(n_windows) FROM qlog WHERE status = 'SUCCESS' GROUP BY grp
UNION ALL SELECT 'pointwise', model_type, CAST(mode AS VARCHAR), '', t_stat, {o.t_tail()} FROM mw
UNION ALL SELECT 'band', band, model_type, '', t_stat, d FROM (SELECT band, model_type, {o.WELCH},
  (mean_a - mean_b) / sqrt((std_a*std_a + std_b*std_b) / 2 + 1e-10) AS d FROM gm)""")
def qc_cohort_tables(spark, d):
    """Report, quality, pointwise and band tables of one cohort run with every gate on."""
    pre = Preset((P,), (K,), 0.95, _QC.rho_lti, _QC.rho_tv, (P, K), "fail", OMEGA, _QC.min_windows, _QC.r2_min)
    out = cohort.qc_cohort(fx.signals_ledger(spark, d), _ring(spark), N, length=LEN, step=STEP, preset=pre)

    def part(name, keys, values):
        cells = [F.lit(k) if k == "" else F.col(k).cast("string") for k in keys]
        return out[name[0]].select(F.lit(name[1]).alias("part"), *[c.alias(f"k{i + 1}") for i, c in enumerate(cells)],
                                   *[F.col(v).cast("double").alias(f"v{i + 1}") for i, v in enumerate(values)])

    return (part(("report", "report"), ("grp", "status", "reason"), ("share_pct", "n"))
            .unionByName(part(("quality", "quality"), ("grp", "", ""), ("lti_r2_mean", "n_windows_mean")))
            .unionByName(part(("pointwise", "pointwise"), ("model_type", "mode", ""), ("t_stat", "p_value")))
            .unionByName(part(("band_stats", "band"), ("band", "model_type", ""), ("t_stat", "cohens_d"))))
