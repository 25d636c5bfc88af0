"""Reusable fragments of the DuckDB check queries."""

from __future__ import annotations

import math

# -- fixtures -----------------------------------------------------------------

F1 = """f1 AS (
  SELECT CAST(label AS VARCHAR) AS subject_id,
         CASE WHEN label % 2 = 0 THEN 'A' ELSE 'B' END AS grp, vec_id AS t,
         unnest(range(64)) AS channel, CAST(unnest(embedding) AS DOUBLE) AS value
  FROM embeddings)"""

SIGNED = """signed AS (
  SELECT a.subject_id, a.grp, a.channel AS i, b.channel AS j,
         CASE WHEN isnan(corr(a.value, b.value)) THEN 0.0
              ELSE coalesce(corr(a.value, b.value), 0.0) END AS r
  FROM f1 a JOIN f1 b ON a.subject_id = b.subject_id AND a.t = b.t AND a.channel < b.channel
  GROUP BY ALL)"""

EDGES = f"{F1}, {SIGNED}, edges AS (SELECT subject_id, grp, i, j, abs(r) AS w FROM signed)"


def fisher(x: str) -> str:
    return f"atanh(greatest(-0.999999, least(0.999999, {x})))"


BINARIZE = f"""kept AS (
  SELECT *, {fisher('w')} AS z,
         row_number() OVER (PARTITION BY subject_id ORDER BY w DESC) AS pos,
         count(*) OVER (PARTITION BY subject_id) AS e FROM edges),
cut AS (SELECT subject_id, min(w) AS limit_w FROM kept
        WHERE pos <= greatest(1, floor(0.15 * e)) + 1 GROUP BY ALL),
flags AS (SELECT k.*, k.w > c.limit_w AS keep FROM kept k JOIN cut c USING (subject_id)),
binar AS (
  SELECT grp, i, j, avg(CAST(keep AS DOUBLE)) AS c,
         coalesce(abs(tanh(avg(CASE WHEN keep THEN z END))), 0.0) AS w,
         abs(tanh(avg(z))) AS w_full
  FROM flags GROUP BY ALL),
share AS (SELECT grp, avg(c) AS mean_sparsity FROM binar GROUP BY ALL)"""

DIRECT = f"""dense AS (
  SELECT grp, i, j, abs(tanh(avg({fisher('w')}))) AS w_full FROM edges GROUP BY ALL),
lim AS (
  SELECT grp, list_reverse_sort(list(w_full)) AS s FROM dense GROUP BY ALL),
direct AS (
  SELECT d.grp, i, j, w_full,
         CASE WHEN w_full > s[CAST(floor(0.15 * len(s)) AS BIGINT) + 1] THEN 1.0 ELSE 0.0 END AS c,
         CASE WHEN w_full > s[CAST(floor(0.15 * len(s)) AS BIGINT) + 1] THEN w_full ELSE 0.0 END AS w
  FROM dense d JOIN lim USING (grp))"""

MEAN = "cmean AS (SELECT grp, i, j, avg(w) AS w FROM edges GROUP BY ALL)"


def layout(n: int) -> str:
    return f"""place AS (
  SELECT range AS channel, round(cos(2 * pi() * range / {n}), 6) AS x,
         round(sin(2 * pi() * range / {n}), 6) AS y,
         round(0.5 + 0.2 * sin(2 * (2 * pi() * range / {n})), 6) AS z FROM range({n})),
dists AS (
  SELECT a.channel AS i, b.channel AS j,
         sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS dist
  FROM place a JOIN place b ON a.channel < b.channel),
sorted AS (SELECT list_sort(list(dist)) AS s FROM dists),
cuts AS (
  SELECT b, s[lo + 1] + (s[least(lo + 1, len(s) - 1) + 1] - s[lo + 1]) * (pos - lo)
            + CASE WHEN b = 10 THEN 1e-10 ELSE 0 END AS edge
  FROM (SELECT s, b, pos, CAST(floor(pos) AS BIGINT) AS lo
        FROM (SELECT s, range AS b, (range / 10.0::DOUBLE) * (len(s) - 1) AS pos
              FROM sorted, range(11)))),
binned AS (
  SELECT d.*, CAST(lo.b AS INTEGER) AS bin FROM dists d
  JOIN cuts lo ON d.dist >= lo.edge JOIN cuts hi ON hi.b = lo.b + 1 AND d.dist < hi.edge)"""


EVENTS = """ev AS (
  SELECT CAST(user_id % 10 AS VARCHAR) AS subject_id,
         CASE WHEN user_id % 10 < 5 THEN 'A' ELSE 'B' END AS grp,
         CAST(list_position((SELECT list_sort(list(DISTINCT event_type)) FROM events), event_type)
              - 1 AS INTEGER) AS channel,
         CAST(floor(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', ts))
              / 21600) AS BIGINT) AS t,
         sum(value) AS value
  FROM events GROUP BY ALL)"""

SHIP = """ship AS (
  SELECT l_returnflag || l_linestatus AS subject_id, l_linestatus AS grp,
         s_nationkey AS channel,
         CAST(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) AS BIGINT) AS t,
         sum(l_extendedprice * (1 - l_discount)) AS value
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""

LEDGER = """led AS (
  SELECT CAST(l_orderkey % 16 AS VARCHAR) AS subject_id,
         CASE WHEN l_orderkey % 16 < 8 THEN 'A' ELSE 'B' END AS grp,
         l_linenumber - 1 AS channel, l_orderkey // 16 AS t,
         sum(l_extendedprice * (1 - l_discount)) AS value
  FROM lineitem GROUP BY ALL)"""


def dense(source: str, n: int) -> str:
    return f"""span AS (SELECT subject_id, grp, max(t) + 1 AS n_samples FROM {source} GROUP BY ALL),
ticks AS (SELECT subject_id, grp, n_samples, unnest(range(n_samples)) AS t FROM span),
grid AS (
  SELECT k.subject_id, k.grp, k.n_samples, k.t, c.range AS channel,
         coalesce(v.value, 0.0) AS value
  FROM ticks k CROSS JOIN range({n}) c
  LEFT JOIN {source} v ON v.subject_id = k.subject_id AND v.t = k.t AND v.channel = c.range)"""


ZSCORE = """moments AS (
  SELECT subject_id, channel, avg(value) AS mu, stddev_pop(value) AS sd FROM grid GROUP BY ALL),
zs AS (
  SELECT subject_id, grp, n_samples, channel, t,
         greatest(-10.0, least(10.0, (value - mu) / greatest(sd, 1e-8))) AS x
  FROM grid JOIN moments USING (subject_id, channel))"""

LEDGER_DENSE = f"{LEDGER}, {dense('led', 7)}"
LEDGER_Z = f"{LEDGER_DENSE}, {ZSCORE}"


# -- models in SQL --------------------------------------------------------------

def lap(source: str, n: int = 7) -> str:
    """Adds lx = (L x) of the normalised ring Laplacian."""
    return f"""shifted AS (
  SELECT a.subject_id, a.grp, a.n_samples, a.channel, a.t, a.x, a.x - 0.5 * (b.x + c.x) AS lx
  FROM {source} a
  JOIN {source} b ON b.subject_id = a.subject_id AND b.t = a.t
                 AND b.channel = (a.channel + 1) % {n}
  JOIN {source} c ON c.subject_id = a.subject_id AND c.t = a.t
                 AND c.channel = (a.channel + {n - 1}) % {n})"""


FEATURES = """feat AS (
  SELECT subject_id, grp, n_samples, channel, t, x AS y,
         lag(x, 1) OVER w AS f1, lag(lx, 1) OVER w AS f2,
         lag(x, 2) OVER w AS f3, lag(lx, 2) OVER w AS f4
  FROM shifted WINDOW w AS (PARTITION BY subject_id, channel ORDER BY t))"""


def scopes(length: int, step: int, first: int = 2) -> str:
    """Rows of the whole recording (-1) and of every full window."""
    return f"""wins AS (
  SELECT subject_id, unnest(range((n_samples - {length}) // {step} + 1)) AS window_idx
  FROM span WHERE n_samples >= {length}),
scoped AS (
  SELECT CAST(-1 AS BIGINT) AS window_idx, * FROM feat WHERE t >= {first}
  UNION ALL
  SELECT w.window_idx, f.* FROM wins w JOIN feat f ON f.subject_id = w.subject_id
    AND f.t >= w.window_idx * {step} + {first} AND f.t < w.window_idx * {step} + {length})"""


def gram(n: int, key: str, source: str = "scoped") -> str:
    cells = [f"sum(f{a} * f{b}) AS g{a}{b}" for a in range(1, n + 1) for b in range(a, n + 1)]
    rhs = [f"sum(f{a} * y) AS v{a}" for a in range(1, n + 1)]
    return (f"gram AS (SELECT {key}, count(*) AS n_obs, sum(y) AS s1, sum(y * y) AS yy,"
            f" {', '.join(cells + rhs)} FROM {source} GROUP BY {key})")


def solve(n: int, key: str, ridge: str = "5e-3") -> str:
    """Gaussian elimination of the ridge system as a chain of CTEs; adds h1..hn."""
    def sym(a, b):
        return f"g{min(a, b)}{max(a, b)}"

    start = [f"{sym(a, b)} + {ridge if a == b else '0'} AS a{a}{b}"
             for a in range(1, n + 1) for b in range(1, n + 1)]
    ctes = [f"e0 AS (SELECT {key}, {', '.join(start)}, "
            f"{', '.join(f'v{a} AS b{a}' for a in range(1, n + 1))} FROM gram)"]
    for k in range(1, n):
        cols = [f"b{a}" if a <= k else f"b{a} - a{a}{k} / a{k}{k} * b{k} AS b{a}"
                for a in range(1, n + 1)]
        cols += [f"a{a}{b}" if a <= k else f"a{a}{b} - a{a}{k} / a{k}{k} * a{k}{b} AS a{a}{b}"
                 for a in range(1, n + 1) for b in range(1, n + 1)]
        ctes.append(f"e{k} AS (SELECT {key}, {', '.join(cols)} FROM e{k - 1})")
    prev = f"e{n - 1}"
    for a in range(n, 0, -1):
        rest = "".join(f" - a{a}{b} * h{b}" for b in range(a + 1, n + 1))
        ctes.append(f"s{a} AS (SELECT *, (b{a}{rest}) / a{a}{a} AS h{a} FROM {prev})")
        prev = f"s{a}"
    hs = ", ".join(f"h{a}" for a in range(1, n + 1))
    ctes.append(f"sol AS (SELECT gram.*, {hs} FROM gram JOIN s1 USING ({key}))")
    return ",\n".join(ctes)


def scores(n: int, order: int = 2, lam_n: int = 7) -> str:
    """RSS, R2, MSE, BIC and spectral radius of the solved rows (P = order, K = 1)."""
    hr = " + ".join(f"h{a} * v{a}" for a in range(1, n + 1))
    hgh = " + ".join(f"h{a} * h{b} * g{min(a, b)}{max(a, b)}"
                     for a in range(1, n + 1) for b in range(1, n + 1))
    return f"""scored AS (
  SELECT *, yy - 2 * ({hr}) + ({hgh}) AS rss FROM sol),
lams AS (SELECT range AS mode, 1 - cos(2 * pi() * ((range + 1) // 2) / {lam_n}) AS lam
         FROM range({lam_n})),
roots AS (
  SELECT subject_id, window_idx, max(CASE
    WHEN p1 * p1 + 4 * p2 >= 0 THEN greatest(abs(p1 + sqrt(p1 * p1 + 4 * p2)),
                                             abs(p1 - sqrt(p1 * p1 + 4 * p2))) / 2
    ELSE sqrt(-p2) END) AS rho
  FROM (SELECT subject_id, window_idx, h1 + h2 * lam AS p1, h3 + h4 * lam AS p2
        FROM sol CROSS JOIN lams) GROUP BY ALL),
models AS (
  SELECT s.*, rho, CASE WHEN window_idx < 0 THEN 'lti' ELSE 'tv' END AS scope,
         rss / n_obs AS mse, 1 - rss / (yy - s1 * s1 / n_obs + 1e-10) AS r2,
         n_obs * ln(rss / n_obs + 1e-10) + {n} * ln(n_obs) AS bic
  FROM scored s JOIN roots USING (subject_id, window_idx))"""


def ledger_models(length: int = 100, step: int = 50) -> str:
    key = "subject_id, grp, window_idx"
    return ",\n".join([LEDGER_Z, lap("zs"), FEATURES, scopes(length, step), gram(4, key),
                       solve(4, key), scores(4)])


def surfaces(n_omega: int = 32, fs: float = 100.0) -> str:
    """Gain of every stable model per (omega, mode), and the TV/LTI pairing."""
    return f"""omegas AS (
  SELECT range AS omega_idx, range * {math.pi / (n_omega - 1)!r} AS omega FROM range({n_omega})),
tf AS (
  SELECT subject_id, grp, scope, window_idx, omega_idx, omega,
         omega * {fs / (2 * math.pi)!r} AS freq_hz, mode, lam,
         1 - (h1 + h2 * lam) * cos(omega) - (h3 + h4 * lam) * cos(2 * omega) AS dre,
         (h1 + h2 * lam) * sin(omega) + (h3 + h4 * lam) * sin(2 * omega) AS dim
  FROM models CROSS JOIN lams CROSS JOIN omegas
  WHERE (scope = 'lti' AND rho < 1.0) OR (scope = 'tv' AND rho < 0.99)),
paired AS (
  SELECT v.subject_id, v.grp, v.window_idx, v.omega_idx, v.freq_hz, v.mode, v.lam,
         1 / sqrt(v.dre * v.dre + v.dim * v.dim) AS g_tv,
         1 / sqrt(l.dre * l.dre + l.dim * l.dim) AS g_lti
  FROM tf v JOIN tf l ON l.scope = 'lti' AND v.scope = 'tv' AND l.subject_id = v.subject_id
    AND l.omega_idx = v.omega_idx AND l.mode = v.mode),
surface AS (
  SELECT subject_id, grp, omega_idx, mode, any_value(freq_hz) AS freq_hz, any_value(lam) AS lam,
         any_value(g_lti) AS g_lti, avg(g_tv) AS tv_mean, stddev_pop(g_tv) AS tv_std,
         var_pop(g_tv) AS tv_var, count(*) AS n_windows
  FROM paired GROUP BY subject_id, grp, omega_idx, mode),
msd AS (SELECT subject_id, grp, window_idx, avg((g_tv - g_lti) * (g_tv - g_lti)) AS msd
        FROM paired GROUP BY ALL),
gmsd AS (SELECT subject_id, grp, avg(msd) AS global_msd, count(*) AS n_windows
         FROM msd GROUP BY ALL),
band AS (
  SELECT *, tv_mean - 1.96 * tv_std / sqrt(n_windows) AS ci_lower,
         tv_mean + 1.96 * tv_std / sqrt(n_windows) AS ci_upper FROM surface),
extent AS (
  SELECT subject_id, grp, avg(tv_var) AS global_variance,
         avg(CAST(g_lti < ci_lower OR g_lti > ci_upper AS DOUBLE)) AS outside_ci_fraction
  FROM band GROUP BY ALL)"""


def ledger_surfaces() -> str:
    return f"{ledger_models()},\n{surfaces()}"


def surrogate_null(n_surrogates: int, shift: str, length: int = 100, step: int = 50) -> str:
    """A sub-query (subject_id, grp, surrogate, global_msd, n_windows) over ``zs``; ``shift`` in terms of s and channel."""
    key = "subject_id, grp, window_idx"
    rolled = f"""rolled AS MATERIALIZED (
  SELECT subject_id || '|' || s.range AS subject_id, grp, n_samples, channel, (t + {shift}) % n_samples AS t, x
  FROM zs CROSS JOIN (SELECT range FROM range(1, {n_surrogates + 1})) s),
rspan AS (SELECT DISTINCT subject_id, n_samples FROM rolled)"""
    parts = [rolled, lap("rolled"), FEATURES, scopes(length, step).replace("FROM span", "FROM rspan"), gram(4, key),
             solve(4, key), scores(4).replace("models AS (", "models AS MATERIALIZED ("),
             surfaces().replace("tf AS (", "tf AS MATERIALIZED (")]
    return f"""(WITH {", ".join(parts)}
SELECT split_part(subject_id, '|', 1) AS subject_id, grp, CAST(split_part(subject_id, '|', 2) AS INTEGER) AS surrogate,
       global_msd, n_windows FROM gmsd WHERE n_windows >= 5)"""


def two_groups(source: str, keys: str, value: str = "value") -> str:
    """Moments of both groups per key."""
    def part(tag, label):
        v = f"CASE WHEN grp = '{label}' THEN {value} END"
        return (f"count({v}) AS n_{tag}, avg({v}) AS mean_{tag}, stddev_pop({v}) AS std_{tag},"
                f" stddev_samp({v}) AS sd_{tag}")
    return (f"gm AS (SELECT {keys}, {part('a', 'A')}, {part('b', 'B')} FROM {source}"
            f" GROUP BY {keys})")


WELCH = """CASE WHEN sd_a*sd_a/n_a + sd_b*sd_b/n_b > 0
  THEN (mean_a - mean_b) / sqrt(sd_a*sd_a/n_a + sd_b*sd_b/n_b) END AS t_stat,
CASE WHEN sd_a*sd_a/n_a + sd_b*sd_b/n_b > 0
  THEN pow(sd_a*sd_a/n_a + sd_b*sd_b/n_b, 2)
    / (pow(sd_a*sd_a/n_a, 2)/(n_a-1) + pow(sd_b*sd_b/n_b, 2)/(n_b-1)) END AS df"""

STUDENT = """CASE WHEN sd_a + sd_b > 0 THEN (mean_a - mean_b) / sqrt(
  ((n_a-1)*sd_a*sd_a + (n_b-1)*sd_b*sd_b) / (n_a+n_b-2) * (1.0/n_a + 1.0/n_b)) END AS t_stat,
CASE WHEN sd_a + sd_b > 0 THEN CAST(n_a + n_b - 2 AS DOUBLE) END AS df"""


def t_tail(t: str = "t_stat", df: str = "df", steps: int = 3000) -> str:
    """Two-sided tail of Student's t by a Simpson sum over the density (0 beyond 60)."""
    x = f"least(abs({t}), 60.0)"
    return (f"CASE WHEN {t} IS NOT NULL THEN greatest(0.0, 1 - 2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0))"
            f" / sqrt(pi() * {df}) * {x} / {3 * steps}.0 * (SELECT sum((CASE WHEN k IN (0, {steps}) THEN 1"
            f" WHEN k % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + pow({x} * k / {steps}.0, 2) / {df}, -({df} + 1) / 2.0))"
            f" FROM range({steps + 1}) steps(k))) END")


def normal_rank_tail(u_max: str, n_a: str, n_b: str, ties: str, steps: int = 2000) -> str:
    """Two-sided normal tail of the rank-sum statistic, corrected for ties, by a Simpson sum over the density."""
    n = f"({n_a} + {n_b})"
    z = (f"(({u_max} - {n_a} * {n_b} / 2.0 - 0.5) / sqrt({n_a} * {n_b} / 12.0 * ({n} + 1 - {ties} / ({n} * ({n} - 1.0)))))")
    return (f"least(1.0, 1 - 2 / sqrt(2 * pi()) * {z} / {3 * steps}.0 * (SELECT sum((CASE WHEN k IN (0, {steps}) THEN 1"
            f" WHEN k % 2 = 1 THEN 4 ELSE 2 END) * exp(-pow({z} * k / {steps}.0, 2) / 2)) FROM range({steps + 1}) steps(k)))")


def rank_tail(u_max: str, n_a: str, n_b: str) -> str:
    """Exact two-sided tail of the rank-sum statistic: all ways to place sample A, one bit per rank."""
    return (f"(SELECT least(1.0, 2.0 * count_if(u >= ceil({u_max})) / count(*)) FROM ("
            f"SELECT m, sum(CASE WHEN (m >> i) & 1 = 1 THEN i + 1 ELSE 0 END) - {n_a} * ({n_a} + 1) / 2 AS u"
            f" FROM range(65536) masks(m), range(16) bits(i) WHERE m < (1 << ({n_a} + {n_b}))"
            f" GROUP BY m HAVING sum((m >> i) & 1) = {n_a}))")
