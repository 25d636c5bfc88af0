"""Cohort statistics over per-subject values.

Two-group tests take long rows (keys, grp, value) and reduce them to moments
per key in one aggregation; the tests are column arithmetic on those rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphdyn.functions.scalars import bands_of
from graphdyn.functions.special import (
    chi2_p_value, mann_whitney_p, norm_ppf, t_critical, t_p_value)
from graphdyn.operators.ranking import global_running_sum, suffix_min
from graphdyn.session import cut_lineage, sized


def unpivot_metrics(df: DataFrame, metrics, ids=("subject_id", "grp")) -> DataFrame:
    """Wide subject rows to (ids, metric, value)."""
    cast = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return cast.unpivot(list(ids), list(metrics), "metric", "value")


def group_moments(df: DataFrame, keys, value: str = "value", a: str = "A",
                  b: str = "B") -> DataFrame:
    """Count, mean, population and sample sd of both groups per key."""
    aggs = []
    for tag, label in (("a", a), ("b", b)):
        v = F.when((F.col("grp") == label) & ~F.isnan(value), F.col(value))
        aggs += [F.count(v).alias(f"n_{tag}"), F.avg(v).alias(f"mean_{tag}"),
                 F.stddev_pop(v).alias(f"std_{tag}"), F.stddev_samp(v).alias(f"sd_{tag}")]
    return df.groupBy(*keys).agg(*aggs)


def welch_columns() -> tuple[Column, Column]:
    va = F.col("sd_a") * F.col("sd_a") / F.greatest("n_a", F.lit(1))
    vb = F.col("sd_b") * F.col("sd_b") / F.greatest("n_b", F.lit(1))
    ok = (F.col("n_a") > 1) & (F.col("n_b") > 1) & (va + vb > 0)
    t = F.when(ok, (F.col("mean_a") - F.col("mean_b")) / F.sqrt(va + vb))
    df = F.when(ok, (va + vb) * (va + vb) / (va * va / (F.col("n_a") - 1)
                                             + vb * vb / (F.col("n_b") - 1)))
    return t, df


def student_columns() -> tuple[Column, Column]:
    dof = F.col("n_a") + F.col("n_b") - 2
    pooled = ((F.col("n_a") - 1) * F.col("sd_a") * F.col("sd_a")
              + (F.col("n_b") - 1) * F.col("sd_b") * F.col("sd_b")) / F.greatest(dof, F.lit(1))
    ok = (F.col("n_a") > 1) & (F.col("n_b") > 1) & (pooled > 0)
    t = (F.col("mean_a") - F.col("mean_b")) / F.sqrt(pooled * (1 / F.col("n_a")
                                                               + 1 / F.col("n_b")))
    return F.when(ok, t), F.when(ok, dof.cast("double"))


def cohens_d(ddof: int = 0, eps: str = "outside") -> Column:
    """Standardised mean difference.

    ``ddof`` 0 uses population sds (tables), 1 sample sds (curves). ``eps``
    places the 1e-10 guard ``outside`` the root, ``inside`` it, or ``none``.
    """
    sa, sb = (F.col("std_a"), F.col("std_b")) if ddof == 0 else (F.col("sd_a"), F.col("sd_b"))
    var = (sa * sa + sb * sb) / 2
    diff = F.col("mean_a") - F.col("mean_b")
    if eps == "outside":
        return diff / (F.sqrt(var) + 1e-10)
    if eps == "inside":
        return diff / F.sqrt(var + 1e-10)
    return F.when(var > 0, diff / F.sqrt(var))


def two_group_test(df: DataFrame, keys, *, value: str = "value", kind: str = "welch",
                   ddof: int = 0, eps: str = "outside", p_values: bool = True,
                   alpha: float = 0.05, a: str = "A", b: str = "B") -> DataFrame:
    """t, df, effect size and (optionally) p per key."""
    t, dof = welch_columns() if kind == "welch" else student_columns()
    out = (group_moments(df, keys, value, a, b).withColumn("t_stat", t).withColumn("df", dof)
           .withColumn("cohens_d", cohens_d(ddof, eps)))
    if p_values:
        out = out.withColumn("p_value", t_p_value("t_stat", "df")).withColumn(
            "significant", F.col("p_value") < alpha)
    return out


def t_confidence_interval(df: DataFrame, keys, value: str = "value",
                          confidence: float = 0.95) -> DataFrame:
    """mean +- t sem across subjects, with the population sd beside it."""
    out = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"))
    crit = t_critical(F.lit((1 + confidence) / 2), (F.col("n") - 1).cast("double"))
    return (out.withColumn("ci_margin", crit * F.col("sem"))
            .withColumn("ci_lower", F.col("mean") - F.col("ci_margin"))
            .withColumn("ci_upper", F.col("mean") + F.col("ci_margin")))


def sem_band(df: DataFrame, keys, value: str = "value") -> DataFrame:
    out = df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"),
        (F.stddev_pop(value) / F.sqrt(F.count(value))).alias("sem"))
    return (out.withColumn("lower", F.col("mean") - F.col("sem"))
            .withColumn("upper", F.col("mean") + F.col("sem")))


def mann_whitney(df: DataFrame, *, key: str = "metric", value: str = "value", a: str = "A",
                 b: str = "B", p_values: bool = True) -> DataFrame:
    """Rank-sum test per key, with average ranks on ties.

    Equal values are first reduced to one row with its counts; one distributed
    sort of the distinct values then ranks all keys at once.
    """
    v = df.select(key, "grp", F.col(value).alias("v")).filter(
        F.col("v").isNotNull() & ~F.isnan("v") & F.col("grp").isin(a, b))
    distinct = v.groupBy(key, "v").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("grp") == a).alias("na"))
    ties = global_running_sum(distinct, key, "v", weight="n", name="hi") \
        .withColumn("lo", F.col("hi") - F.col("n") + 1)
    mid = (F.col("lo") + F.col("hi")) / 2
    n = F.col("n").cast("double")
    out = ties.groupBy(key).agg(
        F.sum(F.col("na") * mid).alias("_ra"), (F.min("lo") - 1).alias("_off"),
        F.sum("na").alias("n_a"), F.sum(F.col("n") - F.col("na")).alias("n_b"),
        F.sum(n * n * n - n).alias("tie_term"),
        F.sum(F.col("v") * F.col("na")).alias("_sa"),
        F.sum(F.col("v") * (F.col("n") - F.col("na"))).alias("_sb"))
    na, nb = F.col("n_a"), F.col("n_b")
    u = F.col("_ra") - na * F.col("_off") - na * (na + 1) / 2
    out = out.filter((na >= 2) & (nb >= 2)).select(
        key, "n_a", "n_b", "tie_term", u.alias("u_stat"), (F.col("_sa") / na).alias("mean_a"),
        (F.col("_sb") / nb).alias("mean_b"))
    if not p_values:
        return out
    out = out.withColumn("p_value", mann_whitney_p("u_stat", "n_a", "n_b", "tie_term"))
    z = norm_ppf(1 - F.col("p_value") / 2) * F.signum(F.col("mean_a") - F.col("mean_b"))
    return out.withColumn("effect_r", z / F.sqrt(na + nb))


def chi2_2x2(df: DataFrame, flag: str = "is_time_varying", a: str = "A", b: str = "B",
             p_values: bool = True) -> DataFrame:
    """Yates-corrected chi-square of a flag against the group, one row."""
    def n(label, want):
        return F.count_if((F.col("grp") == label) & (F.col(flag) == want))

    t = df.agg(n(a, True).alias("a_tv"), n(a, False).alias("a_lti"),
               n(b, True).alias("b_tv"), n(b, False).alias("b_lti"))
    w, x, y, z = (F.col(c).cast("double") for c in ("a_tv", "a_lti", "b_tv", "b_lti"))
    total = w + x + y + z
    prod = (w + x) * (y + z) * (w + y) * (x + z)
    # all four cells differ from expectation by the same amount |wz - xy| / total
    gap = F.abs(w * z - x * y) / total
    cut = F.greatest(gap - F.lit(0.5), F.lit(0.0))
    out = t.withColumn("chi2", F.when(prod > 0, cut * cut * total * total * total / prod))
    return out.withColumn("p_value", chi2_p_value("chi2")) if p_values else out


def fdr_bh(df: DataFrame, family, p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Benjamini-Hochberg adjusted p within a family of tests.

    A family is the set of points of one curve (graph modes or frequencies),
    so its size is fixed by the montage or the grid.
    """
    fam = Window.partitionBy(*family)
    rising = fam.orderBy(F.col(p).asc_nulls_last())
    m = F.count(p).over(fam)
    raw = df.withColumn("_q", F.when(F.col(p).isNotNull(), F.col(p) * m
                                     / F.row_number().over(rising)))
    back = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    q = F.least(F.min("_q").over(back), F.lit(1.0))
    out = raw.withColumn("p_adjusted", F.when(F.col(p).isNotNull(), q)).drop("_q")
    return (out.withColumn("reject", F.col("p_adjusted") <= alpha)
            .withColumn("n_reject", F.count_if(F.col("p_adjusted") <= alpha).over(fam)))


def fdr_bh_large(df: DataFrame, family=(), p: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """The same adjustment for families of any size: no family is one task's work.

    Equal p of a family are one row with a count; a distributed sort ranks them, a
    distributed reverse scan takes the least ratio from each rank on, and the result
    goes back by (family, p).
    """
    family = list(family)
    own = family or ["_all"]
    rows = df if family else df.withColumn("_all", F.lit(0))
    distinct = rows.groupBy(*own, F.col(p).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    known = distinct.filter(F.col("_p").isNotNull())
    ranked = global_running_sum(known, *own, "_p", weight="_n", name="_hi")
    size = ranked.groupBy(*own).agg(F.sum("_n").alias("_m"), F.min(F.col("_hi") - F.col("_n")).alias("_off"))
    ratio = F.col("_p") * F.col("_m") / (F.col("_hi") - F.col("_off"))
    ratios = _null_safe(ranked, sized(size), own).select(*own, "_p", "_n", ratio.alias("_q"))
    least = cut_lineage(suffix_min(ratios, own, ["_p"], "_q", "_adj").withColumn("_adj", F.least("_adj", F.lit(1.0))))
    count = least.groupBy(*own).agg(F.sum(F.when(F.col("_adj") <= alpha, F.col("_n")).otherwise(0)).alias("n_reject"))
    adjusted = least.select(*own, "_p", F.col("_adj").alias("p_adjusted"))
    out = _null_safe(rows.withColumn("_p", F.col(p)), adjusted, [*own, "_p"], "left")
    out = out.withColumn("reject", F.col("p_adjusted") <= alpha)
    out = _null_safe(out, sized(count), own, "left").withColumn("n_reject", F.coalesce("n_reject", F.lit(0)))
    return out.select(*df.columns, "p_adjusted", "reject", "n_reject")


def _null_safe(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """Join in which null keys of both sides meet."""
    renamed = right.select(*[F.col(k).alias(f"_r{i}") for i, k in enumerate(keys)],
                           *[c for c in right.columns if c not in keys])
    on = [left[k].eqNullSafe(renamed[f"_r{i}"]) for i, k in enumerate(keys)]
    return left.join(renamed, on, how).drop(*[f"_r{i}" for i in range(len(keys))])


def pointwise_stats(points: DataFrame, *, family=("model_type",), point: str = "mode",
                    alpha: float = 0.05, a: str = "A", b: str = "B") -> DataFrame:
    """Welch test, effect size and adjusted p at every point of each curve."""
    tests = two_group_test(points, [*family, point], alpha=alpha, a=a, b=b)
    return fdr_bh(tests, family, alpha=alpha)


# -- curves and bands ---------------------------------------------------------

def subject_curves(surface: DataFrame, axis: str) -> DataFrame:
    """Per subject: the surface averaged onto one axis, LTI and TV as rows.

    ``axis`` is omega_idx (mean over modes) or mode (mean over frequencies).
    """
    line = surface.groupBy("subject_id", "grp", axis).agg(
        F.avg("g_lti").alias("LTI"), F.avg("tv_mean").alias("TV"))
    return line.unpivot(["subject_id", "grp", axis], ["LTI", "TV"], "model_type", "value")


def mode_averaged_response(surface: DataFrame) -> DataFrame:
    return t_confidence_interval(subject_curves(surface, "omega_idx"),
                                 ["grp", "model_type", "omega_idx"])


def graph_mode_response(surface: DataFrame) -> DataFrame:
    return t_confidence_interval(subject_curves(surface, "mode"),
                                 ["grp", "model_type", "mode"])


def mode_effect_sizes(surface: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    return (group_moments(subject_curves(surface, "mode"), ["model_type", "mode"], a=a, b=b)
            .select("model_type", "mode", cohens_d(1).alias("cohens_d")))


def band_values(surface: DataFrame) -> DataFrame:
    """Mean gain per band and subject. A bin on a shared edge counts in both bands.

    Subjects are first reduced to one row per frequency; every frequency has
    the same number of modes, so the mean of means is the mean.
    """
    line = surface.groupBy("subject_id", "grp", "omega_idx").agg(
        F.first("freq_hz").alias("freq_hz"), F.avg("g_lti").alias("LTI"),
        F.avg("tv_mean").alias("TV"))
    hit = line.withColumn("band", F.explode(bands_of("freq_hz")))
    per = hit.groupBy("subject_id", "grp", "band").agg(
        F.avg("LTI").alias("LTI"), F.avg("TV").alias("TV"))
    return per.unpivot(["subject_id", "grp", "band"], ["LTI", "TV"], "model_type", "value")


def band_stats(surface: DataFrame, p_values: bool = True, a: str = "A",
               b: str = "B") -> DataFrame:
    return two_group_test(band_values(surface), ["band", "model_type"], eps="inside",
                          p_values=p_values, a=a, b=b)


def group_surface_diff(surface: DataFrame, a: str = "A", b: str = "B") -> DataFrame:
    """Mean surfaces of both groups and their difference per (omega, mode)."""
    def mean(col, label):
        return F.avg(F.when(F.col("grp") == label, F.col(col)))

    out = surface.filter(F.col("grp").isin(a, b)).groupBy("omega_idx", "mode").agg(
        F.first("freq_hz").alias("freq_hz"), F.first("lambda").alias("lambda"),
        mean("g_lti", a).alias("lti_a"), mean("g_lti", b).alias("lti_b"),
        mean("tv_mean", a).alias("tv_a"), mean("tv_mean", b).alias("tv_b"))
    return (out.withColumn("lti_diff", F.col("lti_a") - F.col("lti_b"))
            .withColumn("tv_diff", F.col("tv_a") - F.col("tv_b")))


# -- orders and classification --------------------------------------------------

def model_order_summary(selected: DataFrame, by: str = "grp", ddof: int = 1) -> DataFrame:
    """Mean, sd, range and smallest most frequent value of P and K per group."""
    long = selected.select(by, F.explode(F.array(
        F.struct(F.lit("P").alias("name"), F.col("P").alias("v")),
        F.struct(F.lit("K").alias("name"), F.col("K").alias("v")))).alias("s")) \
        .select(by, "s.name", "s.v")
    counts = long.groupBy(by, "name", "v").agg(F.count(F.lit(1)).alias("c"))
    top = Window.partitionBy(by, "name").orderBy(F.col("c").desc(), "v")
    mode = counts.withColumn("_r", F.row_number().over(top)).filter("_r = 1").select(
        by, "name", F.col("v").alias("most_frequent"))
    sd = F.stddev_samp("v") if ddof else F.stddev_pop("v")
    out = long.groupBy(by, "name").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), sd.alias("std"),
        F.min("v").alias("lo"), F.max("v").alias("hi"))
    return out.join(mode, [by, "name"])


def model_order_histogram(selected: DataFrame, by: str = "grp") -> DataFrame:
    return selected.groupBy(by, "P", "K").agg(F.count(F.lit(1)).alias("n"))


def model_order_test(selected: DataFrame, a: str = "A", b: str = "B",
                     p_values: bool = True) -> DataFrame:
    """Pooled t test on the selected P and K."""
    return two_group_test(unpivot_metrics(selected, ["P", "K"]), ["metric"], kind="student",
                          p_values=p_values, a=a, b=b)


def tv_proportion(df: DataFrame, flag: str = "is_time_varying", by: str = "grp") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"),
                              F.count_if(flag).alias("n_tv"),
                              F.avg(F.col(flag).cast("double")).alias("share_tv"))
