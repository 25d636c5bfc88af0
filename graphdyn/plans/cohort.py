"""End-to-end analyses: consensus, subject test, quality-controlled cohort."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphdyn.operators import compare, consensus, graphs, moments, stats, surrogate, transfer
from graphdyn.operators.connectivity import pearson_edges
from graphdyn.operators.graph_var import (
    fit_models, global_coefficient_cv, lti_models, model_grid, select_model, tv_models,
    window_summary)
from graphdyn.operators.moments import KEY
from graphdyn.schema import PRESETS, QC_LOG, Preset
from graphdyn.session import cut_lineage, sized


def channel_compatibility(signals: DataFrame, n_channels: int) -> tuple[DataFrame, DataFrame]:
    """(kept signals, rejects): subjects whose channels are not exactly the graph's 0..n-1."""
    counts = signals.groupBy(*KEY).agg(F.count_distinct("channel").alias("n"),
                                       F.min("channel").alias("lo"), F.max("channel").alias("hi"))
    bad = sized(counts.filter((F.col("n") != n_channels) | (F.col("lo") < 0)
                              | (F.col("hi") >= n_channels)))
    kept = signals.join(bad.select("subject_id"), "subject_id", "left_anti")
    log = bad.select(*KEY, F.lit("REJECT").alias("status"),
                     F.lit("Channel_mismatch").alias("reason"),
                     F.concat(F.lit(f"L={n_channels}")).alias("detail_1"),
                     F.concat(F.lit("EEG="), F.col("n")).alias("detail_2"),
                     F.lit("").alias("detail_3"))
    return kept, log


def group_network(frames: DataFrame, channels: DataFrame, *, method: str = "binarize",
                       sparsity: float = 0.15, target="match_subject",
                       distance: bool = True) -> DataFrame:
    """Recordings to the final group graph: c, w, w_full and g per pair."""
    cons = cut_lineage(consensus.consensus(pearson_edges(frames), method, sparsity))
    if method == "direct" and isinstance(target, str):
        kept = cons.groupBy("grp").agg(F.avg((F.col("w") > 0).cast("double"))
                                       .alias("mean_sparsity"))
        cons = cons.join(kept, "grp")
    if distance:
        final = consensus.distance_consensus(cons, channels, target)
    else:
        final = consensus.uniform_consensus(cons, target)
    return cons.select("grp", "i", "j", "c", "w", "w_full").join(
        final.select("grp", "i", "j", "g"), ["grp", "i", "j"])


def fit_cohort(signals: DataFrame, basis: DataFrame, n_channels: int, *, length: int, step: int,
               P: int | None = None, K: int | None = None, orders: DataFrame | None = None,
               p_max: int | None = None, k_max: int | None = None,
               by: str | None = None) -> DataFrame:
    """Whole-recording and window models of every subject, in one pass.

    Orders are fixed (P, K) or come per subject from a selection table.
    """
    if orders is None:
        found = moments.graph_var_moments(signals, basis, n_channels, orders=F.array(F.lit(P)),
                                      k_max=K, p_max=P, length=length, step=step, by=by)
        return fit_models(found.withColumn("K", F.lit(K)), basis, by=by)
    lists = orders.select("subject_id", F.array("P").alias("orders"))
    found = moments.graph_var_moments(signals, basis, n_channels, orders=lists, k_max=k_max,
                                  p_max=p_max, length=length, step=step, by=by)
    return fit_models(found.join(orders.select("subject_id", "K"), "subject_id"), basis, by=by)


def subject_test(signals: DataFrame, basis: DataFrame, n_channels: int, *, length: int,
                          step: int, preset: Preset = PRESETS["subject"], fs: float = 100.0,
                          P: int | None = None, K: int | None = None, n_surrogates: int = 0,
                          seed: int = 0, n_omega: int | None = None, shift=None) -> DataFrame:
    """The 15-column summary: selection, models, comparison and test per subject.

    With ``n_surrogates`` the surrogate null uses the same orders as the models:
    P and K, or those selected per subject. ``shift`` replaces the hashed offsets.
    """
    n_omega = n_omega or preset.n_omega
    orders, k_max = None, K
    if P is None:
        grid = model_grid(signals, basis, n_channels, preset.p_grid, preset.k_grid,
                          rho_limit=preset.rho_select)
        orders = cut_lineage(select_model(grid, preset.fallback))
        p_max, k_max = max(*preset.p_grid, preset.fallback[0]), max(*preset.k_grid, preset.fallback[1])
        models = fit_cohort(signals, basis, n_channels, length=length, step=step, orders=orders,
                            p_max=p_max, k_max=k_max)
    else:
        p_max = P
        models = fit_cohort(signals, basis, n_channels, length=length, step=step, P=P, K=K)
    models = cut_lineage(models)
    lti = lti_models(models, preset.rho_lti)
    tv = tv_models(models, length, step, preset.rho_tv)
    parts = cut_lineage(transfer.surface_pass(transfer.paired_models(tv, lti, basis), n_omega=n_omega,
                                              guard=preset.guard))
    surface = cut_lineage(transfer.pass_stats(parts, n_omega, fs))
    msd = cut_lineage(transfer.mean_msd(transfer.pass_msd(parts))).filter(
        F.col("n_windows") >= preset.min_windows)
    extent = transfer.surface_summary(surface)
    if n_surrogates:
        null = surrogate.surrogate_null(
            signals, basis, n_channels, P=P, K=K, orders=orders, p_max=p_max, k_max=k_max,
            length=length, step=step, n_surrogates=n_surrogates, seed=seed, min_windows=preset.min_windows,
            rho_lti=preset.rho_lti, rho_tv=preset.rho_tv, n_omega=n_omega, guard=preset.guard,
            shift=shift)
    else:
        null = msd.limit(0).select("subject_id", "global_msd")
    tests = surrogate.tv_test(null, msd, extent)
    return subject_summary(signals, lti, tv, msd, extent, tests, fs)


def group_comparison(tests: DataFrame, a: str = "A", b: str = "B") -> dict[str, DataFrame]:
    """Groups compared on the subject table: rank tests, time-varying shares and their chi-square."""
    return {"metrics": stats.mann_whitney(stats.unpivot_metrics(tests, SUBJECT_METRICS), a=a, b=b),
            "shares": stats.tv_proportion(tests), "chi2": stats.chi2_2x2(tests)}


def subject_summary(signals, lti, tv, msd, extent, tests, fs: float = 100.0) -> DataFrame:
    """One row per analysed subject (15 columns)."""
    length = signals.groupBy("subject_id").agg(((F.max("t") + 1) / fs).alias("duration"))
    return (
        lti.select(*KEY, "P", "K", F.col("r2").alias("lti_r2"), F.col("bic").alias("lti_bic"),
                   F.col("rho").alias("lti_rho"))
        .join(length, "subject_id")
        .join(msd.select("subject_id", "n_windows", "global_msd"), "subject_id")
        .join(extent.select("subject_id", "global_variance", "outside_ci_fraction"), "subject_id")
        .join(global_coefficient_cv(tv).select("subject_id", "global_coeff_cv"), "subject_id")
        .join(tests.select("subject_id", "p_value_msd", "is_time_varying"), "subject_id")
        .select(*KEY, "P", "K", "duration", "lti_r2", "lti_bic", "lti_rho", "n_windows",
                "global_msd", "global_variance", "global_coeff_cv", "outside_ci_fraction",
                "p_value_msd", "is_time_varying"))


def group_summary_rows(signals, lti, tv, windows, surface, selected, fs: float = 100.0):
    """One row per subject of the group comparison (17 columns)."""
    shape = signals.groupBy("subject_id").agg(
        F.count_distinct("channel").alias("n_channels"),
        ((F.max("t") + 1) / fs).alias("duration"))
    msd = transfer.mean_msd(windows).select("subject_id", F.col("global_msd").alias("mean_msd"))
    cv = transfer.tf_cv(surface).select("subject_id", "mean_cv")
    return (
        lti.select(*KEY, F.col("P").alias("best_P"), F.col("K").alias("best_K"),
                   F.col("r2").alias("lti_r2"), F.col("rho").alias("lti_rho"),
                   F.col("bic").alias("lti_bic"))
        .join(shape, "subject_id")
        .join(selected.select("subject_id", "best_bic"), "subject_id")
        .join(window_summary(tv).drop("grp"), "subject_id")
        .join(msd, "subject_id").join(cv, "subject_id")
        .select(*KEY, "n_channels", "duration", "best_P", "best_K", "best_bic", "lti_r2",
                "lti_rho", "lti_bic", "tv_r2_mean", "tv_r2_std", "tv_rho_mean", "tv_rho_std",
                "n_windows", "mean_msd", "mean_cv"))


# The metrics of the three published group tests
GROUP_METRICS = ("lti_r2", "lti_rho", "lti_bic", "tv_r2_mean", "tv_rho_mean", "mean_msd",
                 "mean_cv")
QC_METRICS = ("lti_r2", "lti_rho", "best_P", "best_K", "n_windows")
SMALL_COHORT_METRICS = (*GROUP_METRICS, "best_P", "best_K", "n_windows")
SUBJECT_METRICS = ("global_msd", "global_variance", "global_coeff_cv", "outside_ci_fraction")


def qc_gate(facts: DataFrame, preset: Preset = PRESETS["qc"]) -> DataFrame:
    """First failing gate of every subject, as one processing-log row.

    ``facts`` has one row per subject: loaded, n_channels, expected_channels,
    selected, lti_rho, lti_r2, tv_fitted, n_windows, tf_ok; NULL = not reached.
    """
    def f(c, digits):
        return F.format_string(f"%.{digits}f", F.col(c))

    lim = preset.rho_lti
    # Statuses, reasons and details of the processing log
    gates = [
        (~F.coalesce(F.col("loaded"), F.lit(False)), "FAILED", "EEG_loading_error", "", "", ""),
        (F.col("n_channels") != F.col("expected_channels"), "REJECT", "Channel_mismatch",
         F.concat(F.lit("L="), F.col("expected_channels")),
         F.concat(F.lit("EEG="), F.col("n_channels")), ""),
        (~F.coalesce(F.col("selected"), F.lit(False)), "FAILED", "Model_selection_error",
         "", "", ""),
        (F.col("lti_rho").isNull(), "FAILED", "LTI_fitting_error", "", "", ""),
        (F.isnan("lti_rho") | (F.col("lti_rho") >= lim), "REJECT", "LTI_unstable",
         F.concat(F.lit("rho="), f("lti_rho", 4)), f"threshold={lim}", ""),
        (F.col("lti_r2") < preset.r2_min, "REJECT", "Low_R2",
         F.concat(F.lit("R2="), f("lti_r2", 4)), f"threshold={preset.r2_min}", ""),
        (~F.coalesce(F.col("tv_fitted"), F.lit(False)), "FAILED", "TV_fitting_error",
         "", "", ""),
        (F.coalesce("n_windows", F.lit(0)) < preset.min_windows, "REJECT",
         "Too_few_stable_windows", F.concat(F.lit("n="), F.coalesce("n_windows", F.lit(0))),
         f"threshold={preset.min_windows}", ""),
        (~F.coalesce(F.col("tf_ok"), F.lit(False)), "FAILED", "Transfer_function_error",
         "", "", ""),
    ]

    def row(status, reason, *details):
        cols = [x if not isinstance(x, str) else F.lit(x) for x in (status, reason, *details)]
        return F.struct(*[c.cast("string").alias(n) for c, n in zip(cols, QC_LOG.names[2:])])

    verdict = row("SUCCESS", "Completed", F.concat(F.lit("R2="), f("lti_r2", 3)),
                  F.concat(F.lit("rho="), f("lti_rho", 3)),
                  F.concat(F.lit("n_win="), F.col("n_windows")))
    for failed, *entry in reversed(gates):
        verdict = F.when(failed, row(*entry)).otherwise(verdict)
    return facts.select(*KEY, verdict.alias("v")).select(*KEY, "v.*")


def qc_report(log: DataFrame) -> DataFrame:
    """Counts by group, status and reason with the share of each group's subjects."""
    counts = log.groupBy("grp", "status", "reason").agg(F.count(F.lit(1)).alias("n"))
    total = log.groupBy("grp").agg(F.count(F.lit(1)).alias("n_subjects"))
    return counts.join(total, "grp").withColumn(
        "share_pct", 100 * F.col("n") / F.col("n_subjects"))


def qc_quality(facts: DataFrame, log: DataFrame) -> DataFrame:
    """Stability, fit and window statistics of the accepted subjects per group."""
    ok = facts.join(log.filter("status = 'SUCCESS'").select("subject_id"), "subject_id",
                    "left_semi")
    aggs = []
    for c in ("lti_rho", "lti_r2", "n_windows"):
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"),
                 F.min(c).alias(f"{c}_min"), F.max(c).alias(f"{c}_max")]
    return ok.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *aggs)


def qc_facts(signals: DataFrame, models: DataFrame, selected: DataFrame, basis: DataFrame, *,
             n_channels: int, length: int, step: int, preset: Preset = PRESETS["qc"],
             p_max: int = 20, fs: float = 100.0, n_omega: int | None = None,
             rejects: DataFrame | None = None) -> DataFrame:
    """The gate inputs of every subject from the shared model tables.

    ``rejects`` are recordings that could not be loaded (``read_cohort``); a
    window model without coefficients counts as a failed fit.
    """
    shape = signals.groupBy(*KEY).agg(F.count_distinct("channel").alias("n_channels")) \
        .withColumn("loaded", F.lit(True))
    if rejects is not None:
        shape = shape.unionByName(rejects.select(
            *KEY, F.lit(None).cast("long").alias("n_channels"), F.lit(False).alias("loaded")))
    lti = models.filter("scope = 'lti'")
    tv = tv_models(models, length, step, preset.rho_tv)
    bad_tf = failing_transfer(lti.unionByName(tv.select(*lti.columns)), basis, p_max, fs,
                              n_omega or preset.n_omega)
    return (
        shape.withColumn("expected_channels", F.lit(n_channels))
        .join(selected.select("subject_id", F.lit(True).alias("selected")), "subject_id", "left")
        .join(lti.select("subject_id", F.col("rho").alias("lti_rho"),
                         F.col("r2").alias("lti_r2")), "subject_id", "left")
        .join(tv.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_windows")),
              "subject_id", "left")
        .join(models.filter("scope = 'tv'").groupBy("subject_id").agg(
            (F.count_if(F.col("rho").isNull() | F.isnan("rho")) == 0).alias("tv_fitted")),
            "subject_id", "left")
        .withColumn("tv_fitted", F.coalesce("tv_fitted", F.lit(True)))
        .join(bad_tf, "subject_id", "left")
        .withColumn("tf_ok", F.coalesce("tf_ok", F.lit(True))))


def failing_transfer(models, basis, p_max, fs, n_omega):
    """Subjects with a model whose transfer function comes too close to a pole."""
    tf = transfer.transfer_function(models, basis, n_omega=n_omega, fs=fs, guard="none",
                                    p_max=p_max)
    low = F.coalesce(1 / F.col("mag"), F.lit(0.0))  # distance from the nearest pole
    near = tf.groupBy("subject_id").agg(F.min(low).alias("low"))
    return near.filter((F.col("low") < 1e-6) | (1 / (F.col("low") + 1e-10) > 1000)) \
        .select("subject_id", F.lit(False).alias("tf_ok"))


def qc_cohort(signals: DataFrame, basis: DataFrame, n_channels: int, *, length: int,
                       step: int, preset: Preset = PRESETS["qc"], fs: float = 100.0,
                       a: str = "A", b: str = "B",
                       rejects: DataFrame | None = None) -> dict[str, DataFrame]:
    """Grid, selection, models, gates and cohort statistics for all subjects at once.

    ``rejects`` of ``read_cohort`` enter the log, report and shares as failed.
    """
    signals, mismatch = channel_compatibility(signals, n_channels)
    grid = cut_lineage(model_grid(signals, basis, n_channels, preset.p_grid, preset.k_grid,
                                  rho_limit=preset.rho_select))
    selected = cut_lineage(select_model(grid, preset.fallback))
    p_max = max(*preset.p_grid, preset.fallback[0])
    models = cut_lineage(fit_cohort(
        signals, basis, n_channels, length=length, step=step, orders=selected, p_max=p_max,
        k_max=max(*preset.k_grid, preset.fallback[1])))
    facts = cut_lineage(qc_facts(signals, models, selected, basis, n_channels=n_channels,
                                 length=length, step=step, preset=preset, p_max=p_max, fs=fs,
                                 rejects=rejects))
    log = qc_gate(facts, preset).unionByName(mismatch.select(*QC_LOG.names))
    accepted = log.filter("status = 'SUCCESS'").select("subject_id")
    lti = lti_models(models, preset.rho_lti).join(accepted, "subject_id", "left_semi")
    tv = tv_models(models, length, step, preset.rho_tv).join(accepted, "subject_id", "left_semi")
    parts = cut_lineage(transfer.surface_pass(transfer.paired_models(tv, lti, basis),
                                              n_omega=preset.n_omega, guard="none"))
    surface = cut_lineage(transfer.pass_stats(parts, preset.n_omega, fs))
    summary = cut_lineage(group_summary_rows(signals, lti, tv, transfer.pass_msd(parts), surface,
                                             selected, fs))
    return {
        "model_grid": grid, "selected": selected, "models": models, "log": log,
        "report": qc_report(log), "quality": qc_quality(facts, log), "summary": summary,
        "group_stats": stats.two_group_test(
            stats.unpivot_metrics(summary, GROUP_METRICS), ["metric"], a=a, b=b),
        "qc_stats": stats.two_group_test(
            stats.unpivot_metrics(summary, QC_METRICS), ["metric"], a=a, b=b),
        "small_cohort_stats": stats.two_group_test(
            stats.unpivot_metrics(summary, SMALL_COHORT_METRICS), ["metric"], a=a, b=b),
        "pointwise": stats.pointwise_stats(stats.subject_curves(surface, "mode"), a=a, b=b),
        "band_stats": stats.band_stats(surface, a=a, b=b),
    }


def consensus_validation(edges: DataFrame, cons: DataFrame, *, w: str = "w",
                        rule: str = "ge_kplus1", sparsity: float = 0.15) -> dict[str, DataFrame]:
    """Subjects against their own group's consensus, ranked and summarised."""
    scores = cut_lineage(compare.subject_vs_consensus(edges, cons, b=w, rule=rule,
                                                      sparsity=sparsity))
    return {"scores": compare.pearson_p(scores), "ranked": compare.rank_subjects(scores),
            "summary": compare.agreement_summary(scores)}


def group_bases(cons: DataFrame, by: str = "grp", w: str = "g") -> DataFrame:
    """Packed eigenbasis of the normalised Laplacian of each group's graph."""
    lap = graphs.normalised_from_edges(cons, by, w)
    return sized(graphs.packed_basis(graphs.graph_fourier_basis(lap, by), by))
