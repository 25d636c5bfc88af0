"""Group consensus networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphdyn.functions.scalars import fisher_z, fisher_z_inv, resolve_sparsity
from graphdyn.operators.connectivity import keep_flag, threshold


def consensus_direct(edges: DataFrame, sparsity: float | None = 0.15,
                     by: str = "grp") -> DataFrame:
    """|tanh(mean atanh r)| per pair, then the proportional threshold.

    Columns: by, i, j, c (0/1), w (thresholded), w_full (dense).
    """
    dense = (edges.groupBy(by, "i", "j")
             .agg(F.abs(fisher_z_inv(F.avg(fisher_z("w")))).alias("w_full")))
    if sparsity is None or sparsity >= 1:
        return dense.select(by, "i", "j", (F.col("w_full") > 0).cast("double").alias("c"),
                            F.col("w_full").alias("w"), "w_full")
    kept = dense.withColumn("keep", keep_flag("proportional", [by], "w_full", sparsity))
    w = F.when(F.col("keep"), F.col("w_full")).otherwise(0.0)
    return kept.select(by, "i", "j", F.when(w > 0, 1.0).otherwise(0.0).alias("c"),
                       w.alias("w"), "w_full")


def consensus_binarize(edges: DataFrame, sparsity: float = 0.15,
                       by: str = "grp") -> DataFrame:
    """Share of subjects that keep an edge, and the mean weight where it is kept.

    Also carries ``mean_sparsity``, the average kept fraction of the subjects.
    """
    cut = threshold(edges, "proportional", keys=(by, "subject_id"), sparsity=sparsity)
    z = fisher_z("w")
    out = cut.groupBy(by, "i", "j").agg(
        F.avg(F.col("keep").cast("double")).alias("c"),
        F.coalesce(F.abs(fisher_z_inv(F.avg(F.when(F.col("keep"), z)))), F.lit(0.0)).alias("w"),
        F.abs(fisher_z_inv(F.avg(z))).alias("w_full"))
    # every subject holds the same dense pair set, so the mean of c is the mean kept fraction
    return out.withColumn("mean_sparsity", F.avg("c").over(Window.partitionBy(by)))


def consensus_mean(edges: DataFrame, by: str = "grp") -> DataFrame:
    return edges.groupBy(by, "i", "j").agg(F.avg("w").alias("w"))


def consensus(edges: DataFrame, method: str = "direct", sparsity: float | None = 0.15,
              by: str = "grp") -> DataFrame:
    if method == "direct":
        return consensus_direct(edges, sparsity, by)
    if method == "binarize":
        return consensus_binarize(edges, sparsity, by)
    raise ValueError(f"unknown consensus method {method!r}")


def consensus_by_subgroup(edges: DataFrame, sparsity: float = 0.15) -> DataFrame:
    """Dense consensus at three levels: subgroup, group and the whole cohort.

    Edges carry grp and subgroup. Subjects are reduced once at the finest
    level; the coarser levels roll up those sums, not the subjects.
    """
    fine = edges.groupBy("grp", "subgroup", "i", "j").agg(
        F.sum(fisher_z("w")).alias("z"), F.count(F.lit(1)).alias("n"))
    levels = fine.groupingSets(
        [[F.col("i"), F.col("j"), F.col("grp"), F.col("subgroup")],
         [F.col("i"), F.col("j"), F.col("grp")],
         [F.col("i"), F.col("j")]],
        F.col("i"), F.col("j"), F.col("grp"), F.col("subgroup"),
    ).agg(F.sum("z").alias("z"), F.sum("n").alias("n"),
          F.grouping_id().alias("gid"))
    label = (F.when(F.col("gid") == 0, F.concat_ws("_", "grp", "subgroup"))
             .when(F.col("gid") == 1, F.col("grp")).otherwise(F.lit("ALL")))
    dense = levels.select(
        label.alias("cohort"), "i", "j", F.col("n").alias("n_subjects"),
        F.abs(fisher_z_inv(F.col("z") / F.col("n"))).alias("w_full"))
    keep = keep_flag("proportional", ["cohort"], "w_full", sparsity)
    return dense.withColumn("keep", keep).select(
        "cohort", "i", "j", "n_subjects", "w_full",
        F.when(F.col("keep"), F.col("w_full")).otherwise(0.0).alias("w"))


# -- final graph ------------------------------------------------------------

def channel_distance(channels: DataFrame) -> DataFrame:
    """Euclidean distance of every channel pair (n(n-1)/2 rows of the layout)."""
    last = channels.select(F.max("channel")).scalar()
    a = channels.select(F.col("channel").alias("i"), F.col("x").alias("xa"),
                        F.col("y").alias("ya"), F.col("z").alias("za"))
    a = a.filter(F.col("i") < last).withColumn(
        "j", F.explode(F.sequence(F.col("i") + 1, last)))
    b = channels.select(F.col("channel").alias("j"), F.col("x").alias("xb"),
                        F.col("y").alias("yb"), F.col("z").alias("zb"))
    dx, dy, dz = (F.col(f"{v}a") - F.col(f"{v}b") for v in "xyz")
    return a.join(b, "j").select(
        "i", "j", F.sqrt(dx * dx + dy * dy + dz * dz).alias("dist"))


def distance_bins(distances: DataFrame, n_bins: int = 10) -> DataFrame:
    """Adds ``bin``: equal-count distance bins, closed below, open above.

    The edges are linear-interpolated percentiles. The layout has a fixed
    number of pairs, so its sorted distances fit one row.
    """
    ranked = distances.agg(F.array_sort(F.collect_list("dist")).alias("s"))
    edges = []
    for b in range(n_bins + 1):
        pos = F.lit(b / n_bins) * (F.size("s") - 1)
        low = F.least(F.floor(pos), F.size("s") - 1).cast("int")
        high = F.least(low + 1, F.size("s") - 1)
        at_low, at_high = F.get("s", low), F.get("s", high)
        edges.append(at_low + (at_high - at_low) * (pos - low))
    edges[-1] = edges[-1] + F.lit(1e-10)
    cuts = ranked.select(F.array(*edges).alias("cuts")).scalar()
    below = F.size(F.filter("_cuts", lambda e: e <= F.col("dist"))) - 1
    return (distances.withColumn("_cuts", cuts)
            .withColumn("bin", below.cast("int")).drop("_cuts"))


def k_target(sparsity, total):
    """clip(round-half-even(s E), 1, E)."""
    s = F.lit(sparsity) if not hasattr(sparsity, "alias") else sparsity
    k = F.bround(s * total, 0).cast("long")
    return F.greatest(F.least(k, total), F.lit(1).cast("long"))


def _sparsity_column(spec):
    if isinstance(spec, str):
        # the mean kept fraction travels with the table, see consensus_binarize
        resolve_sparsity(spec, 1.0)
        return F.col("mean_sparsity")
    return resolve_sparsity(spec)


def consensus_dense_graph(cons: DataFrame, require_existing: bool = True,
                          by: str = "grp") -> DataFrame:
    """No sparsity target: every qualifying edge with its dense weight."""
    ok = F.col("w_full") > 0
    if require_existing:
        ok = ok & (F.col("c") > 0)
    return cons.select(by, "i", "j", F.when(ok, F.col("w_full")).otherwise(0.0).alias("g"))


def distance_consensus(cons: DataFrame, channels: DataFrame, target=0.15, n_bins: int = 10,
                       epsilon: float = 0.1, require_existing: bool = True,
                       by: str = "grp") -> DataFrame:
    """Edges spread evenly over distance bins, left-over slots filled globally.

    Columns: by, i, j, dist, bin, score, selected, g. All pairs stay in the
    result; the pair set of a group is bounded by the montage.
    """
    if target is None:
        return consensus_dense_graph(cons, require_existing, by)
    binned = distance_bins(channel_distance(channels), n_bins)
    scored = cons.join(binned, ["i", "j"]).withColumn(
        "score", F.col("c") + F.lit(epsilon) * F.col("w"))
    group = Window.partitionBy(by)
    total = F.count(F.lit(1)).over(group)
    scored = scored.withColumn("_k", k_target(_sparsity_column(target), total))
    valid = F.col("c") != 0 if require_existing else F.lit(True)
    order = [F.col("score").desc(), F.col("i"), F.col("j")]
    quota = F.floor(F.col("_k") / n_bins) + F.when(
        F.col("bin") < F.col("_k") % n_bins, 1).otherwise(0)
    in_bin = Window.partitionBy(by, "bin", "_valid").orderBy(*order)
    first = (scored.withColumn("_valid", valid)
             .withColumn("_first", F.col("_valid") & (F.row_number().over(in_bin) <= quota)))
    left = F.col("_k") - F.count_if("_first").over(group)
    candidate = F.col("_valid") & ~F.col("_first") & (F.col("score") > 0)
    rest = Window.partitionBy(by, "_cand").orderBy(*order)
    done = (first.withColumn("_left", left).withColumn("_cand", candidate)
            .withColumn("selected", F.col("_first") | (
                F.col("_cand") & (F.row_number().over(rest) <= F.col("_left")))))
    return done.select(by, "i", "j", "dist", "bin", "score", "selected",
                       F.when(F.col("selected"), F.col("w")).otherwise(0.0).alias("g"))


def uniform_consensus(cons: DataFrame, target=0.15, require_existing: bool = True,
                      by: str = "grp") -> DataFrame:
    """The k edges of highest consensus, whatever their length."""
    if target is None:
        return consensus_dense_graph(cons, require_existing, by)
    valid = F.col("c") > 0 if require_existing else F.lit(True)
    total = F.count(F.lit(1)).over(Window.partitionBy(by))
    ranked = Window.partitionBy(by, "_valid").orderBy(F.col("c").desc(), "i", "j")
    out = (cons.withColumn("_k", k_target(_sparsity_column(target), total))
           .withColumn("_valid", valid)
           .withColumn("selected", F.col("_valid") & (F.row_number().over(ranked) <= F.col("_k"))))
    return out.select(by, "i", "j", "selected",
                      F.when(F.col("selected"), F.col("w")).otherwise(0.0).alias("g"))


# -- reports ----------------------------------------------------------------

def consensus_properties(cons: DataFrame, by: str = "grp") -> DataFrame:
    """One row per group over the columns c, w and g."""
    wpos = F.when(F.col("w") > 0, F.col("w"))
    gpos = F.when(F.col("g") > 0, F.col("g"))
    edge = cons.groupBy(by).agg(
        F.min("c").alias("c_min"), F.max("c").alias("c_max"), F.avg("c").alias("c_mean"),
        F.percentile("c", 0.5).alias("c_median"),
        F.count_if(F.col("c") > 0).alias("n_c_pos"),
        F.count_if(F.col("c") > 0.5).alias("n_c_half"),
        F.count_if(F.col("c") == 1).alias("n_c_one"),
        F.min(wpos).alias("w_min"), F.max("w").alias("w_max"), F.avg(wpos).alias("w_mean"),
        F.percentile(wpos, 0.5).alias("w_median"),
        F.count(gpos).alias("n_edges"),
        (F.count(gpos) / F.count(F.lit(1))).alias("sparsity"),
        F.min(gpos).alias("g_min"), F.max(gpos).alias("g_max"), F.avg(gpos).alias("g_mean"))
    ends = cons.select(by, F.explode(F.array("i", "j")).alias("node"),
                       (F.col("g") > 0).cast("int").alias("on"))
    degree = (ends.groupBy(by, "node").agg(F.sum("on").alias("d")).groupBy(by)
              .agg(F.min("d").alias("deg_min"), F.max("d").alias("deg_max"),
                   F.avg("d").alias("deg_mean"), F.stddev_pop("d").alias("deg_std")))
    return edge.join(degree, by)


def equal_width_histogram(df: DataFrame, value: str, keys, n_bins: int) -> DataFrame:
    """Counts over equal-width bins between min and max, last bin closed."""
    keys = list(keys)
    span = df.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    width = (F.col("_hi") - F.col("_lo")) / n_bins
    raw = F.floor((F.col(value) - F.col("_lo")) / width)
    b = F.when(width > 0, F.least(raw, F.lit(n_bins - 1))).otherwise(F.lit(n_bins // 2))
    return (df.join(span, keys).groupBy(*keys, b.cast("int").alias("bin"))
            .agg(F.count(F.lit(1)).alias("n"), F.first("_lo").alias("lo"),
                 F.first("_hi").alias("hi")))


def consensus_histogram(cons: DataFrame, n_bins: int = 50, by: str = "grp") -> DataFrame:
    """Histogram of the positive consensus values with their mean and median."""
    pos = cons.filter(F.col("c") > 0).select(by, "c")
    mid = pos.groupBy(by).agg(F.avg("c").alias("c_mean"),
                              F.percentile("c", 0.5).alias("c_median"))
    return equal_width_histogram(pos, "c", [by], n_bins).join(mid, by)


def recovery_jaccard(graph: DataFrame, truth: DataFrame, truth_above: float = 0.4,
                     by: str = "grp") -> DataFrame:
    """Overlap of a recovered edge set (g > 0) with a truth graph (w > limit).

    Both sides may be sparse; a pair absent from one side is not an edge.
    """
    a = graph.select(by, "i", "j", (F.col("g") > 0).cast("double").alias("a"))
    b = truth.select(by, "i", "j", (F.col("w") > truth_above).cast("double").alias("b"))
    both = a.join(b, [by, "i", "j"], "full").fillna(0.0, ["a", "b"])
    inter = F.sum(F.col("a") * F.col("b"))
    union = F.sum(F.col("a") + F.col("b") - F.col("a") * F.col("b"))
    return both.groupBy(by).agg(
        F.sum("a").alias("n_recovered"), F.sum("b").alias("n_truth"),
        F.when(union > 0, inter / union).otherwise(0.0).alias("jaccard"))
