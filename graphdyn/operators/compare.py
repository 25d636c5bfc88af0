"""Similarity of graphs, and of subjects to a consensus.

Two edge tables are aligned by a full equi-join on (i, j); all metrics of a pair
of graphs then come from one aggregation over the aligned weights a and b.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphdyn.functions.scalars import nan_to_null
from graphdyn.functions.special import t_p_value
from graphdyn.operators.connectivity import keep_flag
from graphdyn.operators.consensus import equal_width_histogram
from graphdyn.operators.ranking import global_positions
from graphdyn.session import sized


def align(left: DataFrame, right: DataFrame, keys=(), a: str = "w", b: str = "w") -> DataFrame:
    """Edges of two graph tables side by side: left columns, weights ``a`` and ``b``.

    ``keys`` are extra join columns beside (i, j), e.g. the group. An edge that
    one side lacks has weight 0 there; a left graph whose keys occur on the right
    gets all edges of that right graph.
    """
    own = [c for c in left.columns if c not in ("i", "j", a)]
    l = left.select(*own, "i", "j", F.col(a).alias("a"))
    r = right.select(*keys, "i", "j", F.col(b).alias("b"))
    if own:
        graphs = left.select(*own).distinct()
        if keys:
            r = graphs.join(r, list(keys))
        else:  # one graph for all, bounded by the montage
            packed = r.agg(F.collect_list(F.struct("i", "j", "b")).alias("e"))
            r = graphs.select(*own, F.inline(packed.scalar()))
    elif keys:
        raise ValueError("keys must be columns of the left table")
    return l.join(r, [*own, "i", "j"], "full").fillna(0.0, ["a", "b"])


def average_rank(keys, value: str) -> Column:
    """Mean rank among ties, within one graph (bounded by the montage)."""
    rising = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return F.rank().over(rising) + (F.count(F.lit(1)).over(ties) - 1) / 2


def with_ranks(pairs: DataFrame, keys) -> DataFrame:
    return (pairs.withColumn("rank_a", average_rank(keys, "a"))
            .withColumn("rank_b", average_rank(keys, "b")))


def with_kept(pairs: DataFrame, keys, rule: str = "ge_kplus1", sparsity: float = 0.15,
              value: float = 0.0) -> DataFrame:
    """Adds the kept flags of both sides under one thresholding rule."""
    return (pairs.withColumn("in_a", keep_flag(rule, keys, "a", sparsity, value))
            .withColumn("in_b", keep_flag(rule, keys, "b", sparsity, value)))


# -- metric expressions over aligned weights ---------------------------------

def pearson() -> Column:
    """0 where a side has no variance."""
    return F.coalesce(nan_to_null(F.corr("a", "b")), F.lit(0.0))


def spearman() -> Column:
    return F.coalesce(nan_to_null(F.corr("rank_a", "rank_b")), F.lit(0.0))


def cosine() -> Column:
    a, b = F.col("a"), F.col("b")
    norms = F.sqrt(F.sum(a * a)) * F.sqrt(F.sum(b * b))
    return F.when(norms > 0, F.sum(a * b) / norms).otherwise(0.0)


def jaccard(empty: float | None = 0.0) -> Column:
    """``empty`` is the index of two empty edge sets."""
    union = F.count_if(F.col("in_a") | F.col("in_b"))
    return F.when(union > 0, F.count_if(F.col("in_a") & F.col("in_b")) / union).otherwise(F.lit(empty))


def mean_abs_diff() -> Column:
    return F.avg(F.abs(F.col("a") - F.col("b")))


def rmsd() -> Column:
    d = F.col("a") - F.col("b")
    return F.sqrt(F.avg(d * d))


def frobenius(relative: bool = False) -> Column:
    """Norm of the difference over the full symmetric matrix."""
    d = F.col("a") - F.col("b")
    diff = F.sqrt(2 * F.sum(d * d))
    if not relative:
        return diff
    size = F.sum(F.col("a") * F.col("a"))
    return F.when(size > 0, diff / F.sqrt(2 * size))


def binary_overlap(flags: DataFrame, keys) -> DataFrame:
    """Counts and ratios of two kept edge sets (columns in_a, in_b)."""
    a, b = F.col("in_a"), F.col("in_b")
    c = flags.groupBy(*keys).agg(
        F.count_if(a).alias("edges_a"), F.count_if(b).alias("edges_b"),
        F.count_if(a & b).alias("n_both"), F.count_if(a & ~b).alias("only_a"),
        F.count_if(~a & b).alias("only_b"), F.count_if(a | b).alias("n_any"),
        F.avg((a == b).cast("double")).alias("agreement"))

    def ratio(num, den):
        return F.when(den > 0, num / den).otherwise(0.0)

    return (c.withColumn("jaccard", ratio(F.col("n_both"), F.col("n_any")))
            .withColumn("dice", ratio(2 * F.col("n_both"), F.col("edges_a") + F.col("edges_b")))
            .withColumn("overlap", ratio(F.col("n_both"), F.least("edges_a", "edges_b"))))


def edge_set_jaccard(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """Set form: INTERSECT and UNION of two edge lists per key."""
    cols = [*keys, "i", "j"]
    both = left.select(*cols).intersect(right.select(*cols)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_both"))
    anyone = left.select(*cols).union(right.select(*cols)).distinct().groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_any"))
    only = left.select(*cols).exceptAll(right.select(*cols)).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("only_left"))
    out = anyone.join(both, list(keys), "left").join(only, list(keys), "left")
    out = out.fillna(0, ["n_both", "only_left"])
    return out.withColumn("jaccard", F.col("n_both") / F.col("n_any"))


def edge_diff_stats(pairs: DataFrame, keys) -> DataFrame:
    """Differences a - b: moments, share beyond sd(a), one-sample t against 0."""
    d = F.col("a") - F.col("b")
    sd_a = pairs.groupBy(*keys).agg(F.stddev_pop("a").alias("_sd_a"))
    out = pairs.join(sd_a, list(keys)).groupBy(*keys).agg(
        F.avg(d).alias("mean_diff"), F.stddev_pop(d).alias("std_diff"),
        F.max(F.abs(d)).alias("max_abs_diff"),
        F.count_if(F.abs(d) > F.col("_sd_a")).alias("n_different"),
        F.count(F.lit(1)).alias("n_edges"), F.stddev_samp(d).alias("_s"))
    n = F.col("n_edges")
    t = F.when(F.col("_s") > 0, F.col("mean_diff") / (F.col("_s") / F.sqrt(n)))
    return (out.withColumn("pct_different", 100 * F.col("n_different") / n)
            .withColumn("t_stat", t).drop("_s"))


def pearson_p(df: DataFrame, r: str = "pearson_r", n: str = "n_edges") -> DataFrame:
    """Two-sided p of a correlation through t with n - 2 degrees of freedom."""
    rr, dof = F.col(r), F.col(n) - 2
    t = rr * F.sqrt(dof / F.greatest(1 - rr * rr, F.lit(1e-300)))
    return df.withColumn("pearson_p", t_p_value(t, dof.cast("double")))


def spectrum_similarity(basis: DataFrame, left: str, right: str, by: str = "grp") -> DataFrame:
    """Correlation and distance of two sorted spectra, matched by mode index."""
    a = basis.filter(F.col(by) == left).select("mode", F.col("lambda").alias("a"))
    b = basis.filter(F.col(by) == right).select("mode", F.col("lambda").alias("b"))
    d = F.col("a") - F.col("b")
    return a.join(b, "mode").agg(pearson().alias("spectrum_r"),
                                 F.sqrt(F.sum(d * d)).alias("spectrum_distance"))


# -- subjects against a consensus ---------------------------------------------

def subject_vs_consensus(edges: DataFrame, cons: DataFrame, *, keys=("grp",), b: str = "w",
                         rule: str = "ge_kplus1", sparsity: float = 0.15,
                         value: float = 0.0) -> DataFrame:
    """Every metric for every subject against one consensus.

    ``keys`` = ("grp",) compares with the own group; () with a single graph.
    One aggregation per subject over n(n-1)/2 aligned pairs; ranks and cut-offs
    of both sides share the same partitioning.
    """
    own = ["subject_id", "grp"]
    graph = sized(cons.select(*keys, "i", "j", b))
    pairs = align(edges.select(*own, "i", "j", "w"), graph, keys, b=b)
    ready = with_kept(with_ranks(pairs, own), own, rule, sparsity, value)
    return ready.groupBy(*own).agg(
        pearson().alias("pearson_r"), spearman().alias("spearman_rho"),
        jaccard().alias("jaccard"), cosine().alias("cosine"),
        mean_abs_diff().alias("mean_abs_diff"), rmsd().alias("rmsd"),
        F.count_if(F.col("in_a") & F.col("in_b")).alias("shared_edges"),
        F.count_if("in_a").alias("subject_edges"), F.count_if("in_b").alias("consensus_edges"),
        F.count(F.lit(1)).alias("n_edges"))


def cross_group(edges: DataFrame, cons: DataFrame, swap: dict[str, str], **kw) -> DataFrame:
    """Subjects against the other group's consensus."""
    swapped = F.create_map(*[F.lit(x) for kv in swap.items() for x in kv])
    other = cons.withColumn("grp", swapped[F.col("grp")])
    return subject_vs_consensus(edges, other, **kw)


def group_vs_group(cons: DataFrame, left: str, right: str, *, w: str = "w", by: str = "grp",
                   rule: str = "ge_k", sparsity: float = 0.15) -> DataFrame:
    """All pairwise metrics between two groups' consensus graphs, one row."""
    a = cons.filter(F.col(by) == left).select("i", "j", F.col(w).alias("w"))
    b = cons.filter(F.col(by) == right).select("i", "j", F.col(w).alias("w"))
    pairs = align(a, b).withColumn("pair", F.lit(f"{left}-{right}"))
    keys = ["pair"]
    ready = with_kept(with_ranks(pairs, keys), keys, rule, sparsity)
    return ready.groupBy(*keys).agg(
        pearson().alias("pearson_r"), spearman().alias("spearman_rho"),
        jaccard().alias("jaccard"), cosine().alias("cosine"),
        mean_abs_diff().alias("mean_abs_diff"), rmsd().alias("rmsd"),
        frobenius().alias("frobenius"), frobenius(True).alias("frobenius_rel"),
        F.count(F.lit(1)).alias("n_edges"))


def rank_subjects(scores: DataFrame, by: str = "pearson_r", id_col: str = "subject_id",
                  name: str = "rank") -> DataFrame:
    """1-based rank by descending score; ties by id."""
    return global_positions(scores, F.col(by).desc(), F.col(id_col), name=name)


def top_and_bottom(ranked: DataFrame, head: int = 10, tail: int = 5,
                   name: str = "rank") -> DataFrame:
    """First ``head`` and last ``tail`` subjects of a ranking (a report)."""
    first = ranked.orderBy(name).limit(head).withColumn("part", F.lit("top"))
    last = ranked.orderBy(F.col(name).desc()).limit(tail).withColumn("part", F.lit("bottom"))
    return first.unionByName(last)


def example_picks(ranked: DataFrame, name: str = "rank") -> DataFrame:
    """Best, upper-median (n//3), lower-median (2n//3) and worst subject."""
    n = ranked.select(F.count(F.lit(1))).scalar()
    pos = F.col(name) - 1
    label = (F.when(pos == 0, "best").when(pos == F.floor(n / 3), "upper_median")
             .when(pos == F.floor(2 * n / 3), "lower_median").when(pos == n - 1, "worst"))
    return ranked.withColumn("pick", label).filter("pick is not null")


def agreement_summary(scores: DataFrame, by: str = "grp", r: str = "pearson_r",
                      j: str = "jaccard") -> DataFrame:
    rr, jj = F.col(r), F.col(j)

    def share(flag):
        return F.avg(flag.cast("double"))

    return scores.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(rr).alias("r_mean"), F.stddev_pop(rr).alias("r_std"),
        F.min(rr).alias("r_min"), F.max(rr).alias("r_max"),
        F.avg(jj).alias("j_mean"), F.stddev_pop(jj).alias("j_std"),
        F.min(jj).alias("j_min"), F.max(jj).alias("j_max"),
        F.count_if(rr > 0.5).alias("n_r_above"), share(rr > 0.5).alias("share_r_above"),
        F.count_if(jj > 0.5).alias("n_j_good"), share(jj > 0.5).alias("share_j_good"),
        F.count_if(jj > 0.3).alias("n_j_ok"), share(jj > 0.3).alias("share_j_ok"))


def agreement_histogram(scores: DataFrame, value: str = "pearson_r", by: str = "grp",
                        n_bins: int = 20) -> DataFrame:
    return equal_width_histogram(scores, value, [by], n_bins)
