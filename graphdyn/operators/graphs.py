"""Graph diagnostics and Laplacians.

Graphs are edge tables (key, i < j, w) over the channels of a montage; zero
weight means "no edge", and every pair is present. Work that needs a whole
matrix (an eigendecomposition) runs as one small group per graph, bounded by
the square of the channel count.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphdyn.schema import DEGREE_FLOOR
from graphdyn.session import cut_lineage, spread


def both_ways(edges: DataFrame, by: str = "grp", w: str = "w") -> DataFrame:
    """Each pair in both directions, in one scan."""
    return edges.select(by, F.inline(F.array(
        F.struct(F.col("i").alias("i"), F.col("j").alias("j"), F.col(w).alias("w")),
        F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col(w).alias("w")))))


def degree_strength(edges: DataFrame, by: str = "grp", w: str = "w") -> DataFrame:
    """Degree and strength per node."""
    return (both_ways(edges, by, w).groupBy(by, F.col("i").alias("node"))
            .agg(F.count_if(F.col("w") > 0).alias("degree"), F.sum("w").alias("strength")))


def degree_summary(edges: DataFrame, by: str = "grp", w: str = "w") -> DataFrame:
    d = degree_strength(edges, by, w)
    return d.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_nodes"),
        F.min("degree").alias("degree_min"), F.percentile("degree", 0.5).alias("degree_median"),
        F.max("degree").alias("degree_max"), F.stddev_pop("degree").alias("degree_std"),
        F.avg("degree").alias("degree_mean"),
        F.min("strength").alias("strength_min"),
        F.percentile("strength", 0.5).alias("strength_median"),
        F.max("strength").alias("strength_max"))


def edge_density(edges: DataFrame, by: str = "grp", w: str = "g", c: str = "c") -> DataFrame:
    """Kept and possible edges; mean and median consensus over the kept ones."""
    kept = F.col(w) > 0
    return edges.groupBy(by).agg(
        F.count_if(kept).alias("n_edges"), F.count(F.lit(1)).alias("n_possible"),
        (100 * F.count_if(kept) / F.count(F.lit(1))).alias("sparsity_pct"),
        F.avg(F.when(kept, F.col(c))).alias("consensus_mean"),
        F.percentile(F.when(kept, F.col(c)), 0.5).alias("consensus_median"))


# -- Laplacians -------------------------------------------------------------

def laplacian(edges: DataFrame, by: str = "grp", w: str = "w") -> DataFrame:
    """D - A as (key, i, j, v): both triangles and the diagonal."""
    cells = both_ways(edges, by, w).select(by, F.inline(F.array(
        F.struct(F.col("i"), F.col("j"), (-F.col("w")).alias("v")),
        F.struct(F.col("i"), F.col("i").alias("j"), F.col("w").alias("v")))))
    return cells.groupBy(by, "i", "j").agg(F.sum("v").alias("v"))


def normalised_from_edges(edges: DataFrame, by: str = "grp", w: str = "w") -> DataFrame:
    """I - D^-1/2 A D^-1/2 of an edge table; negative weights count as 0."""
    a = edges.withColumn("_a", F.greatest(F.col(w), F.lit(0.0)))
    deg = degree_strength(a, by, "_a").select(
        by, "node", F.greatest("strength", F.lit(DEGREE_FLOOR)).alias("d"))
    off = (a.join(deg.select(by, F.col("node").alias("i"), F.col("d").alias("di")), [by, "i"])
           .join(deg.select(by, F.col("node").alias("j"), F.col("d").alias("dj")), [by, "j"])
           .select(by, "i", "j", (-F.col("_a") / F.sqrt(F.col("di") * F.col("dj"))).alias("v")))
    diag = deg.select(by, F.col("node").alias("i"), F.col("node").alias("j"),
                      F.lit(1.0).alias("v"))
    return both_ways(off, by, "v").withColumnRenamed("w", "v").unionByName(diag)


def is_laplacian(matrix: DataFrame, by: str = "grp") -> DataFrame:
    """Flag per matrix: row sums near 0 and no negative diagonal.

    ``matrix`` holds every cell (key, i, j, v). Means run over rows and cells.
    """
    rows = matrix.groupBy(by, "i").agg(
        F.sum("v").alias("row_sum"), F.sum(F.abs("v")).alias("row_abs"),
        F.count(F.lit(1)).alias("cells"),
        F.min(F.when(F.col("i") == F.col("j"), F.col("v"))).alias("diag"))
    return rows.groupBy(by).agg(
        ((F.avg(F.abs("row_sum")) < 1e-3 * F.sum("row_abs") / F.sum("cells"))
         & (F.min("diag") >= -1e-6)).alias("is_laplacian"))


def _dense(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    nodes = np.unique(np.concatenate([pdf["i"].to_numpy(), pdf["j"].to_numpy()]))
    m = np.zeros((len(nodes), len(nodes)))
    m[np.searchsorted(nodes, pdf["i"]), np.searchsorted(nodes, pdf["j"])] = pdf["v"]
    return nodes, m


def _cells(by: str, key, nodes, m) -> pd.DataFrame:
    n = len(nodes)
    return pd.DataFrame({by: [key] * (n * n), "i": np.repeat(nodes, n), "j": np.tile(nodes, n),
                         "v": m.ravel()})


def _normalise_given_laplacian(by):
    def run(key, pdf):
        nodes, m = _dense(pdf)
        lam, u = np.linalg.eigh(m)
        if lam.min() < -1e-6:
            m = (u * np.clip(lam, 0.0, None)) @ u.T
        d = np.sqrt(np.maximum(np.diag(m), DEGREE_FLOOR))
        m = m / np.outer(d, d)
        return _cells(by, key[0], nodes, (m + m.T) / 2)
    return run


def laplacian_normalised(matrix: DataFrame, by: str = "grp") -> DataFrame:
    """Normalised Laplacian of a table of full matrices of either kind.

    The matrix is symmetrised first. Adjacency-like matrices go through joins;
    Laplacian-like ones need a possible eigenvalue clip and run per matrix.
    """
    clean = F.when(F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf")), 0.0) \
        .otherwise(F.col("v"))
    sym = (matrix.select(by, F.inline(F.array(
        F.struct(F.col("i"), F.col("j"), (clean / 2).alias("v")),
        F.struct(F.col("j").alias("i"), F.col("i").alias("j"), (clean / 2).alias("v")))))
        .groupBy(by, "i", "j").agg(F.sum("v").alias("v")))
    tagged = sym.join(is_laplacian(sym, by), by)
    given = (tagged.filter("is_laplacian").select(by, "i", "j", "v").groupBy(by)
             .applyInPandas(_normalise_given_laplacian(by),
                            f"{by} string, i int, j int, v double"))
    cells = tagged.filter(~F.col("is_laplacian")).select(
        by, "i", "j", F.greatest("v", F.lit(0.0)).alias("a"))
    # the degree of an adjacency-like matrix holds its diagonal
    deg = cells.groupBy(by, "i").agg(F.greatest(F.sum("a"), F.lit(DEGREE_FLOOR)).alias("di"))
    other = deg.select(by, F.col("i").alias("j"), F.col("di").alias("dj"))
    own = F.when(F.col("i") == F.col("j"), 1.0).otherwise(0.0)
    built = cells.join(deg, [by, "i"]).join(other, [by, "j"]).select(
        by, "i", "j", (own - F.col("a") / F.sqrt(F.col("di") * F.col("dj"))).alias("v"))
    return built.unionByName(given)


def graph_fourier_basis(lap: DataFrame, by: str = "grp") -> DataFrame:
    """Eigenpairs by ascending eigenvalue: (key, mode, lambda, u array<double>)."""
    def run(key, pdf):
        _, m = _dense(pdf)
        lam, u = np.linalg.eigh((m + m.T) / 2)
        return pd.DataFrame({by: [key[0]] * len(lam), "mode": np.arange(len(lam)),
                             "lambda": lam, "u": list(u.T)})
    return lap.select(by, "i", "j", "v").groupBy(by).applyInPandas(
        run, f"{by} string, mode int, lambda double, u array<double>")


def packed_basis(basis: DataFrame, by: str = "grp") -> DataFrame:
    """One row per graph: lam array, u flattened mode by mode."""
    return (basis.groupBy(by).agg(F.array_sort(F.collect_list(
        F.struct("mode", "lambda", "u"))).alias("b"))
        .select(by, F.col("b.lambda").alias("lam"), F.flatten("b.u").alias("u")))


def psd_shift(matrix: DataFrame, by: str = "grp") -> DataFrame:
    """Symmetrise; lift the diagonal when the smallest eigenvalue is below -1e-8."""
    def run(key, pdf):
        nodes, m = _dense(pdf)
        m = (m + m.T) / 2
        low = np.linalg.eigvalsh(m).min()
        if low < -1e-8:
            m = m - low * np.eye(len(m))
        return _cells(by, key[0], nodes, m)
    return matrix.select(by, "i", "j", "v").groupBy(by).applyInPandas(
        run, f"{by} string, i int, j int, v double")


def spectrum_summary(basis: DataFrame, by: str = "grp") -> DataFrame:
    return basis.groupBy(by).agg(
        F.min("lambda").alias("lambda_min"),
        F.max(F.when(F.col("mode") == 1, F.col("lambda"))).alias("lambda_two"),
        F.max("lambda").alias("lambda_max"),
        F.percentile("lambda", 0.75).alias("lambda_q3"),
        F.count_if(F.col("lambda") < 1e-5).alias("near_zero"))


# -- paths, components, clustering ------------------------------------------

#: Sources whose distances are computed together.
SOURCES = 256


def _nearest_first(cost: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Distances from each source, all sources at once: the nearest open node of each is settled next."""
    n, rows = len(cost), np.arange(len(sources))
    dist = np.full((len(sources), n), np.inf)
    dist[rows, sources] = 0.0
    settled = np.zeros(dist.shape, bool)
    for _ in range(n):
        u = np.where(settled, np.inf, dist).argmin(axis=1)
        d = dist[rows, u]
        if not np.isfinite(np.where(settled[rows, u], np.inf, d)).any():
            break
        settled[rows, u] = True
        np.minimum(dist, d[:, None] + cost[u], out=dist)
    return dist


def _hops(linked: np.ndarray, sources: np.ndarray) -> np.ndarray:
    """Edges on the shortest way from each source; -1 where there is none."""
    hops = np.full((len(sources), len(linked)), -1, np.int32)
    front = np.zeros(hops.shape, bool)
    front[np.arange(len(sources)), sources] = True
    level = 0
    while front.any():
        hops[front] = level
        level += 1
        front = (front.astype(np.float32) @ linked > 0) & (hops < 0)
    return hops


def all_pairs(edges: DataFrame, by: str = "grp", w: str = "w", length: str = "weight") -> DataFrame:
    """Shortest length and hop count of every connected ordered pair.

    A graph's edges travel as one array row per block of ``SOURCES`` source nodes;
    a task settles the nodes of its block in order of distance, for all sources
    at once. A row is bounded by the square of the channel count, and blocks of
    one graph run in different tasks. ``length`` is ``weight`` (the weight is
    the length) or ``inverse``.
    """
    if length not in ("weight", "inverse"):
        raise ValueError("length is weight or inverse")
    packed = edges.groupBy(by).agg(F.collect_list(F.struct("i", "j", F.col(w).cast("double").alias("w"))).alias("e"))
    nodes = F.size(F.array_distinct(F.concat("e.i", "e.j")))
    blocks = spread(packed.select(by, F.col("e.i").alias("i"), F.col("e.j").alias("j"), F.col("e.w").alias("w"),
                                  F.explode(F.sequence(F.lit(0), F.floor((nodes - 1) / SOURCES))).alias("block")),
                    by, "block")

    def run(batches):
        for pdf in batches:
            for row in pdf.itertuples(index=False):
                i, j, weight = np.asarray(row.i), np.asarray(row.j), np.asarray(row.w, float)
                names = np.unique(np.concatenate([i, j]))
                n, on = len(names), weight > 0
                at = np.searchsorted(names, i[on]), np.searchsorted(names, j[on])
                cost = np.full((n, n), np.inf)
                step = weight[on] if length == "weight" else 1 / weight[on]
                np.minimum.at(cost, at, step)
                cost = np.minimum(cost, cost.T)
                sources = np.arange(row.block * SOURCES, min(n, (row.block + 1) * SOURCES))
                hops = _hops(np.isfinite(cost).astype(np.float32), sources)
                dist = _nearest_first(cost, sources)
                a, b = np.nonzero(hops >= 0)
                yield pd.DataFrame({by: getattr(row, by), "i": names[sources[a]], "j": names[b], "d": dist[a, b],
                                    "h": hops[a, b]})

    types = dict(edges.dtypes)
    return blocks.mapInPandas(run, f"{by} {types[by]}, i {types['i']}, j {types['j']}, d double, h int")


def components(edges: DataFrame, by: str = "grp", w: str = "w") -> DataFrame:
    """Component label of every node: the smallest node it can reach over edges of positive weight.

    Labels spread along edges and are then replaced by their own labels, until
    nothing changes; each round is written out.
    """
    both = cut_lineage(both_ways(edges, by, w).select(by, "i", "j", "w"))
    arcs = both.filter("w > 0")
    lab = cut_lineage(both.select(by, F.col("i").alias("node"), F.col("i").alias("component")).distinct())
    while True:
        far = lab.select(by, F.col("node").alias("j"), F.col("component").alias("c"))
        near = arcs.join(far, [by, "j"]).groupBy(by, F.col("i").alias("node")).agg(F.min("c").alias("c"))
        new = lab.join(near, [by, "node"], "left").select(
            by, "node", F.col("component").alias("old"), F.least("component", "c").alias("c"))
        up = new.select(by, F.col("node").alias("c"), F.col("c").alias("c2"))
        new = cut_lineage(new.join(up, [by, "c"]).select(by, "node", "old", F.col("c2").alias("component")))
        lab = new.drop("old")
        if new.filter("old <> component").isEmpty():
            return lab


def components_of_pairs(pairs: DataFrame, by: str = "grp") -> DataFrame:
    """The same labels, read off the connected pairs where these are at hand."""
    return pairs.groupBy(by, F.col("i").alias("node")).agg(F.min("j").alias("component"))


def component_summary(edges: DataFrame, by: str = "grp", w: str = "w") -> DataFrame:
    return component_sizes(components(edges, by, w), by)


def component_sizes(labels: DataFrame, by: str = "grp") -> DataFrame:
    sizes = labels.groupBy(by, "component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy(by).agg(
        F.count(F.lit(1)).alias("component_count"), F.max("size").alias("largest_size"),
        (F.max("size") / F.sum("size")).alias("largest_fraction"))


def avg_shortest_path(pairs: DataFrame, by: str = "grp") -> DataFrame:
    """Mean length over ordered pairs of the largest component (lowest label on ties)."""
    lab = components_of_pairs(pairs, by)
    sizes = lab.groupBy(by, "component").agg(F.count(F.lit(1)).alias("size"))
    giant = sizes.groupBy(by).agg(F.max_by(
        "component", F.struct("size", (-F.col("component")).alias("k"))).alias("component"))
    inside = lab.join(giant, [by, "component"]).select(by, F.col("node").alias("i"))
    return (pairs.join(inside, [by, "i"]).filter("i <> j").groupBy(by)
            .agg(F.avg("d").alias("path_length"), F.avg("h").alias("hop_length")))


def weight_rows(edges: DataFrame, by: str = "grp", w: str = "w") -> DataFrame:
    """One row per node: its weights to nodes 0..n-1 as an array (0 on itself)."""
    arcs = both_ways(edges, by, w).select(by, F.inline(F.array(
        F.struct(F.col("i"), F.col("j"), F.greatest(F.col("w"), F.lit(0.0)).alias("w")),
        F.struct(F.col("i"), F.col("i").alias("j"), F.lit(0.0).alias("w")))))
    cells = arcs.groupBy(by, "i", "j").agg(F.max("w").alias("w"))
    return (cells.groupBy(by, "i")
            .agg(F.array_sort(F.collect_list(F.struct("j", "w"))).alias("r"))
            .select(by, "i", F.col("r.w").alias("row")))


def clustering_weighted(edges: DataFrame, by: str = "grp", w: str = "w") -> DataFrame:
    """Clustering per node: geometric mean of the triangle weights over max w.

    Undefined (NULL) in a graph without edges. Triangles are counted edge by edge: for the edge (i, j) the weight rows of
    its two ends are combined, so no wedge list is ever produced.
    """
    rows = weight_rows(edges, by, w)
    top = edges.groupBy(by).agg(F.max(w).alias("_top"))
    ends = (both_ways(edges, by, w).filter("w > 0")
            .join(rows.withColumnRenamed("row", "ri"), [by, "i"])
            .join(rows.select(by, F.col("i").alias("j"), F.col("row").alias("rj")), [by, "j"]))
    shared = F.aggregate(F.zip_with("ri", "rj", lambda a, b: F.cbrt(a * b)), F.lit(0.0),
                         lambda acc, v: acc + v)
    per_edge = ends.select(by, "i", (F.cbrt("w") * shared).alias("t"))
    tri = per_edge.groupBy(by, "i").agg(F.sum("t").alias("t"), F.count(F.lit(1)).alias("k"))
    nodes = rows.select(by, F.col("i"))
    k = F.col("k")
    return (nodes.join(tri, [by, "i"], "left").join(top, by)
            .select(by, F.col("i").alias("node"), F.when(F.col("_top") > 0, F.coalesce(
                F.when(k > 1, F.col("t") / F.col("_top") / (k * (k - 1))), F.lit(0.0)))
                .alias("clustering")))


def average_clustering(edges: DataFrame, by: str = "grp", w: str = "w") -> DataFrame:
    return clustering_weighted(edges, by, w).groupBy(by).agg(
        F.avg("clustering").alias("clustering"))


def small_world_index(edges: DataFrame, pairs: DataFrame, by: str = "grp",
                      w: str = "w") -> DataFrame:
    """sigma = (C / C_rand) / (L / L_rand) on the unweighted graph.

    The random baseline is in closed form: C_rand = k / n, L_rand = ln n / ln k
    with k the mean degree. Undefined below 4 nodes or without edges.
    """
    flat = edges.withColumn("_b", (F.col(w) > 0).cast("double"))
    c = average_clustering(flat, by, "_b")
    size = degree_strength(flat, by, "_b").groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("degree").alias("k"))
    lengths = avg_shortest_path(pairs, by).select(by, "hop_length")
    c_rand, l_rand = F.col("k") / F.col("n"), F.log("n") / F.log("k")
    sigma = (F.col("clustering") / c_rand) / (F.col("hop_length") / l_rand)
    return (size.join(c, by).join(lengths, by, "left")
            .select(by, "n", F.col("k").alias("mean_degree"), "clustering", "hop_length",
                    F.when((F.col("n") >= 4) & (F.col("k") > 1), sigma).alias("sigma")))


def graph_summary(cons: DataFrame, by: str = "grp") -> DataFrame:
    """One row of metrics per group over the columns c and g."""
    cons = cut_lineage(cons.select(by, "i", "j", "c", "g"))
    pairs = cut_lineage(all_pairs(cons, by, "g"))
    basis = graph_fourier_basis(laplacian(cons, by, "g"), by)
    world = small_world_index(cons, pairs, by, "g").select(
        by, F.col("sigma").alias("small_world_sigma"))
    parts = [
        degree_summary(cons, by, "g"), average_clustering(cons, by, "g"),
        avg_shortest_path(pairs, by).select(by, "path_length"), world,
        component_sizes(components_of_pairs(pairs, by), by), spectrum_summary(basis, by)]
    out = edge_density(cons, by)
    for p in parts:
        out = out.join(p, by, "left")
    return out
