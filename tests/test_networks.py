import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphdyn.operators import compare, connectivity, consensus, graphs
from graphdyn.plans import cohort

EDGE = "subject_id string, grp string, i int, j int, w double"


def edges_frame(spark, graphs_by_id, grp="A"):
    return spark.createDataFrame(
        [(s, grp, i, j, float(m[i, j])) for s, m in graphs_by_id.items()
         for i, j in itertools.combinations(range(len(m)), 2)], EDGE)


def random_graph(n, seed, digits=None):
    a = np.random.default_rng(seed).random((n, n))
    a = np.round((a + a.T) / 2, digits) if digits else (a + a.T) / 2
    np.fill_diagonal(a, 0)
    return a


def test_correlation_with_constant_channel_and_hot_subject(spark):
    rng = np.random.default_rng(0)
    x = {"big": rng.normal(size=(900, 4)) + 1e4, "small": rng.normal(size=(40, 4))}
    x["big"][:, 2] = 7.0
    rows = [(s, "A", t, v.tolist()) for s, m in x.items() for t, v in enumerate(m)]
    f = spark.createDataFrame(rows, "subject_id string, grp string, t long, x array<double>") \
        .repartition(7)
    got = {(r.subject_id, r.i, r.j): r.w for r in connectivity.pearson_edges(f).collect()}
    for s, m in x.items():
        with np.errstate(invalid="ignore", divide="ignore"):
            c = np.nan_to_num(np.abs(np.corrcoef(m.T)))
        for i, j in itertools.combinations(range(4), 2):
            want = 0.0 if s == "big" and 2 in (i, j) else c[i, j]
            assert got[(s, i, j)] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("subjects", [20, 400, 4000])
def test_partial_states_do_not_depend_on_subjects(spark, subjects):
    """At most one state per (subject, task), however many subjects share the tasks."""
    t = F.col("id") % 20 + connectivity.BLOCK * (F.col("id") % 2)
    f = spark.range(subjects * 40).select(
        F.concat(F.lit("s"), (F.floor(F.col("id") / 40)).cast("string")).alias("subject_id"),
        F.lit("A").alias("grp"), t.alias("t"),
        F.array(F.rand(1), F.rand(2), F.rand(3)).alias("x")).coalesce(4)
    n, low, total = connectivity.block_moments(f).agg(F.count("*"), F.min("n"), F.sum("n")).first()
    assert subjects <= n <= 2 * subjects and low >= 20 and total == 40 * subjects
    assert connectivity.pair_moments(f).agg(F.min("n"), F.max("n"), F.count("*")).first() \
        == (40, 40, 3 * subjects)


def test_states_of_many_blocks_merge_within_a_task(spark, monkeypatch):
    """The rows that leave a task do not grow with its blocks, and early sending changes no result."""
    monkeypatch.setattr(connectivity, "BLOCK", 8)
    f = spark.range(3000).select(
        F.when(F.col("id") % 10 < 7, "hot").otherwise("s").alias("subject_id"), F.lit("A").alias("grp"), F.col("id").alias("t"),
        F.array(1e7 + F.rand(1), F.rand(2), F.rand(1) + F.rand(3)).alias("x"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert connectivity.block_moments(f).count() <= 2 * tasks
    merged = {(r.subject_id, r.i, r.j): r.w for r in connectivity.pearson_edges(f).collect()}
    monkeypatch.setattr(connectivity, "HELD", 1)
    early = {(r.subject_id, r.i, r.j): r.w for r in connectivity.pearson_edges(f).collect()}
    rows = f.collect()
    for s in ("hot", "s"):
        want = np.abs(np.corrcoef(np.array([r.x for r in rows if r.subject_id == s]).T))
        for i, j in itertools.combinations(range(3), 2):
            assert merged[s, i, j] == pytest.approx(want[i, j], abs=1e-6)
            assert merged[s, i, j] == pytest.approx(early[s, i, j], abs=1e-9)


def test_sparse_sides_align_with_zero(spark):
    left = spark.createDataFrame([("s", "A", 0, 1, 0.5)], "subject_id string, grp string, i int, j int, w double")
    right = spark.createDataFrame([("A", 0, 1, 0.5), ("A", 0, 2, 0.4), ("B", 0, 1, 1.0)], "grp string, i int, j int, w double")
    got = sorted(tuple(r) for r in compare.align(left, right, ["grp"]).collect())
    assert got == [("s", "A", 0, 1, 0.5, 0.5), ("s", "A", 0, 2, 0.0, 0.4)]
    one = right.filter("grp = 'A'").drop("grp")
    got = compare.subject_vs_consensus(left, one, keys=()).first()
    assert got.n_edges == 2 and got.cosine == pytest.approx(0.25 / (0.5 * np.hypot(0.5, 0.4)))
    pairs = compare.align(one.filter("j = 2"), one.filter("j = 1")).collect()
    assert sorted((r.a, r.b) for r in pairs) == [(0.0, 0.5), (0.4, 0.0)]


def test_dense_consensus_marks_positive_pairs_only(spark):
    e = spark.createDataFrame([("s", "A", 0, 1, 0.0), ("s", "A", 0, 2, 0.3)], "subject_id string, grp string, i int, j int, w double")
    got = {(r.i, r.j): r.c for r in consensus.consensus_direct(e, None).collect()}
    assert got == {(0, 1): 0.0, (0, 2): 1.0}


def test_path_of_twelve_nodes(spark):
    e = spark.createDataFrame([("g", i, i + 1, 1.0) for i in range(11)] + [("g", 20, 21, 0.0)],
                              "grp string, i int, j int, w double")
    pairs = graphs.all_pairs(e)
    assert pairs.filter("i < 12 and j < 12").count() == 144 and pairs.agg(F.max("h")).first()[0] == 11
    c = graphs.component_summary(e).first()
    assert (c.component_count, c.largest_size) == (3, 12)


def test_adjacency_with_diagonal_and_graph_without_edges(spark):
    m = spark.createDataFrame([("g", i, j, 1.0 if i == j else 0.5) for i in range(2) for j in range(2)],
                              "grp string, i int, j int, v double")
    got = {(r.i, r.j): r.v for r in graphs.laplacian_normalised(m).collect()}
    assert got == pytest.approx({(0, 0): 1 / 3, (1, 1): 1 / 3, (0, 1): -1 / 3, (1, 0): -1 / 3})
    none = spark.createDataFrame([("g", 0, 1, 0.0)], "grp string, i int, j int, w double")
    assert [r.clustering for r in graphs.clustering_weighted(none).collect()] == [None, None]


@pytest.mark.parametrize("kappa", [0.15, 0.4, 1.0])
def test_threshold_rules_with_ties(spark, kappa):
    m = random_graph(9, 4, digits=1)
    w = m[np.triu_indices(9, 1)]
    falling = np.sort(w)[::-1]
    e, k = len(w), int(kappa * len(w))
    df = edges_frame(spark, {"s": m})

    def kept(rule):
        return connectivity.threshold(df, rule, sparsity=kappa).filter("keep").count()

    assert kept("proportional") == (w > (falling[k] if k < e else 0)).sum()
    assert kept("ge_kplus1") == (w >= falling[min(k, e - 1)]).sum()
    assert kept("ge_k") == (w >= falling[k - 1]).sum()


def test_direct_and_binarize(spark):
    ms = {f"s{k}": random_graph(8, k) * 0.9 for k in range(5)}
    df = edges_frame(spark, ms)
    iu = np.triu_indices(8, 1)
    z = np.arctanh(np.stack([m[iu] for m in ms.values()]))
    full = np.tanh(z.mean(axis=0))
    k = int(0.3 * 28)
    limit = np.sort(full)[::-1][k]
    d = consensus.consensus_direct(df, 0.3).orderBy("i", "j").toPandas()
    np.testing.assert_allclose(d.w_full, full)
    np.testing.assert_allclose(d.w, np.where(full > limit, full, 0))
    keep = np.stack([r > np.sort(r)[::-1][k] for r in z])
    b = consensus.consensus_binarize(df, 0.3).orderBy("i", "j").toPandas()
    np.testing.assert_allclose(b.c, keep.mean(axis=0))
    cond = np.array([np.tanh(z[keep[:, q], q].mean()) if keep[:, q].any() else 0
                     for q in range(28)])
    np.testing.assert_allclose(b.w, cond)


def test_distance_consensus_fills_from_the_rest(spark):
    """Bins without enough existing edges hand their slots to the best others."""
    rng = np.random.default_rng(5)
    n = 12
    pos = rng.random((n, 3))
    pos[6:] = pos[:6] + 1e-3  # repeated distances
    ch = spark.createDataFrame([(c, f"c{c}", *map(float, p)) for c, p in enumerate(pos)],
                               "channel int, name string, x double, y double, z double")
    c = (rng.random((n, n)) < 0.35) * rng.integers(1, 5, (n, n)) / 4
    iu = np.triu_indices(n, 1)
    cv, wv = c[iu], np.where(c[iu] > 0, rng.random(len(iu[0])), 0.0)
    cons = spark.createDataFrame(
        [("A", int(i), int(j), float(a), float(b)) for i, j, a, b in zip(*iu, cv, wv)],
        "grp string, i int, j int, c double, w double")
    got = consensus.distance_consensus(cons, ch, 0.3).orderBy("i", "j").toPandas()
    dist = np.linalg.norm(pos[iu[0]] - pos[iu[1]], axis=1)
    cuts = np.percentile(dist, np.linspace(0, 100, 11))
    cuts[-1] += 1e-10
    kt = int(np.clip(round(0.3 * 66), 1, 66))
    score, chosen = cv + 0.1 * wv, set()
    order = sorted(range(66), key=lambda q: (-score[q], iu[0][q], iu[1][q]))
    for b in range(10):
        quota = kt // 10 + (b < kt % 10)
        inside = [q for q in order if cuts[b] <= dist[q] < cuts[b + 1] and cv[q] > 0]
        chosen |= set(inside[:quota])
    rest = [q for q in order if q not in chosen and cv[q] > 0]
    chosen |= set(rest[:kt - len(chosen)])
    assert set(np.flatnonzero(got.selected)) == chosen


def test_two_components_paths_and_clustering(spark):
    w = np.zeros((7, 7))
    for i, j, v in ((0, 1, .5), (1, 2, .25), (0, 2, .9), (2, 3, .5), (4, 5, 1.0)):
        w[i, j] = w[j, i] = v
    e = edges_frame(spark, {"s": w}).select("grp", "i", "j", "w")
    pairs = graphs.all_pairs(e)
    c = graphs.component_summary(e).first()
    assert (c.component_count, c.largest_size) == (3, 4)
    d = {(r.i, r.j): (r.d, r.h) for r in pairs.collect()}
    assert d[(0, 2)] == (0.75, 1) and d[(0, 3)] == (1.25, 2) and (0, 4) not in d
    got = graphs.avg_shortest_path(pairs).first()
    assert got.path_length == pytest.approx(np.mean([.5, .75, 1.25, .25, .75, .5]))
    t = (0.5 * 0.25 * 0.9) ** (1 / 3)
    cl = {r.node: r.clustering for r in graphs.clustering_weighted(e).collect()}
    assert cl[0] == pytest.approx(t) and cl[2] == pytest.approx(t / 3)
    assert cl[3] == cl[4] == cl[6] == 0.0


def test_laplacian_branches(spark):
    a = random_graph(6, 2)
    lap = np.diag(a.sum(axis=1)) - a
    d = np.sqrt(a.sum(axis=1))
    want = np.eye(6) - a / np.outer(d, d)
    bad = a.copy()
    bad[0, 1] = bad[1, 0] = -0.4
    clipped = np.clip(bad, 0, None)
    dc = np.sqrt(clipped.sum(axis=1))
    indefinite = np.diag(bad.sum(axis=1)) - bad
    lam, u = np.linalg.eigh(indefinite)
    psd = (u * np.clip(lam, 0, None)) @ u.T
    dp = np.sqrt(np.maximum(np.diag(psd), 1e-10))
    cases = {"adj": (a, want), "lap": (lap, want),
             "neg": (bad, np.eye(6) - clipped / np.outer(dc, dc)),
             "indef": (indefinite, (psd if lam.min() < -1e-6 else indefinite) / np.outer(dp, dp))}
    m = spark.createDataFrame([(k, i, j, float(x[0][i, j])) for k, x in cases.items()
                               for i in range(6) for j in range(6)],
                              "grp string, i int, j int, v double")
    out = {}
    for r in graphs.laplacian_normalised(m).collect():
        out.setdefault(r.grp, np.zeros((6, 6)))[r.i, r.j] = r.v
    for k, (_, w) in cases.items():
        np.testing.assert_allclose(out[k], w, atol=1e-12, err_msg=k)


def test_basis_is_orthonormal_and_rebuilds(spark):
    a = random_graph(6, 8)
    e = edges_frame(spark, {"s": a}).select("grp", "i", "j", "w")
    b = graphs.graph_fourier_basis(graphs.laplacian(e)).orderBy("mode").toPandas()
    u = np.stack(b.u)
    np.testing.assert_allclose(u @ u.T, np.eye(6), atol=1e-12)
    np.testing.assert_allclose((u.T * b["lambda"].to_numpy()) @ u,
                               np.diag(a.sum(axis=1)) - a, atol=1e-12)


def test_ranks_with_ties_and_picks(spark):
    rows = [(f"s{k}", "A", [0.9, 0.5, 0.5, 0.5, 0.1, 0.3, 0.2][k]) for k in range(7)]
    ranked = compare.rank_subjects(
        spark.createDataFrame(rows, "subject_id string, grp string, pearson_r double").repartition(5))
    assert [r.subject_id for r in ranked.orderBy("rank").collect()] == [
        "s0", "s1", "s2", "s3", "s5", "s6", "s4"]
    picks = {r.pick: r["rank"] for r in compare.example_picks(ranked).collect()}
    assert picks == {"best": 1, "upper_median": 3, "lower_median": 5, "worst": 7}


def test_consensus_validation_tables(spark):
    m = {s: random_graph(6, k) for k, s in enumerate("pqrs")}
    e = edges_frame(spark, m)
    out = cohort.consensus_validation(e, consensus.consensus_mean(e))
    assert {r["rank"] for r in out["ranked"].collect()} == {1, 2, 3, 4}
    assert all(0 <= r.pearson_p <= 1 for r in out["scores"].collect())
    assert sum(r.n for r in out["summary"].collect()) == 4
