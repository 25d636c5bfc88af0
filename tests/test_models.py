import brute
import numpy as np
import pytest
from conftest import signals_frame
from pyspark.sql import functions as F

from graphdyn.operators import graph_var, moments, surrogate, transfer
from graphdyn.plans import cohort
from graphdyn.schema import PRESETS, Preset


@pytest.fixture(scope="module")
def recordings(ring_lap):
    rng = np.random.default_rng(3)
    out = {}
    for s, t in (("a", 333), ("b", 260), ("c", 200)):
        x = rng.normal(size=(6, t))
        for k in range(2, t):
            x[:, k] += 0.4 * x[:, k - 1] - 0.2 * ring_lap @ x[:, k - 1] + 0.1 * x[:, k - 2]
        out[(s, "A" if s == "a" else "B")] = x + 5.0
    return out


# step 33 and length 99 put panes of 33; 20 / 30 gives panes of 10 below P = 12
@pytest.mark.parametrize("P,K,length,step", [(3, 2, 99, 33), (12, 1, 80, 30), (10, 1, 60, 20)])
def test_windows_and_whole_recording_match_direct_fit(spark, recordings, basis, ring_lap,
                                                      P, K, length, step):
    models = cohort.fit_cohort(signals_frame(spark, recordings), basis, 6, length=length,
                               step=step, P=P, K=K)
    got = {(r.subject_id, r.window_idx): r for r in models.collect()}
    want = 0
    for (s, _), x in recordings.items():
        z = brute.zscore(x)
        spans = [(-1, z)] + [(w, z[:, w * step:w * step + length])
                             for w in range((z.shape[1] - length) // step + 1)]
        for w, part in spans:
            h = brute.fit(part, ring_lap, P, K)
            r = got[(s, w)]
            want += 1
            np.testing.assert_allclose(r.h, h, rtol=1e-7, atol=1e-9)
            assert r.rho == pytest.approx(brute.radius(h, ring_lap, P, K), rel=1e-6)
            np.testing.assert_allclose((r.rss, r.r2, r.mse, r.bic),
                                       brute.score(h, part, ring_lap, P, K), rtol=1e-7)
    assert len(got) == want


def test_gaps_count_as_zero_before_scaling(spark, recordings, basis, ring_lap):
    rng = np.random.default_rng(0)
    drop = {("b", int(c), int(t)) for c, t in zip(rng.integers(0, 6, 300), rng.integers(0, 259, 300))}
    drop |= {("b", c, t) for c in range(6) for t in range(90, 135)}  # whole panes missing
    x = recordings[("b", "B")].copy()
    for _, c, t in drop:
        x[c, t] = 0.0
    sig = signals_frame(spark, {("b", "B"): recordings[("b", "B")]}, drop)
    m = cohort.fit_cohort(sig, basis, 6, length=40, step=20, P=2, K=1)
    rows = {r.window_idx: r for r in m.collect()}
    z = brute.zscore(x)
    np.testing.assert_allclose(rows[-1].h, brute.fit(z, ring_lap, 2, 1), rtol=1e-7)
    # a window that holds no sample at all is still fitted on its scaled zeros
    for w in (0, 4, 5, 10):
        part = z[:, w * 20:w * 20 + 40]
        np.testing.assert_allclose(rows[w].h, brute.fit(part, ring_lap, 2, 1), rtol=1e-6, atol=1e-9)


@pytest.mark.parametrize("scaling", ["train", "reference"])
def test_grid_and_selection(spark, recordings, basis, ring_lap, scaling):
    grid = graph_var.model_grid(signals_frame(spark, recordings), basis, 6, (1, 2, 4), (0, 1, 2),
                            val_scaling=scaling, pane=40)
    got = {(r.subject_id, r.P, r.K): r for r in grid.collect()}
    best = {}
    for (s, _), x in recordings.items():
        t = x.shape[1]
        raw = x[:, :int(0.70 * t)]
        train = brute.zscore(raw)
        val = brute.zscore(x[:, int(0.70 * t):int(0.85 * t)],
                           raw if scaling == "train" else train)
        for k in (0, 1, 2):
            for p in (1, 2, 4):
                h = brute.fit(train, ring_lap, p, k)
                bic = brute.score(h, val, ring_lap, p, k)[3]
                assert got[(s, p, k)].bic == pytest.approx(bic, rel=1e-7)
                if got[(s, p, k)].stable and bic < best.get(s, (np.inf,))[0]:
                    best[s] = (bic, p, k)
    for r in graph_var.select_model(grid).collect():
        assert (r.P, r.K) == best[r.subject_id][1:]


def test_published_grid_matches_direct_fits(spark, recordings, basis, ring_lap):
    """All 100 cells: coefficients, stability and scores, and normal equations that hold."""
    full = PRESETS["qc"]
    some = {k: v for k, v in recordings.items() if k[0] in "ab"}
    grid = graph_var.model_grid(signals_frame(spark, some), basis, 6, full.p_grid, full.k_grid, pane=50)
    got = {(r.subject_id, r.P, r.K): r for r in grid.collect()}
    assert len(got) == 200 and max(r.residual for r in got.values()) < 1e-9
    for (s, _), x in some.items():
        t = x.shape[1]
        train = brute.zscore(x[:, :int(0.70 * t)])
        val = brute.zscore(x[:, int(0.70 * t):int(0.85 * t)], x[:, :int(0.70 * t)])
        for p in full.p_grid:
            for k in full.k_grid:
                r, h = got[s, p, k], brute.fit(train, ring_lap, p, k)
                np.testing.assert_allclose(r.h, h, rtol=1e-5, atol=1e-7)
                assert r.rho == pytest.approx(brute.radius(h, ring_lap, p, k), rel=1e-4)
                assert (r.rss, r.bic) == pytest.approx((brute.score(h, val, ring_lap, p, k)[0],
                                                        brute.score(h, val, ring_lap, p, k)[3]), rel=1e-5)


def test_nested_fit_equals_separate_solves():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3, 400, 4))
    lam = np.array([0.0, 0.4, 1.1, 1.9])
    lags = np.stack([x[:, 6 - p:400 - p] for p in range(7)], axis=1)            # batch, p, t, mode
    a = np.stack([np.einsum("bptm,bqtm,m->bpq", lags, lags, lam ** j) for j in range(7)], axis=1)
    m = graph_var.LagMoments(a.reshape(3, -1), 6, [394 * 4] * 3, x[:, 6:].sum(axis=(1, 2)))
    for k, h in graph_var.fit_nested(m, 6, (0, 1, 3)).items():
        np.testing.assert_allclose(h, graph_var.fit_coefficients(m, 6, k), rtol=1e-8, atol=1e-10)
        assert graph_var.normal_residual(m, h, 6, k).max() < 1e-10


def test_grid_keeps_failed_cells_and_falls_back(spark, basis):
    x = np.random.default_rng(1).normal(size=(6, 12))
    grid = graph_var.model_grid(signals_frame(spark, {("s", "A"): x}), basis, 6, (9, 20), (1,))
    assert [(r.P, r.success, r.stable) for r in grid.orderBy("P").collect()] == [
        (9, False, False), (20, False, False)]
    r = graph_var.select_model(grid, (5, 1)).first()
    assert (r.P, r.K, r.is_fallback, r.best_bic) == (5, 1, True, None)


def test_tie_prefers_small_k_then_small_p(spark):
    rows = [("s", "A", 2, 1, 1.0, True), ("s", "A", 3, 0, 1.0, True), ("s", "A", 4, 0, 1.0, True),
            ("s", "A", 1, 0, 0.5, False)]
    grid = spark.createDataFrame(rows, "subject_id string, grp string, P int, K int, bic double,"
                                       " stable boolean")
    r = graph_var.select_model(grid).first()
    assert (r.P, r.K) == (3, 0)


def test_features_and_fourier_transform(spark, recordings, basis, ring_lap):
    sig = signals_frame(spark, recordings)
    stats = moments.recording_stats(sig, 6)
    rows = moments.graph_var_features(sig, basis, 6, 3, 2, pane=50, stats=stats) \
        .filter("subject_id = 'b'").orderBy("t", "channel").collect()
    r, y = brute.design(brute.zscore(recordings[("b", "B")]), ring_lap, 3, 2)
    np.testing.assert_allclose([x.f for x in rows], r, atol=1e-9)
    np.testing.assert_allclose([x.y for x in rows], y, atol=1e-9)
    s = moments.graph_fourier_transform(sig, basis, 6, pane=64).groupBy("subject_id").agg(
        F.sum(F.col("s") ** 2).alias("e")).collect()
    energy = {k[0]: (x ** 2).sum() for k, x in recordings.items()}
    assert {x.subject_id: pytest.approx(x.e) for x in s} == energy


def test_surrogate_null_equals_rolled_recordings(spark, recordings, basis, ring_lap):
    P, K, length, step, n_surr = 2, 1, 60, 30, 4
    sig = signals_frame(spark, recordings)
    stats = moments.recording_stats(sig, 6)
    shifts = {(r.subject_id, r.surrogate, r.channel): r.s for r in spark.sql(
        "select explode(sequence(1, 4)) as surrogate").join(
        sig.select("subject_id", "channel").distinct()).join(
        stats.select("subject_id", "n_samples"), "subject_id").selectExpr(
        "*", "pmod(xxhash64(7, surrogate, subject_id, channel), n_samples) as s").collect()}
    null = surrogate.surrogate_null(sig, basis, 6, P=P, K=K, length=length, step=step, seed=7,
                                    n_surrogates=n_surr, min_windows=1, n_omega=16)
    got = {(r.subject_id, r.surrogate): r.global_msd for r in null.collect()}
    lam = np.linalg.eigvalsh(ring_lap)
    assert len(got) == n_surr * len(recordings)
    for (s, _), x in recordings.items():
        z = brute.zscore(x)
        for k in range(1, n_surr + 1):
            rolled = np.stack([np.roll(z[c], shifts[(s, k, c)]) for c in range(6)])
            base = brute.gain(brute.fit(rolled, ring_lap, P, K), lam, P, K, 16)
            msd = []
            for w in range((x.shape[1] - length) // step + 1):
                h = brute.fit(rolled[:, w * step:w * step + length], ring_lap, P, K)
                if brute.radius(h, ring_lap, P, K) < 0.99:
                    msd.append(((brute.gain(h, lam, P, K, 16) - base) ** 2).mean())
            assert got[(s, k)] == pytest.approx(np.mean(msd), rel=1e-6)


def test_surrogate_chunks_smaller_than_panes(spark, recordings, basis):
    sig = signals_frame(spark, recordings)
    stats = moments.recording_stats(sig, 6)

    def cells(chunk):
        b = surrogate.surrogate_blocks(sig, stats, 6, 3, 30, 2, size=chunk)
        out = {}
        for r in b.collect():
            m = out.setdefault((r.subject_id, r.surrogate, r.pane), np.full((6, 32), np.nan))
            for p in r.cells:
                m[p.c, p.o:p.o + len(p.v)] = p.v
        return out

    one, two = cells(17), cells(4096)
    assert one.keys() == two.keys()
    for k in one:
        np.testing.assert_allclose(one[k], two[k])


def test_guards(spark, basis):
    """A unit root at omega = 0, lambda = 0 is handled by each guard in its own way."""
    m = spark.createDataFrame([("s", "A", "lti", -1, 1, 0, [1.0])],
                              "subject_id string, grp string, scope string, window_idx long,"
                              " P int, K int, h array<double>")
    top = {}
    for g in ("add", "rescale", "fail"):
        tf = transfer.transfer_function(m, basis, n_omega=8, guard=g, p_max=3)
        top[g] = tf.agg(F.max("mag"), F.count("*")).first()
    assert top["add"][0] == pytest.approx(1000.0)
    assert top["rescale"][1] == 48
    assert top["fail"][1] == 0


def _planted(ring_lap, varying, seed=42):
    rng = np.random.default_rng(seed)
    n, t = 6, 3000
    x = np.zeros((n, t))
    for k in range(1, t):
        a = 0.3 if not varying else 0.3 + 0.45 * np.sin(2 * np.pi * (k // 1000) / 3)
        x[:, k] = a * x[:, k - 1] - 0.1 * ring_lap @ x[:, k - 1] + 0.1 * rng.normal(size=n)
    return x


def test_planted_dynamics(spark, basis, ring_lap):
    sig = signals_frame(spark, {("still", "A"): _planted(ring_lap, False),
                                ("moving", "B"): _planted(ring_lap, True)})
    pre = Preset((1,), (1,), 1.0, 1.0, 0.99, (1, 1), "add", 16, 5)
    rows = {r.subject_id: r for r in cohort.subject_test(
        sig, basis, 6, length=500, step=250, preset=pre, P=1, K=1, n_surrogates=60).collect()}
    assert rows["moving"].is_time_varying and rows["moving"].p_value_msd < 0.05
    assert rows["moving"].global_msd > 10 * rows["still"].global_msd
    assert rows["still"].p_value_msd > 0.05


def test_qc_gate_order(spark):
    base = dict(loaded=True, n_channels=6, expected_channels=6, selected=True, lti_rho=0.5,
                lti_r2=0.9, tv_fitted=True, n_windows=12, tf_ok=True)
    cases = [({}, "Completed"), ({"loaded": False}, "EEG_loading_error"),
             ({"n_channels": 5, "selected": False}, "Channel_mismatch"),
             ({"selected": None}, "Model_selection_error"), ({"lti_rho": None}, "LTI_fitting_error"),
             ({"lti_rho": 0.95, "lti_r2": 0.1}, "LTI_unstable"), ({"lti_r2": 0.49}, "Low_R2"),
             ({"tv_fitted": None}, "TV_fitting_error"),
             ({"n_windows": 9, "tf_ok": False}, "Too_few_stable_windows"),
             ({"n_windows": None}, "Too_few_stable_windows"),
             ({"tf_ok": False}, "Transfer_function_error")]
    cols = list(base)
    rows = [(f"s{k:02}", "A", *[{**base, **c}[x] for x in cols]) for k, (c, _) in enumerate(cases)]
    facts = spark.createDataFrame(rows, "subject_id string, grp string, loaded boolean,"
                                  " n_channels int, expected_channels int, selected boolean,"
                                  " lti_rho double, lti_r2 double, tv_fitted boolean,"
                                  " n_windows int, tf_ok boolean")
    log = cohort.qc_gate(facts).orderBy("subject_id").collect()
    assert [r.reason for r in log] == [c[1] for c in cases]
    assert log[0].status == "SUCCESS" and log[0].detail_3 == "n_win=12"
    assert log[6].detail_1 == "R2=0.4900"


def test_surrogate_null_takes_selected_orders(spark, recordings, basis):
    """Orders per subject give the same null as a run with that subject's fixed orders."""
    sig = signals_frame(spark, recordings)
    subjects = sorted(s for s, _ in recordings)
    chosen = {s: (1 + i % 2, i % 2) for i, s in enumerate(subjects)}
    orders = spark.createDataFrame([(s, *pk) for s, pk in chosen.items()], "subject_id string, P int, K int")
    common = dict(length=60, step=30, n_surrogates=3, min_windows=1, n_omega=16,
                  shift=lambda s, c: 17 * s + 5 * c)
    null = surrogate.surrogate_null(sig, basis, 6, orders=orders, p_max=2, k_max=1, **common)
    got = {(r.subject_id, r.surrogate): r.global_msd for r in null.collect()}
    for P, K in set(chosen.values()):
        fixed = surrogate.surrogate_null(sig, basis, 6, P=P, K=K, **common)
        for r in fixed.collect():
            if chosen[r.subject_id] == (P, K):
                assert got.pop((r.subject_id, r.surrogate)) == pytest.approx(r.global_msd)
    assert not got
    with pytest.raises(ValueError):
        surrogate.surrogate_null(sig, basis, 6, P=1, **common)


def test_subject_test_selects_and_tests(spark, recordings, basis):
    """Order selection and the surrogate test in one analysis."""
    from dataclasses import replace

    from graphdyn.plans import cohort
    from graphdyn.schema import PRESETS
    preset = replace(PRESETS["subject"], p_grid=(1, 2), k_grid=(0, 1), fallback=(2, 1), min_windows=2)
    out = cohort.subject_test(signals_frame(spark, recordings), basis, 6, length=60, step=30,
                              preset=preset, n_surrogates=3, n_omega=16)
    rows = out.collect()
    assert len(rows) > 0 and {(r.P, r.K) for r in rows} <= {(p, k) for p in (1, 2) for k in (0, 1)}


@pytest.mark.parametrize("length, step", [(61, 30), (60, 60), (70, 1), (55, 23)])
def test_window_moments_for_any_length_and_step(spark, recordings, basis, ring_lap, length, step, monkeypatch):
    """Windows that share no pane give the same models as direct fits, over several blocks."""
    monkeypatch.setattr(moments, "BLOCK", 64)
    P, K = 2, 1
    got = moments.graph_var_moments(signals_frame(spark, recordings), basis, 6, orders=F.array(F.lit(P)),
                                    k_max=K, p_max=P, length=length, step=step)
    models = graph_var.fit_models(got.withColumn("K", F.lit(K)), basis)
    fits = {(r.subject_id, r.window_idx): r.h for r in models.filter("scope = 'tv'").collect()}
    total = 0
    for (s, _), x in recordings.items():
        z = brute.zscore(x)
        for w in range((x.shape[1] - length) // step + 1):
            total += 1
            if w % 7 == 0:
                want = brute.fit(z[:, w * step:w * step + length], ring_lap, P, K)
                assert fits[(s, w)] == pytest.approx(np.ravel(want), rel=1e-5, abs=1e-7)
    assert len(fits) == total


def test_failed_recordings_reach_the_log(spark, recordings, basis):
    """Unloadable recordings and stray channels are rows of the log and leave the statistics."""
    pre = Preset((1, 2), (0, 1), 1.0, 1.0, 0.99, (2, 1), "none", 16, 2, -1.0)
    sig = signals_frame(spark, recordings)
    stray = sig.limit(1).selectExpr("'odd' as subject_id", "grp", "9 as channel", "t", "value")
    rejects = spark.createDataFrame([("gone", "A", "FAILED", "EEG_loading_error", "unreadable", "", "")],
                                    "subject_id string, grp string, status string, reason string,"
                                    " detail_1 string, detail_2 string, detail_3 string")
    out = cohort.qc_cohort(sig.unionByName(stray), basis, 6, length=60, step=30, preset=pre, rejects=rejects)
    log = {r.subject_id: r.reason for r in out["log"].collect()}
    assert log.pop("gone") == "EEG_loading_error" and log.pop("odd") == "Channel_mismatch"
    assert set(log) == {s for s, _ in recordings}
    assert {r.metric for r in out["qc_stats"].collect()} <= set(cohort.QC_METRICS)
    assert {"gone", "odd"}.isdisjoint(r.subject_id for r in out["summary"].collect())


def test_clear_steps_removes_intermediates(spark):
    import os

    from graphdyn import session
    session.clear_steps(spark)
    session.cut_lineage(spark.range(3))
    path = session._STEPS[-1].removeprefix("file:")
    assert os.path.isdir(path) and session.clear_steps(spark) == 1 and not os.path.exists(path)



def test_powers_along_edges_equal_the_spectral_form(spark, recordings, basis, ring_lap):
    cells = [("g", i, j, float(ring_lap[i, j])) for i in range(6) for j in range(6)]
    packed = moments.packed_laplacian(spark.createDataFrame(cells, "grp string, i int, j int, v double"))
    sig = signals_frame(spark, recordings)
    how = dict(orders=F.array(F.lit(2), F.lit(4)), k_max=3, p_max=4, length=60, step=25)
    rows = [{(r.subject_id, r.window_idx, r.P): np.array(r.a) for r in moments.graph_var_moments(
        sig, b, 6, **how).collect()} for b in (basis, packed)]
    assert rows[0].keys() == rows[1].keys()
    for k, a in rows[0].items():
        np.testing.assert_allclose(rows[1][k], a, rtol=1e-9, atol=1e-9 * np.abs(a).max())
    f = [{(r.subject_id, r.t, r.channel): np.array(r.f) for r in moments.graph_var_features(
        sig, b, 6, 2, 3).collect()} for b in (basis, packed)]
    assert all(np.allclose(f[1][k], v, atol=1e-9) for k, v in f[0].items()) and f[0].keys() == f[1].keys()
