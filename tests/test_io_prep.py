import numpy as np
import pytest
from conftest import signals_frame
from pyspark.sql import functions as F

from graphdyn.functions import scalars as fn
from graphdyn.operators import blocks, connectivity, moments, prep
from graphdyn.sources import readers, writers


def test_cohort_with_bad_rows(spark, tmp_path):
    good = tmp_path / "AD" / "s6_one_rs_eeg.csv"
    bad = tmp_path / "HC" / "two.csv"
    for f, body in ((good, "channel,t,value\n0,0,1.5\n1,0,NaN\n"),
                    (bad, "channel,t,value\n0,0,2.0\nx,y,oops\n")):
        f.parent.mkdir()
        f.write_text(body)
    signals, rejects = readers.read_cohort(spark, [str(good), str(bad)])
    rows = sorted((r.subject_id, r.grp, r.channel, r.value) for r in signals.collect())
    # a failed recording leaves the data as a whole
    assert rows == [("one", "AD", 0, 1.5), ("one", "AD", 1, 0.0)]
    r = rejects.collect()
    assert [(x.subject_id, x.status, x.detail_1) for x in r] == [("two", "FAILED", "bad_rows=1")]


def test_cohort_with_unreadable_and_short_files(spark, tmp_path):
    body = "channel,t,value\n" + "".join(f"0,{t},1.0\n" for t in range(5))
    for arm, name in (("AD", "whole"), ("AD", "cut"), ("HC", "broken")):
        (tmp_path / arm).mkdir(exist_ok=True)
        f = tmp_path / arm / (f"{name}.csv.gz" if name == "broken" else f"{name}.csv")
        f.write_bytes(b"not gzip at all" if name == "broken" else body.encode())
    paths = [str(p) for p in tmp_path.glob("*/*")]
    with pytest.raises(Exception, match="(?i)gzip"):
        readers.read_cohort(spark, paths)[0].count()
    want = spark.createDataFrame([("whole", 5), ("cut", 9), ("gone", 4)], "subject_id string, n_samples long")
    signals, rejects = readers.read_cohort(spark, paths, id_rule="stem", skip_unreadable=True, expected=want)
    assert {r.subject_id for r in signals.collect()} == {"whole"} and signals.count() == 5
    got = {r.subject_id: r.detail_1 for r in rejects.collect()}
    assert got.pop("cut") == "n_samples=5/9" and got.pop("gone") == "n_samples=0/4"
    assert list(got.values()) == ["unreadable"]


def test_stray_channels_are_an_error(spark):
    sig = spark.createDataFrame([("s", "A", 0, 0, 1.0), ("s", "A", 3, 0, 1.0)],
                                "subject_id string, grp string, channel int, t long, value double")
    for build in (lambda: blocks.dense_grid(sig, 3), lambda: connectivity.to_frames(sig, 3),
                  lambda: moments.recording_stats(sig, 3)):
        with pytest.raises(Exception, match="channel outside 0..2: 3"):
            build().collect()


def test_log_is_appended(spark, tmp_path):
    path = str(tmp_path / "log")
    row = spark.createDataFrame([("s", "A", "SUCCESS", "Completed", "", "", "")],
                                readers.QC_LOG)
    writers.append_qc_log(path, row)
    writers.append_qc_log(path, row, row)
    assert readers.read_qc_log(spark, path).count() == 3
    for _ in range(2):
        writers.append_qc_log(path, row, row, run="nightly")
    assert readers.read_qc_log(spark, path).count() == 5
    writers.append_qc_log(path, row, run="nightly")
    assert readers.read_qc_log(spark, path).count() == 4


def test_path_rules(spark):
    df = spark.createDataFrame([("/d/AD/s6_x1_rs-hep_eeg.set",), ("/d/hc/sub-07/eeg/a.b.set",),
                                ("plain",)], "path string")
    got = df.select(*[fn.subject_id_from_path("path", r) for r in ("strip", "bids", "stem")],
                    fn.group_from_path("path")).collect()
    assert [tuple(r) for r in got] == [
        ("x1", "s6_x1_rs-hep_eeg", "s6_x1_rs-hep_eeg", "AD"), ("a.b", "sub-07", "a.b", None),
        ("plain", "plain", "plain", None)]


def test_resolve_sparsity():
    assert fn.resolve_sparsity(None) is None
    assert fn.resolve_sparsity(" Subject_Mean ", 0.2) == 0.2
    for bad in ("nope", 0, 1.2):
        with pytest.raises(ValueError):
            fn.resolve_sparsity(bad, 0.2)


def test_windows_keep_full_ones_only(spark):
    x = {("s", "A"): np.arange(23.0)[None], ("short", "A"): np.arange(9.0)[None]}
    w = prep.sliding_windows(signals_frame(spark, x), 10, 4).groupBy("subject_id", "window_idx") \
        .agg(F.min("t").alias("lo"), F.max("t").alias("hi")).orderBy("window_idx").collect()
    assert [(r.subject_id, r.lo, r.hi) for r in w] == [
        ("s", 0, 9), ("s", 4, 13), ("s", 8, 17), ("s", 12, 21)]


def test_filter_across_pane_borders(spark):
    x = np.random.default_rng(0).normal(size=(2, 100))
    taps = prep.bandpass_taps(1, 20, 100, 7)
    out = blocks.to_rows(blocks.prepare(signals_frame(spark, {("s", "A"): x}), 2, taps=taps, size=16))
    rows = out.orderBy("channel", "t").collect()
    want = np.stack([np.convolve(r, taps, mode="same") for r in x])
    np.testing.assert_allclose([r.value for r in rows], want.ravel(), atol=1e-12)


def test_lags_across_pane_borders_on_sparse_rows(spark):
    x = {("s", "A"): np.arange(40.0)[None]}
    rows = prep.lagged(signals_frame(spark, x, {("s", 0, 15), ("s", 0, 20)}), 2, pane=8) \
        .orderBy("t").collect()
    got = {r.t: (r.lag_1, r.lag_2) for r in rows}
    assert len(got) == 38 and got[16] == (None, 14.0) and got[24] == (23.0, 22.0)
    assert got[0] == (None, None) and got[21] == (None, 19.0)


def test_dense_grid_and_shift(spark):
    x = {("s", "A"): np.ones((2, 50))}
    sig = signals_frame(spark, x, {("s", 1, t) for t in range(10, 40)})
    dense = blocks.prepare(sig, 3, size=16)
    assert blocks.to_rows(dense).agg(F.count("*"), F.sum("value")).first() == (150, 70.0)
    s = blocks.to_rows(blocks.circular_shift(dense, 2, blocks.hashed_shift(), size=16), "surrogate")
    assert s.groupBy("surrogate", "channel").agg(F.count_distinct("t").alias("n")) \
        .filter("n <> 50").count() == 0


def test_chain_of_block_steps_matches_whole_recordings(spark):
    """Fill, reference, z-score, long filter and shift against numpy on whole recordings, gaps of whole blocks included."""
    rng = np.random.default_rng(8)
    recs = {("s", "A"): 1e6 + rng.normal(size=(3, 300)), ("t", "B"): rng.normal(size=(3, 47))}
    drop = {("s", c, t) for c in range(3) for t in range(64, 140)} | {("t", 1, 5)}
    sig = signals_frame(spark, recs, drop)
    taps = prep.bandpass_taps(1, 20, 100, 45)
    for ref, cols in (("average", [0, 1, 2]), ([0, 2], [0, 2])):
        made = blocks.prepare(sig, 3, reference=ref, standardise=True, taps=taps, size=32)
        out = blocks.circular_shift(made, 2, lambda s, c: 7 * c + 11 * s, size=32)
        got = {(r.subject_id, r.surrogate, r.channel, r.t): r.value for r in blocks.to_rows(out, "surrogate").collect()}
        assert len(got) == 2 * 3 * 347
        for (name, _), x in recs.items():
            x = x.copy()
            for s, c, t in drop:
                if s == name:
                    x[c, t] = 0.0
            x = x - x[cols].mean(axis=0)
            x = np.clip((x - x.mean(axis=1)[:, None]) / np.maximum(x.std(axis=1), 1e-8)[:, None], -10, 10)
            half = len(taps) // 2
            want = np.stack([np.convolve(np.pad(r, half), taps, mode="valid") for r in x])
            for s in (1, 2):
                for c in range(3):
                    mine = [got[name, s, c, t] for t in range(x.shape[1])]
                    np.testing.assert_allclose(mine, np.roll(want[c], 7 * c + 11 * s), atol=1e-8)


def test_preparation_gathers_the_samples_once(spark):
    sig = signals_frame(spark, {("s", "A"): np.random.default_rng(1).normal(size=(2, 50))})
    plan = blocks.prepare(sig, 2, reference="average", standardise=True)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "channel" not in line]
    assert plan.count("FlatMapCoGroupsInPandas") >= 2 and moved
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = blocks.prepare(sig, 2, reference="average", standardise=True)._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in plan
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_overlap_save_equals_the_direct_sum():
    rng = np.random.default_rng(3)
    taps = np.asarray(prep.bandpass_taps(0.5, 40, 256, 330))
    assert len(taps) == 661
    x = rng.normal(size=(3, 4096 + 660))
    np.testing.assert_allclose(blocks.filtered(x, taps), [np.convolve(r, taps, mode="valid") for r in x], atol=1e-11)


def test_unknown_reference_is_refused():
    with pytest.raises(ValueError):
        blocks.referenced(np.zeros((2, 3)), "median")


@pytest.mark.parametrize("old, new", [(100, 64), (64, 100), (250, 125)])
def test_resampling_keeps_low_and_drops_high_frequencies(spark, old, new):
    """Sines below the new Nyquist frequency keep their phase, those above vanish; blocks leave no seams."""
    n = 6 * old
    t = np.arange(n) / old
    low, high = 0.3 * min(old, new), 0.5 * (new / 2 + old / 2)
    x = np.stack([np.sin(2 * np.pi * low * t), np.sin(2 * np.pi * (high if new < old else low) * t), np.ones(n)])
    for size in (64, 4096):
        out = blocks.resample(signals_frame(spark, {("s", "A"): x}), 3, old, new, size=size)
        rows = blocks.to_rows(out).orderBy("channel", "t").collect()
        y = np.array([r.value for r in rows]).reshape(3, -1)
        assert y.shape[1] == -(-n * new // old) and [r.t for r in rows[:3]] == [0, 1, 2]
        at, edge = np.arange(y.shape[1]) / new, max(3 * new // 4, 20)
        inner = slice(edge, -edge)
        np.testing.assert_allclose(y[0, inner], np.sin(2 * np.pi * low * at)[inner], atol=5e-3)
        np.testing.assert_allclose(y[2, inner], 1.0, atol=2e-3)
        if new < old:
            assert np.abs(y[1, inner]).max() < 5e-3
