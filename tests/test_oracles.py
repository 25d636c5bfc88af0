"""A cross-section of the registered queries against DuckDB on small tables."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"
TABLES = ("lineitem", "supplier", "events", "documents", "embeddings")
PICK = ("consensus_direct", "consensus_binarize", "distance_consensus_match_subject",
        "consensus_by_subgroup", "connected_components", "small_world_index",
        "subject_vs_consensus", "jaccard_rules", "dense_grid", "graph_var_moments", "fit_tv",
        "model_grid", "compare_tf", "tf_marginals", "band_stats", "fdr_bh", "append_qc_log")


def _sorted(rows):
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
@pytest.mark.parametrize("name", PICK)
def test_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    want = [tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()]
    assert len(got) > 0 and len(got) == len(want)
    for g, w in zip(_sorted(got), _sorted(want)):
        assert g == pytest.approx(w, abs=2e-6) if all(
            isinstance(x, (int, float)) for x in g + w) else g == w


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
