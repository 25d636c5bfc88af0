"""What larger tables bring about: graphs without a kept edge, many blocks in a task."""

import numpy as np
import pandas as pd

import __spark_entry__ as entry
from graphdyn.operators import connectivity


def test_jaccard_of_two_empty_edge_sets_is_null_as_in_sql(spark, tmp_path):
    """Many independent vectors per label leave no correlation above 0.1."""
    import duckdb
    rng = np.random.default_rng(2)
    n = 12_000
    pd.DataFrame({"vec_id": range(n), "embedding": list(rng.normal(size=(n, 64)).astype(np.float32)),
                  "label": np.arange(n, dtype=np.int32) % 2}).to_parquet(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    want = {(r, s): j for j, r, s in con.execute(
        f"select jaccard, rule, subject_id from ({entry.oracle_sql()['jaccard_rules']})").fetchall()}
    got = {(r.rule, r.subject_id): r.jaccard for r in entry.queries()["jaccard_rules"](spark, str(tmp_path)).collect()}
    assert got == want and want["value", "0"] is None


def test_cells_of_a_block_reach_python_as_arrays_in_bounded_batches(spark, monkeypatch):
    """A batch holds a few blocks' numbers, no object per cell, however many blocks a task has."""
    seen = []

    def look(self, run, schema):
        seen.append((dict(self.dtypes), self.sparkSession.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")))
        return plain(self, run, schema)

    sig = spark.range(50_000).selectExpr("'a' as subject_id", "'A' as grp", "cast(id % 2 as int) as channel",
                                         "id div 2 as t", "sin(id) as value")
    kind = type(sig)
    plain = kind.mapInPandas
    monkeypatch.setattr(kind, "mapInPandas", look)
    edge = connectivity.pearson_edges(connectivity.to_frames(sig, 2), absolute=False).first()
    x = np.sin(np.arange(50_000)).reshape(-1, 2)
    assert abs(edge.w - np.corrcoef(x.T)[0, 1]) < 1e-9
    types, limit = seen[0]
    assert not any("struct" in t for t in types.values())
    assert int(limit.rstrip("b")) <= 8 << 20
