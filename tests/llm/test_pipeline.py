"""The pipeline's stages against a plain run of the same decisions."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_brute as brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from graphdyn.session import cut_lineage  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="tables not present")
def test_stages_match_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame(
        [(90001, None, None, None, None), (90002, "12 34", "en", "s", 5), (90003, "", "fr", None, 0)], docs.schema))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(cut_lineage(stage(spark, frames[-1], SF)))
    assert all(f.columns == docs.columns for f in frames[:-1])
    rows = [[(r.doc_id, r.text) for r in f.collect()] for f in frames]
    letters = {(d, t) for d, t in rows[0] if any(c.isalpha() for c in t or "")}
    assert set(rows[1]) == letters
    component = brute.jaccard_components(set(rows[1]))
    assert sorted(d for d, _ in rows[2]) == sorted({c for _, c in component.values()})
    hit = {d for d, _ in brute.contaminated(rows[2], items)}
    assert hit and {d for d, _ in rows[3]} == {d for d, _ in rows[2]} - hit
    assert set(rows[4]) <= set(rows[3]) and max(rows[4].count(r) for r in rows[4]) <= 3
    assert sorted(rows[5], key=str) == sorted(rows[4], key=str)
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_text_stages_send_small_batches_to_workers(spark, monkeypatch):
    """Language ID and the Jaccard join hold several copies of a batch's text at once."""
    from graphdyn.llm import jaccard, language
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    docs = spark.createDataFrame([(i, f"some words of text number {i} in a row", "en", "s") for i in range(20)],
                                 "doc_id long, text string, lang string, source string")
    held = spark.conf.get(name)
    try:
        for stage in (lambda: language.accept(docs, language.fit(docs, "text", "lang", "doc_id")),
                      lambda: jaccard.dedup(docs)):
            spark.conf.set(name, str(8 << 20))
            assert stage().count() > 0
            assert int(spark.conf.get(name).rstrip("b")) <= 2 << 20
    finally:
        spark.conf.set(name, held)
    assert jaccard.PACK <= 2 << 20


def test_language_table_takes_a_byte_a_row_for_few_languages():
    import numpy as np
    from graphdyn.llm import language
    rng = np.random.default_rng(1)
    gram, lang = rng.integers(0, 2 ** 63, 3000).astype(np.uint64), rng.integers(0, 4, 3000)
    f = language.Filter(["a", "b", "c", "d"], gram, lang)
    assert f.table.nbytes == 1 << f.bits
    mask = f.contained(gram)[0]
    assert ((mask >> lang.astype(np.uint8)) & 1).all()
