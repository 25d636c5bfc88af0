"""Document fingerprints against exact similarities and a plain run of the edits."""

import hashlib
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_brute as brute  # noqa: E402
from graphdyn.llm import fingerprint  # noqa: E402

SCHEMA = "doc_id long, text string"
RNG = random.Random(11)


def prose(n):
    return " ".join("".join(RNG.choice("abcdefgéü") for _ in range(RNG.randint(2, 7))) for _ in range(n))


def edits(docs):
    """{key: (n_chars, digest, edited, next)} in order of the keys."""
    order, out = sorted(((k, t or "") for k, t in docs), key=lambda r: (r[0] is not None, r[0] or 0)), {}
    for i, (k, t) in enumerate(order):
        n = order[(i + 1) % len(order)][1]
        e = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        out[k] = (len(t), hashlib.sha256(e.encode()).hexdigest(), e, n)
    return out


def exact(a, b):
    x, y = brute.shingles(a), brute.shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("parts", [1, 7])
def test_edit_report(spark, parts, monkeypatch):
    monkeypatch.setattr(fingerprint, "BATCH_BYTES", 2000, raising=False)
    base = prose(400)
    docs = [(i * 3 - 20, prose(RNG.randint(1, 300))) for i in range(60)]
    docs += [(500, base), (501, base), (502, base[: len(base) // 2] + prose(200)), (503, ""), (504, " \t "),
             (505, None), (506, "one two"), (507, "one two"), (508, "Ünï 😀😀 c" * 30), (510, prose(20_000)), (None, prose(90))]
    df = spark.createDataFrame(docs, SCHEMA).repartition(parts)
    got = {r.doc_id: r for r in fingerprint.edit_report(df).collect()}
    want, texts = edits(docs), dict(docs)
    assert set(got) == set(want)
    for k, (n, digest, e, nxt) in want.items():
        r, text = got[k], texts[k] or ""
        assert (r.n_chars, r.edited_sha256) == (n, digest)
        assert r.near_edited == pytest.approx(exact(text, e), abs=0.13)
        assert r.near_next == pytest.approx(exact(text, nxt), abs=0.13)
        assert len(r.fingerprint) in (0, 512)
    assert got[500].fingerprint == got[501].fingerprint and got[500].near_next == 1.0
    assert got[503].fingerprint == got[504].fingerprint == got[505].fingerprint == ""
    assert got[503].near_next == 1.0 and got[505].near_next == 0.0 and got[506].near_next == 1.0


def test_edit_report_small_tables(spark):
    one = spark.createDataFrame([(4, "a b c d")], SCHEMA)
    r, = fingerprint.edit_report(one).collect()
    assert r.edited_sha256 == hashlib.sha256(b"a b a b").hexdigest() and r.near_next == 1.0
    assert fingerprint.edit_report(one.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c d"), (None, None)], SCHEMA)
    assert fingerprint.edit_report(twice).count() == 4


def test_ranges_hold_every_row_once_and_its_next(spark):
    docs = [(i % 40 if i % 3 else 7, f"t {i % 9}") for i in range(600)]
    laid = fingerprint.laid_out(spark.createDataFrame(docs, SCHEMA).repartition(6), "text", "doc_id")
    rows = [(r.k, bytes(r.name)) for r in laid.filter(~F.col("border")).collect()]
    assert len(rows) == 600
    slots = {}
    for r in laid.collect():
        slots.setdefault(r.slot, []).append((r.border, r.k, bytes(r.name)))
    least = {s: min(x for x in v if not x[0])[1:] for s, v in slots.items()}
    order = sorted(slots)
    for s, after in zip(order, order[1:] + order[:1]):
        assert {x[1:] for x in slots[s] if x[0]} == {least[after]}


def test_fingerprints_and_likeness_column(spark):
    base = prose(300)
    docs = [(1, base), (2, base + " " + prose(100)), (3, prose(300)), (4, ""), (5, base.upper().replace("É", "é").replace("Ü", "ü"))]
    df = spark.createDataFrame(docs, SCHEMA).withColumn("fingerprint", F.lit("x"))
    name, = fingerprint.added(df)
    prints = fingerprint.fingerprints(df, keep=("doc_id",)).cache()
    pairs = prints.alias("a").join(prints.alias("b"), F.col("a.doc_id") < F.col("b.doc_id")).select(
        F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"),
        fingerprint.likeness(F.col(f"a.{name}"), F.col(f"b.{name}")).alias("near"))
    texts = dict(docs)
    for r in pairs.collect():
        assert r.near == pytest.approx(exact(texts[r.x], texts[r.y]), abs=0.1)


def test_estimates_are_unbiased_for_sparse_sets():
    """Sets of very different fill, so that densification decides most bins."""
    rng = np.random.default_rng(4)
    sketcher = fingerprint.Sketcher()
    for n, shared in ((6, 3), (40, 30), (300, 150), (3000, 2700)):
        found = []
        for _ in range(60):
            both = np.unique(rng.integers(0, 1 << 63, 2 * n - shared, dtype=np.uint64) * np.uint64(2))
            a, b = np.sort(both[rng.permutation(len(both))[:n]]), None
            rest = np.setdiff1d(both, a)
            b = np.sort(np.concatenate([rng.permutation(a)[:shared], rest]))
            p = [sketcher.pack(sketcher.values(s))[None] for s in (a, b)]
            one = np.ones(1, bool)
            found.append(sketcher.likeness(*p, one, one)[0])
        assert np.mean(found) == pytest.approx(shared / (2 * n - shared), abs=0.05)
