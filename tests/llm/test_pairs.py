"""Jaccard join, suffix dedup, exact dedup and decontamination against brute force."""

import hashlib
import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_brute as brute  # noqa: E402
from graphdyn.llm import decontam, exact, jaccard, suffix  # noqa: E402

SCHEMA = "doc_id long, text string"


def _families(seed=3):
    """Near copies at many rates of change, shared passages, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(90)]
    docs = []
    for _ in range(5):
        base = [word() for _ in range(rng.randint(30, 220))]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, 9)):
                at = rng.randrange(len(w))
                w[at: at + rng.randint(0, 2)] = [word()] * rng.randint(0, 2)
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w[at:at] = passage[rng.randint(0, 20):]
            docs.append(rng.choice((" ", "\n", "  ")).join(w))
    docs += docs[:6] + [docs[0].upper(), "", None, "  \t", "One two", "one two", "one", "a b c d e", "A b  c d e"]
    rng.shuffle(docs)
    return list(enumerate(docs))


def test_jaccard_matches_all_pairs(spark):
    docs = _families()
    got = jaccard.join(spark.createDataFrame(docs, SCHEMA)).collect()
    want = brute.jaccard_components(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) < len(want) - 10


def test_jaccard_chain_is_one_component(spark):
    """Neighbours link, ends do not: the pivot finds some links, the second search the others."""
    words = [f"w{i}" for i in range(400)]
    docs = [(i, " ".join(words[6 * i: 6 * i + 120])) for i in range(12)]
    got = jaccard.join(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.jaccard_components(docs)
    assert {r.component_id for r in got} == {0}


def test_jaccard_null_keys_repeats_and_empty(spark):
    long_ = " ".join(f"x{i}" for i in range(40))
    rows = [(None, long_), (5, long_), (5, long_), (7, long_ + " tail"), (8, ""), (None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_shingles, r.component_id) for r in jaccard.join(df).collect())
    assert got == [(False, 5, 36, 5), (False, 5, 36, 5), (False, 7, 37, 5), (False, 8, 0, 8),
                   (True, 0, 0, None), (True, 0, 36, 5)]
    kept = jaccard.dedup(df)
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [(-1, ""), (5, long_), (8, "")]
    assert jaccard.join(df.limit(0)).count() == 0


def test_jaccard_dedup_keeps_unlinked_texts_without_own_key(spark):
    """Null keys and one repeated key: a component is known by its texts, not by its id."""
    long_ = lambda c: " ".join(f"{c}{i}" for i in range(40))
    near = [long_("n"), long_("n") + " tail"]
    rows = [(None, long_(c)) for c in "abcd"] + [(None, t) for t in near] + [(None, long_("a"))]
    rows += [(5, long_("e")), (5, long_("f")), (5, long_("f")), (3, long_("g")), (5, long_("g") + " end")]
    df = spark.createDataFrame(rows, SCHEMA)
    first = min(near, key=lambda t: hashlib.md5(t.encode()).digest())
    want = [(None, long_(c)) for c in "abcd"] + [(None, first), (5, long_("e")), (5, long_("f")), (3, long_("g"))]
    assert sorted(map(str, jaccard.dedup(df).collect())) == sorted(map(str, spark.createDataFrame(want, SCHEMA).collect()))
    # each class is searched once, with its own text
    lengths = jaccard.list_lengths(df, "text", "doc_id")
    classes = jaccard._searchable(df, lengths, "text", "doc_id").collect()
    assert len(classes) == len({bytes(r.sig) for r in classes}) and all(8 * r.n == len(r.lists) for r in classes)


def test_divide_skip_matches_counting():
    import numpy as np
    rng = np.random.default_rng(1)
    query = rng.choice(300, 120, replace=False).astype(np.uint64)
    sets = []
    for keep in range(70, 121, 5):
        extra = np.arange(1000, 1000 + rng.integers(0, 25), dtype=np.uint64)
        sets.append(np.sort(np.concatenate([rng.choice(query, keep, replace=False), extra])))
    both = [len(np.intersect1d(query, s)) for s in sets]
    want = [i for i, s in enumerate(sets) if 100 * both[i] >= 80 * (len(s) + 120 - both[i])]
    assert sorted(jaccard.divide_skip(query, sets)) == want and 0 < len(want) < len(sets)


def test_suffix_matches_brute_force(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    shared, other = text(900), text(420)
    docs = [text(300) + shared + text(50), shared[100:620] + text(500), text(700), other, "x" + other + "y",
            "ab" * 600, "q" * 399, "q" * 401, None, "", shared[:400] + "#" + shared[401:900], shared[:399],
            text(200) + shared[250:700] + text(30) + shared[250:700]]
    docs += [docs[2], docs[0][:1000] + "Z" + docs[0][1001:]]
    docs = list(enumerate(docs))
    got = suffix.remove_repeats(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == brute.remove_repeats(docs)


def test_suffix_null_keys_and_empty(spark):
    t = "".join(chr(97 + (i * i) % 23) for i in range(500))
    df = spark.createDataFrame([(None, t), (None, t), (3, t), (4, "short")], SCHEMA)
    got = sorted((r.n_bytes, r.n_removed, r.n_spans) for r in suffix.remove_repeats(df).collect())
    assert got == [(5, 0, 0)] + [(500, 500, 1)] * 3
    assert suffix.remove_repeats(df.limit(0)).count() == 0


def test_suffix_spans_of_planted_passages(spark):
    rng = random.Random(11)
    words = lambda n, least: [f"{'é' if i % 9 == 0 else ''}{rng.randrange(10 ** (least - 1), 10 ** least)}" for i in range(n)]
    long_, short = " ".join(words(60, 7)), " ".join(words(52, 6))
    docs, planted = [], {}
    for i in range(40):
        before, after = (" ".join(words(rng.randint(20, 120), 8)) for _ in range(2))
        passage = (long_, short, None)[i % 3]
        docs.append((i, " ".join(x for x in (before, passage, after) if x)))
        if passage is long_:
            at = len(before.encode()) + 1
            planted[i] = (at, at + len(long_.encode()))
    assert len(long_.encode()) >= 400 > len(short.encode()) + 2 and len(short.split()) > 50
    raw = {i: t.encode() for i, t in docs}
    for r in suffix.remove_repeats(spark.createDataFrame(docs, SCHEMA).repartition(5)).collect():
        spans, b = [(s.start, s.end) for s in r.spans], raw[r.doc_id]
        # beside a passage lie blanks and the like beginnings of words, which some documents share too
        assert len(spans) == (r.doc_id in planted) == r.n_spans
        for start, end in spans:
            at, stop = planted[r.doc_id]
            assert at - 16 <= start <= at and stop <= end <= stop + 16
        kept = b"".join(b[x:y] for x, y in zip([0] + [e for _, e in spans], [s for s, _ in spans] + [len(b)]))
        assert len(kept) == r.n_bytes - r.n_removed and hashlib.sha256(kept).hexdigest() == r.kept_sha256
        assert r.n_bytes == len(b)


def test_suffix_query_returns_spans(spark, tmp_path):
    from graphdyn.llm.queries import QUERIES
    t = "".join(chr(97 + (i * i + i // 23) % 26) for i in range(500))
    docs = [(1, "x" * 3 + t), (2, t[:450] + "#" + t[10:]), (3, None), (4, "short")]
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in QUERIES["op8_suffix_dedup"](spark, str(tmp_path)).collect()}
    want = brute.remove_repeats(docs)
    assert {k: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for k, r in got.items()} == want
    spans = {k: [tuple(map(int, s.split(":"))) for s in r.spans.split(",") if s] for k, r in got.items()}
    assert {k: (sum(y - x for x, y in s), len(s)) for k, s in spans.items()} == {k: w[1:3] for k, w in want.items()}
    assert got[3].spans == got[4].spans == "" and sum(w[1] for w in want.values()) > 0


def test_exact_dedup(spark):
    rows = [(3, "a  b"), (1, "a\tb"), (2, "a b "), (None, "a\n\nb"), (4, None), (5, ""), (5, "")]
    got = {(r.doc_id, r.text_sha256[:6]): (r.keep_id, r.group_size, r.kept)
           for r in exact.exact_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()[:6]
    assert got == {(3, sha("a b")): (1, 3, False), (1, sha("a b")): (1, 3, True), (None, sha("a b")): (1, 3, False),
                   (2, sha("a b ")): (2, 1, True), (4, sha("")): (4, 3, True), (5, sha("")): (4, 3, False)}
    assert exact.exact_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_cuckoo_insert_delete_resize():
    index = exact.CuckooIndex(n_buckets=2)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    for i, k in enumerate(keys):
        index.put(k, i)
    assert all(index.get(k) == i for i, k in enumerate(keys)) and index.n_keys == 3000
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert [index.get(k) for k in keys[:4]] == [None, 1, None, 3]
    absent = [hashlib.sha256(f"no{i}".encode()).digest() for i in range(4000)]
    assert sum(index.maybe(k) for k in absent) < 20 and all(index.get(k) is None for k in absent)
    # ten keys that share bucket bits and fingerprint
    twins = [b"\x01\x02\x03\x04\x05\x06" + bytes([i]) * 26 for i in range(10)]
    for i, k in enumerate(twins):
        index.put(k, i)
    assert [index.delete(k) for k in twins[:9]] == [True] * 9 and index.get(twins[9]) == 9


def test_index_update(spark):
    d = [hashlib.sha256(bytes([i])).digest() for i in range(4)]
    live = spark.createDataFrame([(d[0], 10), (d[1], 11)], "digest binary, doc_id long")
    changes = spark.createDataFrame(
        [(1, "delete", d[0], None), (2, "insert", d[0], 20), (3, "insert", d[1], 21), (4, "insert", d[2], 22),
         (5, "delete", d[2], None), (6, "delete", d[3], None)], "seq long, op string, digest binary, doc_id long")
    got = {bytes(r.digest): r.doc_id for r in exact.update_index(live, changes, 4).collect()}
    assert got == {d[0]: 20, d[1]: 11}


ITEMS = [(1, "The quick brown fox jumps over the lazy dog near the old river bank today"),
         (2, "Completely different words stand here for a second item of the test set"), (3, None), (4, ""),
         (5, "too short"), (7, "Short"), (8, "lazy dog near the"), (6, "same words same words same words same words same words")]


def test_decontamination(spark):
    item = ITEMS[0][1]
    docs = [(1, "Start. " + item.upper() + ", end."), (2, item.replace("lazy", "sleepy")), (3, "nothing to see"),
            (4, None), (5, ""), (6, "too short"), (7, "x " * 50 + ITEMS[1][1]), (8, "it is too short indeed"),
            (9, item + " " + ITEMS[1][1]), (10, "same words " * 6), (11, " ".join(item.split()[:-1]))]
    df = spark.createDataFrame(docs, SCHEMA).selectExpr("doc_id", "text", "doc_id as matches", "1 as part")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontam.find(df, items)
    name, = decontam.added(df)
    got = {(r.doc_id, m.item): m.similarity for r in found.collect() for m in r[name]}
    want = brute.contaminated(docs, ITEMS)
    assert got == pytest.approx(want) and (2, 1) not in want and (11, 1) in want
    clean = decontam.clean(df, items)
    assert clean.columns == df.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in docs} - {d for d, _ in want}
    assert decontam.clean(df, items.limit(0)).count() == len(docs) and decontam.clean(df.limit(0), items).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 100)
    docs = [(i, t) for i, t in ITEMS]
    found = decontam.find(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(ITEMS, "item_id long, text string"))
    got = {(r.doc_id, m["item"]) for r in found.collect() for m in r["matches"]}
    assert got == set(brute.contaminated(docs, ITEMS))


def test_hamming_index_is_complete():
    import numpy as np
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 256, (40, 8), dtype=np.uint8)
    near = decontam._NEAR[prints.T].transpose(0, 2, 1)
    for distance in (0, 10, decontam.RADIUS):
        for i, p in enumerate(prints):
            bits = np.unpackbits(p)
            bits[rng.choice(64, distance, replace=False)] ^= 1
            q = np.packbits(bits)
            assert any(near[k][q[k]][i] for k in range(8))
