"""Cross-tokenizer alignment against plain loops over both tokenizers' own outputs."""

import collections
import hashlib
import json
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphdyn.llm import align

pytestmark = pytest.mark.skipif(not os.path.isdir(align.FOLDER), reason="vocabularies not present")
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def both():
    import sentencepiece
    import tokenizers
    path = os.path.join(align.FOLDER, "byte_bpe_50k.json")
    a = tokenizers.Tokenizer.from_file(path)
    a.encode_special_tokens = True
    of = align._byte_of()
    with open(path) as f:
        of_a = {i: bytes(of[c] for c in t) for t, i in json.load(f)["model"]["vocab"].items() if t != "<|endoftext|>"}
    b = sentencepiece.SentencePieceProcessor(model_file=os.path.join(align.FOLDER, "piece_bpe_32k.model"))
    of_b = {i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
            for i in range(b.get_piece_size())}
    return a, of_a, b, of_b


def plain(docs, both):
    """[(key, n_a, n_b, n_groups, n_links, n_best, count_sum, digest)] by loops."""
    a, of_a, b, of_b = both
    links, out, count = [], [], collections.Counter()
    for k, text in docs:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        raw = (" " + text).encode() if text else b""
        if b"".join(of_a[i] for i in ids_a) != raw or b"".join(of_b[i] for i in ids_b) != raw:
            ids_a, ids_b = [], []
        ends = []
        for ids, of in ((ids_a, of_a), (ids_b, of_b)):
            at, own = 0, []
            for i in ids:
                own.append((at, at + len(of[i]), i))
                at += len(of[i])
            ends.append(own)
        own, j = [], 0
        for s, e, i in ends[0]:
            while j < len(ends[1]) and ends[1][j][1] <= s:
                j += 1
            m = j
            while m < len(ends[1]) and ends[1][m][0] < e:
                own.append((i, ends[1][m][2]))
                m += 1
        cuts = sorted({x[1] for x in ends[0]} & {x[1] for x in ends[1]})
        groups, low = [], 0
        for c in cuts:
            groups.append("|".join(",".join(str(i) for s, _, i in e if low <= s < c) for e in ends))
            low = c
        links.append(own)
        count.update(set(own))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if ids_a else ""
        out.append([k, len(ids_a), len(ids_b), len(groups), len(own), digest])
    top = collections.Counter()
    for (i, _), n in count.items():
        top[i] = max(top[i], n)
    return sorted(((k, na, nb, g, n, sum(count[x] == top[x[0]] for x in own), sum(count[x] for x in own), d)
                   for (k, na, nb, g, n, d), own in zip(out, links)), key=str)


def aligned(spark, docs, parts=3):
    df = spark.createDataFrame(docs, SCHEMA).withColumn("n_a", F.lit("x")).withColumn("k", F.lit(1)).repartition(parts)
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256)
                   for r in align.align(df).collect()), key=str)


def texts(seed=5):
    rng = random.Random(seed)
    words = ("the naïve Überraschung tokenizer's 3.14159 running-through antidisestablishment 日本語 😀 don't  \t\n "
             "<|endoftext|> <s> x=f(y);   Ωmega foo_bar HTTP/2 ,,,, é \x00 \x7f").split(" ")
    mixed = lambda n: " ".join(rng.choice(words) for _ in range(n))
    return [mixed(20), mixed(3), "", None, " ", "  a", "a ", "hello world", "hello world", "▁lower one", "x" * 300,
            "日本語の文章" * 20, mixed(400), mixed(900), "ab " * 500, "\n\n  \t x", "no" + "p" * 900 + " end of it",
            mixed(100) + "▁" + mixed(300), "é" * 700 + " " + "ü" * 700]


@pytest.mark.parametrize("unit, range_, fan", [(1 << 16, 1 << 14, 16), (64, 7, 3)])
def test_alignment_matches_loops(spark, both, monkeypatch, unit, range_, fan):
    monkeypatch.setattr(align, "UNIT", unit)
    monkeypatch.setattr(align, "RANGE", range_)
    monkeypatch.setattr(align, "FAN", fan)
    monkeypatch.setattr(align, "PACK", 2000)
    docs = [*enumerate(texts()), (None, "a null key"), (7, "hello world"), (None, "long " * 200)]
    assert aligned(spark, docs) == plain(docs, both)


def test_alignment_of_empty_tables(spark, both):
    assert aligned(spark, []) == [] and aligned(spark, [(1, None)]) == plain([(1, None)], both)


def test_fragments_compose_in_any_tree():
    pair = align.Pair(*align.load())
    rng = random.Random(1)
    names = align._names(max(len(pair.bytes_a), len(pair.bytes_b)))
    for text in (t for t in texts(9) if t and pair.ids([t])[0]):
        ids = pair.ids([text])[0]
        whole = [f for _, f in align.fragments(ids, 0, pair.len_a, pair.len_b, 1 << 30)]
        assert len(whole) == 1
        want = whole[0].closed()
        parts = [f for _, f in align.fragments(ids, 0, pair.len_a, pair.len_b, rng.choice([1, 3, 10, 50]))]
        assert parts[0].cut and not len(parts[0].prefix.id_a)
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i: i + 2] = [parts[i].then(parts[i + 1])]
        got = parts[0].closed()
        assert got.text(names) == want.text(names) and np.array_equal(got.cuts, want.cuts)
        assert all(np.array_equal(x, y) for x, y in zip(got.links(), want.links()))


def test_units_keep_the_tokens_of_the_whole_text():
    pair = align.Pair(*align.load())
    assert pair.safe
    for text in (t for t in texts(3) if t and pair.ids([t])[0]):
        whole = pair.ids([text])[0]
        parts = align.units(text, True, 40)
        assert " ".join(p for _, p in parts) == text
        found = [pair.ids([p])[0] for _, p in parts]
        for side in (0, 1):
            assert np.array_equal(np.concatenate([f[side] for f in found]), whole[side])
        raw = (" " + text).encode()
        assert all(raw[at:].startswith((" " + p).encode()) for at, p in parts)
