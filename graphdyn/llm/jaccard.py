"""N-gram Jaccard join: T-occurrence search in the manner of DivideSkip.

Two texts link when their sets of five-word shingles have Jaccard similarity
of at least 0.8, so they share at least T = 4/9 of the sum of their set sizes.

1. *List lengths.* Every text's shingle hashes go, packed per bucket of hash
   bits, to a count of the documents that hold each, and the counts (one byte
   each) come back to the text. One shuffle of four bytes per shingle, whatever
   the skew: a frequent shingle is four bytes per document in one bucket.
2. *Classes.* Texts with equal sets are one class from here on. A shingle held
   by no other class is private; a class of n shingles of which fewer than
   0.8 n are shared links with nothing and is done.
3. *Short lists.* A class's shingles are ordered by list length. A linked pair
   shares one of its first n - 0.8 n + 1, so only these short lists are merged;
   long lists (common lines and passages) never are.
4. *Probing.* A class whose short lists meet a candidate is the candidate's
   query: the query's short lists over a block of candidates are merged by a
   heap, long ones probed by binary search, and candidates that reach T stay.

Near copies of one text share most lists, so merging would give all pairs of a
group. Instead each class is first searched only against one pivot, the class
with the smallest private share among those it meets. Linked classes get one
label; then the remaining pairs are searched, those with *different* labels that
meet in a short list. Every link is thereby found or lies within one component.

Hashes have 64 bits (list lengths: bucket bits + 32, and a collision there only
makes a list look longer). Edge cases: null, empty and blank texts have no
shingles and link with nothing; texts of one to four words are one shingle;
repeated rows belong to one class; null keys and keys that repeat take part, a
component's id is its smallest non-null key (components without one share the id
null, but stay apart); very long texts are shingled whole, as one row of hashes;
ties between keys go to the text's digest; an empty table gives an empty result;
``join`` reads no other columns, ``dedup`` passes them through whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphdyn.llm.common import TEXT_BATCH, bound_batches, fresh, maybe_member, partitions
from graphdyn.llm.words import chunks, encode, shingle_sets
from graphdyn.session import cut_lineage

SIZE = 5
#: Text bytes and documents whose shingles are packed together.
PACK, PACK_DOCS = TEXT_BATCH, 50_000
#: Candidates per query block.
BLOCK = 256
_U = np.uint64


def required(n: int, m: int) -> int:
    """Least overlap of sets of n and m shingles at similarity 0.8."""
    return -(-4 * (n + m) // 9)


def _sets(texts: list[bytes]) -> list[np.ndarray]:
    return [s for a, b in chunks(texts) for s in shingle_sets(texts[a:b], SIZE)]


def _sig(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


# --- 1. list lengths -------------------------------------------------------

def _pack(bits: int):
    """Documents to rows (pack, bucket, data); the pack's own row has a bucket below 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        base, seq = TaskContext.get().partitionId() << 32, 0
        for pdf in batches:
            raw, ids = encode(pdf["t"]), pdf["k"].to_numpy(np.int64)
            none, names = pdf["none"].to_numpy(bool), pdf["name"].tolist()
            for a, b in chunks(raw, PACK):
                for c in range(a, b, PACK_DOCS):
                    d = min(b, c + PACK_DOCS)
                    yield _pack_rows(base + seq, ids[c:d], none[c:d], names[c:d], _sets(raw[c:d]), bits)
                    seq += 1

    return run


def _pack_rows(pack, ids, none, names, sets, bits) -> pd.DataFrame:
    n = np.array([len(s) for s in sets], np.uint32)
    h = np.concatenate(sets)
    doc = np.repeat(np.arange(len(sets), dtype=np.uint16), n)
    bucket = (h >> _U(64 - bits)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    low = ((h[order] << _U(bits)) >> _U(32)).astype(np.uint32)
    cut = np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
    held = np.flatnonzero(np.diff(cut))
    own = {"ids": ids.tobytes(), "none": none.tobytes(),
           "names": b"".join(names), "n": n.tobytes(), "sigs": b"".join(_sig(s) or bytes(16) for s in sets),
           "doc": doc[order].tobytes()}
    rows = [(pack, -1 - pack % 997, None, *own.values())]
    rows += [(pack, int(k), low[cut[k]:cut[k + 1]].tobytes(), *[None] * len(own)) for k in held]
    return pd.DataFrame(rows, columns=["pack", "bucket", "data", *own])


_PACKED = "pack long, bucket int, data binary, ids binary, none binary, names binary, n binary, sigs binary, doc binary"


def _runs(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Rows of sorted batches, one frame per value of ``by``."""
    held: list[pd.DataFrame] = []
    last = None
    for pdf in batches:
        if pdf.empty:
            continue
        keys = list(zip(*(pdf[c] for c in by)))
        start = 0
        for i in range(1, len(keys) + 1):
            if i < len(keys) and keys[i] == keys[start]:
                continue
            if last is not None and keys[start] != last:
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
            last = keys[start]
            held.append(pdf.iloc[start:i])
            start = i
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each packed hash becomes the number of documents that hold it, 255 at most."""
    for rows in _runs(batches, ["bucket"]):
        if rows["bucket"].iat[0] < 0:
            yield rows
            continue
        parts = [np.frombuffer(x, np.uint32) for x in rows["data"]]
        every = np.concatenate(parts)
        order = np.argsort(every)
        first = np.flatnonzero(np.diff(every[order], prepend=~every[order[:1]]))
        times = np.diff(np.append(first, len(every)))
        df = np.empty(len(every), np.uint8)
        df[order] = np.repeat(np.minimum(times, 255).astype(np.uint8), times)
        ends = np.cumsum([len(p) for p in parts])
        yield rows.assign(data=[x.tobytes() for x in np.split(df, ends[:-1])])


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(k, name, sig, n, df): the list length of each shingle, in order of hash, or null if too few are shared."""
    for rows in _runs(batches, ["pack"]):
        rows = rows.sort_values("bucket")
        own = rows.iloc[0]
        n = np.frombuffer(own["n"], np.uint32).astype(np.int64)
        df = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["data"].iloc[1:]] or [np.empty(0, np.uint8)])
        doc = np.frombuffer(own["doc"], np.uint16)
        df = df[np.argsort(doc, kind="stable")]
        end = np.cumsum(n)
        shared = np.concatenate([[0], np.cumsum(df > 1)])
        shared = shared[end] - shared[end - n]
        ids = pd.array(np.frombuffer(own["ids"], np.int64), dtype="Int64")
        ids[np.frombuffer(own["none"], bool)] = pd.NA
        yield pd.DataFrame({
            "k": ids, "name": [own["names"][16 * i: 16 * i + 16] for i in range(len(n))], "n": n,
            "sig": [own["sigs"][16 * i: 16 * i + 16] if n[i] else None for i in range(len(n))],
            "df": [df[end[i] - n[i]: end[i]].tobytes() if n[i] and 5 * shared[i] >= 4 * n[i] else None
                   for i in range(len(n))]})


def _name(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def list_lengths(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(k, name, n, sig, df) per document, written once; the name is the text's md5."""
    bound_batches(docs.sparkSession, TEXT_BATCH)
    p = partitions(docs)
    bits = min(16, max(6, (2 * p - 1).bit_length()))
    k = F.col(key).cast("long")
    rows = docs.select(F.coalesce(k, F.lit(0)).alias("k"), k.isNull().alias("none"), F.col(text).alias("t"),
                       _name(text).alias("name"))
    packed = rows.mapInPandas(_pack(bits), _PACKED)
    counted = packed.repartition(p, "bucket").sortWithinPartitions("bucket").mapInPandas(_count, _PACKED)
    back = counted.repartition(p, "pack").sortWithinPartitions("pack")
    return cut_lineage(back.mapInPandas(_unpack, "k long, name binary, n long, sig binary, df binary"))


# --- 2. and 3. classes and their short lists -------------------------------

def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Classes of which enough shingles are shared, with the number m of these."""
    for pdf in batches:
        m = []
        for df, g, n in zip(pdf["df"], pdf["g"], pdf["n"]):
            own = np.frombuffer(df, np.uint8) <= g if g < 255 else np.zeros(1, bool)
            m.append(n - int(own.sum()))
        pdf = pdf.assign(m=m)
        yield pdf[5 * pdf["m"] >= 4 * pdf["n"]]


def _order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(sig, n, m, lists, short): hashes by list length, and the shared ones among the short."""
    for pdf in batches:
        out = []
        for s, sig, n, m, df in zip(_sets(encode(pdf["t"])), pdf["sig"], pdf["n"], pdf["m"], pdf["df"]):
            s = s[np.lexsort((s, np.frombuffer(df, np.uint8)))]
            short = s[n - m: n + 1 - (4 * n + 4) // 5]
            out.append((sig, n, m, s.tobytes(), short.view(np.int64)))
        yield pd.DataFrame(out, columns=["sig", "n", "m", "lists", "short"])


def _searchable(docs: DataFrame, lengths: DataFrame, text: str, key: str) -> DataFrame:
    classes = lengths.filter(F.col("df").isNotNull()).groupBy("sig").agg(
        F.min(F.struct("k", "name")).alias("rep"), F.count("*").alias("g"), F.first("n").alias("n"),
        F.first("df").alias("df"))
    classes = classes.select("sig", F.col("rep.k").alias("rep"), F.col("rep.name").alias("digest"), "g", "n", "df")
    kept = cut_lineage(classes.mapInPandas(
        _shared, "sig binary, rep long, digest binary, g long, n long, df binary, m long"))
    # a class has one text, but many texts may have its key, or none of them a key
    texts = docs.select(F.col(key).cast("long").alias("k"), _name(text).alias("name"), F.col(text).alias("t")).filter(
        maybe_member(F.xxhash64(F.col(key).cast("long"), _name(text)), kept.select(F.xxhash64("rep", "digest"))))
    rows = texts.join(kept, F.col("k").eqNullSafe(F.col("rep")) & (F.col("name") == F.col("digest")))
    found = cut_lineage(rows.select("t", "sig", "n", "m", "df").mapInPandas(
        _order, "sig binary, n long, m long, lists binary, short array<long>"))
    again = cut_lineage(found.groupBy("sig").count().filter("count > 1").select("sig"))
    if again.isEmpty():
        return found
    # rows that repeat key and text
    return cut_lineage(found.join(again, "sig", "left_anti").unionByName(
        found.join(again, "sig", "left_semi").dropDuplicates(["sig"])))


# --- 4. search -------------------------------------------------------------

def divide_skip(query: np.ndarray, sets: list[np.ndarray]) -> list[int]:
    """Which of ``sets`` (sorted hashes) link with ``query`` (hashes by list length).

    T depends on the candidate's size; the smallest T decides how many lists are
    long. Short lists are merged by a heap, survivors probe the long ones.
    """
    n = len(query)
    least = min(required(n, len(s)) for s in sets)
    short, long_ = query[: n - least + 1], query[n - least + 1:]

    def held(s: np.ndarray, of: np.ndarray) -> np.ndarray:
        return s[np.minimum(np.searchsorted(s, of), len(s) - 1)] == of

    lists: dict[int, list[int]] = {}
    for i, s in enumerate(sets):
        for k in np.flatnonzero(held(s, short)).tolist():
            lists.setdefault(k, []).append(i)
    out = []
    for i, run in groupby(heapq.merge(*lists.values())):
        met, s = sum(1 for _ in run), sets[i]
        need = required(n, len(s))
        if met + len(long_) >= need and met + int(held(s, long_).sum()) >= need:
            out.append(i)
    return out


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in _runs(batches, ["q", "block"]):
        own = (rows["q"] == rows["x"]).to_numpy()
        query = np.frombuffer(rows["lists"][own].iat[0], _U)
        rows = rows[~own]
        sets = [np.sort(np.frombuffer(x, _U)) for x in rows["lists"]]
        names = rows["x"].tolist()
        linked = divide_skip(query, sets) if sets else []
        yield pd.DataFrame({"a": [rows["q"].iat[0]] * len(linked), "b": [names[i] for i in linked]})


def _links(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (q, x) that link, as (a, b). A query's candidates go out in blocks."""
    p = partitions(pairs)
    lists = classes.select("sig", "lists")
    many = pairs.groupBy("q").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).withColumnRenamed("q", "q2")
    pairs = cut_lineage(pairs.join(many, F.col("q") == F.col("q2")).select(
        "q", "x", F.pmod(F.xxhash64("x"), F.col("blocks")).alias("block")))
    queries = pairs.select("q", F.col("q").alias("x"), "block").distinct()
    rows = pairs.unionByName(queries).join(lists, F.col("x") == F.col("sig")).drop("sig")
    rows = rows.repartition(p, "q", "block").sortWithinPartitions("q", "block")
    return cut_lineage(rows.mapInPandas(_search, "a binary, b binary"))


def components(links: DataFrame) -> DataFrame:
    """(v, label): the smallest name reachable from each end of ``links`` (a, b).

    Labels spread over links and are then replaced by their own labels, until
    nothing changes; each round is written.
    """
    both = cut_lineage(links.select("a", "b").unionByName(
        links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut_lineage(both.groupBy(F.col("a").alias("v")).agg(
        F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")))
    while True:
        far = labels.select(F.col("v").alias("b"), F.col("label").alias("l"))
        spread = both.join(far, "b").groupBy("a").agg(F.min("l").alias("l"))
        new = labels.join(spread, F.col("v") == F.col("a")).select(
            "v", "label", F.least("label", "l").alias("new"))
        jump = new.select(F.col("v").alias("w"), F.col("new").alias("up"))
        new = cut_lineage(new.join(jump, F.col("new") == F.col("w"), "left").select(
            "v", "label", F.coalesce(F.least("up", "new"), "new").alias("new")))
        labels = new.select("v", F.col("new").alias("label"))
        if new.filter(F.col("label") != F.col("new")).isEmpty():
            return labels


def _may_link(a: str, b: str) -> Column:
    """Size, shared-shingle and position bounds for a pair that meets at positions pos."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    need = F.ceil(4 * (n + m) / F.lit(9))
    return ((F.least(F.col(f"{a}.m"), F.col(f"{b}.m")) >= need)
            & (n - F.col(f"{a}.pos") >= need) & (m - F.col(f"{b}.pos") >= need))


def class_links(classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes that give the components of all links."""
    lists = classes.select("sig", "n", "m", F.posexplode("short").alias("i", "h")).select(
        "h", F.struct("sig", "n", "m", (F.col("n") - F.col("m") + F.col("i")).alias("pos")).alias("x"))
    lists = cut_lineage(lists)
    share = (F.col("x.n") - F.col("x.m")) / F.col("x.n")
    first = lists.groupBy("h").agg(F.min(F.struct(share.alias("s"), F.col("x").alias("x"))).alias("p"),
                                   F.count("*").alias("c"))
    first = first.filter("c > 1").select(F.col("h").alias("h2"), F.col("p.s").alias("s"), F.col("p.x").alias("p"))
    met = lists.join(first, F.col("h") == F.col("h2")).filter(
        (F.col("x.sig") != F.col("p.sig")) & _may_link("x", "p"))
    pivots = cut_lineage(met.groupBy(F.col("x.sig").alias("x")).agg(
        F.min(F.struct("s", F.col("p.sig").alias("q"))).alias("best")).select(F.col("best.q").alias("q"), "x"))
    links = _links(pivots, classes)

    label = components(links)
    runs = lists.join(label, F.col("x.sig") == F.col("v"), "left").select(
        "h", "x", F.coalesce("label", "x.sig").alias("label"))
    runs = cut_lineage(runs)
    mixed = runs.groupBy("h").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter(
        "lo < hi").select(F.col("h").alias("h2"))
    runs = runs.join(mixed, F.col("h") == F.col("h2"), "left_semi")
    other = runs.select(F.col("h").alias("h2"), F.col("x").alias("y"), F.col("label").alias("label2"))
    pairs = runs.join(other, (F.col("h") == F.col("h2")) & (F.col("x.sig") < F.col("y.sig"))
                      & (F.col("label") != F.col("label2")) & _may_link("x", "y"))
    pairs = pairs.select(F.col("x.sig").alias("q"), F.col("y.sig").alias("x")).distinct()
    tried = pivots.select(F.least("q", "x").alias("q"), F.greatest("q", "x").alias("x"))
    return links.unionByName(_links(pairs.join(tried, ["q", "x"], "left_anti"), classes))


def _classed(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(k, name, n, c, label), one row per document: key, text's md5, set size, component's id and label.

    The label tells components apart whose ids are equal (null, or a key that
    repeats); texts without words have none.
    """
    lengths = list_lengths(docs, text, key)
    classes = _searchable(docs, lengths, text, key)
    label = components(class_links(classes))
    reps = lengths.filter(F.col("n") > 0).groupBy("sig").agg(F.min("k").alias("rep"))
    named = reps.join(label, F.col("sig") == F.col("v"), "left").select(
        "sig", "rep", F.coalesce("label", "sig").alias("label"))
    named = cut_lineage(named)
    least = named.groupBy("label").agg(F.min("rep").alias("least"))
    found = cut_lineage(named.join(least, "label").select(F.col("sig").alias("s"), "least", "label"))
    out = lengths.join(found, F.col("sig") == F.col("s"), "left")
    return out.select("k", "name", "n", F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("k")).alias("c"),
                      "label")


def join(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_shingles, component_id), one row per document."""
    return _classed(docs, text, key).select(
        F.col("k").alias(key), F.col("n").alias("n_shingles"), F.col("c").alias("component_id"))


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one document of each component, that with the smallest key.

    Documents without words all stay. Of the texts under that key, and of those
    of a component without keys, the one with the smallest md5 stays, once.
    """
    out = cut_lineage(_classed(docs, text, key))
    here, own = F.col(key), _name(text)
    first, k, name = fresh(docs, "first", "k", "name")
    # null keys last; equal texts are in one component, so key and text name a row's component
    heads = out.filter("n > 0").groupBy("label").agg(
        F.min(F.struct(F.col("k").isNull().alias("none"), "k", "name")).alias("m"), F.count("*").alias("r"))
    heads = cut_lineage(heads.select(F.col("label").alias("l2"), F.col("m.k").alias("k2"), F.col("m.name").alias("m"),
                                     "r"))
    marked = out.filter("n > 0").join(heads, F.col("label") == F.col("l2"))
    gone = ~(F.col("k").eqNullSafe(F.col("k2")) & (F.col("name") == F.col("m")))
    lost = cut_lineage(marked.filter(gone).select(F.col("k").alias(k), F.col("name").alias(name)).distinct())
    maybe = maybe_member(F.xxhash64(here.cast("long"), own), lost.select(F.xxhash64(k, name)))
    kept = docs.filter(~maybe).unionByName(docs.filter(maybe).join(
        lost, here.cast("long").eqNullSafe(F.col(k)) & (own == F.col(name)), "left_anti"))
    again = cut_lineage(marked.filter(~gone & (F.col("r") > 1)).groupBy("k", "name").count()
                        .filter("count > 1").select(F.col("k").alias(k), F.col("name").alias(name)))
    if again.isEmpty():
        return kept
    same = here.cast("long").eqNullSafe(F.col(k)) & (own == F.col(name))
    return kept.join(again, same, "left_anti").unionByName(
        kept.join(again, same, "left_semi").withColumn(first, own).dropDuplicates([key, first]).drop(first))
