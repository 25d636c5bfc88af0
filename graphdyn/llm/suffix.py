"""Suffix dedup: removes every byte covered by a 400-byte string that starts elsewhere too.

A suffix is looked at up to its first ``LENGTH`` bytes (a *window*); a window is
repeated if its neighbour in sorted order is equal. Sorting all suffixes would
move every byte 400 times, so the order is built from coarse to fine:

1. *Runs.* Each window has an anchor, its ``GRAM`` bytes of least hash, so equal
   windows have equal anchors at equal offsets. Consecutive windows with one
   anchor are cut into runs of up to ``STEP`` offsets. All windows of a run
   contain its core (about 340 bytes); a core that occurs once has no repeated
   window. Runs that agree as a whole are repeated as a whole.
2. *Suffixes.* What is left are runs whose core occurs elsewhere with other
   margins. Each of their windows is a key: leading token (8 bytes), then a
   fingerprint of all 400 bytes. Sampled splitters range-partition the keys by
   leading token (equal splitters deal a frequent token out by fingerprint, so
   equal suffixes never lie on both sides of a boundary); a bucket sorts locally
   by multikey quicksort and compares neighbours.

Keys travel packed, and equal keys of one pack are folded before the shuffle, so
a passage that a third of all documents share costs one key per pack. Texts
move once to learn the state of their runs and, for those with any, once more
for the result. Hashes have 64 bits.

Edge cases: null and texts under 400 bytes lose nothing; repeated rows lose all
of at least 400 bytes; null keys take part; very long texts are handled whole, a chunk
each; ties cannot arise; an empty table gives an empty result; other columns are not read;
bytes are judged on the input, and kept bytes are joined as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphdyn.llm.common import n_bytes, partitions, unit_hash
from graphdyn.llm.jaccard import _runs
from graphdyn.llm.words import chunks, encode, mix, powers
from graphdyn.session import cut_lineage

LENGTH = 400
GRAM = 16
STEP = 64
#: Window starts that can hold one anchor.
SPAN = LENGTH - GRAM + 1
PACK = 8 << 20
#: Documents (about) from which splitters are drawn.
SAMPLE_DOCS = 400
_U = np.uint64
_CODE = mix(np.arange(256).astype(_U) + _U(77))
#: State of a run: not repeated, margins differ, repeated, repeated and to be sent for the others.
NONE, OPEN, FULL, SENT = 0, 1, 2, 3


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    full = np.concatenate([x, np.full(-n % w, ~_U(0))]).reshape(-1, w)
    right = np.minimum.accumulate(full, axis=1).ravel()
    left = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[: n - w + 1], right[w - 1: n])


class Runs:
    """The runs of some texts laid end to end: text number, first window, windows, core and whole hash."""

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(size)
        self.raw = np.frombuffer(b"".join(texts), np.uint8)
        n = len(self.raw)
        if n < LENGTH:
            self.doc = self.start = self.count = np.empty(0, np.int64)
            self.core = self.whole = np.empty(0, _U)
            self.origin = ends - size
            return
        p, self._inv = powers(n + 1)
        self._sum = np.zeros(n + 1, _U)
        np.cumsum(_CODE[self.raw] * p[:n], out=self._sum[1:])
        gram = mix((self._sum[GRAM:] - self._sum[:-GRAM]) * self._inv[: n - GRAM + 1])
        # least hash, then leftmost: the position is the lower half
        place = (gram >> _U(32) << _U(32)) | np.arange(len(gram), dtype=_U)
        anchor = (_sliding_min(place, SPAN) & _U(0xFFFFFFFF)).astype(np.int64)
        self.origin = ends - size
        inside = np.zeros(n + 1, np.int8)
        long_ = size >= LENGTH
        inside[self.origin[long_]] += 1
        inside[ends[long_] - LENGTH + 1] -= 1
        inside = np.cumsum(inside[: len(anchor)]).astype(bool)
        offset = anchor - np.arange(len(anchor))
        step = offset // STEP
        new = np.ones(len(anchor) + 1, bool)
        new[1:-1] = (anchor[1:] != anchor[:-1]) | (step[1:] != step[:-1]) | (inside[1:] != inside[:-1])
        new[self.origin[long_]] = True
        cut = np.flatnonzero(new)
        first, stop = cut[:-1], cut[1:]
        first, stop = first[inside[first]], stop[inside[first]]
        self.start, self.count = first, stop - first
        self.doc = np.searchsorted(ends, first, "right")
        a, k = anchor[first], step[first]
        self.core = mix(self._hash(a - k * STEP, a - (k + 1) * STEP + 1 + LENGTH) + k.astype(_U))
        self.whole = mix(self._hash(first, stop - 1 + LENGTH) + (offset[first] * SPAN + self.count).astype(_U))

    def _hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self._sum[b] - self._sum[a]) * self._inv[a])

    def windows(self, runs: np.ndarray) -> np.ndarray:
        """Window starts of the given runs, in order."""
        n = self.count[runs]
        return np.repeat(self.start[runs] - np.cumsum(n) + n, n) + np.arange(n.sum())

    def keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leading token, fingerprint) of the suffixes at ``at``."""
        lead = np.zeros(len(at), _U)
        for i in range(8):
            lead = lead << _U(8) | self.raw[at + i].astype(_U)
        return lead, self._hash(at, at + LENGTH)


def multikey_sort(lead: np.ndarray, print_: np.ndarray) -> np.ndarray:
    """Order by leading token; only runs of equal tokens are sorted by the next key."""
    order = np.argsort(lead, kind="stable")
    sorted_ = lead[order]
    cut = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1], [True]]))
    size = np.diff(cut)
    tied = np.repeat(size > 1, size)
    if tied.any():
        group = np.repeat(np.arange(len(size)), size)[tied]
        inner = np.lexsort((print_[order[tied]], group))
        order[np.flatnonzero(tied)] = order[tied][inner]
    return order


# --- packed exchange --------------------------------------------------------

_PACKED = "pack long, bucket int, a binary, b binary, w binary, own binary, names binary, ids binary, none binary"
_COLUMNS = ["pack", "bucket", "a", "b", "w", "own", "names", "ids", "none"]


def _packed(pack: int, a, b, weight, bucket, docs, names, ids, none, n_buckets: int) -> pd.DataFrame:
    """Distinct keys (a, b) of a pack by bucket with their weights, and a row of its own that maps them back."""
    order = np.lexsort((b, a, bucket))
    a_, b_, k_ = a[order], b[order], bucket[order]
    new = np.ones(len(order), bool)
    new[1:] = (a_[1:] != a_[:-1]) | (b_[1:] != b_[:-1]) | (k_[1:] != k_[:-1])
    entry = np.empty(len(order), np.uint32)
    entry[order] = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    w = np.minimum(np.add.reduceat(weight[order], first), 2).astype(np.uint8) if len(first) else np.empty(0, np.uint8)
    a_, b_, k_ = a_[first], b_[first], k_[first]
    cut = np.searchsorted(k_, np.arange(n_buckets + 1))
    own = np.concatenate([docs.astype(np.uint32), entry])
    rows = [(pack, -1 - pack % 997, None, None, None, own.tobytes(), b"".join(names), ids.tobytes(), none.tobytes())]
    rows += [(pack, int(k), a_[cut[k]:cut[k + 1]].tobytes(), b_[cut[k]:cut[k + 1]].tobytes(),
              w[cut[k]:cut[k + 1]].tobytes(), None, None, None, None)
             for k in np.flatnonzero(np.diff(cut))]
    return pd.DataFrame(rows, columns=_COLUMNS)


def _bucket(batches: Iterator[pd.DataFrame], settle) -> Iterator[pd.DataFrame]:
    """Replace the weights of each bucket's keys by ``settle(a, b, weight)``."""
    for rows in _runs(batches, ["bucket"]):
        if rows["bucket"].iat[0] < 0:
            yield rows
            continue
        rows = rows.sort_values("pack")
        a = np.concatenate([np.frombuffer(x, _U) for x in rows["a"]])
        b = np.concatenate([np.frombuffer(x, _U) for x in rows["b"]])
        w = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["w"]])
        ends = np.cumsum([len(x) for x in rows["w"]])
        state = settle(a, b, w)
        yield rows.assign(a=None, b=None, w=[x.tobytes() for x in np.split(state, ends[:-1])])


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(name, id or None, states of its keys) per document of each pack."""
    for rows in _runs(batches, ["pack"]):
        rows = rows.sort_values("bucket")
        own = rows.iloc[0]
        both = np.frombuffer(own["own"], np.uint32)
        docs, entry = both[: len(both) // 2], both[len(both) // 2:]
        state = np.concatenate([np.frombuffer(x, np.uint8) for x in rows["w"].iloc[1:]] or [np.empty(0, np.uint8)])
        state_of = state[entry].copy()
        # only one run of a pack is sent for the others
        sent = np.flatnonzero(state_of == SENT)
        keep = np.unique(entry[sent], return_index=True)[1]
        seen = np.zeros(len(sent), bool)
        seen[keep] = True
        state_of[sent[~seen]] = FULL
        names, ids = own["names"], np.frombuffer(own["ids"], np.int64)
        none = np.frombuffer(own["none"], bool)
        cut = np.searchsorted(docs, np.arange(len(ids) + 1))
        for i in range(len(ids)):
            part = state_of[cut[i]:cut[i + 1]]
            if part.any():
                yield names[16 * i: 16 * i + 16], None if none[i] else int(ids[i]), part.tobytes()


def _settle_runs(core: np.ndarray, whole: np.ndarray, w: np.ndarray) -> np.ndarray:
    order = np.lexsort((whole, core))
    c, x = core[order], whole[order]
    new_core = np.concatenate([[True], c[1:] != c[:-1]])
    new = new_core | np.concatenate([[True], x[1:] != x[:-1]])
    first = np.flatnonzero(new)
    times = np.add.reduceat(w[order].astype(np.int64), first)
    kinds = np.add.reduceat(new.astype(np.int64), np.flatnonzero(new_core))
    kinds = kinds[np.cumsum(new_core[first]) - 1]
    state = np.where(times > 1, FULL, np.where(kinds > 1, OPEN, NONE))
    out = np.repeat(state, np.diff(np.append(first, len(c)))).astype(np.uint8)
    out[first[(times > 1) & (kinds > 1)]] = SENT
    back = np.empty(len(c), np.uint8)
    back[order] = out
    return back


def _settle_suffixes(lead: np.ndarray, print_: np.ndarray, w: np.ndarray) -> np.ndarray:
    order = multikey_sort(lead, print_)
    a, b = lead[order], print_[order]
    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    times = np.add.reduceat(w[order].astype(np.int64), first)
    back = np.empty(len(a), np.uint8)
    back[order] = np.repeat((times > 1).astype(np.uint8), np.diff(np.append(first, len(a))))
    return back


def _exchange(packed: DataFrame, settle, p: int) -> DataFrame:
    rows = packed.repartition(p, "bucket").sortWithinPartitions("bucket")
    rows = rows.mapInPandas(lambda it: _bucket(it, settle), _PACKED)
    return rows.repartition(p, "pack").sortWithinPartitions("pack")


def _pack_base() -> int:
    from pyspark import TaskContext
    return TaskContext.get().partitionId() << 32


def _run_states(docs: DataFrame, p: int) -> DataFrame:
    """(name, first_id, states): per distinct text with a repeated core, the state of each run."""
    bits = max(6, (2 * p - 1).bit_length())

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = _pack_base()
        for pdf in batches:
            raw, names = encode(pdf["t"]), pdf["name"].tolist()
            ids, none = pdf["k"].to_numpy(np.int64), pdf["none"].to_numpy(bool)
            for a, b in chunks(raw, PACK):
                doc, core, whole = [], [], []
                for c, d in chunks(raw[a:b]):
                    runs = Runs(raw[a + c: a + d])
                    doc.append(runs.doc + c)
                    core.append(runs.core)
                    whole.append(runs.whole)
                core = np.concatenate(core)
                yield _packed(base, core, np.concatenate(whole), np.ones(len(core), np.int64),
                              (core >> _U(64 - bits)).astype(np.int64), np.concatenate(doc),
                              names[a:b], ids[a:b], none[a:b], 1 << bits)
                base += 1

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield _frame(_unpack(batches), ["name", "k", "state"])

    back = _exchange(docs.mapInPandas(pack, _PACKED), _settle_runs, p)
    states = back.mapInPandas(unpack, "name binary, k long, state binary")
    # equal texts differ only in which run is sent, so the distinct states are at most one more than the runs
    return states.groupBy("name").agg(F.min("k").alias("first_id"), F.collect_set("state").alias("states"))


def _frame(rows: Iterator[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(list(rows), columns=columns)
    return out.astype({"k": "Int64"}) if "k" in columns else out


def _state(variants) -> np.ndarray:
    return np.maximum.reduce([np.frombuffer(x, np.uint8) for x in variants])


def _splitters(docs: DataFrame, n: int) -> np.ndarray:
    """Leading tokens that cut a sample of suffixes into ``n`` equal parts."""
    share = SAMPLE_DOCS / max(1, docs.count())
    sample = docs.filter(unit_hash("suffix", F.col("k")) < share).select(F.substring("t", 1, 4096).alias("t"))
    lead = []
    for row in sample.limit(2 * SAMPLE_DOCS).collect():
        t = (row["t"] or "").encode("utf-8", "surrogatepass")
        lead += [int.from_bytes(t[i: i + 8], "big") for i in range(0, max(0, len(t) - 8), 37)]
    if not lead:
        return np.empty(0, _U)
    lead = np.sort(np.array(lead, _U))
    return lead[np.linspace(0, len(lead) - 1, n + 1).astype(int)[1:-1]]


def _suffix_states(rows: DataFrame, splitters: np.ndarray, p: int) -> DataFrame:
    """(name, open): which windows of a text's open runs are repeated, in order."""
    n_buckets = len(splitters) + 1

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = _pack_base()
        for pdf in batches:
            raw, names = encode(pdf["t"]), pdf["name"].tolist()
            sends, states = pdf["sends"].to_numpy(bool), [_state(v) for v in pdf["states"]]
            for a, b in chunks(raw, PACK):
                doc, lead, print_, weight = [], [], [], []
                for c, d in chunks(raw[a:b]):
                    runs = Runs(raw[a + c: a + d])
                    state = np.concatenate(states[a + c: a + d])
                    pick = np.flatnonzero((state == OPEN) | (state == SENT) & sends[a + c: a + d][runs.doc])
                    at = runs.windows(pick)
                    x, y = runs.keys(at)
                    lead.append(x)
                    print_.append(y)
                    doc.append(np.repeat(runs.doc[pick] + c, runs.count[pick]))
                    weight.append(np.repeat(np.where(state[pick] == OPEN, 1, 2), runs.count[pick]))
                x, y = np.concatenate(lead), np.concatenate(print_)
                lo, hi = np.searchsorted(splitters, x, "left"), np.searchsorted(splitters, x, "right")
                bucket = lo + (y % np.maximum(1, hi - lo).astype(_U)).astype(np.int64)
                yield _packed(base, x, y, np.concatenate(weight), bucket, np.concatenate(doc),
                              names[a:b], np.zeros(b - a, np.int64), np.zeros(b - a, bool), n_buckets)
                base += 1

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield _frame(((name, state) for name, _, state in _unpack(batches)), ["name", "open"])

    back = _exchange(rows.mapInPandas(pack, _PACKED), _settle_suffixes, p)
    return back.mapInPandas(unpack, "name binary, open binary")


def _cut(raw: bytes, repeated: np.ndarray) -> tuple[int, int, str, np.ndarray, np.ndarray]:
    """(bytes removed, spans, SHA-256 of the rest, starts and ends of the spans) for repeated window starts."""
    cover = np.zeros(len(raw) + 1, np.int32)
    np.add.at(cover, repeated, 1)
    np.add.at(cover, repeated + LENGTH, -1)
    gone = np.cumsum(cover[:-1]) > 0
    rest = np.frombuffer(raw, np.uint8)[~gone].tobytes()
    edge = np.diff(gone.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    return int(gone.sum()), len(start), hashlib.sha256(rest).hexdigest(), start, end


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for t, k, none, sends, variants, open_ in zip(
                encode(pdf["t"]), pdf["k"], pdf["none"], pdf["sends"], pdf["states"], pdf["open"]):
            runs, state = Runs([t]), _state(variants)
            every = [runs.windows(np.flatnonzero(state >= FULL))]
            if open_ is not None and (state == OPEN).any():
                # the answers follow the order in which keys were sent
                sent = np.flatnonzero((state == OPEN) | (state == SENT) if sends else state == OPEN)
                every.append(runs.windows(sent)[np.frombuffer(open_, np.uint8) > 0])
            out.append((None if none else k, len(t), *_cut(t, np.concatenate(every))))
        yield _frame(out, ["k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "start", "end"])


def remove_repeats(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, spans), one row per document.

    ``spans`` holds the removed runs in order, as byte offsets (start, end exclusive); the bytes outside are kept.
    """
    p = partitions(docs)
    t = F.coalesce(F.col(text), F.lit(""))
    k = F.col(key).cast("long")
    rows = docs.select(F.coalesce(k, F.lit(0)).alias("k"), k.isNull().alias("none"), t.alias("t"),
                       F.unhex(F.md5(t)).alias("name"))
    states = cut_lineage(_run_states(rows, p)).withColumnRenamed("name", "name2")
    joined = rows.join(states, F.col("name") == F.col("name2"), "left").drop("name2")
    touched = F.col("states").isNotNull()
    # texts without a repeated core are done and leave their digest only
    joined = cut_lineage(joined.select(
        "k", "none", "name", "states",
        F.when(F.col("none"), F.lit(None)).otherwise(F.col("k")).eqNullSafe(F.col("first_id")).alias("sends"), n_bytes(F.col("t")).alias("n_bytes"),
        F.when(~touched, F.sha2("t", 256)).alias("kept_sha256"), F.when(touched, F.col("t")).alias("t")))
    some = joined.filter(touched)
    found = _suffix_states(some.select("t", "name", "sends", "states"), _splitters(rows, 2 * p), p)
    found = cut_lineage(found.groupBy(F.col("name").alias("name2")).agg(F.max("open").alias("open")))
    cut = some.join(found, F.col("name") == F.col("name2"), "left").select(
        "k", "none", "t", "sends", "states", "open")
    columns = "k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    cut = cut.mapInPandas(_finish, f"{columns}, start array<long>, end array<long>")
    cut = cut.select("k", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.arrays_zip("start", "end").alias("spans"))
    whole = joined.filter(~touched).select(
        F.when(~F.col("none"), F.col("k")).alias("k"), "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), "kept_sha256",
        F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))
    return whole.unionByName(cut).withColumnRenamed("k", key)
