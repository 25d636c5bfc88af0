"""Exact dedup over a cuckoo-filter index of live digests.

Texts are equal if they agree after each run of white space became one space;
the key is the SHA-256 of that text. The index is split by digest; each part is
a cuckoo filter (16-bit fingerprints, four to a bucket) beside the stored keys
of its buckets. A digest whose fingerprint the filter does not hold is new; a
hit is verified against the full digests stored under that fingerprint, so
false positives only cost a look. If a kick chain ends without a free slot, the
filter is rebuilt from the stored keys with twice the buckets.

Copies are first folded to one row per (digest, salt), so a group that holds a
third of all rows reaches the index as at most ``SALTS`` rows. A part holds
digests and numbers, no texts; there are as many parts as shuffle partitions.

Edge cases: null counts as the empty text; repeated rows count each time; a null
doc_id never stays if another copy has one. Rows with equal texts and one doc_id, or
none, are told apart by nothing, so those that carry the id that stays all count as
kept. Very long texts are digested whole; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphdyn.llm.common import SPACE, partitions
from graphdyn.session import cut_lineage

SALTS = 16
SLOTS = 4
KICKS = 200
_MIX = 0x5BD1E995


class CuckooIndex:
    """Live digests with a value each: filter slots and, per fingerprint, stored keys."""

    def __init__(self, n_buckets: int = 64):
        self.keys: dict[int, dict[bytes, object]] = {}
        self.n_keys = 0
        self.looks = 0
        self._reset(n_buckets)

    def _reset(self, n_buckets: int) -> None:
        self.mask = n_buckets - 1
        self.slots: list[list[int]] = [[] for _ in range(n_buckets)]

    @staticmethod
    def _tag(digest: bytes) -> int:
        """32 bits: the upper 16 choose a bucket, the lower 16 are the fingerprint, never 0."""
        word = int.from_bytes(digest[:6], "little")
        return (word >> 16) << 16 | (word & 0xFFFF or 1)

    def _homes(self, tag: int) -> tuple[int, int, int]:
        print_ = tag & 0xFFFF
        a = (tag >> 16) & self.mask
        return print_, a, (a ^ (print_ * _MIX)) & self.mask

    def maybe(self, digest: bytes) -> bool:
        """The filter's answer: False is certain, True may be wrong."""
        print_, a, b = self._homes(self._tag(digest))
        return print_ in self.slots[a] or print_ in self.slots[b]

    def get(self, digest: bytes):
        """The value of a live digest, else None; hits are verified against the stored keys."""
        if not self.maybe(digest):
            return None
        self.looks += 1
        return self.keys.get(self._tag(digest), {}).get(digest)

    def put(self, digest: bytes, value: object) -> None:
        tag = self._tag(digest)
        stored = self.keys.setdefault(tag, {})
        new = digest not in stored
        stored[digest] = value
        if not new:
            return
        self.n_keys += 1
        if len(stored) <= 2 * SLOTS and not self._place(tag):
            self._grow()

    def _place(self, tag: int) -> bool:
        print_, a, b = self._homes(tag)
        for home in (a, b):
            if len(self.slots[home]) < SLOTS:
                self.slots[home].append(print_)
                return True
        home = b
        for kick in range(KICKS):
            out = self.slots[home].pop(kick % SLOTS)
            self.slots[home].append(print_)
            print_, home = out, (home ^ (out * _MIX)) & self.mask
            if len(self.slots[home]) < SLOTS:
                self.slots[home].append(print_)
                return True
        return False

    def _grow(self) -> None:
        """Twice the buckets, filled again from the stored keys.

        Keys that share bucket bits and fingerprint have the same two homes at
        every size; beyond 2 * SLOTS of them only one fingerprint is kept, which
        answers for all, since ``maybe`` asks for presence only.
        """
        n = len(self.slots)
        while True:
            n *= 2
            self._reset(n)
            if all(self._place(tag) for tag, stored in self.keys.items()
                   for _ in range(min(len(stored), 2 * SLOTS))):
                return

    def delete(self, digest: bytes) -> bool:
        """Remove a live digest and one copy of its fingerprint; False if it was not live."""
        if not self.maybe(digest):
            return False
        tag = self._tag(digest)
        stored = self.keys.get(tag, {})
        if digest not in stored:
            return False
        crowded = len(stored) > 2 * SLOTS
        del stored[digest]
        self.n_keys -= 1
        if not stored:
            del self.keys[tag]
        if not crowded:
            print_, a, b = self._homes(tag)
            self.slots[a if print_ in self.slots[a] else b].remove(print_)
        return True

    def items(self) -> Iterator[tuple[bytes, object]]:
        for stored in self.keys.values():
            yield from stored.items()


def digests(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, digest binary): JVM functions only."""
    norm = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), SPACE, " ")
    return docs.select(F.col(key).alias("doc_id"), F.unhex(F.sha2(norm, 256)).alias("digest"))


def _index_part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    index = CuckooIndex()
    for pdf in batches:
        for digest, keep, n in zip(pdf["digest"], pdf["keep_id"], pdf["group_size"]):
            digest, keep = bytes(digest), None if pd.isna(keep) else int(keep)
            held = index.get(digest)
            if held is not None:
                both = [x for x in (keep, held[0]) if x is not None]
                keep, n = min(both, default=None), int(n) + held[1]
            index.put(digest, (keep, int(n)))
    rows, size = [], 20_000
    for digest, (keep, n) in index.items():
        rows.append((digest, keep, n))
        if len(rows) == size:
            yield _frame(rows)
            rows = []
    yield _frame(rows)


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["digest", "keep_id", "group_size"])
    return out.astype({"keep_id": "Int64", "group_size": "int64"})


def classes(keys: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) per live digest of keys (doc_id, digest)."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    folded = keys.groupBy("digest", salt.alias("salt")).agg(
        F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    parts = folded.drop("salt").repartition(partitions(keys), "digest")
    return parts.mapInPandas(_index_part, "digest binary, keep_id long, group_size long")


def _change_part(group: pd.DataFrame, state: pd.DataFrame) -> Iterator[tuple[bytes, int]]:
    index = CuckooIndex()
    for digest, doc in zip(state["digest"], state["doc_id"]):
        index.put(bytes(digest), int(doc))
    for digest, doc, op in zip(group["digest"], group["doc_id"], group["op"]):
        digest = bytes(digest)
        if op == "delete":
            index.delete(digest)
        elif index.get(digest) is None:
            index.put(digest, int(doc))
    yield from index.items()


def update_index(live: DataFrame, changes: DataFrame, n_parts: int = 256) -> DataFrame:
    """Live digests (digest, doc_id) after ordered changes (seq, op, digest, doc_id).

    ``op`` is insert (ignored while the digest is live) or delete. Parts are cut
    by digest; choose ``n_parts`` so that one part's live digests fit a task.
    """
    part = F.pmod(F.xxhash64("digest"), F.lit(n_parts)).alias("part")

    def step(state: pd.DataFrame, group: pd.DataFrame) -> pd.DataFrame:
        rows = list(_change_part(group.sort_values("seq"), state))
        return pd.DataFrame(rows, columns=["digest", "doc_id"]).astype({"doc_id": "int64"})

    old = live.select(part, "digest", "doc_id").groupBy("part")
    new = changes.select(part, "seq", "op", "digest", "doc_id").groupBy("part")
    return old.cogroup(new).applyInPandas(step, "digest binary, doc_id long")


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document.

    The first join is on digest with one row per digest on one side, so a hot
    digest can be split by the skew join.
    """
    keys = cut_lineage(digests(docs, text, key))
    groups = classes(keys).withColumnRenamed("digest", "d")
    out = keys.join(groups, F.col("digest") == F.col("d"))
    return out.select("doc_id", "keep_id", "group_size",
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                      F.lower(F.hex("digest")).alias("text_sha256"))
