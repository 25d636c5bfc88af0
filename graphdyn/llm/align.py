"""Cross-tokenizer alignment by an associative monoid of fragments.

Two tokenizers split the same bytes. A byte offset where tokens of both start is a
*cut*; cuts part the tokens into groups. A *fragment* is what a byte range knows of
this: its tokens before the first cut (open prefix), closed groups, and its tokens
from the last cut on (open suffix); a range without a cut is all open. Fragments of
adjacent ranges compose: suffix and prefix join into one group, or into a longer
open part where one side has no cut. Composition is associative, so the fragments
of a document may be reduced in a tree, in any tasks.

1. *Units.* A text is cut before a blank between two other characters, at the first
   such place after every ``UNIT`` bytes: no token of either vocabulary spans it
   (``Pair.safe`` checks this for the vocabularies at hand, else texts stay whole), so
   tokens are those of the whole text. Units of long texts are spread over tasks.
2. *Fragments.* A unit's tokens fall, by the byte they start at, into ranges of
   ``RANGE`` bytes; each range is a fragment. Texts of one unit are reduced at once.
   Those of longer texts are composed ``FAN`` ranges at a time, level by level; a
   level moves only open parts, and sends the groups it closes straight to the result.
3. *Links.* In a group, the starts of both tokenizers together part its bytes into
   stretches; each is the overlap of exactly one token pair, so it is one link.
4. *Counts.* Short texts travel in packs. A pack sends each distinct id pair once,
   with the number of its documents that hold it; long texts send theirs one by one.
   Sums per pair, the highest per A id, and the way back to packs are joins.

Edge cases: null and empty texts, and texts that a tokenizer does not give back
byte for byte, have no tokens: zeros and an empty digest; they take no part in
counts; equal rows count as documents of their own; null keys pass through; special
tokens in texts are plain text; very long texts are never held as one row of tokens;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphdyn.llm.common import Sent, bound_batches, n_bytes, partitions
from graphdyn.session import cut_lineage

#: Bytes of a unit and of a fragment's range, ranges composed at once, bytes of texts in a pack.
UNIT, RANGE, FAN, PACK = 1 << 16, 1 << 14, 16, 4 << 20
#: Where the public vocabularies lie.
FOLDER = "/opt/tokenizers"

# Fixed value: how the byte-level vocabulary parts a text before merging
PATTERN = (r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
_safe = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")


# --- tokenizers ---------------------------------------------------------------

def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Pair:
    """Tokenizer A (byte-level merges, from JSON) and B (sentence pieces), with the bytes of every id."""

    def __init__(self, a: bytes, b: bytes):
        import sentencepiece
        import tiktoken
        table, of = json.loads(a), _byte_of()
        special = {t["content"] for t in table["added_tokens"]}
        vocab, merges = table["model"]["vocab"], table["model"]["merges"]
        ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if token not in special}
        joined = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if joined != sorted(joined) or table["normalizer"] or not table["pre_tokenizer"].get("use_regex"):
            raise ValueError("A must merge in the order of its ids and part texts by the usual pattern")
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i)
                                else piece.replace("▁", " ").encode())
        self.len_a = np.array([len(x) for x in self.bytes_a], np.int64)
        self.len_b = np.array([len(x) for x in self.bytes_b], np.int64)
        # a token with a blank after something that is none would span a place where texts are cut
        self.safe = not any(re.search(r"\S ", x.decode("utf-8", "replace")) for x in (*self.bytes_a, *self.bytes_b))

    def ids(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of both per text without its leading blank; None where the bytes are not given back."""
        out = []
        for text, b in zip(texts, self.b.encode(texts, num_threads=1) if texts else []):
            raw = b" " + text.encode("utf-8", "surrogatepass")
            a = self.a.encode_ordinary(" " + text)
            same = (b"".join(map(self.bytes_a.__getitem__, a)) == raw
                    and b"".join(map(self.bytes_b.__getitem__, b)) == raw)
            out.append((np.array(a, np.int32), np.array(b, np.int32)) if same else None)
        return out


def load(folder: str = FOLDER, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> tuple[bytes, bytes]:
    """The two vocabulary files; they go to the executors with the functions that use them."""
    found = []
    for name in (a, b):
        with open(os.path.join(folder, name), "rb") as file:
            found.append(file.read())
    return found[0], found[1]


def units(text: str, safe: bool, size: int = 0) -> list[tuple[int, str]]:
    """(offset in bytes, part) of a text with a leading blank; parts begin with a blank, which is not in them."""
    size = size or UNIT
    raw = text.encode("utf-8", "surrogatepass")
    if len(raw) <= size or not safe:
        return [(0, text)]
    out, start, at = [], 0, 0
    # a code point has at most four bytes, so a quarter of the size is never too far
    while True:
        m = _safe.search(text, start + size // 4)
        if m is None:
            return out + [(at, text[start:])]
        part = text[start: m.start()]
        out.append((at, part))
        at += len(part.encode("utf-8", "surrogatepass")) + 1
        start = m.end()


# --- fragments ----------------------------------------------------------------

class Fragment:
    """Tokens of a byte range as (start, id) arrays: those of prefix and suffix, and closed groups between."""

    __slots__ = ("cut", "prefix", "groups", "suffix")

    def __init__(self, cut: bool, prefix, groups, suffix):
        self.cut, self.prefix, self.groups, self.suffix = cut, prefix, groups, suffix

    @classmethod
    def of(cls, start_a, id_a, start_b, id_b) -> Fragment:
        """The fragment of the tokens that start in a range."""
        cuts = np.intersect1d(start_a, start_b, assume_unique=True)
        whole = Tokens(start_a, id_a, start_b, id_b)
        if not len(cuts):
            return cls(False, whole, Groups.none(), Tokens.none())
        return cls(True, whole.between(None, cuts[0]), Groups(whole.between(cuts[0], cuts[-1]), cuts[:-1]),
                   whole.between(cuts[-1], None))

    def then(self, other: Fragment) -> Fragment:
        """Composition with the fragment of the range that follows."""
        if not self.cut:
            if not other.cut:
                return Fragment(False, self.prefix + other.prefix, Groups.none(), Tokens.none())
            return Fragment(True, self.prefix + other.prefix, other.groups, other.suffix)
        if not other.cut:
            return Fragment(True, self.prefix, self.groups, self.suffix + other.prefix)
        return Fragment(True, self.prefix, self.groups + Groups.one(self.suffix + other.prefix) + other.groups, other.suffix)

    def closed(self) -> Groups:
        """All groups of a whole text, which begins and ends with a cut."""
        return self.groups + Groups.one(self.suffix) if self.cut else self.groups


class Tokens:
    """Tokens of both tokenizers in order, with the bytes they start at."""

    __slots__ = ("start_a", "id_a", "start_b", "id_b")

    def __init__(self, start_a, id_a, start_b, id_b):
        self.start_a, self.id_a, self.start_b, self.id_b = start_a, id_a, start_b, id_b

    @classmethod
    def none(cls) -> Tokens:
        return cls(*(np.empty(0, kind) for kind in (np.int64, np.int32) * 2))

    def __add__(self, other: Tokens) -> Tokens:
        return Tokens(*(np.concatenate([getattr(self, n), getattr(other, n)]) for n in self.__slots__))

    def between(self, low, high) -> Tokens:
        cut = lambda s: slice(0 if low is None else np.searchsorted(s, low),
                              len(s) if high is None else np.searchsorted(s, high))
        a, b = cut(self.start_a), cut(self.start_b)
        return Tokens(self.start_a[a], self.id_a[a], self.start_b[b], self.id_b[b])


class Groups:
    """Closed groups in order: their tokens and the cuts at which they begin."""

    __slots__ = ("tokens", "cuts")

    def __init__(self, tokens: Tokens, cuts: np.ndarray):
        self.tokens, self.cuts = tokens, cuts

    @classmethod
    def none(cls) -> Groups:
        return cls(Tokens.none(), np.empty(0, np.int64))

    @classmethod
    def one(cls, tokens: Tokens) -> Groups:
        return cls(tokens, tokens.start_a[:1])

    def __add__(self, other: Groups) -> Groups:
        if not len(self.cuts) or not len(other.cuts):
            return other if len(other.cuts) else self
        return Groups(self.tokens + other.tokens, np.concatenate([self.cuts, other.cuts]))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """A ids and B ids of the overlapping pairs, in order of the bytes they share.

        A run of groups without a gap is read at once: each of its stretches between
        starts lies in the last token of either tokenizer that starts before its end.
        """
        t = self.tokens
        at = np.union1d(t.start_a, t.start_b)
        return (t.id_a[np.searchsorted(t.start_a, at, "right") - 1],
                t.id_b[np.searchsorted(t.start_b, at, "right") - 1])

    def text(self, names: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``; ``names`` holds ids as text followed by a comma, a bar and a semicolon."""
        t, n = self.tokens, len(self.cuts)
        if not n:
            return ""
        first_a, first_b = np.searchsorted(t.start_a, self.cuts), np.searchsorted(t.start_b, self.cuts)
        of_a, of_b = np.zeros(len(t.id_a), np.int64), np.zeros(len(t.id_b), np.int64)
        of_a[np.append(first_a[1:], len(t.id_a)) - 1] = 1
        of_b[np.append(first_b[1:], len(t.id_b)) - 1] = 2
        size_a, size_b = np.diff(np.append(first_a, len(t.id_a))), np.diff(np.append(first_b, len(t.id_b)))
        # a group's A tokens come after all B tokens of the groups before it, and the other way round
        place_a = np.arange(len(t.id_a)) + np.repeat(np.cumsum(size_b) - size_b, size_a)
        place_b = np.arange(len(t.id_b)) + np.repeat(np.cumsum(size_a), size_b)
        out = np.empty(len(t.id_a) + len(t.id_b), object)
        out[place_a], out[place_b] = names[of_a, t.id_a], names[of_b, t.id_b]
        return "".join(out.tolist())[:-1]


def _names(n: int) -> np.ndarray:
    return np.array([[f"{i}{end}" for i in range(n)] for end in ",|;"], object)


def fragments(ids: tuple[np.ndarray, np.ndarray], at: int, len_a: np.ndarray, len_b: np.ndarray,
              size: int = 0) -> Iterator[tuple[int, Fragment]]:
    """(range, fragment) of a unit's tokens, whose first byte is ``at``, in order."""
    size = size or RANGE
    starts = []
    for each, length in zip(ids, (len_a, len_b)):
        n = length[each]
        starts.append(at + np.cumsum(n) - n)
    (a, b), (id_a, id_b) = starts, ids
    end = at + int(len_a[id_a].sum())
    for r in range(at // size, max(at, end - 1) // size + 1):
        lo, hi = np.searchsorted(a, [r * size, (r + 1) * size]), np.searchsorted(b, [r * size, (r + 1) * size])
        yield r, Fragment.of(a[lo[0]:lo[1]], id_a[lo[0]:lo[1]], b[hi[0]:hi[1]], id_b[hi[0]:hi[1]])


def reduce(parts: list[Fragment]) -> Fragment:
    """Composition of adjacent fragments, halves first."""
    while len(parts) > 1:
        parts = [parts[i].then(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def _codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a.astype(np.int64) << 32 | b.astype(np.int64)


def _pairs(groups: Groups) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct id pairs as codes, how often each is linked, and the number of links."""
    codes, times = np.unique(_codes(*groups.links()), return_counts=True)
    return codes, times, int(times.sum())


# --- short texts, in packs ------------------------------------------------------

_DOC = "ids binary, none binary, sizes binary, digests binary, held binary, entries binary, times binary"
_PACK = f"pack long, codes array<long>, n array<int>, {_DOC}"


def _pack_rows(sent: Sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext
        pack, pair = TaskContext.get().partitionId() << 32, Pair(*sent.value)
        names = _names(max(len(pair.bytes_a), len(pair.bytes_b)))
        for pdf in batches:
            texts, size = pdf["t"].tolist(), pdf["size"].to_numpy(np.int64)
            part = (np.cumsum(size) - size) // PACK
            for p in np.unique(part):
                at = np.flatnonzero(part == p)
                yield _pack(pack, [texts[i] for i in at], pdf["k"].to_numpy(np.int64)[at],
                            pdf["none"].to_numpy(bool)[at], pair, names)
                pack += 1

    return run


def _pack(pack: int, texts: list[str], ids: np.ndarray, none: np.ndarray, pair: Pair, names: np.ndarray) -> pd.DataFrame:
    sizes, digests, codes, times = np.zeros((len(texts), 4), np.int64), [], [], []
    for i, found in enumerate(pair.ids(texts)):
        if not texts[i] or found is None:
            digests.append(bytes(32))
            codes.append(np.empty(0, np.int64))
            times.append(np.empty(0, np.int64))
            continue
        whole = reduce([f for _, f in fragments(found, 0, pair.len_a, pair.len_b)]).closed()
        code, n, links = _pairs(whole)
        sizes[i] = len(found[0]), len(found[1]), len(whole.cuts), links
        digests.append(hashlib.sha256(whole.text(names).encode()).digest())
        codes.append(code)
        times.append(n)
    every, entries, n = np.unique(np.concatenate(codes), return_inverse=True, return_counts=True)
    held = np.array([len(c) for c in codes], np.int32)
    # a text's entries are in order, so their steps are small and compress well
    first = np.zeros(len(entries), bool)
    first[(np.cumsum(held) - held)[held > 0]] = True
    steps = np.where(first, entries, np.diff(entries, prepend=0)).astype(np.uint32)
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return pd.DataFrame([(pack, every, n.astype(np.int32), ids.tobytes(), none.tobytes(), sizes.tobytes(),
                          b"".join(digests), held.tobytes(), squeeze(steps.tobytes()),
                          squeeze(np.concatenate(times).astype(np.uint32).tobytes()))],
                        columns=["pack", "codes", "n", "ids", "none", "sizes", "digests", "held", "entries", "times"])


_OUT = ("k long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per text of each pack, from the counts of its pairs."""
    expand = zstandard.ZstdDecompressor().decompress
    for pdf in batches:
        for row in pdf.itertuples():
            ids, none = np.frombuffer(row.ids, np.int64), np.frombuffer(row.none, bool)
            sizes, held = np.frombuffer(row.sizes, np.int64).reshape(-1, 4), np.frombuffer(row.held, np.int32)
            steps = np.frombuffer(expand(row.entries), np.uint32).astype(np.int64)
            times = np.frombuffer(expand(row.times), np.uint32).astype(np.int64)
            doc = np.repeat(np.arange(len(ids)), held)
            # entries are sums of steps, begun anew at each text
            run = np.cumsum(steps)
            begin = np.cumsum(held) - held
            before = np.where(begin > 0, run[np.maximum(begin - 1, 0)], 0) if len(run) else np.zeros(len(ids), np.int64)
            entry = run - before[doc]
            counts = np.zeros((len(ids), 2), np.int64)
            if len(entry):
                total, best = np.asarray(row.totals, np.int64), np.asarray(row.bests, bool)
                np.add.at(counts, doc, np.stack([times * best[entry], times * total[entry]], 1))
            yield pd.DataFrame({
                "k": pd.array([None if x else k for k, x in zip(ids.tolist(), none)], "Int64"),
                "n_a": sizes[:, 0], "n_b": sizes[:, 1], "n_groups": sizes[:, 2], "n_links": sizes[:, 3],
                "n_best": counts[:, 0], "count_sum": counts[:, 1],
                "groups_sha256": [row.digests[32 * i: 32 * i + 32].hex() if n else "" for i, n in enumerate(sizes[:, 0])]})


# --- long texts, in units ---------------------------------------------------------

_TOKENS = ("start_a", "id_a", "start_b", "id_b")
_OPEN = ", ".join(f"{side}_{name} binary" for side in ("prefix", "suffix") for name in _TOKENS)
_CLOSED = "at long, text string, n_groups long, n_links long, codes array<long>, times array<int>"
_PIECE = f"uid long, k long, none boolean, bad boolean, n_a long, n_b long, range long, unit long, cut boolean, {_OPEN}, {_CLOSED}"


def _open_row(f: Fragment) -> dict:
    return {"cut": f.cut} | {f"{side}_{n}": getattr(getattr(f, side), n).tobytes()
                             for side in ("prefix", "suffix") for n in _TOKENS}


def _open_fragment(row) -> Fragment:
    kinds = dict(zip(_TOKENS, (np.int64, np.int32) * 2))
    side = lambda s: Tokens(*(np.frombuffer(getattr(row, f"{s}_{n}"), kinds[n]) for n in _TOKENS))
    return Fragment(row.cut, side("prefix"), Groups.none(), side("suffix"))


def _closed_row(groups: Groups, names: np.ndarray) -> dict:
    if not len(groups.cuts):
        return {}
    codes, times, links = _pairs(groups)
    return {"at": int(groups.cuts[0]), "text": groups.text(names), "n_groups": len(groups.cuts), "n_links": links,
            "codes": codes, "times": times.astype(np.int32)}


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    # missing values stay None, also beside arrays
    out = pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in columns})
    whole = [c for c in ("at", "n_groups", "n_links", "n_a", "n_b", "range", "unit") if c in out]
    return out.astype({c: "Int64" for c in whole} | ({"cut": "boolean"} if "cut" in out else {}))


def _unit_rows(sent: Sent):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = Pair(*sent.value)
        for pdf in batches:
            for row in pdf.itertuples():
                for at, part in units(row.t, pair.safe):
                    yield pd.DataFrame([(row.uid, row.k, row.none, at, part)], columns=["uid", "k", "none", "unit", "t"])

    return run


def _piece_rows(sent: Sent):
    columns = [c.split()[0] for c in _PIECE.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair = Pair(*sent.value)
        names = _names(max(len(pair.bytes_a), len(pair.bytes_b)))
        for pdf in batches:
            for row in pdf.itertuples():
                own = {"uid": row.uid, "k": row.k, "none": row.none, "bad": False, "unit": row.unit}
                found = pair.ids([row.t])[0]
                if found is None:
                    yield _frame([own | {"bad": True}], columns)
                    continue
                rows = [own | {"range": r} | _open_row(f) | _closed_row(f.groups, names)
                        for r, f in fragments(found, row.unit, pair.len_a, pair.len_b)]
                rows[0] |= {"n_a": len(found[0]), "n_b": len(found[1])}
                yield _frame(rows, columns)

    return run


def _composed(open_: DataFrame, sent: Sent, span: int, top: bool) -> DataFrame:
    """One fragment for each ``span`` ranges of a text and rows for the groups this closes; at the top all are closed."""
    schema = f"uid long, range long, unit long, cut boolean, {_OPEN}, {_CLOSED}"
    columns = [c.split()[0] for c in schema.split(", ")]

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pair_sizes = sent.value
        names = _names(pair_sizes)
        pdf = pdf.sort_values(["range", "unit"])
        found = reduce([_open_fragment(r) for r in pdf.itertuples()])
        groups = found.closed() if top else found.groups
        own = {"uid": pdf["uid"].iat[0]}
        starts = list(groups.cuts) + [None]
        # the groups closed here lie apart, so each is a row of its own
        rows = [own | _closed_row(Groups(groups.tokens.between(a, b), np.array([a])), names)
                for a, b in zip(starts, starts[1:])]
        if not top:
            rows.append(own | {"range": pdf["range"].iat[0], "unit": pdf["unit"].iat[0]} | _open_row(found))
        return _frame(rows, columns)

    part = F.floor(F.col("range") / span).alias("part")
    return open_.groupBy("uid", part).applyInPandas(compose, schema)


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of the texts of one document, in order, one row per document; holds one row at a time."""
    uid, digest = None, None
    for pdf in batches:
        for row in pdf.itertuples():
            if row.uid != uid:
                if uid is not None:
                    yield pd.DataFrame({"uid": [uid], "groups_sha256": [digest.hexdigest()]})
                uid, digest = row.uid, hashlib.sha256()
            else:
                digest.update(b";")
            digest.update(row.text.encode())
    if uid is not None:
        yield pd.DataFrame({"uid": [uid], "groups_sha256": [digest.hexdigest()]})


def _long(rows: DataFrame, sent: Sent, most: int, p: int) -> tuple[DataFrame, DataFrame]:
    """((uid, k, sizes, digest) per long text, (uid, code, times) per text and id pair), both written."""
    parts = rows.withColumn("uid", F.monotonically_increasing_id()).mapInPandas(
        _unit_rows(sent), "uid long, k long, none boolean, unit long, t string")
    # units of one text go to different tasks
    pieces = cut_lineage(parts.repartition(p, "uid", "unit").mapInPandas(_piece_rows(sent), _PIECE))
    texts = pieces.groupBy("uid").agg(F.first("k").alias("k"), F.first("none").alias("none"), F.max("bad").alias("bad"),
                                      F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b"))
    texts = cut_lineage(texts)
    good = pieces.join(texts.filter("bad").select("uid"), "uid", "left_anti")
    closed_columns = ["uid", *(c.split()[0] for c in _CLOSED.split(", "))]
    closed = good.filter(F.col("at").isNotNull()).select(closed_columns)
    open_, span = good.drop(*closed_columns[1:], "k", "none", "bad", "n_a", "n_b"), 1
    sizes = Sent(rows.sparkSession, max(Pair(*sent.value).b.get_piece_size(), len(Pair(*sent.value).bytes_a)))
    while True:
        span *= FAN
        top = span * RANGE > most + 1
        level = cut_lineage(_composed(open_, sizes, span, top))
        closed = closed.unionByName(level.filter(F.col("at").isNotNull()).select(closed_columns))
        if top:
            break
        open_ = level.filter(F.col("at").isNull()).drop(*closed_columns[1:])
    pairs = closed.select("uid", F.explode(F.arrays_zip("codes", "times")).alias("x")).groupBy(
        "uid", F.col("x.codes").alias("code")).agg(F.sum("x.times").alias("times"))
    digests = closed.select("uid", "at", "text").repartition(p, "uid").sortWithinPartitions("uid", "at").mapInPandas(
        _digests, "uid long, groups_sha256 string")
    sums = closed.groupBy("uid").agg(F.sum("n_groups").alias("n_groups"), F.sum("n_links").alias("n_links"))
    zero = lambda c: F.when(F.col("bad"), F.lit(0)).otherwise(F.col(c)).cast("long").alias(c)
    known = texts.join(sums, "uid", "left").join(digests, "uid", "left").select(
        "uid", F.when(~F.col("none"), F.col("k")).alias("k"), *(zero(c) for c in ("n_a", "n_b", "n_groups", "n_links")),
        F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    return cut_lineage(known), cut_lineage(pairs)


def align(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabularies: tuple[bytes, bytes] | None = None) -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per document.

    ``vocabularies`` are the two files' bytes, by default ``load()``.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sent, p = Sent(spark, vocabularies or load()), partitions(docs)
    t, k = F.coalesce(F.col(text), F.lit("")), F.col(key).cast("long")
    rows = docs.select(F.coalesce(k, F.lit(0)).alias("k"), k.isNull().alias("none"), t.alias("t"),
                       n_bytes(t).alias("size"))
    most = rows.agg(F.max("size")).first()[0] or 0
    packs = cut_lineage(rows.filter(F.col("size") <= UNIT).mapInPandas(_pack_rows(sent), _PACK))
    pairs = packs.select("pack", F.posexplode(F.arrays_zip("codes", "n")).alias("i", "x")).select(
        "pack", "i", F.col("x.codes").alias("code"), F.col("x.n").alias("n"))
    every = pairs.select("code", "n")
    if most > UNIT:
        texts, held = _long(rows.filter(F.col("size") > UNIT), sent, most, p)
        every = every.unionByName(held.select("code", F.lit(1).alias("n")))
    counts = every.groupBy("code").agg(F.sum("n").alias("total"))
    first = F.shiftright("code", 32).alias("a")
    counts = cut_lineage(counts)
    best = counts.groupBy(first).agg(F.max("total").alias("top"))
    counts = cut_lineage(counts.withColumn("a", first).join(best, "a").select(
        "code", "total", (F.col("total") == F.col("top")).alias("best")))
    back = pairs.join(counts, "code").groupBy("pack").agg(
        F.array_sort(F.collect_list(F.struct("i", "total", "best"))).alias("x"))
    back = back.select("pack", F.col("x.total").alias("totals"), F.col("x.best").alias("bests"))
    out = packs.drop("codes", "n").join(back, "pack", "left").mapInPandas(_unpack, _OUT)
    if most > UNIT:
        sums = held.join(counts, "code").groupBy("uid").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
            F.sum(F.col("times") * F.col("total")).alias("count_sum"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
        out = out.unionByName(texts.join(sums, "uid", "left").select(
            "k", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256"))
    return out.withColumn("k", F.col("k").cast(dict(docs.dtypes)[key])).withColumnRenamed("k", key)
