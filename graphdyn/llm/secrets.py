"""Secret scans: fixed patterns plus dictionary-primed zstandard novelty.

Base spans come from three patterns. The method adds spans: a candidate is a
token of at least ``LEAST`` characters near a sensitive word that mixes digits or
inner capitals with letters. Its novelty is the
number of bytes by which the compressed text grows when the candidate follows
its surroundings, with the surroundings, the document's other identifiers and a
constant list as raw dictionary, per byte of the candidate. Prose and
identifiers that occur elsewhere compress to a few bytes; random strings do not.

Identifiers are the distinct runs of letters, digits and underscores of the whole
document. A candidate's dictionary gets those of its own that occur outside it
too, however far away, and those others that share ``PIECE`` bytes with it; of
identifiers with one piece in common the first ``HOLDERS`` are enough to hold it.

Each document is scanned whole and on its own, so work is linear in the text
and no state is shared. Offsets count code points, ends are exclusive.

Edge cases: null and empty texts have no spans; repeated rows each get theirs;
very long texts and tokens are scanned whole (the surroundings are the ``AROUND``
bytes on each side of a candidate); matches of one start are ordered by kind; an
empty table gives an empty result; columns named like the result move it to a
fresh name, others are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphdyn.llm.common import bound_batches, fresh
from graphdyn.llm.words import encode

# The three base patterns, their kinds in order, and least lengths
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]{24,}"
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

#: Words beside which a random string is suspect.
#: They may be part of a camelCase name and have a plural s.
SENSITIVE = (rb"(?:(?<![A-Za-z])|(?<=[a-z])(?=[A-Z]))"
             rb"(?i:passw(?:or)?d|pwd|secret|token|api_?key|private_?key|access_?key"
             rb"|client_?id|credential|authorization|bearer|signature|session_?id|cookie)s?"
             rb"(?:(?![A-Za-z])|(?<=[a-z])(?=[A-Z]))")
#: Names that code is made of; they prime every dictionary unless ``scan`` is given others.
IDENTIFIERS = (
    b"password passwd secret token api_key apikey access_key private_key client_id client_secret "
    b"authorization bearer signature session_id cookie username user_name credentials config settings "
    b"environment production development localhost example.com https://www. http:// index.html "
    b"import export default return function const static public private protected class interface "
    b"boolean string integer double float length_size count_index value_key name_type self_this null "
    b"true false none undefined exception handler request response controller service repository "
    b"factory manager provider listener callback parameter argument attribute property element "
    b"0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ ")
TOKEN = rb"[A-Za-z0-9+/_.=-]{12,}"
LEAST = 12
#: Bytes after and before a sensitive word in which candidates are looked for, and of the dictionary.
AFTER, BEFORE, AROUND = 80, 40, 1024
#: Bytes that make an identifier worth adding, and how many identifiers are kept for one such piece.
PIECE, HOLDERS = 5, 8
#: Least marginal compressed bytes per candidate byte.
NOVELTY = 0.55

_assign, _access, _hex = re.compile(ASSIGN, re.IGNORECASE), re.compile(ACCESS), re.compile(HEX)
_sensitive, _token = re.compile(SENSITIVE), re.compile(TOKEN)
_name = re.compile(rb"[A-Za-z0-9_]{%d,}" % PIECE)
_mixed = re.compile(rb"(?=.*[A-Za-z])(?=.*[0-9]|.*[a-z].*[A-Z])", re.DOTALL)


def base_spans(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind number, end) in bytes: leftmost matches per kind, short ones dropped.

    The patterns name ASCII only, so bytes of other characters never match and
    matching bytes is matching text.
    """
    out, low = [], raw.lower()
    if any(w in low for w in ASSIGN_WORDS):
        out += [(m.start(), 0, m.end()) for m in _assign.finditer(raw)
                if m.end(2) - m.start(2) >= LEAST_ASSIGN]
    if b"AKIA" in raw:
        out += [(m.start(), 1, m.end()) for m in _access.finditer(raw)
                if m.end() - m.start() >= LEAST_ACCESS]
    return out + [(m.start(), 2, m.end()) for m in _hex.finditer(raw)]


def _pieces(part: bytes) -> set[bytes]:
    return {part[i: i + PIECE] for i in range(len(part) - PIECE + 1)}


class Names:
    """The identifiers of a document, looked up by what they share with its candidates."""

    def __init__(self, raw: bytes, candidates: list[tuple[int, int]]):
        self.times = Counter(_name.findall(raw))
        asked = set().union(*(_pieces(raw[s:e]) for s, e in candidates))
        self.holders: dict[bytes, list[bytes]] = {}
        for name in self.times:
            for p in _pieces(name) & asked:
                held = self.holders.setdefault(p, [])
                if len(held) < HOLDERS:
                    held.append(name)

    def beside(self, part: bytes) -> bytes:
        """Those that occur outside the candidate ``part`` and may match it; its own come last."""
        inside = Counter(_name.findall(part))
        near = {n for p in _pieces(part) for n in self.holders.get(p, ()) if n not in inside}
        own = [n for n in inside if self.times[n] > inside[n]]
        return b" ".join([*sorted(near), *own, b""])


def novelty(raw: bytes, start: int, end: int, identifiers: bytes = IDENTIFIERS, names: bytes = b"") -> float:
    """Marginal compressed bytes of raw[start:end] per byte, given its surroundings and ``names``."""
    before, after = raw[max(0, start - AROUND): start], raw[end: end + AROUND]
    primed = zstandard.ZstdCompressionDict(identifiers + names + after + before,
                                           dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    size = lambda part: len(zstandard.ZstdCompressor(
        level=3, dict_data=primed, write_checksum=False, write_content_size=False,
        write_dict_id=False).compress(part))
    near = raw[max(0, start - 64): start]
    return (size(near + raw[start:end]) - size(near)) / (end - start)


def _is_name(raw: bytes, start: int, end: int) -> bool:
    """Whether the token is a sensitive word in a camelCase name, and so no secret itself."""
    return raw[start:end].isalpha() and _sensitive.search(raw, start, end) is not None


def novel_spans(raw: bytes, taken: list[tuple[int, int, int]],
                identifiers: bytes = IDENTIFIERS) -> list[tuple[int, int, int]]:
    """Candidates near sensitive words that do not touch ``taken`` and do not compress."""
    words = [m.span() for m in _sensitive.finditer(raw)]
    if not words:
        return []
    tokens = [t.span() for t in _token.finditer(raw)]
    first, found = 0, {}
    for s, e in words:
        # tokens and words are in order, so those that end before this word's surroundings are done
        while first < len(tokens) and tokens[first][1] <= s - BEFORE:
            first += 1
        for start, end in islice(tokens, first, None):
            if start >= e + AFTER:
                break
            if _mixed.match(raw, start, end) and not _is_name(raw, start, end):
                found[start] = end
    open_ = [(start, end) for start, end in sorted(found.items())
             if not any(start < e and s < end for s, _, e in taken)]
    if not open_:
        return []
    names = Names(raw, open_)
    return [(start, 3, end) for start, end in open_
            if novelty(raw, start, end, identifiers, names.beside(raw[start:end])) >= NOVELTY]


def spans(raw: bytes, identifiers: bytes = IDENTIFIERS) -> list[tuple[int, int, int]]:
    """All spans (start, kind number, end) in code points, by start, then kind."""
    base = base_spans(raw)
    every = sorted(base + novel_spans(raw, base, identifiers))
    if every:
        # code points before each byte
        points = np.zeros(len(raw) + 1, np.int64)
        lead = np.frombuffer(raw, np.uint8)
        np.cumsum((lead & 0xC0) != 0x80, out=points[1:])
        every = [(int(points[s]), k, int(points[e])) for s, k, e in every]
    return every


def added(docs: DataFrame) -> list[str]:
    return fresh(docs, "spans")


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = (),
         identifiers: bytes = IDENTIFIERS) -> DataFrame:
    """``keep`` columns and an array of (kind, start, end) under a fresh name (``added``).

    ``identifiers`` are known names, parted by blanks, that are never novel.
    """
    bound_batches(docs.sparkSession)
    (name,), (t,) = added(docs), fresh(docs, "t")
    rows = docs.select(*dict.fromkeys(keep), F.col(text).alias(t))
    schema = [f"`{n}` {k}" for n, k in rows.drop(t).dtypes]
    schema.append(f"`{name}` array<struct<kind:string,start:long,end:long>>")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(raw, identifiers)]
                     for raw in encode(pdf[t])]
            yield pdf.drop(columns=t).assign(**{name: found})

    return rows.mapInPandas(run, ", ".join(schema))
