"""Word and shingle hashes of many texts at once, in numpy.

The texts of a chunk are laid end to end; a word's hash is a polynomial over
its bytes, read off one running sum. Hashes are 64 bits; two different words
or shingles agree with probability 2^-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Text bytes handled at once; one longer text is a chunk of its own.
CHUNK = 1 << 18

_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)
_P_INV = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_K = _U(0xD1342543DE82EF95)

_byte = np.arange(256)
_ascii = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte)
#: Bytes that separate words: white space only, or all ASCII but letters and digits.
BLANK = np.isin(_byte, [32, 9, 10, 11, 12, 13])
PUNCT = (_byte < 128) & ~(((_ascii >= 97) & (_ascii <= 122)) | ((_byte >= 48) & (_byte <= 57)))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that any bits of them can be used."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_CODE = mix(_ascii.astype(_U) + _U(1))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse.

    Made anew for each chunk: a module that is pickled by value would carry a cache into every task.
    """
    both = []
    for base in (_P, _P_INV):
        p = np.full(n, base, _U)
        p[:1] = 1
        both.append(np.multiply.accumulate(p))
    return both[0], both[1]


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold ``limit`` bytes or one text."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def words(texts: list[bytes], gap: np.ndarray = BLANK,
          stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """(hash per word, first word of each text and the end), A-Z lower-cased.

    Each of ``stems`` adds an array: a hash of the word's first so many bytes.
    """
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    n = len(raw)
    part = gap[raw]
    part[ends - 1] = True
    edge = np.flatnonzero(np.diff(part.astype(np.int8), prepend=1, append=1))
    start, stop = edge[0::2], edge[1::2]
    p, inv = powers(n + 1)
    run = np.zeros(n + 1, _U)
    np.cumsum(_CODE[raw] * p[:n], out=run[1:])
    out = mix((run[stop] - run[start]) * inv[start] + (stop - start).astype(_U))
    first = np.searchsorted(start, np.concatenate([[0], ends]))
    cut = [mix((run[np.minimum(stop, start + k)] - run[start]) * inv[start] + _U(k * 0x9E3779B1)) for k in stems]
    return out, first, *cut


def shingles(w: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words; shorter by size - 1."""
    if len(w) < size:
        return np.empty(0, _U)
    h = w[: len(w) - size + 1].copy()
    for k in range(1, size):
        h = h * _K + w[k: len(w) - size + 1 + k]
    return mix(h + _U(size))


def shingle_sets(texts: list[bytes], size: int = 5) -> list[np.ndarray]:
    """Sorted distinct shingle hashes per text; a shorter text is one shingle."""
    w, first = words(texts)
    h, out = shingles(w, size), []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            s = np.sort(h[a: b - size + 1])
            keep = np.empty(len(s), bool)
            keep[0] = True
            np.not_equal(s[1:], s[:-1], out=keep[1:])
            out.append(s[keep])
        elif b > a:
            out.append(shingles(w[a:b], b - a))
        else:
            out.append(np.empty(0, _U))
    return out


def encode(texts) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [b"" if t is None or t != t else t.encode("utf-8", "surrogatepass") for t in texts]
