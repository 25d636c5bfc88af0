"""Language ID with bit-sliced Bloom filters over character n-grams.

One table serves all languages: row r holds a bit per language. An n-gram is
looked up at ``HASHES`` rows; the bitwise AND gives every language whose filter
holds it. A document's count per language is its number of hits (a popcount per
bit), corrected for the false positives that the filter's fill makes likely; the
largest decides. The score is its share, after n-grams that every language
holds (a passage that all sources repeat) are taken off all counts.

Learning: n-grams are counted per language over a bounded sample of labelled
documents (``TRAIN_DOCS`` per language, drawn by hash of the key). A language's
filter takes an n-gram that makes up at least ``MIN_SHARE`` of its n-grams, so
at most 1 / MIN_SHARE of them, and at least ``RATIO`` of the largest such share
in any language. Table size therefore does not grow with the corpus.

Rejecting: the learned rows also give each language's floor, ``FLOOR`` times the
share of known n-grams that all but ``LOWEST`` of its rows reach. ``accept`` drops
a text whose corrected share lies below its language's floor by more than its
number of n-grams explains. N-grams that languages share count as known, so shared
passages stay, as do texts of too few n-grams to tell.

Edge cases: null texts and texts without a letter are ``und`` with score 0; ties
go to the first language by name; a text with letters but no hit gets the most
frequent label with score 0; without labelled rows every text is ``und`` and none is
rejected; a key that repeats is learned from once; very long texts are read whole; an
empty table gives an empty result; columns named like a result move it to a fresh
name, other columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphdyn.llm.common import TEXT_BATCH, Sent, bound_batches, fresh, unit_hash
from graphdyn.llm.words import mix
from graphdyn.session import cut_lineage

SIZES = (3, 4)
HASHES = 3
TRAIN_DOCS = 1500
MIN_SHARE = 1e-5
RATIO = 0.2
UNKNOWN = "und"
LOWEST, FLOOR = 0.01, 0.5
#: Standard errors that a share must lie below its floor.
ERRORS = 2.0
_U = np.uint64
_K = _U(0xD1342543DE82EF95)
#: Code points handled at once; one longer text is a chunk of its own.
_CHARS = 1 << 16


def _is_letter(cp: np.ndarray) -> np.ndarray:
    # judged once per distinct code point, of which a chunk has few
    seen = np.zeros(0x110000, bool)
    seen[cp] = True
    which = np.flatnonzero(seen)
    seen[which] = np.fromiter((chr(i).isalpha() for i in which.tolist()), bool, len(which))
    return seen[cp]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > _CHARS:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def grams(texts: list[str]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Per n-gram size (hashes, document numbers), and which texts have a letter.

    Letters are lower-cased; each run of anything else is one blank. N-grams may
    hold blanks but do not cross documents.
    """
    flat = "\x00".join(t.lower() for t in texts) + "\x00"
    cp = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    # a null character inside a text is a blank; document ends are known by length
    ends = np.cumsum([len(t.lower()) + 1 for t in texts]) - 1
    doc = np.zeros(len(cp), np.int32)
    doc[ends[:-1] + 1] = 1
    doc = np.cumsum(doc, dtype=np.int32)
    letter = _is_letter(cp)
    has = np.bincount(doc[letter], minlength=len(texts)) > 0
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    x = np.where(letter, cp, 0).astype(_U)[keep]
    doc = doc[keep]
    out = []
    for n in SIZES:
        if len(x) < n:
            out.append((np.empty(0, _U), np.empty(0, np.int32)))
            continue
        m = len(x) - n + 1
        h = x[:m].copy()
        for k in range(1, n):
            h = h * _K + x[k: m + k]
        same = doc[:m] == doc[n - 1:]
        out.append((mix(h[same] * _K + _U(n)), doc[:m][same]))
    return out, has


class Filter:
    """The bit-sliced table and what is needed to read it."""

    def __init__(self, langs: list[str], gram: np.ndarray, lang: np.ndarray, usual: int = 0):
        self.langs, self.words, self.usual = langs, max(1, -(-len(langs) // 64)), usual
        most = np.bincount(lang, minlength=1).max() if len(lang) else 1
        self.bits = max(12, int(np.ceil(np.log2(4.0 * HASHES * max(1, most)))))
        # few languages need few bits; every worker holds the table
        kind = np.min_scalar_type((1 << min(64, max(1, len(langs)))) - 1)
        self.table = np.zeros((self.words, 1 << self.bits), kind)
        for row in self._rows(gram):
            np.bitwise_or.at(self.table, (lang // 64, row), (_U(1) << (lang % 64).astype(_U)).astype(kind))
        fill = [(self.table[i // 64] >> _U(i % 64) & _U(1)).mean() for i in range(len(langs))]
        self.false = np.array(fill) ** HASHES
        self.floor = np.zeros(len(langs))

    def _rows(self, gram: np.ndarray) -> Iterator[np.ndarray]:
        """Row numbers by double hashing."""
        mask, step = _U((1 << self.bits) - 1), (gram >> _U(32)) | _U(1)
        for k in range(HASHES):
            yield ((gram + _U(k) * step) & mask).astype(np.int64)

    def contained(self, gram: np.ndarray) -> list[np.ndarray]:
        """Per word of 64 languages the bitmask of those that contain each n-gram."""
        out: list[np.ndarray] = [None] * self.words
        for row in self._rows(gram):
            for w in range(self.words):
                got = self.table[w][row]
                out[w] = got if out[w] is None else out[w] & got
        return out

    def _everywhere(self, masks: list[np.ndarray]) -> np.ndarray:
        every = np.ones(len(masks[0]), bool)
        for w, mask in enumerate(masks):
            full = _U((1 << min(64, len(self.langs) - 64 * w)) - 1)
            every &= mask & full == full
        return every

    def _measure(self, texts: list[str]) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per chunk: place, n-grams looked up, corrected hits per language, n-grams of all languages, has a letter."""
        for a, b in _chunks(texts):
            found, has = grams(texts[a:b])
            n, total = b - a, np.zeros(b - a)
            hits, common = np.zeros((len(self.langs), n)), np.zeros(n)
            for gram, doc in found:
                total += np.bincount(doc, minlength=n)
                masks = self.contained(gram)
                if len(self.langs) > 1:
                    common += np.bincount(doc[self._everywhere(masks)], minlength=n)
                for i in range(len(self.langs)):
                    held = (masks[i // 64] >> _U(i % 64)) & _U(1)
                    hits[i] += np.bincount(doc[held.astype(bool)], minlength=n)
            true = np.maximum(0, (hits - total * self.false[:, None]) / (1 - self.false[:, None]))
            yield slice(a, b), total, true, common, has

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        langs, scores = [], np.zeros(len(texts))
        for at, _, true, common, has in self._measure(texts):
            best = np.where(true.any(0), true.argmax(0), self.usual)
            own = np.maximum(0, true - common)
            scores[at] = np.where(has, own.max(0) / np.maximum(own.sum(0), 1e-300), 0.0)
            langs += [self.langs[j] if h else UNKNOWN for j, h in zip(best, has)]
        return langs, scores

    def known(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Per text: n-grams looked up, the best language's corrected share of them, that language, has a letter."""
        total, share = np.zeros(len(texts)), np.zeros(len(texts))
        lang, letter = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        for at, n, true, _, has in self._measure(texts):
            total[at], letter[at] = n, has
            share[at] = true.max(0) / np.maximum(n, 1)
            lang[at] = np.where(true.any(0), true.argmax(0), self.usual)
        return total, share, lang, letter

    def accepts(self, texts: list[str]) -> np.ndarray:
        """Which texts have a language; all, if none is known."""
        if not self.langs:
            return np.ones(len(texts), bool)
        total, share, lang, letter = self.known(texts)
        floor = self.floor[lang]
        # a letter is part of sum(SIZES) n-grams, so these are not independent
        error = np.sqrt(floor * (1 - floor) * sum(SIZES) / np.maximum(total, 1))
        return letter & (share >= floor - ERRORS * error)


def fit(rows: DataFrame, text: str, lang: str, key: str, train_docs: int = TRAIN_DOCS) -> Filter:
    """Learn from labelled ``rows``; counts come back per kept (language, n-gram)."""
    bound_batches(rows.sparkSession, TEXT_BATCH)
    rows = rows.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter(
        F.col("l").isNotNull() & F.col("t").isNotNull())
    sizes = {r["l"]: r["count"] for r in rows.groupBy("l").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return Filter([], np.empty(0, _U), np.empty(0, np.int64))
    number = rows.sparkSession.createDataFrame(
        [(name, i, min(1.0, train_docs / sizes[name])) for i, name in enumerate(langs)],
        "l string, i int, share double")
    # one row per language; a joined shuffle would move every text
    sample = rows.join(F.broadcast(number), "l").filter(unit_hash("language", F.col("k")) < F.col("share"))
    # a key is drawn with all its rows, so it counts once
    sample = cut_lineage(sample.groupBy("i", "k").agg(F.min("t").alias("t")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i, part in pdf.groupby("i"):
                texts = part["t"].tolist()
                for a, b in _chunks(texts):
                    both = np.concatenate([g for g, _ in grams(texts[a:b])[0]])
                    gram, n = np.unique(both, return_counts=True)
                    yield pd.DataFrame({"i": i, "gram": gram.view(np.int64), "n": n})

    counted = sample.select("i", "t").mapInPandas(count, "i int, gram long, n long")
    counted = counted.groupBy("i", "gram").agg(F.sum("n").alias("n"))
    total = counted.groupBy("i").agg(F.sum("n").alias("total"))
    share = counted.join(total, "i").select("i", "gram", (F.col("n") / F.col("total")).alias("share"))
    share = share.filter(F.col("share") >= MIN_SHARE)
    top = share.groupBy("gram").agg(F.max("share").alias("top"))
    kept = share.join(top, "gram").filter(F.col("share") >= RATIO * F.col("top")).select("i", "gram").toPandas()
    model = Filter(langs, kept["gram"].to_numpy(np.int64).view(_U), kept["i"].to_numpy(np.int64),
                   usual=max(range(len(langs)), key=lambda i: sizes[langs[i]]))
    shared = Sent(rows.sparkSession, model)

    def known(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, share, _, letter = shared.value.known(pdf["t"].tolist())
            yield pd.DataFrame({"i": pdf["i"], "share": share})[letter & (n > 0)]

    shares = sample.select("i", "t").mapInPandas(known, "i int, share double")
    for r in shares.groupBy("i").agg(F.percentile("share", F.lit(LOWEST)).alias("low")).collect():
        model.floor[r["i"]] = FLOOR * r["low"]
    return model


def predict(docs: DataFrame, model: Filter, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns of ``docs`` with lang_pred and score under fresh names (``added``)."""
    bound_batches(docs.sparkSession, TEXT_BATCH)
    shared = Sent(docs.sparkSession, model)
    pred, score = added(docs)
    columns = list(dict.fromkeys(keep))
    t, = fresh(docs, "t")
    rows = docs.select(*columns, F.col(text).alias(t))
    schema = ", ".join(f"`{n}` {k}" for n, k in rows.drop(t).dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for i in range(0, len(whole), 1000):  # small frames out, as they may carry texts
                pdf = whole.iloc[i: i + 1000]
                langs, scores = shared.value.predict([x if isinstance(x, str) else "" for x in pdf[t]])
                yield pdf.drop(columns=t).assign(**{pred: langs, score: scores})

    return rows.mapInPandas(run, f"{schema + ', ' if schema else ''}`{pred}` string, `{score}` double")


def accept(docs: DataFrame, model: Filter, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that have a language (``Filter.accepts``).

    A low score rejects nothing: a passage that all languages share, or a second
    language in a text, lowers it without making the text unusable.
    """
    if not model.langs:
        return docs
    shared = Sent(docs.sparkSession, model)
    at = docs.columns.index(text)

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):  # small frames out, as they carry texts
                part = whole.slice(i, 1000)
                kept = shared.value.accepts([x or "" for x in part.column(at).to_pylist()])
                yield part.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def added(docs: DataFrame) -> list[str]:
    return fresh(docs, "lang_pred", "lang_score")


def held_out(key: Column, parts: int, out: int) -> Column:
    """Whether crc32 of the key as text leaves the remainder ``out``; null keys are not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % parts == out, F.lit(False))
