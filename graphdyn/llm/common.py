"""Column names, word patterns and salts shared by the corpus operators."""

from __future__ import annotations

import pickle

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphdyn.session import bound_batches  # noqa: F401

# A word is a maximal run of characters other than these
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of a batch where a text stands beside arrays made from it: batch, strings, bytes and hashes are held at once.
TEXT_BATCH = 2 << 20


class Sent:
    """A learned value that goes to the executors once, with its classes, so that they need no copy of the package."""

    def __init__(self, spark: SparkSession, value):
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._held = None

    def __getstate__(self):
        return {"_bytes": self._bytes, "_held": None}

    @property
    def value(self):
        if self._held is None:
            self._held = pickle.loads(self._bytes.value)
        return self._held


def fresh(df: DataFrame, *bases: str) -> list[str]:
    """Column names that ``df`` does not have (Spark ignores case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for base in bases:
        name = base
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def n_words(text: Column) -> Column:
    """Number of words; null texts have none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def n_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def unit_hash(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of md5(seed:key)."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2 ** 52))


def row_digest(df: DataFrame) -> Column:
    """md5 over all columns; null and empty differ, equal rows agree."""
    parts = []
    for name, kind in df.dtypes:
        c = df[name]
        nested = kind.startswith(("array", "map", "struct"))
        text = F.to_json(F.struct(c)) if nested else c.cast("string")
        parts.append(F.coalesce(F.concat(F.lit("+"), text), F.lit("-")))
    return F.md5(F.concat_ws("|", *parts))


#: 64-bit words of the member bitmap: one megabyte, whatever the number of members.
WORDS = 1 << 17


def maybe_member(h: Column, members: DataFrame) -> Column:
    """Whether a row's hash may be among those of ``members`` (one column); False is certain.

    A bitmap of fixed size goes to the rows, so that a join need only shuffle
    those that may have a partner. With very many members it lets all rows
    through, and the join is as right as before.
    """
    slot = lambda x: F.pmod(x, F.lit(64 * WORDS))
    s = slot(F.col(members.columns[0]))
    one = members.select(F.floor(s / 64).alias("word"), F.expr("1L").alias("one"), (s % 64).cast("int").alias("at"))
    words = one.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, at)")).alias("bits"))
    every = members.sparkSession.range(WORDS).join(words, F.col("id") == F.col("word"), "left").agg(
        F.array_sort(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")))).alias("b"))
    table = every.select(F.col("b.bits")).scalar()
    word = F.element_at(table, (F.floor(slot(h) / 64) + 1).cast("int"))
    shift = F.pow(F.lit(2.0), slot(h) % 64)
    low = word.bitwiseAND(F.when(slot(h) % 64 == 63, F.lit(-2 ** 63)).otherwise(shift.cast("long")))
    return low != 0


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
