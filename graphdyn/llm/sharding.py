"""Extendible hashing: a directory over hash-prefix bits that splits only full buckets.

DataFrame functions only. The hash has 60 bits, the leading bits of the row's
md5. A bucket is a prefix; one whose bytes exceed the limit is split on one
more bit, the others stay. So a row's bucket is its shortest prefix that fits.
The directory is computed from byte sums per cell (a prefix a few bits deeper
than the mean bucket); only cells that are still too large are looked at with
more bits. Rows are read twice: for the sums and for the assignment.

Edge cases: null and empty texts count 0 bytes; one document above the limit
is a shard of its own; rows equal in every column have one hash, no further bit
parts them, so such a bucket is dealt out in equal parts that fit (suffix
``+k``), which of them goes where is arbitrary; very long texts only count as their
bytes; an empty table gives an empty result; other columns pass through, and columns
named like a result move it to a fresh name.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphdyn.llm.common import fresh, n_bytes, row_digest
from graphdyn.session import cut_lineage

BITS = 60
LIMIT = 1 << 20
#: Bits beyond the mean bucket's depth at which sums are first taken, and by which full cells are refined.
SLACK, STEP = 2, 6


def _prefix(h, depth):
    return F.expr(f"shiftright({h}, {BITS} - {depth})")


def _cells(keys: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """(cell, depth, bytes, n, lo, hi): disjoint prefixes that fit or can be read as they are."""
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    first = min(BITS, max(0, math.ceil(math.log2(max(1.0, total / limit)))) + SLACK)
    depth, done, part = first, [], keys
    while True:
        cells = cut_lineage(
            part.groupBy(_prefix("h", depth).alias("cell")).agg(
                F.sum("bytes").alias("bytes"), F.count("*").alias("n"),
                F.min("h").alias("lo"), F.max("h").alias("hi")).withColumn("depth", F.lit(depth)))
        full = (F.col("bytes") > limit) & (F.col("lo") < F.col("hi"))
        if depth == BITS or cells.filter(full).isEmpty():
            return reduce(DataFrame.unionByName, [*done, cells]), first
        done.append(cells.filter(~full))
        part = part.join(cells.filter(full).select("cell"),
                         _prefix("h", depth) == F.col("cell"), "left_semi")
        depth = min(BITS, depth + STEP)


def directory(keys: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, int]:
    """Leaves (depth, prefix, bytes, n, lo, hi) for keys (h, bytes), and the first cell depth."""
    cells, first = _cells(keys, limit)
    up = cells.select("cell", "depth", "bytes", "n", "lo", "hi",
                      F.explode(F.sequence(F.lit(0), F.col("depth"))).alias("d"))
    up = up.withColumn("p", F.expr("shiftright(cell, depth - d)"))
    nodes = up.groupBy("d", "p").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"),
                                     F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    nodes = cut_lineage(nodes)
    fits = nodes.filter((F.col("bytes") <= limit) | (F.col("lo") == F.col("hi")))
    split = nodes.join(fits.select("d", "p"), ["d", "p"], "left_anti").select(
        F.col("d").alias("pd"), F.col("p").alias("pp"))
    leaf = fits.join(split, (F.col("d") - 1 == F.col("pd"))
                     & (F.expr("shiftright(p, 1)") == F.col("pp")), "left_semi")
    leaf = leaf.unionByName(fits.filter("d = 0"))
    return cut_lineage(leaf.withColumnsRenamed({"d": "depth", "p": "prefix"})), first


def added(docs: DataFrame) -> list[str]:
    """Names of the columns that ``shard`` adds: shard, depth, n_bytes, shard_bytes."""
    return fresh(docs, "shard", "depth", "n_bytes", "shard_bytes")


def shard(docs: DataFrame, limit: int = LIMIT, text: str = "text") -> DataFrame:
    """``docs`` with shard (its bits), depth, n_bytes and shard_bytes, see ``added``."""
    name, depth, size, total = added(docs)
    digest, h, cell, lo, hi, pd, pp, n, ord_ = fresh(
        docs, "digest", "h", "cell", "lo", "hi", "pd", "pp", "n", "ord")
    rows = docs.withColumns({digest: row_digest(docs), size: n_bytes(F.col(text))}).withColumn(
        h, F.conv(F.substring(F.col(digest), 1, BITS // 4), 16, 10).cast("long"))
    keys = cut_lineage(rows.select(F.col(h).alias("h"), F.col(size).alias("bytes")))
    leaves, first = directory(keys, limit)
    # each leaf under the cells of the first depth that it covers or lies in
    wide = F.expr(f"cast(pow(2, greatest({first} - depth, 0)) as bigint)")
    start = F.expr(f"case when depth <= {first} then shiftleft(prefix, {first} - depth)"
                   f" else shiftright(prefix, depth - {first}) end")
    table = leaves.select(
        F.explode(F.sequence(start, start + wide - 1)).alias(cell),
        F.expr(f"shiftleft(prefix, {BITS} - depth)").alias(lo),
        F.expr(f"shiftleft(prefix + 1, {BITS} - depth)").alias(hi),
        F.col("depth").alias(depth), F.col("prefix").alias(pp), F.col("bytes").alias(total),
        F.col("n").alias(n), (F.col("lo") == F.col("hi")).alias(pd))
    table = cut_lineage(table)
    out = rows.join(table, (_prefix(h, first) == F.col(cell)) & (F.col(h) >= F.col(lo))
                    & (F.col(h) < F.col(hi)))
    bits = F.when(F.col(depth) == 0, F.lit("")).otherwise(
        F.lpad(F.bin(F.col(pp)), F.col(depth), F.lit("0")))
    out = out.withColumn(name, bits)
    overflow = F.col(pd) & (F.col(total) > limit) & (F.col(n) > 1)
    cols = [*docs.columns, name, depth, size, total]
    if table.filter(overflow).isEmpty():
        return out.select(cols)
    # equal rows are interchangeable: one row and its number of copies is enough
    same = out.filter(overflow).groupBy(digest).agg(
        F.count("*").alias(n), F.first(F.struct(*cols)).alias(h))
    per = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.col(size))))
    same = same.select(n, f"{h}.*").withColumn(ord_, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    part = F.floor(F.col(ord_) / per)
    same = same.withColumns({
        name: F.concat(F.col(name), F.lit("+"), part.cast("string")),
        total: F.col(size) * F.least(per, F.col(n) - part * per)})
    return out.filter(~overflow).select(cols).unionByName(same.select(cols))
