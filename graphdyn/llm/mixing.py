"""Mixing sources to target weights: whole copies plus one hash-seeded extra.

DataFrame functions only. Sizes are summed per source (with map-side partial
sums, so a hot source is no hot task), the small source table gets its targets
and meets the documents again in one join.

Edge cases: a null source is a source of its own, ranked last; null and empty
texts have size 0 and are never taken; repeated rows share one draw per
doc_id; very long texts only count as their words; sources of equal size keep the order
of their names; an empty table gives an empty result; other columns pass through, and
columns named like a result move it to a fresh name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphdyn.llm.common import fresh, n_words, unit_hash
from graphdyn.session import sized

WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, size) to (source, size, target).

    Sources by code point, null last, weigh ``weights`` in turn and share the
    total. A target stops at ``cap`` times its source's size; what is cut off is
    shared by weight among the others. In ascending order of cap * size / weight
    a source is capped exactly if the share left for it would exceed its cap.
    The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = sizes.select(
        "source", "size", (F.lit(float(cap)) * F.col("size")).alias("most"),
        F.element_at(turn, ((F.row_number().over(by_name) - 1) % len(weights) + 1)).alias("w"))
    order = Window.orderBy(F.col("most") / F.col("w"), F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    s = s.select(
        "*", F.sum("size").over(everything).cast("double").alias("total"),
        F.sum("w").over(everything).alias("all_w"),
        F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("most_before"),
        F.coalesce(F.sum("w").over(before), F.lit(0.0)).alias("w_before"))
    capped = (F.col("most") * (F.col("all_w") - F.col("w_before"))
              < F.col("w") * (F.col("total") - F.col("most_before")))
    s = s.withColumn("capped", capped)
    kept = lambda c: F.coalesce(F.sum(F.when(F.col("capped"), F.col(c))).over(everything), F.lit(0.0))
    share = F.col("w") * ((F.col("total") - kept("most")) / (F.col("all_w") - kept("w")))
    return s.select("source", "size", F.when(F.col("capped"), F.col("most")).otherwise(share).alias("target"))


def rates(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED,
          text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` with size, source_size, target and copies under fresh names.

    Returns the frame; the four names are ``added(docs)``.
    """
    size, source_size, target, copies, src = added(docs) + fresh(docs, "source_key")
    words = n_words(F.col(text))
    totals = docs.select(F.col(source).alias("source"), words.alias("size")).groupBy("source").agg(
        F.sum("size").alias("size"))
    table = sized(source_targets(totals, weights, cap)).select(
        F.col("source").alias(src), F.col("size").alias(source_size), F.col("target").alias(target))
    out = docs.join(table, F.col(source).eqNullSafe(F.col(src)), "left").drop(src)
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(F.lit(0.0))
    extra = (unit_hash(seed, F.col(key)) < rate - F.floor(rate)).cast("long")
    return out.withColumns({size: words, copies: F.floor(rate) + extra})


def added(docs: DataFrame) -> list[str]:
    return fresh(docs, "size", "source_size", "target", "copies")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = SEED,
        text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """The mixed corpus: each row floor(rate) times, plus its extra copy if drawn."""
    size, _, _, copies = added(docs)
    out = rates(docs, weights, cap, seed, text, source, key).filter(
        (F.col(copies) > 0) & (F.col(size) > 0))
    return out.withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(docs.columns)
