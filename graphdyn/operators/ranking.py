"""Exact global ranks without a single-task window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphdyn.session import cut_lineage


def global_running_sum(df: DataFrame, *order, weight: str | None = None,
                       name: str = "position") -> DataFrame:
    """Running total of ``weight`` (default 1) in a total order, this row included.

    A range-partitioned sort, written out so that the partition borders cannot
    move, then one total per partition turned into offsets. Rows must be
    distinct in the sort keys (aggregate ties first), so no key value can be
    too large for a partition.
    """
    placed = cut_lineage(df.orderBy(*order).withColumn("_part", F.spark_partition_id())
                         .withColumn("_seq", F.monotonically_increasing_id()))
    w = F.lit(1) if weight is None else F.col(weight)
    sizes = placed.groupBy("_part").agg(F.sum(w).alias("_n"), F.min("_seq").alias("_base"))
    # one row per sort partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    out = placed.join(F.broadcast(offsets), "_part")
    if weight is None:
        within = F.col("_seq") - F.col("_base") + 1
    else:
        within = F.sum(w).over(Window.partitionBy("_part").orderBy("_seq"))
    return (out.withColumn(name, F.col("_off") + within)
            .drop("_part", "_seq", "_base", "_off"))


def global_positions(df: DataFrame, *order, name: str = "position") -> DataFrame:
    """1-based position of every row in a total order with distinct keys."""
    return global_running_sum(df, *order, name=name)


def suffix_min(df: DataFrame, within, order, value: str, name: str) -> DataFrame:
    """Least ``value`` from each row to the end of its group ``within``, in the order of ``order``.

    A two-level reverse scan: inside each partition of a range-partitioned sort,
    then over one least value per (partition, group). A group may span any
    number of partitions.
    """
    placed = cut_lineage(df.orderBy(*within, *order).withColumn("_part", F.spark_partition_id())
                         .withColumn("_seq", F.monotonically_increasing_id()))
    back = Window.partitionBy("_part", *within).orderBy(F.desc("_seq"))
    local = placed.withColumn("_own", F.min(value).over(back))
    later = Window.partitionBy(*within).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    rest = placed.groupBy("_part", *within).agg(F.min(value).alias("_least")).withColumn(
        "_later", F.min("_least").over(later)).drop("_least")
    same = [local[c].eqNullSafe(rest[c]) for c in within]
    joined = local.join(rest, [local["_part"] == rest["_part"], *same])
    return joined.select(*[local[c] for c in df.columns], F.least("_own", "_later").alias(name))
