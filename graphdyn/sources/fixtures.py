"""Signals, frames and channel layouts derived from the star-schema tables.

Every mapping is a scan plus one aggregation with map-side combine. Sample
indices come from keys and timestamps by arithmetic, never from a row number,
so no subject has to pass through a single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER_SUBJECTS = 16
LEDGER_CHANNELS = 7
EVENT_CHANNELS = 5
SHIP_CHANNELS = 25


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames_embeddings(spark, sf_dir) -> DataFrame:
    """F1 as frames: one 64-channel vector per observation."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("label").cast("string").alias("subject_id"),
        F.when(F.col("label") % 2 == 0, "A").otherwise("B").alias("grp"),
        F.col("vec_id").alias("t"),
        F.col("embedding").cast("array<double>").alias("x"),
    )


def signals_embeddings(spark, sf_dir) -> DataFrame:
    """F1 as a long table; ``t`` is the observation key."""
    f = frames_embeddings(spark, sf_dir)
    return f.select("subject_id", "grp", "t", F.posexplode("x").alias("channel", "value"))


def signals_events(spark, sf_dir) -> DataFrame:
    """10 subjects x 5 event types, summed in 6-hour bins; sparse."""
    ev = table(spark, sf_dir, "events").select("ts", "user_id", "event_type", "value")
    kinds = ev.select(F.array_sort(F.collect_set("event_type"))).scalar()
    subject = F.col("user_id") % 10
    seconds = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return (
        ev.select(
            subject.cast("string").alias("subject_id"),
            F.when(subject < 5, "A").otherwise("B").alias("grp"),
            (F.array_position(kinds, F.col("event_type")) - 1).cast("int").alias("channel"),
            F.floor(seconds / 21600).alias("t"),
            "value",
        )
        .groupBy("subject_id", "grp", "channel", "t")
        .agg(F.sum("value").alias("value"))
    )


def signals_shipments(spark, sf_dir) -> DataFrame:
    """6 subjects x 25 nations, daily revenue; the long fixture."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate",
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    # combine before the join: one row per (subject, day, supplier)
    per_supplier = (
        li.groupBy(
            F.concat("l_returnflag", "l_linestatus").alias("subject_id"),
            F.col("l_linestatus").alias("grp"),
            F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-02").cast("date"))
            .cast("long").alias("t"),
            "l_suppkey")
        .agg(F.sum("v").alias("v")))
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    return (
        per_supplier.join(sup, F.col("l_suppkey") == F.col("s_suppkey"))
        .groupBy("subject_id", "grp", F.col("s_nationkey").alias("channel"), "t")
        .agg(F.sum("v").alias("value"))
    )


def signals_ledger(spark, sf_dir) -> DataFrame:
    """16 subjects x 7 line numbers along the order key.

    The recording length grows with the table: T is about orders / 16.
    """
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount")
    subject = F.col("l_orderkey") % LEDGER_SUBJECTS
    return (
        li.groupBy(
            subject.cast("string").alias("subject_id"),
            F.when(subject < LEDGER_SUBJECTS // 2, "A").otherwise("B").alias("grp"),
            (F.col("l_linenumber") - 1).alias("channel"),
            F.floor(F.col("l_orderkey") / LEDGER_SUBJECTS).alias("t"))
        .agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("value"))
    )


def channel_layout(spark, n: int) -> DataFrame:
    """(cos a, sin a, .5 + .2 sin 2a) with a = 2 pi c / n, to 6 digits."""
    a = 2 * F.pi() * F.col("id") / n
    return spark.range(n).select(
        F.col("id").cast("int").alias("channel"),
        F.concat(F.lit("ch"), F.col("id")).alias("name"),
        F.round(F.cos(a), 6).alias("x"),
        F.round(F.sin(a), 6).alias("y"),
        F.round(0.5 + 0.2 * F.sin(2 * a), 6).alias("z"),
    )


def ring_edges(spark, n: int, graph_id: str = "ring") -> DataFrame:
    """Dense pair list of a cycle of n channels with unit weights."""
    i = spark.range(n).select(F.col("id").cast("int").alias("i"))
    return (
        i.select("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("j"))
        .filter("i < j")
        .select(F.lit(graph_id).alias("graph_id"), "i", "j",
                F.when((F.col("j") - F.col("i") == 1) | (F.col("j") - F.col("i") == n - 1), 1.0)
                .otherwise(0.0).alias("w"))
    )


def recording_paths(spark, sf_dir) -> DataFrame:
    """File-like paths built from the documents table, for the id rules."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return d.select(
        "doc_id",
        F.concat(
            F.lit("/data/"),
            F.when(F.col("doc_id") % 3 == 0, "ad_group").when(F.col("doc_id") % 3 == 1, "HC")
            .otherwise("misc"),
            F.lit("/"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("sub-"), F.col("doc_id"),
                                                                 F.lit("/")))
            .otherwise(""),
            F.lit("s6_"), F.col("source"), F.lit("_"), F.col("doc_id"),
            F.when(F.col("doc_id") % 5 < 3, "_rs-hep_eeg").otherwise("_rs_eeg"),
            F.lit(".set")).alias("path"),
    )
