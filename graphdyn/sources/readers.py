"""Sources: recordings, cohorts, graphs, layouts and saved result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphdyn.functions.scalars import group_from_path, nan_to_num, subject_id_from_path
from graphdyn.schema import CHANNELS, EDGES, QC_LOG, SIGNALS
from graphdyn.session import sized


def _load(spark, paths, schema, fmt, header: bool = True, **options):
    paths = [paths] if isinstance(paths, str) else list(paths)
    reader = spark.read.schema(schema).options(**options)
    if fmt == "csv":
        return reader.option("header", header).csv(paths)
    return reader.format(fmt).load(paths)


def read_signals(spark: SparkSession, paths, fmt: str = "parquet") -> DataFrame:
    """Long recording table; NaN and infinities become 0 on ingest."""
    df = _load(spark, paths, SIGNALS, fmt)
    return df.withColumn("value", nan_to_num("value"))


def read_cohort(spark: SparkSession, paths, fmt: str = "csv", id_rule: str = "strip",
                group_depth: int = 1, skip_unreadable: bool = False,
                expected: DataFrame | None = None,
                header: bool = True) -> tuple[DataFrame, DataFrame]:
    """All recordings of a cohort in one scan.

    Files hold (channel, t, value); subject and group come from the path.
    Returns (signals, rejects); rejects has the processing-log columns, one row
    per failed recording, and a failed recording has no rows in signals:

    * a row that cannot be parsed (``bad_rows``),
    * with ``skip_unreadable``, a file that cannot be read at all
      (``unreadable``); without it such a file stops the job,
    * with ``expected`` (subject_id, n_samples), a recording that is absent or
      does not end at that sample (``n_samples``), e.g. a truncated file.
    """
    cols = "channel int, t long, value double"
    options = {"ignoreCorruptFiles": skip_unreadable}
    if fmt == "csv":
        cols += ", _corrupt string"
        options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    raw = _load(spark, paths, cols, fmt, header, **options)

    def named(path):
        return (subject_id_from_path(path, id_rule).alias("subject_id"),
                F.coalesce(group_from_path(path, depth=group_depth), F.lit("ALL")).alias("grp"))

    raw = raw.select("*", *named(F.col("_metadata.file_path")))
    bad = F.col("channel").isNull() | F.col("t").isNull()
    if fmt == "csv":
        bad = bad | F.col("_corrupt").isNotNull()
    flagged = raw.withColumn("_bad", bad)
    key = ["subject_id", "grp"]
    seen = flagged.groupBy(*key).agg(F.count_if("_bad").alias("bad"),
                                     (F.max(F.when(~F.col("_bad"), F.col("t"))) + 1).alias("n"))
    facts = seen.select(*key, F.when(F.col("bad") > 0, F.concat(F.lit("bad_rows="), F.col("bad")))
                        .alias("why"), "n")
    if skip_unreadable:
        files = [paths] if isinstance(paths, str) else list(paths)
        # only paths are listed, contents are not read
        listed = spark.read.format("binaryFile").load(files).select(*named(F.col("path"))).distinct()
        facts = facts.unionByName(listed.join(seen, key, "left_anti").select(
            *key, F.lit("unreadable").alias("why"), F.lit(None).cast("long").alias("n")))
    if expected is not None:
        want = expected.select("subject_id", F.col("n_samples").alias("want"))
        gap = F.col("n").isNull() | (F.col("n") != F.col("want"))
        facts = facts.join(want, "subject_id", "full").withColumn("grp", F.coalesce("grp", F.lit("ALL")))
        facts = facts.withColumn("why", F.coalesce("why", F.when(F.col("want").isNotNull() & gap, F.concat(
            F.lit("n_samples="), F.coalesce("n", F.lit(0)), F.lit("/"), F.col("want")))))
    failed = sized(facts.filter(F.col("why").isNotNull()).select(*key, "why"))
    signals = flagged.filter(~F.col("_bad")).join(failed, key, "left_anti").select(
        *key, "channel", "t", nan_to_num("value").alias("value"))
    rejects = failed.select(
        *key, F.lit("FAILED").alias("status"), F.lit("EEG_loading_error").alias("reason"),
        F.col("why").alias("detail_1"), F.lit("").alias("detail_2"), F.lit("").alias("detail_3"))
    return signals, rejects


def read_graph(spark: SparkSession, paths, fmt: str = "parquet") -> DataFrame:
    return _load(spark, paths, EDGES, fmt).withColumn("w", nan_to_num("w"))


def read_channel_locations(spark: SparkSession, paths, fmt: str = "parquet") -> DataFrame:
    return _load(spark, paths, CHANNELS, fmt)


def missing_channels(signals: DataFrame, channels: DataFrame) -> DataFrame:
    """Channels that occur in recordings but have no usable coordinates."""
    placed = channels.filter(F.col("x").isNotNull() & F.col("y").isNotNull()
                             & F.col("z").isNotNull()).select("channel")
    return signals.select("channel").distinct().join(placed, "channel", "left_anti")


def read_results(spark: SparkSession, path: str, schema) -> DataFrame:
    """A saved result table (CSV with header) under a fixed schema."""
    return _load(spark, path, schema, "csv")


def read_qc_log(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, QC_LOG, "csv")
