"""Sinks. Each write is one distributed job; nothing passes the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphdyn.schema import QC_LOG


def write_consensus(consensus: DataFrame, path: str, subject_edges: DataFrame | None = None,
                    mode: str = "overwrite") -> None:
    """C, W, W_full and G by group; optionally the per-subject stack beside it."""
    consensus.write.mode(mode).partitionBy("grp").parquet(f"{path}/consensus")
    if subject_edges is not None:
        subject_edges.write.mode(mode).partitionBy("grp").parquet(f"{path}/subjects")


def write_table(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)


def write_tables(tables: dict[str, DataFrame], root: str, fmt: str = "csv",
                 mode: str = "overwrite") -> None:
    for name, df in tables.items():
        write_table(df, f"{root}/{name}", fmt, mode)


def write_stats_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_qc_log(path: str, *logs: DataFrame, run: str | None = None) -> None:
    """Add status rows to the processing log, as one partition per run.

    A run that is named and written again replaces its own rows and no others, so a
    repeated job does not double the log. Without a name each call is a run of its own.
    """
    out = logs[0].select(*QC_LOG.names)
    for extra in logs[1:]:
        out = out.unionByName(extra.select(*QC_LOG.names))
    (out.withColumn("run", F.lit(run or uuid.uuid4().hex)).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run").option("header", True).csv(path))
