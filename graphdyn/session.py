"""Session helpers shared by operators, tests and the bench."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Folders of intermediates written by this process.
_STEPS: list[str] = []


def local_session(cpus: int | str = 8, app: str = "graphdyn") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    parallel = 8 if cpus == "*" else int(cpus)
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(parallel))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


#: Bytes of rows that go to a Python worker at once; a batch counted in rows may hold any amount of data.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Limit the session's batches for Python workers to ``limit`` bytes; a smaller limit stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = str(spark.conf.get(name)).rstrip("b")
    if not held.isdigit() or int(held) > limit:
        spark.conf.set(name, str(limit))


def shared_folder(spark: SparkSession) -> str:
    """The folder for materialised intermediates, reachable by every executor.

    ``spark.checkpoint.dir`` names it on a cluster. Only where a local session
    has none, a scratch folder is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    sc = spark.sparkContext
    known = sc._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the executors")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return sc._jsc.sc().getCheckpointDir().get()


def spread(df: DataFrame, *cols) -> DataFrame:
    """Spread rows that are about to be multiplied over all shuffle partitions.

    File packing and adaptive coalescing size partitions by the bytes before
    the multiplication; an explicit number is left alone by both.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *cols)


def sized(df: DataFrame) -> DataFrame:
    """Write a reduced table (one row per subject or pair) before joining it back.

    With the true size known, the optimizer broadcasts it only below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles both sides beyond it.
    Without, the large side would be shuffled by subject just to attach a number.
    """
    return cut_lineage(df)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write an intermediate once and continue from the written table.

    Used where a plan reads a small result several times or loops over it. A
    written table survives lost executors and gives the optimizer true sizes.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STEPS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear_steps(spark: SparkSession) -> int:
    """Delete the intermediates that ``cut_lineage`` has written in this process; their number.

    For the end of a job: tables that still read them can no longer be evaluated.
    """
    conf, hadoop = spark.sparkContext._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs
    count = len(_STEPS)
    while _STEPS:
        path = hadoop.Path(_STEPS.pop())
        path.getFileSystem(conf).delete(path, True)
    return count
