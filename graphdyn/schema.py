"""Column conventions, fixed schemas and parameter presets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

SIGNALS = T.StructType([
    T.StructField("subject_id", T.StringType()),
    T.StructField("grp", T.StringType()),
    T.StructField("channel", T.IntegerType()),
    T.StructField("t", T.LongType()),
    T.StructField("value", T.DoubleType()),
])

CHANNELS = T.StructType([
    T.StructField("channel", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
    T.StructField("z", T.DoubleType()),
])
EDGES = T.StructType([
    T.StructField("graph_id", T.StringType()),
    T.StructField("i", T.IntegerType()),
    T.StructField("j", T.IntegerType()),
    T.StructField("w", T.DoubleType()),
])
QC_LOG = T.StructType([
    T.StructField(c, T.StringType())
    for c in ("subject_id", "grp", "status", "reason", "detail_1", "detail_2", "detail_3")
])
AGREEMENT = T.StructType([
    T.StructField("Subject", T.StringType()),
    T.StructField("Group", T.StringType()),
    T.StructField("Pearson_r", T.DoubleType()),
    T.StructField("Jaccard", T.DoubleType()),
    T.StructField("Shared_Edges", T.IntegerType()),
    T.StructField("Subject_Edges", T.IntegerType()),
    T.StructField("Consensus_Edges", T.IntegerType()),
])

# Five frequency bands in Hz, closed at both ends.
BANDS = (
    ("delta", 0.5, 4.0),
    ("theta", 4.0, 8.0),
    ("alpha", 8.0, 13.0),
    ("beta", 13.0, 30.0),
    ("gamma", 30.0, 40.0),
)

# Numeric limits that are part of the semantics.
SD_FLOOR = 1e-8
Z_CLIP = 10.0
FISHER_CLIP = 0.999999
RIDGE = 5e-3
DEGREE_FLOOR = 1e-10


@dataclass(frozen=True)
class Preset:
    """Model-selection and gating parameters of one analysis flavour."""

    p_grid: tuple[int, ...]
    k_grid: tuple[int, ...]
    rho_select: float
    rho_lti: float
    rho_tv: float
    fallback: tuple[int, int]
    guard: str
    n_omega: int
    min_windows: int
    r2_min: float | None = None


# The three published parameter sets.
PRESETS = {
    "subject": Preset((1, 2, 3, 5, 7, 10, 15, 20), (1, 2, 3, 4),
                      1.0, 1.0, 0.99, (5, 2), "add", 128, 5),
    "group": Preset((1, 2, 3, 5, 7, 10, 15, 20, 30), (1, 2, 3, 4),
                    0.99, 0.99, 0.99, (5, 2), "rescale", 256, 5),
    "qc": Preset(tuple(range(1, 21)), (0, 1, 2, 3, 4),
                 0.95, 0.95, 0.95, (5, 1), "fail", 256, 10, 0.50),
}
