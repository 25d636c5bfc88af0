"""Registration of queries: a Spark plan, its result columns, its check SQL.

A column list such as ``subject_id i:i n:l w:r6`` fixes names, types and the
digits at which both sides are rounded (r6 = 6 digits, NaN as NULL, no -0.0).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}

_CASTS = {"i": ("int", "INTEGER"), "l": ("bigint", "BIGINT"), "s": ("string", "VARCHAR"),
          "b": ("boolean", "BOOLEAN")}


def _parse(spec: str):
    for item in spec.split():
        name, _, kind = item.partition(":")
        yield name, kind or "s"


def project(df: DataFrame, spec: str) -> DataFrame:
    out = []
    for name, kind in _parse(spec):
        c = F.col(name)
        if kind[0] == "r":
            digits = int(kind[1:] or 6)
            x = c.cast("double")
            x = F.when(~F.isnan(x), x)
            c = F.when(F.abs(x) < 0.5 * 10.0 ** -digits, F.lit(0.0)).otherwise(F.round(x, digits))
        else:
            c = c.cast(_CASTS[kind][0])
        out.append(c.alias(name))
    return df.select(*out)


def project_sql(sql: str, spec: str) -> str:
    out = []
    for name, kind in _parse(spec):
        if kind[0] == "r":
            digits = int(kind[1:] or 6)
            x = f"CAST(q.{name} AS DOUBLE)"
            c = (f"CASE WHEN isnan({x}) THEN NULL WHEN abs({x}) < {0.5 * 10.0 ** -digits!r}"
                 f" THEN 0.0::DOUBLE ELSE round({x}, {digits}) END")
        else:
            c = f"CAST(q.{name} AS {_CASTS[kind][1]})"
        out.append(f"{c} AS {name}")
    return f"SELECT {', '.join(out)} FROM (\n{sql}\n) q"


def query(spec: str, sql: str | None = None, name: str | None = None):
    def register(fn):
        key = name or fn.__name__
        if key in QUERIES:
            raise ValueError(f"duplicate query {key}")
        QUERIES[key] = lambda spark, sf_dir: project(fn(spark, sf_dir), spec)
        if sql is not None:
            ORACLES[key] = project_sql(sql, spec)
        return fn
    return register
