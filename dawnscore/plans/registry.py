"""One declaration per query: output columns, Spark builder, check SQL.

The column spec ("name:kind ...", kind s|i|f|b) is applied to both sides, so that names, types
and rounding are the same in Spark and in the check engine.
"""
from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnscore.plans import views

DIGITS = 6
# Results are compared at 6 digits. Scores here are often short decimals, whose means sit exactly
# on a rounding boundary where two engines may differ by one ulp; a fixed offset below the compared
# resolution, the same on both sides, moves them off it.
OFFSET = 3.14159e-10
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _columns(spec: str) -> list[tuple[str, str]]:
    return [tuple(part.split(":")) for part in spec.split()]


def shaped(df: DataFrame, spec: str) -> DataFrame:
    kinds = {"s": "string", "i": "bigint", "b": "boolean"}
    out = []
    for name, kind in _columns(spec):
        col = F.col(name)
        if kind == "f":
            col = F.round(col.cast("double") + F.lit(OFFSET), DIGITS) + F.lit(0.0)
        else:
            col = col.cast(kinds[kind])
        out.append(col.alias(name))
    return df.select(*out)


def shaped_sql(body: str, spec: str) -> str:
    kinds = {"s": "VARCHAR", "i": "BIGINT", "b": "BOOLEAN"}
    out = []
    for name, kind in _columns(spec):
        if kind == "f":
            out.append(f"round(CAST({name} AS DOUBLE) + {OFFSET}, {DIGITS}) + 0.0 AS {name}")
        else:
            out.append(f"CAST({name} AS {kinds[kind]}) AS {name}")
    local, _, final = body.rpartition("\n--\n")
    ctes = views.sql_ctes(body)
    parts = [*ctes, local.strip().rstrip(",")] if local.strip() else list(ctes)
    # self-referencing CTEs are named rec_*
    word = "WITH RECURSIVE " if "rec_" in body else "WITH "
    head = word + ",\n".join(parts) + "\n" if parts else ""
    return f"{head}SELECT {', '.join(out)} FROM (\n{final.strip()}\n) AS result_rows"


def query(name: str, spec: str, sql: str | None = None):
    """Register a builder taking a Views object. SQL: optional CTEs, a line '--', then a SELECT."""
    if not re.fullmatch(r"[a-z]\d\d[a-z]?_[a-z0-9_]+", name):
        raise ValueError(name)

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return shaped(fn(views.Views(spark, sf_dir)), spec)

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = shaped_sql("\n" + sql if "\n--\n" in sql else sql, spec)
        return fn
    return wrap
