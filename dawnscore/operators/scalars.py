"""One-row tables as scalar subqueries."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(df: DataFrame, one: DataFrame) -> DataFrame:
    """Columns of a one-row aggregate on every row: a scalar subquery, run once, no join."""
    value = one.select(F.struct(*one.columns)).scalar()
    return (df.withColumn("_one_row", value)
            .select(*df.columns, *[F.col(f"_one_row.{c}").alias(c) for c in one.columns]))
