"""Targets, weights, dictionary codes and context features."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnscore.operators import rank


def soft_targets(df: DataFrame, key: str, primary: Column, secondary: Column,
                 known: Sequence[str], secondary_weight: float = 0.3,
                 shared: bool = False) -> DataFrame:
    """Primary 1.0, secondaries a weight each or an equal share; on a clash the secondary wins."""
    sec = df.select(key, primary.alias("_p"), secondary.alias("_s"))
    each = F.lit(float(secondary_weight))
    if shared:
        each = each / F.size("_s")
    items = F.concat(F.array(F.struct(F.col("_p").alias("class"), F.lit(0).alias("_role"),
                                      F.lit(1.0).alias("w"))),
                     F.transform("_s", lambda c: F.struct(c.alias("class"), F.lit(1).alias("_role"),
                                                          each.alias("w"))))
    return (sec.select(key, F.inline(items)).filter(F.col("class").isin(*known))
            .groupBy(key, "class").agg(F.max_by("w", "_role").alias("weight")))


def rating_filter(df: DataFrame, at_least: float, rating: str = "rating") -> DataFrame:
    return df.filter(F.col(rating) >= at_least).withColumn("weight", F.col(rating) / 5)


def minmax_power(df: DataFrame, score: str, power: float, cls: str = "class") -> DataFrame:
    """Per class ((x-min)/(max-min))^power rescaled; class extremes are a small joined table."""
    x, lo, hi = F.col(score), F.col("_lo"), F.col("_hi")
    ends = df.groupBy(cls).agg(F.min(score).alias("_lo"), F.max(score).alias("_hi"))
    scaled = F.pow((x - lo) / (hi - lo), F.lit(power)) * (hi - lo) + lo
    return (df.join(ends, cls)
            .withColumn(f"{score}_scaled", F.when(hi - lo < 1e-8, x).otherwise(scaled))
            .drop("_lo", "_hi"))


def index_values(df: DataFrame, column: str, out: str, start: int = 0,
                 cap: int | None = None) -> DataFrame:
    """Dense code by sorted order of the distinct values, joined back; nulls and codes past cap get 0.

    The distinct values are numbered over ranges, so no task holds the whole dictionary.
    """
    values = df.select(column).filter(F.col(column).isNotNull()).distinct().withColumn("_all", F.lit(0))
    code = (F.col("_place") - 1 + start).cast("int")
    if cap is not None:
        code = F.when(code <= cap, code).otherwise(F.lit(0))
    codes = rank.positions(values, "_all", column, "_place").select(column, code.alias(out))
    return df.join(codes, column, "left").withColumn(out, F.coalesce(out, F.lit(0)))


def context_features(df: DataFrame, sites: Sequence[str]) -> DataFrame:
    return df.select("*", (F.col("hour") / F.lit(24.0)).alias("hour_frac"),
                     *[(F.col("site") == s).cast("int").alias(f"site_{s.lower()}") for s in sites])
