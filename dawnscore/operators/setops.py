"""Unions, differences and duplicate removal."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnscore.functions.scalar import total


def union_keep_first(sources: dict[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """Tagged union; of rows with equal keys the one from the earliest source stays.

    The pick is an aggregate, so equal keys meet after a map-side reduction.
    """
    parts = None
    for i, (name, df) in enumerate(sources.items()):
        one = df.withColumn("source", F.lit(name)).withColumn("_p", F.lit(i))
        parts = one if parts is None else parts.unionByName(one, allowMissingColumns=True)
    rest = [c for c in parts.columns if c not in keys]
    first = parts.groupBy(*keys).agg(F.min(F.struct("_p", *[c for c in rest if c != "_p"])).alias("_f"))
    return first.select(*keys, *[F.col(f"_f.{c}").alias(c) for c in rest if c != "_p"])


def coverage(a: DataFrame, b: DataFrame, key: str, names=("only_a", "only_b", "both")) -> DataFrame:
    """Each distinct key with the side it occurs on."""
    tags = (a.select(key, F.lit(1).alias("_a"), F.lit(0).alias("_b"))
            .unionByName(b.select(key, F.lit(0).alias("_a"), F.lit(1).alias("_b")))
            .groupBy(key).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b")))
    return tags.select(key, F.when(F.col("_b") == 0, names[0]).when(F.col("_a") == 0, names[1])
                       .otherwise(names[2]).alias("where_found"))


def uncovered(targets: DataFrame, *found: DataFrame, key: str) -> DataFrame:
    out = targets.select(key).distinct()
    for f in found:
        out = out.join(f.select(key).distinct(), key, "left_anti")
    return out


def consensus(flags: DataFrame, streams: Sequence[str]) -> DataFrame:
    """From top-k flags: classes in every stream's top k, and in exactly one."""
    n = total([F.col(f"top_{s}") for s in streams])
    return (flags.withColumn("agreement", F.when(n == len(streams), "all").when(n == 1, "one"))
            .filter(F.col("agreement").isNotNull()))


def first_per_content(df: DataFrame, content: str, order: str) -> DataFrame:
    """One row per content hash, the smallest by `order`; only the hash and the key are shuffled."""
    return (df.select(order, F.md5(F.col(content)).alias("content_hash"))
            .groupBy("content_hash").agg(F.min(order).alias(order), F.count(F.lit(1)).alias("copies")))
