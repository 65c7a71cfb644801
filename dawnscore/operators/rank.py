"""Ranks, running counts and exact quantiles over groups of any size.

A class can hold a third of all rows, so no window here spans a whole class of raw rows.
Values are counted first, one row per (group, value); running counts are then formed in two
levels: inside narrow value buckets, and over the bucket totals. The bucket is a pure function of
the value, so a recomputed task gives the same buckets. Buckets are narrow relative to the distance
from 0, and between 1/2 and 1 to the distance from 1, so scores crowded at either end spread over
many of them, and so do large distances.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_OCTAVE = 1024
_ABOVE_ONE, _FAR = 100_000, 2_000_000


def value_bucket(value: Column) -> Column:
    """Monotone map of any double to a bounded bucket number; infinities and NaN (largest) have their own."""
    size = F.abs(value.cast("double"))

    def octaves(x: Column) -> Column:
        return F.floor(F.log2(x) * PER_OCTAVE)

    part = (F.when(size <= 0.5, octaves(size))
            .when(size < 1.0, -2 * PER_OCTAVE - octaves(F.lit(1.0) - size))
            .otherwise(_ABOVE_ONE + octaves(size)))
    # the smallest double lies about 1,100,000 buckets below 1; the shift keeps the signs apart
    placed = F.when(value > 0, part + _FAR).when(value < 0, -(part + _FAR)).otherwise(F.lit(0))
    return (F.when(F.isnan(value.cast("double")), F.lit(3 * _FAR))
            .when(size == float("inf"), F.when(value > 0, 2 * _FAR).otherwise(-2 * _FAR))
            .otherwise(placed).cast("long"))


def running_counts(df: DataFrame, keys: Sequence[str], value: str,
                   measures: dict[str, Column] | None = None) -> DataFrame:
    """One row per (keys, value) with m, m_below (strictly smaller values) and m_total."""
    measures = measures or {"n": F.count(F.lit(1))}
    names = list(measures)
    keys = list(keys)
    hist = (df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(*[m.alias(k) for k, m in measures.items()])
            .withColumn("__bucket", value_bucket(F.col(value))))
    before = (Window.partitionBy(*keys, "__bucket").orderBy(value)
              .rowsBetween(Window.unboundedPreceding, -1))
    inner = hist.select("*", *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"_in_{m}")
                               for m in names])
    buckets = hist.groupBy(*keys, "__bucket").agg(*[F.sum(m).alias(f"_t_{m}") for m in names])
    lower = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    offsets = buckets.select(
        *keys, "__bucket",
        *[F.coalesce(F.sum(f"_t_{m}").over(lower), F.lit(0)).alias(f"_off_{m}") for m in names],
        *[F.sum(f"_t_{m}").over(whole).alias(f"{m}_total") for m in names])
    return inner.join(offsets, [*keys, "__bucket"]).select(
        *keys, value, *names,
        *[(F.col(f"_in_{m}") + F.col(f"_off_{m}")).alias(f"{m}_below") for m in names],
        *[f"{m}_total" for m in names])


def _rank_table(df: DataFrame, keys: list[str], value: str, out: str, form: str) -> DataFrame:
    mid = F.col("n_below") + (F.col("n") + 1) / F.lit(2.0)
    n = F.col("n_total")
    expr = {
        "pct": mid / n,
        "unit": F.when(n > 1, (mid - 1) / (n - 1)).otherwise(F.lit(0.0)),
        "open": mid / (n + 1),
        "raw": mid,
    }[form]
    return running_counts(df, keys, value).select(*keys, value, expr.alias(out))


def add_ranks(df: DataFrame, keys: Sequence[str], columns: dict[str, str],
              form: str = "pct") -> DataFrame:
    """Average-tie ranks of several columns inside `keys`, groups of any size.

    form: pct = rank/n, unit = (rank-1)/(n-1), open = rank/(n+1), raw = rank.
    Every rank table is counted from `df` itself, not from the result of an earlier join. A value
    shared by very many rows (zero, say) is one row of the rank table; adaptive execution splits
    such a join partition on the side of the rows. Null values are not counted and keep a null rank;
    infinities and NaN rank at the ends.
    """
    keys = list(keys)
    out = df
    for value, name in columns.items():
        out = out.join(_rank_table(df, keys, value, name, form), [*keys, value], "left")
    return out


def add_rank(df: DataFrame, keys: Sequence[str], value: str, out: str,
             form: str = "pct") -> DataFrame:
    return add_ranks(df, keys, {value: out}, form)


def small_rank(keys: Sequence[str], value: str) -> Column:
    """Average-tie rank for groups bounded by the data model (a file's windows, a row's classes)."""
    ordered = Window.partitionBy(*keys).orderBy(value)
    ties = Window.partitionBy(*keys, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(ties) - 1) / F.lit(2.0)


def small_count(keys: Sequence[str]) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(*keys))


def reference_cdf(train: DataFrame, target: DataFrame, keys: Sequence[str], value: str,
                  out: str) -> DataFrame:
    """Share of training values strictly below each target value, per key; null without training values."""
    keys = list(keys)
    both = (train.select(*keys, value, F.lit(1).alias("_t"))
            .unionByName(target.select(*keys, value, F.lit(0).alias("_t"))))
    cdf = running_counts(both, keys, value, {"n": F.sum("_t")})
    cdf = cdf.select(*keys, value, F.expr("try_divide(n_below, n_total)").alias(out))
    return target.join(cdf, [*keys, value], "left")


def quantiles(df: DataFrame, keys: Sequence[str], value: str,
              wanted: dict[str, float]) -> DataFrame:
    """Exact linear-interpolated quantiles per key, without gathering a group in one task."""
    keys = list(keys)
    counts = running_counts(df, keys, value)
    end = F.col("n_below") + F.col("n")
    aggs, out = [], []
    for name, q in wanted.items():
        pos = F.lit(float(q)) * (F.col("n_total") - 1)
        aggs += [F.min(F.when(end > F.floor(pos), F.col(value))).alias(f"_lo_{name}"),
                 F.min(F.when(end > F.ceil(pos), F.col(value))).alias(f"_hi_{name}")]
        place = F.lit(float(q)) * (F.col("_n") - 1)
        out.append((F.col(f"_lo_{name}") + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
                    * (place - F.floor(place))).alias(name))
    return (counts.groupBy(*keys).agg(F.max("n_total").alias("_n"), *aggs)
            .select(*keys, *out))


def global_quantile(df: DataFrame, value: str, name: str, q: float) -> DataFrame:
    return quantiles(df, [], value, {name: q})


def positions(df: DataFrame, group: str, order: str, out: str) -> DataFrame:
    """1-based position of each row in its group by any ordered column, groups of any size.

    Rows are range-partitioned and written with their partition number, which fixes the cut points
    for both readers of the table; positions are the rank inside (partition, group) plus the
    group's rows in earlier partitions.
    """
    from dawnscore.sources import tables
    spark = df.sparkSession
    cut = (df.repartitionByRange(group, order).withColumn("_part", F.spark_partition_id()))
    fixed = spark.read.schema(cut.schema).parquet(
        tables.write_table(cut, tables.scratch(spark, "positions")))
    sizes = fixed.groupBy(group, "_part").agg(F.count(F.lit(1)).alias("_k"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(group, "_part", F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_part", group).orderBy(order))
    return (fixed.withColumn("_i", inside).join(offsets, [group, "_part"])
            .withColumn(out, F.col("_i") + F.col("_o")).drop("_i", "_o", "_part"))
