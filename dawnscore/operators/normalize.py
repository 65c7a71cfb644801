"""Score normalisation: z-scores, centring, gains, file-level scaling.

Class-level statistics are small tables (one row per class) built by partial aggregation and
joined back; only groups bounded by the data model (a file's windows, a row's classes) use
window frames.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnscore.functions.scalar import clip, logit, normal_quantile, sigmoid
from dawnscore.operators import rank
from dawnscore.operators.scalars import attach


def with_stats(df: DataFrame, keys: Sequence[str], score: str, fit: DataFrame | None = None,
               mean: str = "_mean", std: str = "_std") -> DataFrame:
    """Attach mean and population std of `score` per key; `fit` limits the rows they come from."""
    source = df if fit is None else fit
    stats = source.groupBy(*keys).agg(F.avg(score).alias(mean), F.stddev_pop(score).alias(std))
    return df.join(stats, list(keys), "left") if keys else attach(df, stats)


def zscore(df: DataFrame, keys: Sequence[str], score: str, out: str, eps: float = 1e-8,
           fit: DataFrame | None = None) -> DataFrame:
    both = with_stats(df, keys, score, fit)
    return (both.withColumn(out, (F.col(score) - F.col("_mean")) / (F.col("_std") + eps))
            .drop("_mean", "_std"))


def quantile_normal(df: DataFrame, keys: Sequence[str], score: str, out: str) -> DataFrame:
    """Average rank / (n+1) -> inverse normal -> sigmoid."""
    ranked = rank.add_rank(df, keys, score, "_r", "open")
    return ranked.withColumn(out, sigmoid(normal_quantile(F.col("_r")))).drop("_r")


def file_zscore(df: DataFrame, series: Sequence[str], score: str, out: str) -> DataFrame:
    """Z-score of the logits inside a series, squashed back."""
    w = Window.partitionBy(*series)
    x = df.withColumn("_l", logit(F.col(score)))
    z = (F.col("_l") - F.avg("_l").over(w)) / (F.stddev_pop("_l").over(w) + 1e-6)
    return x.withColumn(out, sigmoid(z, 700.0)).drop("_l")


def site_zscore(rows: DataFrame, metric: str, out: str, site: str = "site") -> DataFrame:
    """Z-score of a row metric inside its site; sites with fewer than 2 rows give 0."""
    stats = rows.groupBy(site).agg(F.avg(metric).alias("_mean"), F.stddev_pop(metric).alias("_std"),
                                   F.count(F.lit(1)).alias("_n"))
    z = (F.col(metric) - F.col("_mean")) / (F.col("_std") + 1e-9)
    return (rows.join(stats, site)
            .withColumn(out, F.when(F.col("_n") < 2, F.lit(0.0)).otherwise(z))
            .drop("_mean", "_std", "_n"))


def file_centre(df: DataFrame, score: str, out: str, file: str = "file_id",
                cls: str = "class") -> DataFrame:
    g = df.groupBy(cls).agg(F.avg(score).alias("_g"))
    fmean = F.avg(score).over(Window.partitionBy(file, cls))
    return (df.withColumn("_f", fmean).join(g, cls)
            .withColumn(out, clip(F.col(score) - F.col("_f") + F.col("_g"), 0, 1))
            .drop("_f", "_g"))


def taxon_centre(df: DataFrame, score: str, out: str, taxa: Sequence[str], alpha: float,
                 file: str = "file_id", cls: str = "class") -> DataFrame:
    fmean = F.avg(score).over(Window.partitionBy(file, cls))
    x = F.col(score)
    return df.withColumn(out, F.when(F.col("taxon").isin(*taxa), x - alpha * fmean).otherwise(x))


def target_std(df: DataFrame, score: str, out: str, target: float = 0.2,
               keys: Sequence[str] = ("class",)) -> DataFrame:
    both = with_stats(df, keys, score)
    gain = F.lit(target) / (F.col("_std") + 1e-8)
    return (both.withColumn(out, clip(F.col("_mean") + gain * (F.col(score) - F.col("_mean")), 0, 1))
            .drop("_mean", "_std"))


def series_max(score: str, series: Sequence[str]) -> Column:
    return F.max(score).over(Window.partitionBy(*series))


def coherence(df: DataFrame, series: Sequence[str], score: str, out: str, a_max: float = 0.10,
              a_mean: float = 0.0, a_q85: float = 0.0) -> DataFrame:
    """Pull every window towards its file's max, mean and 85 % quantile; weights sum to 1."""
    w = Window.partitionBy(*series)
    mix = (F.lit(1 - a_max - a_mean - a_q85) * F.col(score)
           + F.lit(a_max) * F.max(score).over(w))
    if a_mean:
        mix = mix + F.lit(a_mean) * F.avg(score).over(w)
    if a_q85:
        mix = mix + F.lit(a_q85) * F.percentile(score, F.lit(0.85)).over(w)
    return df.withColumn(out, mix)


def rank_aware(df: DataFrame, series: Sequence[str], score: str, out: str,
               power: float = 0.4) -> DataFrame:
    top = F.greatest(series_max(score, series), F.lit(1e-9))
    return df.withColumn(out, F.col(score) * F.pow(top, F.lit(power)))


def file_confidence(df: DataFrame, series: Sequence[str], score: str, out: str, top: int = 2,
                    power: float = 0.4) -> DataFrame:
    """Scale by (mean of the series' best `top` windows)^power."""
    best = F.slice(F.sort_array(F.collect_list(score).over(Window.partitionBy(*series)), False),
                   1, top)
    mean = F.aggregate(best, F.lit(0.0), lambda a, x: a + x) / F.size(best)
    return df.withColumn(out, F.col(score) * F.pow(mean, F.lit(power)))


def max_leak(df: DataFrame, series: Sequence[str], score: str, out: str,
             weight: float = 0.05) -> DataFrame:
    return df.withColumn(out, F.col(score) + weight * series_max(score, series))


def tail_power(df: DataFrame, score: str, out: str, top: int = 30, power: float = 2.0,
               file: str = "file_id", cls: str = "class") -> DataFrame:
    """Classes outside the file's `top` by maximum are raised to a power."""
    peak = df.withColumn("_m", series_max(score, [file, cls]))
    order = Window.partitionBy(file).orderBy(F.desc("_m"), cls)  # windows x classes rows
    return (peak.withColumn("_k", F.dense_rank().over(order))
            .withColumn(out, F.when(F.col("_k") > top, F.pow(score, F.lit(power)))
                        .otherwise(F.col(score))).drop("_m", "_k"))
