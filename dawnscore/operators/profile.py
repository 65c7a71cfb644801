"""Grouped profiles of labels, recordings and scores."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnscore.functions.keys import split_labels
from dawnscore.functions.scalar import clip
from dawnscore.operators import align, rank
from dawnscore.operators.scalars import attach


def segment_labels(segments: DataFrame, keys: Sequence[str], text: str = "primary_label",
                   out: str = "lbls") -> DataFrame:
    """Sorted distinct union of the label lists of each segment (exact duplicates drop out)."""
    tags = segments.select(*keys, F.explode(split_labels(F.col(text))).alias("_l"))
    return (tags.groupBy(*keys).agg(F.sort_array(F.collect_set("_l")).alias(out)))


def multi_hot(rows: DataFrame, lists: str, classes: Sequence[str]) -> DataFrame:
    """One 0/1 row per class; labels outside the class list vanish."""
    grid = align.class_grid(rows, classes)
    return (grid.withColumn("y", F.array_contains(lists, F.col("class")).cast("int"))
            .drop(lists))


def flag_full_files(rows: DataFrame, file: str = "file_id", windows: int = 12) -> DataFrame:
    """Mark rows of files with exactly `windows` rows; counts are pre-aggregated and joined."""
    full = rows.groupBy(file).agg((F.count(F.lit(1)) == windows).alias("is_full"))
    return rows.join(full, file)


def taxon_any(labels: DataFrame, row_keys: Sequence[str]) -> DataFrame:
    return labels.groupBy(*row_keys, "taxon").agg(F.max("y").alias("y_any"))


def file_stats(scores: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    """Per series: max, mean, population std, 85 % quantile, uniformity."""
    x = F.col(score)
    return (scores.groupBy(*keys).agg(
        F.max(x).alias("f_max"), F.avg(x).alias("f_mean"), F.stddev_pop(x).alias("f_std"),
        F.percentile(x, F.lit(0.85)).alias("f_q85"))
        .withColumn("uniformity", 1 - F.col("f_std") / (F.col("f_mean") + 1e-6)))


def describe_counts(df: DataFrame, group: str, item: str) -> DataFrame:
    """Distribution of per-item row counts inside each group."""
    per = df.groupBy(group, item).agg(F.count(F.lit(1)).alias("k"))
    return per.groupBy(group).agg(
        F.count(F.lit(1)).alias("n_items"), F.sum("k").alias("n_rows"), F.avg("k").alias("mean"),
        F.median("k").alias("median"), F.min("k").alias("min_k"), F.max("k").alias("max_k"),
        F.stddev("k").alias("std"))


def list_size_histogram(rows: DataFrame, lists: str) -> DataFrame:
    return (rows.groupBy(F.size(lists).alias("n_labels"))
            .agg(F.count(F.lit(1)).alias("n_rows")))


def label_frequency(rows: DataFrame, lists: str, taxonomy: DataFrame, top: int = 30) -> DataFrame:
    counts = (rows.select(F.explode(lists).alias("class")).groupBy("class")
              .agg(F.count(F.lit(1)).alias("n_rows")))
    return (align.attach_taxon(counts, taxonomy)
            .orderBy(F.desc("n_rows"), "class").limit(top))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(col, list(values)).count().fillna(0)


def numeric_profile(df: DataFrame, group: str, value: str) -> DataFrame:
    """count/mean/std/min/max from one partial aggregate, quartiles from running counts."""
    x = F.col(value)
    base = df.groupBy(group).agg(
        F.count(x).alias("n_rows"), F.avg(x).alias("mean"), F.stddev(x).alias("std"),
        F.min(x).alias("min_v"), F.max(x).alias("max_v"))
    quart = rank.quantiles(df.filter(x.isNotNull()), [group], value,
                           {"q25": .25, "median": .5, "q75": .75})
    return base.join(quart, group)


def site_counts(labels: DataFrame, hit: Column, cls: str = "class",
                site: str = "site") -> DataFrame:
    """Number of distinct sites with a hit per class, and its band."""
    per = labels.groupBy(cls, site).agg(F.max(hit.cast("int")).alias("_h"))
    n = F.col("n_sites")
    return (per.groupBy(cls).agg(F.sum("_h").alias("n_sites"))
            .withColumn("site_band", F.when(n >= 3, "3+").otherwise(n.cast("string"))))


def site_concentration(positives: DataFrame, cls: str = "class",
                       site: str = "site") -> DataFrame:
    per = positives.groupBy(cls, site).agg(F.count(F.lit(1)).alias("k"))
    order = F.struct("k", site)
    return per.groupBy(cls).agg(
        F.sum("k").alias("n_pos"), (F.max("k") / F.sum("k")).alias("max_share"),
        F.max_by(site, order).alias("top_site"))


def simpson(positives: DataFrame, cls: str, category: str) -> DataFrame:
    """1 - sum of squared shares, from one pass over the category counts."""
    per = positives.groupBy(cls, category).agg(F.count(F.lit(1)).alias("k"))
    k = F.col("k").cast("double")
    return per.groupBy(cls).agg((1 - F.sum(k * k) / (F.sum(k) * F.sum(k))).alias("simpson"))


def hour_profile(positives: DataFrame, cls: str = "class", hour: str = "hour") -> DataFrame:
    per = positives.groupBy(cls, hour).agg(F.count(F.lit(1)).alias("k"))
    whole = Window.partitionBy(cls)  # at most 24 rows
    return per.select(cls, hour, (F.col("k") / (F.sum("k").over(whole) + 1e-6)).alias("hour_share"))


def hour_match(rows: DataFrame, profile: DataFrame) -> DataFrame:
    return align.prior_lookup(rows, profile, ["class", "hour"], "hour_share", 0.0)


def saturation(scores: DataFrame, score: str, hot: float = 0.7, share: float = 0.5) -> DataFrame:
    return (scores.groupBy("class").agg(F.avg((F.col(score) > hot).cast("double")).alias("hot_share"))
            .withColumn("is_saturating", F.col("hot_share") > share))


def label_saturation(labels: DataFrame, share: float = 0.05) -> DataFrame:
    """Classes whose positive rows exceed a share of all rows."""
    return (labels.groupBy("class")
            .agg(F.sum("y").alias("n_pos"), F.count(F.lit(1)).alias("n_rows"))
            .withColumn("pos_share", F.col("n_pos") / F.col("n_rows"))
            .filter(F.col("pos_share") > share))


def fired_windows(scores: DataFrame, keys: Sequence[str], fired: Column) -> DataFrame:
    return scores.groupBy(*keys).agg(F.count_if(fired).alias("n_fired"))


def over_present(scores: DataFrame, keys: Sequence[str], fired: Column,
                 limit: int = 8) -> DataFrame:
    return fired_windows(scores, keys, fired).filter(F.col("n_fired") > limit)


def single_window(scores: DataFrame, keys: Sequence[str], fired: Column) -> DataFrame:
    return fired_windows(scores, keys, fired).filter(F.col("n_fired") == 1)


def group_members(labels: DataFrame, row_keys: Sequence[str],
                  members: Sequence[str]) -> DataFrame:
    hit = F.col("class").isin(*members) & (F.col("y") == 1)
    return (labels.groupBy(*row_keys).agg(F.count_if(hit).alias("n_members"))
            .withColumn("has_all", F.col("n_members") == len(members)))


def conflict_rows(labels: DataFrame, row_keys: Sequence[str], group: Sequence[str],
                  other: Sequence[str], at_least: int = 3) -> DataFrame:
    on = F.col("y") == 1
    return (labels.groupBy(*row_keys).agg(
        F.count_if(on & F.col("class").isin(*group)).alias("n_group"),
        F.count_if(on & F.col("class").isin(*other)).alias("n_other"))
        .filter((F.col("n_group") >= at_least) & (F.col("n_other") >= 1)))


def cluster_cofiring(scores: DataFrame, row_keys: Sequence[str], members: Sequence[str],
                     score: str, hot: float = 0.5, at_least: int = 3) -> DataFrame:
    return (scores.filter(F.col("class").isin(*members)).groupBy(*row_keys)
            .agg(F.count_if(F.col(score) > hot).alias("n_hot"))
            .filter(F.col("n_hot") >= at_least))


def aliveness(scores: DataFrame, score: str, keys: Sequence[str] = ("class",)) -> DataFrame:
    """p95, p99, max, std, range per class; dead / semi / alive by p99."""
    x = F.col(score)
    keys = list(keys)
    base = scores.groupBy(*keys).agg(
        F.max(x).alias("p_max"), F.stddev_pop(x).alias("p_std"),
        (F.max(x) - F.min(x)).alias("p_range"))
    tails = rank.quantiles(scores, keys, score, {"p95": .95, "p99": .99})
    return (base.join(tails, keys)
            .withColumn("state", F.when(F.col("p99") < 0.1, "dead").when(F.col("p99") < 0.3, "semi")
                        .otherwise("alive")))


def histogram_entropy(scores: DataFrame, keys: Sequence[str], score: str,
                      bins: int = 20) -> DataFrame:
    """Base-2 entropy of the equal-width histogram on [0, 1]."""
    b = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1))
    per = scores.groupBy(*keys, b.alias("_bin")).agg(F.count(F.lit(1)).alias("_k"))
    k = F.col("_k").cast("double")
    # -sum(q log2 q) with q = k/N equals log2 N - sum(k log2 k)/N: one aggregate, no window
    return per.groupBy(*keys).agg(
        (F.log2(F.sum(k)) - F.sum(k * F.log2(k)) / F.sum(k)).alias("entropy"))


def volatility(scores: DataFrame, score: str, min_rows: int = 3) -> DataFrame:
    per = scores.groupBy("file_id", "class").agg(
        F.stddev_pop(score).alias("_s"), F.count(F.lit(1)).alias("_n"))
    return (per.filter(F.col("_n") >= min_rows).groupBy("class")
            .agg(F.avg("_s").alias("volatility"), F.count(F.lit(1)).alias("n_files")))


def score_shares(scores: DataFrame, keys: Sequence[str], score: str,
                 edges: Sequence[float] = (.1, .3, .5, .7, .9)) -> DataFrame:
    x = F.col(score)
    bounds = [-float("inf"), *edges, float("inf")]
    shares = [F.avg(((x >= lo) & (x < hi)).cast("double")).alias(f"s{i}")
              for i, (lo, hi) in enumerate(zip(bounds, bounds[1:]))]
    return scores.groupBy(*keys).agg(
        *shares, F.avg(((x >= .45) & (x < .55)).cast("double")).alias("undecided"))


def frequency_weights(labels: DataFrame) -> DataFrame:
    per = labels.groupBy("class").agg(F.sum("y").alias("_p"), F.count(F.lit(1)).alias("_n"))
    raw = clip(1 / F.sqrt((F.col("_p") + 1) / F.col("_n")), 1, 10)
    per = per.select("class", raw.alias("_w"))
    mean = per.agg(F.avg("_w").alias("_m"))
    return attach(per, mean).select("class", (F.col("_w") / F.col("_m")).alias("weight"))


def transitions(labels: DataFrame, file: str = "file_id", win: str = "win") -> DataFrame:
    """P(0->1) and P(1->0) per class over consecutive windows of a file."""
    prev = F.lag("y").over(Window.partitionBy(file, "class").orderBy(win))
    steps = labels.withColumn("_prev", prev).filter(F.col("_prev").isNotNull())
    y, p = F.col("y"), F.col("_prev")
    n0, n1 = F.count_if(p == 0), F.count_if(p == 1)
    return steps.groupBy("class").agg(
        F.when(n0 > 0, F.count_if((p == 0) & (y == 1)) / n0).alias("p01"),
        F.when(n1 > 0, F.count_if((p == 1) & (y == 0)) / n1).alias("p10"))


def exclusive_sets(labels: DataFrame, site: str) -> DataFrame:
    """Classes with positives only at a site, only elsewhere, or both."""
    here = F.col("site") == site
    on = F.col("y") == 1
    per = labels.groupBy("class").agg(F.count_if(on & here).alias("n_here"),
                                      F.count_if(on & ~here).alias("n_else"))
    return (per.filter((F.col("n_here") > 0) | (F.col("n_else") > 0))
            .withColumn("where_seen", F.when(F.col("n_else") == 0, "only_here")
                        .when(F.col("n_here") == 0, "only_elsewhere").otherwise("common")))


def file_level(scores: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    return scores.groupBy(*keys).agg(F.max(score).alias(score), F.max("y").alias("y"))


def rare_reweight(chunks: DataFrame, recordings: DataFrame, label: str, below: int,
                  weight: float) -> DataFrame:
    """Chunks of labels with few recordings get a set weight; the counts are one row per label."""
    n = recordings.groupBy(label).agg(F.count(F.lit(1)).alias("n_rec"))
    return (chunks.join(n, label, "left")
            .withColumn("weight", F.when(F.col("n_rec") < below, F.lit(weight))
                        .otherwise(F.col("weight"))))
