"""Ranking and threshold metrics, per class and aggregated.

AUC and average precision come from running counts over distinct scores (see rank.py), so a class
may hold any share of the rows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dawnscore.operators import rank


def _label_counts(label: str):
    return {"pos": F.sum(F.col(label).cast("long")),
            "neg": F.sum((1 - F.col(label)).cast("long"))}


def _d(name: str):
    return F.col(name).cast("double")


def auc(df: DataFrame, keys: Sequence[str], score: str, label: str = "y") -> DataFrame:
    """Mann-Whitney AUC with average ties; only keys with both labels. Adds n_pos, n_neg.

    Wins are summed per value bucket and the negatives of lower buckets added afterwards, so after
    the counting shuffle only one line per (key, bucket) moves.
    """
    keys = list(keys)
    counts = (df.filter(F.col(score).isNotNull()).groupBy(*keys, score).agg(*[c.alias(k) for k, c in _label_counts(label).items()])
              .withColumn("__bucket", rank.value_bucket(F.col(score))))
    below = (Window.partitionBy(*keys, "__bucket").orderBy(score)
             .rowsBetween(Window.unboundedPreceding, -1))
    inner = counts.withColumn("_lower", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    buckets = inner.groupBy(*keys, "__bucket").agg(
        F.sum(_d("pos") * (_d("_lower") + _d("neg") / 2)).alias("_u"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    lower = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_off", F.coalesce(F.sum("_n").over(lower), F.lit(0)))
    out = buckets.groupBy(*keys).agg(
        F.sum(F.col("_u") + _d("_p") * _d("_off")).alias("_u"),
        F.coalesce(F.sum("_p"), F.lit(0)).alias("n_pos"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_neg"))
    return (out.filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
            .withColumn("auc", F.col("_u") / (_d("n_pos") * _d("n_neg"))).drop("_u"))


def auc_without(df: DataFrame, keys: Sequence[str], group: str, score: str,
                label: str = "y") -> DataFrame:
    """AUC of each key with one group left out, for all groups at once.

    Pairs inside and across the left-out group are subtracted from the total, so rows are not
    copied per group.
    """
    keys = list(keys)
    whole = rank.running_counts(df, keys, score, _label_counts(label))
    part = rank.running_counts(df, [*keys, group], score, _label_counts(label))
    ren = whole.select(*keys, score, *[F.col(c).alias(f"a_{c}") for c in (
        "pos", "neg", "pos_below", "neg_below", "pos_total", "neg_total")])
    total = whole.groupBy(*keys).agg(
        F.sum(_d("pos") * (_d("neg_below") + _d("neg") / 2)).alias("_u"))
    cut = part.join(ren, [*keys, score]).groupBy(*keys, group).agg(
        F.sum(_d("pos") * (_d("a_neg_below") + _d("a_neg") / 2)).alias("_own_pos"),
        F.sum(_d("neg") * (_d("a_pos_total") - _d("a_pos_below") - _d("a_pos") / 2)).alias("_own_neg"),
        F.sum(_d("pos") * (_d("neg_below") + _d("neg") / 2)).alias("_own"),
        (F.max("a_pos_total") - F.max("pos_total")).alias("n_pos"),
        (F.max("a_neg_total") - F.max("neg_total")).alias("n_neg"))
    u = F.col("_u") - F.col("_own_pos") - F.col("_own_neg") + F.col("_own")
    return (cut.join(total, keys).filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
            .select(*keys, group, "n_pos", "n_neg", (u / (_d("n_pos") * _d("n_neg"))).alias("auc")))


def macro_auc(df: DataFrame, keys: Sequence[str], score: str, label: str = "y",
              cls: str = "class", when_none: float | None = None) -> DataFrame:
    """Mean class AUC and number of classes per key."""
    out = auc(df, [*keys, cls], score, label).groupBy(*keys).agg(
        F.avg("auc").alias("macro"), F.count(F.lit(1)).alias("n_classes"))
    if when_none is not None:
        out = out.withColumn("macro", F.coalesce("macro", F.lit(when_none)))
    return out


def average_precision(df: DataFrame, keys: Sequence[str], score: str,
                      label: str = "y") -> DataFrame:
    """Sum of recall steps times precision, tied scores taken together."""
    c = rank.running_counts(df, keys, score, _label_counts(label))
    tp = _d("pos_total") - _d("pos_below")
    fp = _d("neg_total") - _d("neg_below")
    step = _d("pos") / _d("pos_total") * tp / (tp + fp)
    return (c.filter("pos_total > 0").groupBy(*keys).agg(F.sum(step).alias("ap")))


def precision_recall(df: DataFrame, keys: Sequence[str], score: str, t: float = 0.5,
                     label: str = "y", cls: str = "class") -> DataFrame:
    """Macro precision (classes that predict something) and recall over classes with positives."""
    hit, y = F.col(score) >= t, F.col(label) == 1
    per = df.groupBy(*keys, cls).agg(F.count_if(hit & y).alias("tp"), F.count_if(hit).alias("np"),
                                     F.count_if(y).alias("p")).filter("p > 0")
    return per.groupBy(*keys).agg(
        F.avg(F.when(F.col("np") > 0, F.col("tp") / F.col("np"))).alias("precision"),
        F.avg(F.col("tp") / F.col("p")).alias("recall"), F.count(F.lit(1)).alias("n_classes"))


def pearson(a: str, b: str):
    """Pearson correlation; null for a constant side (corr itself fails there in ANSI mode)."""
    sa, sb = F.stddev_pop(a), F.stddev_pop(b)
    return F.when((sa > 1e-12) & (sb > 1e-12), F.covar_pop(a, b) / (sa * sb))


def row_spearman(df: DataFrame, row_keys: Sequence[str], a: str, b: str,
                 keep: Sequence[str] = ()) -> DataFrame:
    """Spearman across the classes of each row; constant rows give null."""
    r = df.select(*row_keys, *keep, rank.small_rank(row_keys, a).alias("_ra"),
                  rank.small_rank(row_keys, b).alias("_rb"))
    return r.groupBy(*row_keys).agg(pearson("_ra", "_rb").alias("rho"),
                                    *[F.first(k).alias(k) for k in keep])


def row_spearman_summary(df: DataFrame, row_keys: Sequence[str], a: str, b: str,
                         by: Sequence[str] = ()) -> DataFrame:
    """by must be a subset of row_keys."""
    rho = row_spearman(df, row_keys, a, b).filter(F.col("rho").isNotNull())
    return rho.groupBy(*by).agg(F.avg("rho").alias("sp_mean"), F.min("rho").alias("sp_min"),
                                F.count(F.lit(1)).alias("n_rows"))


def column_spearman(df: DataFrame, a: str, b: str, keys: Sequence[str] = ("class",)) -> DataFrame:
    """Spearman across all rows of each class."""
    r = rank.add_ranks(df.select(*keys, a, b), keys, {a: "_ra", b: "_rb"}, "raw")
    return r.groupBy(*keys).agg(pearson("_ra", "_rb").alias("rho"))


def stream_correlation(wide: DataFrame, streams: Sequence[str],
                       keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlation of each pair of stream columns: one aggregate, then unpivoted."""
    pairs = [(a, b) for i, a in enumerate(streams) for b in streams[i + 1:]]
    agg = wide.groupBy(*keys).agg(*[pearson(a, b).alias(f"{a}__{b}") for a, b in pairs])
    rows = F.array(*[F.struct(F.lit(a).alias("s1"), F.lit(b).alias("s2"),
                              F.col(f"{a}__{b}").alias("r")) for a, b in pairs])
    return agg.select(*keys, F.inline(rows))


def ks_statistic(long: DataFrame, keys: Sequence[str], score: str, is_b: str) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance between rows with is_b = 0 and 1; null if one side is empty."""
    c = rank.running_counts(long, keys, score, {
        "b": F.sum(F.col(is_b).cast("long")), "a": F.sum((1 - F.col(is_b)).cast("long"))})
    gap = F.abs(F.try_divide(_d("a_below") + _d("a"), _d("a_total"))
                - F.try_divide(_d("b_below") + _d("b"), _d("b_total")))
    return c.groupBy(*keys).agg(F.max(gap).alias("ks"))


def f1_thresholds(files: DataFrame, score: str, grid: Sequence[float], label: str = "y",
                  cls: str = "class", min_pos: int = 3) -> DataFrame:
    """Best F1 threshold per class; all grid counts are taken in one pass."""
    y = F.col(label) == 1
    names = [f"t{i}" for i in range(len(grid))]
    counts = files.groupBy(cls).agg(
        F.count_if(y).alias("p"),
        *[F.count_if(y & (F.col(score) >= t)).alias(f"tp_{n}") for n, t in zip(names, grid)],
        *[F.count_if(F.col(score) >= t).alias(f"np_{n}") for n, t in zip(names, grid)])

    def f1(n):
        prec = _d(f"tp_{n}") / (_d(f"np_{n}") + 1e-8)
        rec = _d(f"tp_{n}") / (_d("p") + 1e-8)
        return 2 * prec * rec / (prec + rec + 1e-8)

    best = F.array_max(F.array(*[F.struct(f1(n).alias("f1"), F.lit(-t).alias("neg_t"))
                                 for n, t in zip(names, grid)]))
    return (counts.filter(F.col("p") >= min_pos).select(cls, best.alias("_b"))
            .select(cls, F.col("_b.f1").alias("f1"),
                    F.when(F.col("_b.f1") > 0, -F.col("_b.neg_t")).otherwise(F.lit(0.5))
                    .alias("threshold")))
