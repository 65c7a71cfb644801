"""Rule levers: projections over score columns, and joined class or row tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnscore.functions.scalar import clip
from dawnscore.operators import align, metrics


def _lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def miss_rescue(p: Column, b: Column, c: Column, alpha=0.2, delta=0.3, low: float = 0.4) -> Column:
    lift = _lit(alpha) * F.greatest(F.greatest(b, c) - _lit(delta), F.lit(0.0)) * (1 - p)
    return clip(F.when(p < low, p + lift).otherwise(p), 0, 1)


def alarm_suppress(p: Column, a: Column, b: Column, alpha=0.1, delta: float = 0.3,
                   high: float = 0.6) -> Column:
    strength = clip((F.abs(a - b) - delta) / (1 - delta), 0, 1)
    return clip(F.when(p > high, p * (1 - _lit(alpha) * strength)).otherwise(p), 0, 1)


def detector_correction(p: Column, p_miss: Column, p_alarm: Column, alpha=0.2,
                        beta=0.2) -> Column:
    return clip(F.when(p < 0.5, p + _lit(alpha) * p_miss * (1 - p))
                .when(p > 0.5, p * (1 - _lit(beta) * p_alarm)).otherwise(p), 0, 1)


def band_gate(p: Column, low: Column, total: Column, taxon: Column, alpha: float = 0.5,
              tau: float = 0.4) -> Column:
    return F.when((low / (total + 1e-9) > tau) & (taxon == "Aves"), p * (1 - alpha)).otherwise(p)


def damp(p: Column, u: Column, scale: float = 0.1) -> Column:
    return p * F.greatest(1 - scale * clip(u, 0, 3), F.lit(0.5))


def route(p: Column, other: Column, u: Column, t: float = 1.0) -> Column:
    return F.when(u > t, other).otherwise(p)


def suppress_mapped(p: Column, u: Column, mapped: Column, scale: float = 0.2) -> Column:
    return F.when((u > 1.0) & mapped, p * (1 - scale)).otherwise(p)


def sd_lever(p: Column, sd: Column, high: float, boost: float, low: float, cut: float) -> Column:
    return clip(F.when(sd > high, p * (1 + boost)).when(sd < low, p * (1 - cut)).otherwise(p), 0, 1)


def signature_damped(df: DataFrame, row_keys: Sequence[str], base: str, lever: str, sig: str,
                     members: Column, t: float, shrink: float, out: str) -> DataFrame:
    """Shrink a lever's change on rows whose mean score over a class group is high."""
    mean = F.avg(F.when(members, F.col(sig))).over(Window.partitionBy(*row_keys))
    b, x = F.col(base), F.col(lever)
    return df.withColumn(out, F.when(mean > t, b + shrink * (x - b)).otherwise(x))


def hour_bias(df: DataFrame, logit: str, bucket: str, out: str) -> DataFrame:
    """Subtract (bucket mean - mean of all other buckets) per class from the logits.

    One grouped table of sums per (class, bucket) and one per class; the rest is total - bucket. A class
    seen in one bucket only has nothing to compare with and keeps its logits.
    """
    per = df.groupBy("class", bucket).agg(F.sum(logit).alias("_s"), F.count(F.lit(1)).alias("_n"))
    tot = per.groupBy("class").agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    bias = per.join(tot, "class").select(
        "class", bucket, (F.col("_s") / F.col("_n")
                          - F.try_divide(F.col("_ts") - F.col("_s"), F.col("_tn") - F.col("_n"))).alias("_bias"))
    return (df.join(bias, ["class", bucket])
            .withColumn(out, F.col(logit) - F.coalesce("_bias", F.lit(0.0))).drop("_bias"))


def derive_clusters(df: DataFrame, row_keys: Sequence[str], score: str, target: Column,
                    trigger: Column, min_pos: int = 3, top: int = 3) -> DataFrame:
    """Per target class: the trigger classes with the highest mean score on its positive rows.

    A positive cell carries its row's cells along, so no self join is needed.
    """
    pos = align.chosen_with_row(df, row_keys, {
        "class": F.col("class"), "q": F.col(score), "t": F.coalesce(trigger, F.lit(False))},
        target & (F.col("y") == 1))
    means = (pos.select(F.col("cell.class").alias("target"), F.explode(F.filter("row", lambda e: e["t"])).alias("_o"))
             .groupBy("target", F.col("_o.class").alias("trigger"))
             .agg(F.avg("_o.q").alias("mean_score"), F.count(F.lit(1)).alias("n_pos")))
    w = Window.partitionBy("target").orderBy(F.desc("mean_score"), "trigger")
    return (means.filter(F.col("n_pos") >= min_pos).withColumn("place", F.row_number().over(w))
            .filter(F.col("place") <= top))


def _triggers_in_row(df: DataFrame, clusters: dict[str, Sequence[str]], row_keys: Sequence[str],
                     score: str) -> DataFrame:
    """Per row one map target -> (min, mean) over its triggers; clusters is a small parameter."""
    aggs = []
    for target, members in clusters.items():
        inside = F.when(F.col("class").isin(*members), F.col(score))
        w = Window.partitionBy(*row_keys)
        aggs += [F.lit(target), F.struct(F.min(inside).over(w).alias("lo"),
                                         F.avg(inside).over(w).alias("mean"))]
    return df.withColumn("_trig", F.create_map(*aggs))


def cluster_whitelist(df: DataFrame, row_keys: Sequence[str], clusters: dict[str, Sequence[str]],
                      score: str, ratio: float = 1.3) -> DataFrame:
    """Targets whose mean trigger minimum on positives exceeds ratio x that on negatives."""
    rows = _triggers_in_row(df, clusters, row_keys, score)
    lo = F.try_element_at("_trig", F.col("class"))["lo"]
    per = rows.filter(F.col("class").isin(*clusters)).groupBy("class").agg(
        F.avg(F.when(F.col("y") == 1, lo)).alias("on_pos"),
        F.avg(F.when(F.col("y") == 0, lo)).alias("on_neg"))
    return per.withColumn("keep", F.col("on_pos") > F.col("on_neg") * ratio)


def cluster_rewrite(df: DataFrame, row_keys: Sequence[str], clusters: dict[str, Sequence[str]],
                    score: str, out: str, alpha: float = 2.0, suppress: float = 0.0,
                    use: str = "lo") -> DataFrame:
    """Raise targets by (1 + alpha * trigger score); optionally lower the triggers themselves."""
    rows = _triggers_in_row(df, clusters, row_keys, score)
    own = F.try_element_at("_trig", F.col("class"))[use]
    x = F.when(own.isNotNull(), F.col(score) * (1 + alpha * own)).otherwise(F.col(score))
    if suppress:
        for target, members in clusters.items():
            s = F.element_at("_trig", F.lit(target))[use]
            x = F.when(F.col("class").isin(*members), x * (1 - suppress * s)).otherwise(x)
    return rows.withColumn(out, clip(x, 0, 1)).drop("_trig")


def specialist_audit(scores: DataFrame, recordings: DataFrame, score: str, strict_rec: int,
                     strict_auc: float, loose_rec: int, loose_auc: float) -> DataFrame:
    """Class features and two candidate cuts (many recordings, several sites, weak AUC)."""
    feats = scores.groupBy("class").agg(
        F.sum("y").alias("n_pos"),
        F.count_distinct(F.when(F.col("y") == 1, F.col("site"))).alias("n_sites"))
    rec = recordings.groupBy("class").agg(F.count(F.lit(1)).alias("n_rec"))
    split = scores.withColumn("_ev", F.col("fold") == 0)
    auc = metrics.auc(split, ["class", "_ev"], score).groupBy("class").agg(
        F.max(F.when(F.col("_ev"), F.col("auc"))).alias("auc_eval"),
        F.max(F.when(~F.col("_ev"), F.col("auc"))).alias("auc_train"),
        F.max(F.when(F.col("_ev"), F.col("n_pos"))).alias("n_eval"))

    def cut(n, a):
        return ((F.col("n_rec") >= n) & (F.col("n_sites") >= 2) & (F.col("auc_eval") < a)
                & (F.col("n_eval") >= 3))
    return (feats.join(rec, "class").join(auc, "class")
            .withColumn("strict", cut(strict_rec, strict_auc))
            .withColumn("loose", cut(loose_rec, loose_auc)))
