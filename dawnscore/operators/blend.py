"""Blends of score streams held as columns of one row."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnscore.functions.scalar import clip, sigmoid, total
from dawnscore.operators import metrics, normalize, rank, smooth
from dawnscore.operators.sampling import seeded
from dawnscore.operators.scalars import attach


Tie = Callable[[Column], Column]


def same(col: Column) -> Column:
    """Derived scores as they are; a caller may pass a rounding that merges near ties instead."""
    return col


def mean_of_streams(long: DataFrame, keys: Sequence[str], score: str = "p") -> DataFrame:
    return long.groupBy(*keys).agg(F.avg(score).alias(score))


def linear(weights: dict[str, float]) -> Column:
    """Weighted mean over the streams that are present, weights renormalised."""
    top = total([F.coalesce(F.lit(float(w)) * F.col(s), F.lit(0.0)) for s, w in weights.items()])
    bottom = total([F.when(F.col(s).isNotNull(), F.lit(float(w))).otherwise(F.lit(0.0))
                    for s, w in weights.items()])
    return top / bottom


def class_stats(df: DataFrame, streams: Sequence[str], keys: Sequence[str] = ("class",)) -> DataFrame:
    """Mean and population std of all streams per class, attached in one join."""
    aggs = [f(s).alias(f"{n}_{s}") for s in streams
            for n, f in (("_mean", F.avg), ("_std", F.stddev_pop))]
    return df.join(df.groupBy(*keys).agg(*aggs), list(keys))


def z(s: str, eps: float = 1e-6) -> Column:
    return (F.col(s) - F.col(f"_mean_{s}")) / (F.col(f"_std_{s}") + eps)


def zscore_blend(df: DataFrame, weights: dict[str, float], out: str, base: str) -> DataFrame:
    """Weighted z-scores mapped back to the scale of the base stream."""
    d = class_stats(df, list(weights))
    mix = total([F.lit(float(w)) * z(s) for s, w in weights.items()])
    return (d.withColumn(out, mix * (F.col(f"_std_{base}") + 1e-6) + F.col(f"_mean_{base}"))
            .drop(*[c for c in d.columns if c.startswith(("_mean", "_std"))]))


def with_ranks(df: DataFrame, streams: Sequence[str], keys: Sequence[str] = ("class",)) -> DataFrame:
    """Percentile rank of each stream inside its class as rank_<stream>."""
    return rank.add_ranks(df, keys, {s: f"rank_{s}" for s in streams})


def rank_blend(df: DataFrame, a: str, b: str, out: str, w: float = 0.30) -> DataFrame:
    d = with_ranks(df, [a, b])
    return d.withColumn(out, (1 - w) * F.col(f"rank_{a}") + w * F.col(f"rank_{b}"))


def max_family(streams: Sequence[str], mean: Column | None = None) -> dict[str, Column]:
    cols = [F.col(s) for s in streams]
    top = F.greatest(*cols)
    avg = mean if mean is not None else total(cols) / len(cols)
    return {"max": top, "max_or_mean": F.when(top > 0.5, top).otherwise(avg),
            "lift": cols[0] + 0.1 * (F.greatest(*cols[1:]) - cols[0])}


def confidence_weighted(streams: Sequence[str]) -> Column:
    conf = {s: F.abs(F.col(s) - 0.5) * 2 for s in streams}
    return total([F.col(s) * conf[s] for s in streams]) / (total(list(conf.values())) + 1e-6)


def log_sum_exp(df: DataFrame, streams: Sequence[str], out: str) -> DataFrame:
    """ln of the summed exponentials, scaled by its overall minimum and maximum."""
    raw = df.withColumn("_l", F.log(total([F.exp(s) for s in streams])))
    ends = raw.agg(F.min("_l").alias("_lo"), F.max("_l").alias("_hi"))
    return (attach(raw, ends).withColumn(out, (F.col("_l") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-9))
            .drop("_l", "_lo", "_hi"))


def _row(row_keys: Sequence[str]):
    return Window.partitionBy(*row_keys)


def gap_weighted(df: DataFrame, row_keys: Sequence[str], a: str, b: str, out: str,
                 beta: float = 0.2) -> DataFrame:
    """Row weight from the normalised top1 - top2 gap of stream a; blend of class z-scores."""
    placed = class_stats(df, [a, b]).withColumn(
        "_k", F.row_number().over(_row(row_keys).orderBy(F.desc(a), "class")))
    nth = [F.max(F.when(F.col("_k") == k, F.col(a))).over(_row(row_keys)) for k in (1, 2)]
    d = placed.withColumn("_gap", nth[0] - nth[1]).drop("_k")
    # the gap is constant in a row and every row has all classes, so cell statistics equal row ones
    stats = d.agg(F.avg("_gap").alias("_gm"), F.stddev_pop("_gap").alias("_gs"))
    zg = clip((F.col("_gap") - F.col("_gm")) / (F.col("_gs") + 1e-8), -2, 2)
    w = clip(0.8 + beta * zg / 2, 0.5, 0.95)
    return (attach(d, stats).withColumn("_w", w)
            .withColumn(out, F.col("_w") * z(a, 1e-8) + (1 - F.col("_w")) * z(b, 1e-8)))


def disagreement_shrink(df: DataFrame, row_keys: Sequence[str], a: str, b: str, out: str,
                        k: float = 0.3) -> DataFrame:
    """Shrink the z-blend to its row mean where the streams differ (row RMS, min-max scaled)."""
    diff = F.col(a) - F.col(b)
    d = class_stats(df, [a, b]).withColumn("_base", 0.8 * z(a, 1e-8) + 0.2 * z(b, 1e-8))
    d = d.select("*", F.sqrt(F.avg(diff * diff).over(_row(row_keys))).alias("_rms"),
                 F.avg("_base").over(_row(row_keys)).alias("_rm"))
    ends = d.agg(F.min("_rms").alias("_lo"), F.max("_rms").alias("_hi"))
    s = k * (F.col("_rms") - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1e-8)
    return attach(d, ends).withColumn(out, (1 - s) * F.col("_base") + s * F.col("_rm"))


def disagreement_pull(streams: Sequence[str], threshold: float = 0.3) -> Column:
    """Pull the mean to 0.5 by the population std over the streams."""
    n = len(streams)
    mean = total([F.col(s) for s in streams]) / n
    std = F.sqrt(total([(F.col(s) - mean) * (F.col(s) - mean) for s in streams]) / n)
    pull = clip(std / threshold, 0, 1)
    return (1 - pull) * mean + pull * 0.5


def agreement(p: Column, a: Column, b: Column, w: float = 0.05) -> Column:
    return p * ((1 - w) + w * (1 - F.abs(a - b)))


def top_k_flags(df: DataFrame, row_keys: Sequence[str], streams: Sequence[str],
                k: int) -> DataFrame:
    """top_<stream> = class is in the row's best k; n_top counts the streams that agree."""
    for s in streams:
        w = Window.partitionBy(*row_keys).orderBy(F.desc(s), "class")
        df = df.withColumn(f"top_{s}", (F.row_number().over(w) <= k).cast("int"))
    return df.withColumn("n_top", total([F.col(f"top_{s}") for s in streams]))


def consensus_lever(p: Column, boost: float, suppress: float, streams: int = 2) -> Column:
    n = F.col("n_top")
    return clip(F.when(n == streams, p * (1 + boost)).when(n > 0, p * (1 - suppress)).otherwise(p),
                0, 1)


def rank_where_different(base: str, streams: Sequence[str], threshold: float) -> Column:
    cols = [F.col(s) for s in streams]
    mean = total([F.col(f"rank_{s}") for s in streams]) / len(streams)
    return F.when(F.greatest(*cols) - F.least(*cols) > threshold, mean).otherwise(F.col(base))


def routed_weight(auc_a: Column, auc_b: Column) -> Column:
    """Weight of stream a by fold AUC: reversed a, reversed b, both strong with b ahead."""
    return (F.when((auc_a < 0.5) & (auc_b > 0.7), 0.2).when((auc_b < 0.5) & (auc_a > 0.7), 1.0)
            .when((auc_a > 0.7) & (auc_b > 0.7) & (auc_b - auc_a > 0.15), 0.4).otherwise(0.7))


def soft_routed_weight(auc_a: Column, auc_b: Column, scale: float = 5.0) -> Column:
    return 1 - (0.1 + 0.6 * sigmoid(scale * (auc_b - auc_a)))


def class_fold_auc(df: DataFrame, a: str, b: str, fold: str = "fold", min_folds: int = 2) -> DataFrame:
    """Mean fold AUC per class of two streams; classes with too few folds drop out."""
    from dawnscore.operators.audit import paired_auc
    return (paired_auc(df, ["class", fold], a, b).groupBy("class")
            .agg(F.avg("auc_ref").alias("auc_a"), F.avg("auc_cand").alias("auc_b"),
                 F.count(F.lit(1)).alias("_k")).filter(F.col("_k") >= min_folds).drop("_k"))


def aliveness_weight(state: Column) -> Column:
    return F.when(state == "dead", 0.0).when(state == "semi", 0.3).otherwise(0.7)


def continuous_aliveness(p99: Column) -> Column:
    return clip(0.7 * clip(p99 / 0.5, 0, 1), 0, 0.7)


def rescue_rules(df: DataFrame, a: str, b: str, out: str, w: float = 0.30,
                 rules: Sequence[str] = ("fake", "cont", "spike"),
                 series: Sequence[str] = ("file_id", "class"), win: str = "win",
                 tie: Tie = same) -> DataFrame:
    """Rank blend with three conditional rescues applied in order; a subset can be chosen.

    fake: only stream a fires; cont: strong context rank while b is quiet; spike: only b's rank
    is extreme. Every rule moves the blend a fixed share towards the trusted rank. The context
    smoothing runs first, on the partitioning by file, then all ranks are taken from that table.
    """
    with_context = bool({"cont", "spike"} & set(rules))
    d = (df.withColumn("_pa", clip(F.col(a), 1e-6, 1 - 1e-6))
         .withColumn("_pb", clip(F.col(b), 1e-6, 1 - 1e-6)))
    ranks = {"_pa": "rank_a", "_pb": "rank_b"}
    if with_context:
        s = smooth.Series(series, win)
        d = d.withColumn("_ctx", tie(smooth.fat_tail(s, "_pa")))
        ranks["_ctx"] = "rank_ctx"
    d = rank.add_ranks(d, ["class"], ranks)
    ra, rb, pa, pb = (F.col(c) for c in ("rank_a", "rank_b", "_pa", "_pb"))
    pred = (1 - w) * ra + w * rb
    fake = (pa > 0.50) & (pb < 0.05)
    if with_context:
        rc = F.col("rank_ctx")
        cont = (rc > 0.88) & (ra > 0.75) & (pb < 0.12) & ~fake
        spike = (rb > 0.95) & (ra < 0.80) & ~fake & ~cont
    if "fake" in rules:
        pred = F.when(fake, 0.88 * pred + 0.12 * ra).otherwise(pred)
    if "cont" in rules:
        pred = F.when(cont, 0.85 * pred + 0.15 * F.greatest(ra, rc)).otherwise(pred)
    if "spike" in rules:
        pred = F.when(spike, 0.88 * pred + 0.12 * rb).otherwise(pred)
    return d.withColumn(out, pred).drop("_pa", "_pb", "_ctx")


def shift_mean(long: DataFrame, file_keys: Sequence[str], score: str, shifts: Sequence[int],
               windows: int = 12, win: str = "win") -> DataFrame:
    """Mean over circularly shifted passes, each score put back at its own window."""
    back = F.pmod(F.col(win) + F.col("shift"), F.lit(windows)).cast("int")
    return (long.withColumn(win, back).filter(F.col("shift").isin(*shifts))
            .groupBy(*file_keys, win).agg(F.avg(score).alias(score)))


def weight_sweep(df: DataFrame, a: str, b: str, weights: Sequence[float],
                 file: str = "file_id", tie: Tie = same) -> DataFrame:
    """File-level macro AUC of w*a + (1-w)*b for each weight; best marks the winner, the smallest on ties."""
    cols = {f"{x:.2f}": f"_w{i}" for i, x in enumerate(weights)}
    mixes = [F.max(x * F.col(a) + (1 - x) * F.col(b)).alias(f"_w{i}") for i, x in enumerate(weights)]
    files = df.groupBy(file, "class").agg(F.max("y").alias("y"), *mixes)
    files = files.withColumns({c: tie(F.col(c)) for c in cols.values()})
    from dawnscore.operators.align import unpivot_streams
    swept = metrics.macro_auc(unpivot_streams(files, cols, "w", "_p"), ["w"], "_p")
    # one row per weight of the caller's list
    order = Window.orderBy(F.desc(tie(F.col("macro"))), F.col("w").cast("double"))
    return swept.withColumn("best", F.row_number().over(order) == 1)


def best_class_weight(df: DataFrame, a: str, b: str, weights: Sequence[float],
                      tie: Tie = same) -> DataFrame:
    """Per class the weight of stream a with the best AUC (smallest weight on ties)."""
    from dawnscore.operators.align import unpivot_streams
    cols = {f"{x:.2f}": f"_w{i}" for i, x in enumerate(weights)}
    mixed = df.select("class", "y", *[
        tie(x * F.col(a) + (1 - x) * F.col(b)).alias(f"_w{i}")
        for i, x in enumerate(weights)])
    per = metrics.auc(unpivot_streams(mixed, cols, "w", "_p"), ["class", "w"], "_p")
    best = F.max_by(F.struct("w", "auc"), F.struct(tie(F.col("auc")), -F.col("w").cast("double")))
    return per.groupBy("class").agg(best.alias("_b")).select(
        "class", F.col("_b.w").alias("w"), F.col("_b.auc").alias("auc"))


def masked_passes(df: DataFrame, score: str, out: str, passes: int = 5, share: float = 0.05,
                  seed: int = 42) -> DataFrame:
    """Mean over passes that zero a seeded share of the classes."""
    hidden = [F.pmod(seeded(F.col("class"), seed + i), F.lit(10_000)) < share * 10_000
              for i in range(passes)]
    kept = total([(~h).cast("double") for h in hidden]) / passes
    return df.withColumn(out, F.col(score) * kept)
