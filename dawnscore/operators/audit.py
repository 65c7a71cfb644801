"""Error breakdowns and candidate audits over score tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnscore.functions import vec
from dawnscore.operators import align, metrics
from dawnscore.operators.scalars import attach

TAXA = ("Aves", "Amphibia", "Insecta", "Mammalia", "Reptilia")


def per_taxon(class_auc: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return class_auc.groupBy(*keys, "taxon").agg(F.avg("auc").alias("macro"),
                                                 F.count(F.lit(1)).alias("n_classes"))


def paired_auc(df: DataFrame, keys: Sequence[str], ref: str, cand: str,
               label: str = "y") -> DataFrame:
    """Class AUC of two score columns side by side, from one counting pass."""
    both = align.unpivot_streams(df.select(*keys, label, ref, cand), {"ref": ref, "cand": cand},
                                 "_m", "_p")
    per = metrics.auc(both, [*keys, "_m"], "_p", label)
    return per.groupBy(*keys).agg(
        F.max(F.when(F.col("_m") == "ref", F.col("auc"))).alias("auc_ref"),
        F.max(F.when(F.col("_m") == "cand", F.col("auc"))).alias("auc_cand"),
        F.max("n_pos").alias("n_pos")).withColumn("delta", F.col("auc_cand") - F.col("auc_ref"))


def verdict(sp: Column, aves_delta: Column, delta: Column) -> Column:
    near = sp >= 0.99
    return (F.when(sp.isNull(), "?")
            .when(near & (aves_delta.isNull() | (aves_delta >= 0)), "A")
            .when(near & (F.abs(delta) <= 0.005), "B").otherwise("C"))


def audit_rows(df: DataFrame, keys: Sequence[str], ref: str, cand: str,
               row_keys: Sequence[str] = ("file_id", "win"),
               base: DataFrame | None = None) -> DataFrame:
    """One audit line per key: macro, change, change per taxon, row Spearman, verdict.

    base: the rows before they were copied per parameter set; the reference is then ranked once.
    """
    keys = list(keys)
    if base is None:
        per = paired_auc(df, [*keys, "class", "taxon"], ref, cand)
    else:
        one = metrics.auc(base, ["class"], ref).select("class", F.col("auc").alias("auc_ref"))
        per = (metrics.auc(df, [*keys, "class", "taxon"], cand).withColumnRenamed("auc", "auc_cand")
               .join(one, "class").withColumn("delta", F.col("auc_cand") - F.col("auc_ref")))
    lines = per.groupBy(*keys).agg(
        F.avg("auc_cand").alias("macro"), F.avg("delta").alias("macro_delta"),
        *[F.avg(F.when(F.col("taxon") == t, F.col("delta"))).alias(f"d_{t.lower()}") for t in TAXA],
        F.count(F.lit(1)).alias("n_classes"))
    sp = metrics.row_spearman_summary(df, [*keys, *row_keys], ref, cand, by=keys)
    sp = sp.select(*keys, "sp_mean")
    both = lines.join(sp, keys) if keys else attach(lines, sp)
    return both.withColumn("verdict", verdict(F.col("sp_mean"), F.col("d_aves"),
                                              F.col("macro_delta")))


def grouped_macro(df: DataFrame, group: str, score: str, row_keys: Sequence[str],
                  min_rows: int = 0, min_classes: int = 1,
                  streams: Sequence[str] = ()) -> DataFrame:
    rows = df.groupBy(group).agg((F.count(F.lit(1)) / F.count_distinct("class")).alias("n_rows"))
    macro = metrics.macro_auc(df, [group, *streams], score)
    return (macro.join(rows, group)
            .filter((F.col("n_rows") >= min_rows) & (F.col("n_classes") >= min_classes)))


def bucketed_auc(class_auc: DataFrame, features: DataFrame, bucket: Column,
                 keys: Sequence[str] = ()) -> DataFrame:
    """Mean class AUC by a bucket of class features."""
    return (class_auc.join(features, "class").withColumn("bucket", bucket)
            .groupBy("bucket", *keys).agg(F.avg("auc").alias("macro"),
                                          F.count(F.lit(1)).alias("n_classes")))


def miss_buckets(long: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    p = F.col(score)
    name = (F.when(p < 0.1, "confident_miss").when(p < 0.3, "weak_miss")
            .when(p < 0.5, "borderline").otherwise("caught"))
    per = long.filter("y = 1").groupBy(*keys, name.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(*keys)  # four rows per key
    return per.withColumn("share", F.col("n") / F.sum("n").over(whole))


def miss_agreement(wide: DataFrame, streams: Sequence[str], t: float = 0.5) -> DataFrame:
    """Share of stream 1's misses that stream 2 misses too."""
    pos = wide.filter("y = 1")
    miss = {s: F.col(s) < t for s in streams}
    aggs = [F.count_if(miss[a] & miss[b]).alias(f"{a}__{b}") for a in streams for b in streams]
    one = pos.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(a).alias("s1"), F.lit(b).alias("s2"),
                              F.col(f"{a}__{b}").alias("n_both"),
                              F.when(F.col(f"{a}__{a}") > 0,
                                     F.col(f"{a}__{b}") / F.col(f"{a}__{a}")).alias("share"))
                     for a in streams for b in streams])
    return one.select(F.inline(rows))


def universal_misses(wide: DataFrame, keys: Sequence[str], streams: Sequence[str],
                     t: float = 0.5) -> DataFrame:
    n = sum(((F.col(s) < t).cast("int") for s in streams[1:]), (F.col(streams[0]) < t).cast("int"))
    k = len(streams)
    return wide.filter("y = 1").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_pos"), F.count_if(n == k).alias("all_miss"),
        F.count_if(n == 0).alias("all_catch"),
        F.count_if((n > 0) & (n < k)).alias("mixed"),
        F.avg((n == k).cast("double")).alias("miss_rate"))


def predicted_instead(df: DataFrame, row_keys: Sequence[str], score: str, missed: Column,
                      top: int = 3) -> DataFrame:
    """For missed positives: the row's top classes, one output row each."""
    d = align.chosen_with_row(df, row_keys, {
        "class": F.col("class"), "taxon": F.col("taxon"), "n": -F.col(score)},
        (F.col("y") == 1) & missed)
    tops = F.slice(F.array_sort(F.transform("row", lambda e: F.struct(
        e["n"].alias("n"), e["class"].alias("other"), e["taxon"].alias("other_taxon")))), 1, top)
    return d.select(*row_keys, "cell.class", "cell.taxon", F.posexplode(tops).alias("_k", "_o")).select(
        *row_keys, "class", "taxon", "_o.other", "_o.other_taxon", (F.col("_k") + 1).alias("place"))


def ranked_above(df: DataFrame, row_keys: Sequence[str], score: str, top: int = 3) -> DataFrame:
    """Per class: the classes that most often outscore it on its positive rows."""
    d = align.chosen_with_row(df, row_keys, {"other": F.col("class"), "q": F.col(score)}, F.col("y") == 1)
    above = F.filter("row", lambda e: e["q"] > F.col("cell")["q"])
    counts = (d.select(F.col("cell.other").alias("class"), F.explode(above).alias("_o"))
              .groupBy("class", F.col("_o.other").alias("other")).agg(F.count(F.lit(1)).alias("n_above")))
    w = Window.partitionBy("class").orderBy(F.desc("n_above"), "other")  # one row per class pair
    return counts.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)


def confusion_pairs(df: DataFrame, row_keys: Sequence[str], score: str, group: str,
                    weak: DataFrame, top: int = 3) -> DataFrame:
    """Weak classes: their group's top other classes on positive rows, as pair counts."""
    tagged = df.join(weak.select("class", F.lit(True).alias("_weak")), "class", "left")
    d = align.chosen_with_row(tagged, [*row_keys, group], {"n": -F.col(score), "other": F.col("class")},
                              (F.col("y") == 1) & F.col("_weak"))
    others = F.slice(F.array_sort(F.filter("row", lambda e: e["other"] != F.col("cell")["other"])), 1, top)
    return (d.select(F.col("cell.other").alias("class"), F.explode(others).alias("_o"))
            .groupBy("class", F.col("_o.other").alias("other")).agg(F.count(F.lit(1)).alias("n_pairs")))


def false_positive_shares(long: DataFrame, keys: Sequence[str], score: str) -> DataFrame:
    p = F.col(score)
    return long.filter("y = 0").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_neg"), F.avg((p > 0.7).cast("double")).alias("high_share"),
        F.avg(((p > 0.5) & (p <= 0.7)).cast("double")).alias("mid_share"))


def present_on_false_positives(df: DataFrame, row_keys: Sequence[str], fired: Column) -> DataFrame:
    """Labels that truly are on the rows where a class fires wrongly."""
    d = align.chosen_with_row(df, row_keys, {"class": F.col("class"), "y": F.col("y")},
                              (F.col("y") == 0) & fired)
    return (d.select("cell.class", F.explode(F.filter("row", lambda e: e["y"] == 1)).alias("_o"))
            .groupBy("class", F.col("_o.class").alias("present")).agg(F.count(F.lit(1)).alias("n")))


def best_stream(class_auc: DataFrame, keys: Sequence[str] = ("class", "taxon")) -> DataFrame:
    """Winner, its AUC and the margin to the runner-up (one row per stream and class)."""
    ranked = F.sort_array(F.collect_list(F.struct("auc", "model")), False)
    return class_auc.groupBy(*keys).agg(ranked.alias("_r")).select(
        *keys, F.col("_r")[0]["model"].alias("best"), F.col("_r")[0]["auc"].alias("best_auc"),
        (F.col("_r")[0]["auc"] - F.try_element_at("_r", F.lit(2))["auc"]).alias("margin"))


def win_tie_loss(pairs: DataFrame, band: float = 0.01) -> DataFrame:
    d = F.col("delta")
    return pairs.agg(F.count_if(d > band).alias("wins"), F.count_if(F.abs(d) <= band).alias("ties"),
                     F.count_if(d < -band).alias("losses"), F.avg(d).alias("mean"),
                     F.stddev(d).alias("std"), F.avg((d > 0).cast("double")).alias("share_pos"))


def quadrant_auc(df: DataFrame, score: str, features: Sequence[str], t: float = 0.5) -> DataFrame:
    """AUC of features for TP vs FP, TN vs FN, correct vs wrong (wrong = positive side)."""
    fires, y = F.col(score) >= t, F.col("y") == 1
    wrong = (fires != y).cast("int")
    side = F.when(fires, F.lit("tp_fp")).otherwise(F.lit("tn_fn"))
    tagged = df.select(*features, wrong.alias("_w"), F.array(side, F.lit("all")).alias("_c"))
    long = align.unpivot_streams(tagged, {f: f for f in features}, "feature", "_v")
    long = long.select("feature", "_v", F.col("_w"), F.explode("_c").alias("contrast"))
    return metrics.auc(long, ["feature", "contrast"], "_v", "_w")


def row_uncertainty(df: DataFrame, row_keys: Sequence[str], score: str, n_classes: int,
                    keep: Sequence[str] = ()) -> DataFrame:
    """Normalised entropy, top1, margin, top-5 mass, effective classes of each row."""
    arr = F.sort_array(F.collect_list(score), False)
    rows = df.groupBy(*row_keys).agg(arr.alias("_p"), *[F.first(k).alias(k) for k in keep])
    rows = rows.withColumn("_s", vec.fold(F.col("_p")))
    q = F.transform("_p", lambda x: x / (F.col("_s") + 1e-12))
    h = vec.fold(F.transform(q, lambda x: -x * F.log(x + 1e-12)))
    sq = vec.fold(F.transform("_p", lambda x: x * x))
    return rows.select(
        *row_keys, *keep, (h / F.log(F.lit(float(n_classes)))).alias("entropy"),
        F.col("_p")[0].alias("top1"), (F.col("_p")[0] - F.col("_p")[1]).alias("margin"),
        (vec.fold(F.slice("_p", 1, 5)) / (F.col("_s") + 1e-12)).alias("top5"),
        (F.col("_s") * F.col("_s") / (sq + 1e-12)).alias("effective"))


def ambiguity_zones(rows: DataFrame) -> DataFrame:
    """Shares of rows in the (overlapping) zones of top score and margin."""
    m, g = F.col("top1"), F.col("margin")
    zones = {"zone_a": m > 0.7, "zone_b": (m >= 0.3) & (m <= 0.7) & (g > 0.2),
             "zone_c": (m > 0.3) & (g < 0.2), "zone_d": m < 0.3}
    return rows.agg(F.count(F.lit(1)).alias("n_rows"),
                    *[F.avg(c.cast("double")).alias(k) for k, c in zones.items()])


def row_vocabulary_class(df: DataFrame, row_keys: Sequence[str], unmapped: Sequence[str],
                         keep: Sequence[str] = ()) -> DataFrame:
    on = F.col("y") == 1
    unk = F.count_if(on & F.col("class").isin(*unmapped))
    kno = F.count_if(on & ~F.col("class").isin(*unmapped))
    kind = (F.when((unk > 0) & (kno == 0), "UNK_ONLY").when((unk > 0) & (kno > 0), "UNK_MIXED")
            .when(kno > 0, "KNOWN_ONLY").otherwise("BG"))
    return df.groupBy(*row_keys).agg(kind.alias("kind"), *[F.first(k).alias(k) for k in keep])


def group_separation(rows: DataFrame, metrics_: Sequence[str], positive: str, negative: str,
                     by: Sequence[str] = (), min_each: int = 3) -> DataFrame:
    """AUC of each metric for one row kind against another, optionally per group."""
    two = (rows.filter(F.col("kind").isin(positive, negative))
           .withColumn("_y", (F.col("kind") == positive).cast("int")))
    long = align.unpivot_streams(two.select(*by, "_y", *metrics_), {m: m for m in metrics_},
                                 "metric", "_v")
    out = metrics.auc(long, [*by, "metric"], "_v", "_y")
    return out.filter((F.col("n_pos") >= min_each) & (F.col("n_neg") >= min_each))


def separation_summary(per_group: DataFrame) -> DataFrame:
    med = F.median("auc")
    return per_group.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n_groups"), med.alias("median_auc"),
        (F.abs(med - 0.5) * 2).alias("strength"))


def f1_grid(lo: float = 0.25, hi: float = 0.70, step: float = 0.05) -> list[float]:
    return [round(lo + i * step, 2) for i in range(int(round((hi - lo) / step)) + 1)]


def with_grid(df: DataFrame, params: dict[str, Sequence[float]]) -> DataFrame:
    """Every row once per parameter combination: the literal list is short and caller-given."""
    for name, values in params.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(float(x)) for x in values])))
    return df


def self_rank(df: DataFrame, row_keys: Sequence[str], score: str) -> DataFrame:
    """On positive rows: classes scoring above the true one, and its own score, per class."""
    place = F.rank().over(Window.partitionBy(*row_keys).orderBy(F.desc(score))) - 1
    return (df.withColumn("_above", place).filter("y = 1").groupBy("class")
            .agg(F.count(F.lit(1)).alias("n"), F.avg("_above").alias("mean_above"),
                 F.avg(score).alias("mean_self")))


def fold_stability(df: DataFrame, score: str, fold: str = "fold") -> DataFrame:
    return (metrics.auc(df, ["class", fold], score).groupBy("class")
            .agg(F.avg("auc").alias("mean"), F.stddev_pop("auc").alias("std"),
                 F.count(F.lit(1)).alias("n_folds")))


def site_spread(site_macro: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return site_macro.groupBy(*keys).agg((F.max("macro") - F.min("macro")).alias("spread"),
                                         F.count(F.lit(1)).alias("n_sites"))


def burst_counts(df: DataFrame, key: str, steps: str, sigmas: float = 2.0) -> DataFrame:
    """Steps whose magnitude exceeds mean + k*std of all steps, counted per row."""
    mags = df.withColumn("_m", F.transform(steps, lambda v: vec.norm(v)))
    x = F.explode("_m").alias("x")
    stats = mags.select(x).agg((F.avg("x") + sigmas * F.stddev_pop("x")).alias("_t"))
    return (attach(mags, stats).withColumn("n_bursts", F.size(F.filter("_m", lambda v: v > F.col("_t"))))
            .drop("_m"))


def stream_difference(df: DataFrame, a: str, b: str) -> DataFrame:
    d = F.abs(F.col(a) - F.col(b))
    return df.agg(F.avg(d).alias("mad"), F.avg((d > 1e-6).cast("double")).alias("changed"))


def site_inflation(long: DataFrame, site: str, score: str) -> DataFrame:
    here = F.col("site") == site
    return long.groupBy("class", "model").agg(
        (F.avg(F.when(here, F.col(score))) - F.avg(F.when(~here, F.col(score)))).alias("inflation"))


def taxon_rows(df: DataFrame, row_keys: Sequence[str], scores: Sequence[str]) -> DataFrame:
    """Row x taxon maxima of scores and labels."""
    return df.groupBy(*row_keys, "taxon").agg(*[F.max(s).alias(s) for s in scores],
                                              F.max("y").alias("y"))


def top_taxon_quadrants(df: DataFrame, row_keys: Sequence[str], a: str, b: str,
                        taxon: str = "Aves") -> DataFrame:
    """2x2 of 'top class is of the taxon' for two streams, with shares of the truth."""
    def top(s):
        return F.max_by("taxon", F.struct(F.col(s), F.col("class"))) == taxon
    on = F.col("y") == 1
    rows = df.groupBy(*row_keys).agg(
        top(a).alias("a_says"), top(b).alias("b_says"),
        F.max((on & (F.col("taxon") == taxon)).cast("int")).alias("_in"),
        F.max((on & (F.col("taxon") != taxon)).cast("int")).alias("_out"))
    return rows.groupBy("a_says", "b_says").agg(
        F.count(F.lit(1)).alias("n_rows"), F.avg("_in").alias("share_taxon"),
        F.avg("_out").alias("share_other"))


def kind_profile(rows: DataFrame, metrics_: Sequence[str]) -> DataFrame:
    long = align.unpivot_streams(rows.select("kind", *metrics_), {m: m for m in metrics_},
                                 "metric", "_v")
    return long.groupBy("kind", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_v").alias("mean"), F.stddev_pop("_v").alias("std"))


def lever_isolation(df: DataFrame, base: str, variants: Sequence[str],
                    rich: int = 10) -> DataFrame:
    """Each variant against the base: macro, change, Aves change, worst class."""
    long = align.unpivot_streams(df, {n: n for n in (base, *variants)}, "variant", "_p")
    auc = metrics.auc(long, ["variant", "class", "taxon"], "_p")
    ref = auc.filter(F.col("variant") == base).select("class", F.col("auc").alias("_ref"))
    d = auc.filter(F.col("variant") != base).join(ref, "class")
    d = d.withColumn("delta", F.col("auc") - F.col("_ref"))
    return d.groupBy("variant").agg(
        F.avg("auc").alias("macro"), F.avg(F.when(F.col("taxon") == "Aves", F.col("delta"))).alias("aves_delta"),
        F.avg("delta").alias("delta"),
        F.min_by("class", F.struct(F.round("delta", 9), F.col("class"))).alias("worst"),
        F.count_if(F.col("n_pos") >= rich).alias("n_rich"))
