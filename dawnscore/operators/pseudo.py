"""Pseudo-label curation: agreement, forensics, refinement, verification."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnscore.functions.scalar import floor_then_power, total
from dawnscore.operators import align, rank
from dawnscore.operators.scalars import attach


def agreement_top_k(df: DataFrame, row_keys: Sequence[str], fused: str, keep: Column,
                    k: int) -> DataFrame:
    """Rows that pass all thresholds, then the k best classes of each row."""
    w = Window.partitionBy(*row_keys).orderBy(F.desc(fused), "class")
    return (df.filter(keep).withColumn("place", F.row_number().over(w))
            .filter(F.col("place") <= k))


def soft_labels(df: DataFrame, row_keys: Sequence[str], score: str, confidence: Column | None = None,
                max_floor: float = 0.5, floor: float = 0.1, power: float = 0.5,
                min_sum: float = 0.05) -> DataFrame:
    """Row weights of softened labels: drop weak rows, floor, power, weight = confidence * sum."""
    q = floor_then_power(F.col(score), floor, power)
    conf = F.lit(1.0) if confidence is None else F.first(confidence)
    rows = df.groupBy(*row_keys).agg(
        F.max(score).alias("max_prob"), F.sum(q).alias("_sum"),
        F.count_if(q > 0).alias("n_pos"), conf.alias("_c"))
    return (rows.filter((F.col("max_prob") >= max_floor) & (F.col("_sum") >= min_sum))
            .withColumn("weight", F.col("_c") * F.col("_sum")).drop("_c", "_sum"))


def sharpness_weight(df: DataFrame, row_keys: Sequence[str], score: str, max_floor: float = 0.5,
                     floor: float = 0.1, power: float = 0.5) -> DataFrame:
    top = F.sort_array(F.collect_list(score), False)
    q = floor_then_power(F.col(score), floor, power)
    rows = df.groupBy(*row_keys).agg(top.alias("_t"), F.sum(q).alias("_sum"))
    t = F.col("_t")
    return (rows.filter((t[0] >= max_floor) & (F.col("_sum") >= 0.05))
            .withColumn("sharp", (t[0] - t[1]) / (t[0] + 1e-6))
            .withColumn("weight", F.col("sharp") * F.col("_sum")).drop("_t", "_sum"))


def forensic_flags(pseudo: DataFrame, rows_total: DataFrame, saturation_share: float = 0.05,
                   present_limit: int = 8) -> DataFrame:
    """Flag entries of saturating classes and of files where a class is over-present."""
    per_class = pseudo.groupBy("class").agg(F.count(F.lit(1)).alias("_k"))
    sat = attach(per_class, rows_total).select(
        "class", (F.col("_k") / F.col("n_rows") > saturation_share).alias("is_saturating"))
    seen = F.count(F.lit(1)).over(Window.partitionBy("file_id", "class"))  # a file's windows
    return (pseudo.withColumn("is_over_present", seen > present_limit).join(sat, "class")
            .withColumn("is_suspicious", F.col("is_saturating") | F.col("is_over_present")))


def refine(scores: DataFrame, in_pseudo: Column, score: str, drop: Sequence[str],
           strict: Sequence[str], clusters: dict[str, Sequence[str]], targets: Sequence[str],
           strict_score: float = 0.7, present_limit: int = 10) -> DataFrame:
    """Mark each pseudo-label with the first rule that removes it (A, A2, B, C, D) or 'kept'.

    B keeps, where several members of a cluster are labelled in one window, only the member that
    scores best in the whole row; C drops over-present members; all groups are one file or smaller.
    """
    of = F.create_map(*[F.lit(x) for name, ms in clusters.items() for m in ms for x in (m, name)])
    cls, p = F.col("class"), F.col(score)
    cluster = F.try_element_at(of, cls) if clusters else F.lit(None).cast("string")
    stage = (F.when(~F.col("_in"), "out").when(cls.isin(*drop), "A")
             .when(cls.isin(*strict) & (p <= strict_score), "A2").otherwise("kept"))
    d = (scores.withColumn("_in", in_pseudo).withColumn("_cluster", cluster)
         .withColumn("stage", stage))
    group = Window.partitionBy("file_id", "win", "_cluster")
    live = F.count_if(F.col("stage") == "kept").over(group)
    best = F.max_by("class", F.struct(p, cls)).over(group)
    d = d.withColumn("stage", F.when((F.col("stage") == "kept") & F.col("_cluster").isNotNull()
                                     & (live > 1) & (best != cls), "B").otherwise(F.col("stage")))
    windows = F.count_if(F.col("stage") == "kept").over(Window.partitionBy("file_id", "class"))
    d = d.withColumn("stage", F.when((F.col("stage") == "kept") & F.col("_cluster").isNotNull()
                                     & (windows > present_limit), "C").otherwise(F.col("stage")))
    return (d.withColumn("stage", F.when((F.col("stage") == "kept") & cls.isin(*targets), "D")
                         .otherwise(F.col("stage")))
            .filter("stage <> 'out'").drop("_in", "_cluster"))


def stage_counts(refined: DataFrame) -> DataFrame:
    """Rows removed by each rule and left after it."""
    order = ["A", "A2", "B", "C", "D"]
    counts = refined.agg(F.count(F.lit(1)).alias("_all"),
                         *[F.count_if(F.col("stage") == s).alias(s) for s in order])
    rows = []
    for i, s in enumerate(order):
        gone = total([F.col(x) for x in order[:i + 1]])
        rows.append(F.struct(F.lit(s).alias("stage"), F.col(s).alias("dropped"),
                             (F.col("_all") - gone).alias("remaining")))
    return counts.select(F.inline(F.array(*rows)))


def verify_signals(df: DataFrame, fused: Column, signals: Sequence[Column], cos: Column,
                   rare: Column, initial: float = 0.5, strict_cos: float = 0.7) -> DataFrame:
    """Keep strong entries with at least one independent signal; add rare taxa by similarity."""
    n = total([F.coalesce(s.cast("int"), F.lit(0)) for s in signals])
    verified = (fused > initial) & (n >= 1)
    boosted = F.coalesce((cos > strict_cos) & rare, F.lit(False))
    return (df.withColumn("n_signals", n)
            .withColumn("source", F.when(verified, "verified").when(boosted, "rare"))
            .filter(F.col("source").isNotNull()))


def acoustic_confirm(pseudo: DataFrame, sims: DataFrame, row_keys: Sequence[str],
                     k: int) -> DataFrame:
    """Entries whose class is among the row's k most similar centroids."""
    w = Window.partitionBy(*row_keys).orderBy(F.desc("cos"), "class")
    top = sims.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= k)
    return pseudo.join(top.select(*row_keys, "class"), [*row_keys, "class"], "left_semi")


def signatures(df: DataFrame, row_keys: Sequence[str], score: str, min_pos: int = 1) -> DataFrame:
    """Per target class: mean score profile on its positive rows minus the overall mean profile."""
    base = df.groupBy("class").agg(F.avg(score).alias("_base"))
    d = align.chosen_with_row(df, row_keys, {"class": F.col("class"), "q": F.col(score)}, F.col("y") == 1)
    pos = (d.select(F.col("cell.class").alias("target"), F.explode("row").alias("_o"))
           .groupBy("target", F.col("_o.class").alias("other")).agg(F.avg("_o.q").alias("_m"), F.count(F.lit(1)).alias("n_pos")))
    return (pos.filter(F.col("n_pos") >= min_pos).join(base.withColumnRenamed("class", "other"), "other")
            .select("target", "other", (F.col("_m") - F.col("_base")).alias("lift"), "n_pos"))


def signature_similarity(df: DataFrame, row_keys: Sequence[str], score: str,
                         sig: DataFrame) -> DataFrame:
    """Cosine of each row's lift over the mean profile with every target signature."""
    base = df.groupBy("class").agg(F.avg(score).alias("_base"))
    unit = F.sqrt(F.sum(F.col("lift") * F.col("lift")).over(Window.partitionBy("target"))) + 1e-9
    s = sig.withColumn("_s", F.col("lift") / unit).select("target", F.col("other").alias("class"), "_s")
    lift = (df.join(base, "class").withColumn("_l", F.col(score) - F.col("_base")))
    norm = F.sqrt(F.sum(F.col("_l") * F.col("_l")).over(Window.partitionBy(*row_keys))) + 1e-9
    return (lift.withColumn("_n", norm).join(s, "class").groupBy(*row_keys, "target")
            .agg(F.sum(F.col("_l") / F.col("_n") * F.col("_s")).alias("cos")))


def best_matches(sims: DataFrame, row_keys: Sequence[str], tau: float, top: int = 5) -> DataFrame:
    w = Window.partitionBy(*row_keys).orderBy(F.desc("cos"), "target")
    return (sims.filter(F.col("cos") > tau).withColumn("place", F.row_number().over(w))
            .filter(F.col("place") <= top))


def match_distribution(sims: DataFrame) -> DataFrame:
    base = sims.groupBy("target").agg(F.avg("cos").alias("mean"), F.max("cos").alias("max_cos"))
    return base.join(rank.quantiles(sims, ["target"], "cos", {"p90": .9, "p99": .99}), "target")


def outlier_filter(pseudo: DataFrame, sims: DataFrame, own: DataFrame, row_keys: Sequence[str],
                   factor: float = 1.5, min_n: int = 5) -> DataFrame:
    """Drop entries farther from their class centroid than factor x its own p95 distance.

    own: (class, dist) of the class members; classes with too few members keep their entries.
    """
    spread = rank.quantiles(own, ["class"], "dist", {"p95": .95})
    n = own.groupBy("class").agg(F.count(F.lit(1)).alias("_n"))
    limits = spread.join(n, "class").filter(F.col("_n") >= min_n)
    d = (pseudo.join(sims.select(*row_keys, "class", "cos"), [*row_keys, "class"], "left")
         .join(limits, "class", "left"))
    far = (1 - F.col("cos")) > F.col("p95") * factor
    return d.filter(~F.coalesce(far, F.lit(False))).drop("p95", "_n")


def detector_filter(df: DataFrame, fused: Column, in_pseudo: Column, p_alarm: Column, p_miss: Column,
                    tau_drop: float = 0.7, tau_add: float = 0.7, low: float = 0.3) -> DataFrame:
    """Drop likely false alarms, add likely misses; each (row, class) appears once."""
    kept = in_pseudo & (p_alarm <= tau_drop)
    added = ~in_pseudo & (fused < low) & (p_miss > tau_add)
    return (df.withColumn("source", F.when(kept, "kept").when(added, "recovered"))
            .filter(F.col("source").isNotNull()))


def external_verify(pseudo: DataFrame, sims: DataFrame, row_keys: Sequence[str],
                    tau: float) -> DataFrame:
    """Mark entries below tau to an outside centroid; classes without one are kept."""
    d = pseudo.join(sims.select(*row_keys, "class", "cos"), [*row_keys, "class"], "left")
    return d.withColumn("keep", F.coalesce(F.col("cos") >= tau, F.lit(True)))


def multi_site_entries(scores: DataFrame, score: str, low: float = 0.4, high: float = 0.5,
                       min_sites: int = 2) -> DataFrame:
    """Entries above `high` of classes that score above `low` at several sites."""
    wide = (scores.filter(F.col(score) > low).groupBy("class")
            .agg(F.count_distinct("site").alias("_s")).filter(F.col("_s") >= min_sites))
    return scores.filter(F.col(score) > high).join(wide.select("class"), "class", "left_semi")


def tri_state_mask(y: Column, p: Column, tau_pos: float = 0.5, tau_neg: float = 0.1,
                   positives_only: bool = False) -> Column:
    sure = (y == 1) | (p < tau_neg)
    if not positives_only:
        sure = sure | (p > tau_pos)
    return sure.cast("int")


def teacher_agreement(df: DataFrame, row_keys: Sequence[str], streams: Sequence[str],
                      t: float = 0.3) -> DataFrame:
    n = total([(F.col(s) > t).cast("int") for s in streams])
    rows = df.groupBy(*row_keys).agg(F.count_if(n >= 2).alias("n_agreed"), F.max(n).alias("best"))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"),
                    F.avg((F.col("n_agreed") > 0).cast("double")).alias("share_agreed"),
                    F.avg("n_agreed").alias("mean_agreed"))


def file_pseudo(df: DataFrame, score: str, threshold: float, power: float,
                floor: float = 0.1, file: str = "file_id") -> DataFrame:
    """Mean over a file's windows; files whose best class is weak drop out; power, then floor."""
    mean = df.groupBy(file, "class").agg(F.avg(score).alias("_m"))
    top = F.max("_m").over(Window.partitionBy(file))
    q = F.pow("_m", F.lit(power))
    return (mean.withColumn("_t", top).filter(F.col("_t") >= threshold)
            .select(file, "class", F.when(q < floor, 0.0).otherwise(q).alias("p")))


def top_k_with_truth(df: DataFrame, row_keys: Sequence[str], score: str, truth: Column, k: int,
                     t: float) -> DataFrame:
    """Positive where the class is a confident top-k pick or truly labelled."""
    w = Window.partitionBy(*row_keys).orderBy(F.desc(score), "class")
    d = df.withColumn("_k", F.row_number().over(w))
    pick = ((F.col("_k") <= k) & (F.col(score) > t)).cast("int")
    return d.withColumn("y_soft", F.greatest(pick, truth)).filter("y_soft = 1").drop("_k")


def threshold_map(df: DataFrame, row_keys: Sequence[str], score: str, t: float = 0.5) -> DataFrame:
    entries = F.collect_list(F.when(F.col(score) >= t, F.struct("class", F.lit(1.0))))
    return df.groupBy(*row_keys).agg(F.map_from_entries(F.array_sort(entries)).alias("labels"))


def label_mass(df: DataFrame, row_keys: Sequence[str], label: Column) -> DataFrame:
    return df.groupBy(*row_keys).agg(F.sum(label).alias("weight"))
