"""Top-k, capped, stratified and seeded sampling; folds and splits.

Seeded choices use a hash of (seed, key): the same rows are chosen at any partitioning.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnscore.operators import rank
from dawnscore.operators.scalars import attach


def top_k(df: DataFrame, row_keys: Sequence[str], score: str, k: int,
          tie: Sequence[str] = ("class",)) -> DataFrame:
    """k best per group; Spark cuts each partition to k per group before the shuffle."""
    w = Window.partitionBy(*row_keys).orderBy(F.desc(score), *tie)
    return df.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)


def top_k_cap(df: DataFrame, row_keys: Sequence[str], score: str, k: int, out: str,
              cls: str = "class") -> DataFrame:
    w = Window.partitionBy(*row_keys).orderBy(F.desc(score), cls)
    return df.withColumn(out, F.when(F.row_number().over(w) <= k, F.col(score)).otherwise(0.0))


def site_capped(df: DataFrame, score: str, per_site: int, per_class: int, key: str,
                cls: str = "class", site: str = "site") -> DataFrame:
    """Best rows per (class, site), then a class cap walking the sites in order.

    After the first cap a class holds at most per_site rows per site; the walk needs only counts
    of the sites before it, not one sorted run over the class.
    """
    first = top_k(df, [cls, site], score, per_site, (key,))
    sizes = first.groupBy(cls, site).agg(F.count(F.lit(1)).alias("_k"))
    before = (Window.partitionBy(cls).orderBy(site)
              .rowsBetween(Window.unboundedPreceding, -1))  # one row per site
    offset = sizes.select(cls, site, F.coalesce(F.sum("_k").over(before), F.lit(0)).alias("_o"))
    return (first.join(offset, [cls, site])
            .filter(F.col("_o") + F.col("place") <= per_class).drop("_o"))


def seeded(key: Column, seed: int) -> Column:
    """52 bits of the MD5 of seed and key, the same in any engine."""
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def quota_sample(df: DataFrame, bucket: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """n rows: an equal quota per bucket in seeded order, topped up from the rest."""
    n_buckets = F.count_distinct(bucket)
    quota = df.agg(F.greatest(F.floor(F.lit(n) / n_buckets), F.lit(1)).alias("_q"))
    d = df.withColumn("_h", seeded(F.col(key), seed))
    w = Window.partitionBy(bucket).orderBy("_h", key)
    # a bucket needs at most n candidates, whatever its size: the filter is a group limit
    cand = d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    cand = attach(cand, quota)
    return (cand.orderBy((F.col("_r") > F.col("_q")).cast("int"), "_h", key).limit(n)
            .drop("_h", "_r", "_q"))


def nested_largest(df: DataFrame, group: str, score: str, per_group: int, overall: int,
                   key: str) -> DataFrame:
    return (top_k(df, [group], score, per_group, (key,)).drop("place")
            .orderBy(F.desc(score), key).limit(overall))


def file_split(df: DataFrame, file: str, n_eval: int, seed: int = 0) -> DataFrame:
    """The first n_eval files in seeded order are the holdout."""
    files = df.select(file).distinct()
    held = files.orderBy(seeded(F.col(file), seed), file).limit(n_eval).withColumn("_e", F.lit(1))
    return (df.join(held, file, "left")
            .withColumn("split", F.when(F.col("_e") == 1, "eval").otherwise("train")).drop("_e"))


def class_holdout(df: DataFrame, label: str, key: str, share: float = 0.2, min_n: int = 5,
                  seed: int = 0) -> DataFrame:
    """A share of each label (at least 1, none for small labels) in seeded order.

    The cut is a hash threshold found from running counts, so a large label is never sorted in
    one task.
    """
    d = df.withColumn("_u", F.pmod(seeded(F.col(key), seed), F.lit(1 << 40)) / float(1 << 40))
    counts = rank.running_counts(d, [label], "_u")
    take = F.when(F.col("n_total") < min_n, F.lit(0)).otherwise(
        F.greatest(F.lit(1), F.floor(F.col("n_total") * share)))
    cut = counts.filter(F.col("n_below") < take).groupBy(label).agg(F.max("_u").alias("_cut"))
    return (d.join(cut, label, "left")
            .withColumn("is_holdout", F.coalesce(F.col("_u") <= F.col("_cut"), F.lit(False)))
            .drop("_u", "_cut"))


def round_robin(files: DataFrame, site: str, file: str, k: int = 5) -> DataFrame:
    """Fold = position inside the site (by file name) modulo k; files is one row per file."""
    return (rank.positions(files, site, file, "_pos")
            .withColumn("fold", ((F.col("_pos") - 1) % k).cast("int")).drop("_pos"))


MAX_SIZES = 2_000_000  # distinct group sizes: s of them need s * s / 2 rows, so 2e12 rows


def lightest_folds(sizes: Sequence[tuple[int, int]], k: int) -> list[tuple[int, list[int]]]:
    """Groups of each (size, count), largest size first, to the lightest of k folds one after the other.

    Returns per size how many of its groups each fold takes. Groups of one size are interchangeable: fold f
    takes its j-th of them at the load it has then, so the first `count` of those loads (ties to the
    smaller fold) are found by bisection instead of a walk over groups.
    """
    loads, out = [0] * k, []
    for size, count in sorted(sizes, reverse=True):
        def below(level: int) -> list[int]:
            return [max(0, -(-(level - x) // size)) for x in loads]  # noqa: B023
        low, high = min(loads), max(loads) + count * size
        while low < high:               # the largest level with at most `count` groups below it
            middle = (low + high + 1) // 2
            low, high = (middle, high) if sum(below(middle)) <= count else (low, middle - 1)
        takes = below(low)
        for f in sorted(range(k), key=lambda f: (loads[f] + takes[f] * size, f))[:count - sum(takes)]:
            takes[f] += 1
        loads = [x + t * size for x, t in zip(loads, takes, strict=True)]
        out.append((size, takes))
    return out


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Whole groups per fold, balanced by rows: in order of size, each to the fold that is lightest by then.

    Only the histogram of group sizes reaches the driver, checked; groups of one size go to the folds in
    the order of their keys, by their places counted over ranges (rank.positions).
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    counted = sizes.groupBy("_n").agg(F.count(F.lit(1)).alias("m")).limit(MAX_SIZES + 1).collect()
    if len(counted) > MAX_SIZES:
        raise ValueError(f"more than {MAX_SIZES} distinct group sizes")
    takes = lightest_folds([(r["_n"], r["m"]) for r in counted], k)
    ends = df.sparkSession.createDataFrame(
        [(size, [int(x) for x in np.cumsum(t)]) for size, t in takes], "_size long, _ends array<long>")
    placed = rank.positions(sizes, "_n", group, "_pos").join(ends, F.col("_n") == F.col("_size"))
    folds = placed.select(group, F.size(F.filter("_ends", lambda e: e < F.col("_pos"))).alias("fold"))
    return df.join(folds, group)


def site_holdout_plan(labels: DataFrame, min_pos: int = 5) -> DataFrame:
    """Leave-one-site-out: per (class, site) the train and test counts and whether it is usable.

    Train counts are total minus site, so rows are not copied per site.
    """
    per = labels.groupBy("class", "site").agg(F.sum("y").alias("test_pos"),
                                              F.count(F.lit(1)).alias("test_n"))
    tot = per.groupBy("class").agg(F.sum("test_pos").alias("_p"), F.sum("test_n").alias("_n"))
    d = per.join(tot, "class").select(
        "class", "site", "test_pos", "test_n", (F.col("_p") - F.col("test_pos")).alias("train_pos"),
        (F.col("_n") - F.col("test_n")).alias("train_n"))
    usable = ((F.col("train_pos") >= min_pos) & (F.col("test_pos") > 0)
              & (F.col("test_pos") < F.col("test_n")))
    return d.withColumn("usable", usable)


def site_roles(df: DataFrame, site: str) -> DataFrame:
    """Role column of one leave-one-site-out fold."""
    return df.withColumn("role", F.when(F.col("site") == site, "test").otherwise("train"))


def equal_class_weight(df: DataFrame, label: str) -> DataFrame:
    """1 / count(label), normalised to sum 1: every label gets the same total."""
    per = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = per.agg(F.count(F.lit(1)).alias("_k"))
    w = attach(per, total).select(label, (1 / (F.col("_n") * F.col("_k"))).alias("weight"))
    return df.join(w, label)


def focus_weight(df: DataFrame, focus: Column, heavy: float = 10.0) -> DataFrame:
    raw = F.when(focus, heavy).otherwise(1.0)
    total = df.agg(F.sum(raw).alias("_t"))
    return attach(df, total).withColumn("weight", raw / F.col("_t")).drop("_t")


def weighted_draws(df: DataFrame, key: str, weight: str, n: int, seed: int = 0,
                   per_bucket: int = 100_000) -> DataFrame:
    """n draws with replacement, probability by weight.

    Rows lie in hash buckets of bounded size. A draw is a position in the total weight: it is sent
    to its bucket by an equi join on equal-width cells of that range (a bucket covers only the
    cells its share spans), then to a row by the running weight inside the bucket.
    """
    buckets = int(min(1_000_000, max(1, df.count() // per_bucket)))
    d = df.withColumn("_bk", F.pmod(seeded(F.col(key), seed), F.lit(buckets)))
    upto = Window.partitionBy("_bk").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_hi", F.sum(weight).over(upto)).withColumn("_lo", F.col("_hi") - F.col(weight))
    per = d.groupBy("_bk").agg(F.sum(weight).alias("_w"))
    walk = Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, 0)  # one row per bucket
    per = per.withColumn("_end", F.sum("_w").over(walk)).withColumn("_start", F.col("_end") - F.col("_w"))
    total = per.agg(F.max("_end").alias("_t"))

    def cell(x):
        return F.least(F.floor(x / F.col("_t") * buckets), F.lit(buckets - 1))

    spans = attach(per, total).select(
        "_bk", "_start", "_end", F.explode(F.sequence(cell(F.col("_start")), cell(F.col("_end")))).alias("_cell"))
    u = F.pmod(seeded(F.col("id"), seed + 1), F.lit(1 << 40)) / float(1 << 40)
    draws = attach(df.sparkSession.range(n), total).withColumn("_pos", u * F.col("_t"))
    placed = (draws.withColumn("_cell", cell(F.col("_pos"))).join(spans, "_cell")
              .filter((F.col("_pos") >= F.col("_start")) & (F.col("_pos") < F.col("_end")))
              .select(F.col("id").alias("draw"), "_bk", (F.col("_pos") - F.col("_start")).alias("_off")))
    return (placed.join(d, "_bk").filter((F.col("_off") >= F.col("_lo")) & (F.col("_off") < F.col("_hi")))
            .drop("_bk", "_off", "_lo", "_hi"))


def candidate_list(df: DataFrame, row_keys: Sequence[str], a: str, b: str, taxon_a: str,
                   taxon_b: str, sim: str, tau: float) -> DataFrame:
    """Rows where two streams' top classes are of two given taxa and the similarity is high."""
    def top(s):
        return F.max_by("taxon", F.struct(F.col(s), F.col("class")))
    rows = df.groupBy(*row_keys).agg(top(a).alias("top_a"), top(b).alias("top_b"),
                                     F.max(sim).alias("sim"))
    return (rows.filter((F.col("top_a") == taxon_a) & (F.col("top_b") == taxon_b)
                        & (F.col("sim") > tau)).orderBy(F.desc("sim"), *row_keys))


def cross_site_pool(files: DataFrame, labelled: DataFrame, min_files: int = 5, seed: int = 0,
                    file: str = "file_id", site: str = "site") -> DataFrame:
    """For every unlabelled file of the pool a seeded background file of another site.

    Files are numbered site by site; a file draws a number outside its own site's range, which is
    an equi join on the number. No pairs of sites or files are formed.
    """
    pool = files.join(labelled.select(file).distinct(), file, "left_anti")
    sizes = pool.groupBy(site).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_files)
    before = Window.orderBy(site).rowsBetween(Window.unboundedPreceding, -1)  # one row per site
    sizes = sizes.select(site, "_n", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"),
                         F.sum("_n").over(Window.partitionBy()).alias("_t"))
    # position inside the site from running counts of the file hash: a large site is not one task
    hashed = pool.withColumn("_u", F.pmod(seeded(F.col(file), seed), F.lit(1 << 52)) / float(1 << 52))
    pos = rank.running_counts(hashed, [site], "_u").select(site, "_u", F.col("n_below").alias("_p"))
    d = (hashed.join(pos, [site, "_u"]).join(sizes, site)
         .withColumn("_no", F.col("_o") + F.col("_p")))
    pick = F.pmod(seeded(F.col(file), seed + 1), F.col("_t") - F.col("_n"))
    ask = d.filter(F.col("_t") > F.col("_n")).select(
        file, site, F.pmod(F.col("_o") + F.col("_n") + pick, F.col("_t")).alias("_no"))
    give = d.select("_no", F.col(file).alias("background"), F.col(site).alias("background_site"))
    return ask.join(give, "_no").drop("_no")
