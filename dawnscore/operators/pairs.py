"""Training-pair mining and row flags over score tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _row_items(df: DataFrame, row_keys: Sequence[str], where: Column, name: str, score: str,
               ascending: bool, top: int | None) -> Column:
    """The row's classes under a condition as an ordered list (at most one entry per class)."""
    v = F.col(score) if ascending else -F.col(score)
    items = F.array_sort(F.collect_list(F.when(where, F.struct(v.alias("o"), F.col("class").alias("c"),
                                                               F.col("taxon").alias("t")))))
    return (F.slice(items, 1, top) if top else items).alias(name)


def hard_pairs(df: DataFrame, row_keys: Sequence[str], score: str, margin: float = 0.0,
               top: int = 20, positive: Column | None = None, taxon_rule: str | None = None) -> DataFrame:
    """(row, pos, neg) with s_neg - s_pos > -margin, the worst `top` per row.

    Of the i-th weakest positive and j-th strongest negative, i*j - 1 pairs of the row are at
    least as bad, so only pairs with i*j <= top are formed; the result is exact. A taxon rule
    (cross | within) filters pairs, hence looks at all of the row's classes.
    """
    pos = (F.col("y") == 1) & (positive if positive is not None else F.lit(True))
    cut = top if taxon_rule is None else None
    rows = df.groupBy(*row_keys).agg(
        _row_items(df, row_keys, pos, "_p", score, True, cut),
        _row_items(df, row_keys, F.col("y") == 0, "_n", score, False, cut))
    pairs = (rows.select(*row_keys, "_n", F.posexplode("_p").alias("_i", "_pos"))
             .select(*row_keys, "_i", "_pos", F.posexplode("_n").alias("_j", "_neg")))
    gap = -F.col("_neg.o") - F.col("_pos.o")
    keep = gap > -margin
    if taxon_rule is None:
        keep = keep & ((F.col("_i") + 1) * (F.col("_j") + 1) <= top)
    elif taxon_rule == "cross":
        keep = keep & (F.col("_pos.t") != F.col("_neg.t"))
    else:
        keep = keep & (F.col("_pos.t") == F.col("_neg.t"))
    w = Window.partitionBy(*row_keys).orderBy(F.desc("gap"), "_i", "_j")
    return (pairs.withColumn("gap", gap).filter(keep).withColumn("place", F.row_number().over(w))
            .filter(F.col("place") <= top)
            .select(*row_keys, F.col("_pos.c").alias("pos"), F.col("_neg.c").alias("neg"), "gap", "place"))


def preference_pairs(df: DataFrame, row_keys: Sequence[str], ensemble: str, ref: str,
                     hi: float = 0.7, lo: float = 0.1, split: float = 0.5) -> DataFrame:
    """Classes the ensemble wants up (ref low) x classes it wants down (ref high), inside a row."""
    up = (F.col(ensemble) > hi) & (F.col(ref) < split)
    down = (F.col(ensemble) < lo) & (F.col(ref) > split)
    rows = df.groupBy(*row_keys).agg(F.collect_list(F.when(up, F.col("class"))).alias("_u"),
                                     F.collect_list(F.when(down, F.col("class"))).alias("_d"))
    return (rows.select(*row_keys, "_d", F.explode("_u").alias("preferred"))
            .select(*row_keys, "preferred", F.explode("_d").alias("rejected")))


def hard_rows(df: DataFrame, row_keys: Sequence[str], score: str, t: float = 0.3) -> DataFrame:
    low = F.min(F.when(F.col("y") == 1, F.col(score)))
    return (df.groupBy(*row_keys).agg(low.alias("min_pos"))
            .withColumn("is_hard", F.coalesce(F.col("min_pos") < t, F.lit(False))))


def quality_filter(df: DataFrame, row_keys: Sequence[str], score: str, tau: float) -> DataFrame:
    """Rows whose best class stays below tau."""
    return (df.groupBy(*row_keys).agg(F.max(score).alias("top"))
            .filter(F.col("top") < tau))
