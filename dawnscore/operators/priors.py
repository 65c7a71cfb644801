"""Site and hour priors: fitting, shrinking, fusing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnscore.functions.scalar import clip
from dawnscore.operators.scalars import attach


def prior_tables(labels: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Class means of y with counts for all, site, hour and site x hour: one grouping-sets pass."""
    keys = [*extra, "class", "site", "hour"]
    base = [*extra, "class"]
    sets = [base, [*base, "site"], [*base, "hour"], [*base, "site", "hour"]]
    level = (F.when(F.grouping("site") + F.grouping("hour") == 2, "global")
             .when(F.grouping("hour") == 1, "site").when(F.grouping("site") == 1, "hour")
             .otherwise("site_hour"))
    # labels are summed per cell before the sets expand rows fourfold
    cells = labels.groupBy(*keys).agg(F.sum("y").alias("_y"), F.count(F.lit(1)).alias("_n"))
    return cells.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(k) for k in keys]).agg(
        level.alias("level"), (F.sum("_y") / F.sum("_n")).alias("p"), F.sum("_n").alias("n"))


def _level(tables: DataFrame, level: str, keys: list[str], tag: str) -> DataFrame:
    return tables.filter(F.col("level") == level).select(
        *keys, F.col("p").alias(f"_p{tag}"), F.col("n").alias(f"_n{tag}"))


def shrunk_prior(rows: DataFrame, tables: DataFrame, with_site_hour: bool = True,
                 extra: tuple[str, ...] = (), out: str = "prior_logit") -> DataFrame:
    """Global -> hour -> site -> site x hour shrinkage, then the clipped logit.

    rows need class, site, hour. Each prior level is joined on its own key.
    """
    keys = [*extra, "class"]
    df = rows.join(_level(tables, "global", keys, "g"), keys, "left")
    df = df.join(_level(tables, "hour", [*keys, "hour"], "h"), [*keys, "hour"], "left")
    df = df.join(_level(tables, "site", [*keys, "site"], "s"), [*keys, "site"], "left")
    p: Column = F.coalesce("_pg", F.lit(0.0))

    def pull(p: Column, tag: str, strength: float) -> Column:
        w = F.col(f"_n{tag}") / (F.col(f"_n{tag}") + strength)
        return F.when(F.col(f"_n{tag}").isNotNull(), w * F.col(f"_p{tag}") + (1 - w) * p).otherwise(p)

    p = pull(pull(p, "h", 8.0), "s", 8.0)
    if with_site_hour:
        k = [*keys, "site", "hour"]
        df = df.join(_level(tables, "site_hour", k, "x"), k, "left")
        p = pull(p, "x", 4.0)
    q = clip(p, 1e-4, 1 - 1e-4)
    df = df.withColumn("_q", q).withColumn(out, F.log(F.col("_q")) - F.log1p(-F.col("_q")))
    return df.drop("_q", *[c for c in df.columns if c.startswith(("_p", "_n"))])


def fuse(base: Column, prior: Column, role: Column) -> Column:
    """Roles: event, texture, proxy (mapped, active), prior_event, prior_texture, inactive."""
    return (F.when(role == "event", base + 0.4 * prior).when(role == "texture", base + 1.0 * prior)
            .when(role == "proxy", base + 0.8 * prior).when(role == "prior_event", 0.4 * prior)
            .when(role == "prior_texture", 1.0 * prior).when(role == "inactive", F.lit(-8.0))
            .otherwise(base))


def fold_safe_tables(labels: DataFrame, fold: str = "fold") -> DataFrame:
    """Prior tables for every fold without that fold's rows, as total minus fold."""
    dims = ["class", "site", "hour"]
    level = (F.when(F.grouping("site") + F.grouping("hour") == 2, "global")
             .when(F.grouping("hour") == 1, "site").when(F.grouping("site") == 1, "hour")
             .otherwise("site_hour"))
    cells = labels.groupBy(fold, *dims).agg(F.sum("y").alias("_y"), F.count(F.lit(1)).alias("_n"))
    sets = [[fold, *s] for s in (["class"], ["class", "site"], ["class", "hour"], dims)]
    mine = cells.groupingSets([[F.col(c) for c in s] for s in sets],
                              F.col(fold), *[F.col(d) for d in dims]).agg(
        level.alias("level"), F.sum("_y").alias("_fy"), F.sum("_n").alias("_fn"))
    total = mine.groupBy("level", *dims).agg(F.sum("_fy").alias("_ty"), F.sum("_fn").alias("_tn"),
                                             F.collect_set(fold).alias("_in"))
    all_folds = labels.select(fold).distinct().agg(F.collect_set(fold).alias("_all"))
    grid = attach(total, all_folds).select(
        F.explode("_all").alias(fold), "level", *dims, "_ty", "_tn")
    same = F.lit(True)
    for d in dims:
        same = same & F.col(f"g.{d}").eqNullSafe(F.col(f"m.{d}"))
    joined = grid.alias("g").join(
        mine.alias("m"), (F.col(f"g.{fold}") == F.col(f"m.{fold}"))
        & (F.col("g.level") == F.col("m.level")) & same, "left")
    n = F.col("_tn") - F.coalesce("_fn", F.lit(0))
    return joined.select(f"g.{fold}", "g.level", *[f"g.{d}" for d in dims],
                         ((F.col("_ty") - F.coalesce("_fy", F.lit(0))) / n).alias("p"),
                         n.alias("n")).filter("n > 0")


def site_prior_forms(labels: DataFrame, n_classes: int, alpha: float = 1.0) -> DataFrame:
    """Laplace share, share of the site's best class, seen flag, per (site, class).

    labels: dense rows with y; the site total counts windows.
    """
    per = labels.groupBy("site", "class").agg(F.sum("y").alias("n_pos"), F.count(F.lit(1)).alias("_w"))
    best = F.max("n_pos").over(Window.partitionBy("site"))  # one row per class
    return per.select("site", "class", "n_pos",
                      ((F.col("n_pos") + alpha) / (F.col("_w") + alpha * n_classes)).alias("laplace"),
                      (F.col("n_pos") / (best + 1e-8)).alias("relative"),
                      (F.col("n_pos") > 0).cast("int").alias("seen"))


def soft_gate(p: Column, prior: Column, tau: float = 0.75) -> Column:
    return p * (tau * prior + (1 - tau))


def presence_boost(scores: DataFrame, seen: DataFrame, score: str, out: str,
                   strength: float = 0.3) -> DataFrame:
    """Classes seen at the row's site or hour are pulled up; seen = distinct (class, site, hour)."""
    by_site = seen.select("class", "site").distinct().withColumn("_s", F.lit(1))
    by_hour = seen.select("class", "hour").distinct().withColumn("_h", F.lit(1))
    p = F.col(score)
    known = F.col("_s").isNotNull() | F.col("_h").isNotNull()
    return (scores.join(by_site, ["class", "site"], "left").join(by_hour, ["class", "hour"], "left")
            .withColumn(out, F.when(known, p + strength * (1 - p)).otherwise(p)).drop("_s", "_h"))


def taxon_gate(p: Column, t: Column) -> dict[str, Column]:
    """All gate variants of a score by its taxon probability; 'offset' is the one used."""
    return {
        "mult": p * t, "half": 0.5 * p + 0.5 * p * t, "root": p * F.sqrt(t),
        "floor": p * (0.5 + 0.5 * t), "mean": p * (1 + t) / 2, "max": F.greatest(p, p * t),
        "thresh": F.when(t > 0.3, p).otherwise(p * t), "quarter": p * F.pow(t, F.lit(0.25)),
        "offset": p * clip(t + 0.1, 0, 1)}
