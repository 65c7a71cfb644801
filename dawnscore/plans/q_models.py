"""Registered queries: fitted models and plug-in functions."""
import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from dawnscore.operators import metrics, models as M, normalize, smooth, udf
from dawnscore.plans.q_smooth import PART, at
from dawnscore.plans.q_vectors import sims5
from dawnscore.plans.registry import query
from dawnscore.plans.views import CLASSES, ROW, SERIES

CELL = "row_id:s class:s "


@query("j11_meta_filter", CELL + "p_correct:f")
def _(v):
    sims = sims5(v).drop("vec_id")
    d = (v.scores.join(sims, [*ROW, "class"], "left")
         .withColumn("cos", F.coalesce("cos", F.lit(-1.0)))
         .withColumn("fused", 0.7 * F.col("pa") + 0.3 * F.col("pb"))
         .withColumn("is_aves", (F.col("taxon") == "Aves").cast("double")))
    feats = ["fused", "pa", "pb", "cos", "is_aves"]
    art = M.fit_detector(d.filter("fold <> 0 and fused > 0.2"), feats, "y")
    out = d.filter("fold = 0 and fused > 0.2").withColumn("p_correct", M.apply_detector(art))
    return out.filter("p_correct >= 0.5")


@query("m01_probe", "row_id:s class:s p:f")
def _(v):
    rows = v.scores.groupBy(*ROW, "row_id", "fold").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("class", "y", "pb"))), lambda e: e["y"]).alias("ys"),
        F.transform(F.array_sort(F.collect_list(F.struct("class", "y", "pb"))), lambda e: e["pb"]).alias("base"))
    keyed = v.vecs.select(F.concat(F.lit("F"), "file_no").alias("file_id"), "win", "emb")
    return M.probe_out_of_fold(rows.join(keyed, ROW), ["row_id"], "emb", "ys", "base", sorted(CLASSES))


@query("m02_platt", CELL + "p:f")
def _(v):
    return M.platt(v.scores, "pa", "p")


@query("m03_isotonic", CELL + "p:f")
def _(v):
    return M.isotonic(v.scores, "pa", "p")


FEATS = ["pa", "pb", "pc", "disagree", "b_over_a", "f_mean", "f_std", "uniform", "fused"]


def detector_rows(v):
    d = v.scores.withColumn("fused", 0.7 * F.col("pa") + 0.3 * F.col("pb"))
    return M.detector_features(d, "pa", "pb", "pc", "fused").withColumn("alarm", 1 - F.col("y"))


@query("m04_detectors", "detector:s part:s auc:f")
def _(v):
    d = detector_rows(v)
    parts = None
    for name, rows, label in (("alarm", d.filter("fused > 0.4"), "alarm"), ("miss", d.filter("fused <= 0.4"), "y")):
        art = M.fit_detector(rows.filter("fold <> 0"), FEATS, label)
        one = rows.withColumn("p", F.round(M.apply_detector(art), 9)).select(
            F.lit(name).alias("detector"), F.when(F.col("fold") == 0, "eval").otherwise("train").alias("part"),
            F.col(label).alias("y"), "p")
        parts = one if parts is None else parts.unionByName(one)
    return metrics.auc(parts, ["detector", "part"], "p")


@query("m04b_coefficients", "feature:s mean:f scale:f coef:f")
def _(v):
    art = M.fit_detector(detector_rows(v).filter("fold <> 0 and fused > 0.4"), FEATS, "alarm")
    return v.spark.createDataFrame(art, "feature string, mean double, scale double, coef double, intercept double")


@query("m05_stacking", CELL + "p:f stacked:f")
def _(v):
    s = smooth.Series(SERIES, "win")
    d = v.scores.select(
        "row_id", "class", "y", "fold", "pa", "pb", "pc", F.max("pa").over(s.whole).alias("a_max"),
        F.stddev_pop("pa").over(s.whole).alias("a_std"), F.max("pb").over(s.whole).alias("b_max"),
        F.stddev_pop("pb").over(s.whole).alias("b_std"), F.col("win").cast("double").alias("pos"),
        s.at("pa", -1).alias("a_prev"), s.at("pa", 1).alias("a_next"), s.at("pb", -1).alias("b_prev"),
        s.at("pb", 1).alias("b_next"), F.greatest("pa", "pb").alias("hi"), F.least("pa", "pb").alias("lo"),
        F.abs(F.col("pa") - F.col("pb")).alias("gap"))
    feats = [c for c in d.columns if c not in ("row_id", "class", "y", "fold")]
    return M.stacking(d, feats, "pa", F.col("fold") != 0, CLASSES, ["row_id"])


@query("m06_confound", "target:s folds:s accuracy:f over_chance:f")
def _(v):
    rows = v.vecs.withColumn("hour", F.col("file_no") % 24)
    site, hour = (M.confound_accuracy(rows, t, "file_no", "vec_id", k=3, iterations=20).withColumn("target", F.lit(t))
                  for t in ("site", "hour"))
    return site.unionByName(hour)


TGRID = [0.5, 0.7, 0.85, 1.0, 1.2, 1.5, 2.0, 3.0]


@query("m07_temperature_fit", CELL + "t:f p:f", f"""
l AS (SELECT *, ln(q / (1 - q)) AS l FROM (SELECT *, least(greatest(pb, 1e-6), 1 - 1e-6) AS q FROM scores)),
g AS (SELECT class, t, round(avg(CASE WHEN y = 1 THEN -ln(least(greatest(1 / (1 + exp(-l / t)), 1e-6), 1 - 1e-6)) ELSE -ln(1 - least(greatest(1 / (1 + exp(-l / t)), 1e-6), 1 - 1e-6)) END), 10) AS bce, sum(y) AS pos
  FROM l, (SELECT unnest({TGRID}) AS t) WHERE fold <> 0 GROUP BY ALL),
b AS (SELECT class, t FROM g QUALIFY row_number() OVER (PARTITION BY class ORDER BY bce, t) = 1)
--
SELECT row_id, l.class, t, 1 / (1 + exp(-l / t)) AS p FROM l JOIN b USING (class) WHERE fold = 0""")
def _(v):
    from dawnscore.functions.scalar import temperature
    t = M.fit_temperature(v.scores.filter("fold <> 0"), "pb", TGRID).select("class", "t")
    return v.scores.filter("fold = 0").join(t, "class").withColumn("p", temperature(F.col("pb"), F.col("t")))


# An example artifact (feature, mean, scale, coef, intercept).
ARTIFACT = [("pa", 0.3, 0.25, 1.4, -0.2), ("pb", 0.35, 0.3, -0.6, -0.2), ("pc", 0.08, 0.1, 0.5, -0.2)]


@query("m08_saved_detector", CELL + "p:f",
       "SELECT row_id, class, 1 / (1 + exp(-((pa - .3) / .25 * 1.4 + (pb - .35) / .3 * -.6 + (pc - .08) / .1 * .5 - .2))) AS p FROM scores")
def _(v):
    return v.scores.withColumn("p", M.apply_detector(ARTIFACT))


@query("o01_batch_scorer", "vec_id:i win:i class:s p:f e0:f is_scored:b", """
seg AS (SELECT v.vec_id, w.w AS win, k.k AS k, coalesce(x.x, 0) AS x FROM vecs v, range(12) w(w), range(6) k(k) LEFT JOIN vx x ON x.vec_id = v.vec_id AND x.i = w.w * 6 + k.k + 1),
f AS (SELECT vec_id, win, CASE WHEN vec_id % 50 = 13 THEN 0 ELSE avg(x) END AS m, CASE WHEN vec_id % 50 = 13 THEN 0 ELSE max(abs(x)) END AS pk, vec_id % 50 <> 13 AS is_scored FROM seg GROUP BY vec_id, win)
--
SELECT vec_id, win, c.class, CASE WHEN NOT is_scored THEN 0 WHEN c.class = 'loud' THEN pk ELSE abs(m) END AS p, m AS e0, is_scored FROM f, (VALUES ('loud'), ('mean')) c(class)""")
def _(v):
    def make():
        def score(x):
            if np.any(x[:, 0] == np.float32(99.0)):
                raise ValueError("unreadable")
            x = x.astype(float)
            return np.column_stack([np.abs(x).max(axis=1), np.abs(x.mean(axis=1))]), x.mean(axis=1)[:, None]
        return score

    from dawnscore.sources.tables import matrix_to_long
    bad = F.concat(F.array(F.lit(99.0).cast("float")), F.slice("emb", 2, 63))
    rec = v.vecs.select(F.col("vec_id").alias("file_id"),
                        F.when(F.col("vec_id") % 50 == 13, bad).otherwise(F.col("emb")).alias("samples"))
    out = udf.batch_score(rec, make, ["loud", "mean"], 1, width=6)
    out = out.withColumn("vec_id", F.col("file_id").cast("long")).withColumn("e0", F.col("emb")[0])
    return matrix_to_long(out, ["vec_id", "win", "e0", "is_scored"], "scores", ["loud", "mean"], "m")


@query("o02_per_file", "file_id:s win:i class:s p:f",
       f"SELECT file_id, win, class, avg(pa) OVER ({PART} ORDER BY win ROWS UNBOUNDED PRECEDING) AS p FROM scores")
def _(v):
    def running(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["class", "win"])
        p["p"] = p.groupby("class")["pa"].expanding().mean().reset_index(level=0, drop=True)
        return p[["file_id", "win", "class", "p"]]
    return udf.per_file(v.scores.select("file_id", "win", "class", "pa"), running,
                        "file_id string, win int, class string, p double")


@query("o03_per_class_fit", "class:s slope:f intercept:f",
       "SELECT class, regr_slope(pb, pa) AS slope, regr_intercept(pb, pa) AS intercept FROM scores GROUP BY 1")
def _(v):
    def partial(p):
        x, y = p["pa"].to_numpy(), p["pb"].to_numpy()
        return pd.DataFrame({"class": [p["class"].iloc[0]], "n": [float(len(p))], "sx": [x.sum()], "sy": [y.sum()],
                             "sxy": [(x * y).sum()], "sxx": [(x * x).sum()]})

    def merge(p):
        n, sx, sy, sxy, sxx = (p[c].sum() for c in ("n", "sx", "sy", "sxy", "sxx"))
        slope = (n * sxy - sx * sy) / (n * sxx - sx * sx)
        return pd.DataFrame({"class": [p["class"].iloc[0]], "slope": [slope], "intercept": [(sy - slope * sx) / n]})

    return udf.per_class_fit(v.scores.select("row_id", "class", "pa", "pb"), partial, merge,
                             "class string, n double, sx double, sy double, sxy double, sxx double",
                             "class string, slope double, intercept double", chunk_rows=500)
