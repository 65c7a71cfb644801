"""Fitted models: Spark ML for single fits, batched second-order steps for many small fits.

Per-class fits never gather a class in one task: every iteration is an aggregate over all rows, and
only gradients and curvatures (their size depends on classes and features) reach the driver.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf

from dawnscore.functions.scalar import clip, logit, total
from dawnscore.operators import boosting, rank, sampling, vectors
from dawnscore.sources import tables
from dawnscore.operators.scalars import attach

MAX_GROUPS = 100_000


def balanced_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """n / (2 * n of the own class)."""
    n = df.agg(F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_p"))
    own = F.when(F.col(label) == 1, F.col("_p")).otherwise(F.col("_n") - F.col("_p"))
    return attach(df, n).withColumn(out, F.col("_n") / (2.0 * own)).drop("_n", "_p")


def fit_detector(df: DataFrame, features: Sequence[str], label: str = "label",
                 c: float = 1.0) -> list[tuple]:
    """Standardised, balanced logistic regression as (feature, mean, scale, coef, intercept) rows."""
    stats = df.agg(F.count(F.lit(1)).alias("_n"),
                   *[g(f).alias(f"{n}_{f}") for f in features
                     for n, g in (("m", F.avg), ("s", F.stddev_pop))]).head()
    scale = {f: stats[f"s_{f}"] or 1.0 for f in features}
    z = [((F.col(f) - F.lit(float(stats[f"m_{f}"]))) / F.lit(float(scale[f]))).alias(f) for f in features]
    d = balanced_weight(df.select(label, *z), label)
    d = VectorAssembler(inputCols=list(features), outputCol="features").transform(d)
    model = LogisticRegression(labelCol=label, weightCol="weight", maxIter=100, standardization=False,
                               regParam=1.0 / (c * stats["_n"])).fit(d)
    return [(f, float(stats[f"m_{f}"]), float(scale[f]), float(w), float(model.intercept))
            for f, w in zip(features, model.coefficients)]


def apply_detector(artifact: Sequence[tuple], column=F.col) -> Column:
    """Probability from a saved linear detector (a short coefficient list)."""
    dot = total([(column(f) - mean) / scale * coef for f, mean, scale, coef, _ in artifact])
    return 1 / (1 + F.exp(-(dot + artifact[0][4])))


def detector_features(df: DataFrame, a: str, b: str, c: str, fused: str,
                      series: Sequence[str] = ("file_id", "class")) -> DataFrame:
    """Nine (row, class) features of the false-alarm and miss detectors."""
    w = Window.partitionBy(*series)
    x = df.select("*", F.avg(b).over(w).alias("f_mean"), F.stddev_pop(b).over(w).alias("f_std"))
    return x.select("*", F.abs(F.col(a) - F.col(b)).alias("disagree"),
                    F.greatest(F.col(b) - F.col(a), F.lit(0.0)).alias("b_over_a"),
                    (1 - F.col("f_std") / (F.col("f_mean") + 1e-6)).alias("uniform"))


def fit_temperature(df: DataFrame, score: str, grid: Sequence[float], min_pos: int = 5,
                    eps: float = 1e-6) -> DataFrame:
    """Per class the temperature of the grid with the least cross entropy, in one pass."""
    l = logit(F.col(score), eps)
    aggs = []
    for i, t in enumerate(grid):
        p = clip(1 / (1 + F.exp(-l / t)), eps, 1 - eps)
        bce = F.when(F.col("y") == 1, -F.log(p)).otherwise(-F.log(1 - p))
        aggs.append(F.avg(bce).alias(f"_b{i}"))
    per = df.groupBy("class").agg(F.sum("y").alias("_pos"), *aggs)
    best = F.array_min(F.array(*[F.struct(F.round(f"_b{i}", 10).alias("bce"), F.lit(i).alias("i"),
                                          F.lit(float(t)).alias("t")) for i, t in enumerate(grid)]))
    return per.select("class", F.when(F.col("_pos") >= min_pos, best["t"]).otherwise(F.lit(1.0)).alias("t"),
                      best["bce"].alias("bce"))


def _fold_list(df: DataFrame, fold: str) -> list[int]:
    folds = [r[0] for r in df.select(fold).distinct().limit(101).collect()]
    if len(folds) > 100:
        raise ValueError("too many folds")
    return sorted(folds)


def platt(df: DataFrame, score: str, out: str, fold: str = "fold", cls: str = "class",
          label: str = "y", c: float = 1.0, steps: int = 8) -> DataFrame:
    """Out-of-fold Platt scaling: decision value a*s+b per class and held-out fold.

    Rows are counted per (class, fold, score) once; each Newton step is one aggregate giving five
    sums per class and fold. Classes or folds with too few labels keep the raw score.
    """
    hist = df.groupBy(cls, fold, score).agg(F.sum(label).cast("double").alias("_p"),
                                            F.count(F.lit(1)).cast("double").alias("_n")).persist()
    folds = _fold_list(df, fold)
    counts = (hist.groupBy(cls, fold).agg(F.sum("_p").alias("p"), F.sum("_n").alias("n"))
              .limit(MAX_GROUPS + 1).collect())
    if len(counts) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} class and fold pairs")
    classes = sorted({r[cls] for r in counts})
    pos = {(r[cls], r[fold]): r["p"] for r in counts}
    num = {(r[cls], r[fold]): r["n"] for r in counts}
    params = {}
    for k in classes:
        all_p, all_n = sum(pos.get((k, f), 0) for f in folds), sum(num.get((k, f), 0) for f in folds)
        for f in folds:
            p, n = all_p - pos.get((k, f), 0), all_n - num.get((k, f), 0)
            if all_p >= 4 and p >= 3 and n - p >= 3:
                params[(k, f)] = np.zeros(2)
    kind = df.schema[cls].dataType.simpleString()
    x = F.col(score)
    for _ in range(steps):
        rows = [(k, [float(params.get((k, f), np.zeros(2))[0]) for f in folds],
                 [float(params.get((k, f), np.zeros(2))[1]) for f in folds]) for k in classes]
        table = df.sparkSession.createDataFrame(rows, f"{cls} {kind}, _a array<double>, _c array<double>")
        aggs = []
        for i, f in enumerate(folds):
            inside = F.col(fold) != f
            q = 1 / (1 + F.exp(-clip(F.col("_a")[i] * x + F.col("_c")[i], -500, 500)))
            g = F.col("_n") * q - F.col("_p")
            h = F.col("_n") * q * (1 - q)
            for name, e in (("ga", g * x), ("gc", g), ("haa", h * x * x), ("hac", h * x), ("hcc", h)):
                aggs.append(F.sum(F.when(inside, e)).alias(f"{name}{i}"))
        sums = hist.join(F.broadcast(table), cls).groupBy(cls).agg(*aggs).collect()
        for r in sums:
            for i, f in enumerate(folds):
                if (r[cls], f) in params:
                    w = params[(r[cls], f)]
                    grad = np.array([w[0] + c * r[f"ga{i}"], c * r[f"gc{i}"]])
                    hess = np.array([[1 + c * r[f"haa{i}"], c * r[f"hac{i}"]],
                                     [c * r[f"hac{i}"], c * r[f"hcc{i}"]]])
                    params[(r[cls], f)] = w - np.linalg.solve(hess + 1e-9 * np.eye(2), grad)
    hist.unpersist()
    fitted = df.sparkSession.createDataFrame(
        [(k, f, float(w[0]), float(w[1])) for (k, f), w in params.items()],
        f"{cls} {kind}, {fold} int, _a double, _c double")
    return (df.join(F.broadcast(fitted), [cls, fold], "left")
            .withColumn(out, F.coalesce(F.col("_a") * x + F.col("_c"), x)).drop("_a", "_c"))


def pool_adjacent(lo: np.ndarray, hi: np.ndarray, weight: np.ndarray,
                  mass: np.ndarray) -> list[list[float]]:
    """Pool-adjacent-violators over blocks sorted by lo: [lo, hi, weight, mass] with rising means."""
    out: list[list[float]] = []
    for block in zip(lo, hi, weight, mass):
        out.append(list(block))
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            top = out.pop()
            out[-1] = [out[-1][0], top[1], out[-1][2] + top[2], out[-1][3] + top[3]]
    return out


def isotonic(df: DataFrame, score: str, out: str, fold: str = "fold", cls: str = "class",
             label: str = "y", max_knots: int = 5_000_000) -> DataFrame:
    """Out-of-fold isotonic calibration per class, clipped outside the fitted range.

    Pooling runs first inside score buckets, then over the surviving blocks of a class, which is
    exact and leaves the second step only a small share of the values.
    """
    folds = _fold_list(df, fold)
    hist = df.groupBy(cls, fold, score).agg(F.sum(label).cast("double").alias("_m"),
                                            F.count(F.lit(1)).cast("double").alias("_w"))
    held = F.explode(F.array(*[F.lit(f) for f in folds]))
    train = (hist.withColumn("_held", held).filter(F.col("_held") != F.col(fold))
             .groupBy(cls, "_held", score).agg(F.sum("_m").alias("_m"), F.sum("_w").alias("_w"))
             .withColumn("_bucket", rank.value_bucket(F.col(score))))
    kind = df.schema[cls].dataType.simpleString()
    schema = f"{cls} {kind}, _held int, lo double, hi double, w double, m double"

    def frame(pieces: list) -> pd.DataFrame:
        out = pd.DataFrame([(k, h, *b) for k, h, bs in pieces for b in bs],
                           columns=[cls, "_held", "lo", "hi", "w", "m"])
        return out

    def pool_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            if not len(p):
                continue
            k, h, bucket = p[cls].to_numpy(), p["_held"].to_numpy(), p["_bucket"].to_numpy()
            cut = np.flatnonzero((k[1:] != k[:-1]) | (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])) + 1
            x, w, m = p[score].to_numpy(), p["_w"].to_numpy(), p["_m"].to_numpy()
            ends = [0, *cut.tolist(), len(p)]
            yield frame([(k[i], h[i], pool_adjacent(x[i:j], x[i:j], w[i:j], m[i:j]))
                         for i, j in zip(ends, ends[1:])])

    def pool_class(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("lo")
        b = pool_adjacent(*(p[c].to_numpy() for c in ("lo", "hi", "w", "m")))
        return frame([(p[cls].iloc[0], p["_held"].iloc[0], b)])

    # a bucket lies in one partition, so a sorted run of it is a run of the class's own order
    runs = (train.repartition(cls, "_held", "_bucket").sortWithinPartitions(cls, "_held", score)
            .mapInPandas(pool_runs, schema))
    final = runs.groupBy(cls, "_held").applyInPandas(pool_class, schema)
    knots = final.limit(max_knots + 1).toPandas()
    if len(knots) > max_knots:
        raise ValueError("too many knots to share")
    table = {}
    for (k, f), g in knots.groupby([cls, "_held"], sort=False):
        p, n = g["m"].sum(), g["w"].sum()
        if p >= 3 and n - p >= 3:
            g = g.sort_values("lo")
            y = (g["m"] / g["w"]).to_numpy()
            table[(k, int(f))] = (np.column_stack([g["lo"], g["hi"]]).ravel(), np.repeat(y, 2))

    @pandas_udf("double")
    def calibrated(k: pd.Series, f: pd.Series, s: pd.Series) -> pd.Series:
        res = s.astype(float).copy()
        for key, idx in pd.DataFrame({"k": k, "f": f}).groupby(["k", "f"]).indices.items():
            fit = table.get((key[0], int(key[1])))
            if fit is not None:
                res.iloc[idx] = np.interp(s.iloc[idx], fit[0], fit[1])
        return res

    return df.withColumn(out, calibrated(F.col(cls), F.col(fold), F.col(score)))


def fold_moments(df: DataFrame, x: str, fold: str) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Rows, sum and sum of outer products of the vectors of each fold, from one pass; sizes are checked."""
    first = df.select(F.size(x)).head()
    dims = first[0] if first else 0
    if 100 * dims * dims > vectors.MAX_MATRIX_CELLS:
        raise ValueError(f"{dims} dimensions are too many for shared moments of the folds")

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list] = {}
        for b in batches:
            for f, part in b.groupby("f"):
                m = np.array(part["x"].tolist(), dtype=np.float64)
                have = held.setdefault(int(f), [0, np.zeros(dims), np.zeros((dims, dims))])
                have[0] += len(m)
                have[1] += m.sum(axis=0)
                have[2] += m.T @ m
        for f, (n, s, g) in held.items():
            yield pd.DataFrame({"f": f, "i": np.arange(dims + 1), "row": [*g, s], "n": float(n)})
    parts = df.select(F.col(fold).alias("f"), F.col(x).alias("x")).mapInPandas(partial, "f int, i int, row array<double>, n double")
    rows = (parts.groupBy("f", "i").agg(Summarizer.sum(array_to_vector("row")).alias("_r"), F.sum("n").alias("n"))
            .select("f", "i", vector_to_array("_r").alias("row"), "n").orderBy("f", "i").collect())
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r["f"], []).append(r)
    return {f: (int(v[0]["n"]), np.array(v[-1]["row"]), np.array([r["row"] for r in v[:-1]])) for f, v in out.items()}


def fold_projections(moments: dict[int, tuple], dims: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per held-out fold the standardisation and principal components of all other rows, as (matrix, offset).

    The other folds' moments are the total minus the fold's own, so no fold is read again.
    """
    n_all = sum(m[0] for m in moments.values())
    s_all, g_all = sum(m[1] for m in moments.values()), sum(m[2] for m in moments.values())
    out = {}
    for f, (n_own, s_own, g_own) in moments.items():
        n = n_all - n_own
        if n < 2:
            continue
        mean = (s_all - s_own) / n
        cov = (g_all - g_own) / n - np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov), 0))
        scale[scale < 1e-12] = 1.0
        values, axes = np.linalg.eigh(cov / np.outer(scale, scale))
        take = axes[:, ::-1][:, :min(dims, n - 1)] / scale[:, None]
        out[f] = (take, mean @ take)
    return out


def fit_folds(df: DataFrame, x: str, ys: str, fold: str, projections: dict[int, tuple], n_classes: int,
              min_pos: int = 8, c: float = 0.25, steps: int = 12, tolerance: float = 1e-8) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Balanced logistic fits of every class on the rows outside each fold: fold -> (weights, fitted).

    weights: (classes, components + 1), the last one the intercept, penalised like the others; fitted is
    False for classes with fewer than min_pos positives, or no negatives, among the training rows. A step
    is one pass over all rows for all folds and classes: each partition returns a gradient-and-curvature
    row per (fold, class); steps end when no weight moves any more.
    """
    folds = sorted(projections)
    own = {r["f"]: r for r in df.groupBy(F.col(fold).alias("f")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(ys)[i]).cast("double").alias(f"p{i}") for i in range(n_classes)]).collect()}
    counts = {f: np.array([r["n"], *[r[f"p{i}"] or 0.0 for i in range(n_classes)]], dtype=float) for f, r in own.items()}
    total = sum(counts.values())
    fits = {}
    for f in folds:
        n, *pos = total - counts.get(f, np.zeros(n_classes + 1))
        pos = np.array(pos)
        size = projections[f][0].shape[1] + 1
        fits[f] = [np.zeros((n_classes, size)), (pos >= min_pos) & (pos < n), n / (2 * np.maximum(pos, 1)), n / (2 * np.maximum(n - pos, 1))]
    data = df.select(F.col(fold).alias("f"), F.col(x).alias("x"), F.col(ys).alias("y"))
    for _ in range(steps):
        now = {f: (w.copy(), ok, wp, wn) for f, (w, ok, wp, wn) in fits.items()}

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            acc: dict[tuple[int, int], np.ndarray] = {}
            for b in batches:
                if not len(b):
                    continue
                m, y, at = (np.array(b[k].tolist(), dtype=float) for k in ("x", "y", "f"))
                for f, (w, ok, w_pos, w_neg) in now.items():  # noqa: B023
                    take = at != f
                    if not take.any():
                        continue
                    matrix, offset = projections[f]
                    z = np.column_stack([m[take] @ matrix - offset, np.ones(take.sum())])
                    q = 1 / (1 + np.exp(-np.clip(z @ w.T, -50, 50)))
                    t = y[take]
                    cw = np.where(t == 1, w_pos, w_neg)
                    g = (cw * (q - t)).T @ z
                    for i in np.flatnonzero(ok):
                        h = (z * (cw[:, i] * q[:, i] * (1 - q[:, i]))[:, None]).T @ z
                        acc[f, i] = acc.get((f, i), 0.0) + np.concatenate([g[i], h.ravel()])
            if acc:
                yield pd.DataFrame([(f, int(i), v) for (f, i), v in acc.items()], columns=["f", "i", "v"])
        rows = (data.mapInPandas(partial, "f int, i int, v array<double>").groupBy("f", "i")
                .agg(Summarizer.sum(array_to_vector("v")).alias("s")).select("f", "i", vector_to_array("s").alias("s")).collect())
        moved = 0.0
        for r in rows:
            w = fits[r["f"]][0]
            v, size = np.array(r["s"]), w.shape[1]
            step = np.linalg.solve(np.eye(size) + c * v[size:].reshape(size, size), w[r["i"]] + c * v[:size])
            w[r["i"]] -= step
            moved = max(moved, float(np.abs(step).max()))
        if moved < tolerance:
            break
    return {f: (w, ok) for f, (w, ok, _, _) in fits.items()}


def fit_many(df: DataFrame, x: str, ys: str, n_classes: int, dims: int, c: float = 0.25,
             steps: int = 6) -> np.ndarray:
    """Balanced logistic fits of many labels on shared features, over all rows: (classes, dims + 1) weights."""
    whole = {0: (np.eye(dims), np.zeros(dims))}  # no row belongs to fold 0
    rows = df.select(F.col(x).alias("_x"), F.col(ys).alias("_y"), F.lit(-1).alias("_f"))
    return fit_folds(rows, "_x", "_y", "_f", whole, n_classes, 0, c, steps)[0][0]


def probe_out_of_fold(df: DataFrame, keys: Sequence[str], emb: str, ys: str, base: str,
                      classes: Sequence[str], dims: int = 32, c: float = 0.25, alpha: float = 0.5,
                      min_pos: int = 8, fold: str = "fold") -> DataFrame:
    """Standardise, project to `dims` components and fit a logistic probe per class on the rows outside each
    fold; the decision value is blended with base on the fold's rows.

    ys, base: arrays in class order. Classes with too few positives keep the base score, and so does
    everything where no rows lie outside the fold.
    """
    n = len(classes)
    data = tables.stage(df.select(*keys, F.col(fold).cast("int").alias("_f"), F.col(emb).alias("_x"), F.col(ys).alias("_y"), F.col(base).alias("_b")),
                        "probe")
    projections = fold_projections(fold_moments(data, "_x", "_f"), dims)
    fits = fit_folds(data, "_x", "_y", "_f", projections, n, min_pos, c)

    @pandas_udf("array<double>")
    def decide(f: pd.Series, x: pd.Series, b: pd.Series) -> pd.Series:
        if len(x) == 0:
            return pd.Series([], dtype=object)
        out, m, at = np.array(b.tolist(), dtype=float), np.array(x.tolist(), dtype=float), f.to_numpy()
        for k, (w, ok) in fits.items():
            take = np.flatnonzero(at == k)
            if len(take):
                matrix, offset = projections[k]
                z = np.column_stack([m[take] @ matrix - offset, np.ones(len(take))])
                out[take] = np.where(ok, (1 - alpha) * out[take] + alpha * (z @ w.T), out[take])
        return pd.Series(list(out))
    names = F.array(*[F.lit(k) for k in classes])
    out = data.select(*keys, decide("_f", "_x", "_b").alias("_o"))
    return (out.select(*keys, F.explode(F.arrays_zip(names.alias("class"), F.col("_o").alias("p"))).alias("_z"))
            .select(*keys, F.col("_z.class").alias("class"), F.col("_z.p").alias("p")))


def stacking(df: DataFrame, features: Sequence[str], base: str, train: Column, classes: Sequence[str],
             keys: Sequence[str], blend: float = 0.1, plan: boosting.Plan = boosting.Plan()) -> DataFrame:
    """Boosted trees on stream features, all classes in the same jobs, blended into the base of the other rows.

    Classes without a fit (too few positives, or held-out rows of one kind) keep the base.
    """
    model = boosting.fit(df, features, classes, train, keys, plan=plan)
    rest = df.filter(~train)
    stacked = boosting.predict(rest.select(*keys, "class", *features, base), model, features, classes, [*keys, base])
    own = F.coalesce("stacked", F.col(base))
    return stacked.select(*keys, "class", ((1 - blend) * F.col(base) + blend * own).alias("p"), own.alias("stacked"))


def confound_accuracy(df: DataFrame, target: str, group: str, key: str, emb: str = "emb", k: int = 3,
                      iterations: int = 20) -> DataFrame:
    """How well embeddings tell a nuisance (site): accuracy with row folds and with grouped folds."""
    coded = StringIndexer(inputCol=target, outputCol="label").fit(df.withColumn(target, F.col(target).cast("string")))
    d = coded.transform(df.withColumn(target, F.col(target).cast("string"))).withColumn("_v", array_to_vector(emb))
    # grouped folds: whole groups, balanced by rows
    d = sampling.group_folds(d.withColumn("f_row", F.pmod(F.xxhash64(F.lit(1), key), F.lit(k))), group, k)
    d = d.withColumnRenamed("fold", "f_group").persist()
    chance = 1.0 / max(1, len(coded.labels))
    rows = []
    for kind in ("row", "group"):
        hits = n = 0
        for f in range(k):
            pipe = Pipeline(stages=[StandardScaler(inputCol="_v", outputCol="features", withMean=True),
                                    LogisticRegression(maxIter=iterations, regParam=0.01)])
            model = pipe.fit(d.filter(F.col(f"f_{kind}") != f))
            r = model.transform(d.filter(F.col(f"f_{kind}") == f)).agg(
                F.count(F.lit(1)).alias("n"), F.count_if(F.col("prediction") == F.col("label")).alias("h")).head()
            hits, n = hits + r["h"], n + r["n"]
        rows.append((kind, hits / n, hits / n / chance))
    d.unpersist()
    return df.sparkSession.createDataFrame(rows, "folds string, accuracy double, over_chance double")
