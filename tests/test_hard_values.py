"""Skewed, crowded, infinite, missing and repeated values against pandas and NumPy."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dawnscore.operators import align, blend, levers, metrics, rank

RNG = np.random.default_rng(11)
VALUES = {
    "near_zero": RNG.beta(0.05, 8, 4000), "near_one": 1 - RNG.beta(0.05, 8, 4000), "distances": RNG.chisquare(1536, 4000),
    "mostly_zero": np.where(RNG.random(4000) < 0.9, 0.0, RNG.normal(size=4000)), "signed": RNG.normal(size=4000) * 1e-9,
    "tiny": np.array([5e-324, -5e-324, 0.0, 1e308, -1e308, 1.0, 0.5, np.nextafter(0.5, 0), np.nextafter(1, 0)] * 3),
    "infinite": np.array([np.inf, -np.inf, 0.0, 1.0, -1.0, 2.0, np.inf]),
}


def frame(spark, values):
    return spark.createDataFrame(pd.DataFrame({"class": "a", "i": range(len(values)), "p": values}))


@pytest.mark.parametrize("name", sorted(VALUES))
def test_ranks_equal_pandas(spark, name):
    got = rank.add_rank(frame(spark, VALUES[name]), ["class"], "p", "r", "raw").toPandas().sort_values("i")
    assert (got["r"].to_numpy() == pd.Series(VALUES[name]).rank().to_numpy()).all()


@pytest.mark.parametrize("name", ["near_zero", "near_one", "distances"])
def test_buckets_spread_and_keep_the_order(spark, name):
    rows = frame(spark, VALUES[name]).select("p", rank.value_bucket(F.col("p")).alias("b")).toPandas().sort_values("p")
    assert (np.diff(rows["b"]) >= 0).all()
    assert rows.groupby("b")["p"].nunique().max() < 0.02 * len(rows)


def test_null_and_nan_ranks(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, None), ("a", 3, float("nan")), ("a", 4, float("inf"))], "class string, i int, p double")
    got = {r.i: r.r for r in rank.add_rank(df, ["class"], "p", "r", "raw").collect()}
    assert got == {1: 1.0, 2: None, 3: 3.0, 4: 2.0}


def test_auc_of_close_and_infinite_scores(spark):
    rows = [("a", k * 1e-10, int(k > 2)) for k in range(1, 5)] + [("b", float("inf"), 1), ("b", 3.0, 0), ("b", -9.0, 0)]
    got = {r["class"]: r.auc for r in metrics.auc(spark.createDataFrame(rows, "class string, p double, y int"), ["class"], "p").collect()}
    assert got == {"a": 1.0, "b": 1.0}
    pairs = spark.createDataFrame([("a", s, s, y) for _, s, y in rows[:4]], "class string, a double, b double, y int")
    assert blend.best_class_weight(pairs, "a", "b", [0.0, 1.0]).first().auc == 1.0


def test_one_sided_classes_do_not_abort(spark):
    train = spark.createDataFrame([("a", 1.0)], "class string, p double")
    target = spark.createDataFrame([("a", 2.0), ("z", 1.0)], "class string, p double")
    assert {r["class"]: r.c for r in rank.reference_cdf(train, target, ["class"], "p", "c").collect()} == {"a": 1.0, "z": None}
    long = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 1), ("z", 1.0, 1)], "class string, p double, side int")
    assert {r["class"]: r.ks for r in metrics.ks_statistic(long, ["class"], "p", "side").collect()} == {"a": 1.0, "z": None}
    logits = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 3.0), ("z", 1, 5.0)], "class string, h int, x double")
    assert {(r["class"], r.h): r.o for r in levers.hour_bias(logits, "x", "h", "o").collect()} == {
        ("a", 1): 3.0, ("a", 2): 1.0, ("z", 1): 5.0}


def test_grid_takes_repeats_strays_and_unknown_classes(spark):
    cells = spark.createDataFrame([("f", 0, "a", 1.0), ("f", 0, "a", 2.0), ("f", 1, "b", 3.0), ("f", 5, "a", 9.0), ("f", -1, "b", 9.0),
                                   ("g", 0, "zz", 4.0), ("h", 1, "b", None)], "file_id string, win int, class string, p double")
    got = {(r.file_id, r.win, r["class"]): r.p for r in align.densify_files(cells, ["file_id"], ["a", "b"], 2, ["p"]).collect()}
    want = {(f, w, c): None for f in "fgh" for w in (0, 1) for c in "ab"}
    assert got == want | {("f", 0, "a"): 2.0, ("f", 1, "b"): 3.0}


def test_neighbours_of_string_keys_and_limited_probes(spark):
    from dawnscore.operators import vectors
    m = RNG.normal(size=(90, 6)).round(3)
    df = spark.createDataFrame([(f"row_{i:03d}", m[i].tolist()) for i in range(90)], "key string, emb array<double>")
    unit = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
    sims = np.round(unit @ unit.T, 9)
    np.fill_diagonal(sims, -9)
    want = {(f"row_{i:03d}", f"row_{j:03d}") for i in range(90) for j in np.argsort(-sims[i], kind="stable")[:3]}
    got = {(r.q_id, r.t_id) for r in vectors.knn(df, "key", 3, block=20).collect()}
    assert got == want
    some = {(r.q_id, r.t_id) for r in vectors.knn(df, "key", 3, block=20, n_probe=2).collect()}
    assert len(some) == len(want) and len(some & want) / len(want) > 0.6
    assert vectors.knn(df.limit(0), "key", 3).count() == 0
