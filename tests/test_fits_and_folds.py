"""Folds, expected information and probes against plain versions."""
import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dawnscore.operators import models, sampling, vectors


def greedy(sizes, k):
    loads, takes = [0] * k, {}
    for s in sorted(sizes, reverse=True):
        f = loads.index(min(loads))
        loads[f] += s
        takes.setdefault(s, [0] * k)[f] += 1
    return loads, takes


def test_lightest_folds_equal_the_walk_over_groups():
    rng = random.Random(1)
    for _ in range(300):
        sizes = [rng.choice([1, 1, 2, 3, 5, 8, 40]) for _ in range(rng.randrange(1, 60))]
        k = rng.randrange(1, 7)
        loads, takes = greedy(sizes, k)
        got = sampling.lightest_folds([(s, sizes.count(s)) for s in set(sizes)], k)
        assert [sum(s * t[f] for s, t in got) for f in range(k)] == loads
        assert all(t == takes[s] for s, t in got)


def test_large_group_gets_a_fold_of_its_own(spark):
    rows = [("big", i) for i in range(40)] + [(f"g{i % 20}", i) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, i long")
    out = sampling.group_folds(df, "g", 3).groupBy("fold").agg(F.count("*").alias("n"), F.collect_set("g").alias("g")).collect()
    assert sorted(r["n"] for r in out) == [30, 30, 40]
    assert [r["g"] for r in out if r["n"] == 40] == [["big"]]
    assert sampling.group_folds(df.limit(0), "g", 3).count() == 0


@pytest.mark.parametrize("a,b,n", [(3, 4, 9), (1, 1, 5), (5, 5, 8), (8, 3, 8), (2, 6, 7)])
def test_expected_information_equals_enumeration(a, b, n):
    total = 0.0
    for chosen in combinations(range(n), b):
        k = sum(i < a for i in chosen)
        total += (k / n * math.log(k * n / (a * b)) if k else 0.0) / math.comb(n, b)
    assert math.isclose(vectors.expected_information(a, b, n), total, rel_tol=1e-10, abs_tol=1e-14)


def test_expected_information_of_large_margins():
    # near the large-sample value: one half of one over n, less the cells' shares
    n, a, b = 4_000_000_000, 1_200_000_000, 900_000_000
    both = sum(vectors.expected_information(x, y, n) for x in (a, n - a) for y in (b, n - b))
    assert math.isclose(both, 1 / (2 * n), rel_tol=1e-2)


def test_information_is_adjusted_for_chance(spark):
    rows = [(i % 8, f"c{i // 8 % 2}") for i in range(160)] + [(9, "c9")] * 12
    got = {r["class"]: r for r in vectors.presence_information(spark.createDataFrame(rows, "g long, class string"), "g").collect()}
    assert math.isclose(got["c9"]["nmi"], 1.0) and 0.1 < got["c9"]["adjusted"] < 1
    assert abs(got["c0"]["adjusted"]) < 0.1
    assert "c0" in got and vectors.presence_information(spark.createDataFrame([(1, "a")] * 3, "g long, class string"), "g").count() == 0


def plain_probe(x, y, fold, held, dims, c, min_pos):
    """Decision values of the held rows per class, or None."""
    train = fold != held
    mean, sd = x[train].mean(0), x[train].std(0)
    z = (x - mean) / sd
    axes = np.linalg.svd(z[train], full_matrices=False)[2][:dims]
    p = np.column_stack([z @ axes.T, np.ones(len(x))])
    out = []
    for i in range(y.shape[1]):
        t, m = y[train, i], p[train]
        if not min_pos <= t.sum() < len(t):
            out.append(None)
            continue
        cw = np.where(t == 1, len(t) / (2 * t.sum()), len(t) / (2 * (len(t) - t.sum())))
        w = np.zeros(p.shape[1])
        for _ in range(60):
            q = 1 / (1 + np.exp(-m @ w))
            grad = w + c * m.T @ (cw * (q - t))
            w -= np.linalg.solve(np.eye(len(w)) + c * (m * (cw * q * (1 - q))[:, None]).T @ m, grad)
        assert np.abs(w + c * m.T @ (cw * (1 / (1 + np.exp(-m @ w)) - t))).max() < 1e-6
        out.append(p[~train] @ w)
    return out


def test_probe_equals_plain_fits_on_the_other_folds(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(240, 12)) @ rng.normal(size=(12, 12))
    y = np.column_stack([x[:, 0] + rng.normal(size=240) > 0, x[:, 1] > 2.5, np.arange(240) < 3]).astype(int)
    fold, base = np.arange(240) % 5, rng.random((240, 3))
    rows = [(i, [float(v) for v in x[i]], [int(v) for v in y[i]], [float(v) for v in base[i]], int(fold[i])) for i in range(240)]
    df = spark.createDataFrame(rows, "id long, emb array<double>, ys array<int>, base array<double>, fold int")
    got = {(r["id"], r["class"]): r["p"] for r in models.probe_out_of_fold(df, ["id"], "emb", "ys", "base", ["a", "b", "c"], dims=6).collect()}
    assert len(got) == 720
    for held in range(5):
        want = plain_probe(x, y, fold, held, 6, 0.25, 8)
        for i, name in enumerate("abc"):
            for k, row in enumerate(np.flatnonzero(fold == held)):
                value = base[row, i] if want[i] is None else 0.5 * base[row, i] + 0.5 * want[i][k]
                assert abs(got[row, name] - value) < 1e-6
    assert want[2] is None
    one = models.probe_out_of_fold(df.withColumn("fold", F.lit(0)), ["id"], "emb", "ys", "base", ["a", "b", "c"]).collect()
    assert all(abs(r["p"] - base[r["id"], "abc".index(r["class"])]) < 1e-12 for r in one)
