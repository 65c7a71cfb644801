"""Operators without check SQL against direct NumPy computations on small data."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from dawnscore.operators import metrics, models, smooth, trust, vectors

SERIES = ["file_id", "class"]


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(5)
    rows = [(f"f{f}", w, c, float(rng.random())) for f in range(4) for c in ("a", "b")
            for w in range(12 if f else 1)]
    df = spark.createDataFrame(rows, "file_id string, win int, class string, p double")
    by = {}
    for f, w, c, p in rows:
        by.setdefault((f, c), []).append(p)
    return df, {k: np.array(v) for k, v in by.items()}


def check(out, want):
    got = {}
    for r in out.orderBy("win").collect():
        got.setdefault((r["file_id"], r["class"]), []).append(r["q"])
    for k, v in want.items():
        assert got[k] == pytest.approx(list(v), abs=1e-9)


def kalman_forward(z, q, r, p0, update_first):
    x, p, out = z[0], p0, []
    for t, v in enumerate(z):
        if t or update_first:
            pp = p + q
            k = pp / (pp + r)
            x, p = x + k * (v - x), (1 - k) * pp
        out.append((x, p))
    return out


def test_kalman(series):
    df, by = series
    check(smooth.kalman(df, SERIES, "win", "p", "q", 0.1, 0.3),
          {k: [s[0] for s in kalman_forward(v, 0.1, 0.3, 0.3, True)] for k, v in by.items()})


@pytest.mark.parametrize("fixed", [False, True])
def test_rts(series, fixed):
    df, by = series
    want = {}
    for k, z in by.items():
        f = kalman_forward(z, 0.02, 0.1, 0.1 if fixed else 1e6, False)
        x = [s[0] for s in f]
        for t in range(len(x) - 2, -1, -1):
            g = 0.02 / 0.12 if fixed else f[t][1] / (f[t][1] + 0.02)
            x[t] = f[t][0] + g * (x[t + 1] - f[t][0])
        want[k] = x
    check(smooth.kalman_rts(df, SERIES, "win", "p", "q", 0.02, 0.1, 0.1 if fixed else 1e6, fixed), want)


def test_hmm_equals_enumeration(series):
    """Posterior by summing over all state paths of short series."""
    df, by = series
    short = df.filter("win < 6")
    want = {}
    for k, v in by.items():
        e = np.clip(v[:6], 1e-3, 1 - 1e-3)
        n = len(e)
        num, den = np.zeros(n), 0.0
        for path in range(2 ** n):
            s = [(path >> i) & 1 for i in range(n)]
            pr = (0.1 if s[0] else 0.9)
            for t in range(n):
                pr *= e[t] if s[t] else 1 - e[t]
                if t:
                    pr *= [[0.8, 0.2], [0.35, 0.65]][s[t - 1]][s[t]]
            den += pr
            num += pr * np.array(s)
        want[k] = num / den
    check(smooth.hmm_posterior(short, SERIES, "win", "p", "q", F.lit(0.2), F.lit(0.35)), want)


def test_trust_filter_stays_in_range_and_follows_agreement(spark):
    rows = [("f", w, c, .9 if w > 5 else .1, .85 if w > 5 else .15) for w in range(12) for c in ("a", "b")]
    df = spark.createDataFrame(rows, "file_id string, win int, class string, x double, z double")
    out = {(r["win"], r["class"]): r["p"] for r in trust.trust_filter(df, ["x", "z"]).collect()}
    assert len(out) == 24 and all(0 < p < 1 for p in out.values())
    assert out[(11, "a")] > 0.6 > 0.4 > out[(3, "a")]


def brute_knn(m, files, k):
    u = m / (np.linalg.norm(m, axis=1, keepdims=True) + 1e-9)
    s = np.round(u @ u.T, 9)
    out = set()
    for i in range(len(m)):
        cand = sorted((-s[i, j], j) for j in range(len(m)) if j != i and files[j] != files[i])[:k]
        out |= {(i, j) for _, j in cand}
    return out


@pytest.mark.parametrize("block", [32, 10_000])
def test_knn_blocks_and_hot_copies(spark, block):
    """A third of the vectors are copies of one vector; blocks are forced to be small."""
    rng = np.random.default_rng(2)
    m = rng.normal(size=(240, 8)).round(3)
    m[::3] = m[0]
    files = [i // 4 for i in range(240)]
    df = spark.createDataFrame([(i, files[i], m[i].tolist()) for i in range(240)], "id long, f int, emb array<double>")
    got = {(r["q_id"], r["t_id"]) for r in vectors.knn(df, "id", 5, exclude=["f"], block=block).collect()}
    assert got == brute_knn(m, files, 5)


def test_auc_without_group(spark):
    rng = np.random.default_rng(1)
    rows = [("c", f"s{i % 3}", float(round(rng.random(), 2)), int(rng.random() < .4)) for i in range(120)]
    df = spark.createDataFrame(rows, "class string, site string, p double, y int")
    got = {r["site"]: r["auc"] for r in metrics.auc_without(df, ["class"], "site", "p").collect()}
    for s in ("s0", "s1", "s2"):
        rest = df.filter(F.col("site") != s)
        assert got[s] == pytest.approx(metrics.auc(rest, ["class"], "p").head()["auc"])


@pytest.fixture(scope="module")
def calib(spark):
    rng = np.random.default_rng(7)
    s = rng.random(400).round(3)
    y = (rng.random(400) < s).astype(int)
    rows = [("c", int(i % 2), float(s[i]), int(y[i])) for i in range(400)]
    return spark.createDataFrame(rows, "class string, fold int, p double, y int"), s, y, np.arange(400) % 2


def test_platt_solves_its_equations(calib):
    df, s, y, fold = calib
    rows = models.platt(df, "p", "q", steps=12).filter("fold = 0").select("p", "q").distinct().orderBy("p").collect()
    a = (rows[-1]["q"] - rows[0]["q"]) / (rows[-1]["p"] - rows[0]["p"])
    b = rows[0]["q"] - a * rows[0]["p"]
    x, t = s[fold == 1], y[fold == 1]
    r = 1 / (1 + np.exp(-(a * x + b))) - t
    assert abs(a + (r * x).sum()) < 1e-6 and abs(r.sum()) < 1e-6


def test_isotonic_is_the_least_squares_monotone_fit(calib):
    df, s, y, fold = calib
    out = {r["p"]: r["q"] for r in models.isotonic(df, "p", "q").filter("fold = 0").collect()}
    x, t = s[fold == 1], y[fold == 1].astype(float)
    grid = np.unique(x)
    # min-max formula of isotonic regression
    def block(i, j):
        m = (x >= grid[i]) & (x <= grid[j])
        return t[m].mean()
    fit = [max(min(block(i, j) for j in range(k, len(grid))) for i in range(k + 1)) for k in range(0, len(grid), 20)]
    at = [float(g) for g in grid[::20]]
    shared = [(g, f) for g, f in zip(at, fit) if g in out]
    assert shared and all(out[g] == pytest.approx(f) for g, f in shared)
    xs = sorted(out)
    assert all(out[a] <= out[b] + 1e-12 for a, b in zip(xs, xs[1:]))


def test_mahalanobis(spark):
    rng = np.random.default_rng(9)
    m = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(60)], "id long, emb array<double>")
    c = np.cov(m.T)
    c = .9 * c + .1 * np.diag(c).mean() * np.eye(4)
    d = m - m.mean(axis=0)
    want = np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d)
    got = {r["id"]: r for r in vectors.mahalanobis(df, df, ["id"]).collect()}
    assert [got[i]["dist"] for i in range(60)] == pytest.approx(list(want))
    p90 = np.percentile(want, 90)
    assert got[3]["weight"] == pytest.approx(np.exp(-max(0, want[3] - p90) / p90))


def test_fit_many_gradient_is_zero(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(150, 3))
    y = np.column_stack([(x[:, 0] + rng.normal(size=150) > .8), (x[:, 1] > 0)]).astype(int)
    df = spark.createDataFrame([(x[i].tolist(), y[i].tolist()) for i in range(150)], "x array<double>, y array<int>")
    w = models.fit_many(df, "x", "y", 2, 3, steps=12)
    m = np.column_stack([x, np.ones(150)])
    for c in range(2):
        p = y[:, c].sum()
        cw = np.where(y[:, c] == 1, 150 / (2 * p), 150 / (2 * (150 - p)))
        q = 1 / (1 + np.exp(-m @ w[c]))
        assert np.abs(w[c] + .25 * (cw * (q - y[:, c])) @ m).max() < 1e-6


def test_knn_moves_rows_once_per_block(spark):
    """Rows that reach the comparing groups: queries x target blocks + targets x query blocks, and no more."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(600, 8)).round(3)
    files = [i // 4 for i in range(600)]
    df = spark.createDataFrame([(i, files[i], m[i].tolist()) for i in range(600)] + [(600, 999, None)],
                               "id long, f int, emb array<double>")
    met = spark.sparkContext.accumulator(0)
    plain = vectors._top_pairs

    def counted(q, t, k, exclude):
        met.add(len(q) + len(t))
        return plain(q, t, k, exclude)
    vectors._top_pairs = counted
    try:
        got = {(r["q_id"], r["t_id"]) for r in vectors.knn(df, "id", 5, exclude=["f"], block=30).collect()}
    finally:
        vectors._top_pairs = plain
    assert got == brute_knn(m, files, 5)
    assert 0 < met.value <= 600 * 3 + 600 * 8
