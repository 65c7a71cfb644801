"""Histogram boosting of all classes against a plain loop over one class."""
import numpy as np
from pyspark.sql import functions as F

from dawnscore.operators import boosting, models

PLAN = boosting.Plan(rounds=12, leaves=5, rate=0.3, least_rows=8, feature_share=1.0, row_share=2.0, patience=50)
FEATS = ["a", "b", "c"]


def data(seed=0, n=700, classes=("x", "y")):
    rng, rows = np.random.default_rng(seed), []
    for k, cls in enumerate(classes):
        x = rng.normal(size=(n, 3)).round(3)
        y = (x[:, k % 3] + 0.7 * x[:, 2] + rng.normal(size=n) > 1).astype(int)
        rows += [(f"{cls}{i}", cls, *map(float, x[i]), int(y[i]), i % 3) for i in range(n)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, class string, a double, b double, c double, y int, fold int")


def plain(rows, cls, cuts, plan, rounds):
    """Probabilities of the held-out rows after `rounds` trees."""
    mine = [r for r in rows if r[1] == cls]
    x = np.array([[sum(c < v for c in cut) for v, cut in zip(r[2:5], cuts)] for r in mine])
    y, train = np.array([r[5] for r in mine]), np.array([r[6] != 0 for r in mine])
    w = np.where(y == 1, (train & (y == 0)).sum() / (train & (y == 1)).sum(), 1.0)
    margin = np.zeros(len(y))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        groups, done = [np.arange(len(y))], []

        def score(i):
            t = i[train[i]]
            return g[t].sum() ** 2 / (h[t].sum() + 1e-12)
        while groups:
            offers = []
            for k, i in enumerate(groups):
                best = (0.0,)
                for f in range(3):
                    for cut in range(boosting.BINS - 1):
                        left, right = i[x[i, f] <= cut], i[x[i, f] > cut]
                        if min(train[left].sum(), train[right].sum()) < plan.least_rows:
                            continue
                        gain = round(score(left) + score(right) - score(i), 9)
                        if gain > best[0]:
                            best = (gain, left, right)
                if best[0] > 0:
                    offers.append((-best[0], k, best))
            room = plan.leaves - len(done) - len(groups)
            chosen = {k: b for _, k, b in sorted(offers, key=lambda o: o[:2])[:max(room, 0)]}
            done += [i for k, i in enumerate(groups) if k not in chosen]
            groups = [side for k in sorted(chosen, key=lambda k: -chosen[k][0]) for side in chosen[k][1:]]
            if len(done) + len(groups) == plan.leaves:
                done, groups = done + groups, []
        for i in done:
            t = i[train[i]]
            margin[i] -= plan.rate * g[t].sum() / (h[t].sum() + 1e-12)
    return {r[0]: p for r, p, t in zip(mine, 1 / (1 + np.exp(-margin)), train) if not t}


def auc(p, rows):
    y = {r[0]: r[5] for r in rows}
    pos, neg = [v for k, v in p.items() if y[k]], [v for k, v in p.items() if not y[k]]
    return np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg])


def test_equals_a_plain_loop_and_jobs_do_not_depend_on_classes(spark):
    rows = data()
    df = frame(spark, rows)
    model = boosting.fit(df, FEATS, ["x", "y"], F.col("fold") != 0, ["id"], plan=PLAN)
    got = {r.id: r.stacked for r in boosting.predict(df.filter("fold = 0"), model, FEATS, ["x", "y"], ["id"]).collect()}
    for k, cls in enumerate(("x", "y")):
        used = int(model.used[k])
        assert used >= 1
        want = plain(rows, cls, model.cuts, PLAN, used)
        assert max(abs(got[i] - p) for i, p in want.items()) < 1e-9
        assert abs(auc(want, rows) - model.auc[k]) < 5e-3 and model.auc[k] > 0.75
    single = boosting.fit(df.filter("class = 'x'"), FEATS, ["x"], F.col("fold") != 0, ["id"], plan=PLAN)
    many = boosting.fit(frame(spark, data(1, 200, ("x", "y", "z", "u", "v"))), FEATS, ["x", "y", "z", "u", "v"],
                        F.col("fold") != 0, ["id"], plan=PLAN)
    assert max(single.jobs, model.jobs, many.jobs) <= (PLAN.rounds + 1) * (PLAN.leaves - 1) + PLAN.rounds // boosting.STAGE


def test_stops_early_and_keeps_the_base_where_nothing_fits(spark):
    rng = np.random.default_rng(4)
    rows = [(f"n{i}", "noise", *map(float, rng.normal(size=3)), int(rng.random() < 0.4), i % 2) for i in range(300)]
    rows += [(f"r{i}", "rare", *map(float, rng.normal(size=3)), int(i < 2), i % 2) for i in range(40)]
    rows += [(f"m{i}", "noise", None, float("nan"), 1.0, None, i % 2) for i in range(4)]
    plan = boosting.Plan(rounds=60, patience=3, least_rows=5)
    df = frame(spark, rows)
    model = boosting.fit(df, FEATS, ["noise", "rare"], F.col("fold") != 0, ["id"], plan=plan)
    assert model.used[1] == 0 and 0 < model.used[0] < 40
    out = models.stacking(df.withColumn("base", F.lit(0.25)), FEATS, "base", F.col("fold") != 0, ["noise", "rare"], ["id"], plan=plan)
    got = {r.id: r for r in out.collect()}
    assert len(got) == sum(r[6] == 0 for r in rows)
    assert all(got[k].p == 0.25 == got[k].stacked for k in got if k.startswith("r"))
    assert all(0 < r.stacked < 1 for r in got.values())


def test_row_and_feature_shares():
    mark = np.random.default_rng(0).integers(-2 ** 63, 2 ** 63 - 1, 50_000)
    plan = boosting.Plan()
    a, b, c = (boosting.row_sampled(mark, t, plan) for t in (0, 4, 5))
    assert (a == b).all() and abs(a.mean() - 0.8) < 0.01 and abs((a & c).mean() - 0.64) < 0.01
    assert all(boosting.features_allowed(t, 19, plan).sum() == 15 for t in range(4))
    assert boosting.binned_auc(np.array([0, 1, 1]), np.array([2, 1, 0])) == (1 * 2.5 + 1 * 3) / 6


def test_bytes_of_a_cut_column_and_nodes_one_row_at_a_time():
    import pyarrow as pa
    rng = np.random.default_rng(5)
    bins = rng.integers(0, 8, (40, 3)).astype(np.uint8)
    for kind in (pa.binary(), pa.large_binary()):
        column = pa.array([r.tobytes() for r in bins], kind)
        assert (boosting._bytes(column.slice(7, 20), 3) == bins[7:27]).all()
        assert boosting._bytes(column.slice(0, 0), 3).shape == (0, 3)
    t = boosting.Trees(2, 2, 5)
    t.left[1, 1, :2], t.feature[1, 1, :2], t.cut[1, 1, :2] = (1, 3), (0, 2), (3, 5)
    cls = rng.integers(0, 2, 40)
    want = [0 if c == 0 else 2 if b[0] > 3 else 4 if b[2] > 5 else 3 for c, b in zip(cls, bins)]
    assert t.nodes(cls, bins, 1).tolist() == want and not t.nodes(cls, bins, 0).any()
