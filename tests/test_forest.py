"""Index search against the exact one."""
import numpy as np
from pyspark.sql import functions as F

from dawnscore.operators import forest, vectors


def table(spark, m, files=None, name="id"):
    rows = [(i, int(files[i]) if files is not None else i // 3, [float(v) for v in x]) for i, x in enumerate(m)]
    return spark.createDataFrame(rows, f"{name} long, f long, emb array<double>")


def clustered(n, dims=24, centres=60, seed=1):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(centres, dims))[rng.integers(0, centres, n)] + 0.25 * rng.normal(size=(n, dims))


def brute(m, files, queries, k):
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for q in queries:
        sims = np.round(u @ u[q], 9)
        sims[(files == files[q]) | (np.arange(len(m)) == q)] = -9
        out[q] = np.sort(sims)[::-1][:k]
    return out


def test_recall_on_clusters_and_few_leaves_seen(spark):
    m = clustered(6000)
    files = np.arange(6000) // 3
    asking = list(range(0, 6000, 50))
    got = forest.index_knn(table(spark, m, files), "id", 5, exclude=["f"], queries=F.expr("id % 50 = 0"),
                           trees=6, leaf=128, probes=4).collect()
    want = brute(m, files, asking, 5)
    hits = sum(r.sim >= want[r.q_id][r.place - 1] - 1e-6 for r in got)
    assert {r.q_id for r in got} == set(asking) and hits >= 0.95 * 5 * len(asking)
    assert all(files[r.q_id] != files[r.t_id] for r in got)
    assert len({(r.q_id, r.t_id) for r in got}) == len(got)
    trees = [forest.grow(m.astype(np.float32), 6000, 128, 10_000, np.random.default_rng(s)) for s in range(6)]
    for t in trees:
        leaf, _ = t.route(m.astype(np.float32))
        assert np.bincount(leaf).max() <= 128 and (t.leaves(m.astype(np.float32), 4)[:, 0] == leaf).all()


def test_one_leaf_is_exact_and_recall_counts_places(spark):
    m = clustered(300)
    d = table(spark, m)
    exact = vectors.knn(d, "id", 4, exclude=["f"], queries=F.expr("id % 7 = 0"))
    found = forest.index_knn(d, "id", 4, exclude=["f"], queries=F.expr("id % 7 = 0"))
    assert forest.recall(found, exact).first() == (1.0, 43)
    assert forest.recall(found.filter("place <= 2"), exact).first()[0] == 0.5
    blocks = vectors.knn(d, "id", 4, exclude=["f"], block=40, queries=F.expr("id % 7 = 0"))
    assert sorted(map(tuple, blocks.collect())) == sorted(map(tuple, exact.collect()))


def test_sample_smaller_than_the_table_adds_bits():
    x = np.random.default_rng(2).normal(size=(20_000, 16)).astype(np.float32)
    t = forest.grow(x[:256], 20_000, 64, 10_000, np.random.default_rng(0))
    assert len(t.more) >= 3
    leaf, margins = t.route(x)
    sizes = np.unique(leaf, return_counts=True)[1]
    assert np.median(sizes) < 150 and margins.shape[1] == t.depth + len(t.more)
    seen = t.leaves(x[:50], 5)
    assert all(len(set(r.tolist())) == 5 for r in seen if (r >= 0).all())


def test_copies_fill_a_leaf(spark):
    m = clustered(900)
    m[:600] = m[0]
    files = np.arange(900)
    got = forest.index_knn(table(spark, m, files), "id", 3, exclude=["f"], trees=3, leaf=64, probes=2, chunk=50).collect()
    copies = [r for r in got if r.q_id < 600]
    assert len(copies) == 1800 and all(r.sim > 1 - 1e-8 and r.t_id < 600 for r in copies)
    assert {r.q_id for r in got} == set(range(900))


def test_keys_of_other_types_and_empty(spark):
    d = table(spark, clustered(40)).withColumn("id", F.concat(F.lit("k"), "id"))
    got = forest.index_knn(d, "id", 2).collect()
    assert len(got) == 80 and all(r.q_id.startswith("k") and r.q_id != r.t_id for r in got)
    assert forest.index_knn(d.limit(0), "id", 2).count() == 0
    none = d.withColumn("emb", F.when(F.col("id") != "k1", F.col("emb")))
    assert len({r.q_id for r in forest.index_knn(none, "id", 2).collect()}) == 39
