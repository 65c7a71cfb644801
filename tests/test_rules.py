"""Hand-made frames with known numbers, and invariants."""
import math

import pytest
from pyspark.sql import functions as F

from dawnscore.functions import keys as K
from dawnscore.functions import scalar as S
from dawnscore.functions import vec
from dawnscore.operators import (align, arrays, encode, metrics, normalize, pairs, profile, rank,
                                 sampling, smooth)


@pytest.fixture(scope="module")
def one_file(spark):
    rows = [("f", w, "ramp", w / 11.0, int(w > 5)) for w in range(12)]
    rows += [("f", w, "flat", 0.5, 0) for w in range(12)]
    return spark.createDataFrame(rows, "file_id string, win int, class string, p double, y int")


@pytest.fixture(scope="module")
def ties(spark):
    return spark.createDataFrame([("c", .1, 0), ("c", .1, 1), ("c", .1, 0), ("c", .9, 1)],
                                 "class string, p double, y int")


def test_average_tie_rank(ties):
    got = sorted(r["r"] for r in rank.add_rank(ties, ["class"], "p", "r").collect())
    assert got == [0.5, 0.5, 0.5, 1.0]


def test_auc_with_ties(ties):
    assert metrics.auc(ties, ["class"], "p").head()["auc"] == pytest.approx(0.75)


def test_auc_skips_single_label_classes(spark):
    df = spark.createDataFrame([("n", .1, 0), ("n", .2, 0), ("p", .3, 1), ("m", .4, 1), ("m", .2, 0)],
                               "class string, p double, y int")
    assert [r["class"] for r in metrics.auc(df, ["class"], "p").collect()] == ["m"]
    none = metrics.macro_auc(df.filter("class <> 'm'"), [], "p", when_none=0.0).head()
    assert (none["macro"], none["n_classes"]) == (0.0, 0)


def test_auc_of_negated_scores_and_temperature(one_file):
    df = one_file.filter("class = 'ramp'").withColumn("p", F.abs(F.col("p") - 0.4))
    df = df.withColumn("n", -F.col("p")).withColumn("t", S.temperature(F.col("p"), F.lit(1.3)))
    a, b, c = (metrics.auc(df, ["class"], x).head()["auc"] for x in ("p", "n", "t"))
    assert a == pytest.approx(1 - b) and a == pytest.approx(c)


KERNELS = {
    "five": lambda s, x: smooth.kernel(s, x, smooth.FIVE_TAP),
    "truncated": lambda s, x: smooth.gaussian_truncated(s, x, 0.7),
    "nearest": lambda s, x: smooth.gaussian(s, x, 1.5),
    "reflect": lambda s, x: smooth.gaussian(s, x, 1.5, "reflect"),
    "student": smooth.fat_tail,
    "blend": lambda s, x: smooth.neighbour_blend(s, x, 0.4),
    "max": lambda s, x: smooth.local_max(s, x, 0.4),
    "median": lambda s, x: smooth.median_filter(s, x, 5),
}


@pytest.mark.parametrize("name", sorted(KERNELS))
def test_smoothing_keeps_constants_and_single_windows(one_file, name):
    s = smooth.Series(["file_id", "class"], "win")
    out = one_file.withColumn("q", KERNELS[name](s, "p"))
    assert all(r["q"] == pytest.approx(0.5) for r in out.filter("class = 'flat'").collect())
    single = one_file.filter("class = 'ramp' and win = 7")
    assert single.withColumn("q", KERNELS[name](s, "p")).head()["q"] == pytest.approx(7 / 11)


def test_kernels_sum_to_one():
    for w in (smooth.FIVE_TAP, smooth.student_weights(), smooth.gaussian_weights(0.5, 2)):
        assert sum(w) == pytest.approx(1)


@pytest.mark.parametrize("fn", [
    lambda d: smooth.ema_two_pass(d, ["file_id", "class"], "win", "p", "q", 0.3),
    lambda d: smooth.kalman(d, ["file_id", "class"], "win", "p", "q"),
    lambda d: smooth.kalman_rts(d, ["file_id", "class"], "win", "p", "q", 0.01, 0.1)])
def test_recursions_keep_constants(one_file, fn):
    assert all(r["q"] == pytest.approx(0.5) for r in fn(one_file).filter("class = 'flat'").collect())


def test_adaptive_blend_leaves_single_row_files(one_file):
    one = one_file.filter("win = 3")
    got = smooth.adaptive_blend(one, "p", "q").filter("class = 'ramp'").head()
    assert got["q"] == got["p"]


def test_ranks_lie_in_unit_interval(one_file):
    r = rank.add_rank(one_file, ["class"], "p", "r").agg(F.min("r"), F.max("r")).head()
    assert 0 < r[0] and r[1] <= 1


def test_normal_quantile(spark):
    df = spark.createDataFrame([(0.5,), (0.975,), (0.01,), (0.999,)], "p double")
    got = [r["z"] for r in df.select(S.normal_quantile(F.col("p")).alias("z")).collect()]
    assert got == pytest.approx([0, 1.959963985, -2.326347874, 3.090232306], abs=1e-7)


def test_names(spark):
    df = spark.createDataFrame([("REC_Train_0007_S08_20250102_230405.ogg",), ("odd.ogg",)], "f string")
    f = F.col("f")
    a, b = df.select(K.name_site(f).alias("s"), K.name_hour(f).alias("h"), K.name_site(f, unknown="unknown").alias("u"),
                     K.name_timestamp(f).cast("string").alias("t")).collect()
    assert (a["s"], a["h"], a["t"]) == ("S08", 23, "2025-01-02 23:04:05")
    assert (b["s"], b["h"], b["u"], b["t"]) == (None, -1, "unknown", None)


def test_list_literals(spark):
    df = spark.createDataFrame([("['x', 'y']",), ("[]",), ("",), (None,), ("x y",), ("x,y",)], "t string")
    got = [r["l"] for r in df.select(K.parse_list_literal(F.col("t")).alias("l")).collect()]
    assert got == [["x", "y"], [], [], [], ["x", "y"], ["x", "y"]]


def test_segment_union(spark):
    df = spark.createDataFrame([("f", 5, "a; b;"), ("f", 5, "a; b;"), ("f", 5, None), ("f", 5, "b;c")],
                               "filename string, end int, primary_label string")
    assert profile.segment_labels(df, ["filename", "end"]).head()["lbls"] == ["a", "b", "c"]


def test_secondary_wins_on_a_clash(spark):
    df = spark.createDataFrame([(1, "a", ["a", "b", "zz"])], "id int, p string, s array<string>")
    out = encode.soft_targets(df, "id", F.col("p"), F.col("s"), ["a", "b"], 0.3)
    assert {r["class"]: r["weight"] for r in out.collect()} == {"a": 0.3, "b": 0.3}


def test_two_sites(spark):
    df = spark.createDataFrame([("a", "S1", 1), ("a", "S1", 1), ("b", "S1", 1), ("b", "S2", 1), ("b", "S3", 1),
                                ("c", "S1", 0)], "class string, site string, y int")
    got = {r["class"]: (r["n_sites"], r["site_band"]) for r in profile.site_counts(df, F.col("y") == 1).collect()}
    assert got == {"a": (1, "1"), "b": (3, "3+"), "c": (0, "0")}


def test_dense_grid_fills_gaps(spark):
    cells = spark.createDataFrame([("f", 0, "b", 1.0), ("f", 2, "a", 2.0), ("g", 1, "zz", 3.0), ("g", 1, "b", 4.0)],
                                  "file_id string, win int, class string, x double")
    got = align.densify_files(cells, ["file_id"], ["a", "b"], 3, ["x"]).collect()
    assert len(got) == 12
    assert {(r["file_id"], r["win"], r["class"]): r["x"] for r in got if r["x"] is not None} == {
        ("f", 0, "b"): 1.0, ("f", 2, "a"): 2.0, ("g", 1, "b"): 4.0}


def test_chunk_shift_wraps(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 3.0)], "chunk int, p double")
    got = {r["win"]: r["p"] for r in align.chunk_to_window(df, shift=2).collect()}
    assert got[2] == 1.0 and got[11] == 3.0 and got[0] == 3.0 and got[1] == 3.0


def test_hms_round_trip(spark):
    df = spark.createDataFrame([(0,), (59,), (3725,)], "s int")
    d = df.withColumn("t", K.seconds_to_hms(F.col("s"))).withColumn("b", K.hms_to_seconds(F.col("t")))
    assert all(r["s"] == r["b"] for r in d.collect())
    assert d.filter("s = 3725").head()["t"] == "01:02:05"


def test_crops_and_tiling(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],)], "x array<double>")
    x = F.col("x")
    r = df.select(arrays.centre_crop(x, 3).alias("c"), arrays.centre_crop(x, 7).alias("p"),
                  arrays.tile(x, 7).alias("t"), arrays.clip_around(x, F.lit(0), 2).alias("a"),
                  arrays.clip_around(x, F.lit(99), 2).alias("z")).head()
    assert r["c"] == [2.0, 3.0, 4.0] and r["p"] == [1.0, 2.0, 3.0, 4.0, 5.0, 0.0, 0.0]
    assert r["t"] == [1.0, 2.0, 3.0, 4.0, 5.0, 1.0, 2.0] and r["a"] == [1.0, 2.0] and r["z"] == [4.0, 5.0]


def test_swap_run(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [9, 8, 7, 6])], "a array<int>, b array<int>")
    assert df.select(arrays.swap_run(F.col("a"), F.col("b"), F.lit(1), F.lit(2)).alias("s")).head()["s"] == [1, 8, 7, 4]


def test_unit_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    a, b = df.select(vec.unit(F.col("v")).alias("u")).collect()
    assert a["u"] == pytest.approx([.6, .8]) and b["u"] == [0.0, 0.0]


def test_file_scaling_by_hand(spark):
    df = spark.createDataFrame([("f", 0, "a", .1), ("f", 1, "a", .5), ("f", 2, "a", .3)],
                               "file_id string, win int, class string, p double")
    keys = ["file_id", "class"]
    by = normalize.file_confidence(df, keys, "p", "q").orderBy("win").collect()
    assert by[0]["q"] == pytest.approx(.1 * .4 ** .4)
    assert normalize.rank_aware(df, keys, "p", "q").filter("win = 2").head()["q"] == pytest.approx(.3 * .5 ** .4)


def test_hot_value_quantiles_and_ranks(spark):
    """A third of all rows share one value in one class."""
    df = (spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), F.col("id") % 5))
                                   .alias("class"),
                                   F.when(F.col("id") % 3 == 0, 0.0).otherwise((F.col("id") % 701) / 701.0).alias("p")))
    r = rank.add_rank(df, ["class"], "p", "r")
    assert r.count() == 3000
    assert r.filter("class = 'hot'").select("r").distinct().head()["r"] == pytest.approx(1001 / 2000)
    q = rank.quantiles(df, ["class"], "p", {"m": 0.5}).filter("class = 'hot'").head()
    assert q["m"] == 0.0


def test_hard_pairs_prune_is_exact(spark):
    import random
    rnd = random.Random(3)
    rows = [(r, f"c{i:02d}", "T", round(rnd.random(), 1), int(rnd.random() < .4)) for r in range(6) for i in range(12)]
    df = spark.createDataFrame(rows, "row int, class string, taxon string, p double, y int")
    got = {(r["row"], r["pos"], r["neg"]) for r in pairs.hard_pairs(df, ["row"], "p", 0.2, 5).collect()}
    want = set()
    for r in range(6):
        pos = sorted((p, c) for rr, c, _, p, y in rows if rr == r and y == 1)
        neg = sorted((-p, c) for rr, c, _, p, y in rows if rr == r and y == 0)
        alls = sorted((-(-n[0] - p[0]), i, j, p[1], n[1]) for i, p in enumerate(pos) for j, n in enumerate(neg)
                      if -n[0] - p[0] > -0.2)
        want |= {(r, a[3], a[4]) for a in alls[:5]}
    assert got == want


def test_sampling_invariants(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
        (F.col("id") % 7).cast("string")).alias("b"), (F.col("id") % 5 + 1.0).alias("w"))
    q = sampling.quota_sample(df, "b", "id", 80)
    sizes = {r["b"]: r["count"] for r in q.groupBy("b").count().collect()}
    assert sum(sizes.values()) == 80 and min(sizes.values()) >= 10 and len(sizes) == 8
    h = sampling.class_holdout(df, "b", "id").groupBy("b").agg(F.count_if("is_holdout").alias("k"), F.count("*").alias("n"))
    assert all(r["k"] == math.floor(r["n"] * .2) for r in h.collect())
    g = sampling.group_folds(df, "b", 3).groupBy("b").agg(F.count_distinct("fold").alias("k"))
    assert all(r["k"] == 1 for r in g.collect())
    p = rank.positions(df, "b", "id", "pos").groupBy("b").agg(
        F.count_distinct("pos").alias("d"), F.max("pos").alias("m"), F.count("*").alias("n")).collect()
    assert all(r["d"] == r["m"] == r["n"] for r in p)
    d = sampling.weighted_draws(df, "id", "w", 3000, per_bucket=100)
    assert d.count() == 3000
    assert d.agg(F.avg("w")).head()[0] == pytest.approx(11 / 3, abs=.15)


def test_cross_site_pool(spark):
    files = spark.range(200).select(F.concat(F.lit("f"), "id").alias("file_id"),
                                    F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("site"))
    out = sampling.cross_site_pool(files, files.limit(0)).collect()
    assert len(out) == 200 and all(r["site"] != r["background_site"] for r in out)
