"""Incremental audit lines of lever grids against lines from whole copies of the cells."""
import json
import random

import pytest
from pyspark.sql import functions as F

from dawnscore.operators import audit, encode, lever_grid

FIELDS = "file_id string, win int, class string, taxon string, y int, p double, b double, c double"


def cells(spark, n=6, seed=3):
    rnd = random.Random(seed)
    rows = [(f"f{i}", w, f"k{k}", ("Aves", "Insecta")[k % 2], int(rnd.random() < .3),
             round(rnd.random(), 1), round(rnd.random(), 1), round(rnd.random(), 1))
            for i in range(n) for w in range(3) for k in range(4)]
    rows += [("flat", 0, f"k{k}", ("Aves", "Insecta")[k % 2], 0, .9, .9, .9) for k in range(4)]
    rows.append(("f0", 0, "k9", "Aves", 0, .2, .9, .9))    # a class without positives, moved by the rescue
    return spark.createDataFrame(rows, FIELDS)


def candidate(s):
    return F.round(lever_grid.lever(F.col("p"), F.col("p"), F.col("b"), F.col("c"))(s), 9)


def test_grid_sizes():
    points = lever_grid.lever_points()
    assert [sum(p["family"] == f for p in points) for f in ("reference", "rescue", "suppress", "both", "single")] == [
        1, 24, 24, 16, 6]
    assert [p["point"] for p in points] == list(range(71)) and len(lever_grid.correction_points()) == 25


def test_changes_equal_whole_copies(spark):
    df = cells(spark)
    points = [p for p in lever_grid.lever_points() if p["point"] in (0, 3, 30, 60, 70)]
    got = {r["point"]: r for r in lever_grid.audit_grid(df, points, candidate, "p").collect()}
    assert sorted(got) == [p["point"] for p in points]
    assert sorted(r["place"] for r in got.values()) == list(range(1, len(points) + 1))
    for p in points:
        one = F.from_json(F.lit(json.dumps(p)),
                          "family string, low double, alpha_up double, delta_up double, high double, "
                          "alpha_down double, delta_down double")
        copy = df.withColumn("s", one).withColumn("cand", candidate(F.col("s")))
        want = audit.audit_rows(copy, [], "p", "cand").head()
        for name in ("macro", "macro_delta", "d_aves", "d_insecta", "sp_mean"):
            assert got[p["point"]][name] == pytest.approx(want[name], abs=1e-9), (p, name)
        assert (got[p["point"]]["verdict"], got[p["point"]]["n_classes"]) == (want["verdict"], want["n_classes"])
        assert got[p["point"]]["d_mammalia"] is None


def test_null_scores_and_empty_tables(spark):
    points = lever_grid.lever_points()[:3]
    none = lever_grid.audit_grid(spark.createDataFrame([], FIELDS), points, candidate, "p").collect()
    assert [(r["macro"], r["sp_mean"], r["verdict"]) for r in none] == [(None, None, "?")] * 3
    df = cells(spark)
    holes = df.unionByName(spark.createDataFrame([("h", 0, "k0", "Aves", 1, None, .9, .9)], FIELDS))
    a, b = (lever_grid.audit_grid(x, points, candidate, "p").orderBy("point").collect() for x in (df, holes))
    assert [r["macro"] for r in a] == pytest.approx([r["macro"] for r in b])


def test_class_a_list(spark):
    lines = spark.createDataFrame(
        [(0, "reference", "A", .9, .9), (1, "rescue", "A", .1, .5), (2, "rescue", "A", .3, .1), (3, "both", "B", .8, .8),
         (4, "both", "A", None, .4)],
        "point int, family string, verdict string, d_aves double, macro_delta double")
    assert [r["point"] for r in lever_grid.class_a(lines).orderBy("place").collect()] == [2, 1, 4]
    assert [r["point"] for r in lever_grid.class_a(lines, "macro_delta", 2).orderBy("place").collect()] == [1, 4]


def test_codes_are_dense_and_ordered(spark):
    rows = [(f"v{i:03d}",) for i in range(200) for _ in range(1 + i % 2)] + [(None,)]
    df = spark.createDataFrame(rows, "v string")
    got = {r["v"]: r["c"] for r in encode.index_values(df, "v", "c", start=1).collect()}
    assert got == {**{f"v{i:03d}": i + 1 for i in range(200)}, None: 0}
    assert {r["c"] for r in encode.index_values(df, "v", "c", start=1, cap=8).collect()} == set(range(9))


def test_cells_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch
    df = cells(spark)
    counted = df.mapInPandas(passed, df.schema)
    lines = lever_grid.audit_grid(counted, lever_grid.lever_points(), candidate, "p")
    assert len(lines.collect()) == 71 and len(lever_grid.class_a(lines).collect()) <= 10
    assert seen.value == df.count()


def test_order_and_ranks_of_odd_scores():
    import numpy as np
    import pyarrow as pa
    x = pa.array([None, -float("inf"), -2.0, -0.0, 0.0, 1e-300, 0.3, 0.7, 1.0, 5.0, float("inf"), float("nan"), None])
    o = lever_grid._ordered(x)
    assert (np.diff(o[:-1]) >= 0).all() and o[3] == o[4] and o[0] == o[-1] and len(set(o.tolist())) == 11
    assert (np.diff(lever_grid._places(o[1:-1])) >= 0).all()
    assert lever_grid._ranks(np.array([[3, 1, 3, 2], [5, 5, 5, 5]])).tolist() == [[3.5, 1, 3.5, 2], [2.5] * 4]
