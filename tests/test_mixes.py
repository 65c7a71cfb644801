"""Mix assembly: share distribution, partners over the whole table, series form."""
import math

from pyspark.sql import functions as F

from dawnscore.operators import arrays


def samples(spark, n, taxon="Insecta"):
    return spark.range(n).select("id", F.array(F.col("id").cast("double"), F.lit(1.0)).alias("s"), F.lit(taxon).alias("taxon"))


def test_pair_share_is_the_arcsine_law(spark):
    got = [r.lam for r in arrays.assemble_mixes(samples(spark, 20_000), samples(spark, 0), "id", "s", "taxon", p_pair=1.0).collect()]
    assert all(0.5 <= x <= 1 for x in got)
    for q in (0.55, 0.7, 0.85, 0.97):   # P(max(b, 1 - b) <= q) for Beta(1/2, 1/2)
        want = 1 - 2 * (2 / math.pi) * math.asin(math.sqrt(1 - q))
        assert abs(sum(x <= q for x in got) / len(got) - want) < 0.012


def test_every_background_and_partner_can_be_drawn(spark):
    out = arrays.assemble_mixes(samples(spark, 3000), samples(spark, 40), "id", "s", "taxon", p_other=0.5, p_pair=1.0).collect()
    assert {r.bg_key for r in out if r["mode"] == "background"} == set(range(40))
    pairs = [r for r in out if r["mode"] == "pair"]
    assert len({r.pair_key for r in pairs}) > 0.55 * len(pairs) and all(r.pair_key != r.id for r in pairs)
    assert len(out) == 3000 and abs(len(pairs) - 1500) < 150 and not any(r["mode"] == "plain" for r in out)
    for r in pairs:
        assert abs(r.mixed[0] - (r.lam * r.id + (1 - r.lam) * r.pair_key)) < 1e-9 and r.label_share == r.lam
    few = arrays.assemble_mixes(samples(spark, 400), samples(spark, 1), "id", "s", "taxon", p_other=1.0).collect()
    assert all(r["mode"] == "background" and r.bg_key == 0 and r.label_share == 1 for r in few)
    assert [r["mode"] for r in arrays.assemble_mixes(samples(spark, 1), samples(spark, 0), "id", "s", "taxon", p_pair=1.0).collect()] == ["plain"]


def test_series_form_swaps_runs(spark):
    files = spark.range(600).select("id", F.transform(F.sequence(F.lit(0), (F.col("id") % 5 + 3).cast("int")),
                                                      lambda i: F.array(F.col("id"), i.cast("long"))).alias("w"))
    out = arrays.mix_series(files, "id", "w", p_swap=0.8).collect()
    assert len(out) == 600 and 0.7 < sum(r.pair_key is not None for r in out) / 600 < 0.9
    for r in out:
        n = r.id % 5 + 4
        assert len(r.mixed) == n
        taken = [k for k, x in enumerate(r.mixed) if x[0] != r.id]
        assert all(list(r.mixed[k]) == [r.pair_key if k in taken else r.id, k] for k in range(n))
        assert abs(r.label_share - (1 - len(taken) / n)) < 1e-12
        if r.pair_key is not None:
            m = r.pair_key % 5 + 4
            assert taken == [k for k in range(r.start, r.start + r.length) if k < m] and r.length <= n / 2 + 0.5
    assert arrays.mix_series(files.limit(0), "id", "w").count() == 0
