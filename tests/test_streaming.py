"""Row-wise operators on a streaming DataFrame give the batch result."""
from pyspark.sql import functions as F

from dawnscore.functions import scalar as S
from dawnscore.operators import blend, levers, models, priors, pseudo


def project(df):
    a, b, c = F.col("pa"), F.col("pb"), F.col("pc")
    return df.select("id", blend.linear({"pa": .6, "pb": .4}).alias("lin"), blend.disagreement_pull(["pa", "pb", "pc"]).alias("pull"),
                     levers.miss_rescue(a, b, c).alias("resc"), priors.soft_gate(a, b).alias("gate"),
                     pseudo.tri_state_mask(F.col("y"), b).alias("mask"), S.temperature(a, F.lit(1.1)).alias("temp"),
                     models.apply_detector([("pa", .3, .2, 1.0, .1), ("pb", .3, .2, -1.0, .1)]).alias("det"))


def test_rowwise_on_a_stream(spark, tmp_path):
    rows = spark.range(40).select("id", *[(F.pmod(F.col("id") * k, F.lit(11)) / 11.0).alias(n) for n, k in
                                          (("pa", 3), ("pb", 5), ("pc", 7))], (F.col("id") % 2).cast("int").alias("y"))
    path = str(tmp_path / "in")
    rows.write.parquet(path)
    stream = project(spark.readStream.schema(rows.schema).parquet(path))
    q = (stream.writeStream.format("memory").queryName("rowwise_out").outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted(map(tuple, spark.table("rowwise_out").collect()))
    assert got == sorted(map(tuple, project(rows).collect())) and len(got) == 40
