"""Registered queries: scans, sinks and contracts."""
from pyspark.sql import functions as F

from dawnscore.operators import align, blend, rank, vectors
from dawnscore.plans.registry import query
from dawnscore.plans.views import CLASSES, ROW
from dawnscore.sources import tables as S


@query("a01_metadata_scan", "primary_label:s collection:s rating:f filename:s latitude:f", """
SELECT CAST(rec_id % 97 AS VARCHAR) AS primary_label, collection, rating, filename, lat AS latitude FROM recs""")
def _(v):
    rows = v.recs.select((F.col("rec_id") % 97).cast("string").alias("primary_label"),
                         F.col("secondary").alias("secondary_labels"), F.col("lat").alias("latitude"),
                         F.col("lon").alias("longitude"), F.col("grp").alias("class_name"), "collection",
                         "rating", "filename")
    path = S.write_csv(rows, S.scratch(v.spark, "recordings"))
    return S.read_csv(v.spark, path, S.RECORDINGS)


@query("a02_columnar_scan", "row_id:s site:s hour:i", "SELECT DISTINCT row_id, site, hour FROM scores WHERE site = 'S03'")
def _(v):
    rows = v.scores.filter("class = 'click'").select("row_id", "file_id", "site", "hour")
    path = S.write_table(rows, S.scratch(v.spark, "windows"))
    return S.read_columns(v.spark, path, ["row_id", "site", "hour"], F.col("site") == "S03")


@query("a03_matrix_to_long", "row_id:s class:s model:s p:f", "SELECT row_id, class, 'A' AS model, pa AS p FROM scores")
def _(v):
    arr = F.transform(F.array_sort(F.collect_list(F.struct("class", "pa"))), lambda e: e["pa"])
    m = v.scores.groupBy(*ROW, "row_id").agg(arr.alias("scores"))
    return S.matrix_to_long(m, ["row_id"], "scores", sorted(CLASSES), "A")


@query("a04_recording_listing", "filename:s length:i")
def _(v):
    return S.list_recordings(v.spark, v.dir, ["parquet"])


@query("a05_wide_sink", "row_id:s click:f error:f purchase:f signup:f view:f", """
SELECT row_id, max(CASE WHEN class = 'click' THEN pa END)::FLOAT AS click, max(CASE WHEN class = 'error' THEN pa END)::FLOAT AS error,
  max(CASE WHEN class = 'purchase' THEN pa END)::FLOAT AS purchase, max(CASE WHEN class = 'signup' THEN pa END)::FLOAT AS signup,
  max(CASE WHEN class = 'view' THEN pa END)::FLOAT AS view FROM scores GROUP BY 1""")
def _(v):
    wide = S.wide_scores(v.scores, CLASSES, score="pa")
    path = S.write_csv(wide, S.scratch(v.spark, "wide"))
    return v.spark.read.csv(path, header=True, schema=wide.schema)


@query("a06_output_contract", "n_files:i n_nan:i n_out_of_range:i n_bad_files:i n_short_rows:i", """
r AS (SELECT user_id, win, count(*) AS k FROM (SELECT DISTINCT substr(file_id, 2) AS user_id, win, class FROM cells) GROUP BY ALL)
--
SELECT (SELECT count(DISTINCT file_id) FROM cells) AS n_files, 0 AS n_nan, (SELECT count(*) FROM cells WHERE cents > 40000) AS n_out_of_range,
  (SELECT count(*) FROM (SELECT user_id FROM r GROUP BY 1 HAVING count(*) <> 12)) AS n_bad_files, (SELECT count(*) FROM r WHERE k <> 5) AS n_short_rows""")
def _(v):
    return S.contract_violations(v.cells.withColumn("p", F.col("cents") / 40000), 12, 5)


@query("a07_pseudo_sink", "filename:s start_s:i end_s:i primary_label:s pa:f pb:f pc:f", """
SELECT file_id || '.ogg' AS filename, end_sec - 5 AS start_s, end_sec AS end_s, class AS primary_label, pa, pb, pc FROM scores WHERE pa > .3 AND pb > .2""")
def _(v):
    rows = S.pseudo_rows(v.scores, (F.col("pa") > .3) & (F.col("pb") > .2), ["pa", "pb", "pc"])
    path = S.write_table(rows, S.scratch(v.spark, "pseudo"))
    return v.spark.read.parquet(path).withColumnsRenamed({"start": "start_s", "end": "end_s"})


@query("a08_observation_ingest", "species:s sound_key:s ext:s", """
s AS (SELECT event_id AS obs_id, event_type AS species, j AS sound_id, CASE (event_id + j) % 4 WHEN 0 THEN 'mp3' WHEN 1 THEN 'ogg' WHEN 2 THEN 'txt' ELSE 'wav' END AS ext
  FROM events, range(2) t(j) WHERE event_id % 10 <> 0)
--
SELECT species, obs_id || '_' || sound_id AS sound_key, ext FROM s WHERE ext <> 'txt' QUALIFY row_number() OVER (PARTITION BY species ORDER BY obs_id, sound_id) <= 500""")
def _(v):
    e = F.col("event_id")

    def sound(j):
        ext = F.element_at(F.array(*[F.lit(x) for x in ("mp3", "OGG", "txt", "wav")]), ((e + j) % 4 + 1).cast("int"))
        scheme = F.when(e % 10 == 0, "http").otherwise("https")
        url = F.concat(scheme, F.lit("://host.example/a.b/"), e.cast("string"), F.lit("."), ext, F.lit("?v=1.5"))
        return F.struct(F.lit(j).alias("id"), url.alias("file_url"), F.lit("cc0").alias("license_code"))

    docs = v.table("events").select(F.to_json(F.struct(
        e.alias("id"), F.col("event_type").alias("species"),
        F.array(*[sound(j) for j in range(3)]).alias("sounds"))).alias("value"))
    path = S.scratch(v.spark, "observations")
    docs.write.text(path)
    return S.observation_sounds(v.spark.read.json(path, schema=S.OBSERVATIONS), 500)


@query("a09_artifact_tables", "class:s mean:f std:f n:i", """
SELECT class, avg(pa) AS mean, stddev_pop(pa) AS std, count(*) AS n FROM scores WHERE fold <> 0 GROUP BY 1""")
def _(v):
    fit = v.scores.filter("fold <> 0").groupBy("class").agg(
        F.avg("pa").alias("mean"), F.stddev_pop("pa").alias("std"), F.count(F.lit(1)).alias("n"))
    return S.save_artifact(fit, S.scratch(v.spark, "class-stats"))


@query("a09b_rank_artifact", "class:s p:f cdf:f", """
SELECT DISTINCT class, pa AS p, (rank() OVER (PARTITION BY class ORDER BY pa) - 1) / count(*) OVER (PARTITION BY class) AS cdf FROM scores WHERE fold <> 0""")
def _(v):
    c = rank.running_counts(v.scores.filter("fold <> 0"), ["class"], "pa")
    table = c.select("class", F.col("pa").alias("p"), (F.col("n_below") / F.col("n_total")).alias("cdf"))
    return S.save_artifact(table, S.scratch(v.spark, "rank-quantiles"))


@query("a09c_centroid_artifact", "class:s n:i dims:i", "SELECT class, count(*) AS n, max(len(embedding)) AS dims FROM vecs GROUP BY 1")
def _(v):
    c = vectors.centroids(v.vecs, ["class"])
    return S.save_artifact(c, S.scratch(v.spark, "centroids")).withColumn("dims", F.size("centroid"))
