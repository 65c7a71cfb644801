"""Registered queries: scalar functions and projections."""
from pyspark.sql import Window
from pyspark.sql import functions as F

from dawnscore.functions import keys as K
from dawnscore.functions import scalar as S
from dawnscore.operators import encode
from dawnscore.plans.registry import query

PAT = "'^[A-Za-z0-9]+_(Train|Test)_([0-9]+)_(S[0-9]+)_([0-9]{8})_([0-9]{6})'"


@query("b01_recording_name", "event_id:i split_name:s site:s hour:i day_no:i", f"""
SELECT event_id, nullif(regexp_extract(filename, {PAT}, 1), '') AS split_name,
  nullif(regexp_extract(filename, {PAT}, 3), '') AS site,
  coalesce(TRY_CAST(substr(nullif(regexp_extract(filename, {PAT}, 5), ''), 1, 2) AS INT), -1) AS hour,
  TRY_CAST(substr(nullif(regexp_extract(filename, {PAT}, 4), ''), 7, 2) AS INT) AS day_no
FROM names""")
def _(v):
    f = F.col("filename")
    return v.names.select("event_id", K.name_split(f).alias("split_name"),
                          K.name_site(f).alias("site"), K.name_hour(f).alias("hour"),
                          F.dayofmonth(K.name_timestamp(f)).alias("day_no"))


@query("b02_hms_to_seconds", "filename:s start_s:i end_s:i n:i", """
SELECT filename, start_s, end_s, count(*) AS n FROM (
  SELECT filename,
    CAST(split_part(start_t, ':', 1) AS INT) * 3600 + CAST(split_part(start_t, ':', 2) AS INT) * 60
      + CAST(split_part(start_t, ':', 3) AS INT) AS start_s,
    CAST(split_part(end_t, ':', 1) AS INT) * 3600 + CAST(split_part(end_t, ':', 2) AS INT) * 60
      + CAST(split_part(end_t, ':', 3) AS INT) AS end_s FROM segs)
GROUP BY ALL""")
def _(v):
    return (v.segs.select("filename", K.hms_to_seconds(F.col("start_t")).alias("start_s"),
                          K.hms_to_seconds(F.col("end_t")).alias("end_s"))
            .groupBy("filename", "start_s", "end_s").agg(F.count(F.lit(1)).alias("n")))


@query("b03_seconds_to_hms", "event_id:i hms:s", """
SELECT event_id, lpad(CAST(sec // 3600 AS VARCHAR), 2, '0') || ':' ||
  lpad(CAST(sec % 3600 // 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(sec % 60 AS VARCHAR), 2, '0') AS hms
FROM names""")
def _(v):
    return v.names.select("event_id", K.seconds_to_hms(F.col("sec")).alias("hms"))


@query("b04_row_key", "row_id:s n:i", """
SELECT replace(filename, '.ogg', '') || '_' || end_sec AS row_id, count(*) AS n FROM segs GROUP BY 1""")
def _(v):
    key = K.row_key(F.col("filename"), F.col("end_sec"))
    return v.segs.groupBy(key.alias("row_id")).agg(F.count(F.lit(1)).alias("n"))


@query("b05_row_key_split", "row_id:s class:s file_part:s end_part:i start_part:i", """
SELECT row_id, class, file_id AS file_part, end_sec AS end_part, end_sec - 5 AS start_part FROM scores""")
def _(v):
    r = F.col("row_id")
    end = K.row_key_end(r)
    return v.scores.select("row_id", "class", K.row_key_file(r).alias("file_part"),
                           end.alias("end_part"), (end - 5).alias("start_part"))


@query("b06_multi_label_split", "filename:s end_sec:i label:s n:i", """
SELECT filename, end_sec, label, count(*) AS n FROM (
  SELECT filename, end_sec, trim(unnest(string_split(primary_label, ';'))) AS label FROM segs)
WHERE label <> '' GROUP BY ALL""")
def _(v):
    return (v.segs.select("filename", "end_sec",
                          F.explode(K.split_labels(F.col("primary_label"))).alias("label"))
            .groupBy("filename", "end_sec", "label").agg(F.count(F.lit(1)).alias("n")))


@query("b07_list_literal", "rec_id:i n_items:i items:s", """
SELECT rec_id, CASE rec_id % 5 WHEN 0 THEN 0 WHEN 3 THEN 0 ELSE 2 END AS n_items,
  CASE rec_id % 5 WHEN 1 THEN grp || '|XX' WHEN 2 THEN grp || '|YY' WHEN 4 THEN label || '|' || grp
    ELSE '' END AS items FROM recs""")
def _(v):
    items = K.parse_list_literal(F.col("secondary"))
    return v.recs.select("rec_id", items.alias("i")).select(
        "rec_id", F.size("i").alias("n_items"), F.array_join("i", "|").alias("items"))


@query("b08_soft_target", "rec_id:i class:s weight:f", """
SELECT rec_id, class, coalesce(max(CASE WHEN role = 2 THEN 0.3 END), max(CASE WHEN role = 1 THEN 1.0 END)) AS weight
FROM (SELECT rec_id, label AS class, 1 AS role FROM recs
  UNION ALL SELECT rec_id, grp, 2 FROM recs WHERE rec_id % 5 IN (1, 2, 4)
  UNION ALL SELECT rec_id, label, 2 FROM recs WHERE rec_id % 5 = 4)
WHERE class IN (SELECT n_name FROM nation) OR class IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')
GROUP BY ALL""")
def _(v):
    known = [f"NATION_{i}" for i in range(25)] + ["1-URGENT", "2-HIGH", "3-MEDIUM",
                                                  "4-NOT SPECIFIED", "5-LOW"]
    return encode.soft_targets(v.recs, "rec_id", F.col("label"),
                               K.parse_list_literal(F.col("secondary")), known)


@query("b08_soft_target_shared", "rec_id:i class:s weight:f", """
SELECT rec_id, class, coalesce(max(CASE WHEN role = 2 THEN 0.25 END), max(CASE WHEN role = 1 THEN 1.0 END)) AS weight
FROM (SELECT rec_id, label AS class, 1 AS role FROM recs
  UNION ALL SELECT rec_id, grp, 2 FROM recs WHERE rec_id % 5 IN (1, 2, 4)
  UNION ALL SELECT rec_id, label, 2 FROM recs WHERE rec_id % 5 = 4)
WHERE class IN (SELECT n_name FROM nation) OR class IN ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')
GROUP BY ALL""")
def _(v):
    known = [f"NATION_{i}" for i in range(25)] + ["1-URGENT", "2-HIGH", "3-MEDIUM",
                                                  "4-NOT SPECIFIED", "5-LOW"]
    return encode.soft_targets(v.recs, "rec_id", F.col("label"),
                               K.parse_list_literal(F.col("secondary")), known,
                               secondary_weight=0.5, shared=True)


@query("b09_genus", "c_custkey:i genus:s", """
SELECT c_custkey, split_part(c_mktsegment || ' ' || c_name, ' ', 1) AS genus FROM customer""")
def _(v):
    name = F.concat_ws(" ", "c_mktsegment", "c_name")
    return v.table("customer").select("c_custkey", K.genus(name).alias("genus"))


@query("b10_geo_cell", "rec_id:i cell:s", """
SELECT rec_id, CASE WHEN lat IS NULL OR lon IS NULL THEN 'NA' ELSE
  CASE WHEN a >= 0 THEN '+' ELSE '' END || a || '_' || CASE WHEN o >= 0 THEN '+' ELSE '' END || o END AS cell
FROM (SELECT *, CAST(floor(lat / 10) * 10 AS INT) AS a, CAST(floor(lon / 10) * 10 AS INT) AS o FROM recs)""")
def _(v):
    return v.recs.select("rec_id", K.geo_cell(F.col("lat"), F.col("lon")).alias("cell"))


@query("b11_hour_bucket", "file_id:s b6:i b4:i", """
SELECT DISTINCT file_id, hour // 6 AS b6, hour // 4 AS b4 FROM scores""")
def _(v):
    h = F.col("hour")
    return v.scores.select("file_id", K.hour_bucket(h, 6).alias("b6"),
                           K.hour_bucket(h, 4).alias("b4")).distinct()


@query("b12_count_band", "grp:s label:s n:i band:s", """
SELECT grp, label, n, CASE WHEN n <= 0 THEN '0' WHEN n <= 10 THEN '1-10' WHEN n <= 50 THEN '11-50'
  WHEN n <= 200 THEN '51-200' ELSE '200+' END AS band
FROM (SELECT grp, label, count(*) FILTER (WHERE rec_id % 3 = 0) AS n FROM recs GROUP BY ALL)""")
def _(v):
    n = (v.recs.groupBy("grp", "label").agg(F.count_if(F.col("rec_id") % 3 == 0).alias("n")))
    return n.withColumn("band", K.count_band(F.col("n")))


@query("b13_chunk_id", "event_id:i start:f chunk:s", """
SELECT event_id, sec / 8.0 AS start, substr(sha1(filename || '_' || printf('%.3f', sec / 8.0)), 1, 8) AS chunk FROM names""")
def _(v):
    start = F.col("sec") / F.lit(8.0)
    return v.names.select("event_id", start.alias("start"),
                          K.chunk_id(F.col("filename"), start).alias("chunk"))


@query("b14_sigmoid_logit", "row_id:s class:s sg:f lg:f lg4:f sg20:f", """
SELECT row_id, class, 1 / (1 + exp(-least(greatest((pa - 0.5) * 80, -30), 30))) AS sg,
  ln(q / (1 - q)) AS lg, ln(q4 / (1 - q4)) AS lg4,
  1 / (1 + exp(-least(greatest((pb - 0.5) * 8, -20), 20))) AS sg20
FROM (SELECT *, least(greatest(pa, 1e-6), 1 - 1e-6) AS q, least(greatest(pb, 1e-4), 1 - 1e-4) AS q4 FROM scores)""")
def _(v):
    a, b = F.col("pa"), F.col("pb")
    return v.scores.select("row_id", "class", S.sigmoid((a - 0.5) * 80).alias("sg"),
                           S.logit(a).alias("lg"), S.logit(b, 1e-4).alias("lg4"),
                           S.sigmoid((b - 0.5) * 8, 20).alias("sg20"))


@query("b15_taxon_temperature", "row_id:s class:s p:f", """
SELECT row_id, class, 1 / (1 + exp(-ln(q / (1 - q)) / CASE WHEN taxon IN ('Amphibia', 'Insecta') THEN 0.95 ELSE 1.10 END)) AS p
FROM (SELECT *, least(greatest(pa, 1e-6), 1 - 1e-6) AS q FROM scores)""")
def _(v):
    t = S.taxon_temperature(F.col("taxon"))
    return v.scores.select("row_id", "class", S.temperature(F.col("pa"), t).alias("p"))


@query("b16_power_floor", "row_id:s class:s a:f b:f", """
SELECT row_id, class, CASE WHEN pa < 0.1 THEN 0 ELSE sqrt(pa) END AS a,
  CASE WHEN pb * pb < 0.1 THEN 0 ELSE pb * pb END AS b FROM scores""")
def _(v):
    return v.scores.select("row_id", "class", S.floor_then_power(F.col("pa")).alias("a"),
                           S.power_then_floor(F.col("pb"), 2.0).alias("b"))


@query("b17_threshold_sharpen", "row_id:s class:s p:f", """
SELECT row_id, s.class, least(greatest(CASE WHEN pa > t THEN 0.5 + 0.5 * (pa - t) / (1 - t) ELSE 0.5 * pa / t END, 0), 1) AS p
FROM scores s JOIN (SELECT class, 0.25 + 0.1 * (length(class) % 4) AS t FROM tax) USING (class)""")
def _(v):
    t = v.tax.select("class", (0.25 + 0.1 * (F.length("class") % 4)).alias("t"))
    return v.scores.join(t, "class").select(
        "row_id", "class", S.sharpen(F.col("pa"), F.col("t")).alias("p"))


@query("b18_min_rating", "rec_id:i rating:f weight:f", """
SELECT rec_id, rating, rating / 5 AS weight FROM recs WHERE rating >= 3""")
def _(v):
    return encode.rating_filter(v.recs, 3.0)


@query("b19_minmax_power", "row_id:s class:s p:f", """
SELECT row_id, class, CASE WHEN hi - lo < 1e-8 THEN pa ELSE pow((pa - lo) / (hi - lo), 0.4) * (hi - lo) + lo END AS p
FROM (SELECT *, min(pa) OVER (PARTITION BY class) AS lo, max(pa) OVER (PARTITION BY class) AS hi FROM scores)""")
def _(v):
    return encode.minmax_power(v.scores, "pa", 0.4).withColumnRenamed("pa_scaled", "p")


@query("b20_site_code", "vec_id:i code:s", """
SELECT vec_id, 'S' || lpad(CAST(site AS VARCHAR), 2, '0') AS code FROM vecs""")
def _(v):
    return v.vecs.select("vec_id", K.site_code(F.concat(F.lit("S"), F.col("site"))).alias("code"))


@query("b21_dictionary_encoding", "row_id:s class:s class_ix:i taxon_ix:i site_ix:i hour24:i", """
SELECT row_id, class, dense_rank() OVER (ORDER BY class) - 1 AS class_ix,
  dense_rank() OVER (ORDER BY taxon) - 1 AS taxon_ix,
  CASE WHEN dense_rank() OVER (ORDER BY site) <= 8 THEN dense_rank() OVER (ORDER BY site) ELSE 0 END AS site_ix,
  hour % 24 AS hour24 FROM scores""")
def _(v):
    df = encode.index_values(v.scores, "class", "class_ix")
    df = encode.index_values(df, "taxon", "taxon_ix")
    df = encode.index_values(df, "site", "site_ix", start=1, cap=8)
    return df.withColumn("hour24", F.col("hour") % 24)


@query("b22_context_features", "file_id:s win:i hour_frac:f site_s00:i site_s03:i site_s09:i", """
SELECT DISTINCT file_id, win, hour / 24.0 AS hour_frac, (site = 'S00')::INT AS site_s00,
  (site = 'S03')::INT AS site_s03, (site = 'S09')::INT AS site_s09 FROM scores""")
def _(v):
    rows = v.scores.filter(F.col("class") == "click")
    return encode.context_features(rows, ["S00", "S03", "S09"])
