"""Registered queries: grouped profiles."""
from pyspark.sql import functions as F

from dawnscore.functions import keys as K
from dawnscore.operators import profile as P
from dawnscore.plans.registry import query
from dawnscore.plans.views import CLASSES, ROW, SERIES

SEG_TAGS = """seg_tags AS (SELECT DISTINCT filename, end_sec, trim(unnest(string_split(primary_label, ';'))) AS label FROM segs),
seg_sets AS (SELECT filename, end_sec, string_agg(label, '|' ORDER BY label) AS lbls, count(*) AS k
  FROM seg_tags WHERE label <> '' GROUP BY ALL)
--
"""


def seg_sets(v):
    return P.segment_labels(v.segs, ["filename", "end_sec"])


@query("d01_segment_labels", "filename:s end_sec:i lbls:s", SEG_TAGS + "SELECT * FROM seg_sets")
def _(v):
    return seg_sets(v).withColumn("lbls", F.array_join("lbls", "|"))


@query("d02_multi_hot", "filename:s end_sec:i class:s y:i", SEG_TAGS + """
SELECT s.filename, s.end_sec, t.class, (EXISTS (SELECT 1 FROM seg_tags g WHERE g.filename = s.filename
  AND g.end_sec = s.end_sec AND g.label = t.class))::INT AS y
FROM seg_sets s, tax t WHERE t.class <> 'view'""")
def _(v):
    return P.multi_hot(seg_sets(v), "lbls", [c for c in CLASSES if c != "view"])


@query("d03_full_files", "filename:s end_sec:i is_full:b", SEG_TAGS + """
SELECT filename, end_sec, count(*) OVER (PARTITION BY filename) = 12 AS is_full FROM seg_sets""")
def _(v):
    return P.flag_full_files(seg_sets(v), "filename")


@query("d04_taxon_any", "file_id:s win:i taxon:s y_any:i", """
SELECT file_id, win, CASE WHEN taxon = 'Reptilia' THEN 'Aves' ELSE taxon END AS taxon, max(y) AS y_any FROM scores GROUP BY ALL""")
def _(v):
    s = v.scores.withColumn("taxon", F.when(F.col("taxon") == "Reptilia", "Aves")
                            .otherwise(F.col("taxon")))
    return P.taxon_any(s, ROW)


@query("d05_file_stats", "file_id:s class:s f_max:f f_mean:f f_std:f f_q85:f uniformity:f", """
SELECT file_id, class, max(pa) AS f_max, avg(pa) AS f_mean, stddev_pop(pa) AS f_std,
  quantile_cont(pa, 0.85) AS f_q85, 1 - stddev_pop(pa) / (avg(pa) + 1e-6) AS uniformity FROM scores GROUP BY ALL""")
def _(v):
    return P.file_stats(v.scores, SERIES, "pa")


@query("d06_taxonomy_breakdown", "grp:s n_items:i n_rows:i mean:f median:f min_k:i max_k:i std:f", """
SELECT grp, count(*) AS n_items, sum(k) AS n_rows, avg(k) AS mean, median(k) AS median, min(k) AS min_k,
  max(k) AS max_k, stddev_samp(k) AS std FROM (SELECT grp, label, count(*) AS k FROM recs GROUP BY ALL) GROUP BY grp""")
def _(v):
    return P.describe_counts(v.recs, "grp", "label")


@query("d07_label_count_histogram", "n_labels:i n_rows:i", SEG_TAGS + """
SELECT k AS n_labels, count(*) AS n_rows FROM seg_sets GROUP BY 1""")
def _(v):
    return P.list_size_histogram(seg_sets(v), "lbls")


@query("d08_label_frequency", "class:s taxon:s n_rows:i", SEG_TAGS + """
SELECT label AS class, coalesce(taxon, 'Aves') AS taxon, count(*) AS n_rows FROM seg_tags LEFT JOIN tax ON tax.class = label
WHERE label <> '' GROUP BY ALL ORDER BY n_rows DESC, label LIMIT 30""")
def _(v):
    return P.label_frequency(seg_sets(v), "lbls", v.tax)


@query("d09_crosstab", "label:s F:i O:i P:i", """
SELECT label, count(*) FILTER (WHERE collection = 'F') AS "F", count(*) FILTER (WHERE collection = 'O') AS "O",
  count(*) FILTER (WHERE collection = 'P') AS "P" FROM recs GROUP BY 1""")
def _(v):
    return P.crosstab(v.recs, "label", "collection", ["F", "O", "P"])


@query("d10_rating_profile",
       "collection:s n_rows:i mean:f std:f min_v:f max_v:f q25:f median:f q75:f", """
SELECT collection, count(*) AS n_rows, avg(rating) AS mean, stddev_samp(rating) AS std, min(rating) AS min_v,
  max(rating) AS max_v, quantile_cont(rating, .25) AS q25, median(rating) AS median, quantile_cont(rating, .75) AS q75
FROM recs GROUP BY 1""")
def _(v):
    return P.numeric_profile(v.recs, "collection", "rating")


@query("d10b_rating_counts", "rating:f n:i", "SELECT rating, count(*) AS n FROM recs GROUP BY 1")
def _(v):
    return v.recs.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


@query("d11_sites_per_class", "class:s n_sites:i site_band:s n_scored:i", """
SELECT class, count(DISTINCT CASE WHEN y = 1 THEN site END) AS n_sites,
  CASE WHEN count(DISTINCT CASE WHEN y = 1 THEN site END) >= 3 THEN '3+'
    ELSE CAST(count(DISTINCT CASE WHEN y = 1 THEN site END) AS VARCHAR) END AS site_band,
  count(DISTINCT CASE WHEN pa > 0.95 THEN site END) AS n_scored
FROM scores GROUP BY 1""")
def _(v):
    a = P.site_counts(v.scores, F.col("y") == 1)
    b = P.site_counts(v.scores, F.col("pa") > 0.95).select("class", F.col("n_sites").alias("n_scored"))
    return a.join(b, "class")


@query("d11b_site_band_by_taxon", "site_band:s Aves:i Amphibia:i Insecta:i", """
SELECT CASE WHEN k >= 3 THEN '3+' ELSE CAST(k AS VARCHAR) END AS site_band, count(*) FILTER (WHERE grp < 'NATION_15') AS "Aves",
  count(*) FILTER (WHERE grp BETWEEN 'NATION_15' AND 'NATION_2') AS "Amphibia", count(*) FILTER (WHERE grp > 'NATION_2') AS "Insecta"
FROM (SELECT grp, count(DISTINCT CASE WHEN rating > 4.8 THEN label END) AS k FROM recs GROUP BY 1) GROUP BY 1""")
def _(v):
    k = P.site_counts(v.recs, F.col("rating") > 4.8, "grp", "label")
    g = F.col("grp")
    k = k.withColumn("taxon", F.when(g < "NATION_15", "Aves").when(g <= "NATION_2", "Amphibia")
                     .otherwise("Insecta"))
    return P.crosstab(k, "site_band", "taxon", ["Aves", "Amphibia", "Insecta"])


@query("d12_site_concentration", "class:s n_pos:i max_share:f top_site:s", """
SELECT class, sum(k) AS n_pos, max(k) / sum(k) AS max_share, arg_max(site, (k, site)) AS top_site
FROM (SELECT class, site, count(*) AS k FROM scores WHERE y = 1 GROUP BY ALL) GROUP BY 1""")
def _(v):
    return P.site_concentration(v.scores.filter("y = 1"))


@query("d13_simpson", "class:s simpson:f", """
SELECT class, 1 - sum(pow(k / tot, 2)) AS simpson FROM (SELECT class, k, sum(k) OVER (PARTITION BY class) AS tot FROM
  (SELECT class, site, count(*) AS k FROM scores WHERE y = 1 GROUP BY class, site)) GROUP BY 1""")
def _(v):
    return P.simpson(v.scores.filter("y = 1"), "class", "site")


HOURS = """hour_p AS (SELECT class, hour, count(*) / (sum(count(*)) OVER (PARTITION BY class) + 1e-6) AS hour_share
  FROM scores WHERE y = 1 GROUP BY class, hour)
--
"""


@query("d14_hour_profile", "class:s hour:i hour_share:f", HOURS + "SELECT * FROM hour_p")
def _(v):
    return P.hour_profile(v.scores.filter("y = 1"))


@query("d14b_hour_match", "row_id:s class:s hour_share:f", HOURS + """
SELECT row_id, s.class, coalesce(hour_share, 0) AS hour_share FROM scores s LEFT JOIN hour_p h
  ON h.class = s.class AND h.hour = s.hour""")
def _(v):
    return P.hour_match(v.scores, P.hour_profile(v.scores.filter("y = 1")))


@query("d15_saturation", "class:s hot_share:f is_saturating:b", """
SELECT class, avg((pa > 0.4)::INT) AS hot_share, avg((pa > 0.4)::INT) > 0.3 AS is_saturating FROM scores GROUP BY 1""")
def _(v):
    return P.saturation(v.scores, "pa", 0.4, 0.3)


@query("d15b_label_saturation", "class:s n_pos:i pos_share:f", """
SELECT class, sum(y) AS n_pos, sum(y) / count(*) AS pos_share FROM scores GROUP BY 1 HAVING sum(y) / count(*) > 0.29""")
def _(v):
    return P.label_saturation(v.scores, 0.29)


@query("d16_over_present", "file_id:s class:s n_fired:i", """
SELECT file_id, class, count(*) AS n_fired FROM scores WHERE pa > 0.2 GROUP BY ALL HAVING count(*) > 8""")
def _(v):
    return P.over_present(v.scores, SERIES, F.col("pa") > 0.2)


@query("d17_single_window", "file_id:s class:s taxon:s n_fired:i", """
SELECT file_id, class, taxon, count(*) AS n_fired FROM scores WHERE pa > 0.6 GROUP BY ALL HAVING count(*) = 1""")
def _(v):
    return P.single_window(v.scores, [*SERIES, "taxon"], F.col("pa") > 0.6)


@query("d18_group_members", "file_id:s win:i n_members:i has_all:b", """
SELECT file_id, win, count(*) FILTER (WHERE y = 1 AND class IN ('click', 'error', 'view')) AS n_members,
  count(*) FILTER (WHERE y = 1 AND class IN ('click', 'error', 'view')) = 3 AS has_all FROM scores GROUP BY ALL""")
def _(v):
    return P.group_members(v.scores, ROW, ["click", "error", "view"])


@query("d19_conflict_rows", "file_id:s win:i n_group:i n_other:i", """
SELECT * FROM (SELECT file_id, win, sum(y) FILTER (WHERE class IN ('click', 'error', 'view')) AS n_group,
  sum(y) FILTER (WHERE class = 'signup') AS n_other FROM scores GROUP BY ALL) WHERE n_group >= 2 AND n_other >= 1""")
def _(v):
    return P.conflict_rows(v.scores, ROW, ["click", "error", "view"], ["signup"], 2)


@query("d20_cluster_cofiring", "file_id:s win:i n_hot:i", """
SELECT file_id, win, count(*) AS n_hot FROM scores WHERE pa > 0.2 AND class IN ('click', 'error', 'view', 'signup')
GROUP BY ALL HAVING count(*) >= 3""")
def _(v):
    return P.cluster_cofiring(v.scores, ROW, ["click", "error", "view", "signup"], "pa", 0.2)


@query("d21_aliveness", "class:s p_max:f p_std:f p_range:f p95:f p99:f state:s", """
SELECT *, CASE WHEN p99 < 0.1 THEN 'dead' WHEN p99 < 0.3 THEN 'semi' ELSE 'alive' END AS state FROM (
  SELECT class, max(pa) AS p_max, stddev_pop(pa) AS p_std, max(pa) - min(pa) AS p_range,
    quantile_cont(pa, .95) AS p95, quantile_cont(pa, .99) AS p99 FROM scores GROUP BY 1)""")
def _(v):
    return P.aliveness(v.scores, "pa")


ENTROPY = """binned AS (SELECT {key}, least(floor(pa * 20), 19) AS b, count(*) AS k FROM scores GROUP BY ALL),
shares AS (SELECT {key}, k / sum(k) OVER (PARTITION BY {key}) AS q FROM binned)
--
SELECT {key}, -sum(q * log2(q)) AS entropy FROM shares GROUP BY ALL"""


@query("d22_class_entropy", "class:s entropy:f", ENTROPY.format(key="class"))
def _(v):
    return P.histogram_entropy(v.scores, ["class"], "pa")


@query("d22b_row_entropy", "file_id:s win:i entropy:f", ENTROPY.format(key="file_id, win"))
def _(v):
    return P.histogram_entropy(v.scores, ROW, "pa")


@query("d23_volatility", "class:s volatility:f n_files:i", """
SELECT class, avg(s) AS volatility, count(*) AS n_files FROM (SELECT file_id, class, stddev_pop(pa) AS s, count(*) AS k
  FROM scores WHERE n > 0 GROUP BY ALL) WHERE k >= 3 GROUP BY 1""")
def _(v):
    return P.volatility(v.scores.filter("n > 0"), "pa")


@query("d24_score_shares", "class:s s0:f s1:f s2:f s3:f s4:f s5:f undecided:f", """
SELECT class, avg((pb < .1)::INT) AS s0, avg((pb >= .1 AND pb < .3)::INT) AS s1, avg((pb >= .3 AND pb < .5)::INT) AS s2,
  avg((pb >= .5 AND pb < .7)::INT) AS s3, avg((pb >= .7 AND pb < .9)::INT) AS s4, avg((pb >= .9)::INT) AS s5,
  avg((pb >= .45 AND pb < .55)::INT) AS undecided FROM scores GROUP BY 1""")
def _(v):
    return P.score_shares(v.scores, ["class"], "pb")


@query("d25_frequency_weights", "class:s weight:f", """
SELECT class, w / avg(w) OVER () AS weight FROM (SELECT class,
  least(greatest(1 / sqrt((sum(y) FILTER (WHERE hour % (length(class) + 1) = 0) + 1) / count(*)), 1), 10) AS w FROM scores GROUP BY 1)""")
def _(v):
    y = F.when(F.col("hour") % (F.length("class") + 1) == 0, F.col("y")).otherwise(0)
    return P.frequency_weights(v.scores.withColumn("y", y))


@query("d26_transitions", "class:s p01:f p10:f", """
SELECT class, sum((q = 0 AND y = 1)::INT) / sum((q = 0)::INT) AS p01, sum((q = 1 AND y = 0)::INT) / sum((q = 1)::INT) AS p10
FROM (SELECT class, y, lag(y) OVER (PARTITION BY file_id, class ORDER BY win) AS q FROM scores) WHERE q IS NOT NULL GROUP BY 1""")
def _(v):
    return P.transitions(v.scores)


@query("d27_exclusive_sets", "class:s n_here:i n_else:i where_seen:s", """
SELECT *, CASE WHEN n_else = 0 THEN 'only_here' WHEN n_here = 0 THEN 'only_elsewhere' ELSE 'common' END AS where_seen
FROM (SELECT label AS class, count(*) FILTER (WHERE nation_id = 3 AND on_y) AS n_here, count(*) FILTER (WHERE nation_id <> 3 AND on_y) AS n_else
  FROM (SELECT rec_id % 60 AS label, nation_id, rating > 4.8 AS on_y FROM recs) GROUP BY 1) WHERE n_here + n_else > 0""")
def _(v):
    lab = v.recs.select((F.col("rec_id") % 60).alias("class"), F.col("nation_id").alias("site"),
                        (F.col("rating") > 4.8).cast("int").alias("y"))
    return P.exclusive_sets(lab, 3)


@query("d28_file_level", "file_id:s class:s pa:f y:i", """
SELECT file_id, class, max(pa) AS pa, max(y) AS y FROM scores GROUP BY ALL""")
def _(v):
    return P.file_level(v.scores, SERIES, "pa")


@query("d29_rare_reweight", "event_id:i weight:f", """
SELECT event_id, CASE WHEN k < 60 THEN 5.0 ELSE 1.0 END AS weight FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id) AS k FROM events)""")
def _(v):
    chunks = v.table("events").select("event_id", "user_id", F.lit(1.0).alias("weight"))
    return P.rare_reweight(chunks, v.table("events"), "user_id", 60, 5.0)
