"""Registered queries: sample arrays and training pairs."""
from pyspark.sql import functions as F

from dawnscore.functions import vec
from dawnscore.operators import arrays as A, pairs
from dawnscore.plans.registry import query
from dawnscore.plans.views import CLASSES, ROW

SEG = """seg AS (SELECT v.vec_id, w.w AS win, (w.w + 1) * 5 AS end_sec, k.k AS k, coalesce(x.x, 0) AS x
  FROM vecs v, range(12) w(w), range(6) k(k) LEFT JOIN vx x ON x.vec_id = v.vec_id AND x.i = w.w * 6 + k.k + 1)"""


def windows(v):
    return A.segment(v.vecs.select("vec_id", "emb"), "emb", 6)


@query("n01_segment", "vec_id:i win:i end_sec:i first:f total:f", SEG + """
--
SELECT vec_id, win, end_sec, max(CASE WHEN k = 0 THEN x END) AS first, sum(x) AS total FROM seg GROUP BY ALL""")
def _(v):
    return windows(v).select("vec_id", "win", "end_sec", F.col("window")[0].alias("first"),
                             vec.fold(F.col("window")).alias("total"))


@query("n02_sliding_chunks", "vec_id:i start:i total:f last:f", """
s AS (SELECT vec_id, greatest(vec_id % 65, 10) AS n FROM vecs),
st AS (SELECT vec_id, n, h * 16 AS start FROM s, range(4) t(h) WHERE h * 16 + 24 <= greatest(n, 24)),
e AS (SELECT st.*, j.j, x.x FROM st, range(24) j(j) JOIN vx x ON x.vec_id = st.vec_id AND x.i = (st.start + j.j) % st.n + 1)
--
SELECT vec_id, start, sum(x) AS total, max(CASE WHEN j = 23 THEN x END) AS last FROM e GROUP BY ALL""")
def _(v):
    n = F.greatest(F.col("vec_id") % 65, F.lit(10)).cast("int")
    d = v.vecs.select("vec_id", F.slice("emb", F.lit(1), n).alias("x"))
    c = A.sliding_chunks(d, "x", 24, 16)
    return c.select("vec_id", "start", vec.fold(F.transform("chunk", lambda x: x.cast("double"))).alias("total"),
                    F.element_at("chunk", -1).alias("last"))


@query("n03_silence", "vec_id:i db:f is_silent:b", """
r AS (SELECT vec_id, 20 * log10(greatest(sqrt(avg(pow(x * (vec_id % 5) * .01, 2))), 1e-12)) AS db FROM vx GROUP BY 1)
--
SELECT vec_id, db, db < -50 AS is_silent FROM r""")
def _(v):
    d = v.vecs.select("vec_id", F.transform("emb", lambda x: x.cast("double") * (F.col("vec_id") % 5) * .01).alias("x"))
    return d.select("vec_id", A.level_db(F.col("x")).alias("db"), A.is_silent(F.col("x")).alias("is_silent"))


RMS = SEG + """,
wr AS (SELECT vec_id, win, round(sqrt(avg(x * x)), 12) AS rms, max(abs(x)) AS peak FROM seg GROUP BY ALL)
--
"""


@query("n04_quiet_windows", "vec_id:i win:i rms:f", RMS + """
SELECT vec_id, win, rms FROM (SELECT * FROM wr WHERE rms > 1e-4 AND peak < .95)
QUALIFY rms <= CASE WHEN count(*) OVER (PARTITION BY vec_id) <= 3 THEN max(rms) OVER (PARTITION BY vec_id) ELSE quantile_cont(rms, .4) OVER (PARTITION BY vec_id) END""")
def _(v):
    return A.quiet_windows(windows(v), "vec_id")


@query("n04b_lowest_windows", "vec_id:i win:i rms:f place:i", RMS + """
SELECT vec_id, win, rms, row_number() OVER (PARTITION BY vec_id ORDER BY rms, win) AS place FROM wr QUALIFY place <= 2""")
def _(v):
    return A.lowest_windows(windows(v), "vec_id", 2)


@query("n04c_seeded_quiet_window", "vec_id:i win:i rms:f")
def _(v):
    return A.seeded_windows(A.quiet_windows(windows(v), "vec_id"), "vec_id", 1)


@query("n05_crops", "vec_id:i centre:f padded:f around:f", """
SELECT vec_id, sum(x) FILTER (WHERE i BETWEEN 23 AND 42) AS centre, sum(x) AS padded,
  sum(x) FILTER (WHERE i - 1 >= least(greatest((vec_id % 12) * 6 - 7, 0), 44) AND i - 1 < least(greatest((vec_id % 12) * 6 - 7, 0), 44) + 20) AS around
FROM vx GROUP BY 1""")
def _(v):
    d = v.vecs.select("vec_id", F.transform("emb", lambda x: x.cast("double")).alias("x"))
    x = F.col("x")
    return d.select("vec_id", vec.fold(A.centre_crop(x, 20)).alias("centre"), vec.fold(A.centre_crop(x, 80)).alias("padded"),
                    vec.fold(A.clip_around(x, (F.col("vec_id") % 12) * 6 + 3, 20)).alias("around"))


@query("n06_band_energies", "vec_id:i e_low:f e_mid:f e_high:f r_low:f r_mid:f r_high:f", """
b AS (SELECT vec_id, sum(CASE WHEN i <= 10 THEN abs(x) END) AS e_low, sum(CASE WHEN i BETWEEN 11 AND 40 THEN abs(x) END) AS e_mid, sum(CASE WHEN i > 40 THEN abs(x) END) AS e_high FROM vx GROUP BY 1)
--
SELECT *, e_low / (e_low + e_mid + e_high + 1e-9) AS r_low, e_mid / (e_low + e_mid + e_high + 1e-9) AS r_mid, e_high / (e_low + e_mid + e_high + 1e-9) AS r_high FROM b""")
def _(v):
    d = v.vecs.select("vec_id", F.transform("emb", lambda x: F.abs(x.cast("double"))).alias("s"))
    return A.band_ratios(d, "s", {"low": (0, 10), "mid": (10, 40), "high": (40, 64)})


@query("n07_mix_assembly", "vec_id:i mode:s lam:f label_share:f total:f")
def _(v):
    d = v.vecs.select("vec_id", "emb", F.when(F.col("class") < "c5", "Aves").otherwise("Insecta").alias("taxon"))
    m = A.assemble_mixes(d.filter("vec_id % 4 > 0"), d.filter("vec_id % 4 = 0"), "vec_id", "emb", "taxon")
    return m.withColumn("total", vec.fold(F.col("mixed")))


@query("n07b_series_mix", "file_no:i pair_key:i start:i length:i label_share:f total:f")
def _(v):
    files = v.vecs.groupBy("file_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("win", "emb"))), lambda e: e["emb"]).alias("windows"))
    m = A.mix_series(files, "file_no", "windows")
    return m.withColumn("total", vec.fold(F.flatten(F.transform("mixed", lambda w: F.transform(w, lambda x: x.cast("double"))))))


PAIRS = """pp AS (SELECT p.file_id, p.win, p.class AS pos, n.class AS neg, p.taxon AS pt, n.taxon AS nt, n.pb - p.pb AS gap, p.pb AS sp, n.pb AS sn FROM scores p JOIN scores n USING (file_id, win) WHERE p.y = 1 AND n.y = 0)
--
"""
PAIR_SPEC = "file_id:s win:i pos:s neg:s gap:f place:i"


@query("n08_hard_pairs", PAIR_SPEC, PAIRS + """
SELECT *, row_number() OVER (PARTITION BY file_id, win ORDER BY gap DESC, sp, pos, sn DESC, neg) AS place FROM pp WHERE gap > -.1 QUALIFY place <= 3""")
def _(v):
    return pairs.hard_pairs(v.scores, ROW, "pb", 0.1, 3)


@query("n08b_hard_pairs_targeted", PAIR_SPEC, PAIRS + """
SELECT *, row_number() OVER (PARTITION BY file_id, win ORDER BY gap DESC, sp, pos, sn DESC, neg) AS place FROM pp WHERE gap > -.1 AND pt <> 'Aves' AND pt <> nt QUALIFY place <= 3""")
def _(v):
    return pairs.hard_pairs(v.scores, ROW, "pb", 0.1, 3, F.col("taxon") != "Aves", "cross")


@query("n09_preference_pairs", "file_id:s win:i preferred:s rejected:s", """
SELECT p.file_id, p.win, p.class AS preferred, r.class AS rejected FROM scores p JOIN scores r USING (file_id, win)
WHERE p.pb > .7 AND p.pa < .5 AND r.pb < .3 AND r.pa > .5""")
def _(v):
    return pairs.preference_pairs(v.scores, ROW, "pb", "pa", 0.7, 0.3)


@query("n10_hard_rows", "file_id:s win:i min_pos:f is_hard:b", """
SELECT file_id, win, min(CASE WHEN y = 1 THEN pb END) AS min_pos, coalesce(min(CASE WHEN y = 1 THEN pb END) < .3, false) AS is_hard FROM scores GROUP BY ALL""")
def _(v):
    return pairs.hard_rows(v.scores, ROW, "pb")


@query("n11_quality_filter", "file_id:s win:i top:f", """
SELECT file_id, win, max(pa) AS top FROM scores GROUP BY ALL HAVING max(pa) < .4""")
def _(v):
    return pairs.quality_filter(v.scores, ROW, "pa", 0.4)
