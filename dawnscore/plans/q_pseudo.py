"""Registered queries: pseudo-label curation."""
from pyspark.sql import functions as F

from dawnscore.operators import align, metrics, profile, pseudo as P, rank, sampling, vectors
from dawnscore.plans.q_metrics import auc_sql
from dawnscore.plans.q_vectors import CENT5, sims5
from dawnscore.plans.registry import query
from dawnscore.plans.views import ROW, SERIES

CELL = "row_id:s class:s "
N1 = "count(*)"


def keep_j01():
    return (F.col("pa") > 0.15) & (F.col("pb") > 0.2) & (F.col("pc") > 0.03)


J01 = """j01 AS (SELECT *, row_number() OVER (PARTITION BY file_id, win ORDER BY pa DESC, class) AS place FROM scores
  WHERE pa > .15 AND pb > .2 AND pc > .03 QUALIFY place <= 2)"""


def j01(v):
    return P.agreement_top_k(v.scores, ROW, "pa", keep_j01(), 2)


@query("j01_agreement_top_k", CELL + "pa:f place:i", J01 + "\n--\nSELECT * FROM j01")
def _(v):
    return j01(v)


@query("j02_soft_labels", "file_id:s win:i max_prob:f n_pos:i weight:f", """
q AS (SELECT *, CASE WHEN pa < .1 THEN 0 ELSE sqrt(pa) END AS q FROM scores)
--
SELECT file_id, win, max(pa) AS max_prob, count(*) FILTER (WHERE q > 0) AS n_pos, sum(q) * max(0.5 + hour / 48.0) AS weight FROM q GROUP BY ALL
HAVING max(pa) >= .5 AND sum(q) >= .05""")
def _(v):
    return P.soft_labels(v.scores, ROW, "pa", confidence=0.5 + F.col("hour") / 48.0)


@query("j03_sharpness_weight", "file_id:s win:i sharp:f weight:f", """
q AS (SELECT *, CASE WHEN pa < .1 THEN 0 ELSE sqrt(pa) END AS q, row_number() OVER (PARTITION BY file_id, win ORDER BY pa DESC, class) AS k FROM scores),
r AS (SELECT file_id, win, max(pa) AS t1, max(CASE WHEN k = 2 THEN pa END) AS t2, sum(q) AS s FROM q GROUP BY ALL)
--
SELECT file_id, win, (t1 - t2) / (t1 + 1e-6) AS sharp, (t1 - t2) / (t1 + 1e-6) * s AS weight FROM r WHERE t1 >= .5 AND s >= .05""")
def _(v):
    return P.sharpness_weight(v.scores, ROW, "pa")


@query("j04_forensic_flags", CELL + "is_over_present:b is_saturating:b is_suspicious:b", """
e AS (SELECT * FROM scores WHERE pa > .2),
f AS (SELECT row_id, class, count(*) OVER (PARTITION BY file_id, class) > 8 AS is_over_present,
  count(*) OVER (PARTITION BY class) / (SELECT count(*) / 5 FROM scores) > .42 AS is_saturating FROM e)
--
SELECT *, is_over_present OR is_saturating AS is_suspicious FROM f""")
def _(v):
    n = v.scores.agg((F.count(F.lit(1)) / 5).alias("n_rows"))
    return P.forensic_flags(v.scores.filter("pa > 0.2"), n, .42, 8)


REFINE = """r0 AS (SELECT *, CASE WHEN class IN ('click', 'view') THEN 'x' WHEN class IN ('error', 'signup') THEN 'z' END AS cl,
  CASE WHEN class = 'purchase' THEN 'A' WHEN class = 'error' AND pa <= .3 THEN 'A2' ELSE 'kept' END AS s0 FROM (
    SELECT *, pa > .2 AS inp FROM scores)),
r1 AS (SELECT *, CASE WHEN NOT inp THEN 'out' ELSE s0 END AS s1 FROM r0),
r2 AS (SELECT *, CASE WHEN s1 = 'kept' AND cl IS NOT NULL AND count(*) FILTER (WHERE s1 = 'kept') OVER w > 1
  AND arg_max(class, (pa, class)) OVER w <> class THEN 'B' ELSE s1 END AS s2 FROM r1 WINDOW w AS (PARTITION BY file_id, win, cl)),
r3 AS (SELECT *, CASE WHEN s2 = 'kept' AND cl IS NOT NULL AND count(*) FILTER (WHERE s2 = 'kept') OVER (PARTITION BY file_id, class) > 5 THEN 'C' ELSE s2 END AS s3 FROM r2),
r4 AS (SELECT *, CASE WHEN s3 = 'kept' AND class = 'signup' THEN 'D' ELSE s3 END AS stage FROM r3 WHERE s3 <> 'out')
--
"""


def refined(v):
    return P.refine(v.scores, F.col("pa") > 0.2, "pa", ["purchase"], ["error"],
                    {"x": ["click", "view"], "z": ["error", "signup"]}, ["signup"], 0.3, 5)


@query("j05_refine", CELL + "stage:s", REFINE + "SELECT row_id, class, stage FROM r4")
def _(v):
    return refined(v)


@query("j05b_refine_counts", "stage:s dropped:i remaining:i", REFINE + """
SELECT t.stage, (SELECT count(*) FROM r4 WHERE r4.stage = t.stage) AS dropped, (SELECT count(*) FROM r4 WHERE r4.stage = 'kept' OR r4.stage > t.stage) AS remaining
FROM (VALUES ('A'), ('A2'), ('B'), ('C'), ('D')) t(stage)""")
def _(v):
    return P.stage_counts(refined(v))


SIMS = CENT5


@query("j06_verify_signals", CELL + "n_signals:i source:s", SIMS + """,
t AS (SELECT s.*, c.cos, (pb > .4)::INT + (pc > .1)::INT + coalesce((cos > .2)::INT, 0) AS n_signals FROM scores s
  LEFT JOIN sims c ON c.file_id = s.file_id AND c.win = s.win AND c.class = s.class)
--
SELECT row_id, class, n_signals, CASE WHEN pa > .3 AND n_signals >= 1 THEN 'verified' ELSE 'rare' END AS source FROM t
WHERE (pa > .3 AND n_signals >= 1) OR coalesce(cos > .3 AND taxon IN ('Mammalia', 'Insecta', 'Reptilia'), false)""")
def _(v):
    d = v.scores.join(sims5(v).drop("vec_id"), [*ROW, "class"], "left")
    cos = F.col("cos")
    return P.verify_signals(d, F.col("pa"), [F.col("pb") > .4, F.col("pc") > .1, cos > .2], cos,
                            F.col("taxon").isin("Mammalia", "Insecta", "Reptilia"), .3, .3)


@query("j07_acoustic_confirm", CELL + "pa:f", SIMS + """,
tk AS (SELECT * FROM sims QUALIFY row_number() OVER (PARTITION BY file_id, win ORDER BY round(cos, 9) DESC, class) <= 2)
--
SELECT row_id, class, pa FROM scores s WHERE pa > .2 AND EXISTS (SELECT 1 FROM tk WHERE tk.file_id = s.file_id AND tk.win = s.win AND tk.class = s.class)""")
def _(v):
    sims = sims5(v).withColumn("cos", F.round("cos", 9))
    return P.acoustic_confirm(v.scores.filter("pa > 0.2"), sims, ROW, 2)


SIG = """base AS (SELECT class, avg(pb) AS b FROM scores GROUP BY 1),
sig AS (SELECT s.class AS target, o.class AS other, avg(o.pb) - any_value(b.b) AS lift, count(*) AS n_pos FROM scores s JOIN scores o USING (file_id, win) JOIN base b ON b.class = o.class
  WHERE s.y = 1 GROUP BY s.class, o.class)"""
SIGSIM = SIG + """,
ns AS (SELECT *, lift / (sqrt(sum(lift * lift) OVER (PARTITION BY target)) + 1e-9) AS u FROM sig WHERE n_pos >= 3),
pf AS (SELECT file_id, win, s.class, (pb - b) / (sqrt(sum((pb - b) * (pb - b)) OVER (PARTITION BY file_id, win)) + 1e-9) AS u FROM scores s JOIN base USING (class)),
sm AS (SELECT file_id, win, target, round(sum(pf.u * ns.u), 9) AS cos FROM pf JOIN ns ON ns.other = pf.class GROUP BY ALL)
--
"""


@query("j08_confusion_signature", "target:s other:s lift:f n_pos:i", SIG + "\n--\nSELECT * FROM sig")
def _(v):
    return P.signatures(v.scores, ROW, "pb")


def sig_sims(v):
    sig = P.signatures(v.scores, ROW, "pb", 3)
    return P.signature_similarity(v.scores, ROW, "pb", sig).withColumn("cos", F.round("cos", 9))


@query("j09_signature_match", "file_id:s win:i target:s cos:f place:i", SIGSIM + """
SELECT *, row_number() OVER (PARTITION BY file_id, win ORDER BY cos DESC, target) AS place FROM sm WHERE cos > .5 QUALIFY place <= 5""")
def _(v):
    return P.best_matches(sig_sims(v), ROW, 0.5, 5)


@query("j09b_match_distribution", "target:s mean:f max_cos:f p90:f p99:f", SIGSIM + """
SELECT target, avg(cos) AS mean, max(cos) AS max_cos, quantile_cont(cos, .9) AS p90, quantile_cont(cos, .99) AS p99 FROM sm GROUP BY 1""")
def _(v):
    return P.match_distribution(sig_sims(v))


@query("j10_outlier_filter", CELL + "pa:f", SIMS + """,
own AS (SELECT s.class, quantile_cont(round(1 - s.cos, 9), .95) AS p95 FROM sims s JOIN vecs v ON v.vec_id = s.vec_id AND v.cls5 = s.class GROUP BY 1 HAVING count(*) >= 5)
--
SELECT row_id, s.class, pa FROM scores s LEFT JOIN sims c ON c.file_id = s.file_id AND c.win = s.win AND c.class = s.class LEFT JOIN own o ON o.class = s.class
WHERE pa > .2 AND NOT coalesce(1 - c.cos > p95 * 1.05, false)""")
def _(v):
    sims = sims5(v)
    own = (sims.join(v.vecs.select("vec_id", F.col("cls5").alias("class")), ["vec_id", "class"])
           .select("class", F.round(1 - F.col("cos"), 9).alias("dist")))
    return P.outlier_filter(v.scores.filter("pa > 0.2"), sims.drop("vec_id"), own, ROW, 1.05)


@query("j12_detector_filter", CELL + "source:s", """
SELECT row_id, class, CASE WHEN pa > .2 THEN 'kept' ELSE 'recovered' END AS source FROM scores
WHERE (pa > .2 AND pb <= .6) OR (NOT pa > .2 AND pa < .15 AND pc > .05)""")
def _(v):
    return P.detector_filter(v.scores, F.col("pa"), F.col("pa") > .2, F.col("pb"), F.col("pc"), .6, .05, .15)


@query("j13_external_verify", CELL + "keep:b", SIMS + """
--
SELECT row_id, s.class, coalesce(c.cos >= .1, true) AS keep FROM scores s LEFT JOIN (SELECT * FROM sims WHERE class <> 'view') c
  ON c.file_id = s.file_id AND c.win = s.win AND c.class = s.class WHERE pa > .2""")
def _(v):
    sims = sims5(v).filter("class <> 'view'").drop("vec_id")
    return P.external_verify(v.scores.filter("pa > 0.2"), sims, ROW, 0.1)


CAPS = """cap1 AS (SELECT *, row_number() OVER (PARTITION BY class, site ORDER BY sc DESC, row_id) AS k1 FROM ent QUALIFY k1 <= {a}),
cap2 AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY site, k1) AS k2 FROM cap1 QUALIFY k2 <= {b})"""


@query("j14_multi_site_filter", CELL + "site:s pa:f", """
ms AS (SELECT class FROM scores WHERE pa > .4 GROUP BY 1 HAVING count(DISTINCT site) >= 2),
ent AS (SELECT *, pa AS sc FROM scores WHERE pa > .5 AND class IN (SELECT class FROM ms)),
""" + CAPS.format(a=5, b=40) + "\n--\nSELECT row_id, class, site, pa FROM cap2")
def _(v):
    e = P.multi_site_entries(v.scores, "pa")
    return sampling.site_capped(e, "pa", 5, 40, "row_id")


@query("j15_targeted_classes", CELL + "site:s sc:f", f"""
tg AS (SELECT class FROM {auc_sql('(SELECT * FROM scores WHERE fold <> 0)', 'class', 'pb')} WHERE auc <= .856 AND class IN (
  SELECT class FROM scores WHERE y = 1 GROUP BY 1 HAVING count(DISTINCT site) >= 2)),
e0 AS (SELECT *, greatest(pa, pb) AS sc FROM scores WHERE greatest(pa, pb) > .55 AND class IN (SELECT class FROM tg)),
ent AS (SELECT * FROM e0 WHERE class IN (SELECT class FROM e0 GROUP BY 1 HAVING count(DISTINCT site) >= 2)),
""" + CAPS.format(a=6, b=50) + "\n--\nSELECT row_id, class, site, sc FROM cap2")
def _(v):
    weak = metrics.auc(v.scores.filter("fold <> 0"), ["class"], "pb").filter("auc <= 0.856")
    sites = profile.site_counts(v.scores, F.col("y") == 1).filter("n_sites >= 2")
    targets = weak.join(sites.select("class"), "class", "left_semi")
    d = v.scores.withColumn("sc", F.greatest("pa", "pb"))
    d = d.join(targets.select("class"), "class", "left_semi")
    return sampling.site_capped(P.multi_site_entries(d, "sc", .55, .55), "sc", 6, 50, "row_id")


@query("j16_tri_state_mask", CELL + "mask:i strict:i", """
SELECT row_id, class, (y = 1 OR pb < .1 OR pb > .5)::INT AS mask, (y = 1 OR pb < .1)::INT AS strict FROM scores""")
def _(v):
    y, p = F.col("y"), F.col("pb")
    return v.scores.select("row_id", "class", P.tri_state_mask(y, p).alias("mask"),
                           P.tri_state_mask(y, p, positives_only=True).alias("strict"))


@query("j17_teacher_agreement", "n_rows:i share_agreed:f mean_agreed:f", """
r AS (SELECT file_id, win, count(*) FILTER (WHERE (pa > .3)::INT + (pb > .3)::INT + (pc > .3)::INT >= 2) AS k FROM scores GROUP BY ALL)
--
SELECT count(*) AS n_rows, avg((k > 0)::INT) AS share_agreed, avg(k) AS mean_agreed FROM r""")
def _(v):
    return P.teacher_agreement(v.scores, ROW, ["pa", "pb", "pc"])


@query("j18_file_pseudo", "file_id:s class:s p:f", """
m AS (SELECT file_id, class, avg(pa) AS m FROM scores GROUP BY ALL)
--
SELECT file_id, class, CASE WHEN pow(m, 1.5) < .1 THEN 0 ELSE pow(m, 1.5) END AS p FROM m QUALIFY max(m) OVER (PARTITION BY file_id) >= .3""")
def _(v):
    return P.file_pseudo(v.scores, "pa", 0.3, 1.5)


@query("j19_top_k_with_truth", CELL + "y_soft:i", """
SELECT row_id, class, 1 AS y_soft FROM scores QUALIFY (row_number() OVER (PARTITION BY file_id, win ORDER BY pb DESC, class) <= 2 AND pb > .4) OR y = 1""")
def _(v):
    return P.top_k_with_truth(v.scores, ROW, "pb", F.col("y"), 2, 0.4)


@query("j20_threshold_map", "file_id:s win:i labels:s", """
SELECT file_id, win, coalesce(string_agg(class, ',' ORDER BY class) FILTER (WHERE pa >= .3), '') AS labels FROM scores GROUP BY ALL""")
def _(v):
    m = P.threshold_map(v.scores, ROW, "pa", 0.3)
    return m.withColumn("labels", F.array_join(F.array_sort(F.map_keys("labels")), ","))


@query("j21_label_mass", "file_id:s win:i weight:f", """
SELECT file_id, win, sum(CASE WHEN pow(pa, 2) < .1 THEN 0 ELSE pow(pa, 2) END) AS weight FROM scores GROUP BY ALL""")
def _(v):
    from dawnscore.functions.scalar import power_then_floor
    return P.label_mass(v.scores, ROW, power_then_floor(F.col("pa"), 2.0))
