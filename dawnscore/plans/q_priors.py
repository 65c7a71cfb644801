"""Registered queries: priors, gates and rule levers."""
from pyspark.sql import functions as F

from dawnscore.functions.scalar import logit, sigmoid
from dawnscore.operators import align, audit, levers, metrics, normalize, priors
from dawnscore.plans.q_metrics import UNC, auc_sql, tie, tie_sql
from dawnscore.plans.q_smooth import PART
from dawnscore.plans.registry import query
from dawnscore.plans.views import ROW, SERIES

CELL = "row_id:s class:s "
TABLES = """pt AS (SELECT class, site, hour, CASE WHEN grouping(site) + grouping(hour) = 2 THEN 'global' WHEN grouping(hour) = 1 THEN 'site'
  WHEN grouping(site) = 1 THEN 'hour' ELSE 'site_hour' END AS level, avg(y) AS p, count(*) AS n
  FROM scores {where} GROUP BY GROUPING SETS ((class), (class, site), (class, hour), (class, site, hour)))"""
SHRUNK = """p1 AS (SELECT s.*, g.p AS pg, h.p AS ph, h.n AS nh, t.p AS ps, t.n AS ns, x.p AS px, x.n AS nx FROM scores s
  LEFT JOIN pt g ON g.level = 'global' AND g.class = s.class LEFT JOIN pt h ON h.level = 'hour' AND h.class = s.class AND h.hour = s.hour
  LEFT JOIN pt t ON t.level = 'site' AND t.class = s.class AND t.site = s.site
  LEFT JOIN pt x ON x.level = 'site_hour' AND x.class = s.class AND x.site = s.site AND x.hour = s.hour),
p2 AS (SELECT *, coalesce(nh / (nh + 8.0) * ph + (1 - nh / (nh + 8.0)) * pg, pg) AS q1 FROM p1),
p3 AS (SELECT *, coalesce(ns / (ns + 8.0) * ps + (1 - ns / (ns + 8.0)) * q1, q1) AS q2 FROM p2),
p4 AS (SELECT *, coalesce(nx / (nx + 4.0) * px + (1 - nx / (nx + 4.0)) * q2, q2) AS q3 FROM p3),
prior_rows AS (SELECT *, ln(least(greatest(q3, 1e-4), 1 - 1e-4) / (1 - least(greatest(q3, 1e-4), 1 - 1e-4))) AS prior_logit,
  ln(least(greatest(q2, 1e-4), 1 - 1e-4) / (1 - least(greatest(q2, 1e-4), 1 - 1e-4))) AS fork_logit FROM p4)
--
"""


@query("i01_prior_tables", "class:s site:s hour:i level:s p:f n:i",
       TABLES.format(where="") + "\n--\nSELECT * FROM pt")
def _(v):
    return priors.prior_tables(v.scores)


@query("i02_shrunk_prior", CELL + "prior_logit:f fork_logit:f",
       TABLES.format(where="WHERE fold <> 0") + ",\n" + SHRUNK + "SELECT row_id, class, prior_logit, fork_logit FROM prior_rows")
def _(v):
    t = priors.prior_tables(v.scores.filter("fold <> 0"))
    full = priors.shrunk_prior(v.scores, t)
    return priors.shrunk_prior(full, t, with_site_hour=False, out="fork_logit")


ROLE = "CASE class WHEN 'click' THEN 'event' WHEN 'error' THEN 'texture' WHEN 'purchase' THEN 'proxy' WHEN 'signup' THEN 'prior_event' ELSE 'inactive' END"


@query("i03_prior_fusion", CELL + "fused:f", TABLES.format(where="") + ",\n" + SHRUNK + f"""
SELECT row_id, class, CASE {ROLE} WHEN 'event' THEN pa + .4 * prior_logit WHEN 'texture' THEN pa + prior_logit WHEN 'proxy' THEN pa + .8 * prior_logit
  WHEN 'prior_event' THEN .4 * prior_logit ELSE -8.0 END AS fused FROM prior_rows""")
def _(v):
    d = priors.shrunk_prior(v.scores, priors.prior_tables(v.scores))
    role = (F.when(F.col("class") == "click", "event").when(F.col("class") == "error", "texture")
            .when(F.col("class") == "purchase", "proxy").when(F.col("class") == "signup", "prior_event")
            .otherwise("inactive"))
    return d.withColumn("fused", priors.fuse(F.col("pa"), F.col("prior_logit"), role))


@query("i04_fold_safe_priors", "fold:i level:s class:s site:s hour:i p:f n:i", """
SELECT fold, CASE WHEN grouping(site) + grouping(hour) = 2 THEN 'global' WHEN grouping(hour) = 1 THEN 'site'
  WHEN grouping(site) = 1 THEN 'hour' ELSE 'site_hour' END AS level, class, site, hour, avg(y) AS p, count(*) AS n
FROM (SELECT f.fold, s.class, s.site, s.hour, s.y FROM scores s JOIN (SELECT DISTINCT fold FROM scores) f ON f.fold <> s.fold)
GROUP BY GROUPING SETS ((fold, class), (fold, class, site), (fold, class, hour), (fold, class, site, hour))""")
def _(v):
    return priors.fold_safe_tables(v.scores)


@query("i04b_fold_safe_prior_logit", CELL + "prior_logit:f", """
cells_f AS (SELECT fold, class, site, hour, sum(y) AS y, count(*) AS n FROM scores GROUP BY ALL),
o AS (SELECT f.fold, c.class, c.site, c.hour, sum(c.y) AS y, sum(c.n) AS n FROM cells_f c JOIN (SELECT DISTINCT fold FROM scores) f ON f.fold <> c.fold GROUP BY ALL),
g AS (SELECT fold, class, sum(y) / sum(n) AS p FROM o GROUP BY ALL),
h AS (SELECT fold, class, hour, sum(y) / sum(n) AS p, sum(n) AS n FROM o GROUP BY ALL),
t AS (SELECT fold, class, site, sum(y) / sum(n) AS p, sum(n) AS n FROM o GROUP BY ALL),
q1 AS (SELECT s.row_id, s.class, s.fold, s.site, CASE WHEN h.n IS NULL THEN g.p ELSE h.n / (h.n + 8.0) * h.p + (1 - h.n / (h.n + 8.0)) * g.p END AS q
  FROM scores s JOIN g USING (fold, class) LEFT JOIN h USING (fold, class, hour)),
q2 AS (SELECT q1.row_id, q1.class, CASE WHEN t.n IS NULL THEN q ELSE t.n / (t.n + 8.0) * t.p + (1 - t.n / (t.n + 8.0)) * q END AS q FROM q1 LEFT JOIN t USING (fold, class, site))
--
SELECT row_id, class, ln(least(greatest(q, 1e-4), 1 - 1e-4) / (1 - least(greatest(q, 1e-4), 1 - 1e-4))) AS prior_logit FROM q2""")
def _(v):
    t = priors.fold_safe_tables(v.scores)
    return priors.shrunk_prior(v.scores, t, with_site_hour=False, extra=("fold",))


@query("i05_site_prior_forms", "site:s class:s laplace:f relative:f seen:i", """
SELECT site, class, (k + 1.0) / (w + 5.0) AS laplace, k / (max(k) OVER (PARTITION BY site) + 1e-8) AS relative, (k > 0)::INT AS seen
FROM (SELECT site, class, sum(y) AS k, count(*) AS w FROM scores GROUP BY ALL)""")
def _(v):
    return priors.site_prior_forms(v.scores, 5)


@query("i06_soft_site_gate", CELL + "p:f", """
SELECT row_id, s.class, pa * (.75 * coalesce(prior, 1.0) + .25) AS p FROM scores s LEFT JOIN
  (SELECT site, class, avg(y) AS prior FROM scores WHERE site < 'S07' GROUP BY ALL) t ON t.site = s.site AND t.class = s.class""")
def _(v):
    prior = v.scores.filter("site < 'S07'").groupBy("site", "class").agg(F.avg("y").alias("prior"))
    d = align.prior_lookup(v.scores, prior, ["site", "class"])
    return d.withColumn("p", priors.soft_gate(F.col("pa"), F.col("prior")))


@query("i07_presence_boost", CELL + "p:f", """
seen_at AS (SELECT DISTINCT class, site, hour FROM scores WHERE y = 1)
--
SELECT row_id, class, CASE WHEN EXISTS (SELECT 1 FROM seen_at t WHERE t.class = s.class AND (t.site = s.site OR t.hour = s.hour)) THEN pa + .3 * (1 - pa) ELSE pa END AS p FROM scores s""")
def _(v):
    seen = v.scores.filter("y = 1").select("class", "site", "hour").distinct()
    return priors.presence_boost(v.scores, seen, "pa", "p")


@query("i08_taxon_gate", CELL + "mult:f half:f root:f floor:f mean:f max:f thresh:f quarter:f offset_v:f", """
SELECT row_id, class, pa * pb AS mult, .5 * pa + .5 * pa * pb AS half, pa * sqrt(pb) AS root, pa * (.5 + .5 * pb) AS floor, pa * (1 + pb) / 2 AS mean,
  greatest(pa, pa * pb) AS max, CASE WHEN pb > .3 THEN pa ELSE pa * pb END AS thresh, pa * pow(pb, .25) AS quarter, pa * least(greatest(pb + .1, 0), 1) AS offset_v FROM scores""")
def _(v):
    g = priors.taxon_gate(F.col("pa"), F.col("pb"))
    g["offset_v"] = g.pop("offset")
    return v.scores.select("row_id", "class", *[c.alias(k) for k, c in g.items()])


@query("i09_confusion_clusters", "target:s trigger:s mean_score:f n_pos:i place:i", """
m AS (SELECT s.class AS target, o.class AS trigger, avg(o.pb) AS mean_score, count(*) AS n_pos FROM scores s JOIN scores o USING (file_id, win)
  WHERE s.y = 1 AND s.class IN ('error', 'purchase') AND o.class IN ('click', 'view', 'signup') GROUP BY ALL HAVING count(*) >= 3)
--
SELECT *, row_number() OVER (PARTITION BY target ORDER BY mean_score DESC, trigger) AS place FROM m QUALIFY place <= 2""")
def _(v):
    return levers.derive_clusters(v.scores, ROW, "pb", F.col("class").isin("error", "purchase"),
                                  F.col("class").isin("click", "view", "signup"), 3, 2)


CLUSTERS = {"error": ["click", "view"], "purchase": ["signup", "view", "click"]}


@query("i10_cluster_whitelist", "class:s on_pos:f on_neg:f keep:b", """
lo AS (SELECT file_id, win, min(CASE WHEN class IN ('click', 'view') THEN pb END) AS e, min(CASE WHEN class IN ('signup', 'view', 'click') THEN pb END) AS p FROM scores GROUP BY ALL)
--
SELECT class, on_pos, on_neg, on_pos > on_neg * 1.0 AS keep FROM (SELECT class, avg(CASE WHEN y = 1 THEN x END) AS on_pos, avg(CASE WHEN y = 0 THEN x END) AS on_neg FROM (
  SELECT class, y, CASE class WHEN 'error' THEN e ELSE p END AS x FROM scores JOIN lo USING (file_id, win) WHERE class IN ('error', 'purchase')) GROUP BY 1)""")
def _(v):
    return levers.cluster_whitelist(v.scores, ROW, CLUSTERS, "pb", 1.0)


@query("i11_cluster_rewrite", CELL + "p:f two_way:f", """
t AS (SELECT file_id, win, min(CASE WHEN class IN ('click', 'view') THEN pb END) AS e, min(CASE WHEN class IN ('signup', 'view', 'click') THEN pb END) AS p,
  avg(CASE WHEN class IN ('click', 'view') THEN pb END) AS em, avg(CASE WHEN class IN ('signup', 'view', 'click') THEN pb END) AS pm FROM scores GROUP BY ALL)
--
SELECT row_id, class, least(CASE class WHEN 'error' THEN pb * (1 + 2 * e) WHEN 'purchase' THEN pb * (1 + 2 * p) ELSE pb END, 1) AS p,
  least(CASE class WHEN 'error' THEN pb * (1 + em) WHEN 'purchase' THEN pb * (1 + pm) WHEN 'signup' THEN pb * (1 - .3 * pm) ELSE pb * (1 - .3 * em) * (1 - .3 * pm) END, 1) AS two_way
FROM scores JOIN t USING (file_id, win)""")
def _(v):
    d = levers.cluster_rewrite(v.scores, ROW, CLUSTERS, "pb", "p")
    return levers.cluster_rewrite(d, ROW, CLUSTERS, "pb", "two_way", 1.0, 0.3, "mean")


@query("i12_miss_rescue", CELL + "p:f",
       "SELECT row_id, class, least(greatest(CASE WHEN pa < .4 THEN pa + .2 * greatest(greatest(pb, pc) - .3, 0) * (1 - pa) ELSE pa END, 0), 1) AS p FROM scores")
def _(v):
    return v.scores.withColumn("p", levers.miss_rescue(F.col("pa"), F.col("pb"), F.col("pc")))


@query("i13_alarm_suppress", CELL + "p:f",
       "SELECT row_id, class, CASE WHEN pa > .6 THEN pa * (1 - .1 * least(greatest((abs(pb - pc) - .3) / .7, 0), 1)) ELSE pa END AS p FROM scores")
def _(v):
    return v.scores.withColumn("p", levers.alarm_suppress(F.col("pa"), F.col("pb"), F.col("pc")))


@query("i14_detector_correction", CELL + "p:f",
       "SELECT row_id, class, CASE WHEN pa < .5 THEN pa + .2 * pb * (1 - pa) WHEN pa > .5 THEN pa * (1 - .2 * pc) ELSE pa END AS p FROM scores")
def _(v):
    return v.scores.withColumn("p", levers.detector_correction(F.col("pa"), F.col("pb"), F.col("pc")))


@query("i15_band_gate", CELL + "p:f",
       "SELECT row_id, class, CASE WHEN pb / (pb + pc + .2 + 1e-9) > .4 AND taxon = 'Aves' THEN pa * .5 ELSE pa END AS p FROM scores")
def _(v):
    total = F.col("pb") + F.col("pc") + 0.2
    return v.scores.withColumn("p", levers.band_gate(F.col("pa"), F.col("pb"), total, F.col("taxon")))


@query("i16_uncertainty_levers", CELL + "u:f damped:f routed:f suppressed:f", UNC + """,
zu AS (SELECT file_id, win, round((-((entropy - avg(entropy) OVER w) / (stddev_pop(entropy) OVER w + 1e-9)) + (top1 - avg(top1) OVER w) / (stddev_pop(top1) OVER w + 1e-9)
  + (margin - avg(margin) OVER w) / (stddev_pop(margin) OVER w + 1e-9)) / 3, 9) AS u FROM unc WINDOW w AS (PARTITION BY site))
--
SELECT row_id, class, u, pa * greatest(1 - .1 * least(greatest(u, 0), 3), .5) AS damped, CASE WHEN u > 1 THEN pb ELSE pa END AS routed,
  CASE WHEN u > 1 AND class <> 'view' THEN pa * .8 ELSE pa END AS suppressed FROM scores JOIN zu USING (file_id, win)""")
def _(v):
    rows = audit.row_uncertainty(v.scores, ROW, "pa", 5, keep=["site"])
    for m in ("entropy", "top1", "margin"):
        rows = normalize.site_zscore(rows, m, f"z_{m}")
    u = rows.select(*ROW, F.round((-F.col("z_entropy") + F.col("z_top1") + F.col("z_margin")) / 3, 9).alias("u"))
    p, uc = F.col("pa"), F.col("u")
    return v.scores.join(u, ROW).select(
        "row_id", "class", "u", levers.damp(p, uc).alias("damped"),
        levers.route(p, F.col("pb"), uc).alias("routed"),
        levers.suppress_mapped(p, uc, F.col("class") != "view").alias("suppressed"))


@query("i17_hour_bias", CELL + "p:f", """
l AS (SELECT *, hour // 6 AS hb, ln(q / (1 - q)) AS lg FROM (SELECT *, least(greatest(pa, 1e-4), 1 - 1e-4) AS q FROM scores)),
b AS (SELECT t.class, t.hb, avg(CASE WHEN l.hb = t.hb THEN lg END) - avg(CASE WHEN l.hb <> t.hb THEN lg END) AS bias FROM (SELECT DISTINCT class, hb FROM l) t JOIN l ON l.class = t.class GROUP BY ALL)
--
SELECT row_id, l.class, 1 / (1 + exp(-(lg - bias))) AS p FROM l JOIN b ON b.class = l.class AND b.hb = l.hb""")
def _(v):
    d = v.scores.withColumn("hb", F.floor(F.col("hour") / 6)).withColumn("lg", logit(F.col("pa"), 1e-4))
    return levers.hour_bias(d, "lg", "hb", "c").withColumn("p", sigmoid(F.col("c")))


@query("i18_sd_lever", CELL + "p:f",
       f"SELECT row_id, class, least(greatest(CASE WHEN sd > .25 THEN pa * 1.1 WHEN sd < .15 THEN pa * .8 ELSE pa END, 0), 1) AS p FROM (SELECT *, stddev_pop(pa) OVER ({PART}) AS sd FROM scores)")
def _(v):
    from pyspark.sql import Window
    sd = F.stddev_pop("pa").over(Window.partitionBy(*SERIES))
    d = v.scores.withColumn("sd", sd)
    return d.withColumn("p", levers.sd_lever(F.col("pa"), F.col("sd"), .25, .1, .15, .2))


@query("i19_signature_damped", CELL + "p:f", """
l AS (SELECT *, CASE WHEN pa < .4 THEN pa + .2 * greatest(greatest(pb, pc) - .3, 0) * (1 - pa) ELSE pa END AS lev,
  avg(CASE WHEN class IN ('purchase', 'error') THEN pb END) OVER (PARTITION BY file_id, win) AS sig FROM scores)
--
SELECT row_id, class, CASE WHEN sig > .5 THEN pa + .3 * (lev - pa) ELSE lev END AS p FROM l""")
def _(v):
    d = v.scores.withColumn("lev", levers.miss_rescue(F.col("pa"), F.col("pb"), F.col("pc")))
    return levers.signature_damped(d, ROW, "pa", "lev", "pb", F.col("class").isin("purchase", "error"), .5, .3, "p")


@query("l38_lever_isolation", "variant:s macro:f delta:f aves_delta:f worst:s n_rich:i", f"""
pr AS (SELECT site, class, avg(y) AS prior FROM scores GROUP BY ALL),
t AS (SELECT file_id, win, min(CASE WHEN class IN ('click', 'view') THEN pb END) AS e FROM scores GROUP BY ALL),
b AS (SELECT s.class, s.taxon, s.y, pb AS base, {tie_sql('pb * (.75 * prior + .25)')} AS site_only, {tie_sql("least(CASE WHEN s.class = 'error' THEN pb * (1 + 2 * e) ELSE pb END, 1)")} AS cluster_only,
  {tie_sql("least(CASE WHEN s.class = 'error' THEN pb * (1 + 2 * e) ELSE pb END, 1) * (.75 * prior + .25)")} AS all_levers
  FROM scores s JOIN pr ON pr.site = s.site AND pr.class = s.class JOIN t ON t.file_id = s.file_id AND t.win = s.win),
u AS (UNPIVOT b ON base, site_only, cluster_only, all_levers INTO NAME variant VALUE p),
a AS (SELECT * FROM {auc_sql('u', 'variant, class, taxon', 'p')}),
d AS (SELECT a.variant, a.class, a.taxon, a.auc, a.auc - r.auc AS delta, a.n_pos FROM a JOIN a r ON r.variant = 'base' AND r.class = a.class WHERE a.variant <> 'base')
--
SELECT variant, avg(auc) AS macro, avg(delta) AS delta, avg(CASE WHEN taxon = 'Aves' THEN delta END) AS aves_delta, arg_min(class, (round(delta, 9), class)) AS worst,
  count(*) FILTER (WHERE n_pos >= 10) AS n_rich FROM d GROUP BY 1""")
def _(v):
    prior = v.scores.groupBy("site", "class").agg(F.avg("y").alias("prior"))
    d = levers.cluster_rewrite(v.scores, ROW, {"error": ["click", "view"]}, "pb", "cl")
    d = d.join(prior, ["site", "class"])
    gate = priors.soft_gate
    d = d.select("class", "taxon", "y", F.col("pb").alias("base"),
                 tie(gate(F.col("pb"), F.col("prior"))).alias("site_only"),
                 tie(F.col("cl")).alias("cluster_only"),
                 tie(gate(F.col("cl"), F.col("prior"))).alias("all_levers"))
    return audit.lever_isolation(d, "base", ["site_only", "cluster_only", "all_levers"])
