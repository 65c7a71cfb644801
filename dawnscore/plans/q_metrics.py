"""Registered queries: metrics and audits."""
from pyspark.sql import functions as F

from dawnscore.functions.keys import count_band
from dawnscore.functions.scalar import clip
from dawnscore.operators import align, audit, lever_grid, levers, metrics, profile, rank, smooth
from dawnscore.plans.q_smooth import avg_rank, kernel_sql
from dawnscore.plans.registry import query
from dawnscore.plans.views import CLASSES, ROW, SERIES
from dawnscore.operators.scalars import attach


def auc_sql(src, keys, score, y="y"):
    return f"""(SELECT {keys}, (sum(CASE WHEN {y} = 1 THEN rk END) - sum({y}) * (sum({y}) + 1) / 2.0)
    / (sum({y}) * (count(*) - sum({y}))) AS auc, sum({y}) AS n_pos, count(*) - sum({y}) AS n_neg
  FROM (SELECT *, {avg_rank(keys, score)} AS rk FROM {src}) GROUP BY {keys} HAVING sum({y}) > 0 AND sum({y}) < count(*))"""


def tie(col):
    """Derived scores are rounded before ranking so that float noise cannot split ties."""
    return F.round(col + 3.1e-13, 9)


def tie_sql(expr):
    return f"round({expr} + 3.1e-13, 9)"


A = auc_sql("scores", "class, taxon", "pa")
LONG = auc_sql("longs", "model, class, taxon", "p")


@query("l01_class_auc", "model:s class:s auc:f n_pos:i", f"SELECT * FROM {LONG}")
def _(v):
    return metrics.auc(v.longs, ["model", "class"], "p")


@query("l02_macro_auc", "model:s macro:f n_classes:i",
       f"SELECT model, avg(auc) AS macro, count(*) AS n_classes FROM {LONG} GROUP BY 1")
def _(v):
    return metrics.macro_auc(v.longs, ["model"], "p")


@query("l03_taxon_auc", "taxon:s macro:f n_classes:i",
       f"SELECT taxon, avg(auc) AS macro, count(*) AS n_classes FROM {A} GROUP BY 1")
def _(v):
    return audit.per_taxon(metrics.auc(v.scores, ["class", "taxon"], "pa"))


@query("l04_precision_recall", "model:s precision:f recall:f n_classes:i", """
SELECT model, avg(CASE WHEN np > 0 THEN tp / np END) AS precision, avg(tp / p) AS recall, count(*) AS n_classes FROM (
  SELECT model, class, count(*) FILTER (WHERE p >= 0.4 AND y = 1) AS tp, count(*) FILTER (WHERE p >= 0.4) AS np, sum(y) AS p
  FROM longs GROUP BY ALL) WHERE p > 0 GROUP BY 1""")
def _(v):
    return metrics.precision_recall(v.longs, ["model"], "p", 0.4)


@query("l05_average_precision", "class:s ap:f", """
c AS (SELECT class, pa, sum(y) AS pos, count(*) AS n FROM scores GROUP BY ALL),
r AS (SELECT class, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS np, sum(pos) OVER (PARTITION BY class) AS tot FROM c
  WINDOW w AS (PARTITION BY class ORDER BY pa DESC ROWS UNBOUNDED PRECEDING))
--
SELECT class, sum(pos / tot * tp / np) AS ap FROM r WHERE tot > 0 GROUP BY 1""")
def _(v):
    return metrics.average_precision(v.scores, ["class"], "pa")


def rho_sql(part, a, b, src="scores"):
    return f"""(SELECT {part}, CASE WHEN stddev_pop(ra) > 1e-12 AND stddev_pop(rb) > 1e-12 THEN corr(ra, rb) END AS rho
  FROM (SELECT *, {avg_rank(part, a)} AS ra, {avg_rank(part, b)} AS rb FROM {src}) GROUP BY {part})"""


@query("l06_row_spearman", "sp_mean:f sp_min:f n_rows:i",
       f"SELECT avg(rho) AS sp_mean, min(rho) AS sp_min, count(*) AS n_rows FROM {rho_sql('file_id, win', 'pa', 'pb')} WHERE rho IS NOT NULL")
def _(v):
    return metrics.row_spearman_summary(v.scores, ROW, "pa", "pb")


@query("l07_column_spearman", "class:s rho:f", f"SELECT * FROM {rho_sql('class', 'pa', 'pb')}")
def _(v):
    return metrics.column_spearman(v.scores, "pa", "pb")


CORR = """SELECT {k}'pa' AS s1, 'pb' AS s2, corr(pa, pb) AS r FROM scores {g} UNION ALL
SELECT {k}'pa', 'pc', corr(pa, pc) FROM scores {g} UNION ALL SELECT {k}'pb', 'pc', corr(pb, pc) FROM scores {g}"""


@query("l08_stream_correlation", "s1:s s2:s r:f", CORR.format(k="", g=""))
def _(v):
    return metrics.stream_correlation(v.scores, ["pa", "pb", "pc"])


@query("l08b_class_stream_correlation", "class:s s1:s s2:s r:f",
       CORR.format(k="class, ", g="GROUP BY class"))
def _(v):
    return metrics.stream_correlation(v.scores, ["pa", "pb", "pc"], ["class"])


AUDIT_SPEC = "macro:f macro_delta:f d_aves:f d_amphibia:f d_insecta:f sp_mean:f n_classes:i verdict:s"


def audit_sql(src, keys=""):
    """keys: extra grouping columns with a trailing comma, e.g. 'alpha, '."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in (keys + "class").split(","))
    back = " AND ".join(f"l.{k.strip()} = s.{k.strip()}" for k in keys.split(",") if k.strip()) or "true"
    sk = f"SELECT {keys}avg(rho) AS sp_mean FROM {rho_sql(keys + 'file_id, win', 'ref', 'cand', src)} WHERE rho IS NOT NULL GROUP BY ALL"
    return f"""SELECT l.*, sp_mean, CASE WHEN sp_mean IS NULL THEN '?' WHEN sp_mean >= 0.99 AND (d_aves IS NULL OR d_aves >= 0) THEN 'A'
  WHEN sp_mean >= 0.99 AND abs(macro_delta) <= 0.005 THEN 'B' ELSE 'C' END AS verdict FROM (
  SELECT {', '.join('b.' + k.strip() for k in keys.split(',') if k.strip()) + ', ' if keys else ''}avg(b.auc) AS macro, avg(b.auc - a.auc) AS macro_delta,
    avg(CASE WHEN b.taxon = 'Aves' THEN b.auc - a.auc END) AS d_aves, avg(CASE WHEN b.taxon = 'Amphibia' THEN b.auc - a.auc END) AS d_amphibia,
    avg(CASE WHEN b.taxon = 'Insecta' THEN b.auc - a.auc END) AS d_insecta, count(*) AS n_classes
  FROM {auc_sql(src, keys + 'class, taxon', 'ref')} a JOIN {auc_sql(src, keys + 'class, taxon', 'cand')} b ON {on} GROUP BY ALL) l
JOIN ({sk}) s ON {back}"""


@query("l09_candidate_audit", AUDIT_SPEC, f"""
cand_t AS (SELECT *, pa AS ref, {tie_sql('0.9 * pa + 0.1 * pb')} AS cand FROM scores)
--
{audit_sql('cand_t')}""")
def _(v):
    df = v.scores.withColumn("cand", tie(0.9 * F.col("pa") + 0.1 * F.col("pb")))
    return audit.audit_rows(df, [], "pa", "cand")


@query("l10_site_macro_auc", "site:s macro:f n_classes:i n_rows:i", f"""
SELECT site, macro, n_classes, n_rows FROM (SELECT site, avg(auc) AS macro, count(*) AS n_classes FROM {auc_sql('scores', 'site, class', 'pa')} GROUP BY 1)
JOIN (SELECT site, count(DISTINCT row_id) AS n_rows FROM scores GROUP BY 1) USING (site) WHERE n_rows >= 150 AND n_classes >= 3""")
def _(v):
    return audit.grouped_macro(v.scores, "site", "pa", ROW, 150, 3)


@query("l10b_hour_bucket_auc", "bucket:i model:s macro:f n_classes:i", f"""
SELECT bucket, model, avg(auc) AS macro, count(*) AS n_classes
FROM {auc_sql('(SELECT *, hour // 6 AS bucket FROM longs)', 'bucket, model, class', 'p')} GROUP BY ALL""")
def _(v):
    df = v.longs.withColumn("bucket", F.floor(F.col("hour") / 6))
    return metrics.macro_auc(df, ["bucket", "model"], "p")


@query("l11_rarity_band_auc", "bucket:s model:s macro:f n_classes:i", f"""
SELECT CASE WHEN k <= 50 THEN '11-50' WHEN k <= 200 THEN '51-200' ELSE '200+' END AS bucket, model, avg(auc) AS macro, count(*) AS n_classes
FROM {LONG} JOIN (SELECT class, count(*) FILTER (WHERE file_id < 'F12') + 11 AS k FROM cells GROUP BY 1) USING (class) GROUP BY ALL""")
def _(v):
    feats = v.cells.groupBy("class").agg((F.count_if(F.col("file_id") < "F12") + 11).alias("k"))
    return audit.bucketed_auc(metrics.auc(v.longs, ["model", "class"], "p"), feats,
                              count_band(F.col("k")), ["model"])


@query("l12_bucket_auc", "bucket:s macro:f n_classes:i", f"""
SELECT CASE WHEN k > 0 THEN 'many' ELSE 'few' END AS bucket, avg(auc) AS macro, count(*) AS n_classes FROM {A}
JOIN (SELECT class, count(DISTINCT site) FILTER (WHERE y = 1 AND hour = 7 AND win > 8) - 1 AS k FROM scores GROUP BY 1) USING (class) GROUP BY 1""")
def _(v):
    hit = (F.col("y") == 1) & (F.col("hour") == 7) & (F.col("win") > 8)
    feats = profile.site_counts(v.scores, hit).withColumn("k", F.col("n_sites") - 1)
    return audit.bucketed_auc(metrics.auc(v.scores, ["class"], "pa"), feats,
                              F.when(F.col("k") > 0, "many").otherwise("few"))


@query("l13_miss_buckets", "model:s bucket:s n:i share:f", """
b AS (SELECT model, CASE WHEN p < .1 THEN 'confident_miss' WHEN p < .3 THEN 'weak_miss' WHEN p < .5 THEN 'borderline' ELSE 'caught' END AS bucket,
  count(*) AS n FROM longs WHERE y = 1 GROUP BY ALL)
--
SELECT *, n / sum(n) OVER (PARTITION BY model) AS share FROM b""")
def _(v):
    return audit.miss_buckets(v.longs, ["model"], "p")


@query("l14_miss_agreement", "s1:s s2:s n_both:i share:f", """
pos AS (SELECT (pa < .5)::INT AS pa, (pb < .5)::INT AS pb, (pc < .5)::INT AS pc FROM scores WHERE y = 1),
lng AS (UNPIVOT (SELECT row_number() OVER () AS id, * FROM pos) ON pa, pb, pc INTO NAME s VALUE m)
--
SELECT a.s AS s1, b.s AS s2, sum(a.m * b.m) AS n_both, sum(a.m * b.m) / sum(a.m) AS share FROM lng a JOIN lng b USING (id) GROUP BY ALL""")
def _(v):
    return audit.miss_agreement(v.scores, ["pa", "pb", "pc"])


UNI = """SELECT {k}, count(*) AS n_pos, count(*) FILTER (WHERE m = 3) AS all_miss, count(*) FILTER (WHERE m = 0) AS all_catch,
  count(*) FILTER (WHERE m IN (1, 2)) AS mixed, avg((m = 3)::INT) AS miss_rate
FROM (SELECT *, (pa < .5)::INT + (pb < .5)::INT + (pc < .5)::INT AS m FROM scores WHERE y = 1) GROUP BY ALL"""
UNI_SPEC = " n_pos:i all_miss:i all_catch:i mixed:i miss_rate:f"


@query("l14b_universal_miss_class", "class:s" + UNI_SPEC, UNI.format(k="class"))
def _(v):
    return audit.universal_misses(v.scores, ["class"], ["pa", "pb", "pc"])


@query("l14c_universal_miss_site_hour", "site:s hour:i" + UNI_SPEC, UNI.format(k="site, hour"))
def _(v):
    return audit.universal_misses(v.scores, ["site", "hour"], ["pa", "pb", "pc"])


TOP3 = """placed AS (SELECT *, row_number() OVER (PARTITION BY file_id, win ORDER BY pb DESC, class) AS k FROM scores)
--
"""


@query("l15_predicted_instead", "class:s other:s taxon_pair:s n:i", TOP3 + """
SELECT s.class, o.class AS other, s.taxon || '>' || o.taxon AS taxon_pair, count(*) AS n FROM scores s JOIN placed o USING (file_id, win)
WHERE s.y = 1 AND s.pb < 0.5 AND o.k <= 3 GROUP BY ALL""")
def _(v):
    hits = audit.predicted_instead(v.scores, ROW, "pb", F.col("pb") < 0.5)
    return (hits.groupBy("class", "other", F.concat_ws(">", "taxon", "other_taxon").alias("taxon_pair"))
            .agg(F.count(F.lit(1)).alias("n")))


@query("l16_ranked_above", "class:s other:s n_above:i place:i", """
c AS (SELECT s.class, o.class AS other, count(*) AS n_above FROM scores s JOIN scores o USING (file_id, win)
  WHERE s.y = 1 AND o.pb > s.pb GROUP BY ALL)
--
SELECT *, row_number() OVER (PARTITION BY class ORDER BY n_above DESC, other) AS place FROM c
QUALIFY place <= 3""")
def _(v):
    return audit.ranked_above(v.scores, ROW, "pb")


@query("l17_confusion_pairs", "class:s other:s n_pairs:i", f"""
g AS (SELECT *, CASE WHEN class IN ('click', 'error', 'signup') THEN 'g1' ELSE 'g2' END AS grp FROM scores),
weak AS (SELECT class FROM {auc_sql('scores', 'class', 'pb')} WHERE auc < 0.86),
p AS (SELECT s.file_id, s.win, s.class, o.class AS other,
  row_number() OVER (PARTITION BY s.file_id, s.win, s.class ORDER BY o.pb DESC, o.class) AS k
  FROM g s JOIN g o ON s.file_id = o.file_id AND s.win = o.win AND s.grp = o.grp AND s.class <> o.class WHERE s.y = 1)
--
SELECT class, other, count(*) AS n_pairs FROM p WHERE k <= 1 AND class IN (SELECT class FROM weak) GROUP BY ALL""")
def _(v):
    df = v.scores.withColumn("grp", F.when(F.col("class").isin("click", "error", "signup"), "g1")
                             .otherwise("g2"))
    weak = metrics.auc(v.scores, ["class"], "pb").filter("auc < 0.86")
    return audit.confusion_pairs(df, ROW, "pb", "grp", weak, 1)


FP = """SELECT {k}, count(*) AS n_neg, avg((p > .7)::INT) AS high_share, avg((p > .5 AND p <= .7)::INT) AS mid_share
FROM longs WHERE y = 0 GROUP BY ALL"""


@query("l18_false_positives", "model:s n_neg:i high_share:f mid_share:f", FP.format(k="model"))
def _(v):
    return audit.false_positive_shares(v.longs, ["model"], "p")


@query("l18b_class_false_positives", "model:s class:s n_neg:i high_share:f mid_share:f",
       FP.format(k="model, class"))
def _(v):
    return audit.false_positive_shares(v.longs, ["model", "class"], "p")


@query("l18c_present_on_false_positives", "class:s present:s n:i", """
SELECT s.class, o.class AS present, count(*) AS n FROM scores s JOIN scores o USING (file_id, win)
WHERE s.y = 0 AND s.pb > 0.7 AND o.y = 1 GROUP BY ALL""")
def _(v):
    return audit.present_on_false_positives(v.scores, ROW, F.col("pb") > 0.7)


@query("l19_best_stream", "class:s taxon:s best:s best_auc:f margin:f", f"""
r AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY auc DESC, model DESC) AS k FROM {LONG})
--
SELECT a.class, a.taxon, a.model AS best, a.auc AS best_auc, a.auc - b.auc AS margin FROM r a JOIN r b ON a.class = b.class WHERE a.k = 1 AND b.k = 2""")
def _(v):
    return audit.best_stream(metrics.auc(v.longs, ["model", "class", "taxon"], "p"))


@query("l19b_winner_by_taxon", "taxon:s A:i B:i C:i", f"""
SELECT taxon, count(*) FILTER (WHERE best = 'A') AS "A", count(*) FILTER (WHERE best = 'B') AS "B", count(*) FILTER (WHERE best = 'C') AS "C"
FROM (SELECT class, taxon, arg_max(model, auc) AS best FROM {LONG} GROUP BY ALL) GROUP BY 1""")
def _(v):
    best = audit.best_stream(metrics.auc(v.longs, ["model", "class", "taxon"], "p"))
    return profile.crosstab(best, "taxon", "best", ["A", "B", "C"])


PAIRED = f"""pr AS (SELECT a.class, a.taxon, a.auc AS auc_ref, b.auc AS auc_cand, b.auc - a.auc AS delta, a.n_pos FROM {A} a
  JOIN {auc_sql('scores', 'class', 'pb')} b ON a.class = b.class)
--
"""


@query("l20_win_tie_loss", "wins:i ties:i losses:i mean:f std:f share_pos:f", PAIRED + """
SELECT count(*) FILTER (WHERE delta > .01) AS wins, count(*) FILTER (WHERE abs(delta) <= .01) AS ties,
  count(*) FILTER (WHERE delta < -.01) AS losses, avg(delta) AS mean, stddev_samp(delta) AS std, avg((delta > 0)::INT) AS share_pos FROM pr""")
def _(v):
    return audit.win_tie_loss(audit.paired_auc(v.scores, ["class", "taxon"], "pa", "pb"))


@query("l21_quadrant_auc", "feature:s contrast:s auc:f n_pos:i n_neg:i", f"""
f AS (UNPIVOT (SELECT pb, pc, (pa >= .5)::INT AS fires, ((pa >= .5)::INT <> y)::INT AS w FROM scores) ON pb, pc INTO NAME feature VALUE val),
c AS (SELECT feature, val, w, CASE WHEN fires = 1 THEN 'tp_fp' ELSE 'tn_fn' END AS contrast FROM f UNION ALL SELECT feature, val, w, 'all' FROM f)
--
SELECT * FROM {auc_sql('c', 'feature, contrast', 'val', 'w')}""")
def _(v):
    return audit.quadrant_auc(v.scores, "pa", ["pb", "pc"])


UNC = """unc AS (SELECT file_id, win, site, s, -sum(q * ln(q + 1e-12)) / ln(5) AS entropy, max(pa) AS top1,
    max(pa) - max(CASE WHEN k = 2 THEN pa END) AS margin, sum(CASE WHEN k <= 5 THEN pa END) / (s + 1e-12) AS top5, s * s / (sum(pa * pa) + 1e-12) AS effective
  FROM (SELECT *, pa / (s + 1e-12) AS q FROM (SELECT *, sum(pa) OVER (PARTITION BY file_id, win) AS s,
    row_number() OVER (PARTITION BY file_id, win ORDER BY pa DESC, class) AS k FROM scores)) GROUP BY file_id, win, site, s)"""
UNC_METRICS = ["entropy", "top1", "margin", "top5", "effective"]


def uncertainty(v):
    return audit.row_uncertainty(v.scores, ROW, "pa", len(CLASSES), keep=["site"])


@query("l22_row_uncertainty", "file_id:s win:i entropy:f top1:f margin:f top5:f effective:f",
       UNC + "\n--\nSELECT * FROM unc")
def _(v):
    return uncertainty(v)


@query("l23_ambiguity_zones", "n_rows:i zone_a:f zone_b:f zone_c:f zone_d:f", UNC + """
--
SELECT count(*) AS n_rows, avg((top1 > .7)::INT) AS zone_a, avg((top1 BETWEEN .3 AND .7 AND margin > .2)::INT) AS zone_b,
  avg((top1 > .3 AND margin < .2)::INT) AS zone_c, avg((top1 < .3)::INT) AS zone_d FROM unc""")
def _(v):
    return audit.ambiguity_zones(uncertainty(v))


KIND = """kinds AS (SELECT file_id, win, site, CASE WHEN u > 0 AND k = 0 THEN 'UNK_ONLY' WHEN u > 0 THEN 'UNK_MIXED' WHEN k > 0 THEN 'KNOWN_ONLY' ELSE 'BG' END AS kind
  FROM (SELECT file_id, win, site, sum(CASE WHEN class IN ('view', 'signup') THEN y ELSE 0 END) AS u,
    sum(CASE WHEN class IN ('view', 'signup') THEN 0 ELSE y END) AS k FROM scores GROUP BY ALL))"""


def kinds(v):
    return audit.row_vocabulary_class(v.scores, ROW, ["view", "signup"], keep=["site"])


@query("l24_row_vocabulary_class", "file_id:s win:i kind:s", KIND + "\n--\nSELECT * FROM kinds")
def _(v):
    return kinds(v)


SEP = UNC + ",\n" + KIND + """,
m AS (UNPIVOT (SELECT u.site, (kind = 'UNK_ONLY')::INT AS y, round(entropy, 9) AS entropy, round(top1, 9) AS top1, round(margin, 9) AS margin,
    round(effective, 9) AS effective FROM unc u JOIN kinds USING (file_id, win) WHERE kind IN ('UNK_ONLY', 'KNOWN_ONLY'))
  ON entropy, top1, margin, effective INTO NAME metric VALUE val)
--
"""
SEP_METRICS = ["entropy", "top1", "margin", "effective"]


def separated(v):
    u = uncertainty(v).drop("site").withColumns({m: F.round(m, 9) for m in SEP_METRICS})
    return u.join(kinds(v), ROW)


@query("l25_group_separation", "metric:s n_groups:i median_auc:f strength:f", SEP + f"""
SELECT metric, count(*) AS n_groups, median(auc) AS median_auc, abs(median(auc) - .5) * 2 AS strength
FROM {auc_sql('m', 'site, metric', 'val')} WHERE n_pos >= 3 AND n_neg >= 3 GROUP BY 1""")
def _(v):
    return audit.separation_summary(audit.group_separation(
        separated(v), SEP_METRICS, "UNK_ONLY", "KNOWN_ONLY", ["site"]))


@query("l25b_pooled_separation", "metric:s auc:f n_pos:i n_neg:i",
       SEP + f"SELECT * FROM {auc_sql('m', 'metric', 'val')}")
def _(v):
    return audit.group_separation(separated(v), SEP_METRICS, "UNK_ONLY", "KNOWN_ONLY")


@query("l26_gain_ratio", "gain_eval:f gain_train:f ratio:f", f"""
g AS (SELECT part, avg(b.auc - a.auc) AS gain FROM {auc_sql("(SELECT *, CASE WHEN fold = 0 THEN 'eval' ELSE 'train' END AS part FROM scores)", 'part, class', 'pb')} a
  JOIN {auc_sql("(SELECT *, CASE WHEN fold = 0 THEN 'eval' ELSE 'train' END AS part FROM scores)", 'part, class', 'pa')} b USING (part, class) GROUP BY 1)
--
SELECT e.gain AS gain_eval, t.gain AS gain_train, t.gain / greatest(e.gain, 1e-6) AS ratio FROM g e, g t WHERE e.part = 'eval' AND t.part = 'train'""")
def _(v):
    df = v.scores.withColumn("part", F.when(F.col("fold") == 0, "eval").otherwise("train"))
    g = audit.paired_auc(df, ["part", "class"], "pb", "pa").agg(
        F.avg(F.when(F.col("part") == "eval", F.col("delta"))).alias("gain_eval"),
        F.avg(F.when(F.col("part") == "train", F.col("delta"))).alias("gain_train"))
    return g.withColumn("ratio", F.col("gain_train") / F.greatest("gain_eval", F.lit(1e-6)))


@query("l26b_drop_one_site", "site:s class:s auc:f n_pos:i", f"""
SELECT * FROM {auc_sql('(SELECT t.site, s.class, s.pa, s.y FROM scores s, (SELECT DISTINCT site FROM scores) t WHERE s.site <> t.site)', 'site, class', 'pa')}""")
def _(v):
    return metrics.auc_without(v.scores, ["class"], "site", "pa")


@query("l27_site_spread", "model:s spread:f n_sites:i", f"""
SELECT model, max(m) - min(m) AS spread, count(*) AS n_sites FROM (SELECT model, site, avg(auc) AS m FROM {auc_sql('longs', 'model, site, class', 'p')} GROUP BY ALL) GROUP BY 1""")
def _(v):
    return audit.site_spread(audit.grouped_macro(v.longs, "site", "p", ROW, 4, 1, ["model"]), ["model"])


def points_sql(points):
    def text(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return ("(VALUES " + ", ".join(f"({', '.join(map(text, p.values()))})" for p in points)
            + f") AS points({', '.join(points[0])})")


BASE = tie_sql("0.7 * pa + 0.3 * pb")
UP = """CASE WHEN ref < low THEN least(greatest(ref + alpha_up * greatest(greatest(pb, CASE WHEN family = 'single' THEN pb ELSE pc END) - delta_up, 0) * (1 - ref), 0), 1) ELSE ref END"""
LEVERED = f"""grid_t AS (SELECT * EXCLUDE (up), {tie_sql("CASE WHEN up > high THEN up * (1 - alpha_down * least(greatest((abs(pa - pb) - delta_down) / (1 - delta_down), 0), 1)) ELSE up END")} AS cand
  FROM (SELECT *, {UP} AS up FROM (SELECT *, {BASE} AS ref FROM scores), {points_sql(lever_grid.lever_points())})),
lines AS (SELECT * FROM ({audit_sql("grid_t", "point, ")}) JOIN {points_sql(lever_grid.lever_points())} USING (point))
--
"""
PLACE = f"row_number() OVER (ORDER BY {tie_sql('macro_delta')} DESC, point) AS place"
POINT_SPEC = "place:i point:i family:s low:f alpha_up:f delta_up:f high:f alpha_down:f delta_down:f "


def lever_lines(v):
    df = v.scores.withColumn("base", tie(0.7 * F.col("pa") + 0.3 * F.col("pb")))
    cand = lever_grid.lever(*[F.col(c) for c in ("base", "pa", "pb", "pc")])
    return lever_grid.audit_grid(df, lever_grid.lever_points(), lambda s: tie(cand(s)), "base")


@query("l28_parameter_grid", POINT_SPEC + AUDIT_SPEC, LEVERED + f"SELECT *, {PLACE} FROM lines")
def _(v):
    return lever_lines(v)


@query("l28b_class_a_points", "list:s " + POINT_SPEC + AUDIT_SPEC, LEVERED + " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{by}' AS list, *, row_number() OVER (ORDER BY {tie_sql(by)} DESC NULLS LAST, point) AS place
  FROM lines WHERE verdict = 'A' AND family <> 'reference') WHERE place <= 10""" for by in ("d_aves", "macro_delta")))
def _(v):
    lines = lever_lines(v)
    both = [lever_grid.class_a(lines, by).withColumn("list", F.lit(by)) for by in ("d_aves", "macro_delta")]
    return both[0].unionByName(both[1])


CORRECTED = f"""grid_t AS (SELECT *, pa AS ref, {tie_sql("CASE WHEN pa < .5 THEN least(pa + alpha * pb * (1 - pa), 1) WHEN pa > .5 THEN pa * (1 - beta * (1 - pc)) ELSE pa END")} AS cand
  FROM scores, {points_sql(lever_grid.correction_points())}),
lines AS (SELECT * FROM ({audit_sql("grid_t", "point, ")}) JOIN {points_sql(lever_grid.correction_points())} USING (point))
--
"""


@query("l28c_correction_grid", "place:i point:i alpha:f beta:f " + AUDIT_SPEC, CORRECTED + f"SELECT *, {PLACE} FROM lines")
def _(v):
    def cand(s):
        return tie(levers.detector_correction(F.col("pa"), F.col("pb"), 1 - F.col("pc"), s["alpha"], s["beta"]))
    return lever_grid.audit_grid(v.scores, lever_grid.correction_points(), cand, "pa")


@query("l30_self_rank", "class:s n:i mean_above:f mean_self:f", """
SELECT class, count(*) AS n, avg(k) AS mean_above, avg(pb) AS mean_self
FROM (SELECT *, rank() OVER (PARTITION BY file_id, win ORDER BY pb DESC) - 1 AS k FROM scores) WHERE y = 1 GROUP BY 1""")
def _(v):
    return audit.self_rank(v.scores, ROW, "pb")


@query("l31_specialist_audit", "class:s n_rec:i n_sites:i n_pos:i auc_eval:f auc_train:f strict:b loose:b", f"""
SELECT c.class, n_rec, n_sites, c.n_pos, e.auc AS auc_eval, t.auc AS auc_train,
  n_rec >= 300 AND n_sites >= 2 AND e.auc < 0.95 AND e.n_pos >= 3 AS strict, n_rec >= 500 AND n_sites >= 2 AND e.auc < 0.97 AND e.n_pos >= 3 AS loose
FROM (SELECT class, sum(y) AS n_pos, count(DISTINCT CASE WHEN y = 1 THEN site END) AS n_sites FROM scores GROUP BY 1) c
JOIN (SELECT class, count(*) AS n_rec FROM cells GROUP BY 1) r USING (class)
JOIN {auc_sql('(SELECT * FROM scores WHERE fold = 0)', 'class', 'pa')} e USING (class)
JOIN {auc_sql('(SELECT * FROM scores WHERE fold <> 0)', 'class', 'pa')} t USING (class)""")
def _(v):
    return levers.specialist_audit(v.scores, v.cells, "pa", 300, 0.95, 500, 0.97)


@query("l32_fold_stability", "class:s mean:f std:f n_folds:i",
       f"SELECT class, avg(auc) AS mean, stddev_pop(auc) AS std, count(*) AS n_folds FROM {auc_sql('scores', 'class, fold', 'pa')} GROUP BY 1")
def _(v):
    return audit.fold_stability(v.scores, "pa")


@query("l33_f1_threshold", "class:s f1:f threshold:f", """
f AS (SELECT file_id, class, max(pb) AS p, max(y) AS y FROM scores GROUP BY ALL),
g AS (SELECT class, t, sum(y) AS pos, sum(CASE WHEN p >= t THEN y ELSE 0 END) AS tp, sum((p >= t)::INT) AS np
  FROM f, (SELECT unnest([.25, .3, .35, .4, .45, .5, .55, .6, .65, .7]) AS t) GROUP BY ALL),
s AS (SELECT class, t, 2 * (tp / (np + 1e-8)) * (tp / (pos + 1e-8)) / (tp / (np + 1e-8) + tp / (pos + 1e-8) + 1e-8) AS f1 FROM g WHERE pos >= 3)
--
SELECT class, f1, CASE WHEN f1 > 0 THEN t ELSE .5 END AS threshold FROM s QUALIFY row_number() OVER (PARTITION BY class ORDER BY f1 DESC, t) = 1""")
def _(v):
    files = profile.file_level(v.scores, SERIES, "pb")
    return metrics.f1_thresholds(files, "pb", audit.f1_grid())


@query("l34_cumulative_ablation", "stage:s macro:f n_classes:i", f"""
pr AS (SELECT class, site, avg(y) AS prior FROM scores GROUP BY ALL),
st AS (SELECT s.file_id, s.win, s.class, s.y, pb AS a_raw, {tie_sql('pb + 0.3 * prior')} AS b_prior, pb + 0.3 * prior AS bp
  FROM scores s JOIN pr ON pr.class = s.class AND pr.site = s.site),
sm AS (SELECT *, {tie_sql(kernel_sql('bp', smooth.FIVE_TAP))} AS c_smooth,
  {tie_sql(kernel_sql('bp', smooth.gaussian_weights(0.5, 2)))} AS d_gauss FROM st),
u AS (UNPIVOT (SELECT class, y, a_raw, b_prior, c_smooth, d_gauss FROM sm) ON a_raw, b_prior, c_smooth, d_gauss INTO NAME stage VALUE p)
--
SELECT stage, avg(auc) AS macro, count(*) AS n_classes FROM {auc_sql('u', 'stage, class', 'p')} GROUP BY 1""")
def _(v):
    prior = v.scores.groupBy("class", "site").agg(F.avg("y").alias("prior"))
    s = smooth.Series(SERIES, "win")
    df = (v.scores.join(prior, ["class", "site"])
          .withColumn("bp", F.col("pb") + 0.3 * F.col("prior")))
    df = df.select(*SERIES, "y", F.col("pb").alias("a_raw"), tie(F.col("bp")).alias("b_prior"),
                   tie(smooth.kernel(s, "bp", smooth.FIVE_TAP)).alias("c_smooth"),
                   tie(smooth.gaussian(s, "bp", 0.5)).alias("d_gauss"))
    stages = {c: c for c in ("a_raw", "b_prior", "c_smooth", "d_gauss")}
    return metrics.macro_auc(align.unpivot_streams(df, stages, "stage", "p"), ["stage"], "p")


@query("l35_event_bursts", "auc:f n_pos:i mean_voiced:f mean_silent:f", f"""
mg AS (SELECT vec_id, class, (i - 1) // 4 AS st, sqrt(sum(x * x)) AS m FROM vx GROUP BY ALL),
th AS (SELECT avg(m) + 2 * stddev_pop(m) AS t FROM mg),
bc AS (SELECT vec_id, (class < 'c5')::INT AS y, count(*) FILTER (WHERE m > t) AS k, 1 AS one FROM mg, th GROUP BY ALL)
--
SELECT auc, n_pos, (SELECT avg(k) FROM bc WHERE y = 1) AS mean_voiced, (SELECT avg(k) FROM bc WHERE y = 0) AS mean_silent FROM {auc_sql('bc', 'one', 'k')}""")
def _(v):
    steps = F.transform(F.sequence(F.lit(0), F.floor(F.size("emb") / 4).cast("int") - 1),
                        lambda i: F.slice("emb", i * 4 + 1, 4))
    df = v.vecs.withColumn("steps", steps).withColumn("y", (F.col("class") < "c5").cast("int"))
    b = audit.burst_counts(df, "vec_id", "steps").select("y", "n_bursts")
    means = b.agg(F.avg(F.when(F.col("y") == 1, F.col("n_bursts"))).alias("mean_voiced"),
                  F.avg(F.when(F.col("y") == 0, F.col("n_bursts"))).alias("mean_silent"))
    return attach(metrics.auc(b, [], "n_bursts"), means)


@query("l36_distribution_shift", "class:s shift:f ks:f rho:f", f"""
d AS (SELECT class, pa AS p, 0 AS b FROM scores UNION ALL SELECT class, pb, 1 FROM scores),
c AS (SELECT class, p, sum(1 - b) AS a, sum(b) AS b FROM d GROUP BY ALL),
r AS (SELECT class, abs(sum(a) OVER w / sum(a) OVER (PARTITION BY class) - sum(b) OVER w / sum(b) OVER (PARTITION BY class)) AS gap FROM c
  WINDOW w AS (PARTITION BY class ORDER BY p ROWS UNBOUNDED PRECEDING))
--
SELECT m.class, shift, ks, rho FROM (SELECT class, avg(pb) - avg(pa) AS shift FROM scores GROUP BY 1) m
JOIN (SELECT class, max(gap) AS ks FROM r GROUP BY 1) k USING (class) JOIN {rho_sql('class', 'pa', 'pb')} USING (class)""")
def _(v):
    long = align.unpivot_streams(v.scores.select("class", "pa", "pb"), {"A": "pa", "B": "pb"})
    ks = metrics.ks_statistic(long.withColumn("b", (F.col("model") == "B").cast("int")), ["class"], "p", "b")
    shift = v.scores.groupBy("class").agg((F.avg("pb") - F.avg("pa")).alias("shift"))
    return shift.join(ks, "class").join(metrics.column_spearman(v.scores, "pa", "pb"), "class")


@query("l37_stream_difference", "mad:f changed:f n_moved:i most_hurt:s most_helped:s", PAIRED + """
SELECT mad, changed, n_moved, most_hurt, most_helped FROM (SELECT avg(abs(pa - pb)) AS mad, avg((abs(pa - pb) > 1e-6)::INT) AS changed FROM scores),
  (SELECT count(*) FILTER (WHERE abs(delta) > .01) AS n_moved, arg_min(class, delta) AS most_hurt, arg_max(class, delta) AS most_helped FROM pr)""")
def _(v):
    pr = audit.paired_auc(v.scores, ["class"], "pa", "pb").agg(
        F.count_if(F.abs("delta") > .01).alias("n_moved"),
        F.min_by("class", "delta").alias("most_hurt"), F.max_by("class", "delta").alias("most_helped"))
    return attach(audit.stream_difference(v.scores, "pa", "pb"), pr)


@query("l39_site_inflation", "class:s model:s inflation:f", """
SELECT class, model, avg(CASE WHEN site = 'S08' THEN p END) - avg(CASE WHEN site <> 'S08' THEN p END) AS inflation FROM longs GROUP BY ALL""")
def _(v):
    return audit.site_inflation(v.longs, "S08", "p")


TAXROW = """tr AS (SELECT file_id, win, CASE WHEN taxon IN ('Aves', 'Reptilia') THEN 'Aves' ELSE 'Other' END AS tx, max(pa) AS pa, max(pb) AS pb, max(y) AS y FROM scores GROUP BY ALL)
--
"""


def two_taxa(v):
    return v.scores.withColumn("taxon", F.when(F.col("taxon").isin("Aves", "Reptilia"), "Aves")
                               .otherwise("Other"))


@query("l40_taxon_detection", "taxon:s auc_a:f auc_b:f", TAXROW + f"""
SELECT a.tx AS taxon, a.auc AS auc_a, b.auc AS auc_b FROM {auc_sql('tr', 'tx', 'pa')} a JOIN {auc_sql('tr', 'tx', 'pb')} b USING (tx)""")
def _(v):
    rows = audit.taxon_rows(two_taxa(v), ROW, ["pa", "pb"])
    return audit.paired_auc(rows, ["taxon"], "pa", "pb").select(
        "taxon", F.col("auc_ref").alias("auc_a"), F.col("auc_cand").alias("auc_b"))


@query("l40b_agreement_quadrants", "a_says:b b_says:b n_rows:i share_taxon:f share_other:f", """
q AS (SELECT file_id, win, arg_max(taxon IN ('Aves', 'Reptilia'), (pa, class)) AS a_says, arg_max(taxon IN ('Aves', 'Reptilia'), (pb, class)) AS b_says,
  max(CASE WHEN taxon IN ('Aves', 'Reptilia') THEN y ELSE 0 END) AS i, max(CASE WHEN taxon IN ('Aves', 'Reptilia') THEN 0 ELSE y END) AS o FROM scores GROUP BY ALL)
--
SELECT a_says, b_says, count(*) AS n_rows, avg(i) AS share_taxon, avg(o) AS share_other FROM q GROUP BY ALL""")
def _(v):
    return audit.top_taxon_quadrants(two_taxa(v), ROW, "pa", "pb")


@query("l41_kind_profile", "kind:s metric:s n:i mean:f std:f", UNC + ",\n" + KIND + """,
p AS (UNPIVOT (SELECT kind, entropy, top1, margin FROM unc JOIN kinds USING (file_id, win)) ON entropy, top1, margin INTO NAME metric VALUE val)
--
SELECT kind, metric, count(*) AS n, avg(val) AS mean, stddev_pop(val) AS std FROM p GROUP BY ALL""")
def _(v):
    rows = uncertainty(v).drop("site").join(kinds(v), ROW)
    return audit.kind_profile(rows, ["entropy", "top1", "margin"])


@query("l41b_kind_by_site", "site:s BG:i KNOWN_ONLY:i UNK_MIXED:i UNK_ONLY:i", KIND + """
--
SELECT site, count(*) FILTER (WHERE kind = 'BG') AS "BG", count(*) FILTER (WHERE kind = 'KNOWN_ONLY') AS "KNOWN_ONLY",
  count(*) FILTER (WHERE kind = 'UNK_MIXED') AS "UNK_MIXED", count(*) FILTER (WHERE kind = 'UNK_ONLY') AS "UNK_ONLY" FROM kinds GROUP BY 1""")
def _(v):
    return profile.crosstab(kinds(v), "site", "kind", ["BG", "KNOWN_ONLY", "UNK_MIXED", "UNK_ONLY"])
