"""Registered queries: blends and ensembles."""
from pyspark.sql import functions as F

from dawnscore.operators import audit, blend, metrics, profile, rank
from dawnscore.plans.q_metrics import auc_sql, rho_sql, tie, tie_sql
from dawnscore.plans.q_sampling import seeded_sql
from dawnscore.plans.q_smooth import PART, avg_rank, kernel_sql
from dawnscore.plans.registry import query
from dawnscore.plans.views import ROW, SERIES
from dawnscore.operators.smooth import student_weights
from dawnscore.operators.scalars import attach

CELL = "row_id:s class:s "


def z_sql(col, eps="1e-6"):
    return f"(({col} - avg({col}) OVER (PARTITION BY class)) / (stddev_pop({col}) OVER (PARTITION BY class) + {eps}))"


def pct(col):
    return f"{avg_rank('class', col)} / count(*) OVER (PARTITION BY class)"


@query("h01_mean_of_streams", "file_id:s win:i class:s p:f",
       "SELECT file_id, win, class, avg(p) AS p FROM longs GROUP BY ALL")
def _(v):
    return blend.mean_of_streams(v.longs, [*ROW, "class"])


@query("h02_linear_blend", CELL + "p:f", """
SELECT row_id, class, (0.6 * pa + CASE WHEN n > 0 THEN 0.3 * pb ELSE 0 END + 0.1 * pc) / CASE WHEN n > 0 THEN 1.0 ELSE 0.7 END AS p FROM scores""")
def _(v):
    df = v.scores.withColumn("pb", F.when(F.col("n") > 0, F.col("pb")))
    return df.withColumn("p", blend.linear({"pa": 0.6, "pb": 0.3, "pc": 0.1}))


@query("h03_zscore_blend", CELL + "p:f", f"""
SELECT row_id, class, (0.7 * {z_sql('pa')} + 0.3 * {z_sql('pb')}) * (stddev_pop(pa) OVER (PARTITION BY class) + 1e-6)
  + avg(pa) OVER (PARTITION BY class) AS p FROM scores""")
def _(v):
    return blend.zscore_blend(v.scores, {"pa": 0.7, "pb": 0.3}, "p", "pa")


@query("h04_rank_blend", CELL + "p:f",
       f"SELECT row_id, class, 0.7 * {pct('pa')} + 0.3 * {pct('pb')} AS p FROM scores")
def _(v):
    return blend.rank_blend(v.scores, "pa", "pb", "p")


@query("h05_rank_family", CELL + "r_mean:f r_max:f soft:f", f"""
SELECT row_id, class, (ra + rb + rc) / 3 AS r_mean, greatest(ra, rb, rc) AS r_max, 0.8 * pa + 0.2 * (ra + rb + rc) / 3 AS soft
FROM (SELECT *, {pct('pa')} AS ra, {pct('pb')} AS rb, {pct('pc')} AS rc FROM scores)""")
def _(v):
    d = blend.with_ranks(v.scores, ["pa", "pb", "pc"])
    mean = (F.col("rank_pa") + F.col("rank_pb") + F.col("rank_pc")) / 3
    return d.select("row_id", "class", mean.alias("r_mean"),
                    F.greatest("rank_pa", "rank_pb", "rank_pc").alias("r_max"),
                    (0.8 * F.col("pa") + 0.2 * mean).alias("soft"))


@query("h06_max_family", CELL + "mx:f mm:f lift:f", """
SELECT row_id, class, greatest(pa, pb, pc) AS mx, CASE WHEN greatest(pa, pb, pc) > .5 THEN greatest(pa, pb, pc) ELSE (pa + pb + pc) / 3 END AS mm,
  pa + 0.1 * (greatest(pb, pc) - pa) AS lift FROM scores""")
def _(v):
    f = blend.max_family(["pa", "pb", "pc"])
    return v.scores.select("row_id", "class", f["max"].alias("mx"), f["max_or_mean"].alias("mm"),
                           f["lift"].alias("lift"))


@query("h07_confidence_weighted", CELL + "p:f", """
SELECT row_id, class, (pa * abs(pa - .5) * 2 + pb * abs(pb - .5) * 2 + pc * abs(pc - .5) * 2) / (abs(pa - .5) * 2 + abs(pb - .5) * 2 + abs(pc - .5) * 2 + 1e-6) AS p FROM scores""")
def _(v):
    return v.scores.withColumn("p", blend.confidence_weighted(["pa", "pb", "pc"]))


@query("h08_log_sum_exp", CELL + "p:f", """
SELECT row_id, class, (l - min(l) OVER ()) / (max(l) OVER () - min(l) OVER () + 1e-9) AS p FROM (SELECT *, ln(exp(pa) + exp(pb) + exp(pc)) AS l FROM scores)""")
def _(v):
    return blend.log_sum_exp(v.scores, ["pa", "pb", "pc"], "p")


@query("h09_gap_weighted", CELL + "p:f", f"""
g AS (SELECT file_id, win, max(pa) - max(CASE WHEN k = 2 THEN pa END) AS gap FROM
  (SELECT *, row_number() OVER (PARTITION BY file_id, win ORDER BY pa DESC, class) AS k FROM scores) GROUP BY ALL),
w AS (SELECT file_id, win, least(greatest(0.8 + 0.2 * least(greatest((gap - avg(gap) OVER ()) / (stddev_pop(gap) OVER () + 1e-8), -2), 2) / 2, .5), .95) AS w FROM g),
z AS (SELECT *, {z_sql('pa', '1e-8')} AS za, {z_sql('pb', '1e-8')} AS zb FROM scores)
--
SELECT row_id, class, w * za + (1 - w) * zb AS p FROM z JOIN w USING (file_id, win)""")
def _(v):
    return blend.gap_weighted(v.scores, ROW, "pa", "pb", "p")


@query("h10_disagreement_shrink", CELL + "p:f", f"""
z AS (SELECT *, 0.8 * {z_sql('pa', '1e-8')} + 0.2 * {z_sql('pb', '1e-8')} AS base, sqrt(avg(pow(pa - pb, 2)) OVER (PARTITION BY file_id, win)) AS rms FROM scores),
s AS (SELECT *, 0.3 * (rms - min(rms) OVER ()) / (max(rms) OVER () - min(rms) OVER () + 1e-8) AS s, avg(base) OVER (PARTITION BY file_id, win) AS rm FROM z)
--
SELECT row_id, class, (1 - s) * base + s * rm AS p FROM s""")
def _(v):
    return blend.disagreement_shrink(v.scores, ROW, "pa", "pb", "p")


@query("h11_disagreement_pull", CELL + "p:f", """
SELECT row_id, class, (1 - k) * m + k * .5 AS p FROM (SELECT row_id, class, avg(p) AS m, least(stddev_pop(p) / .3, 1) AS k FROM longs GROUP BY ALL)""")
def _(v):
    return v.scores.withColumn("p", blend.disagreement_pull(["pa", "pb", "pc"]))


@query("h12_agreement", CELL + "p:f",
       "SELECT row_id, class, pc * (0.95 + 0.05 * (1 - abs(pa - pb))) AS p FROM scores")
def _(v):
    return v.scores.withColumn("p", blend.agreement(F.col("pc"), F.col("pa"), F.col("pb")))


TOPK = """tk AS (SELECT *, (row_number() OVER (PARTITION BY file_id, win ORDER BY pa DESC, class) <= 2)::INT AS ta,
  (row_number() OVER (PARTITION BY file_id, win ORDER BY pb DESC, class) <= 2)::INT AS tb FROM scores)
--
"""


@query("h13_consensus_lever", CELL + "p:f", TOPK + """
SELECT row_id, class, least(greatest(CASE ta + tb WHEN 2 THEN pa * 1.15 WHEN 1 THEN pa * 0.8 ELSE pa END, 0), 1) AS p FROM tk""")
def _(v):
    d = blend.top_k_flags(v.scores, ROW, ["pa", "pb"], 2)
    return d.withColumn("p", blend.consensus_lever(F.col("pa"), 0.15, 0.2))


@query("h14_rank_where_different", CELL + "p:f", f"""
SELECT row_id, class, CASE WHEN greatest(pa, pb, pc) - least(pa, pb, pc) > .4 THEN (ra + rb + rc) / 3 ELSE pa END AS p
FROM (SELECT *, {pct('pa')} AS ra, {pct('pb')} AS rb, {pct('pc')} AS rc FROM scores)""")
def _(v):
    d = blend.with_ranks(v.scores, ["pa", "pb", "pc"])
    return d.withColumn("p", blend.rank_where_different("pa", ["pa", "pb", "pc"], 0.4))


@query("h15_class_routed", CELL + "w:f ws:f p:f", f"""
fa AS (SELECT a.class, avg(a.auc) AS aa, avg(b.auc) AS ab FROM {auc_sql('scores', 'class, fold', 'pb')} a
  JOIN {auc_sql('scores', 'class, fold', 'pc')} b USING (class, fold) GROUP BY 1 HAVING count(*) >= 2),
wt AS (SELECT class, CASE WHEN aa < .5 AND ab > .7 THEN .2 WHEN ab < .5 AND aa > .7 THEN 1.0 WHEN aa > .7 AND ab > .7 AND ab - aa > .15 THEN .4 ELSE .7 END AS w,
  1 - (.1 + .6 / (1 + exp(-5 * (ab - aa)))) AS ws FROM fa)
--
SELECT row_id, s.class, w, ws, w * pb + (1 - w) * pc AS p FROM scores s JOIN wt ON wt.class = s.class""")
def _(v):
    w = blend.class_fold_auc(v.scores, "pb", "pc").select(
        "class", blend.routed_weight(F.col("auc_a"), F.col("auc_b")).alias("w"),
        blend.soft_routed_weight(F.col("auc_a"), F.col("auc_b")).alias("ws"))
    return v.scores.join(w, "class").withColumn(
        "p", F.col("w") * F.col("pb") + (1 - F.col("w")) * F.col("pc"))


@query("h16_aliveness_routed", CELL + "p:f pc_cont:f", """
q AS (SELECT class, quantile_cont(pb, .99) - 0.75 AS p99 FROM scores GROUP BY 1)
--
SELECT row_id, s.class, w * pb + (1 - w) * pa AS p, wc * pb + (1 - wc) * pa AS pc_cont FROM scores s JOIN
  (SELECT class, CASE WHEN p99 < .1 THEN 0 WHEN p99 < .235 THEN .3 ELSE .7 END AS w, least(greatest(.7 * least(greatest(p99 / .5, 0), 1), 0), .7) AS wc FROM q) q
  ON q.class = s.class""")
def _(v):
    q = rank.quantiles(v.scores, ["class"], "pb", {"p99": .99}).withColumn("p99", F.col("p99") - 0.75)
    state = F.when(F.col("p99") < 0.1, "dead").when(F.col("p99") < 0.235, "semi").otherwise("alive")
    q = q.select("class", blend.aliveness_weight(state).alias("w"),
                 blend.continuous_aliveness(F.col("p99")).alias("wc"))
    d = v.scores.join(q, "class")
    return d.select("row_id", "class",
                    (F.col("w") * F.col("pb") + (1 - F.col("w")) * F.col("pa")).alias("p"),
                    (F.col("wc") * F.col("pb") + (1 - F.col("wc")) * F.col("pa")).alias("pc_cont"))


@query("h16b_multi_criteria", "class:s p99:f entropy:f w_and:f", """
q AS (SELECT class, quantile_cont(pb, .99) AS p99 FROM scores GROUP BY 1),
b AS (SELECT class, least(floor(pb * 20), 19) AS b, count(*) AS k FROM scores GROUP BY ALL),
e AS (SELECT class, -sum(s * log2(s)) AS entropy FROM (SELECT class, k / sum(k) OVER (PARTITION BY class) AS s FROM b) GROUP BY 1)
--
SELECT class, p99, entropy, CASE WHEN p99 < .985 AND entropy > 2.0 THEN 0 ELSE .7 END AS w_and FROM q JOIN e USING (class)""")
def _(v):
    q = rank.quantiles(v.scores, ["class"], "pb", {"p99": .99})
    e = profile.histogram_entropy(v.scores, ["class"], "pb")
    return q.join(e, "class").withColumn(
        "w_and", F.when((F.col("p99") < .985) & (F.col("entropy") > 2.0), 0.0).otherwise(0.7))


@query("h17_row_entropy_routed", CELL + "p:f", """
b AS (SELECT file_id, win, least(floor(pa * 20), 19) AS b, count(*) AS k FROM scores GROUP BY ALL),
e AS (SELECT file_id, win, round(-sum(s * log2(s)), 9) AS h FROM (SELECT file_id, win, k / sum(k) OVER (PARTITION BY file_id, win) AS s FROM b) GROUP BY ALL)
--
SELECT row_id, class, CASE WHEN h > (SELECT median(h) FROM e) THEN .5 * pa + .5 * pb ELSE .7 * pa + .3 * pb END AS p FROM scores JOIN e USING (file_id, win)""")
def _(v):
    e = (profile.histogram_entropy(v.scores, ROW, "pa")
         .withColumn("entropy", F.round("entropy", 9)))
    med = rank.global_quantile(e, "entropy", "med", 0.5)
    w = F.when(F.col("entropy") > F.col("med"), 0.5).otherwise(0.7)
    return (attach(v.scores.join(e, ROW), med)
            .withColumn("p", w * F.col("pa") + (1 - w) * F.col("pb")))


@query("h18_taxon_weights", CELL + "p:f frozen:f", """
SELECT row_id, class, CASE WHEN taxon <> 'Aves' THEN .5 * pa + .5 * pb ELSE .8 * pa + .2 * pb END AS p,
  pa + CASE WHEN taxon <> 'Aves' THEN 0.1 * pb ELSE 0 END AS frozen FROM scores""")
def _(v):
    other = F.col("taxon") != "Aves"
    w = F.when(other, 0.5).otherwise(0.8)
    return v.scores.select("row_id", "class", (w * F.col("pa") + (1 - w) * F.col("pb")).alias("p"),
                           (F.col("pa") + F.when(other, 0.1 * F.col("pb")).otherwise(0)).alias("frozen"))


@query("h19_target_overlay", CELL + "p:f",
       f"SELECT row_id, class, CASE WHEN class IN ('view', 'error') THEN .7 * pa + .3 * {z_sql('pb')} ELSE pa END AS p FROM scores")
def _(v):
    d = blend.class_stats(v.scores, ["pb"])
    mix = 0.7 * F.col("pa") + 0.3 * blend.z("pb")
    return d.withColumn("p", F.when(F.col("class").isin("view", "error"), mix).otherwise(F.col("pa")))


RESCUE = f"""s0 AS (SELECT *, least(greatest(pa, 1e-6), 1 - 1e-6) AS a, least(greatest(pb, 1e-6), 1 - 1e-6) AS b FROM scores),
s1 AS (SELECT *, {pct('a')} AS ra, {pct('b')} AS rb, {tie_sql(kernel_sql('a', student_weights()))} AS ctx FROM s0),
s2 AS (SELECT *, {pct('ctx')} AS rc, a > .5 AND b < .05 AS fake FROM s1),
s3 AS (SELECT *, rc > .88 AND ra > .75 AND b < .12 AND NOT fake AS cont FROM s2),
s4 AS (SELECT *, rb > .95 AND ra < .8 AND NOT fake AND NOT cont AS spike, .7 * ra + .3 * rb AS p0 FROM s3),
rescued AS (SELECT *, CASE WHEN fake THEN .88 * p0 + .12 * ra WHEN cont THEN .85 * p0 + .15 * greatest(ra, rc)
  WHEN spike THEN .88 * p0 + .12 * rb ELSE p0 END AS p FROM s4)"""


@query("h20_rescue_rules", CELL + "p:f", RESCUE + "\n--\nSELECT row_id, class, p FROM rescued")
def _(v):
    return blend.rescue_rules(v.scores, "pa", "pb", "p", tie=tie)


@query("h21_shift_mean", "file_id:s class:s win:i p:f", """
SELECT s.file_id, s.class, s.win, (s.pa + a.pb + b.pc) / 3 AS p FROM scores s
JOIN scores a ON a.file_id = s.file_id AND a.class = s.class AND a.win = (s.win - 1 + 12) % 12
JOIN scores b ON b.file_id = s.file_id AND b.class = s.class AND b.win = (s.win + 1) % 12""")
def _(v):
    shift = F.when(F.col("model") == "A", 0).when(F.col("model") == "B", 1).otherwise(-1)
    return blend.shift_mean(v.longs.withColumn("shift", shift), SERIES, "p", [-1, 0, 1])


SWEEP = [i / 20 for i in range(6, 16)]  # 0.30 to 0.75


@query("h22_weight_sweep", "w:s macro:f n_classes:i best:b", f"""
f AS (SELECT w, file_id, class, max(y) AS y, {tie_sql('max(w * pa + (1 - w) * pb)')} AS p FROM
  scores, (SELECT i / 20.0 AS w FROM range(6, 16) t(i)) GROUP BY ALL),
m AS (SELECT printf('%.2f', w) AS w, avg(auc) AS macro, count(*) AS n_classes FROM {auc_sql('f', 'w, class', 'p')} GROUP BY 1)
--
SELECT *, row_number() OVER (ORDER BY {tie_sql('macro')} DESC, w) = 1 AS best FROM m""")
def _(v):
    return blend.weight_sweep(v.scores, "pa", "pb", SWEEP, tie=tie)


@query("h23_best_class_weight", "class:s w:s auc:f", f"""
m AS (SELECT class, y, printf('%.2f', w / 20.0) AS w, {tie_sql('(w / 20.0) * pb + (1 - w / 20.0) * pc')} AS p FROM scores, range(21) t(w)),
a AS (SELECT * FROM {auc_sql('m', 'class, w', 'p')})
--
SELECT class, arg_max(w, (round(auc, 9), -CAST(w AS DOUBLE))) AS w, max(auc) AS auc FROM a GROUP BY 1""")
def _(v):
    return blend.best_class_weight(v.scores, "pb", "pc", [i / 20 for i in range(21)], tie=tie)


@query("h24_masked_passes", CELL + "p:f", f"""
SELECT row_id, class, pa * ({' + '.join(f"(({seeded_sql('class', 42 + i)} % 10000) >= 2000)::INT" for i in range(5))}) / 5.0 AS p FROM scores""")
def _(v):
    return blend.masked_passes(v.scores, "pa", "p", share=0.2)


@query("l29_factor_ablation", "variant:s macro:f n_classes:i", RESCUE + f""",
v AS (SELECT class, y, {tie_sql('.7 * pa + .3 * pb')} AS linear, {tie_sql('p0')} AS rank_plain, {tie_sql('p')} AS rank_rescued, pa AS only_a, pb AS only_b FROM rescued),
u AS (UNPIVOT v ON linear, rank_plain, rank_rescued, only_a, only_b INTO NAME variant VALUE p)
--
SELECT variant, avg(auc) AS macro, count(*) AS n_classes FROM {auc_sql('u', 'variant, class', 'p')} GROUP BY 1""")
def _(v):
    from dawnscore.operators.align import unpivot_streams
    d = blend.rescue_rules(v.scores, "pa", "pb", "p", tie=tie)
    d = d.select("class", "y", tie(0.7 * F.col("pa") + 0.3 * F.col("pb")).alias("linear"),
                 tie(0.7 * F.col("rank_a") + 0.3 * F.col("rank_b")).alias("rank_plain"),
                 tie(F.col("p")).alias("rank_rescued"), F.col("pa").alias("only_a"),
                 F.col("pb").alias("only_b"))
    names = ["linear", "rank_plain", "rank_rescued", "only_a", "only_b"]
    return metrics.macro_auc(unpivot_streams(d, {n: n for n in names}, "variant", "p"),
                             ["variant"], "p")
