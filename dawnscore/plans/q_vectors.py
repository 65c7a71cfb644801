"""Registered queries: embedding analytics."""
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnscore.functions import vec
from dawnscore.operators import audit, forest, metrics, rank, vectors as V
from dawnscore.plans.q_metrics import auc_sql, rho_sql
from dawnscore.plans.q_smooth import avg_rank
from dawnscore.plans.registry import query
from dawnscore.plans.views import CLASSES, ROW
from dawnscore.operators.scalars import attach
from dawnscore.sources import tables

CENT = """cent AS (SELECT class, i, avg(x) AS m, count(*) AS n FROM vx GROUP BY ALL HAVING count(*) >= {n}),
ucent AS (SELECT class, i, m / (sqrt(sum(m * m) OVER (PARTITION BY class)) + 1e-9) AS m FROM cent)"""
CENT5 = """cent5 AS (SELECT cls5 AS class, i, avg(x) AS m FROM vx GROUP BY ALL),
ucent5 AS (SELECT class, i, m / (sqrt(sum(m * m) OVER (PARTITION BY class)) + 1e-9) AS m FROM cent5),
sims AS (SELECT u.vec_id, 'F' || u.file_no AS file_id, u.win, c.class, sum(u.x * c.m) AS cos FROM ux u JOIN ucent5 c USING (i) GROUP BY ALL)"""
NN = """uv AS (SELECT vec_id, file_no, site, list(x ORDER BY i) AS u FROM ux GROUP BY ALL),
prs AS (SELECT a.vec_id AS q_id, b.vec_id AS t_id, round(list_dot_product(a.u, b.u), 9) AS sim FROM uv a JOIN uv b
  ON a.vec_id <> b.vec_id AND a.file_no <> b.file_no {extra}),
nn AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY sim DESC, t_id) AS place FROM prs QUALIFY place <= {k})"""
LBL = """lb AS (SELECT vec_id, class AS label FROM vecs UNION SELECT vec_id, 'm' || (vec_id % 4) FROM vecs)"""


def sims5(v, classes=None):
    """Cosines of the score rows that have an embedding to the class centroids."""
    named = v.vecs.withColumn("class", F.col("cls5"))
    keyed = named.withColumn("file_id", F.concat(F.lit("F"), "file_no"))
    return V.centroid_similarity(keyed, V.centroids(named, ["class"]), ["vec_id", "file_id", "win"],
                                 classes=classes)


def labelled(v):
    return v.vecs.withColumn("lbls", F.array_sort(F.array(
        F.col("class"), F.concat(F.lit("m"), (F.col("vec_id") % 4).cast("string")))))


def neighbours(v, k, exclude=("file_no",)):
    return V.knn(v.vecs, "vec_id", k, exclude=exclude)


@query("k01_unit_vectors", "vec_id:i u1:f u64:f self_cos:f", """
SELECT vec_id, max(CASE WHEN i = 1 THEN x END) AS u1, max(CASE WHEN i = 64 THEN x END) AS u64, sum(x * x) AS self_cos FROM ux GROUP BY 1""")
def _(v):
    u = V.with_unit(v.vecs)
    return u.select("vec_id", F.col("unit")[0].alias("u1"), F.col("unit")[63].alias("u64"),
                    vec.dot(F.col("unit"), F.col("unit")).alias("self_cos"))


@query("k02_class_centroid", "class:s n:i pos:i x:f", CENT.format(n=5) + "\n--\nSELECT class, n, i - 1 AS pos, m AS x FROM cent")
def _(v):
    c = V.centroids(v.vecs, ["class"], min_n=5)
    return c.select("class", "n", F.posexplode("centroid").alias("pos", "x"))


@query("k03_centroid_similarity", "vec_id:i class:s cos:f", CENT.format(n=48) + """
--
SELECT v.vec_id, c.class, coalesce(s.cos, -1) AS cos FROM vecs v, (SELECT DISTINCT class FROM vecs) c LEFT JOIN
  (SELECT u.vec_id, c.class, sum(u.x * c.m) AS cos FROM ux u JOIN ucent c USING (i) GROUP BY ALL) s ON s.vec_id = v.vec_id AND s.class = c.class""")
def _(v):
    return V.centroid_similarity(v.vecs, V.centroids(v.vecs, ["class"], min_n=48), ["vec_id"],
                                 classes=[f"c{i}" for i in range(10)])


@query("k04_site_centred", "vec_id:i pos:i x:f", """
d AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY site, i) AS d FROM vx)
--
SELECT vec_id, i - 1 AS pos, d / (sqrt(sum(d * d) OVER (PARTITION BY vec_id)) + 1e-9) AS x FROM d""")
def _(v):
    return V.centred(v.vecs, ["site"]).select("vec_id", F.posexplode("unit").alias("pos", "x"))


@query("k05_knn", "q_id:i t_id:i sim:f place:i", NN.format(k=5, extra="") + "\n--\nSELECT * FROM nn")
def _(v):
    return neighbours(v, 5)


@query("k05b_knn_cross_site", "q_id:i t_id:i sim:f place:i",
       NN.format(k=5, extra="AND a.site <> b.site") + "\n--\nSELECT * FROM nn")
def _(v):
    return neighbours(v, 5, ("file_no", "site"))


ASKING = "vec_id % 50 = 0"  # the stated query set, against all rows


@query("k05c_index_knn", "q_id:i t_id:i sim:f place:i")
def _(v):
    return forest.index_knn(v.vecs, "vec_id", 5, exclude=["file_no"], queries=F.expr(ASKING))


@query("k05d_index_recall", "recall:f n_queries:i")
def _(v):
    found = forest.index_knn(v.vecs, "vec_id", 5, exclude=["file_no"], queries=F.expr(ASKING))
    return forest.recall(found, V.knn(v.vecs, "vec_id", 5, exclude=["file_no"], queries=F.expr(ASKING)))


@query("k06_label_agreement", "agreement:f coverage:f", NN.format(k=5, extra="") + ",\n" + LBL + """,
ov AS (SELECT q_id, t_id, max((b.label IS NOT NULL)::INT) AS o FROM nn JOIN lb a ON a.vec_id = q_id LEFT JOIN lb b ON b.vec_id = t_id AND b.label = a.label GROUP BY ALL)
--
SELECT avg(a) AS agreement, count(*) / (SELECT count(*) FROM vecs) AS coverage FROM (SELECT q_id, avg(o) AS a FROM ov GROUP BY 1)""")
def _(v):
    rows = labelled(v)
    return V.label_agreement(V.neighbour_table(neighbours(v, 5), rows, "vec_id", ["lbls"]), rows, "vec_id")


@query("k06b_random_pairs", "agreement:f n_pairs:i")
def _(v):
    return V.random_pair_agreement(labelled(v), "vec_id")


JAC = NN.format(k=5, extra="") + ",\n" + LBL + """,
iv AS (SELECT q_id, t_id, sum((b.label IS NOT NULL)::INT) AS k FROM nn JOIN lb a ON a.vec_id = q_id LEFT JOIN lb b ON b.vec_id = t_id AND b.label = a.label GROUP BY ALL),
jac AS (SELECT q_id, 1 - avg(k / (4.0 - k)) AS score FROM iv GROUP BY 1)
--
"""


@query("k07_jaccard_disagreement", "q_id:i score:f", JAC + "SELECT vec_id AS q_id, coalesce(score, 0.5) AS score FROM vecs LEFT JOIN jac ON q_id = vec_id")
def _(v):
    rows = labelled(v)
    return V.jaccard_disagreement(V.neighbour_table(neighbours(v, 5), rows, "vec_id", ["lbls"]), rows, "vec_id")


@query("k08_flip_test", "auc:f n_pos:i n_neg:i")
def _(v):
    rows = V.flip_labels(labelled(v), "vec_id", [f"c{i}" for i in range(10)] + [f"m{i}" for i in range(4)])
    rows = rows.withColumn("lbls", F.col("flipped"))
    t = V.neighbour_table(neighbours(v, 5), rows, "vec_id", ["lbls"])
    score = V.jaccard_disagreement(t, rows, "vec_id").withColumn("score", F.round("score", 9))
    flags = rows.select(F.col("vec_id").alias("q_id"), "is_flipped")
    return metrics.auc(score.join(flags, "q_id"), [], "score", "is_flipped")


@query("k09_label_recovery", "n_rows:i top1:f top3:f")
def _(v):
    return V.recover_hidden(neighbours(v, 5), labelled(v), "vec_id")


@query("k10_recall_at_k", "class:s recall:f n:i grp:s", NN.format(k=5, extra="") + ",\n" + LBL + """,
h AS (SELECT a.label AS class, q_id, sum((b.label IS NOT NULL)::INT) AS h FROM nn JOIN lb a ON a.vec_id = q_id LEFT JOIN lb b ON b.vec_id = t_id AND b.label = a.label GROUP BY ALL)
--
SELECT class, avg(h) / 5 AS recall, count(*) AS n, CASE WHEN count(*) >= 60 THEN 'abundant' WHEN count(*) <= 45 THEN 'rare' ELSE 'mid' END AS grp FROM h GROUP BY 1""")
def _(v):
    return V.recall_at_k(V.neighbour_table(neighbours(v, 5), labelled(v), "vec_id", ["lbls"]), 5, 60, 45)


def fired_rows(v):
    """Score cells where the teacher fires, with the row's embedding."""
    keyed = v.vecs.select(F.concat(F.lit("F"), "file_no").alias("file_id"), "win", "vec_id", "emb")
    return (v.scores.filter("pb > 0.45").select(*ROW, "class", F.col("y").alias("is_tp"))
            .join(keyed, ROW))


FIRED = """fx AS (SELECT s.class, s.y AS is_tp, x.vec_id, x.i, x.x FROM scores s JOIN vx x ON s.file_id = 'F' || x.file_no AND s.win = x.win WHERE s.pb > 0.45)"""
LOO = FIRED + """,
tp AS (SELECT class, i, sum(x) AS s, count(*) AS n FROM fx WHERE is_tp = 1 GROUP BY ALL),
rf AS (SELECT fx.*, CASE WHEN is_tp = 1 AND n > 1 THEN (s - x) / (n - 1) ELSE s / n END AS r FROM fx JOIN tp USING (class, i)),
ds AS (SELECT class, 1 - is_tp AS imp, vec_id, round(1 - sum(x * r) / (sqrt(sum(x * x)) + 1e-9) / (sqrt(sum(r * r)) + 1e-9), 9) AS dist FROM rf GROUP BY class, is_tp, vec_id)"""


@query("k11_impostor_auc", "class:s n_tp:i n_imp:i auc:f", LOO + f"""
--
SELECT class, n_neg AS n_tp, n_pos AS n_imp, auc FROM {auc_sql('ds', 'class', 'dist', 'imp')} WHERE n_neg >= 5 AND n_pos >= 3""")
def _(v):
    return V.impostor_auc(V.leave_one_out_distance(fired_rows(v), ["class"]))


@query("k11b_impostor_summary", "n_classes:i mean_auc:f median_auc:f weighted_auc:f share_over_half:f", LOO + f"""
--
SELECT count(*) AS n_classes, avg(auc) AS mean_auc, median(auc) AS median_auc, sum(auc * n_pos) / sum(n_pos) AS weighted_auc,
  avg((auc > .5)::INT) AS share_over_half FROM {auc_sql('ds', 'class', 'dist', 'imp')} WHERE n_neg >= 5 AND n_pos >= 3""")
def _(v):
    return V.impostor_summary(V.impostor_auc(V.leave_one_out_distance(fired_rows(v), ["class"])))


@query("k12_prototype_impostor", "bucket:s n_classes:i mean_auc:f", FIRED + ",\n" + CENT5 + f""",
ds AS (SELECT DISTINCT s.class, 1 - f.is_tp AS imp, s.vec_id, round(1 - s.cos, 9) AS dist FROM fx f JOIN sims s ON s.class = f.class AND s.vec_id = f.vec_id),
a AS (SELECT * FROM {auc_sql('ds', 'class', 'dist', 'imp')} WHERE n_neg >= 5 AND n_pos >= 3)
--
SELECT CASE WHEN k >= 100 THEN 'many' ELSE 'few' END AS bucket, count(*) AS n_classes, avg(auc) AS mean_auc FROM a
JOIN (SELECT cls5 AS class, count(*) AS k FROM vecs GROUP BY 1) USING (class) GROUP BY 1""")
def _(v):
    sims = sims5(v).select("vec_id", "class", F.round(1 - F.col("cos"), 9).alias("dist"))
    d = fired_rows(v).select("vec_id", "class", "is_tp").join(sims, ["vec_id", "class"])
    feats = v.vecs.groupBy(F.col("cls5").alias("class")).agg(F.count(F.lit(1)).alias("k"))
    out = audit.bucketed_auc(V.impostor_auc(d), feats, F.when(F.col("k") >= 100, "many").otherwise("few"))
    return out.withColumnRenamed("macro", "mean_auc")


@query("k13_mahalanobis", "vec_id:i dist:f weight:f")
def _(v):
    return V.mahalanobis(v.vecs, v.vecs.filter("site < 5"), ["vec_id"])


@query("k14_pca", "vec_id:i pc1_abs:f")
def _(v):
    from pyspark.ml.functions import vector_to_array
    p = V.pca(v.vecs, ["vec_id"], 32)
    return p.select("vec_id", F.abs(vector_to_array("features")[0]).alias("pc1_abs"))


@query("k15_cluster_information", "k:i class:s n_pos:i mi:f nmi:f adjusted:f")
def _(v):
    parts = [V.cluster_information(v.vecs, k).withColumn("k", F.lit(k)) for k in (8, 16, 32, 64)]
    return reduce(DataFrame.unionByName, parts)


@query("k15b_site_information", "class:s n_pos:i mi:f nmi:f adjusted:f", """
w AS (SELECT count(*) AS w FROM vecs), a AS (SELECT site, count(*) AS a FROM vecs GROUP BY 1), b AS (SELECT class, count(*) AS b FROM vecs GROUP BY 1),
jt AS (SELECT a.site, b.class, j.y, a.a, CASE WHEN j.y = 1 THEN b.b ELSE w - b.b END AS b, w,
  (SELECT count(*) FROM vecs v WHERE v.site = a.site AND (v.class = b.class) = (j.y = 1)) AS n FROM a, b, w, (VALUES (0), (1)) j(y)),
mi AS (SELECT class, sum(CASE WHEN n > 0 THEN n / w * ln(n * w / (a * b)) ELSE 0 END) AS mi FROM jt GROUP BY 1),
ex AS (SELECT class, sum(x / w * ln(x * w / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(w - a + 1) + lgamma(w - b + 1)
  - lgamma(w + 1) - lgamma(x + 1) - lgamma(a - x + 1) - lgamma(b - x + 1) - lgamma(w - a - b + x + 1))) AS e
  FROM (SELECT *, unnest(range(greatest(1, a + b - w), least(a, b) + 1))::DOUBLE AS x FROM jt) GROUP BY 1),
hg AS (SELECT -sum(a / w * ln(a / w)) AS hg FROM a, w)
--
SELECT class, b AS n_pos, mi, mi / h AS nmi, (mi - e) / ((h + hg) / 2 - e) AS adjusted
FROM (SELECT class, b, -(b / w * ln(b / w) + (1 - b / w) * ln(1 - b / w)) AS h FROM b, w) JOIN mi USING (class) JOIN ex USING (class), hg""")
def _(v):
    return V.presence_information(v.vecs, "site")


@query("k16_site_silhouette", "grouping:s silhouette:f")
def _(v):
    return V.silhouette(v.vecs, "site", 32)


@query("k17_class_correlation", "class:s partner:s r:f place:i", """
c AS (SELECT a.class, b.class AS partner, corr(a.pb, b.pb) AS r FROM scores a JOIN scores b USING (file_id, win) WHERE a.class <> b.class GROUP BY ALL)
--
SELECT *, row_number() OVER (PARTITION BY class ORDER BY r DESC, partner) AS place FROM c QUALIFY place <= 3""")
def _(v):
    return V.class_correlation(v.scores, ROW, "pb", CLASSES, 3)


@query("k18_within_between", "class:s n:i within:f between:f gap:f", """
uv AS (SELECT vec_id, class, list(x ORDER BY i) AS u FROM ux GROUP BY ALL),
pr AS (SELECT a.class, a.class = b.class AS same, list_dot_product(a.u, b.u) AS c FROM uv a JOIN uv b ON a.vec_id <> b.vec_id)
--
SELECT class, (SELECT count(*) FROM vecs v WHERE v.class = pr.class) AS n, avg(CASE WHEN same THEN c END) AS within, avg(CASE WHEN NOT same THEN c END) AS between,
  avg(CASE WHEN same THEN c END) - avg(CASE WHEN NOT same THEN c END) AS gap FROM pr GROUP BY class""")
def _(v):
    return V.within_between(v.vecs)


@query("k19_vector_statistics", "vec_id:i l2:f max_abs:f var:f pr:f gini:f kurtosis:f", """
m AS (SELECT *, avg(x) OVER (PARTITION BY vec_id) AS mu, row_number() OVER (PARTITION BY vec_id ORDER BY abs(x)) AS rk, count(*) OVER (PARTITION BY vec_id) AS n FROM vx)
--
SELECT vec_id, sqrt(sum(x * x)) AS l2, max(abs(x)) AS max_abs, avg(pow(x - mu, 2)) AS var, pow(sum(x * x), 2) / (sum(pow(x, 4)) + 1e-12) AS pr,
  sum((2 * rk - n - 1) * abs(x)) / (max(n) * sum(abs(x)) + 1e-12) AS gini, avg(pow(x - mu, 4)) / (pow(avg(pow(x - mu, 2)), 2) + 1e-12) - 3 AS kurtosis FROM m GROUP BY 1""")
def _(v):
    return V.statistics(v.vecs, ["vec_id"])


@query("k20_ambiguous_vote", "n_rows:i accuracy:f", NN.format(k=5, extra="AND a.site <> b.site") + """,
sv AS (SELECT v.vec_id, s.class, s.pb, s.y FROM scores s JOIN vecs v ON s.file_id = 'F' || v.file_no AND s.win = v.win),
amb AS (SELECT vec_id FROM (SELECT vec_id, pb, row_number() OVER (PARTITION BY vec_id ORDER BY pb DESC, class) AS k FROM sv) GROUP BY 1
  HAVING max(pb) > .3 AND max(pb) - max(CASE WHEN k = 2 THEN pb END) < .2),
vt AS (SELECT q_id, class, round(avg(pb), 9) AS v FROM nn JOIN sv ON sv.vec_id = nn.t_id WHERE q_id IN (SELECT vec_id FROM amb) GROUP BY ALL),
pk AS (SELECT q_id, arg_max(class, (v, class)) AS class FROM vt GROUP BY 1)
--
SELECT count(*) AS n_rows, avg(coalesce(y, 0)) AS accuracy FROM pk LEFT JOIN sv ON sv.vec_id = q_id AND sv.class = pk.class""")
def _(v):
    keyed = v.vecs.select(F.concat(F.lit("F"), "file_no").alias("file_id"), "win", "vec_id")
    sv = v.scores.join(keyed, ROW).select("vec_id", "class", F.col("pb").alias("p"), "y")
    rows = audit.row_uncertainty(sv, ["vec_id"], "p", 5)
    rows = rows.withColumn("is_ambiguous", (F.col("top1") > .3) & (F.col("margin") < .2))
    return V.ambiguous_vote(neighbours(v, 5, ("file_no", "site")), rows, sv, "vec_id")


@query("k21_confusion_targets", "class:s target:s n:i n_pos:i place:i", NN.format(k=10, extra="") + ",\n" + LBL + """,
c AS (SELECT a.label AS class, b.label AS target, count(*) AS n FROM nn JOIN lb a ON a.vec_id = q_id JOIN lb b ON b.vec_id = t_id
  WHERE a.label IN ('c0', 'c1', 'm0') AND b.label NOT IN ('c0', 'c1', 'm0') GROUP BY ALL)
--
SELECT class, target, n, (SELECT count(*) FROM lb WHERE label = c.class) AS n_pos, row_number() OVER (PARTITION BY class ORDER BY n DESC, target) AS place FROM c QUALIFY place <= 3""")
def _(v):
    t = V.neighbour_table(neighbours(v, 10), labelled(v), "vec_id", ["lbls"])
    return V.confusion_targets(t, ["c0", "c1", "m0"])


@query("k22_pool_diversity", "site:i mean_dist:f n:i", """
d AS (SELECT vec_id, site, sqrt(sum(pow(x - m, 2))) AS d FROM (SELECT *, avg(x) OVER (PARTITION BY site, i) AS m FROM vx) GROUP BY ALL)
--
SELECT site, avg(d) AS mean_dist, count(*) AS n FROM d GROUP BY 1""")
def _(v):
    return V.pool_diversity(v.vecs, "site")


@query("k22b_pool_gap", "s1:i s2:i gap:f", """
c AS (SELECT site, i, avg(x) AS m FROM vx GROUP BY ALL)
--
SELECT a.site AS s1, b.site AS s2, sqrt(sum(pow(a.m - b.m, 2))) AS gap FROM c a JOIN c b ON a.i = b.i AND a.site < b.site GROUP BY ALL""")
def _(v):
    return V.pool_gaps(v.vecs, "site")


SUSP = JAC.replace("\n--\n", "") + ",\n" + CENT.format(n=1) + """,
sg AS (SELECT v.vec_id, (v.class >= 'c8')::INT AS y, round(coalesce(j.score, .5), 9) AS knn, round(1 - c.cos, 9) AS own, round(d.l2, 9) AS l2 FROM vecs v LEFT JOIN jac j ON j.q_id = v.vec_id
  JOIN (SELECT u.vec_id, sum(u.x * c.m) AS cos FROM ux u JOIN ucent c ON c.class = u.class AND c.i = u.i GROUP BY 1) c ON c.vec_id = v.vec_id
  JOIN (SELECT vec_id, avg(x) AS l2 FROM vx GROUP BY 1) d ON d.vec_id = v.vec_id),
rk AS (SELECT *, {a} AS a, {b} AS b, {c} AS c, 1 AS one FROM sg),
sp AS (SELECT *, round((a + b + c) / 3, 9) AS s FROM rk)
--
""".format(**{k: f"({avg_rank('1', col)} - 1) / (count(*) OVER () - 1)" for k, col in zip("abc", ("knn", "own", "l2"))})


def suspicion(v):
    rows = labelled(v)
    nn = V.jaccard_disagreement(V.neighbour_table(neighbours(v, 5), rows, "vec_id", ["lbls"]), rows, "vec_id")
    cents = V.centroids(v.vecs, ["class"]).select("class", vec.unit(F.col("centroid")).alias("c"))
    own = V.with_unit(v.vecs).join(cents, "class").select(
        "vec_id", (F.col("class") >= "c8").cast("int").alias("y"),
        F.round(1 - vec.dot(F.col("unit"), F.col("c")), 9).alias("own"),
        F.round(vec.fold(F.transform("emb", lambda x: x.cast("double"))) / F.size("emb"), 9).alias("l2"))
    # read once per signal and by the join: written first, so that neighbours are searched once
    s = tables.stage(own.join(nn.select(F.col("q_id").alias("vec_id"), F.round("score", 9).alias("knn")), "vec_id"), "suspicion")
    return (V.composite_suspicion(s, ["knn", "own", "l2"])
            .withColumn("suspicion", F.round("suspicion", 9)))


@query("k23_composite_suspicion", "vec_id:i suspicion:f", SUSP + "SELECT vec_id, s AS suspicion FROM sp")
def _(v):
    return suspicion(v)


@query("k23b_suspicion_auc", "auc:f sp_knn_own:f sp_knn_l2:f sp_own_l2:f", SUSP + f"""
SELECT auc, (SELECT corr(a, b) FROM sp) AS sp_knn_own, (SELECT corr(a, c) FROM sp) AS sp_knn_l2, (SELECT corr(b, c) FROM sp) AS sp_own_l2 FROM {auc_sql('sp', 'one', 's')}""")
def _(v):
    s = tables.stage(suspicion(v), "suspicion-ranks")
    c = s.agg(metrics.pearson("r_knn", "r_own").alias("sp_knn_own"), metrics.pearson("r_knn", "r_l2").alias("sp_knn_l2"),
              metrics.pearson("r_own", "r_l2").alias("sp_own_l2"))
    return attach(metrics.auc(s, [], "suspicion"), c)


@query("k24_distance_ratio", "vec_id:i d_pos:f d_neg:f ratio:f", """
g AS (SELECT i, avg(CASE WHEN class < 'c3' THEN x END) AS p, avg(CASE WHEN class >= 'c3' THEN x END) AS q FROM vx WHERE site < 5 GROUP BY 1),
d AS (SELECT vec_id, sqrt(sum(pow(x - p, 2))) AS d_pos, sqrt(sum(pow(x - q, 2))) AS d_neg FROM vx JOIN g USING (i) GROUP BY 1)
--
SELECT *, d_pos / (d_neg + 1e-6) AS ratio FROM d""")
def _(v):
    return V.group_distance_ratio(v.vecs, ["vec_id"], F.col("site") < 5, F.col("class") < "c3")
