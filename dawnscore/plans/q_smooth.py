"""Registered queries: normalisation, smoothing and sequence features."""
from pyspark.sql import functions as F

from dawnscore.functions.scalar import (ACKLAM_A, ACKLAM_B, ACKLAM_C, ACKLAM_D, logit,
                                         sigmoid)
from dawnscore.operators import normalize as Z
from dawnscore.operators import profile, rank, smooth, trust
from dawnscore.plans.registry import query
from dawnscore.plans.views import ROW, SERIES

CELL = "row_id:s class:s "
PART = "PARTITION BY file_id, class"
SER = f"{PART} ORDER BY win"


def series():
    return smooth.Series(SERIES, "win")


def avg_rank(part, col):
    """Average-tie rank in check SQL."""
    return (f"(rank() OVER (PARTITION BY {part} ORDER BY {col}) + "
            f"(count(*) OVER (PARTITION BY {part}, {col}) - 1) / 2.0)")


def at(col, k, part=PART):
    """Edge-repeating offset in check SQL."""
    if k == 0:
        return col
    fn, end, order = ("lag", "first_value", "win") if k < 0 else ("lead", "first_value", "win DESC")
    return (f"coalesce({fn}({col}, {abs(k)}) OVER ({part} ORDER BY win), "
            f"{end}({col}) OVER ({part} ORDER BY {order}))")


def kernel_sql(col, weights):
    r = len(weights) // 2
    return " + ".join(f"{w!r} * {at(col, k)}" for k, w in zip(range(-r, r + 1), weights))


@query("e01_percentile_rank", CELL + "r:f",
       f"SELECT row_id, class, {avg_rank('class', 'pa')} / count(*) OVER (PARTITION BY class) AS r FROM scores")
def _(v):
    return rank.add_rank(v.scores, ["class"], "pa", "r")


@query("e02_unit_rank", CELL + "r:f",
       f"SELECT row_id, class, ({avg_rank('class', 'pb')} - 1) / (count(*) OVER (PARTITION BY class) - 1) AS r FROM scores")
def _(v):
    return rank.add_rank(v.scores, ["class"], "pb", "r", "unit")


def poly_sql(coefs, x):
    out = repr(coefs[0])
    for k in coefs[1:]:
        out = f"({out}) * {x} + {k!r}"
    return f"({out})"


@query("e03_quantile_normal", CELL + "p:f", f"""
r AS (SELECT row_id, class, {avg_rank('class', 'pa')} / (count(*) OVER (PARTITION BY class) + 1.0) AS r FROM scores),
q AS (SELECT *, r - .5 AS m, pow(r - .5, 2) AS m2, sqrt(-2 * ln(r)) AS ql, sqrt(-2 * ln(1 - r)) AS qh FROM r),
z AS (SELECT *, CASE WHEN r < .02425 THEN {poly_sql(ACKLAM_C, 'ql')} / {poly_sql(ACKLAM_D, 'ql')}
  WHEN r > 1 - .02425 THEN -{poly_sql(ACKLAM_C, 'qh')} / {poly_sql(ACKLAM_D, 'qh')}
  ELSE {poly_sql(ACKLAM_A, 'm2')} * m / {poly_sql(ACKLAM_B, 'm2')} END AS z FROM q)
--
SELECT row_id, class, 1 / (1 + exp(-z)) AS p FROM z""")
def _(v):
    return Z.quantile_normal(v.scores, ["class"], "pa", "p")


@query("e04_file_rank", CELL + "r:f",
       f"SELECT row_id, class, {avg_rank('file_id, class', 'pa')} / count(*) OVER ({PART}) AS r FROM scores")
def _(v):
    return v.scores.withColumn("r", rank.small_rank(SERIES, "pa") / rank.small_count(SERIES))


@query("e05_class_rank", CELL + "r:f",
       f"SELECT row_id, class, {avg_rank('row_id', 'pa')} / count(*) OVER (PARTITION BY row_id) AS r FROM scores")
def _(v):
    return v.scores.withColumn("r", rank.small_rank(ROW, "pa") / rank.small_count(ROW))


@query("e06_reference_cdf", CELL + "cdf:f", """
SELECT e.row_id, e.class, (SELECT count(*) FROM scores t WHERE t.fold <> 0 AND t.class = e.class AND t.pa < e.pa) * 1.0
  / (SELECT count(*) FROM scores t WHERE t.fold <> 0 AND t.class = e.class) AS cdf FROM scores e WHERE e.fold = 0""")
def _(v):
    return rank.reference_cdf(v.scores.filter("fold <> 0"), v.scores.filter("fold = 0"), ["class"],
                              "pa", "cdf")


@query("e07_class_zscore", CELL + "z:f zt:f", """
SELECT row_id, class, (pa - avg(pa) OVER w) / (stddev_pop(pa) OVER w + 1e-8) AS z,
  (pa - avg(pa) FILTER (WHERE fold <> 0) OVER w) / (stddev_pop(pa) FILTER (WHERE fold <> 0) OVER w + 1e-8) AS zt
FROM scores WINDOW w AS (PARTITION BY class)""")
def _(v):
    z = Z.zscore(v.scores, ["class"], "pa", "z")
    return Z.zscore(z, ["class"], "pa", "zt", fit=v.scores.filter("fold <> 0"))


@query("e08_file_zscore", CELL + "p:f", f"""
SELECT row_id, class, 1 / (1 + exp(-(l - avg(l) OVER ({PART})) / (stddev_pop(l) OVER ({PART}) + 1e-6))) AS p FROM (
  SELECT *, ln(q / (1 - q)) AS l FROM (SELECT *, least(greatest(pb, 1e-6), 1 - 1e-6) AS q FROM scores))""")
def _(v):
    return Z.file_zscore(v.scores, SERIES, "pb", "p")


@query("e09_site_zscore", "file_id:s win:i z:f", """
SELECT file_id, win, CASE WHEN count(*) OVER w < 2 THEN 0 ELSE (m - avg(m) OVER w) / (stddev_pop(m) OVER w + 1e-9) END AS z
FROM (SELECT file_id, win, site, max(pa) AS m FROM scores GROUP BY ALL) WINDOW w AS (PARTITION BY site)""")
def _(v):
    rows = v.scores.groupBy(*ROW, "site").agg(F.max("pa").alias("m"))
    return Z.site_zscore(rows, "m", "z")


@query("e10_file_centre", CELL + "p:f", f"""
SELECT row_id, class, least(greatest(pa - avg(pa) OVER ({PART}) + avg(pa) OVER (PARTITION BY class), 0), 1) AS p FROM scores""")
def _(v):
    return Z.file_centre(v.scores, "pa", "p")


@query("e11_taxon_centre", CELL + "p:f", f"""
SELECT row_id, class, CASE WHEN taxon IN ('Amphibia', 'Insecta') THEN pa - 0.5 * avg(pa) OVER ({PART}) ELSE pa END AS p FROM scores""")
def _(v):
    return Z.taxon_centre(v.scores, "pa", "p", ["Amphibia", "Insecta"], 0.5)


@query("e12_target_std", CELL + "p:f", """
SELECT row_id, class, least(greatest(avg(pa) OVER w + 0.2 / (stddev_pop(pa) OVER w + 1e-8) * (pa - avg(pa) OVER w), 0), 1) AS p
FROM scores WINDOW w AS (PARTITION BY class)""")
def _(v):
    return Z.target_std(v.scores, "pa", "p")


@query("e13_neighbour_blend", CELL + "p:f",
       f"SELECT row_id, class, 0.65 * pa + 0.175 * ({at('pa', -1)} + {at('pa', 1)}) AS p FROM scores")
def _(v):
    return v.scores.withColumn("p", smooth.neighbour_blend(series(), "pa", 0.35))


@query("e14_local_max", CELL + "p:f",
       f"SELECT row_id, class, 0.7 * pa + 0.3 * greatest({at('pa', -1)}, pa, {at('pa', 1)}) AS p FROM scores")
def _(v):
    return v.scores.withColumn("p", smooth.local_max(series(), "pa", 0.3))


@query("e15_adaptive_blend", CELL + "p:f", f"""
SELECT row_id, class, (1 - a) * pa + a * 0.5 * ({at('pa', -1)} + {at('pa', 1)}) AS p
FROM (SELECT *, 0.2 * (1 - max(pa) OVER (PARTITION BY file_id, win)) AS a FROM scores)""")
def _(v):
    return smooth.adaptive_blend(v.scores, "pa", "p")


@query("e15b_adaptive_blend_inner", CELL + "p:f", f"""
SELECT row_id, class, CASE WHEN win IN (0, 11) THEN pa ELSE (1 - a) * pa + a * 0.5 * ({at('pa', -1)} + {at('pa', 1)}) END AS p
FROM (SELECT *, 0.35 * (1 - max(pa) OVER (PARTITION BY file_id, win)) AS a FROM scores)""")
def _(v):
    return smooth.adaptive_blend(v.scores, "pa", "p", 0.35, skip_edges=True)


@query("e16_five_tap", CELL + "p:f",
       f"SELECT row_id, class, {kernel_sql('pa', smooth.FIVE_TAP)} AS p FROM scores")
def _(v):
    return v.scores.withColumn("p", smooth.kernel(series(), "pa", smooth.FIVE_TAP))


@query("e17_gaussian_truncated", CELL + "p:f", """
SELECT s.row_id, s.class, sum(exp(-pow(t.win - s.win, 2) / (2 * 0.49)) * t.pa) / sum(exp(-pow(t.win - s.win, 2) / (2 * 0.49))) AS p
FROM scores s JOIN scores t ON t.file_id = s.file_id AND t.class = s.class AND abs(t.win - s.win) <= 3 GROUP BY ALL""")
def _(v):
    return v.scores.withColumn("p", smooth.gaussian_truncated(series(), "pa", 0.7))


@query("e18_gaussian_nearest", CELL + "p:f pl:f", f"""
SELECT row_id, class, {kernel_sql('pa', smooth.gaussian_weights(0.5, 2))} AS p,
  1 / (1 + exp(-({kernel_sql('l', smooth.gaussian_weights(1.0, 4))}))) AS pl
FROM (SELECT *, ln(q / (1 - q)) AS l FROM (SELECT *, least(greatest(pa, 1e-6), 1 - 1e-6) AS q FROM scores))""")
def _(v):
    s = series()
    df = v.scores.withColumn("l", logit(F.col("pa")))
    return df.select(*df.columns, smooth.gaussian(s, "pa", 0.5).alias("p"),
                     sigmoid(smooth.gaussian(s, "l", 1.0)).alias("pl"))


@query("e18b_gaussian_reflect", CELL + "p:f", """
SELECT row_id, class, sum(w * x) / sum(w) AS p FROM (
  SELECT s.row_id, s.class, exp(-k * k / 2.0) AS w, t.pa AS x FROM scores s, (SELECT range AS k FROM range(-4, 5)) o
  JOIN scores t ON t.file_id = s.file_id AND t.class = s.class
    AND t.win = CASE WHEN s.win + k < 0 THEN -(s.win + k) - 1 WHEN s.win + k > 11 THEN 23 - (s.win + k) ELSE s.win + k END)
GROUP BY ALL""")
def _(v):
    return v.scores.withColumn("p", smooth.gaussian(series(), "pa", 1.0, "reflect"))


@query("e19_multi_sigma", CELL + "p:f ad:f", f"""
SELECT row_id, class, ({kernel_sql('pa', smooth.gaussian_weights(0.3, 1))}) / 3 + ({kernel_sql('pa', smooth.gaussian_weights(0.5, 2))}) / 3
  + ({kernel_sql('pa', smooth.gaussian_weights(0.7, 3))}) / 3 AS p,
  CASE WHEN quantile_cont(pb, .99) OVER (PARTITION BY class) < 0.985 THEN {kernel_sql('pa', smooth.gaussian_weights(1.0, 4))}
    ELSE {kernel_sql('pa', smooth.gaussian_weights(0.5, 2))} END AS ad FROM scores""")
def _(v):
    s = series()
    tails = rank.quantiles(v.scores, ["class"], "pb", {"p99": .99})
    out = v.scores.select("*", smooth.multi_sigma(s, "pa", [.3, .5, .7]).alias("p"))
    out = out.join(tails, "class")
    return out.withColumn("ad", smooth.adaptive_sigma(s, "pa", F.col("p99") < 0.985))


@query("e20_fat_tail", CELL + "p:f",
       f"SELECT row_id, class, {kernel_sql('pa', smooth.student_weights())} AS p FROM scores")
def _(v):
    return v.scores.withColumn("p", smooth.fat_tail(series(), "pa"))


@query("e21_sharpened", CELL + "p:f p3:f", f"""
short AS (SELECT row_id, class, 0.2 * {at('pa', -1)} + 0.6 * pa + 0.2 * {at('pa', 1)} AS p3 FROM scores WHERE win < 4)
--
SELECT s.row_id, s.class, p, p3 FROM (SELECT row_id, class, pow({kernel_sql('q', (0.05, 0.15, 0.60, 0.15, 0.05))}, 1 / 1.5) AS p
  FROM (SELECT *, pow(pa, 1.5) AS q FROM scores)) s LEFT JOIN short USING (row_id, class)""")
def _(v):
    full = smooth.sharpened(v.scores, SERIES, "win", "pa", "p")
    short = smooth.sharpened(v.scores.filter("win < 4"), SERIES, "win", "pa", "p3")
    return full.join(short.select("row_id", "class", "p3"), ["row_id", "class"], "left")


@query("e22_median", CELL + "p:f", f"""
SELECT row_id, class, list_sort([{', '.join(at('pa', k) for k in (-1, 0, 1))}])[2] AS p FROM scores""")
def _(v):
    return v.scores.withColumn("p", smooth.median_filter(series(), "pa", 3))


@query("e23_ema", "file_id:s class:s win:i p:f", """
fw AS (SELECT s.file_id, s.class, s.win, sum(t.pa * CASE WHEN t.win = 0 THEN pow(0.6, s.win) ELSE 0.4 * pow(0.6, s.win - t.win) END) AS f
  FROM scores s JOIN scores t ON t.file_id = s.file_id AND t.class = s.class AND t.win <= s.win GROUP BY ALL),
bw AS (SELECT s.file_id, s.class, s.win, sum(t.pa * CASE WHEN t.win = 11 THEN pow(0.6, 11 - s.win) ELSE 0.4 * pow(0.6, t.win - s.win) END) AS b
  FROM scores s JOIN scores t ON t.file_id = s.file_id AND t.class = s.class AND t.win >= s.win GROUP BY ALL)
--
SELECT file_id, class, win, 0.5 * (f + b) AS p FROM fw JOIN bw USING (file_id, class, win)""")
def _(v):
    return smooth.ema_two_pass(v.scores, SERIES, "win", "pa", "p", 0.4)


def kalman_sql(z, q, r, p0, update_first):
    """Forward filter as a recursive CTE rec_f(file_id, class, win, x, p) over base(…, win, z)."""
    start = f"(1 - ({p0} + {q}) / ({p0} + {q} + {r})) * ({p0} + {q})" if update_first else f"{p0}"
    return f"""base AS (SELECT file_id, class, win, {z} AS z FROM scores),
rec_f AS (SELECT file_id, class, win, z AS x, CAST({start} AS DOUBLE) AS p FROM base WHERE win = 0
  UNION ALL SELECT s.file_id, s.class, s.win, k.x + (k.p + {q}) / (k.p + {q} + {r}) * (s.z - k.x), (1 - (k.p + {q}) / (k.p + {q} + {r})) * (k.p + {q})
  FROM rec_f k JOIN base s ON s.file_id = k.file_id AND s.class = k.class AND s.win = k.win + 1)"""


def rts_sql(gain):
    return f"""rec_s AS (SELECT file_id, class, win, x FROM rec_f WHERE win = 11
  UNION ALL SELECT f.file_id, f.class, f.win, f.x + {gain} * (s.x - f.x) FROM rec_s s JOIN rec_f f ON f.file_id = s.file_id AND f.class = s.class AND f.win = s.win - 1)"""


LOGIT_PA = "ln(least(greatest(pa, 1e-6), 1 - 1e-6) / (1 - least(greatest(pa, 1e-6), 1 - 1e-6)))"


def hmm_sql(rates, prior, eps):
    """Forward-backward posterior; rates is a CTE body giving class, p01, p10."""
    return f"""rates AS ({rates}),
base AS (SELECT file_id, s.class, win, least(greatest(pa, {eps}), 1 - {eps}) AS e, p01, p10 FROM scores s JOIN rates r ON r.class = s.class),
rec_f AS (SELECT file_id, class, win, (1 - {prior}) * (1 - e) / ((1 - {prior}) * (1 - e) + {prior} * e) AS a, {prior} * e / ((1 - {prior}) * (1 - e) + {prior} * e) AS b FROM base WHERE win = 0
  UNION ALL SELECT s.file_id, s.class, s.win, ((1 - p01) * a + p10 * b) * (1 - e) / (((1 - p01) * a + p10 * b) * (1 - e) + (p01 * a + (1 - p10) * b) * e),
    (p01 * a + (1 - p10) * b) * e / (((1 - p01) * a + p10 * b) * (1 - e) + (p01 * a + (1 - p10) * b) * e)
  FROM rec_f k JOIN base s ON s.file_id = k.file_id AND s.class = k.class AND s.win = k.win + 1),
rec_b AS (SELECT file_id, class, win, CAST(1 AS DOUBLE) AS a, CAST(1 AS DOUBLE) AS b FROM base WHERE win = 11
  UNION ALL SELECT k.file_id, k.class, k.win - 1, ((1 - p01) * (1 - e) * a + p01 * e * b) / ((1 - p01) * (1 - e) * a + p01 * e * b + p10 * (1 - e) * a + (1 - p10) * e * b),
    (p10 * (1 - e) * a + (1 - p10) * e * b) / ((1 - p01) * (1 - e) * a + p01 * e * b + p10 * (1 - e) * a + (1 - p10) * e * b)
  FROM rec_b k JOIN base s ON s.file_id = k.file_id AND s.class = k.class AND s.win = k.win WHERE k.win > 0)
--
SELECT file_id, class, win, f.b * k.b / (f.a * k.a + f.b * k.b) AS p FROM rec_f f JOIN rec_b k USING (file_id, class, win)"""


def literal_rates(p01, p10):
    return f"SELECT class, {p01} AS p01, {p10} AS p10 FROM tax"


@query("e24_kalman", "file_id:s class:s win:i p:f", kalman_sql("pa", 0.1, 0.3, 0.3, True) + """
--
SELECT file_id, class, win, x AS p FROM rec_f""")
def _(v):
    return smooth.kalman(v.scores, SERIES, "win", "pa", "p")


@query("e25_kalman_rts", "file_id:s class:s win:i p:f", kalman_sql("pa", 0.01, 0.1, 1e6, False) + ",\n" + rts_sql("f.p / (f.p + 0.01)") + """
--
SELECT file_id, class, win, x AS p FROM rec_s""")
def _(v):
    return smooth.kalman_rts(v.scores, SERIES, "win", "pa", "p", 0.01, 0.1)


@query("e25b_kalman_logit", "file_id:s class:s win:i p:f", kalman_sql(LOGIT_PA, 0.1, 0.5, 0.5, False) + ",\n" + rts_sql("0.1 / 0.6") + """
--
SELECT file_id, class, win, 1 / (1 + exp(-x)) AS p FROM rec_s""")
def _(v):
    df = v.scores.withColumn("l", logit(F.col("pa")))
    out = smooth.kalman_rts(df, SERIES, "win", "l", "s", 0.1, 0.5, p0=0.5, fixed_gain=True)
    return out.withColumn("p", sigmoid(F.col("s")))


@query("e26_hmm", "file_id:s class:s win:i p:f", hmm_sql(literal_rates(0.1, 0.3), 0.1, 1e-3))
def _(v):
    return smooth.hmm_posterior(v.scores, SERIES, "win", "pa", "p", F.lit(0.1), F.lit(0.3))


@query("e26b_hmm_stay", "file_id:s class:s win:i p:f", hmm_sql(literal_rates(0.3, 0.3), 0.5, 1e-6))
def _(v):
    return smooth.hmm_posterior(v.scores, SERIES, "win", "pa", "p", F.lit(0.3), F.lit(0.3),
                                prior=0.5, eps=1e-6)


@query("e26c_hmm_class_rates", "file_id:s class:s win:i p:f", hmm_sql("""SELECT class, sum((q = 0 AND y = 1)::INT) / sum((q = 0)::INT) AS p01, sum((q = 1 AND y = 0)::INT) / sum((q = 1)::INT) AS p10
  FROM (SELECT class, y, lag(y) OVER (PARTITION BY file_id, class ORDER BY win) AS q FROM scores) WHERE q IS NOT NULL GROUP BY 1""", 0.1, 1e-3))
def _(v):
    rates = profile.transitions(v.scores)
    df = v.scores.join(rates, "class")
    return smooth.hmm_posterior(df, SERIES, "win", "pa", "p", F.col("p01"), F.col("p10"),
                                keep=["p01", "p10"])


@query("e27_trust_filter", "file_id:s win:i class:s p:f")
def _(v):
    return trust.trust_filter(v.scores, ["pa", "pb", "pc"])


@query("e28_file_max", CELL + "p:f",
       f"SELECT row_id, class, 0.9 * pa + 0.1 * max(pa) OVER ({PART}) AS p FROM scores")
def _(v):
    return Z.coherence(v.scores, SERIES, "pa", "p")


@query("e29_file_coherence", CELL + "p:f", f"""
SELECT row_id, class, 0.75 * pa + 0.1 * max(pa) OVER ({PART}) + 0.1 * avg(pa) OVER ({PART})
  + 0.05 * quantile_cont(pa, 0.85) OVER ({PART}) AS p FROM scores""")
def _(v):
    return Z.coherence(v.scores, SERIES, "pa", "p", 0.10, 0.10, 0.05)


@query("e30_rank_aware", CELL + "p:f",
       f"SELECT row_id, class, pa * pow(greatest(max(pa) OVER ({PART}), 1e-9), 0.4) AS p FROM scores")
def _(v):
    return Z.rank_aware(v.scores, SERIES, "pa", "p")


@query("e31_file_confidence", CELL + "p:f legacy:f", f"""
SELECT row_id, s.class, pa * pow(m, 0.4) AS p, pa * m AS legacy FROM scores s JOIN (
  SELECT file_id, class, avg(pa) AS m FROM (SELECT *, row_number() OVER ({PART} ORDER BY pa DESC) AS k FROM scores)
  WHERE k <= 2 GROUP BY ALL) t ON t.file_id = s.file_id AND t.class = s.class""")
def _(v):
    a = Z.file_confidence(v.scores, SERIES, "pa", "p")
    return Z.file_confidence(a, SERIES, "pa", "legacy", power=1.0)


@query("e32_max_leak", CELL + "p:f",
       f"SELECT row_id, class, pa + 0.05 * max(pa) OVER ({PART}) AS p FROM scores")
def _(v):
    return Z.max_leak(v.scores, SERIES, "pa", "p")


@query("e33_tail_power", CELL + "p:f", """
SELECT row_id, s.class, CASE WHEN k > 2 THEN pa * pa ELSE pa END AS p FROM scores s JOIN (
  SELECT file_id, class, row_number() OVER (PARTITION BY file_id ORDER BY m DESC, class) AS k
  FROM (SELECT file_id, class, max(pa) AS m FROM scores GROUP BY ALL)) t ON t.file_id = s.file_id AND t.class = s.class""")
def _(v):
    return Z.tail_power(v.scores, "pa", "p", top=2)


FEATS = f"""{at('pa', -1)} AS prev, {at('pa', 1)} AS next, avg(pa) OVER ({PART}) AS s_mean, max(pa) OVER ({PART}) AS s_max,
  stddev_pop(pa) OVER ({PART}) AS s_std"""


@query("e34_sequence_features", CELL + "prev:f next:f s_mean:f s_max:f s_std:f",
       f"SELECT row_id, class, {FEATS} FROM scores")
def _(v):
    return smooth.sequence_features(v.scores, SERIES, "win", "pa")


@query("e35_interaction_features",
       CELL + "s_std:f d_mean:f d_prev:f d_next:f raw_prior:f raw_base:f prior_base:f", f"""
SELECT row_id, class, s_std, pa - s_mean AS d_mean, pa - prev AS d_prev, pa - next AS d_next, pb * pc AS raw_prior,
  pb * pa AS raw_base, pc * pa AS prior_base FROM (SELECT *, {FEATS} FROM scores)""")
def _(v):
    return smooth.interaction_features(v.scores, SERIES, "win", "pb", "pc", "pa")


@query("e36_window_position", "file_id:s class:s win:i pos:i", f"""
SELECT file_id, class, win, row_number() OVER ({SER}) - 1 AS pos FROM cells""")
def _(v):
    return smooth.window_position(v.cells, SERIES, "win")


@query("e37_context_stack", "vec_id:i dims:i first:f middle:f last:f", f"""
SELECT vec_id, 3 * len(embedding) AS dims, {at('embedding[1]', -1, 'PARTITION BY file_no')} AS first,
  embedding[1] AS middle, {at('embedding[len(embedding)]', 1, 'PARTITION BY file_no')} AS last FROM vecs""")
def _(v):
    s = smooth.context_stack(v.vecs, ["file_no"], "win", "emb")
    dim = F.size("emb")
    return s.select("vec_id", F.size("stacked").alias("dims"), F.col("stacked")[0].alias("first"),
                    F.element_at("stacked", dim + 1).alias("middle"),
                    F.element_at("stacked", -1).alias("last"))
