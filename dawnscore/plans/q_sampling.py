"""Registered queries: top-k, sampling, folds and set operations."""
from pyspark.sql import functions as F

from dawnscore.operators import blend, sampling as S, setops
from dawnscore.plans.q_pseudo import CAPS
from dawnscore.plans.registry import query
from dawnscore.plans.views import ROW

CELL = "row_id:s class:s "


@query("f01_top_k", CELL + "pa:f place:i", """
SELECT *, row_number() OVER (PARTITION BY file_id, win ORDER BY pa DESC, class) AS place FROM scores WHERE pa > .1 QUALIFY place <= 2""")
def _(v):
    return S.top_k(v.scores.filter("pa > 0.1"), ROW, "pa", 2)


@query("f02_top_k_cap", CELL + "p:f", """
SELECT row_id, class, CASE WHEN row_number() OVER (PARTITION BY file_id, win ORDER BY pa DESC, class) <= 2 THEN pa ELSE 0 END AS p FROM scores""")
def _(v):
    return S.top_k_cap(v.scores, ROW, "pa", 2, "p")


@query("f03_site_capped", CELL + "site:s pa:f", "ent AS (SELECT *, pa AS sc FROM scores WHERE pa > .3),\n" + CAPS.format(a=8, b=50)
       + "\n--\nSELECT row_id, class, site, pa FROM cap2")
def _(v):
    return S.site_capped(v.scores.filter("pa > 0.3"), "pa", 8, 50, "row_id")


def seeded_sql(key, seed):
    """sampling.seeded in SQL."""
    return f"CAST('0x' || substr(md5('{seed}:' || {key}), 1, 13) AS BIGINT)"


@query("f04_quota_sample", "rec_id:i grp:s", f"""
q AS (SELECT greatest(500 // count(DISTINCT grp), 1) AS quota FROM recs),
r AS (SELECT rec_id, grp, {seeded_sql('rec_id', 0)} AS h FROM recs),
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY h, rec_id) AS place FROM r)
--
SELECT rec_id, grp FROM p, q ORDER BY (place > quota)::INT, h, rec_id LIMIT 500""")
def _(v):
    return S.quota_sample(v.recs.select("rec_id", "grp"), "grp", "rec_id", 500)


@query("f05_nested_largest", "row_id:s class:s site:s pb:f", """
a AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY site ORDER BY pb DESC, row_id || class) <= 5)
--
SELECT row_id, class, site, pb FROM a ORDER BY pb DESC, row_id || class LIMIT 30""")
def _(v):
    d = v.scores.withColumn("k", F.concat("row_id", "class"))
    return S.nested_largest(d, "site", "pb", 5, 30, "k")


@query("f06_file_split", "file_id:s split:s", f"""
f AS (SELECT DISTINCT file_id FROM cells)
--
SELECT file_id, CASE WHEN row_number() OVER (ORDER BY {seeded_sql('file_id', 0)}, file_id) <= 11 THEN 'eval' ELSE 'train' END AS split FROM f""")
def _(v):
    return S.file_split(v.cells.select("file_id"), "file_id", 11).distinct()


@query("f07_class_holdout", "rec_id:i label:s is_holdout:b", f"""
u AS (SELECT rec_id, label, {seeded_sql('rec_id', 0)} % 1099511627776 AS u FROM recs),
t AS (SELECT *, count(*) OVER (PARTITION BY label) AS n, rank() OVER (PARTITION BY label ORDER BY u) - 1 AS below FROM u)
--
SELECT rec_id, label, n >= 5 AND below < greatest(1, floor(n * .2)) AS is_holdout FROM t""")
def _(v):
    return S.class_holdout(v.recs.select("rec_id", "label"), "label", "rec_id")


@query("f08_round_robin", "file_id:s site:s fold:i", """
SELECT file_id, site, (row_number() OVER (PARTITION BY site ORDER BY file_id) - 1) % 5 AS fold FROM (SELECT DISTINCT file_id, site FROM cells)""")
def _(v):
    return S.round_robin(v.cells.select("file_id", "site").distinct(), "site", "file_id")


@query("f09_group_folds", "fold:i n_rows:i n_files:i", """
g AS (SELECT file_id, count(*) AS n FROM cells GROUP BY 1),
o AS (SELECT n, row_number() OVER (ORDER BY n DESC, file_id) AS i FROM g),
rec_f AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS load, [0, 0, 0, 0, 0]::BIGINT[] AS files
  UNION ALL SELECT o.i, list_transform(range(1, 6), lambda x: load[x] + CASE WHEN x = list_position(load, list_min(load)) THEN o.n ELSE 0 END),
    list_transform(range(1, 6), lambda x: files[x] + CASE WHEN x = list_position(load, list_min(load)) THEN 1 ELSE 0 END)
  FROM rec_f JOIN o ON o.i = rec_f.i + 1)
--
SELECT * FROM (SELECT unnest(range(5)) AS fold, unnest(load) AS n_rows, unnest(files) AS n_files FROM rec_f WHERE i = (SELECT max(i) FROM o)) WHERE n_files > 0""")
def _(v):
    d = S.group_folds(v.cells.select("file_id", "win", "class"), "file_id")
    return d.groupBy("fold").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("file_id").alias("n_files"))


@query("f10_site_holdout", "class:s site:s test_pos:i test_n:i train_pos:i train_n:i usable:b", """
p AS (SELECT class, site, sum(y) AS test_pos, count(*) AS test_n FROM scores GROUP BY ALL),
t AS (SELECT *, sum(test_pos) OVER (PARTITION BY class) - test_pos AS train_pos, sum(test_n) OVER (PARTITION BY class) - test_n AS train_n FROM p)
--
SELECT *, train_pos >= 5 AND test_pos > 0 AND test_pos < test_n AS usable FROM t""")
def _(v):
    return S.site_holdout_plan(v.scores)


@query("f10b_site_roles", "row_id:s class:s role:s", """
SELECT row_id, class, CASE WHEN site = 'S04' THEN 'test' ELSE 'train' END AS role FROM scores""")
def _(v):
    return S.site_roles(v.scores, "S04")


@query("f11_equal_class_weight", "rec_id:i weight:f", """
SELECT rec_id, 1e4 / (count(*) OVER (PARTITION BY grp) * (SELECT count(DISTINCT grp) FROM recs)) AS weight FROM recs""")
def _(v):
    d = S.equal_class_weight(v.recs.select("rec_id", "grp"), "grp")
    return d.withColumn("weight", F.col("weight") * 1e4)


@query("f12_focus_weight", "row_id:s class:s weight:f", """
SELECT row_id, class, 1e4 * w / sum(w) OVER () AS weight FROM (SELECT *, CASE WHEN taxon IN ('Amphibia', 'Insecta') THEN 10.0 ELSE 1.0 END AS w FROM scores)""")
def _(v):
    d = S.focus_weight(v.scores, F.col("taxon").isin("Amphibia", "Insecta"))
    return d.withColumn("weight", F.col("weight") * 1e4)


@query("f13_weighted_draws", "draw:i rec_id:i")
def _(v):
    d = v.recs.select("rec_id", F.col("rating").alias("w"))
    return S.weighted_draws(d, "rec_id", "w", 1000)


@query("f14_candidate_list", "file_id:s win:i sim:f", """
SELECT file_id, win, max(pc) AS sim FROM scores GROUP BY ALL
HAVING arg_max(taxon, (pa, class)) = 'Aves' AND arg_max(taxon, (pb, class)) = 'Insecta' AND max(pc) > .1""")
def _(v):
    return S.candidate_list(v.scores, ROW, "pa", "pb", "Aves", "Insecta", "pc", 0.1)


@query("f15_cross_site_pool", "file_id:s site:s background:s background_site:s")
def _(v):
    files = v.cells.select("file_id", "site").distinct()
    return S.cross_site_pool(files, v.cells.filter("fold = 0"), 5)


@query("g01_union_keep_first", "file_id:s win:i class:s source:s n:i", """
u AS (SELECT file_id, win, class, n, 'old' AS source, 0 AS p FROM cells WHERE n > 1 UNION ALL SELECT file_id, win, class, n + 100, 'new', 1 FROM cells WHERE ks % 2 = 0)
--
SELECT file_id, win, class, source, n FROM u QUALIFY row_number() OVER (PARTITION BY file_id, win, class ORDER BY p) = 1""")
def _(v):
    key = ["file_id", "win", "class"]
    old = v.cells.filter("n > 1").select(*key, "n")
    new = v.cells.filter("ks % 2 = 0").select(*key, (F.col("n") + 100).alias("n"))
    return setops.union_keep_first({"old": old, "new": new}, key)


@query("g02_exact_duplicates", "filename:s start_t:s end_t:s primary_label:s", """
SELECT DISTINCT filename, start_t, end_t, primary_label FROM segs""")
def _(v):
    return v.segs.select("filename", "start_t", "end_t", "primary_label").dropDuplicates()


@query("g03_coverage_sets", "grp:s where_found:s", """
a AS (SELECT DISTINCT grp FROM recs WHERE yr = 1996 AND rating >= 4.8), b AS (SELECT DISTINCT grp FROM recs WHERE yr = 1997 AND rating >= 4.8)
--
SELECT coalesce(a.grp, b.grp) AS grp, CASE WHEN b.grp IS NULL THEN 'removed' WHEN a.grp IS NULL THEN 'new' ELSE 'overlap' END AS where_found FROM a FULL JOIN b ON a.grp = b.grp""")
def _(v):
    hot = v.recs.filter("rating >= 4.8")
    return setops.coverage(hot.filter("yr = 1996"), hot.filter("yr = 1997"), "grp", ("removed", "new", "overlap"))


@query("g03b_uncovered", "grp:s", """
SELECT n_name AS grp FROM nation EXCEPT SELECT grp FROM recs WHERE yr = 1996 AND rating >= 4.9 EXCEPT SELECT grp FROM recs WHERE yr = 1997 AND rating >= 4.9""")
def _(v):
    hot = v.recs.filter("rating >= 4.9")
    return setops.uncovered(v.table("nation").select(F.col("n_name").alias("grp")), hot.filter("yr = 1996"),
                            hot.filter("yr = 1997"), key="grp")


@query("g04_top_k_consensus", CELL + "agreement:s", """
t AS (SELECT *, (row_number() OVER (PARTITION BY file_id, win ORDER BY pa DESC, class) <= 2)::INT + (row_number() OVER (PARTITION BY file_id, win ORDER BY pb DESC, class) <= 2)::INT AS n2 FROM scores)
--
SELECT row_id, class, CASE n2 WHEN 2 THEN 'all' ELSE 'one' END AS agreement FROM t WHERE n2 > 0""")
def _(v):
    return setops.consensus(blend.top_k_flags(v.scores, ROW, ["pa", "pb"], 2), ["pa", "pb"])


@query("g05_content_dedupe", "doc_id:i copies:i", """
SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY md5(text)""")
def _(v):
    d = v.table("documents").withColumn("body", F.encode("text", "utf-8"))
    return setops.first_per_content(d, "body", "doc_id")
