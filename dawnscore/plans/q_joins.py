"""Registered queries: joins, grids and reshaping."""
from pyspark.sql import functions as F

from dawnscore.functions import keys as K
from dawnscore.operators import align
from dawnscore.plans.registry import query
from dawnscore.plans.views import CLASSES


@query("c01_attach_labels", "row_id:s class:s pa:f label:s", """
labels_by_row AS (SELECT DISTINCT replace(filename, '.ogg', '') || '_' || end_sec AS row_id,
  trim(unnest(string_split(primary_label, ';'))) AS label FROM segs)
--
SELECT s.row_id, s.class, s.pa, l.label FROM scores s JOIN labels_by_row l USING (row_id) WHERE l.label <> ''""")
def _(v):
    lab = v.segs.select(K.row_key(F.col("filename"), F.col("end_sec")).alias("row_id"),
                        F.explode(K.split_labels(F.col("primary_label"))).alias("label")).distinct()
    return align.attach_labels(v.scores, lab)


@query("c02_align_zero_fill", "row_id:s class:s p:f", """
SELECT s.row_id, s.class, coalesce(c.p, 0) AS p FROM scores s LEFT JOIN
  (SELECT file_id, win, class, least(n / 10.0, 1.0) AS p FROM cells WHERE n > 1) c USING (file_id, win, class)""")
def _(v):
    sparse = v.cells.filter("n > 1").withColumn("p", F.least(F.col("n") / 10.0, F.lit(1.0)))
    return align.align_zero_fill(v.scores, sparse, ["file_id", "win", "class"])


@query("c03_taxon_lookup", "file_id:s class:s taxon:s n:i", """
SELECT c.file_id, c.class, coalesce(t.taxon, 'Aves') AS taxon, sum(c.n) AS n FROM cells c
LEFT JOIN (SELECT * FROM tax WHERE class <> 'view') t USING (class) GROUP BY ALL""")
def _(v):
    per = v.cells.groupBy("file_id", "class").agg(F.sum("n").alias("n"))
    return align.attach_taxon(per, v.tax.filter("class <> 'view'"))


@query("c04_vocabulary_mapping", "n_nationkey:i vocab_index:i is_mapped:b", """
SELECT n_nationkey, coalesce(v.ix, -1) AS vocab_index, v.ix IS NOT NULL AS is_mapped FROM nation
LEFT JOIN (SELECT DISTINCT c_nationkey AS ix, 'NATION_' || c_nationkey AS nm FROM customer
  WHERE c_nationkey % 3 <> 1) v ON v.nm = n_name""")
def _(v):
    vocab = (v.table("customer").filter("c_nationkey % 3 <> 1")
             .select(F.col("c_nationkey").alias("vocab_index"),
                     F.concat(F.lit("NATION_"), "c_nationkey").alias("n_name")).distinct())
    return align.map_vocabulary(v.table("nation"), vocab, "n_name")


@query("c05_genus_proxy", "row_id:s target:s p:f", """
SELECT row_id, t.target, max(pa) AS p FROM (SELECT row_id, pa, length(class) AS genus FROM scores) s
JOIN (VALUES (5, 'short one'), (6, 'mid one'), (4, 'tiny one'), (5, 'short two')) t(genus, target) USING (genus)
GROUP BY ALL""")
def _(v):
    targets = v.spark.createDataFrame([(5, "short one"), (6, "mid one"), (4, "tiny one"),
                                       (5, "short two")], "genus int, class string")
    sc = v.scores.withColumn("genus", F.length("class"))
    return align.genus_proxy(sc, targets, ["row_id"], score="pa").withColumnRenamed("pa", "p")


@query("c06_leak_guard", "file_id:s n:i", """
SELECT file_id, sum(n) AS n FROM cells WHERE file_id NOT IN (SELECT file_id FROM cells WHERE fold = 0)
GROUP BY 1""")
def _(v):
    held = v.cells.filter("fold = 0")
    return align.drop_holdout(v.cells, held).groupBy("file_id").agg(F.sum("n").alias("n"))


@query("c07_overlap_semi", "rec_id:i label:s", """
SELECT rec_id, grp AS label FROM recs WHERE yr = 1996
AND grp IN (SELECT grp FROM recs WHERE yr = 1997) AND grp IN (SELECT n_name FROM nation WHERE n_regionkey < 3)""")
def _(v):
    r = v.recs.withColumn("label", F.col("grp"))
    tax = v.table("nation").filter("n_regionkey < 3").select(F.col("n_name").alias("label"))
    return align.keep_shared_labels(r.filter("yr = 1996"), r.filter("yr = 1997"), tax)


@query("c08_chunk_to_window", "file_id:s win:i class:s p:f shifted:f", """
SELECT s.file_id, s.win, s.class, a.p, b.p AS shifted FROM scores s
JOIN (SELECT file_id, class, win // 4 AS chunk, max(pa) AS p FROM scores GROUP BY ALL) a
  ON a.file_id = s.file_id AND a.class = s.class AND a.chunk = s.win // 4
JOIN (SELECT file_id, class, win // 4 AS chunk, max(pa) AS p FROM scores GROUP BY ALL) b
  ON b.file_id = s.file_id AND b.class = s.class AND b.chunk = ((s.win - 2 + 12) % 12) // 4""")
def _(v):
    chunks = (v.scores.groupBy("file_id", "class", F.floor(F.col("win") / 4).cast("int").alias("chunk"))
              .agg(F.max("pa").alias("p")))
    plain = align.chunk_to_window(chunks)
    moved = align.chunk_to_window(chunks, shift=2).withColumnRenamed("p", "shifted").drop("chunk")
    return plain.join(moved, ["file_id", "class", "win"])


SLIDE = """sliding AS (SELECT file_id, class, win, win * 2.5 AS st, pa FROM scores),
seg_nos AS (SELECT range AS seg FROM range(9))
--
SELECT file_id, class, seg, sum(w * pa) / sum(w) AS p, count(*) AS n_parts FROM (
  SELECT *, {w} AS w FROM sliding JOIN seg_nos ON st < seg * 5 + 5 AND st + 5 > seg * 5)
GROUP BY ALL"""


@query("c09_overlap_weighted", "file_id:s class:s seg:i p:f n_parts:i",
       SLIDE.format(w="(least(st + 5, seg * 5 + 5) - greatest(st, seg * 5)) / 5"))
def _(v):
    return align.overlap_resegment(v.scores, ["file_id", "class"], F.col("win") * 2.5, 5.0,
                                   score="pa").withColumnRenamed("pa", "p")


@query("c10_overlap_count", "file_id:s class:s seg:i p:f n_parts:i", SLIDE.format(w="1.0"))
def _(v):
    return align.overlap_resegment(v.scores, ["file_id", "class"], F.col("win") * 2.5, 5.0,
                                   score="pa", weighted=False).withColumnRenamed("pa", "p")


@query("c11_stream_align", "n_both:i only_a:i only_b:i", """
SELECT count(*) FILTER (WHERE a.n IS NOT NULL AND b.n IS NOT NULL) AS n_both,
  count(*) FILTER (WHERE b.n IS NULL) AS only_a, count(*) FILTER (WHERE a.n IS NULL) AS only_b
FROM (SELECT * FROM cells WHERE n > 1) a FULL JOIN (SELECT * FROM cells WHERE ks % 3 > 0) b USING (file_id, win, class)""")
def _(v):
    return align.unmatched_count(v.cells.filter("n > 1"), v.cells.filter("ks % 3 > 0"),
                                 ["file_id", "win", "class"])


@query("c11b_stream_join", "file_id:s win:i class:s pa:f pb:f", """
SELECT file_id, win, class, a.p AS pa, b.p AS pb FROM (SELECT *, cents / 1e6 AS p FROM cells WHERE n > 1) a
JOIN (SELECT *, ks / 1e4 AS p FROM cells WHERE ks % 3 > 0) b USING (file_id, win, class)""")
def _(v):
    key = ["file_id", "win", "class"]
    a = v.cells.filter("n > 1").select(*key, (F.col("cents") / 1e6).alias("pa"))
    b = v.cells.filter("ks % 3 > 0").select(*key, (F.col("ks") / 1e4).alias("pb"))
    return align.align_streams(a, b, key)


@query("c12_score_lookup", "row_id:s class:s pa:f pb:f", """
labelled AS (SELECT DISTINCT replace(filename, '.ogg', '') AS file_id, end_sec,
  trim(unnest(string_split(primary_label, ';'))) AS class FROM segs)
--
SELECT l.file_id || '_' || l.end_sec AS row_id, l.class, s.pa, s.pb FROM labelled l
LEFT JOIN scores s USING (file_id, end_sec, class) WHERE l.class <> ''""")
def _(v):
    lab = v.segs.select(F.regexp_replace("filename", r"\.ogg$", "").alias("file_id"), "end_sec",
                        F.explode(K.split_labels(F.col("primary_label"))).alias("class")).distinct()
    hit = align.score_lookup(lab, v.scores.select("file_id", "end_sec", "class", "pa", "pb"),
                             ["file_id", "end_sec", "class"])
    return hit.withColumn("row_id", F.concat_ws("_", "file_id", "end_sec"))


@query("c13_prior_lookup", "row_id:s class:s p:f", """
SELECT row_id, s.class, pa * coalesce(prior, 1.0) AS p FROM scores s LEFT JOIN
  (SELECT site, class, avg(y) AS prior FROM scores WHERE site <= 'S06' GROUP BY ALL) t
  ON t.site = s.site AND t.class = s.class""")
def _(v):
    prior = (v.scores.filter("site <= 'S06'").groupBy("site", "class")
             .agg(F.avg("y").alias("prior")))
    return (align.prior_lookup(v.scores, prior, ["site", "class"])
            .withColumn("p", F.col("pa") * F.col("prior")))


@query("c14_dense_grid", "file_id:s win:i class:s n:i", """
SELECT file_id, win, class, n FROM scores""")
def _(v):
    return v.scores


@query("c14b_class_grid", "vec_id:i class:s hit:b", """
SELECT vec_id, t.class, ((vec_id + length(t.class)) % 3 = 0) AS hit FROM vecs, tax t""")
def _(v):
    grid = align.class_grid(v.vecs.select("vec_id"), CLASSES)
    return grid.withColumn("hit", (F.col("vec_id") + F.length("class")) % 3 == 0)


@query("c15_gap_classes", "class:s", """
SELECT n_name AS class FROM nation WHERE n_name NOT IN (SELECT 'NATION_' || s_nationkey FROM supplier WHERE s_suppkey < 20)
AND n_name NOT IN (SELECT grp FROM recs WHERE rating >= 4.9)""")
def _(v):
    targets = v.table("nation").select(F.col("n_name").alias("class"))
    vocab = v.table("supplier").filter("s_suppkey < 20").select(
        F.concat(F.lit("NATION_"), "s_nationkey").alias("class"))
    recs = v.recs.filter("rating >= 4.9").select(F.col("grp").alias("class"))
    return align.gap_classes(targets, vocab, recs)
