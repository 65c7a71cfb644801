"""Score, label, vector and recording views over the given tables, in Spark and in check SQL."""
from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dawnscore.functions import keys as K
from dawnscore.operators import align

WINDOWS = 12
TAXA = {"click": "Aves", "error": "Amphibia", "purchase": "Insecta", "signup": "Mammalia",
        "view": "Reptilia"}
CLASSES = list(TAXA)
ROW = ["file_id", "win"]
SERIES = ["file_id", "class"]

_TAX_ROWS = ", ".join(f"('{c}', '{t}')" for c, t in TAXA.items())

CTES = {
    "tax": f"tax(class, taxon) AS (VALUES {_TAX_ROWS})",
    "cells": """cells AS (
  SELECT 'F' || user_id AS file_id, 'S' || lpad(CAST(user_id % 10 AS VARCHAR), 2, '0') AS site,
    user_id % 24 AS hour, user_id % 5 AS fold,
    CAST(least(floor((epoch(ts) - 1704067200) / 216000), 11) AS BIGINT) AS win,
    event_type AS class, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents,
    CAST(sum(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) AS BIGINT) AS ks,
    max(value) AS mx
  FROM events GROUP BY ALL)""",
    "scores": """scores AS (
  SELECT f.file_id, f.site, f.hour, f.fold, w.win, f.file_id || '_' || ((w.win + 1) * 5) AS row_id,
    (w.win + 1) * 5 AS end_sec, t.class, t.taxon,
    coalesce(round(least(CAST(c.cents AS DOUBLE) / c.n / 10000, 1.0), 9), 0) AS pa,
    coalesce(round(CAST(c.ks AS DOUBLE) / c.n / 100, 9), 0) AS pb,
    coalesce(round(c.mx / 500, 9), 0) AS pc,
    CASE WHEN c.mx > 60 THEN 1 ELSE 0 END AS y, coalesce(c.n, 0) AS n
  FROM (SELECT DISTINCT file_id, site, hour, fold FROM cells) f, range(12) w(win), tax t
    LEFT JOIN cells c ON c.file_id = f.file_id AND c.win = w.win AND c.class = t.class)""",
    "longs": """longs AS (
  SELECT * EXCLUDE (pa, pb, pc), 'A' AS model, pa AS p FROM scores
  UNION ALL SELECT * EXCLUDE (pa, pb, pc), 'B' AS model, pb AS p FROM scores
  UNION ALL SELECT * EXCLUDE (pa, pb, pc), 'C' AS model, pc AS p FROM scores)""",
    "names": """names AS (
  SELECT event_id, user_id, CASE WHEN event_id % 7 = 3 THEN 'odd-' || event_id ELSE
    'REC_' || CASE WHEN event_id % 5 = 0 THEN 'Test' ELSE 'Train' END || '_' || event_id || '_S'
    || lpad(CAST(user_id % 10 AS VARCHAR), 2, '0') || '_' || strftime(ts, '%Y%m%d') || '_'
    || strftime(ts, '%H%M%S') || '.ogg' END AS filename,
    hour(ts) * 3600 + minute(ts) * 60 + CAST(floor(second(ts)) AS BIGINT) AS sec FROM events)""",
    "segs": """segs AS (
  SELECT 'F' || user_id || '.ogg' AS filename,
    '00:00:' || lpad(CAST(w * 5 AS VARCHAR), 2, '0') AS start_t,
    CASE WHEN w = 11 THEN '00:01:00' ELSE '00:00:' || lpad(CAST(w * 5 + 5 AS VARCHAR), 2, '0') END AS end_t,
    CASE event_id % 4 WHEN 0 THEN event_type || '; view;' WHEN 1 THEN ' click ;' || event_type
      ELSE event_type END AS primary_label, w * 5 + 5 AS end_sec
  FROM (SELECT *, CAST(least(floor((epoch(ts) - 1704067200) / 216000), 11) AS BIGINT) AS w
        FROM events WHERE value > 60))""",
    "recs": """recs AS (
  SELECT o_orderkey AS rec_id, o_orderpriority AS label, o_orderstatus AS collection,
    greatest(round(c_acctbal / 2000, 1), 0.0) AS rating, n_name AS grp,
    n_nationkey AS nation_id, year(o_orderdate) AS yr,
    'rec' || o_orderkey || '.ogg' AS filename,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 180 - 89.5 END AS lat,
    o_custkey % 360 - 179.75 AS lon,
    CASE o_orderkey % 5 WHEN 0 THEN '[]' WHEN 1 THEN '[''' || n_name || ''', ''XX'']'
      WHEN 2 THEN n_name || ' YY' WHEN 3 THEN NULL
      ELSE '[''' || o_orderpriority || ''', ''' || n_name || ''']' END AS secondary
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
    "vecs": """vecs AS (
  SELECT vec_id, vec_id // 12 AS file_no, vec_id % 12 AS win, vec_id % 7 AS site, 'c' || label AS class,
    CASE label % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'error' WHEN 2 THEN 'purchase' WHEN 3 THEN 'signup' ELSE 'view' END AS cls5, embedding
  FROM embeddings)""",
    "vx": """vx AS (
  SELECT vec_id, file_no, win, site, class, cls5, i, CAST(embedding[i] AS DOUBLE) AS x
  FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM vecs))""",
    "ux": """ux AS (
  SELECT vec_id, file_no, win, site, class, cls5, i, x / (sqrt(sum(x * x) OVER (PARTITION BY vec_id)) + 1e-9) AS x
  FROM vx)""",
}


def sql_ctes(body: str) -> list[str]:
    """The view definitions a body needs, in dependency order."""
    need: set[str] = set()
    todo = [body]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in need and re.search(rf"\b{name}\b", text):
                need.add(name)
                todo.append(CTES[name])
    return [CTES[name] for name in CTES if name in need]


class Views:
    """Lazily declared DataFrames for one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        ev = self.table("events")
        seconds = F.unix_timestamp(F.col("ts").cast("timestamp"))
        return ev.withColumn("win", F.least(F.floor((seconds - 1704067200) / 216000),
                                            F.lit(WINDOWS - 1)).cast("int"))

    @cached_property
    def cells(self) -> DataFrame:
        """One row per (file, window, class) that has events; partial sums collapse hot files."""
        user = F.col("user_id")
        return (self.events.groupBy(
            F.concat(F.lit("F"), user.cast("string")).alias("file_id"),
            F.concat(F.lit("S"), F.lpad((user % 10).cast("string"), 2, "0")).alias("site"),
            (user % 24).cast("int").alias("hour"), (user % 5).cast("int").alias("fold"),
            "win", F.col("event_type").alias("class"))
            .agg(F.count(F.lit(1)).alias("n"),
                 F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents"),
                 F.sum(F.regexp_extract("props", r"([0-9]+)", 1).cast("long")).alias("ks"),
                 F.max("value").alias("mx")))

    @cached_property
    def scores(self) -> DataFrame:
        """Dense (file, window, class) grid, left hash-partitioned by file for the series work."""
        dense = align.densify_files(
            self.cells, file_keys=["file_id", "site", "hour", "fold"], classes=CLASSES,
            windows=WINDOWS, payload=["n", "cents", "ks", "mx"])
        n = F.col("n")
        zero = F.lit(0.0)
        taxon = F.element_at(F.create_map(*[F.lit(x) for kv in TAXA.items() for x in kv]),
                             F.col("class"))
        return dense.select(
            "file_id", "site", "hour", "fold", "win",
            F.concat("file_id", F.lit("_"), ((F.col("win") + 1) * 5).cast("string")).alias("row_id"),
            ((F.col("win") + 1) * 5).alias("end_sec"), "class", taxon.alias("taxon"),
            F.coalesce(F.round(F.least(F.col("cents").cast("double") / n / 10000, F.lit(1.0)), 9),
                       zero).alias("pa"),
            F.coalesce(F.round(F.col("ks").cast("double") / n / 100, 9), zero).alias("pb"),
            F.coalesce(F.round(F.col("mx") / 500, 9), zero).alias("pc"),
            F.when(F.col("mx") > 60, 1).otherwise(0).alias("y"),
            F.coalesce(n, F.lit(0)).alias("n"))

    @cached_property
    def longs(self) -> DataFrame:
        return align.unpivot_streams(self.scores, {"A": "pa", "B": "pb", "C": "pc"})

    @cached_property
    def tax(self) -> DataFrame:
        return self.spark.createDataFrame(list(TAXA.items()), "class string, taxon string")

    @cached_property
    def names(self) -> DataFrame:
        e = F.col("event_id")
        ts = F.col("ts")
        good = F.concat(
            F.lit("REC_"), F.when(e % 5 == 0, "Test").otherwise("Train"), F.lit("_"),
            e.cast("string"), F.lit("_S"), F.lpad((F.col("user_id") % 10).cast("string"), 2, "0"),
            F.lit("_"), F.date_format(ts, "yyyyMMdd"), F.lit("_"), F.date_format(ts, "HHmmss"),
            F.lit(".ogg"))
        return self.table("events").select(
            "event_id", "user_id",
            F.when(e % 7 == 3, F.concat(F.lit("odd-"), e.cast("string"))).otherwise(good)
            .alias("filename"),
            (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).alias("sec"))

    @cached_property
    def segs(self) -> DataFrame:
        e, w = F.col("event_id"), F.col("win")
        return self.events.filter("value > 60").select(
            F.concat(F.lit("F"), F.col("user_id").cast("string"), F.lit(".ogg")).alias("filename"),
            K.seconds_to_hms(w * 5).alias("start_t"), K.seconds_to_hms(w * 5 + 5).alias("end_t"),
            F.when(e % 4 == 0, F.concat("event_type", F.lit("; view;")))
            .when(e % 4 == 1, F.concat(F.lit(" click ;"), "event_type"))
            .otherwise(F.col("event_type")).alias("primary_label"),
            (w * 5 + 5).alias("end_sec"))

    @cached_property
    def recs(self) -> DataFrame:
        o = F.col("o_orderkey")
        q = F.lit("'")
        return (self.table("orders").join(self.table("customer"),
                                          F.col("o_custkey") == F.col("c_custkey"))
                .join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
                .select(
                    o.alias("rec_id"), F.col("o_orderpriority").alias("label"),
                    F.col("o_orderstatus").alias("collection"),
                    F.greatest(F.round(F.col("c_acctbal") / 2000, 1), F.lit(0.0)).alias("rating"),
                    F.col("n_name").alias("grp"), F.col("n_nationkey").alias("nation_id"),
                    F.year("o_orderdate").alias("yr"),
                    F.concat(F.lit("rec"), o.cast("string"), F.lit(".ogg")).alias("filename"),
                    F.when(o % 11 == 0, F.lit(None)).otherwise(o % 180 - 89.5).alias("lat"),
                    (F.col("o_custkey") % 360 - 179.75).alias("lon"),
                    F.when(o % 5 == 0, F.lit("[]"))
                    .when(o % 5 == 1, F.concat(F.lit("['"), "n_name", F.lit("', 'XX']")))
                    .when(o % 5 == 2, F.concat("n_name", F.lit(" YY")))
                    .when(o % 5 == 3, F.lit(None).cast("string"))
                    .otherwise(F.concat(F.lit("["), q, "o_orderpriority", q, F.lit(", "), q,
                                        "n_name", q, F.lit("]"))).alias("secondary")))

    @cached_property
    def vecs(self) -> DataFrame:
        v = F.col("vec_id")
        return self.table("embeddings").select(
            "vec_id", F.floor(v / 12).alias("file_no"), (v % 12).cast("int").alias("win"), (v % 7).alias("site"),
            F.concat(F.lit("c"), F.col("label").cast("string")).alias("class"),
            F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col("label") % 5 + 1).alias("cls5"),
            F.col("embedding").alias("emb"))
