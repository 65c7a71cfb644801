"""Table scans, sinks and their contracts."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dawnscore.operators import sampling

# Column layouts of the metadata files. Label codes stay text even where they look
# like numbers.
RECORDINGS = T.StructType([
    T.StructField("primary_label", T.StringType()), T.StructField("secondary_labels", T.StringType()),
    T.StructField("latitude", T.DoubleType()), T.StructField("longitude", T.DoubleType()),
    T.StructField("class_name", T.StringType()), T.StructField("collection", T.StringType()),
    T.StructField("rating", T.DoubleType()), T.StructField("filename", T.StringType())])
TAXONOMY = T.StructType([
    T.StructField("primary_label", T.StringType()), T.StructField("scientific_name", T.StringType()),
    T.StructField("common_name", T.StringType()), T.StructField("class_name", T.StringType()),
    T.StructField("inat_taxon_id", T.IntegerType())])
SEGMENTS = T.StructType([
    T.StructField("filename", T.StringType()), T.StructField("start", T.StringType()),
    T.StructField("end", T.StringType()), T.StructField("primary_label", T.StringType())])
OBSERVATIONS = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("species", T.StringType()),
    T.StructField("sounds", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("file_url", T.StringType()),
        T.StructField("license_code", T.StringType())])))])
AUDIO_EXTENSIONS = ("mp3", "m4a", "wav", "ogg", "flac")


_LOCAL: dict[str, str] = {}  # a local session's own folder: the setting cannot be changed at run time


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared folder; only a local session may do without one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        application = spark.sparkContext.applicationId
        root = _LOCAL.setdefault(application, _LOCAL.get(application) or tempfile.mkdtemp(prefix="spark-"))
    return f"{root}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Header CSV under an explicit schema; nothing is inferred."""
    return spark.read.csv(path, header=True, schema=schema)


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("errorifexists").csv(path, header=True)
    return path


def read_columns(spark: SparkSession, path: str, columns: Sequence[str],
                 where: Column | None = None) -> DataFrame:
    """Columnar scan; the projection and the filter reach the files."""
    df = spark.read.parquet(path)
    return (df if where is None else df.filter(where)).select(*columns)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> str:
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back: several readers, one computation."""
    return df.sparkSession.read.schema(df.schema).parquet(write_table(df, scratch(df.sparkSession, name)))


def matrix_to_long(df: DataFrame, keys: Sequence[str], scores: str, classes: Sequence[str],
                   model: str) -> DataFrame:
    """Score arrays in class order -> one keyed row per class."""
    names = F.array(*[F.lit(c) for c in classes])
    pairs = F.arrays_zip(names.alias("class"), F.col(scores).alias("p"))
    return (df.select(*keys, F.explode(pairs).alias("_z"))
            .select(*keys, F.col("_z.class").alias("class"), F.lit(model).alias("model"),
                    F.col("_z.p").alias("p")))


def list_recordings(spark: SparkSession, root: str, extensions: Sequence[str]) -> DataFrame:
    """Files under a root: species from the parent folder, allowed extensions, no '_' folders."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", "length"))
    parts = F.split("path", "/")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return (files.withColumn("species", F.element_at(parts, -2))
            .withColumn("filename", F.element_at(parts, -1))
            .filter(ext.isin(*extensions) & ~F.col("species").startswith("_"))
            .select("species", "filename", "path", "length"))


def wide_scores(long: DataFrame, classes: Sequence[str], row: str = "row_id",
                score: str = "p") -> DataFrame:
    """row_id + one float column per class in the given order; absent cells are 0."""
    wide = long.groupBy(row).pivot("class", list(classes)).agg(F.first(score))
    return wide.select(row, *[F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)),
                                         F.lit(0.0)).cast("float").alias(c) for c in classes])


def contract_violations(long: DataFrame, windows: int = 12, classes: int = 0,
                        score: str = "p") -> DataFrame:
    """One row of counts: bad values, files without exactly `windows` rows, rows lacking classes."""
    p = F.col(score)
    rows = long.groupBy("file_id", "win").agg(
        F.count(F.lit(1)).alias("_k"), F.count_if(p.isNull() | F.isnan(p)).alias("_nan"),
        F.count_if((p < 0) | (p > 1)).alias("_range"))
    files = rows.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("_w"), F.sum("_nan").alias("_nan"), F.sum("_range").alias("_range"),
        F.count_if(F.col("_k") != classes).alias("_short"))
    return files.agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("_nan").alias("n_nan"),
        F.sum("_range").alias("n_out_of_range"), F.count_if(F.col("_w") != windows).alias("n_bad_files"),
        F.sum("_short").alias("n_short_rows"))


def pseudo_rows(df: DataFrame, keep: Column, scores: Sequence[str]) -> DataFrame:
    """Sink layout of pseudo-labels: filename, start, end, label, one column per stream."""
    end = (F.col("win") + 1) * 5
    return df.filter(keep).select(
        F.concat("file_id", F.lit(".ogg")).alias("filename"), (end - 5).alias("start"),
        end.alias("end"), F.col("class").alias("primary_label"), *scores)


def observation_sounds(docs: DataFrame, per_species: int, per_doc: int = 2,
                       extensions: Sequence[str] = AUDIO_EXTENSIONS) -> DataFrame:
    """Observation documents -> one row per usable sound, capped per species.

    At most per_doc sounds of a document, HTTPS only, extension checked without the query string.
    The cap is a group limit: each task passes on at most per_species rows of a species.
    """
    s = docs.select(F.col("id").alias("obs_id"), "species",
                    F.explode(F.slice("sounds", 1, per_doc)).alias("s"))
    bare = F.split(F.col("s.file_url"), r"\?")[0]
    ext = F.lower(F.regexp_extract(bare, r"\.([^./]+)$", 1))
    s = (s.withColumn("ext", ext)
         .filter(F.col("s.file_url").startswith("https://") & F.col("ext").isin(*extensions))
         .select("species", F.concat_ws("_", "obs_id", "s.id").alias("sound_key"), "obs_id",
                 F.col("s.id").alias("sound_id"), "ext"))
    s = s.withColumn("_one", F.lit(0))
    return sampling.top_k(s, ["species"], "_one", per_species, ("obs_id", "sound_id")).drop("_one", "place")


def save_artifact(df: DataFrame, path: str) -> DataFrame:
    """Write a small fitted table and return it read back."""
    write_table(df, path)
    return df.sparkSession.read.parquet(path)
