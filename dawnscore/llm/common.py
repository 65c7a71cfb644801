"""Helpers shared by the operators of this package."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: white space that separates words (bytes.split() uses the same six characters).
SPACE = r"\x20\x09-\x0D"


_LOCAL: dict[str, str] = {}  # a local session's own folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names; a local one is made only for a local session without any."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        application = spark.sparkContext.applicationId
        folder = _LOCAL.setdefault(application, _LOCAL.get(application) or tempfile.mkdtemp(prefix="spark-"))
    return folder.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends here and survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_ROWS = 1_000


def arrow_rows(spark: SparkSession) -> None:
    """Whole texts go to Python workers: a session with larger Arrow batches gets BATCH_ROWS rows a batch."""
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)


@contextmanager
def arrow_rows_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of so many rows for the jobs run inside, for rows that are large by themselves."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only what an operator reads, under fixed names, so that other columns cannot clash."""
    arrow_rows(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def small_batches(batches: Iterator[pa.RecordBatch], column: str = "text",
                  most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of about `most` bytes of text; a longer single row stays whole."""
    for batch in batches:
        rows = batch.num_rows
        if not rows:
            continue
        size = batch.column(batch.schema.get_field_index(column)).nbytes
        step = max(1, rows * most // max(size, 1))
        for at in range(0, rows, step):
            yield batch.slice(at, step)
