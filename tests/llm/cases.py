"""Small frames with the awkward cases every operator has to take."""
from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, key string, found string"


def frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """rows: (doc_id, text[, lang[, source]]); further columns clash with names the operators use."""
    full = [(*r[:2], *(r[2:4] or ("en", "s")), None if r[1] is None else len(r[1]), "x", "y", "z") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(seed: int, n: int, vocabulary: int = 400) -> list[str]:
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}{rng.choice('abcdefgh')}" for _ in range(n)]


def prose(seed: int, n: int = 120) -> str:
    return " ".join(words(seed, n))


ODD = [(None, prose(1)), (101, None), (102, ""), (103, " \n\t "), (104, "x" * 50_000), (105, prose(2)), (105, prose(2)),
       (106, prose(3, 20_000)), (107, "é😀 ß  ½ œ 中文 ا"), (108, "a b")]
