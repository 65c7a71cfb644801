"""Places where callers plug in their own Python: scorers, per-file and per-class functions."""
from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batch_score(recordings: DataFrame, make_scorer: Callable[[], Callable], classes: Sequence[str],
                emb_dims: int, file: str = "file_id", samples: str = "samples", width: int = 160_000,
                windows: int = 12, batch: int = 16) -> DataFrame:
    """Recordings -> windows -> model -> one row per window with scores and embedding.

    make_scorer runs once per task and returns fn(array (n, width)) -> (scores (n, classes),
    embeddings (n, emb_dims)). Files go in batches; when one fails, its files are retried singly
    and a file that fails alone gets zeros, so that no row is lost.
    """
    n_classes = len(classes)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()

        def cut(values) -> np.ndarray:
            x = np.zeros(width * windows, dtype=np.float32)
            v = np.asarray(values, dtype=np.float32)[:width * windows]
            x[:len(v)] = v
            return x.reshape(windows, width)

        def attempt(rows: list) -> tuple[np.ndarray, np.ndarray, bool]:
            try:
                s, e = scorer(np.concatenate([cut(r) for r in rows]))
                return np.asarray(s, dtype=float), np.asarray(e, dtype=float), True
            except Exception:
                if len(rows) == 1:
                    return np.zeros((windows, n_classes)), np.zeros((windows, emb_dims)), False
                return None, None, False

        for pdf in parts:
            for start in range(0, len(pdf), batch):
                part = pdf.iloc[start:start + batch]
                rows = part[samples].tolist()
                s, e, ok = attempt(rows)
                good = [ok] * len(rows)
                if s is None:
                    single = [attempt([r]) for r in rows]
                    s = np.concatenate([x[0] for x in single])
                    e = np.concatenate([x[1] for x in single])
                    good = [x[2] for x in single]
                ids = np.repeat(part[file].to_numpy(), windows)
                win = np.tile(np.arange(windows), len(part))
                yield pd.DataFrame({
                    file: ids, "win": win, "row_id": [f"{i}_{(w + 1) * 5}" for i, w in zip(ids, win)],
                    "scores": list(s), "emb": list(e), "is_scored": np.repeat(good, windows)})

    schema = (f"{file} string, win int, row_id string, scores array<double>, emb array<double>, "
              "is_scored boolean")
    return recordings.select(F.col(file).cast("string").alias(file), samples).mapInPandas(run, schema)


def per_file(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
             file: str = "file_id", order: str = "win") -> DataFrame:
    """fn on the ordered rows of each file; a file is bounded by its windows and classes."""
    return df.groupBy(file).applyInPandas(lambda p: fn(p.sort_values(order)), schema)


def per_class_fit(df: DataFrame, partial: Callable[[pd.DataFrame], pd.DataFrame],
                  merge: Callable[[pd.DataFrame], pd.DataFrame], partial_schema: str, schema: str,
                  cls: str = "class", chunk_key: str = "row_id", chunk_rows: int = 200_000) -> DataFrame:
    """A fit over one class's rows as partial states of bounded chunks and their merge.

    A class is cut into chunks by a hash of its rows, so no task sees more than about chunk_rows
    of them; merge gets one small state per chunk.
    """
    sizes = df.groupBy(cls).agg(F.count(F.lit(1)).alias("_n"))
    chunks = F.greatest(F.ceil(F.col("_n") / chunk_rows), F.lit(1))
    d = df.join(sizes, cls).withColumn("_chunk", F.pmod(F.xxhash64(chunk_key), chunks)).drop("_n")
    states = d.groupBy(cls, "_chunk").applyInPandas(lambda p: partial(p.drop(columns="_chunk")), partial_schema)
    return states.groupBy(cls).applyInPandas(merge, schema)
