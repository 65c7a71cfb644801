"""Trust-weighted filter over several score streams of a file (diagonal covariance)."""
from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _logit(p):
    q = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def filter_block(streams: np.ndarray, top: int = 30, kappa: float = 0.05, r_min: float = 1e-3,
                 missing: float = 0.01) -> np.ndarray:
    """streams: (models, windows, classes) of one file -> (windows, classes)."""
    models, windows, classes = streams.shape
    mean = streams.mean(axis=0)
    tail = np.argsort(-mean.max(axis=0), kind="stable")[top:]
    mean[:, tail] = mean[:, tail] ** 2
    spread = mean.var(axis=0, ddof=1) if windows > 1 else np.zeros(classes)
    noise = np.maximum(spread, r_min) + 1e-6
    state, var = _logit(mean[0]), np.full(classes, 1e6)
    trust, trust_var = np.zeros(models), np.full(models, 1e2)
    out = np.empty((windows, classes))
    for t in range(windows):
        var = var + kappa * noise + 1e-6
        trust_var = trust_var + 1.0
        seen = _sigmoid(state)
        residual = np.abs(streams[:, t, :] - seen).mean(axis=1)
        gain = trust_var / (trust_var + 1.0)
        trust = trust + gain * (_logit(residual) - trust)
        trust_var = (1 - gain) * trust_var
        weight = _sigmoid(trust)
        for m in range(models):
            z = (0.2 * streams[m, max(t - 1, 0)] + 0.6 * streams[m, t]
                 + 0.2 * streams[m, min(t + 1, windows - 1)])
            z = 0.5 * z + 0.5 * seen
            k = var / (var + noise / (weight[m] + 1e-3))
            state = state + k * (_logit(z) - state) * (z >= missing)
            var = (1 - k) * var
        out[t] = _sigmoid(state)
    return out


def trust_filter(wide: DataFrame, streams: Sequence[str], file: str = "file_id",
                 win: str = "win", cls: str = "class") -> DataFrame:
    """One array of cells per file (windows x classes, bounded by the data model), Arrow batches
    of files in the task; cells a file lacks count as 0."""
    streams = list(streams)
    cells = F.array_sort(F.collect_list(F.struct(F.col(win).cast("int").alias("w"), F.col(cls).alias("c"),
                                                 *[F.col(s).cast("double").alias(s) for s in streams])))
    files = wide.groupBy(file).agg(cells.alias("_x")).select(
        F.col(file).cast("string").alias(file), F.col("_x.w").alias("_w"), F.col("_x.c").alias("_c"),
        *[F.col(f"_x.{s}").alias(s) for s in streams])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for row in b.itertuples(index=False):
                windows, at = np.unique(row[1], return_inverse=True)
                classes, col = np.unique(np.asarray(row[2], dtype=str), return_inverse=True)
                grid = np.zeros((len(streams), len(windows), len(classes)))
                for i in range(len(streams)):
                    grid[i, at, col] = row[3 + i]
                parts.append(pd.DataFrame({
                    file: row[0], win: np.repeat(windows, len(classes)), cls: np.tile(classes, len(windows)),
                    "p": filter_block(grid).ravel()}))
            if parts:
                yield pd.concat(parts)

    return files.mapInPandas(run, f"{file} string, {win} int, {cls} string, p double")
