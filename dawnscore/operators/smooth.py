"""Smoothing along the windows of a file.

Every function partitions by the series keys (file, class) ordered by window, so a chain of them
runs on one partitioning. A series has as many rows as a file has windows.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnscore.functions.scalar import clip, total


class Series:
    """Window frames of a series and offset access with edge rules."""

    def __init__(self, keys: Sequence[str], order: str):
        self.w = Window.partitionBy(*keys).orderBy(order)
        self.whole = self.w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    def at(self, x: str, k: int) -> Column:
        """Value k windows away, edge repeated."""
        if k == 0:
            return F.col(x)
        end = (F.first if k < 0 else F.last)(x).over(self.whole)
        return F.coalesce(self.at_or_null(x, k), end)

    def at_or_null(self, x: str, k: int) -> Column:
        return F.col(x) if k == 0 else (F.lag(x, -k) if k < 0 else F.lead(x, k)).over(self.w)

    def at_reflect(self, x: str, k: int) -> Column:
        """Half-sample reflection (d c b a | a b c d | d c b a) for any series length."""
        arr = F.collect_list(x).over(self.whole)
        n = F.size(arr)
        m = F.pmod(F.row_number().over(self.w) - 1 + k, 2 * n)
        return F.element_at(arr, F.when(m < n, m + 1).otherwise(2 * n - m))

    def count(self) -> Column:
        return F.count(F.lit(1)).over(self.whole)


def gaussian_weights(sigma: float, radius: int) -> list[float]:
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def student_weights(radius: int = 3, df: float = 2.0, scale: float = 1.2) -> list[float]:
    raw = [(1 + (k / scale) ** 2 / df) ** (-(df + 1) / 2) for k in range(-radius, radius + 1)]
    return [w / sum(raw) for w in raw]


def kernel(s: Series, x: str, weights: Sequence[float], mode: str = "nearest") -> Column:
    """Weighted sum over centred offsets; mode nearest | reflect | truncated (renormalised)."""
    radius = len(weights) // 2
    pairs = list(zip(range(-radius, radius + 1), weights))
    if mode == "truncated":
        terms = [(s.at_or_null(x, k), w) for k, w in pairs]
        top = total([F.coalesce(F.lit(w) * v, F.lit(0.0)) for v, w in terms])
        return top / total([F.when(v.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for v, w in terms])
    at = s.at if mode == "nearest" else s.at_reflect
    return total([F.lit(w) * at(x, k) for k, w in pairs])


def neighbour_blend(s: Series, x: str, alpha: float) -> Column:
    return (1 - alpha) * F.col(x) + alpha / 2 * (s.at(x, -1) + s.at(x, 1))


def local_max(s: Series, x: str, alpha: float) -> Column:
    return (1 - alpha) * F.col(x) + alpha * F.greatest(s.at(x, -1), F.col(x), s.at(x, 1))


def adaptive_blend(df: DataFrame, x: str, out: str, base: float = 0.20, file: str = "file_id",
                   win: str = "win", cls: str = "class", skip_edges: bool = False) -> DataFrame:
    """alpha = base * (1 - best score of the row); single-window files stay as they are."""
    s = Series([file, cls], win)
    alpha = F.lit(base) * (1 - F.col("_conf"))
    mixed = (1 - alpha) * F.col(x) + alpha * 0.5 * (s.at(x, -1) + s.at(x, 1))
    keep = s.count() < 2
    if skip_edges:
        keep = keep | s.at_or_null(x, -1).isNull() | s.at_or_null(x, 1).isNull()
    return (df.withColumn("_conf", F.max(x).over(Window.partitionBy(file, win)))
            .withColumn(out, F.when(keep, F.col(x)).otherwise(mixed)).drop("_conf"))


FIVE_TAP = (0.1, 0.2, 0.4, 0.2, 0.1)


def gaussian_truncated(s: Series, x: str, sigma: float) -> Column:
    return kernel(s, x, gaussian_weights(sigma, max(1, math.ceil(3 * sigma))), "truncated")


def gaussian(s: Series, x: str, sigma: float, mode: str = "nearest") -> Column:
    return kernel(s, x, gaussian_weights(sigma, int(4 * sigma + 0.5)), mode)


def multi_sigma(s: Series, x: str, sigmas: Sequence[float],
                weights: Sequence[float] | None = None) -> Column:
    weights = weights or [1 / len(sigmas)] * len(sigmas)
    return total([F.lit(w) * gaussian(s, x, sg) for sg, w in zip(sigmas, weights)])


def adaptive_sigma(s: Series, x: str, wide: Column, narrow_sigma: float = 0.5,
                   wide_sigma: float = 1.0) -> Column:
    return (F.when(wide, gaussian(s, x, wide_sigma)).otherwise(gaussian(s, x, narrow_sigma)))


def fat_tail(s: Series, x: str) -> Column:
    return F.when(s.count() > 1, kernel(s, x, student_weights())).otherwise(F.col(x))


def sharpened(df: DataFrame, keys: Sequence[str], win: str, x: str, out: str,
              power: float = 1.5) -> DataFrame:
    s = Series(keys, win)
    five = F.pow(kernel(s, "_s", (0.05, 0.15, 0.60, 0.15, 0.05)), F.lit(1 / power))
    three = kernel(s, x, (0.20, 0.60, 0.20))
    n = s.count()
    return (df.withColumn("_s", F.pow(x, F.lit(power)))
            .withColumn(out, F.when(n > 4, five).when(n > 2, three).otherwise(F.col(x)))
            .drop("_s"))


def median_filter(s: Series, x: str, k: int) -> Column:
    r = k // 2
    return F.element_at(F.array_sort(F.array(*[s.at(x, o) for o in range(-r, r + 1)])), r + 1)


# --- recursions: the series as one sorted array, folded in the JVM ---

def to_series(df: DataFrame, keys: Sequence[str], win: str, x: str,
              carry: Sequence[str] = ()) -> DataFrame:
    packed = F.sort_array(F.collect_list(F.struct(win, *carry, x)))
    return (df.groupBy(*keys).agg(packed.alias("_s"))
            .withColumn("_x", F.transform("_s", lambda e: e[x].cast("double"))))


def from_series(df: DataFrame, keys: Sequence[str], win: str, x: str, values: str,
                out: str, carry: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    rows = df.select(*keys, *keep, F.inline(F.arrays_zip(F.col("_s").alias("_e"),
                                                         F.col(values).alias(out))))
    return rows.select(*keys, *keep, F.col(f"_e.{win}").alias(win),
                       *[F.col(f"_e.{c}").alias(c) for c in carry], F.col(f"_e.{x}").alias(x), out)


def scan(arr: Column, first: Callable, step: Callable, kind: str) -> Column:
    """Running fold that keeps every state: first(x), then step(previous state, x)."""
    empty = F.array().cast(f"array<{kind}>")

    def grow(acc, x):
        nxt = F.when(F.size(acc) == 0, first(x)).otherwise(step(F.try_element_at(acc, F.lit(-1)), x))
        return F.concat(acc, F.array(nxt.cast(kind)))

    return F.aggregate(arr, empty, grow)


def ema_two_pass(df: DataFrame, keys: Sequence[str], win: str, x: str, out: str,
                 alpha: float) -> DataFrame:
    def run(arr):
        return scan(arr, lambda v: v, lambda p, v: alpha * v + (1 - alpha) * p, "double")
    s = (to_series(df, keys, win, x).withColumn("_f", run(F.col("_x")))
         .withColumn("_b", F.reverse(run(F.reverse("_x"))))
         .withColumn("_o", F.zip_with("_f", "_b", lambda a, b: 0.5 * (a + b))))
    return from_series(s, keys, win, x, "_o", out)


STATE = "struct<x:double,p:double>"


def _state(x, p):
    return F.struct(x.alias("x"), p.alias("p"))


def _kalman_forward(arr: Column, q: float, r: float, p0: float, start_updates: bool) -> Column:
    def step(s, z):
        pp = s["p"] + q
        k = pp / (pp + r)
        return _state(s["x"] + k * (z - s["x"]), (1 - k) * pp)

    def first(z):
        start = _state(z, F.lit(p0))
        return step(start, z) if start_updates else start
    return scan(arr, first, step, STATE)


def kalman(df: DataFrame, keys: Sequence[str], win: str, x: str, out: str, q: float = 0.1,
           r: float = 0.3) -> DataFrame:
    """Causal random-walk filter; starts at the first value with variance r."""
    s = (to_series(df, keys, win, x).withColumn("_f", _kalman_forward(F.col("_x"), q, r, r, True))
         .withColumn("_o", F.transform("_f", lambda e: e["x"])))
    return from_series(s, keys, win, x, "_o", out)


def kalman_rts(df: DataFrame, keys: Sequence[str], win: str, x: str, out: str, q: float, r: float,
               p0: float = 1e6, fixed_gain: bool = False) -> DataFrame:
    """Forward filter and backward smoother; fixed_gain uses q/(q+r) backwards."""
    def back(s, e):
        gain = F.lit(q / (q + r)) if fixed_gain else e["p"] / (e["p"] + q)
        return _state(e["x"] + gain * (s["x"] - e["x"]), e["p"])
    s = (to_series(df, keys, win, x)
         .withColumn("_f", _kalman_forward(F.col("_x"), q, r, p0, False))
         .withColumn("_b", F.reverse(scan(F.reverse("_f"), lambda e: e, back, STATE)))
         .withColumn("_o", F.transform("_b", lambda e: e["x"])))
    return from_series(s, keys, win, x, "_o", out)


PAIR = "struct<a:double,b:double>"


def hmm_posterior(df: DataFrame, keys: Sequence[str], win: str, x: str, out: str, p01: Column,
                  p10: Column, prior: float = 0.1, eps: float = 1e-3,
                  keep: Sequence[str] = ()) -> DataFrame:
    """Two-state forward-backward posterior; emissions are the clipped score and its complement.

    p01 / p10 may be literals or columns of `keep` (per-class rates joined beforehand).
    """
    def norm(a, b):
        s = a + b + 1e-30
        return F.struct((a / s).alias("a"), (b / s).alias("b"))

    def forward(s, e):
        return norm(((1 - F.col("_p01")) * s["a"] + F.col("_p10") * s["b"]) * (1 - e),
                    (F.col("_p01") * s["a"] + (1 - F.col("_p10")) * s["b"]) * e)

    def backward(s, e):
        return norm((1 - F.col("_p01")) * (1 - e) * s["a"] + F.col("_p01") * e * s["b"],
                    F.col("_p10") * (1 - e) * s["a"] + (1 - F.col("_p10")) * e * s["b"])

    ones = F.array(F.struct(F.lit(1.0).alias("a"), F.lit(1.0).alias("b"))).cast(f"array<{PAIR}>")
    s = (to_series(df, [*keys, *keep], win, x).withColumn("_p01", p01).withColumn("_p10", p10)
         .withColumn("_e", F.transform("_x", lambda v: clip(v, eps, 1 - eps)))
         .withColumn("_f", scan(F.col("_e"), lambda e: norm((1 - prior) * (1 - e), prior * e),
                                forward, PAIR))
         # beta at t looks at the emission of t+1: fold the reversed tail onto a vector of ones
         .withColumn("_r", F.aggregate(
             F.slice(F.reverse("_e"), F.lit(1), F.size("_e") - 1), ones,
             lambda acc, e: F.concat(acc, F.array(
                 backward(F.element_at(acc, -1), e).cast(PAIR)))))
         .withColumn("_o", F.zip_with("_f", F.reverse("_r"), lambda f, b:
                                      f["b"] * b["b"] / (f["a"] * b["a"] + f["b"] * b["b"] + 1e-30))))
    return from_series(s, keys, win, x, "_o", out)


def sequence_features(df: DataFrame, keys: Sequence[str], win: str, x: str) -> DataFrame:
    """prev, next, series mean, max, population std."""
    s = Series(keys, win)
    return df.select("*", s.at(x, -1).alias("prev"), s.at(x, 1).alias("next"),
                     F.avg(x).over(s.whole).alias("s_mean"), F.max(x).over(s.whole).alias("s_max"),
                     F.stddev_pop(x).over(s.whole).alias("s_std"))


def interaction_features(df: DataFrame, keys: Sequence[str], win: str, raw: str, prior: str,
                         base: str) -> DataFrame:
    f = sequence_features(df, keys, win, base)
    b, r, p = F.col(base), F.col(raw), F.col(prior)
    return f.select("*", (b - F.col("s_mean")).alias("d_mean"), (b - F.col("prev")).alias("d_prev"),
                    (b - F.col("next")).alias("d_next"), (r * p).alias("raw_prior"),
                    (r * b).alias("raw_base"), (p * b).alias("prior_base"))


def window_position(df: DataFrame, keys: Sequence[str], order: str, out: str = "pos") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(order)) - 1)


def context_stack(df: DataFrame, keys: Sequence[str], order: str, vec: str,
                  out: str = "stacked") -> DataFrame:
    s = Series(keys, order)
    return df.withColumn(out, F.concat(s.at(vec, -1), F.col(vec), s.at(vec, 1)))
