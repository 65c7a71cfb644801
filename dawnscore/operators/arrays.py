"""Sample arrays: windows, chunks, silence, quiet windows, crops, bands, mixing."""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnscore.functions import vec
from dawnscore.operators import rank
from dawnscore.operators.scalars import attach


def pad_to(x: Column, n: int) -> Column:
    """Exactly n samples: cut or zero-filled."""
    return F.slice(F.concat(x, F.array_repeat(F.lit(0.0), F.greatest(F.lit(n) - F.size(x), F.lit(0)))), 1, n)


def segment(df: DataFrame, samples: str, width: int, windows: int = 12, seconds: int = 5) -> DataFrame:
    """Fixed windows with their end second; short recordings are zero-filled."""
    x = F.transform(samples, lambda v: v.cast("double"))
    full = df.withColumn("_x", pad_to(x, width * windows))
    parts = F.transform(F.sequence(F.lit(0), F.lit(windows - 1)),
                        lambda i: F.slice("_x", i * width + 1, width))
    return (full.select(*df.columns, F.posexplode(parts).alias("win", "window"))
            .withColumn("end_sec", (F.col("win") + 1) * seconds))


def tile(x: Column, n: int) -> Column:
    reps = F.ceil(F.lit(n) / F.size(x)).cast("int")
    return F.when(F.size(x) >= n, x).otherwise(F.slice(F.flatten(F.array_repeat(x, reps)), 1, n))


def sliding_chunks(df: DataFrame, samples: str, duration: int, hop: int) -> DataFrame:
    """Chunks of a duration every hop; short recordings are tiled to one chunk."""
    t = df.withColumn("_t", tile(F.col(samples), duration))
    starts = F.sequence(F.lit(0), F.size("_t") - duration, F.lit(hop))
    return (t.withColumn("start", F.explode(starts))
            .withColumn("chunk", F.slice("_t", F.col("start") + 1, duration)).drop("_t"))


def rms(x: Column) -> Column:
    return F.sqrt(vec.fold(F.transform(x, lambda v: v.cast("double") * v.cast("double"))) / F.size(x))


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))


def level_db(x: Column) -> Column:
    return 20 * F.log10(F.greatest(rms(x), F.lit(1e-12)))


def is_silent(x: Column, floor_db: float = -50.0) -> Column:
    return level_db(x) < floor_db


def quiet_windows(windows: DataFrame, file: str, window: str = "window", q: float = 0.4) -> DataFrame:
    """Usable windows (rms > 1e-4, peak < 0.95) no louder than the file's q-quantile.

    Files with at most three usable windows keep them all. Groups are the windows of one file.
    """
    w = Window.partitionBy(file)
    d = windows.withColumn("rms", F.round(rms(F.col(window)), 12)).withColumn("peak", peak(F.col(window)))
    ok = d.filter((F.col("rms") > 1e-4) & (F.col("peak") < 0.95))
    limit = F.when(F.count(F.lit(1)).over(w) <= 3, F.max("rms").over(w)).otherwise(
        F.percentile("rms", F.lit(q)).over(w))
    return ok.withColumn("_limit", limit).filter(F.col("rms") <= F.col("_limit")).drop("_limit")


def lowest_windows(windows: DataFrame, file: str, k: int, window: str = "window") -> DataFrame:
    w = Window.partitionBy(file).orderBy("rms", "win")
    return (windows.withColumn("rms", F.round(rms(F.col(window)), 12))
            .withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k))


def seeded_windows(windows: DataFrame, file: str, n: int, seed: int = 0) -> DataFrame:
    w = Window.partitionBy(file).orderBy(F.xxhash64(F.lit(seed), F.col(file), F.col("win")))
    return windows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def centre_crop(x: Column, n: int) -> Column:
    start = F.floor((F.size(x) - n) / 2).cast("int")
    return F.when(F.size(x) <= n, pad_to(x, n)).otherwise(F.slice(x, F.greatest(start, F.lit(0)) + 1, n))


def clip_around(x: Column, centre: Column, n: int) -> Column:
    """n samples centred on a position, moved inside the recording."""
    start = F.greatest(F.floor(centre - n / 2), F.lit(0))
    start = F.least(start, F.size(x) - n).cast("int")
    return F.slice(x, F.greatest(start, F.lit(0)) + 1, n)


def band_energies(x: Column, bands: dict[str, tuple[int, int]]) -> dict[str, Column]:
    """Sum of spectrum bins per band (lo inclusive, hi exclusive)."""
    return {b: vec.fold(F.transform(F.slice(x, lo + 1, hi - lo), lambda v: v.cast("double")))
            for b, (lo, hi) in bands.items()}


def band_ratios(df: DataFrame, spectrum: str, bands: dict[str, tuple[int, int]]) -> DataFrame:
    e = df.select("*", *[c.alias(f"e_{b}") for b, c in band_energies(F.col(spectrum), bands).items()])
    total = sum((F.col(f"e_{b}") for b in list(bands)[1:]), F.col(f"e_{list(bands)[0]}")) + 1e-9
    return e.select("*", *[(F.col(f"e_{b}") / total).alias(f"r_{b}") for b in bands])


def mix(a: Column, b: Column, lam: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: lam * x.cast("double") + (1 - lam) * y.cast("double"))


def unit_hash(key: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1_000_000)) / 1e6


def beta_half(u: Column) -> Column:
    """A draw from the Beta(1/2, 1/2) distribution from a uniform one: its inverse distribution is closed."""
    return F.pow(F.sin(F.lit(math.pi / 2) * u), 2)


def _numbered(df: DataFrame, key: str, seed: int, out: str) -> DataFrame:
    """Rows numbered from 0 over the whole table in the order of a seeded hash."""
    h = df.withColumn("_all", F.lit(0)).withColumn("_hh", F.struct(F.xxhash64(F.lit(seed), key).alias("h"), F.col(key).alias("k")))
    return rank.positions(h, "_all", "_hh", "_pos").withColumn(out, F.col("_pos") - 1).drop("_all", "_hh", "_pos")


def _chosen(df: DataFrame, backgrounds: DataFrame, key: str, taxon: str, p_aves: float, p_other: float, p_pair: float,
            seed: int) -> tuple[DataFrame, DataFrame]:
    """df with _no, _mode, _bno and _pno (numbers of the partner drawn), and the numbered backgrounds."""
    k = F.col(key)
    own, bg = _numbered(df, key, seed, "_no"), _numbered(backgrounds, key, seed, "_bno")
    counts = attach(df.agg(F.count(F.lit(1)).alias("_np")), backgrounds.agg(F.count(F.lit(1)).alias("_nb")))
    use_bg = (F.col("_nb") > 0) & (unit_hash(k, seed + 1) < F.when(F.col(taxon) == "Aves", p_aves).otherwise(p_other))
    use_pair = unit_hash(k, seed + 2) < p_pair
    draw = F.pmod(F.xxhash64(F.lit(seed + 4), k), F.lit(1 << 60))
    d = attach(own, counts).withColumn("_mode", F.when(use_bg, "background")
                                       .when(use_pair & (F.col("_np") > 1), "pair").otherwise("plain"))
    return (d.withColumn("_bno", F.when(F.col("_mode") == "background", F.pmod(draw, F.greatest("_nb", F.lit(1)))))
            .withColumn("_pno", F.when(F.col("_mode") == "pair", F.pmod(
                F.col("_no") + 1 + F.pmod(draw, F.greatest(F.col("_np") - 1, F.lit(1))), F.col("_np")))), bg)


def assemble_mixes(df: DataFrame, backgrounds: DataFrame, key: str, samples: str, taxon: str,
                   p_aves: float = 0.3, p_other: float = 0.6, lam_lo: float = 0.5,
                   lam_hi: float = 0.9, p_pair: float = 0.5, seed: int = 0) -> DataFrame:
    """Background mix (label kept) or pair mix (labels shared), chosen by seeded hashes.

    Partners come from an equi join on row numbers over the whole table, so every background, and every
    other row, can be drawn at any size. The pair share is max(b, 1-b) with b from Beta(1/2, 1/2);
    x' = lam x + (1-lam) partner. Without backgrounds all rows take the
    way of pairs; without other rows a sample stays plain.
    """
    beta = unit_hash(F.col(key), seed + 3)
    half = beta_half(beta)
    lam = (F.when(F.col("_mode") == "background", lam_lo + (lam_hi - lam_lo) * beta)
           .when(F.col("_mode") == "pair", F.greatest(half, 1 - half)).otherwise(1.0))
    d, bg = _chosen(df, backgrounds, key, taxon, p_aves, p_other, p_pair, seed)
    d = d.withColumn("lam", lam)
    bg = bg.select("_bno", F.col(key).alias("bg_key"), F.col(samples).alias("_bg"))
    mates = d.select(F.col("_no").alias("_pno"), F.col(key).alias("pair_key"), F.col(samples).alias("_px"))
    d = d.join(bg, "_bno", "left").join(mates, "_pno", "left")
    other = F.when(F.col("_mode") == "background", F.col("_bg")).otherwise(F.col("_px"))
    mixed = F.when(other.isNull(), F.transform(samples, lambda v: v.cast("double"))).otherwise(
        mix(F.col(samples), other, F.col("lam")))
    # background mixes keep the full label; pairs share it
    share = F.when(F.col("_mode") == "pair", F.col("lam")).otherwise(1.0)
    return d.select(key, F.col("_mode").alias("mode"), "lam", "bg_key", "pair_key",
                    share.alias("label_share"), mixed.alias("mixed"))


def swap_run(a: Column, b: Column, start: Column, length: Column) -> Column:
    """Windows start..start+length-1 of a replaced by those of b; a keeps its length, missing windows their own."""
    return F.transform(a, lambda x, i: F.when((i >= start) & (i < start + length) & (i < F.size(b)), F.get(b, i)).otherwise(x))


def mix_series(df: DataFrame, key: str, windows: str, p_swap: float = 0.5, seed: int = 0) -> DataFrame:
    """Series form: a file takes a run of windows from another file; labels are shared by the length of the run.

    windows: the file's windows in order, one array entry each. The share that stays is max(b, 1-b) with b
    from Beta(1/2, 1/2), so the run has round((1-share) x windows) of them and starts where a hash says.
    Returns key, pair_key (null: left as it is), start, length, label_share (of the file's own labels), mixed.
    """
    k = F.col(key)
    own = _numbered(df.select(key, windows), key, seed, "_no")
    counts = df.agg(F.count(F.lit(1)).alias("_np"))
    half = beta_half(unit_hash(k, seed + 3))
    n = F.size(windows)
    swaps = (unit_hash(k, seed + 2) < p_swap) & (F.col("_np") > 1)
    draw = F.pmod(F.xxhash64(F.lit(seed + 4), k), F.lit(1 << 60))
    d = (attach(own, counts).withColumn("_pno", F.when(swaps, F.pmod(F.col("_no") + 1 + F.pmod(draw, F.greatest(F.col("_np") - 1, F.lit(1))), F.col("_np"))))
         .withColumn("length", F.when(swaps, F.round((1 - F.greatest(half, 1 - half)) * n)).otherwise(0).cast("int")))
    d = d.withColumn("start", F.pmod(F.xxhash64(F.lit(seed + 5), k), (n - F.col("length") + 1).cast("long")).cast("int"))
    mates = own.select(F.col("_no").alias("_pno"), F.col(key).alias("pair_key"), F.col(windows).alias("_b"))
    d = d.join(mates, "_pno", "left")
    mixed = F.when(F.col("pair_key").isNull(), F.col(windows)).otherwise(swap_run(F.col(windows), F.col("_b"), F.col("start"), F.col("length")))
    taken = F.greatest(F.least(F.col("length"), F.size("_b") - F.col("start")), F.lit(0))
    share = F.when(F.col("pair_key").isNull() | (n <= 0), F.lit(1.0)).otherwise(1 - taken / n)
    return d.select(key, "pair_key", "start", "length", share.alias("label_share"), mixed.alias("mixed"))
