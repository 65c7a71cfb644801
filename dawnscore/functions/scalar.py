"""Scalar score arithmetic: squashing, temperature, power, sharpening."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi)))


def sigmoid(x: Column, bound: float = 30.0) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-clip(x, -bound, bound)))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1.0 - eps)
    return F.log(q / (F.lit(1.0) - q))


def temperature(p: Column, t: Column, eps: float = 1e-6) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit(p, eps) / t))


def taxon_temperature(taxon: Column, texture=("Amphibia", "Insecta"),
                      t_texture: float = 0.95, t_event: float = 1.10) -> Column:
    return F.when(taxon.isin(*texture), F.lit(t_texture)).otherwise(F.lit(t_event))


def floor_then_power(p: Column, floor: float = 0.1, power: float = 0.5) -> Column:
    return F.pow(F.when(p < floor, F.lit(0.0)).otherwise(p), F.lit(power))


def power_then_floor(p: Column, power: float = 2.0, floor: float = 0.1) -> Column:
    q = F.pow(p, F.lit(power))
    return F.when(q < floor, F.lit(0.0)).otherwise(q)


def sharpen(p: Column, t: Column) -> Column:
    """Stretch scores away from a per-class threshold t so that t lands on 0.5."""
    up = F.lit(0.5) + F.lit(0.5) * (p - t) / (F.lit(1.0) - t)
    return clip(F.when(p > t, up).otherwise(F.lit(0.5) * p / t), 0.0, 1.0)


def total(columns) -> Column:
    """Left-to-right sum of columns."""
    return reduce(lambda a, b: a + b, columns)


# Coefficients of Acklam's approximation, central region (A / B) and tails (C / D).
ACKLAM_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
            1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
ACKLAM_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
            6.680131188771972e+01, -1.328068155288572e+01, 1.0)
ACKLAM_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
            -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
ACKLAM_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
            3.754408661907416e+00, 1.0)


def normal_quantile(p: Column) -> Column:
    """Inverse normal CDF by Acklam's published rational approximation (rel. error < 1.2e-9)."""
    def poly(coefs, x):
        return reduce(lambda acc, k: acc * x + F.lit(k), coefs[1:], F.lit(coefs[0]))

    split = 0.02425
    mid = p - 0.5
    r = mid * mid
    centre = poly(ACKLAM_A, r) * mid / poly(ACKLAM_B, r)
    q_low = F.sqrt(F.lit(-2.0) * F.log(p))
    q_high = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - p))
    return (F.when(p < split, poly(ACKLAM_C, q_low) / poly(ACKLAM_D, q_low))
            .when(p > 1 - split, -poly(ACKLAM_C, q_high) / poly(ACKLAM_D, q_high))
            .otherwise(centre))
