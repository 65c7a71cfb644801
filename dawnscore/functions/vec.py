"""Array-as-vector expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fold(x: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return fold(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(fold(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def unit(a: Column, eps: float = 1e-9) -> Column:
    """a / (|a| + eps); bind `a` to a column so that the norm is computed once."""
    n = norm(a) + F.lit(eps)
    return F.zip_with(a, F.array_repeat(n, F.size(a)), lambda x, s: x.cast("double") / s)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))


def blend(a: Column, b: Column, wa: Column, wb: Column) -> Column:
    return F.zip_with(F.transform(a, lambda x: x.cast("double") * wa),
                      F.transform(b, lambda y: y.cast("double") * wb), lambda x, y: x + y)


def dense(entries: Column, size: int, empty: Column) -> Column:
    """Sorted array of (slot, v) structs -> array of `size` values, `empty` where a slot is missing.

    One linear pass: every entry is preceded by as many empties as slots were skipped.
    """
    before = F.concat(F.array(F.lit(-1)), F.transform(
        F.slice(entries, F.lit(1), F.greatest(F.size(entries) - 1, F.lit(0))), lambda e: e["slot"].cast("int")))
    parts = F.zip_with(entries, F.slice(before, F.lit(1), F.size(entries)), lambda e, p: F.concat(
        F.array_repeat(empty, (e["slot"] - p - 1).cast("int")), F.array(e["v"])))
    rest = F.lit(size) - 1 - F.coalesce(F.try_element_at(entries, F.lit(-1))["slot"], F.lit(-1))
    return F.concat(F.flatten(parts), F.array_repeat(empty, rest.cast("int")))
