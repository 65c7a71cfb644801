"""Audit lines for whole grids of lever parameters, from the cells that each grid point moves.

A lever leaves most cells as they are. Instead of copying every cell per grid point, a cell emits one
row for each point that changes it. With P, N the counts of positives and negatives by value and dP,
dN what a point adds and takes away, the won pairs are bilinear:

    U(P + dP, N + dN) = U(P, N) + U(dP, N) + U(P, dN) + U(dP, dN)

so the base is counted once, and only moved values are placed in it and among themselves. In the
same way a row without a moved cell keeps its rank correlation of 1, and only moved rows are ranked.

The cells are read once. A task adds up its batch's counts per (class, value, point), packs them per
class and value bucket and sends them to the bucket; there the pairs inside the bucket are counted, and
pairs across buckets follow from one line per (class, bucket, point).
"""
from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dawnscore.operators import audit, levers
from dawnscore.operators.scalars import attach
from dawnscore.sources import tables

MAX_POINTS = 10_000
PER_OCTAVE = 256                        # value buckets; coarser than rank.py's, as each is one group of packed counts
_ABOVE_ONE, _FAR = 100_000, 2_000_000
_ROWS = -10 * _FAR                      # the bucket number of the lines on rows
STEP_CELLS = 2_000_000                  # cells times points whose ranks a task forms at a time
# The audited grids (low, alpha, delta of the rescue; high, alpha, delta of the suppression).
RESCUE = ((0.3, 0.4, 0.5), (0.1, 0.2, 0.3, 0.5), (0.3, 0.5))
SUPPRESS = ((0.5, 0.6, 0.7), (0.05, 0.1, 0.2, 0.3), (0.3, 0.5))
COMBINED = ((0.4, 0.5), (0.2, 0.3), (0.5, 0.6), (0.1, 0.2))
SINGLE = ((0.4, 0.5), (0.1, 0.2, 0.3))
CORRECTION = ((0.0, 0.1, 0.2, 0.3, 0.5), (0.0, 0.1, 0.2, 0.3, 0.5))


def lever_points() -> list[dict]:
    """The reference point (no lever), rescue alone, suppression alone, both, and rescue by one teacher."""
    def point(family: str, low=None, up=None, lift=None, high=None, down=None, gap=None) -> dict:
        return {"point": len(out), "family": family, "low": low, "alpha_up": up, "delta_up": lift,
                "high": high, "alpha_down": down, "delta_down": gap}

    out: list[dict] = []
    out.append(point("reference"))
    for low in RESCUE[0]:
        for up in RESCUE[1]:
            for lift in RESCUE[2]:
                out.append(point("rescue", low, up, lift))
    for high in SUPPRESS[0]:
        for down in SUPPRESS[1]:
            for gap in SUPPRESS[2]:
                out.append(point("suppress", None, None, None, high, down, gap))
    for low in COMBINED[0]:
        for up in COMBINED[1]:
            for high in COMBINED[2]:
                for down in COMBINED[3]:
                    out.append(point("both", low, up, 0.3, high, down, 0.3))
    for low in SINGLE[0]:
        for up in SINGLE[1]:
            out.append(point("single", low, up, 0.3))
    return out


def correction_points() -> list[dict]:
    return [{"point": i * len(CORRECTION[1]) + j, "alpha": a, "beta": b}
            for i, a in enumerate(CORRECTION[0]) for j, b in enumerate(CORRECTION[1])]


def lever(base: Column, a: Column, b: Column, c: Column) -> Callable[[Column], Column]:
    """Rescue of low scores by the teachers b and c (b alone in the single form), then suppression
    of high scores where a and b disagree; a point without one of the two leaves that step out."""
    def cand(s: Column) -> Column:
        second = F.when(s["family"] == "single", b).otherwise(c)
        up = levers.miss_rescue(base, b, second, s["alpha_up"], s["delta_up"], s["low"])
        return levers.alarm_suppress(up, a, b, s["alpha_down"], s["delta_down"], s["high"])
    return cand


def _literals(points: Sequence[dict]) -> Column:
    if not 0 < len(points) <= MAX_POINTS:
        raise ValueError(f"{len(points)} grid points: between 1 and {MAX_POINTS} are meant")
    kinds = {str: "string", int: "int", float: "double"}
    kind = {k: next((kinds[type(p[k])] for p in points if p[k] is not None), "double") for k in points[0]}
    fields = ", ".join(f"{k}: {t}" for k, t in kind.items())
    # one string keeps the plan small; the optimiser folds it to a literal
    return F.from_json(F.lit(json.dumps(list(points))), f"array<struct<{fields}>>")


def moved_cells(df: DataFrame, points: Sequence[dict], cand: Callable[[Column], Column],
                score: str) -> DataFrame:
    """df with _moves: the (point, value) pairs of the grid points that change the cell's score."""
    tried = F.transform(_literals(points), lambda s: F.struct(s["point"].alias("point"), cand(s).alias("value")))
    return df.withColumn("_moves", F.filter(tried, lambda m: m["value"] != F.col(score)))


def _ordered(x: pa.Array) -> np.ndarray:
    """Scores as integers in the order of Spark: null, then numbers, then NaN; equal scores, equal integers."""
    missing = x.is_null().to_numpy(zero_copy_only=False)
    v = x.fill_null(0.0).to_numpy(zero_copy_only=False) + 0.0
    v[np.isnan(v)] = np.nan
    bits = v.view(np.int64)
    out = np.where(bits < 0, bits ^ np.int64(2 ** 63 - 1), bits)
    out[missing] = -2 ** 63
    return out


def _places(order: np.ndarray) -> np.ndarray:
    """Value bucket of ordered scores, as rank.value_bucket forms them: monotone, narrow near 0 and 1."""
    bits = np.where(order < 0, order ^ np.int64(2 ** 63 - 1), order)
    v = bits.view(np.float64)
    size = np.abs(v)
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(size <= 0.5, np.floor(np.log2(size) * PER_OCTAVE), np.where(
            size < 1, -2 * PER_OCTAVE - np.floor(np.log2(1 - size) * PER_OCTAVE), _ABOVE_ONE + np.floor(np.log2(size) * PER_OCTAVE)))
        placed = np.where(v > 0, part + _FAR, np.where(v < 0, -(part + _FAR), 0.0))
    placed = np.where(size == np.inf, np.sign(v) * 2 * _FAR, placed)
    return np.where(np.isnan(v), 3 * _FAR, placed).astype(np.int64)


def _ranks(m: np.ndarray) -> np.ndarray:
    """Average ranks within each line of m."""
    order = np.argsort(m, axis=1, kind="stable")
    s = np.take_along_axis(m, order, axis=1)
    turn = s[:, 1:] != s[:, :-1]
    n, edge = m.shape[1], np.ones((len(m), 1), bool)
    first = np.maximum.accumulate(np.where(np.hstack([edge, turn]), np.arange(n), 0), axis=1)
    last = np.minimum.accumulate(np.where(np.hstack([turn, edge]), np.arange(n), n)[:, ::-1], axis=1)[:, ::-1]
    out = np.empty(m.shape)
    np.put_along_axis(out, order, (first + last) / 2 + 1, axis=1)
    return out


def _rho(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pearson correlation line by line, NaN where a side is constant (metrics.pearson)."""
    a, b = a - a.mean(axis=1, keepdims=True), b - b.mean(axis=1, keepdims=True)
    sa, sb = np.sqrt((a * a).mean(axis=1)), np.sqrt((b * b).mean(axis=1))
    ok = (sa > 1e-12) & (sb > 1e-12)
    return np.where(ok, (a * b).mean(axis=1) / np.where(ok, sa * sb, 1.0), np.nan)


def _row_sums(starts: np.ndarray, base: np.ndarray, cell: np.ndarray, point: np.ndarray, moved: np.ndarray,
              n_points: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Per point what its moved rows add to the sum and number of rank correlations; number of rows that have one.

    Row r holds the cells starts[r] ... starts[r + 1] - 1; move i puts the score moved[i] into cell[i] at point[i].
    """
    rho, rows, whole = np.zeros(n_points), np.zeros(n_points, np.int64), 0
    sizes = np.diff(starts)
    first_move = np.searchsorted(cell, starts)          # moves stand in the order of their cells
    for size in np.unique(sizes[sizes > 0]):
        its = np.flatnonzero(sizes == size)
        step = max(1, STEP_CELLS // int(size * n_points))
        for some in (its[i:i + step] for i in range(0, len(its), step)):
            m = base[starts[some][:, None] + np.arange(size)]
            varies = (m != m[:, :1]).any(axis=1)
            whole += int(varies.sum())
            lens = first_move[some + 1] - first_move[some]
            if not lens.any():
                continue
            at = np.repeat(first_move[some] - np.cumsum(lens) + lens, lens) + np.arange(lens.sum())
            row = np.repeat(np.arange(len(some)), lens)
            touched = np.zeros((len(some), n_points), bool)
            touched[row, point[at]] = True
            r, p = np.nonzero(touched)
            number = np.cumsum(touched).reshape(touched.shape) - 1
            cand = m[r]
            cand[number[row, point[at]], cell[at] - starts[some][row]] = moved[at]
            got = _rho(_ranks(m)[r], _ranks(cand))
            rho += np.bincount(p, np.nan_to_num(got) - varies[r], n_points)
            rows += np.bincount(p, ~np.isnan(got) * 1.0 - varies[r], n_points).astype(np.int64)
    return rho, rows, whole


def _pack(value: np.ndarray, point: np.ndarray, dp: np.ndarray, dn: np.ndarray) -> bytes:
    """Entries sorted by (value, point), each value once."""
    start = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    size = np.diff(np.r_[start, len(value)]).astype(np.int32)
    parts = (np.array([len(start), len(value)], np.int64), value[start], size, point.astype(np.int16),
             dp.astype(np.int32), dn.astype(np.int32))
    return b"".join(p.tobytes() for p in parts)


def _unpack(raw: bytes) -> tuple[np.ndarray, ...]:
    n, m = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    at, out = 16, []
    for kind, count in ((np.int64, n), (np.int32, n), (np.int16, m), (np.int32, m), (np.int32, m)):
        out.append(np.frombuffer(raw, kind, count, at))
        at += count * np.dtype(kind).itemsize
    value, size, point, dp, dn = out
    return np.repeat(value, size), point.astype(np.int64), dp.astype(np.int64), dn.astype(np.int64)


def _added(value: np.ndarray, point: np.ndarray, dp: np.ndarray, dn: np.ndarray) -> tuple[np.ndarray, ...]:
    """Entries of one (value, point) summed up, in that order; what cancels out drops."""
    order = np.lexsort((point, value))
    value, point, dp, dn = value[order], point[order], dp[order], dn[order]
    start = np.flatnonzero(np.r_[True, (value[1:] != value[:-1]) | (point[1:] != point[:-1])]) if len(value) else order
    dp, dn = (np.add.reduceat(x, start) if len(start) else x for x in (dp, dn))
    keep = (dp != 0) | (dn != 0)
    return value[start][keep], point[start][keep], dp[keep], dn[keep]


_PIECES = "class string, taxon string, bucket long, counts binary"
_PARTS = "class string, taxon string, bucket long, point int, won double, dp double, dn double"


def _pieces(points: np.ndarray):
    """Rows of cells -> packed counts per class and value bucket, and one line of row correlations a batch."""
    n_points = len(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0)
            starts = np.r_[0, np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))].astype(np.int64)
            cls, taxon, y, score, moves = column.flatten().flatten()
            base, lens = _ordered(score), pc.list_value_length(moves).to_numpy(zero_copy_only=False)
            at, value = moves.flatten().flatten()
            point = np.searchsorted(points, at.to_numpy(zero_copy_only=False))
            value, cell = _ordered(value), np.repeat(np.arange(len(base)), lens)
            rho, rows, whole = _row_sums(starts, base, cell, point, value, n_points)
            out = [(None, None, _ROWS, rho.tobytes() + rows.tobytes() + np.int64(whole).tobytes())]
            # a move takes the old score away and adds the new one; point n_points holds the scores themselves
            held = np.flatnonzero(~y.is_null().to_numpy(zero_copy_only=False) & (base != -2 ** 63))
            y = y.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            counted = np.zeros(len(base), bool)
            counted[held] = True
            ok = counted[cell]
            cell, point, value = cell[ok], point[ok], value[ok]
            where = np.r_[held, cell, cell]
            sign = np.r_[np.ones(len(held), np.int64), -np.ones(len(cell), np.int64), np.ones(len(cell), np.int64)]
            value = np.r_[base[held], base[cell], value]
            point = np.r_[np.full(len(held), n_points), point, point]
            names: dict[tuple, int] = {}
            group = np.array([names.setdefault(pair, len(names)) for pair in zip(cls.to_pylist(), taxon.to_pylist(), strict=True)], np.int64)
            for pair, g in names.items():
                its = group[where] == g
                w, sg = y[where[its]], sign[its]
                v, p, dp, dn = _added(value[its], point[its], w * sg, (1 - w) * sg)
                if not len(v):
                    continue
                bucket = _places(v)
                cut = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(v)]
                out += [(*pair, int(bucket[i]), _pack(v[i:j], p[i:j], dp[i:j], dn[i:j])) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
                zip(*out, strict=True), (pa.string(), pa.string(), pa.int64(), pa.binary()), strict=True)],
                names=["class", "taxon", "bucket", "counts"])
    return run


def _bucket_parts(points: np.ndarray):
    """All pieces of a (class, bucket) -> per point its changes of counts there and the pairs won inside the bucket."""
    n_points = len(points)

    def lines(key: tuple, point, won, dp, dn) -> pa.Table:
        n = len(point)
        return pa.table([pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.string()), pa.array([key[2]] * n, pa.int64()),
                         pa.array(point, pa.int32()), pa.array(won, pa.float64()), pa.array(dp, pa.float64()), pa.array(dn, pa.float64())],
                        names=["class", "taxon", "bucket", "point", "won", "dp", "dn"])

    def run(table: pa.Table) -> pa.Table:
        key = tuple(table.column(i)[0].as_py() for i in range(3))
        raw = table.column(3).to_pylist()
        if key[2] == _ROWS:
            rho = sum(np.frombuffer(r, np.float64, n_points) for r in raw)
            rows = sum(np.frombuffer(r, np.int64, n_points + 1, 8 * n_points) for r in raw)
            return lines(key, np.arange(n_points + 1), np.r_[rho, 0.0], rows.astype(float), np.zeros(n_points + 1))
        value, point, dp, dn = _added(*(np.concatenate(x) for x in zip(*map(_unpack, raw), strict=True)))
        own = point == n_points
        v, p, n = value[own], dp[own], dn[own]
        p_up, n_up = np.r_[0, np.cumsum(p)], np.r_[0, np.cumsum(n)]

        def won(pos, n_below, n_at):
            return pos * (n_below + n_at / 2.0)
        out = [(n_points, won(p, n_up[:-1], n).sum(), p_up[-1], n_up[-1])]
        order = np.lexsort((value[~own], point[~own]))
        mv, mp, dp, dn = value[~own][order], point[~own][order], dp[~own][order], dn[~own][order]
        if len(mv):
            low, high = np.searchsorted(v, mv, "left"), np.searchsorted(v, mv, "right")
            start = np.flatnonzero(np.r_[True, mp[1:] != mp[:-1]])
            before = np.cumsum(dn) - dn
            before -= np.repeat(before[start], np.diff(np.r_[start, len(mp)]))
            u = (won(dp, n_up[low], n_up[high] - n_up[low]) + dn * (p_up[-1] - p_up[high] + (p_up[high] - p_up[low]) / 2.0)
                 + won(dp, before, dn))
            out += zip(mp[start], *(np.add.reduceat(x, start) for x in (u, dp, dn)), strict=True)
        return lines(key, *zip(*out, strict=True))
    return run


def _parts(cells: DataFrame, points: np.ndarray, row_keys: Sequence[str], score: str, label: str) -> DataFrame:
    """The cells are read once: everything the lines need per (class, bucket, point), written to the scratch folder."""
    cell = F.struct(F.col("class").cast("string").alias("class"), F.col("taxon").cast("string").alias("taxon"),
                    F.col(label).cast("long").alias("y"), F.col(score).cast("double").alias("score"),
                    F.transform("_moves", lambda m: F.struct(m["point"].cast("int").alias("point"),
                                                             m["value"].cast("double").alias("value"))).alias("moves"))
    rows = cells.groupBy(*row_keys).agg(F.collect_list(cell).alias("_cells")).select("_cells")
    pieces = rows.mapInArrow(_pieces(points), _PIECES)
    return tables.stage(pieces.groupBy("class", "taxon", "bucket").applyInArrow(_bucket_parts(points), _PARTS), "grid-parts")


def _changes(parts: DataFrame, n_points: int) -> tuple[DataFrame, DataFrame]:
    """class AUC (class, taxon, n_pos, n_neg, auc) and the change of each point that moves scores of the class."""
    counts = parts.filter(F.col("bucket") != _ROWS)
    whole = Window.partitionBy("class", "taxon")
    lower = whole.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.filter(F.col("point") == n_points).select(
        "class", "taxon", "bucket", "won", F.col("dp").alias("p"), F.col("dn").alias("n"),
        *[F.coalesce(F.sum(c).over(lower), F.lit(0.0)).alias(f"{k}_below") for k, c in (("p", "dp"), ("n", "dn"))],
        *[F.sum(c).over(whole).alias(f"{k}_total") for k, c in (("p", "dp"), ("n", "dn"))])
    auc = (base.groupBy("class", "taxon").agg(
        F.sum(F.col("won") + F.col("p") * F.col("n_below")).alias("_u"), F.max("p_total").alias("n_pos"), F.max("n_total").alias("n_neg"))
        .filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
        .select("class", "taxon", (F.col("_u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc")))
    earlier = (Window.partitionBy("class", "taxon", "point").orderBy("bucket")
               .rowsBetween(Window.unboundedPreceding, -1))
    moved = counts.filter(F.col("point") < n_points).withColumn("_before", F.coalesce(F.sum("dn").over(earlier), F.lit(0.0)))
    there = base.select(*[F.col(c).alias(f"_{c}") for c in ("class", "taxon", "bucket")], "p", "p_below", "p_total", "n_below", "n_total")
    same = (moved["class"].eqNullSafe(F.col("_class")) & moved["taxon"].eqNullSafe(F.col("_taxon"))
            & (moved["bucket"] == F.col("_bucket")))
    u = (F.col("won") + F.col("dp") * (F.col("n_below") + F.col("_before"))
         + F.col("dn") * (F.col("p_total") - F.col("p_below") - F.col("p")))
    change = (moved.join(there, same).filter((F.col("p_total") > 0) & (F.col("n_total") > 0))
              .groupBy("point", "class", "taxon").agg((F.sum(u) / F.max(F.col("p_total") * F.col("n_total"))).alias("delta")))
    return auc, change


def audit_grid(df: DataFrame, points: Sequence[dict], cand: Callable[[Column], Column], score: str,
               row_keys: Sequence[str] = ("file_id", "win"), label: str = "y") -> DataFrame:
    """One audit line per grid point: parameters, macro AUC, changes, row Spearman, verdict, place.

    df holds row keys, class, taxon, label and score; cand gives a point's score from the point's
    struct and the columns of df, null where the score is null. place orders by macro_delta, largest
    first. Points that move nothing get a change of 0 and a correlation of 1.
    """
    numbers = np.array(sorted(p["point"] for p in points), np.int64)
    parts = _parts(moved_cells(df, points, cand, score), numbers, row_keys, score, label)
    base, change = _changes(parts, len(numbers))
    in_taxon = {f"d_{t.lower()}": F.col("taxon") == t for t in audit.TAXA}
    whole = base.agg(F.avg("auc").alias("_macro"), F.count(F.lit(1)).alias("n_classes"),
                     *[F.count_if(hit).alias(f"_n_{k}") for k, hit in in_taxon.items()])
    rows = parts.filter(F.col("bucket") == _ROWS)
    varying = rows.filter(F.col("point") == len(numbers)).agg(F.coalesce(F.sum("dp"), F.lit(0.0)).alias("_all_rows"))
    # points stand in parts by their place in the sorted list
    named = F.element_at(F.array(*[F.lit(int(n)) for n in numbers]), F.col("point") + 1).alias("point")
    change = change.groupBy("point").agg(
        F.sum("delta").alias("_d"), *[F.sum(F.when(hit, F.col("delta"))).alias(f"_s_{k}") for k, hit in in_taxon.items()])
    change = change.select(named, *[c for c in change.columns if c != "point"])
    rho = rows.filter(F.col("point") < len(numbers)).select(named, F.col("won").alias("_rho"), F.col("dp").alias("_rows"))
    lines = (attach(whole, varying).select("*", F.inline(_literals(points)))
             .join(change, "point", "left").join(rho, "point", "left"))

    def part(total: str, n: str) -> Column:
        return F.when(F.col(n) > 0, F.coalesce(total, F.lit(0.0)) / F.col(n))

    lines = lines.select(
        *points[0], (F.col("_macro") + part("_d", "n_classes")).alias("macro"),
        part("_d", "n_classes").alias("macro_delta"),
        *[part(f"_s_{k}", f"_n_{k}").alias(k) for k in in_taxon], "n_classes",
        F.expr("try_divide(_all_rows + coalesce(_rho, 0), _all_rows + coalesce(_rows, 0))").alias("sp_mean"))
    # lines number as the caller's points, so one task orders them
    best = Window.orderBy(F.desc(F.round(F.col("macro_delta") + 3.1e-13, 9)), "point")
    return (lines.withColumn("verdict", audit.verdict(F.col("sp_mean"), F.col("d_aves"), F.col("macro_delta")))
            .withColumn("place", F.row_number().over(best)))


def class_a(lines: DataFrame, by: str = "d_aves", top: int = 10) -> DataFrame:
    """The best points of verdict A by one change, the reference point left out; place among them."""
    best = Window.orderBy(F.desc_nulls_last(F.round(F.col(by) + 3.1e-13, 9)), "point")
    return (lines.filter((F.col("verdict") == "A") & (F.col("family") != "reference"))
            .withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top))
