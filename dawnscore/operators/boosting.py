"""Boosted trees for many classes at once, from histograms.

Features are cut at common quantiles into up to BINS bins, one byte each. A tree of every class grows
level by level in the same jobs: one pass adds up gradients, curvatures and rows per (class, node,
feature, bin) inside the tasks, a shuffle by class sums them and picks the best split of each node there;
only splits reach the driver. So the number of jobs depends on rounds and levels, not on the classes, and
no class is ever gathered. Margins are written out every STAGE rounds; in between, a pass applies the few
trees that are new. The held-out AUC that stops a class comes with the first pass of the next round.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnscore.sources import tables

BINS = 64
STAGE = 10
AUC_BINS = 4096
_ODD = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Plan:
    """Parameters of the fit; the defaults are the usual ones of histogram boosting."""
    rounds: int = 200
    leaves: int = 15
    rate: float = 0.03
    least_rows: int = 20
    least_curvature: float = 1e-3
    feature_share: float = 0.8
    row_share: float = 0.8
    row_rounds: int = 5            # rounds that share a sample of the rows
    patience: int = 20
    ridge: float = 0.0
    min_pos: int = 3
    seed: int = 7


class Trees:
    """Trees of all classes: arrays (classes, trees, nodes); left -1 marks a leaf, the right child follows the left."""

    def __init__(self, classes: int, count: int, nodes: int):
        shape = (classes, count, nodes)
        self.feature, self.cut = np.zeros(shape, np.int16), np.zeros(shape, np.int16)
        self.left, self.value = np.full(shape, -1, np.int16), np.zeros(shape)

    def one(self, tree: int) -> Trees:
        out = object.__new__(Trees)
        for name in ("feature", "cut", "left", "value"):
            setattr(out, name, getattr(self, name)[:, tree:tree + 1].copy())
        return out

    def nodes(self, cls: np.ndarray, bins: np.ndarray, tree: int) -> np.ndarray:
        """Node at which each row stands in its class's tree."""
        n_nodes, n_f = self.left.shape[2], bins.shape[1]
        left, feature, cut = (np.ascontiguousarray(x[:, tree]).ravel() for x in (self.left, self.feature, self.cut))
        flat = bins.ravel()
        root = cls * n_nodes
        at, going = root.copy(), np.arange(len(cls))
        while True:
            child = left[at[going]]
            inner = child >= 0
            if not inner.all():
                going, child = going[inner], child[inner]
            if not len(going):
                return at - root
            here = at[going]
            at[going] = root[going] + child + (flat[going * n_f + feature[here]] > cut[here])

    def margins(self, cls: np.ndarray, bins: np.ndarray, first: int, last: np.ndarray | int) -> np.ndarray:
        """Sum of the trees first ... last - 1 (last: one number, or one per class)."""
        out = np.zeros(len(cls))
        ends = np.broadcast_to(last, self.left.shape[0])
        for tree in range(first, int(ends.max(initial=0))):
            value = np.ascontiguousarray(self.value[:, tree]).ravel()[cls * self.value.shape[2] + self.nodes(cls, bins, tree)]
            out += value if tree < ends.min() else np.where(tree < ends[cls], value, 0.0)
        return out


def best_split(hist: np.ndarray, allowed: np.ndarray, plan: Plan) -> tuple[float, int, int]:
    """gain, feature, last bin to the left of the best split; gain 0 where none is allowed.

    hist: (features, bins, 3) sums of gradients, curvatures and rows. Equal gains: the first feature and bin.
    """
    left = hist.cumsum(axis=1)[:, :-1]
    right = hist.sum(axis=1, keepdims=True) - left

    def part(x: np.ndarray) -> np.ndarray:
        return x[..., 0] ** 2 / (x[..., 1] + plan.ridge + 1e-12)
    gain = part(left) + part(right) - part(left + right)
    ok = np.ones(gain.shape, bool)
    for side in (left, right):
        ok &= (side[..., 2] >= plan.least_rows) & (side[..., 1] >= plan.least_curvature)
    gain = np.where(ok & allowed[:, None], np.round(gain, 9), 0.0)
    at = int(gain.argmax())
    return float(gain.ravel()[at]), at // gain.shape[1], at % gain.shape[1]


def row_sampled(mark: np.ndarray, turn: int, plan: Plan) -> np.ndarray:
    """Rows whose hash, mixed with the number of the sample, falls into the share."""
    with np.errstate(over="ignore"):
        x = (mark.astype(np.uint64) + np.uint64(turn // plan.row_rounds + 1) * np.uint64(0xBF58476D1CE4E5B9)) * _ODD
        x ^= x >> np.uint64(29)
        return (x * _ODD >> np.uint64(40)).astype(np.float64) < plan.row_share * 2 ** 24


def features_allowed(turn: int, features: int, plan: Plan) -> np.ndarray:
    """The same features for all classes in a round."""
    keep = max(1, int(round(plan.feature_share * features)))
    out = np.zeros(features, bool)
    out[np.random.default_rng([plan.seed, turn]).permutation(features)[:keep]] = True
    return out


def binned_auc(pos: np.ndarray, neg: np.ndarray) -> float:
    """AUC from counts of positives and negatives per score bin; ties count half."""
    below = np.concatenate([[0], np.cumsum(neg)[:-1]])
    total = pos.sum() * neg.sum()
    return float((pos * (below + neg / 2)).sum() / total) if total else 0.5


def _score_bins(margin: np.ndarray) -> np.ndarray:
    return np.clip((1 + margin / (1 + np.abs(margin))) / 2 * AUC_BINS, 0, AUC_BINS - 1).astype(np.int64)


def quantile_cuts(df: DataFrame, features: Sequence[str]) -> list[list[float]]:
    """Ascending distinct cut points per feature (at most BINS - 1); null and NaN stay out."""
    shares = [k / BINS for k in range(1, BINS)]
    row = df.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")), shares, 20_000).alias(f"_{i}")
                   for i, f in enumerate(features)]).first()
    return [sorted(set(row[f"_{i}"] or [])) for i in range(len(features))]


def _bin(feature: str, cuts: list[float]) -> Column:
    """Number of cut points below the value, as one byte; null and NaN go to the first bin."""
    x = F.coalesce(F.col(feature).cast("double"), F.lit(float("nan")))
    found = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<double>"), lambda c: c < x))
    return F.when(F.isnan(x), F.lit(0)).otherwise(found)


def _bytes(packed: pa.Array, features: int) -> np.ndarray:
    """Rows of a binary column of one byte per feature, without copying them one by one."""
    if not len(packed):
        return np.zeros((0, features), np.uint8)
    kind = np.dtype(np.int64 if pa.types.is_large_binary(packed.type) else np.int32)
    start = int(np.frombuffer(packed.buffers()[1], kind, 1, kind.itemsize * packed.offset)[0])
    return np.frombuffer(packed.buffers()[2], np.uint8, len(packed) * features, start).reshape(-1, features)


def _columns(batch: pa.RecordBatch, features: int) -> tuple[np.ndarray, ...]:
    cls, y, train, mark, margin = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
    return cls.astype(np.int64), y, train, mark, margin, _bytes(batch.column(5), features)


_DATA = ["_cls", "_y", "_train", "_mark", "_margin", "_bins"]


@dataclass
class Fit:
    """Trees, how many of them each class uses, and the cut points; classes without a fit use none."""
    trees: Trees
    used: np.ndarray
    cuts: list[list[float]]
    auc: np.ndarray
    jobs: int


def _prepared(df: DataFrame, features: Sequence[str], cuts: list[list[float]], classes: Sequence[str], cls: str,
              keep: Sequence[Column] = ()) -> DataFrame:
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(cls)).cast("int") - 1
    packed = F.unhex(F.concat(*[F.lpad(F.hex(_bin(f, c)), 2, "0") for f, c in zip(features, cuts, strict=True)]))
    return df.select(*keep, number.alias("_cls"), packed.alias("_bins")).filter("_cls >= 0")


def fit(df: DataFrame, features: Sequence[str], classes: Sequence[str], train: Column, key: Sequence[str],
        label: str = "y", cls: str = "class", plan: Plan = Plan()) -> Fit:
    """Fit every class with at least min_pos positives among the train rows; rows that are no train rows stop it.

    Positives weigh negatives / positives of their class. A class stops when its held-out AUC has not
    improved for `patience` rounds and uses the trees up to the best one; without held-out rows of both
    kinds it is not fitted. Null labels drop out.
    """
    features, classes = list(features), list(classes)
    spark = df.sparkSession
    n_f, n_c, n_nodes = len(features), len(classes), 2 * plan.leaves - 1
    rows = df.filter(F.col(label).isNotNull())
    cuts = quantile_cuts(rows.filter(train), features)
    data = _prepared(rows, features, cuts, classes, cls, [
        F.col(label).cast("int").alias("_y"), F.coalesce(train, F.lit(False)).alias("_train"),
        F.xxhash64(F.lit(plan.seed), *key).alias("_mark"), F.lit(0.0).alias("_margin")]).select(*_DATA)

    def stage(frame: DataFrame) -> DataFrame:
        return spark.read.schema(frame.schema).parquet(tables.write_table(frame, tables.scratch(spark, "boosting")))
    data = stage(data)
    counts = {r["_cls"]: r for r in data.groupBy("_cls").agg(
        F.sum(F.when(F.col("_train"), F.col("_y"))).alias("p"), F.count_if("_train").alias("n"),
        F.sum(F.when(~F.col("_train"), F.col("_y"))).alias("ep"), F.count_if(~F.col("_train")).alias("en")).collect()}
    weight, open_ = np.ones(n_c), np.zeros(n_c, bool)
    for c, r in counts.items():
        p, ep = r["p"] or 0, r["ep"] or 0
        open_[c] = p >= plan.min_pos and p < r["n"] and 0 < ep < r["en"]
        weight[c] = (r["n"] - p) / p if p else 1.0
    trees = Trees(n_c, plan.rounds, n_nodes)
    best, used, since, jobs = np.zeros(n_c), np.zeros(n_c, int), 0, 0

    def splits(turn: int, slots: np.ndarray, current: Trees, measure: bool) -> list:
        """One pass: the best split of every open node, and the held-out AUC where asked for."""
        allowed = features_allowed(turn, n_f, plan)
        past = {name: getattr(trees, name)[:, since:turn].copy() for name in ("feature", "cut", "left", "value")}
        first, running = since, open_.copy()
        most = int(slots.max()) + 1

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = object.__new__(Trees)
            for name, value in past.items():
                setattr(known, name, value)
            hist = np.zeros((n_c, most, n_f, BINS, 3))
            curve = np.zeros((n_c, 2, AUC_BINS))
            for batch in batches:
                c, y, is_train, mark, margin, bins = _columns(batch, n_f)
                live = running[c]
                slot = slots[c, current.nodes(c, bins, 0)]
                take = live & is_train & (slot >= 0) & row_sampled(mark, turn, plan)
                # only rows that count here pass through the trees that are new since the last stage
                asked = take | (live & ~is_train) if measure else take
                c, y, slot, bins, take, is_train = c[asked], y[asked], slot[asked], bins[asked], take[asked], is_train[asked]
                margin = margin[asked] + known.margins(c, bins, 0, turn - first)
                if measure:
                    test = ~is_train
                    np.add.at(curve, (c[test], 1 - y[test], _score_bins(margin[test])), 1)
                    c, y, slot, bins, margin = c[take], y[take], slot[take], bins[take], margin[take]
                p = 1 / (1 + np.exp(-margin))
                w = np.where(y == 1, weight[c], 1.0)
                place = (c * most + slot) * BINS
                amounts = (w * (p - y), w * p * (1 - p), None)
                for f in range(n_f):
                    cell = place + bins[:, f]
                    for k, amount in enumerate(amounts):
                        hist[:, :, f, :, k] += np.bincount(cell, amount, n_c * most * BINS).reshape(n_c, most, BINS)
            for c in np.flatnonzero(running):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([hist[c].tobytes()], pa.binary()),
                                                  pa.array([curve[c].tobytes() if measure else b""], pa.binary())], names=["c", "hist", "curve"])

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, list] = {}
            for batch in batches:
                for c, hist, curve in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                    held = sums.setdefault(c, [0.0, 0.0])
                    held[0] = held[0] + np.frombuffer(hist).reshape(most, n_f, BINS, 3)
                    held[1] = held[1] + (np.frombuffer(curve).reshape(2, AUC_BINS) if curve else 0.0)
            for c, (hist, curve) in sums.items():
                out = []
                for s in range(most):
                    gain, feature, cut = best_split(hist[s], allowed, plan)
                    left = hist[s][feature, :cut + 1].sum(axis=0)
                    whole = hist[s][0].sum(axis=0)
                    out += [gain, feature, cut, *left[:2], *whole[:2]]
                auc = binned_auc(*curve) if measure else 0.0
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([out], pa.list_(pa.float64())),
                                                  pa.array([auc])], names=["c", "splits", "auc"])
        partial = data.mapInArrow(add_up, "c int, hist binary, curve binary")
        return partial.repartition("c").mapInArrow(choose, "c int, splits array<double>, auc double").collect()  # a row per class

    for turn in range(plan.rounds + 1):
        if turn - since == STAGE:
            recent, first = {n: getattr(trees, n)[:, since:turn].copy() for n in ("feature", "cut", "left", "value")}, since

            def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                known = object.__new__(Trees)
                for name, value in recent.items():  # noqa: B023
                    setattr(known, name, value)
                for batch in batches:
                    c, _, _, _, margin, bins = _columns(batch, n_f)
                    yield batch.set_column(4, "_margin", pa.array(margin + known.margins(c, bins, 0, STAGE)))
            data, since, jobs = stage(data.mapInArrow(forward, data.schema)), turn, jobs + 1
        slots = np.full((n_c, n_nodes), -1)
        slots[:, 0] = 0
        sums: dict[tuple[int, int], tuple[float, float]] = {}
        filled = np.ones(n_c, int)
        leaves = np.ones(n_c, int)
        measure = True
        tree = min(turn, plan.rounds - 1)
        current = Trees(n_c, 1, n_nodes)
        while (slots >= 0).any() and open_.any():
            found = splits(turn, slots, current, measure)
            jobs += 1
            following = np.full((n_c, n_nodes), -1)
            for r in found:
                c = r["c"]
                if measure and turn:
                    if r["auc"] > best[c] + 1e-12:
                        best[c], used[c] = r["auc"], turn
                    elif turn - used[c] >= plan.patience:
                        open_[c] = False
                if not open_[c] or turn == plan.rounds:
                    continue
                offers = []
                for node in np.flatnonzero(slots[c] >= 0):
                    gain, feature, cut, lg, lh, g, h = r["splits"][7 * slots[c, node]:7 * slots[c, node] + 7]
                    sums.setdefault((c, int(node)), (g, h))
                    if gain > 0:
                        offers.append((-gain, int(node), int(feature), int(cut), lg, lh))
                slot = 0
                for _, node, feature, cut, lg, lh in sorted(offers):
                    if leaves[c] == plan.leaves:
                        break
                    child, (g, h) = filled[c], sums[(c, node)]
                    current.feature[c, 0, node], current.cut[c, 0, node], current.left[c, 0, node] = feature, cut, child
                    sums[(c, child)], sums[(c, child + 1)] = (lg, lh), (g - lg, h - lh)
                    filled[c] += 2
                    leaves[c] += 1
                    following[c, child], following[c, child + 1] = slot, slot + 1
                    slot += 2
                if leaves[c] == plan.leaves:
                    following[c] = -1
            slots, measure = following, False
            if turn == plan.rounds:
                break
        if turn == plan.rounds or not open_.any():
            break
        for (c, node), (g, h) in sums.items():
            if current.left[c, 0, node] < 0 and open_[c]:
                current.value[c, 0, node] = -plan.rate * g / (h + plan.ridge + 1e-12)
        for name in ("feature", "cut", "left", "value"):
            getattr(trees, name)[:, tree] = getattr(current, name)[:, 0]
    return Fit(trees, used, cuts, best, jobs)


def predict(df: DataFrame, model: Fit, features: Sequence[str], classes: Sequence[str], keys: Sequence[str],
            cls: str = "class") -> DataFrame:
    """keys, class, stacked: probability of every row whose class has a fit; null for the others."""
    features, classes = list(features), list(classes)
    data = _prepared(df, features, model.cuts, classes, cls, [F.col(k) for k in keys]).select(*keys, "_cls", "_bins")
    shipped = df.sparkSession.sparkContext.broadcast((model.trees, model.used))
    n_f, n_k = len(features), len(keys)
    kinds = ", ".join(f"`{k}` {data.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, used = shipped.value
        for batch in batches:
            c = batch.column(n_k).to_numpy(zero_copy_only=False).astype(np.int64)
            bins = _bytes(batch.column(n_k + 1), n_f)
            p = 1 / (1 + np.exp(-trees.margins(c, bins, 0, used)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(n_k)), pa.array([classes[i] for i in c], pa.string()), pa.array(p, mask=used[c] == 0)],
                names=[*keys, cls, "stacked"])
    return data.mapInArrow(run, f"{kinds}, `{cls}` string, stacked double")
