"""Naive Bayes support vectors: n-gram indicators times class log-count ratios, linear hinge loss.

A text is read in windows of about WINDOW bytes, cut at white space, so that no text fills the table of
features. A window's features are indicators: words and symbol runs alone and in pairs, runs of up to four
shapes (lower case, capitalised, upper case, mixed, digits, symbols, or the same as the one before), and
whether a line stands in it twice; each has one of PLACES places by hash. Over all labelled training
texts the documents of either class are counted per place; a feature's value is the log of the ratio of
its smoothed shares. Rows scaled to length one then train a linear model with hinge loss by dual
coordinate descent: one multiplier a row, kept inside its box, changed to its optimum in turn until no
step is left, in a bounded sample of the labelled rows. Rows set aside from the sample turn margins into
probabilities. A text's score is that of the mean margin of its windows.
"""
from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dawnscore.llm.common import small_batches, texts

PLACES = 1 << 20
WINDOW = 100_000                  # bytes
SMOOTHING = 1.0
FIT_ROWS = 5_000                  # the bounded sample of labelled texts for the hinge loss: expected rows, both classes,
FIT_FEATURES = 12_000_000         # and expected features in them; class ratios and counts are over all labelled texts
ROUNDS, BOX, TOLERANCE = 60, 1.0, 1e-3
BROADCAST_LABELS = 1_000_000      # 16 MB; with more, texts and labels are shuffled
THRESHOLD = 0.3
_TOKEN = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\sA-Za-z0-9\x80-\xff]+")
_SPACE = re.compile(rb"\s")
_SHIFT = np.uint64(64 - 20)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_SAME = 7                         # shape of a token equal to the one before


def _shape(token: bytes) -> int:
    if not (token[0] >= 128 or token.isalnum() or token[:1].isalnum()):
        return 6
    if token.isdigit():
        return 5
    lower, upper = token != token.upper(), token != token.lower()
    return 1 if not upper else 3 if not lower and len(token) > 1 else 2 if token[1:] == token[1:].lower() else 4


class _Tokens(dict):
    """Token -> CRC and shape in one number; kept up to a bound."""

    def __missing__(self, token: bytes) -> int:
        value = crc32(token) | _shape(token) << 32
        if len(token) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[token] = value
        return value


def windows(raw: bytes) -> Iterator[bytes]:
    """The text in stretches of WINDOW bytes and the rest of a word; an empty text is one empty window."""
    at = 0
    while True:
        end = _SPACE.search(raw, at + WINDOW) if len(raw) - at > WINDOW else None
        yield raw[at:end.start() if end else len(raw)]
        if not end:
            return
        at = end.start()


def features(raw: bytes, tokens: _Tokens) -> np.ndarray:
    """Places of one window's indicators, ascending, each once."""
    found = _TOKEN.findall(raw)
    value = np.fromiter(map(tokens.__getitem__, found), np.uint64, len(found))
    if not len(value):
        return np.zeros(0, np.int32)
    word = (value & np.uint64(0xFFFFFFFF)) + np.uint64(1)
    shape = value >> np.uint64(32)
    shape[1:][word[1:] == word[:-1]] = _SAME
    with np.errstate(over="ignore"):
        parts = [word * _ODD[0], (word[:-1] * _ODD[1]) ^ (word[1:] * _ODD[2]) * _ODD[0]]
        run = shape + np.uint64(1)
        for n in range(1, 5):
            if n > 1:
                run = run[:len(shape) - n + 1] * np.uint64(8) + shape[n - 1:]
            parts.append((run + np.uint64(n << 40)) * _ODD[3])
    lines = [x for x in raw.split(b"\n") if x.strip()]
    if len(set(lines)) < len(lines):
        parts.append(np.array([1 << 50], np.uint64) * _ODD[3])
    places = np.concatenate([(p ^ (p >> np.uint64(31))) * _ODD[1] >> _SHIFT for p in parts]).astype(np.int32)
    places.sort()
    return places[np.concatenate([[True], places[1:] != places[:-1]])]


def class_counts(train: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of either class per place; texts and features of either class. train: doc_id, text, label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = _Tokens(), np.zeros((2, PLACES + 2), np.int64)
        for batch in small_batches(batches):
            for text, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                counts[label, PLACES] += 1
                for part in windows((text or "").encode()):
                    places = features(part, tokens)
                    counts[label, places] += 1
                    counts[label, PLACES + 1] += len(places)
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0][at]), pa.array(counts[1][at])],
                                         names=["place", "bad", "good"])
    total = train.mapInArrow(run, "place int, bad long, good long").groupBy("place").agg(
        F.sum("bad").alias("bad"), F.sum("good").alias("good")).toArrow()  # PLACES rows at most
    out = np.zeros((2, PLACES + 2), np.int64)
    at = total.column("place").to_numpy()
    out[0, at], out[1, at] = total.column("bad").to_numpy(), total.column("good").to_numpy()
    return out[:, :PLACES], out[:, PLACES], out[:, PLACES + 1]


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """Log of the ratio of smoothed shares, good to bad; 0 where a place was never seen."""
    smooth = counts + SMOOTHING
    ratio = np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())
    return np.where(counts.any(axis=0), ratio, 0).astype(np.float32)


def descend(rows: list[np.ndarray], signs: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias with the least half squared length plus BOX-weighted hinge losses, by dual coordinate descent.

    rows: places of the indicators; signs: 1 or -1. Both classes have the same total weight in the loss.
    """
    weights, bias = np.zeros(len(ratios)), 0.0
    values = [ratios[x].astype(np.float64) for x in rows]
    values = [v / max(np.sqrt((v * v).sum()), 1e-9) for v in values]
    square = np.array([(v * v).sum() + 1 for v in values])
    boxes = np.where(signs > 0, len(signs) / max(2 * (signs > 0).sum(), 1), len(signs) / max(2 * (signs < 0).sum(), 1)) * BOX
    alpha = np.zeros(len(rows))
    order = np.arange(len(rows))
    rng = np.random.default_rng(7)
    for _ in range(ROUNDS):
        rng.shuffle(order)
        most = 0.0
        for i in order.tolist():
            places, x, sign = rows[i], values[i], signs[i]
            slope = sign * (float(weights[places] @ x) + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), boxes[i])
            step = (new - alpha[i]) * sign
            if step:
                most = max(most, abs(step))
                weights[places] += step * x     # places are distinct
                bias += step
                alpha[i] = new
        if most < TOLERANCE:
            break
    return weights, bias


def calibrate(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a sigmoid by Newton steps on smoothed targets; the slope is kept positive."""
    good, bad = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, offset = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + offset, -30, 30)))
        gap, wide = p - target, p * (1 - p)
        gradient = np.array([(gap * margins).sum() + 1e-3 * (slope - 1), gap.sum()])
        curve = np.array([[(wide * margins * margins).sum() + 1e-3, (wide * margins).sum()], [(wide * margins).sum(), wide.sum() + 1e-6]])
        step = np.linalg.solve(curve, gradient)
        size = min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        slope, offset = slope - size * step[0], offset - size * step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (float(slope), float(offset)) if slope > 0 else (1e-6, float(np.log((good + 1) / (bad + 1))))


def margin(raw: bytes, tokens: _Tokens, products: np.ndarray, squares: np.ndarray, bias: float) -> float:
    """Mean margin of a text's windows; products: ratio times weight, squares: ratio squared, per place."""
    out = []
    for part in windows(raw):
        places = features(part, tokens)
        length = np.sqrt(squares[places].sum(dtype=np.float64))
        out.append(float(products[places].sum(dtype=np.float64)) / max(length, 1e-9) + bias)
    return float(np.mean(out))


def _hash(column: str) -> Column:
    """0 to 2^32 - 1 from the id, unrelated to its CRC."""
    return F.conv(F.substring(F.sha2(F.col(column).cast("string"), 256), 1, 8), 16, 10).cast("double")


class Model:
    """products, squares, bias, and the sigmoid (slope, offset)."""

    def __init__(self, products: np.ndarray, squares: np.ndarray, bias: float, slope: float, offset: float):
        self.products, self.squares, self.bias, self.slope, self.offset = products, squares, bias, slope, offset

    def score(self, raw: bytes, tokens: _Tokens) -> float:
        x = self.slope * margin(raw, tokens, self.products, self.squares, self.bias) + self.offset
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def fit(train: DataFrame) -> Model:
    """train: doc_id, text, label (0 or 1). Without one of the classes every score is the smoothed share of good texts."""
    counts, n_texts, n_features = class_counts(train)
    bad, good = (int(x) for x in n_texts)
    if not bad or not good:
        share = (good + 1) / (bad + good + 2)
        return Model(np.zeros(PLACES, np.float32), np.zeros(PLACES, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    ratios = log_ratios(counts)
    # equal shares of the sample for both classes, by the hash of the id
    share = [min(1.0, FIT_ROWS / 2 / int(n), FIT_FEATURES / 2 / max(int(f), 1)) for n, f in zip(n_texts, n_features, strict=True)]
    sample = train.filter(_hash("doc_id") < F.when(F.col("label") == 1, share[1]).otherwise(share[0]) * 2.0 ** 32)
    shipped = train.sparkSession.sparkContext.broadcast(ratios)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens()
        for batch in small_batches(batches):
            rows = [(i, label, features(part, tokens).tobytes())
                    for i, text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True)
                    for part in windows((text or "").encode())]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                                              pa.array([r[2] for r in rows], pa.binary())], names=["doc_id", "label", "places"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratios = shipped.value
        found = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: (r[0], r[1], r[2]))
        rows = [np.frombuffer(r[2], np.int32) for r in found]
        aside = np.array([crc32(f"aside:{r[0]}".encode()) % 5 == 0 for r in found], bool)
        labels = np.array([r[1] for r in found])
        if len(set(labels[~aside].tolist())) < 2 or len(set(labels[aside].tolist())) < 2:
            aside[:] = False                      # too few rows to set some aside
        taught = np.flatnonzero(~aside)
        weights, bias = descend([rows[i] for i in taught], np.where(labels[taught] == 1, 1.0, -1.0), ratios)
        products, squares = (weights * ratios).astype(np.float32), ratios * ratios
        margins = np.array([float(products[x].sum(dtype=np.float64)) / max(np.sqrt(squares[x].sum(dtype=np.float64)), 1e-9) + bias
                            for x in rows])
        chosen = aside if aside.any() else ~aside
        slope, offset = calibrate(margins[chosen], labels[chosen])
        yield pa.RecordBatch.from_arrays([pa.array([products.tobytes()], pa.binary()), pa.array([bias]), pa.array([slope]), pa.array([offset])],
                                         names=["products", "bias", "slope", "offset"])
    row = (sample.mapInArrow(places, "doc_id long, label int, places binary").repartition(1)
           .mapInArrow(learn, "products binary, bias double, slope double, offset double").first())
    # the sample may hold more of one class than all labels do: the offset goes back to their own shares
    offset = row.offset + float(np.log(share[0] / share[1]))
    return Model(np.frombuffer(row.products, np.float32), ratios * ratios, row.bias, row.slope, offset)


def quality(docs: DataFrame, labels: DataFrame, label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (1 from the threshold on) per row of docs.

    Learns from the labelled documents whose crc32(doc_id as text) modulo 5 is not 0; those with 0 are held
    out. Several labels of an id count as their mean, at one half as good; null labels and ids do not count.
    Null and empty texts have no features and get the score of the bias. Rows with a null id are scored, not
    held out and never learned from; repeated rows count each. An empty docs table gives no rows, and
    without labels every score is one half. Other columns are not read.
    """
    source = texts(docs)
    held_out = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0, F.lit(False))
    known = (labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).alias("value")).filter("id is not null and value is not null")
             .groupBy("id").agg((F.avg("value") >= 0.5).cast("int").alias("label")))
    if labels.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    train = source.filter(~held_out).join(known, F.col("doc_id") == F.col("id")).select("doc_id", "text", "label")
    shipped = docs.sparkSession.sparkContext.broadcast(fit(train))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tokens = shipped.value, _Tokens()
        for batch in small_batches(batches):
            scores = [model.score((text or "").encode(), tokens) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])
    scored = source.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
