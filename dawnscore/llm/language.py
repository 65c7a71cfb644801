"""Language by a string kernel: blended-spectrum presence kernel, Nyström landmarks, ridge regression.

The kernel of two windows of text is the number of character n-grams (n = 1..4, lower case, hashed to
`DIMS` places) present in both, divided by the root of the product of their numbers. A window holds at
most `WINDOW` characters, so its row never fills up; a text's kernel with a landmark is the mean over
its windows, weighted by length. Landmarks are windows of the training sample; with K the landmarks'
kernel, a text's features are k(text, landmarks) K^(-1/2). One ridge regression per language against
the rest gives the scores; whole batches of windows are scored by two matrix products.
"""
from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dawnscore.llm.common import arrow_rows, small_batches, staged

LENGTHS = (1, 2, 3, 4)
DIMS = 1 << 13
WINDOW = 2_000         # characters
PER_LANGUAGE = 300     # bounds of the training sample: texts per language, each with one of its windows,
SAMPLE_ROWS = 30_000   # and of all languages (with over 100 languages fewer of each, at least one)
MAX_LANGUAGES = 10_000  # more are refused, none is left out
LANDMARKS = 160
RIDGE = 1e-2
UNKNOWN = "und"
_LATIN_LETTER = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]")
_MIX = np.uint32(0x9E3779B1)


def has_letter(text: str | None) -> bool:
    return bool(text) and (_LATIN_LETTER.search(text) is not None or any(map(str.isalpha, text)))


def windows(text: str) -> list[str]:
    """Windows of about equal length that cover the text; neighbours overlap so that no n-gram is cut."""
    count = max(1, -(-len(text) // WINDOW))
    step = -(-len(text) // count)
    return [text[max(0, k * step - max(LENGTHS) + 1):(k + 1) * step] for k in range(count)]


def training_window(text: str, doc_id: int) -> str:
    """The window of a training text by a hash of its id, or the next one that holds a letter."""
    parts = windows(text)
    start = zlib.crc32(str(doc_id).encode()) % len(parts)
    return next((w for w in parts[start:] + parts[:start] if has_letter(w)), "")


def presence(texts: list[str]) -> np.ndarray:
    """One row of DIMS places per text: True where a hashed n-gram is present."""
    out = np.zeros((len(texts), DIMS), bool)
    flat = out.reshape(-1)
    sizes = [len(t) for t in texts]
    codes = np.frombuffer("".join(texts).lower().encode("utf-32-le", "surrogatepass"), "<u4")
    if len(codes) != sum(sizes):  # lower case may change lengths
        texts = [t.lower() for t in texts]
        sizes = [len(t) for t in texts]
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    row = np.repeat(np.arange(len(texts), dtype=np.int64) * DIMS, sizes)
    rolling = np.zeros(len(codes), np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, max(LENGTHS) + 1):
            keep = len(codes) - n + 1
            if keep <= 0:
                break
            rolling = (rolling[:keep] ^ codes[n - 1:]) * _MIX + np.uint32(n)
            rolling ^= rolling >> np.uint32(15)
            if n in LENGTHS:
                place = row[:keep] + (rolling & np.uint32(DIMS - 1))
                flat[place if n == 1 else place[row[:keep] == row[n - 1:]]] = True
    return out


@dataclass
class Model:
    languages: list[str]
    landmarks: np.ndarray     # DIMS × landmarks
    norms: np.ndarray         # of the landmarks
    weights: np.ndarray       # landmarks × languages

    def scores(self, present: np.ndarray) -> np.ndarray:
        x = present.astype(np.float32)
        size = np.sqrt(np.maximum(x.sum(axis=1), 1))
        return ((x @ self.landmarks) / (size[:, None] * self.norms)) @ self.weights


def fit(languages: list[str], bits: np.ndarray, names: list[str], *, landmarks: int = LANDMARKS,
        ridge: float = RIDGE) -> Model:
    """languages: of each row of bits (packed presence). Landmarks are taken from the languages in turn."""
    turn: dict[str, int] = {}
    rank = []
    for language in languages:
        rank.append(turn.setdefault(language, 0))
        turn[language] += 1
    order = sorted(range(len(languages)), key=lambda k: (rank[k], k))
    chosen = order[:max(landmarks, len(names))]
    marks = np.unpackbits(bits[chosen], axis=1).astype(np.float32)
    norms = np.sqrt(np.maximum(marks.sum(axis=1), 1))
    blocks = []
    for at in range(0, len(bits), 2_000):      # unpacked rows are held for one block at a time
        x = np.unpackbits(bits[at:at + 2_000], axis=1).astype(np.float32)
        blocks.append((x @ marks.T) / (np.sqrt(np.maximum(x.sum(axis=1), 1))[:, None] * norms))
    kernel = np.concatenate(blocks)
    values, vectors = np.linalg.eigh(kernel[chosen].astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ root
    target = np.where(np.array(languages)[:, None] == np.array(names)[None, :], 1.0, -1.0)
    share = np.array([turn[n] for n in languages], float)
    weight = (len(languages) / len(names) / share)[:, None]     # languages count alike
    gram = features.T @ (features * weight) + ridge * len(languages) * np.eye(features.shape[1]) / 100
    solved = np.linalg.solve(gram, features.T @ (target * weight))
    return Model(names, np.ascontiguousarray(marks.T), norms, (root @ solved).astype(np.float32))


def text_scores(model: Model, texts: list[str]) -> np.ndarray:
    """Scores of whole texts: means over their windows that hold a letter, weighted by length."""
    total = np.zeros((len(texts), len(model.languages)))
    mass = np.zeros(len(texts))
    parts: list[str] = []
    owners: list[int] = []

    def flush() -> None:
        sizes = np.array([len(p) for p in parts], float)
        np.add.at(total, owners, model.scores(presence(parts)) * sizes[:, None])
        np.add.at(mass, owners, sizes)
        parts.clear()
        owners.clear()

    for k, text in enumerate(texts):
        for part in windows(text):
            if has_letter(part):
                parts.append(part)
                owners.append(k)
                if len(parts) == 256:
                    flush()
    if parts:
        flush()
    return total / np.maximum(mass, 1)[:, None]


def _sample(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Bounded training sample: texts of every language by the order of a hash of the id, as packed rows."""
    learn = docs.filter("not held_out and lang is not null and text is not null and doc_id is not null")
    count = learn.select(F.count_distinct("lang")).head()[0]
    if count > MAX_LANGUAGES:
        raise ValueError(f"{count} values of lang: at most {MAX_LANGUAGES} languages are meant")
    each = max(1, min(PER_LANGUAGE, SAMPLE_ROWS // max(count, 1)))
    ids = (learn.select("doc_id", "lang")
           .withColumn("at", F.row_number().over(
               Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")))
           .filter(f"at <= {each}").select(F.col("doc_id").alias("id")))
    ids = staged(ids.distinct(), "language-sample")  # at most SAMPLE_ROWS ids

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = [training_window(t, i) for i, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            packed = np.packbits(presence(texts), axis=1)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array([p.tobytes() for p in packed], pa.binary()),
                pa.array([bool(t) for t in texts])], names=["doc_id", "lang", "bits", "letters"])
    chosen = learn.join(F.broadcast(ids), learn["doc_id"] == ids["id"], "left_semi")
    rows = (chosen.select("doc_id", "lang", "text").mapInArrow(bits, "doc_id long, lang string, bits binary, letters boolean")
            .filter("letters").groupBy("doc_id").agg(F.min(F.struct("lang", "bits")).alias("x"))
            .select("doc_id", "x.*").orderBy(F.xxhash64("doc_id"), "doc_id").collect())
    packed = np.array([np.frombuffer(r.bits, np.uint8) for r in rows], np.uint8).reshape(-1, DIMS // 8)
    return [r.lang for r in rows], packed


def predict(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score per row of docs.

    held_out rows (crc32 of the id as text, mod 4, is 2) are never learned from. Null texts and texts
    without a letter are `und` with score 0, as is everything if there is nothing to learn from. Rows
    without an id are predicted, not learned from, and not held out. Equal scores go to the language
    that sorts first. Repeated rows give equal rows, an empty table none. Other columns are not read.
    """
    arrow_rows(docs.sparkSession)
    picked = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"),
        F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"))
    languages, packed = _sample(picked)
    model = fit(languages, packed, sorted(set(languages))) if languages else None
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = shipped.value
        for batch in small_batches(batches):
            texts = batch.column(2).to_pylist()
            names, values = [UNKNOWN] * len(texts), np.zeros(len(texts))
            wanted = [k for k, t in enumerate(texts) if here is not None and has_letter(t)]
            if wanted:
                scores = text_scores(here, [texts[k] for k in wanted])
                best = scores.argmax(axis=1)
                values[wanted] = np.clip((scores[np.arange(len(wanted)), best] + 1) / 2, 0, 1)
                for k, b in zip(wanted, best.tolist(), strict=True):
                    names[k] = here.languages[b]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names), pa.array(values)],
                names=["doc_id", "held_out", "lang_pred", "score"])
    return picked.select("doc_id", "held_out", "text").mapInArrow(
        run, "doc_id long, held_out boolean, lang_pred string, score double")
