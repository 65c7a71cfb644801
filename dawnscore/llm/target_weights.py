"""Target-distribution importance resampling with a head-tail vocabulary.

Features are the words of a text and its pairs of neighbouring words; a feature's bucket is its CRC-32
modulo the number of buckets. Head: words and pairs that make up at least one part in HEAD of all words
or pairs (so there are never more than HEAD of each, whatever the corpus) travel to all tasks, words with
their CRC state, from which a pair's CRC goes on, pairs with their bucket. Tail: everything else takes
its CRC directly. Which features are in the head changes no result, only the time: totals are exact.

Totals over all documents and over all target texts give each bucket a gain; a document's weight is the
mean gain of its features. Adding Gumbel noise from a hash of the id and taking the highest scores draws
documents in proportion to their weights without replacement. Ranks come from counts per score (scores are
whole thousandths, so there are few) and from the order inside one score.
"""
from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dawnscore.llm.common import small_batches, staged, texts

BUCKETS = 10_000
HEAD = 20_000                    # at most so many words, and pairs, in the head
HEAD_BYTES = 64                  # longer words stay in the tail
LEAST_WORDS, SHARE, SEED = 20, 25, 7
_HELD = 200_000                  # entries of a task's table of counts before rare ones are let go
_CHUNK = 1 << 16

# A-Z to a-z; every ASCII character that is no letter or digit to a space.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class _Frequent:
    """Counts of what is frequent in one task: entries below the share seen so far are let go when full."""

    def __init__(self) -> None:
        self.counts: Counter = Counter()
        self.total = 0

    def add(self, items: list) -> None:
        counts = self.counts
        counts.update(items)
        self.total += len(items)
        if len(counts) > _HELD:
            # what falls below the share here may be counted short: the head only decides about time
            least = max(2, self.total / (4 * HEAD))
            self.counts = Counter({k: n for k, n in counts.items() if n >= least})
            if len(self.counts) > _HELD // 2:
                top = sorted(self.counts.values())[-_HELD // 2]
                self.counts = Counter({k: n for k, n in self.counts.items() if n > top})

    def rows(self) -> list[tuple]:
        least = self.total / (2 * HEAD)
        return [(k, n) for k, n in self.counts.items() if n >= least]


def head(docs: DataFrame) -> tuple[list[bytes], list[bytes]]:
    """Frequent words and pairs (joined by a space) of the corpus, at most HEAD of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = _Frequent(), _Frequent()
        for batch in small_batches(batches):
            for text in batch.column(1).to_pylist():
                found = words_of(text)
                for at in range(0, len(found), _CHUNK):
                    part = found[at:at + _CHUNK + 1]
                    words.add(part[:_CHUNK])
                    pairs.add(list(zip(part, islice(part, 1, None), strict=False)))
        rows = [(1, w, n) for w, n in words.rows() if len(w) <= HEAD_BYTES]
        rows += [(2, b" ".join(p), n) for p, n in pairs.rows() if len(p[0]) + len(p[1]) <= HEAD_BYTES]
        rows += [(-1, b"", words.total), (-2, b"", pairs.total)]
        yield pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()),
            pa.array([r[2] for r in rows], pa.int64())], names=["size", "item", "n"])
    counts = docs.mapInArrow(run, "size int, item binary, n long").groupBy("size", "item").agg(F.sum("n").alias("n"))
    counts = staged(counts, "head-counts")
    totals = {r.size: r.n for r in counts.filter("size < 0").collect()}  # two rows
    out: list[list[bytes]] = []
    for size in (1, 2):
        # a share of the total each: no more than HEAD rows can pass
        top = counts.filter((F.col("size") == size) & (F.col("n") * HEAD >= totals.get(-size, 0))).select("item").collect()
        out.append(sorted(bytes(r["item"]) for r in top))
    return out[0], out[1]


@dataclass
class Vocabulary:
    """Head words with their CRC state, head pairs with their bucket."""
    states: dict[bytes, int]
    buckets: dict[tuple[bytes, bytes], int]

    @classmethod
    def of(cls, words: list[bytes], pairs: list[bytes]) -> Vocabulary:
        return cls({w: crc32(w) for w in words}, {tuple(p.split(b" ")): crc32(p) % BUCKETS for p in pairs})

    def features(self, words: list[bytes]) -> np.ndarray:
        """Buckets of all words, then of all pairs."""
        n = len(words)
        if not n:
            return np.zeros(0, np.int64)
        known = self.states.get
        state = [s if (s := known(w)) is not None else crc32(w) for w in words]
        pair = self.buckets.get
        following = [b if (b := pair(p)) is not None else crc32(b" " + p[1], s) % BUCKETS
                     for p, s in zip(zip(words, islice(words, 1, None), strict=False), state, strict=False)]
        out = np.empty(2 * n - 1, np.int64)
        out[:n] = np.array(state, np.int64) % BUCKETS
        out[n:] = following
        return out


def bucket_totals(docs: DataFrame, vocabulary: tuple[list[bytes], list[bytes]]) -> np.ndarray:
    """Features of all texts per bucket, exact."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary.of(*shipped.value)
        total = np.zeros(BUCKETS, np.int64)
        for batch in small_batches(batches):
            for text in batch.column(1).to_pylist():
                total += np.bincount(known.features(words_of(text)), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])
    out = np.zeros(BUCKETS, np.int64)
    for r in docs.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n  # BUCKETS rows
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    s_all, t_all = float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + BUCKETS) / ((float(s) + 1) * (t_all + BUCKETS))))
                     for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def weights(docs: DataFrame, vocabulary: tuple[list[bytes], list[bytes]], gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight."""
    shipped = docs.sparkSession.sparkContext.broadcast((vocabulary, gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, gain = shipped.value
        known = Vocabulary.of(*words)
        for batch in small_batches(batches):
            counts, sums = [], []
            for text in batch.column(1).to_pylist():
                found = words_of(text)
                counts.append(len(found))
                sums.append(int(gain[known.features(found)].sum()))
            features = [max(0, 2 * n - 1) for n in counts]
            weight = [s // f if f else 0 for s, f in zip(sums, features, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(features, pa.int64()),
                                              pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])
    return docs.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(scored: DataFrame, share: int, least_words: int) -> DataFrame:
    """Add rank: 1, 2, 3 ... by score (ties to the smaller id) for the drawn, null for all others.

    scored is a table that can be read again. Rows that repeat an id and its score stand side by side.
    """
    taking = scored.filter((F.col("n_words") >= least_words) & F.col("score").isNotNull())
    per_score = taking.groupBy("score").agg(F.count("*").alias("n"))
    # one row per distinct score: a few ten thousand at any number of documents
    above = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    places = per_score.select(F.col("score").alias("at"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("before"),
                              F.floor(F.sum("n").over(Window.partitionBy()) * share / 100).cast("long").alias("drawn"))
    places = places.filter("before < drawn")
    inside = F.row_number().over(Window.partitionBy("score").orderBy("doc_id", "n_features"))
    chosen = (taking.join(places, F.col("score") == F.col("at")).withColumn("rank", (F.col("before") + inside).cast("long"))
              .withColumn("rank", F.when(F.col("rank") <= F.col("drawn"), F.col("rank"))))
    rest = scored.filter((F.col("n_words") < least_words) | F.col("score").isNull()).withColumn("rank", F.lit(None).cast("long"))
    undrawn = taking.join(places, F.col("score") == F.col("at"), "left_anti").withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    return chosen.select(*columns).unionByName(undrawn.select(*columns)).unionByName(rest.select(*columns))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED,
             target_id: str = "item_id") -> DataFrame:
    """doc_id, n_features, weight, score, rank per row of docs: `share` percent of the documents with at
    least `least_words` words are drawn to look like target.

    Null, empty and wordless texts have no features and weight 0. A null doc_id has no score, is never
    drawn and not counted among those to draw from. Rows that repeat an id are rows of their own. With an
    empty target all gains follow the corpus alone; empty docs give no rows. Other columns are not read.
    """
    source = texts(docs)
    vocabulary = head(source)
    corpus = bucket_totals(source, vocabulary)
    gain = gains(corpus, bucket_totals(texts(target, target_id), vocabulary))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weights(source, vocabulary, gain).withColumn("score", F.col("weight") + noise)
    return ranked(staged(scored, "target-scores"), share, least_words)
