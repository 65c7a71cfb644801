"""Masked pseudo-likelihood: every word of a text is predicted from the words on both sides.

Vocabulary: the most frequent words of the whole corpus, and classes of endings for all others.
Network: a table per window position (two words to the left, two to the right) gives vectors that are
added and squashed; a softmax over classes of words and one inside the class give the probability of
the middle word. A document's score is the sum of the log-probabilities of all its words.
Training: documents are dealt into shares of about SHARE_WORDS words by a hash of id and words; each
share runs gradient descent over its windows, from common weights and with a rate of its own for every
weight; the shares' weights are averaged in proportion to their windows, in two steps on the executors,
and sent out for the next round. Shares follow from the rows alone, so scores do not depend on how files
or tasks are cut. A round takes one word in ROUNDS of every text, the next round the words after those,
so that all rounds together train on every window once.
"""
from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnscore.llm.common import small_batches, staged, texts

CLASS = 64                       # words in a class, and classes
VOCABULARY = CLASS * CLASS
ENDINGS = 255                    # classes of endings for words outside the vocabulary
PAD = VOCABULARY - 1
WORDS = VOCABULARY - ENDINGS - 1
REACH = 2
HIDDEN = 32
ROUNDS, BATCH, RATE = 2, 8192, 0.08
SHARE_WORDS = 2_000_000
BLOCKS = 16                      # rows in which a share's weights travel
_POSITIONS = [d for d in range(-REACH, REACH + 1) if d]
_SHAPES = {"near": (len(_POSITIONS), VOCABULARY, HIDDEN), "bias": (HIDDEN,), "classes": (CLASS, HIDDEN),
           "class_bias": (CLASS,), "members": (CLASS, CLASS, HIDDEN), "member_bias": (CLASS, CLASS)}


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all documents; counted inside each task first, in tables of bounded size."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def emptied() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())],
                                             names=["word", "n"])
            held.clear()
            return out
        for batch in small_batches(batches):
            for text in batch.column(1).to_pylist():
                held.update(words_of(text))
            if len(held) > 200_000:
                yield emptied()
        yield emptied()
    return docs.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class _Numbers(dict):
    """word → id; the class of the ending for words outside the vocabulary, of which a bounded number is kept."""

    def __missing__(self, word: bytes) -> int:
        number = WORDS + crc32(word[-3:]) % ENDINGS
        if len(self) < 200_000 and len(word) <= 48:
            self[word] = number
        return number


def token_ids(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, ids (binary, unsigned 16-bit)."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbers((w, k) for k, w in enumerate(shipped.value)).__getitem__
        for batch in small_batches(batches):
            raw = [array("H", list(map(number, words_of(text)))).tobytes() for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary())], names=["doc_id", "ids"])
    return docs.mapInArrow(run, "doc_id long, ids binary")


@dataclass
class Network:
    near: np.ndarray
    bias: np.ndarray
    classes: np.ndarray
    class_bias: np.ndarray
    members: np.ndarray
    member_bias: np.ndarray

    @classmethod
    def from_flat(cls, flat: np.ndarray) -> Network:
        out, at = [], 0
        for shape in _SHAPES.values():
            size = int(np.prod(shape))
            out.append(flat[at:at + size].reshape(shape).copy())
            at += size
        return cls(*out)

    @classmethod
    def empty(cls) -> Network:
        return cls(*(np.zeros(shape, np.float32) for shape in _SHAPES.values()))

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, n).ravel() for n in _SHAPES])

    def hidden(self, around: np.ndarray) -> np.ndarray:
        """around: rows of the ids at each window position."""
        out = np.repeat(self.bias[None, :], len(around), axis=0)
        for k in range(len(_POSITIONS)):
            out += self.near[k].take(around[:, k], axis=0)
        out /= 1 + np.abs(out)
        return out

    def train(self, around: np.ndarray, target: np.ndarray, seen: Network | None = None) -> None:
        """One step over a batch; seen: sums of squared gradients so far, which set each weight's own rate."""
        n, seen = len(target), seen or Network.empty()
        h = self.hidden(around)
        order = np.argsort((target // CLASS).astype(np.uint8), kind="stable")   # by class, once for all that follows
        h, around, target = h.take(order, axis=0), around.take(order, axis=0), target[order]
        group, member = target // CLASS, target % CLASS
        rows = np.arange(n)
        a = _softmax(h @ self.classes.T + self.class_bias)
        a[rows, group] -= 1
        back = a @ self.classes
        _adapt(self.classes, seen.classes, a.T @ h)
        _adapt(self.class_bias, seen.class_bias, a.sum(axis=0))
        begin = np.searchsorted(group, np.arange(CLASS + 1)).tolist()
        b = np.empty((n, CLASS), np.float32)
        present = [c for c in range(CLASS) if begin[c + 1] > begin[c]]
        for c in present:
            part = slice(begin[c], begin[c + 1])
            np.matmul(h[part], self.members[c].T, out=b[part])
        b += self.member_bias.take(group, axis=0)
        b = _softmax(b)
        b[rows, member] -= 1
        grown = np.zeros_like(self.members)
        for c in present:
            part = slice(begin[c], begin[c + 1])
            back[part] += b[part] @ self.members[c]
            np.matmul(b[part].T, h[part], out=grown[c])
        _adapt(self.members, seen.members, grown)
        _adapt_rows(self.member_bias, seen.member_bias, np.array(present), np.add.reduceat(b, [begin[c] for c in present]))
        back *= np.square(1 - np.abs(h))
        _adapt(self.bias, seen.bias, back.sum(axis=0))
        for k in range(len(_POSITIONS)):
            at = around[:, k]
            sort = np.argsort(at.astype(np.uint16), kind="stable")
            ids = at[sort]
            first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            _adapt_rows(self.near[k], seen.near[k], ids[first], np.add.reduceat(back.take(sort, axis=0), first))

    def log_probs(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        order = np.argsort((target // CLASS).astype(np.uint8), kind="stable")
        around, target = around.take(order, axis=0), target[order]
        group, member = target // CLASS, target % CLASS
        rows = np.arange(len(target))
        # products in double precision: equal windows get equal scores wherever they stand in a batch
        h = self.hidden(around).astype(np.float64)
        logits = (h @ self.classes.T.astype(np.float64)).astype(np.float32)
        logits += self.class_bias
        found = logits[rows, group]
        found -= _log_sum(logits)
        begin = np.searchsorted(group, np.arange(CLASS + 1)).tolist()
        members = self.members.astype(np.float64)
        for c in range(CLASS):
            part = slice(begin[c], begin[c + 1])
            if begin[c] < begin[c + 1]:
                logits[part] = h[part] @ members[c].T
        logits += self.member_bias.take(group, axis=0)
        found += logits[rows, member]
        found -= _log_sum(logits)
        out = np.empty(len(target), np.float32)
        out[order] = found
        return out


def _adapt(weights: np.ndarray, seen: np.ndarray, gradient: np.ndarray) -> None:
    seen += gradient * gradient
    weights -= RATE * gradient / np.sqrt(seen + 1e-8)


def _adapt_rows(weights: np.ndarray, seen: np.ndarray, rows: np.ndarray, gradient: np.ndarray) -> None:
    """The same for some rows, each named once."""
    squares = seen[rows] + gradient * gradient
    seen[rows] = squares
    weights[rows] -= RATE * gradient / np.sqrt(squares + 1e-8)


_SAFE = 60.0                     # exp of it, 64 times over, is far inside single precision
_ONES = np.ones((CLASS, 1), np.float32)


def _softmax(logits: np.ndarray) -> np.ndarray:
    """In place. The largest logit comes off only where one could overflow."""
    if len(logits) and max(logits.max(), -logits.min()) > _SAFE:
        logits -= logits.max(axis=1, keepdims=True)
    np.exp(logits, out=logits)
    logits /= logits @ _ONES
    return logits


def _log_sum(logits: np.ndarray) -> np.ndarray:
    """The logits are used up."""
    top = 0.0
    if len(logits) and max(logits.max(), -logits.min()) > _SAFE:
        top = logits.max(axis=1)
        logits -= top[:, None]
    np.exp(logits, out=logits)
    return top + np.log(logits.sum(axis=1))


def initial() -> np.ndarray:
    rng = np.random.default_rng(7)
    return np.concatenate([
        (rng.standard_normal(int(np.prod(s))) * (0.1 if n in ("near", "classes", "members") else 0)).astype(np.float32)
        for n, s in _SHAPES.items()])


def windows(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Padded ids of all texts one after the other, and the places of the words in it."""
    sizes = np.array([len(x) for x in ids])
    begin = np.cumsum(sizes + REACH) - sizes
    flat = np.full(int((sizes + REACH).sum()) + REACH, PAD, np.int64)
    for x, at in zip(ids, begin.tolist(), strict=True):
        flat[at:at + len(x)] = x
    places = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
    return flat, places


def _around(flat: np.ndarray, places: np.ndarray) -> np.ndarray:
    return np.stack([flat[places + d] for d in _POSITIONS], 1)


def round_places(ids: list[np.ndarray], places: np.ndarray, turn: int) -> np.ndarray:
    """Places of the words a round trains on: those whose number in their own text is `turn` modulo ROUNDS."""
    sizes = np.array([len(x) for x in ids], np.int64)
    number = np.arange(len(places)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return places[number % ROUNDS == turn]


def _averaged(dealt: DataFrame, start: np.ndarray, turn: int) -> np.ndarray:
    """One round: training in each share, weights averaged by number of windows. dealt: share, doc_id, ids, by share."""
    shipped = dealt.sparkSession.sparkContext.broadcast(start)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, rates, windows_seen, current = Network.empty(), Network.empty(), 0, None

        def done() -> Iterator[pa.RecordBatch]:
            if windows_seen:
                parts = np.array_split(network.flat().astype(np.float64) * windows_seen, BLOCKS)
                yield pa.RecordBatch.from_arrays([
                    pa.array(range(BLOCKS), pa.int32()), pa.array([current % 8] * BLOCKS, pa.int32()), pa.array([current] * BLOCKS, pa.int64()),
                    pa.array([p.astype(np.float32).tobytes() for p in parts], pa.binary()),
                    pa.array([windows_seen] * BLOCKS, pa.int64())], names=["block", "salt", "share", "weights", "n"])
        for batch in small_batches(batches, "ids", 1_000_000):
            shares = batch.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], shares[1:] != shares[:-1], [True]]))
            for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if shares[low] != current:
                    yield from done()
                    network, rates, windows_seen, current = Network.from_flat(shipped.value), Network.empty(), 0, int(shares[low])
                ids = [np.frombuffer(x, np.uint16) for x in batch.column(2).slice(low, high - low).to_pylist()]
                flat, places = windows(ids)
                if not len(places):
                    continue
                chosen = round_places(ids, places, turn)
                np.random.default_rng(len(places)).shuffle(chosen)
                for at in range(0, len(chosen), BATCH):
                    part = chosen[at:at + BATCH]
                    network.train(_around(flat, part), flat[part], rates)
                windows_seen += len(chosen)
        yield from done()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list] = {}
        for batch in batches:
            for block, salt, _, raw, n in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                entry = sums.setdefault((block, salt), [0.0, 0])
                entry[0] = entry[0] + np.frombuffer(raw, np.float32).astype(np.float64)
                entry[1] += n
        for (block, salt), (total, n) in sums.items():
            yield pa.RecordBatch.from_arrays([
                pa.array([block], pa.int32()), pa.array([salt], pa.int32()), pa.array([salt], pa.int64()),
                pa.array([total.astype(np.float32).tobytes()], pa.binary()), pa.array([n], pa.int64())],
                names=["block", "salt", "share", "weights", "n"])
    schema = "block int, salt int, share long, weights binary, n long"
    # sums are formed in the order of shares, so that they come out the same each time
    rows = (dealt.mapInArrow(train, schema).repartition("block", "salt").sortWithinPartitions("block", "salt", "share")
            .mapInArrow(added, schema).withColumn("salt", F.lit(0)).repartition("block").sortWithinPartitions("block", "share")
            .mapInArrow(added, schema).collect())  # BLOCKS rows
    if not rows:
        return start
    return np.concatenate([np.frombuffer(r.weights, np.float32) / np.float32(r.n)
                           for r in sorted(rows, key=lambda r: r.block)]).astype(np.float32)


def fit(tokens: DataFrame) -> np.ndarray:
    """Weights after ROUNDS rounds over tokens (doc_id, ids)."""
    weights = initial()
    words = tokens.agg(F.sum(F.length("ids") / 2)).first()[0] or 0
    shares = max(1, -(-int(words) // SHARE_WORDS))
    # several partitions a share, so that two shares seldom meet in one task
    dealt = (tokens.select(F.pmod(F.xxhash64("doc_id", "ids"), F.lit(shares)).alias("share"), "doc_id", "ids")
             .repartition(max(shares, min(4 * shares, 4096)), "share").sortWithinPartitions("share", "doc_id", "ids"))
    for turn in range(ROUNDS):
        weights = _averaged(dealt, weights, turn)
    return weights


def vocabulary(docs: DataFrame) -> list[bytes]:
    """The WORDS most frequent words, ties in the order of bytes."""
    counts = staged(word_counts(docs), "word-counts")
    # how many words have a count: the least count that can be among the first WORDS; what is below stays on the executors
    least, left = 0, WORDS
    for r in counts.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(WORDS).collect():
        least, left = r.n, left - r.k
        if left <= 0:
            break
    top = counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").limit(WORDS).collect()  # bounded by the network's size
    return [bytes(r.word) for r in top]


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, log_prob (sum over all words), mean_log_prob per row of docs.

    Null, empty and wordless texts have no words, log_prob 0 and a null mean. Repeated rows count and
    are scored each, a null id stays null, an empty table gives no rows. Other columns are not read.
    """
    source = texts(docs, id_col, text_col)
    tokens = staged(token_ids(source, vocabulary(source)), "masked-tokens")
    shipped = docs.sparkSession.sparkContext.broadcast(fit(tokens))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network.from_flat(shipped.value)
        for batch in small_batches(batches, "ids", 1_000_000):
            ids = [np.frombuffer(x, np.uint16) for x in batch.column(1).to_pylist()]
            sizes = np.array([len(x) for x in ids])
            flat, places = windows(ids)
            logs = np.zeros(len(places) + 1)
            for at in range(0, len(places), BATCH):
                part = places[at:at + BATCH]
                logs[at:at + len(part)] = network.log_probs(_around(flat, part), flat[part])
            total = np.concatenate([[0], np.cumsum(logs[:-1])])
            ends = np.cumsum(sizes)
            sums = total[ends] - total[ends - sizes]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(sizes), pa.array(sums),
                pa.array(sums / np.maximum(sizes, 1), mask=sizes == 0)],
                names=["doc_id", "n_words", "log_prob", "mean_log_prob"])
    return tokens.mapInArrow(run, "doc_id long, n_words long, log_prob double, mean_log_prob double")
