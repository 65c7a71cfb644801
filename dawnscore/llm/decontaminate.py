"""Benchmark decontamination: BM25 index of test items, block-max WAND, question and answer overlap.

The test items are indexed, the training passages are the queries. An item has an entry with all its
words and, if it has an answer, another with those of its question. Weights are divided by what an entry
must at least have in a passage that meets its rule (`_least`), times the threshold, so that one
threshold serves all entries and no such passage is missed.
Per batch of documents:
* words become term numbers; segments of `span` words are cut, passages are two neighbouring segments,
  so every run of `span` words, and every item, lies inside one passage;
* common terms, which together give no entry more than half the threshold, are not essential. For the
  others, the block maxima of their postings are added up per (passage, block of entries); a block whose
  bound (with the common part) stays under the threshold is skipped, as in block-max WAND;
* surviving blocks are scored exactly, all items with an entry at or above the threshold are retrieved;
* a retrieved item is a leak if enough of its question's and its answer's word n-grams stand in the passage;
  of several passages of a document one that is a leak is kept before others.

The items are cut into parts of bounded size, each broadcast for one pass over the documents; corpus
statistics of the index (document frequency, mean length) are those of all items, whatever the parts.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnscore.llm.common import small_batches, staged, texts

K1, B = 1.2, 0.75
GRAM = 5
BLOCK = 4
DENSE_CELLS = 8_000_000          # (segment, block) bounds held at once
SEEN_CELLS = 32_000_000          # (passage, term) marks held at once
PART_CHARS = 16_000_000          # characters of the items in one part of the index
_NOT_WORD = re.compile(r"[\W_]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_NO_CORE = bytes(c for c in range(128) if not chr(c).isalnum() and c not in b" \t\n\r\x0b\x0c")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def word_core(word: str) -> str:
    """Letters and digits in lower case; an empty core is no word."""
    return _NOT_WORD.sub("", word).lower()


def _words(text: str | None) -> list[str]:
    return [w.decode() for w in (text or "").encode().split()]


def cores(text: str | None) -> list[str]:
    return [c for c in map(word_core, _words(text)) if c]


def question_answer(text: str | None) -> tuple[list[str], list[str]]:
    """The last line, or else the last sentence, is the answer; an item of one sentence has none."""
    parts = [p for p in (text or "").strip().split("\n") if cores(p)]
    if len(parts) < 2:
        parts = [p for p in _SENTENCE.split((text or "").strip()) if cores(p)]
    words = [cores(p) for p in parts]
    if len(words) < 2:
        return [w for p in words for w in p], []
    return [w for p in words[:-1] for w in p], words[-1]


@dataclass
class Index:
    """Index of one part of the items; plain arrays, built on the driver, broadcast to the tasks."""
    threshold: float
    overlap: float = 0.5
    question_only: float = 0.8
    terms: dict[str, int] = field(default_factory=dict)
    ids: list[int] = field(default_factory=list)
    question: list[set[tuple[int, ...]]] = field(default_factory=list)
    answer: list[set[tuple[int, ...]]] = field(default_factory=list)
    # per entry: those of whole items come first, in the order of ids, then those of questions
    entry_item: list[int] = field(default_factory=list)
    item_terms: list[np.ndarray] = field(default_factory=list)
    item_weights: list[np.ndarray] = field(default_factory=list)
    block_terms: list[np.ndarray] = field(default_factory=list)   # per block: its entries' one after the other,
    block_weights: list[np.ndarray] = field(default_factory=list)
    block_starts: list[np.ndarray] = field(default_factory=list)  # and where each begins
    span: int = 64
    first: np.ndarray | None = None      # per term: its block postings [first[t], first[t + 1])
    block: np.ndarray | None = None
    block_max: np.ndarray | None = None
    common: np.ndarray | None = None     # per block: what common terms can give at most

    def is_leak(self, question: float, answer: float) -> bool:
        return (question >= self.overlap and answer >= self.overlap) or question >= self.question_only


def _grams(ids: list[int]) -> set[tuple[int, ...]]:
    n = min(GRAM, len(ids))
    return {tuple(ids[k:k + n]) for k in range(len(ids) - n + 1)} if n else set()


def _least(weights: dict[int, float], *parts: tuple[set[tuple[int, ...]], float]) -> float:
    """Weight of the terms of any passage that holds at least the given share of each part's n-grams.

    A term's weight is dealt out to the n-grams that hold it; terms of some n-grams weigh no less than
    the shares of these n-grams add up to.
    """
    holders = Counter(t for grams, _ in parts for g in grams for t in set(g))
    total = 0.0
    for grams, share in parts:
        values = sorted(sum(weights[t] / holders[t] for t in set(g)) for g in grams)
        total += sum(values[:math.ceil(share * len(values) - 1e-9)])
    return total


def build_index(items: list[tuple[int, str]], df: dict[str, int], count: int, mean_len: float,
                threshold: float, overlap: float = 0.5, question_only: float = 0.8) -> Index:
    out = Index(threshold, overlap, question_only)
    questions: list[tuple[int, np.ndarray, np.ndarray]] = []

    def scaled(weights: np.ndarray, least: float) -> np.ndarray:
        return weights * (threshold / (least * (1 - 1e-9)))

    for item_id, text in items:
        question, answer = question_answer(text)
        words = question + answer
        if not words:
            continue
        numbers = [out.terms.setdefault(w, len(out.terms)) for w in words]
        terms, tf = np.unique(np.array(numbers), return_counts=True)
        names = dict(zip(numbers, words, strict=True))
        idf = np.array([math.log(1 + (count - df[names[t]] + 0.5) / (df[names[t]] + 0.5))
                        for t in terms.tolist()])
        weight = idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(words) / mean_len))
        out.ids.append(item_id)
        out.question.append(_grams(numbers[:len(question)]))
        out.answer.append(_grams(numbers[len(question):]))
        weight /= weight.sum()
        of = dict(zip(terms.tolist(), weight.tolist(), strict=True))
        least = _least(of, (out.question[-1], overlap), (out.answer[-1], overlap))
        out.entry_item.append(len(out.ids) - 1)
        out.item_terms.append(terms)
        out.item_weights.append(scaled(weight, least))
        if answer:
            asked = np.isin(terms, numbers[:len(question)])
            own = weight[asked] / weight[asked].sum()
            least = _least(dict(zip(terms[asked].tolist(), own.tolist(), strict=True)),
                           (out.question[-1], question_only))
            questions.append((len(out.ids) - 1, terms[asked], scaled(own, least)))
        out.span = max(out.span, len(words))
    for number, terms, weight in questions:
        out.entry_item.append(number)
        out.item_terms.append(terms)
        out.item_weights.append(weight)
    total = len(out.terms)
    blocks = -(-len(out.entry_item) // BLOCK)
    out.first, out.common = np.zeros(total + 1, np.int64), np.zeros(blocks)
    out.block, out.block_max = np.zeros(0, np.int64), np.zeros(0)
    if not total:
        return out
    size = [len(t) for t in out.item_terms]
    for at in range(0, len(size), BLOCK):
        out.block_terms.append(np.concatenate(out.item_terms[at:at + BLOCK]))
        out.block_weights.append(np.concatenate(out.item_weights[at:at + BLOCK]))
        out.block_starts.append(np.cumsum([0, *size[at:at + BLOCK]])[:-1])
    term = np.concatenate(out.item_terms)
    weight = np.concatenate(out.item_weights)
    item = np.repeat(np.arange(len(size)), size)
    # common terms: most frequent first, while no entry gets more than half the threshold from them
    often = np.array([df[w] for w in out.terms])
    by_term = np.argsort(term, kind="stable")
    begin = np.searchsorted(term[by_term], np.arange(total + 1))
    is_common, given = np.zeros(total, bool), np.zeros(len(size))
    for t in np.argsort(-often, kind="stable").tolist():
        rows = by_term[begin[t]:begin[t + 1]]
        if (given[item[rows]] + weight[rows] > threshold / 2).any():
            break
        given[item[rows]] += weight[rows]
        is_common[t] = True
    np.maximum.at(out.common, np.arange(len(size)) // BLOCK, given)
    keep = ~is_common[term]
    key = term[keep] * blocks + item[keep] // BLOCK
    order = np.argsort(key, kind="stable")
    at, start = np.unique(key[order], return_index=True)
    if len(at):
        out.block_max = np.maximum.reduceat(weight[keep][order], start)
        out.block = at % blocks
        out.first = np.searchsorted(at // blocks, np.arange(total + 1))
    return out


class _TermOf(dict):
    """Core with characters beyond ASCII → term number (-1 outside the index, -2 no word), kept up to a bound."""

    def __init__(self, terms: dict[str, int]):
        super().__init__()
        self.terms = {w.encode(): k for w, k in terms.items()}

    def __missing__(self, word: bytes) -> int:
        core = word_core(word.decode()).encode()
        value = self.terms.get(core, -1) if core else -2
        if len(word) <= 64:
            if len(self) >= 200_000:
                self.clear()
            self[word] = value
        return value

    def ids(self, text: str | None) -> np.ndarray:
        """Term numbers of the words of a text, -1 for those outside the index.

        Lower case and the marks to drop are settled for ASCII over the whole text; other words one by one.
        """
        known = self.terms.get
        found = [k if (k := known(w)) is not None else -1 if w.isascii() else self[w]
                 for w in (text or "").encode().translate(_LOWER, _NO_CORE).split()]
        ids = np.array(found, np.int64)
        return ids[ids != -2]


def _alive(index: Index, segment: np.ndarray, term: np.ndarray, follows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, block) whose bound reaches the threshold, ascending. A passage begins at each segment and
    takes in the next one where that follows in the same text. segment, term: one row per word, by segment."""
    blocks = len(index.common)
    passages, found = [], []
    step = max(1, DENSE_CELLS // blocks)
    for low in range(0, len(follows), step):
        high = min(low + step, len(follows))
        a, b = np.searchsorted(segment, [low, high + 1])    # with the segment after the last passage
        t = term[a:b]
        many = index.first[t + 1] - index.first[t]
        at = np.arange(int(many.sum())) + np.repeat(index.first[t] - (np.cumsum(many) - many), many)
        cell = np.repeat((segment[a:b] - low) * blocks, many) + index.block[at]
        own = np.bincount(cell, index.block_max[at], (high - low + 1) * blocks).reshape(-1, blocks)
        bound = own[:-1] + np.where(follows[low:high, None], own[1:], 0.0)
        p, k = np.nonzero((bound > 0) & (bound + index.common >= index.threshold - 1e-9))
        passages.append(p + low)
        found.append(k)
    return np.concatenate(passages or [np.zeros(0, np.int64)]), np.concatenate(found or [np.zeros(0, np.int64)])


def _retrieved(index: Index, words: list[np.ndarray], passage: np.ndarray, block: np.ndarray) -> list[tuple[int, int]]:
    """(row of words, item): items with an entry whose exact score in those words reaches the threshold.

    words: the terms of each passage; passage, block: what is left to score, as rows of words and blocks.
    """
    out: set[tuple[int, int]] = set()
    step = max(1, SEEN_CELLS // (len(index.terms) + 1))
    for low in range(0, len(words), step):
        seen = np.zeros((min(step, len(words) - low), len(index.terms) + 1), bool)
        for k in range(len(seen)):
            seen[k, words[low + k]] = True       # -1 marks the last place, which no item uses
        a, b = np.searchsorted(passage, [low, low + len(seen)])
        order = a + np.argsort(block[a:b], kind="stable")
        its, begin = np.unique(block[order], return_index=True)
        for one, x, y in zip(its.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)], strict=True):
            for part in range(x, y, 2_000):
                rows = passage[order[part:min(part + 2_000, y)]]
                held = seen[np.ix_(rows - low, index.block_terms[one])]
                scores = np.add.reduceat(np.where(held, index.block_weights[one], 0.0), index.block_starts[one], axis=1)
                for r, e in zip(*np.nonzero(scores >= index.threshold - 1e-9), strict=True):
                    out.add((int(rows[r]), index.entry_item[one * BLOCK + int(e)]))
    return sorted(out)


def search(index: Index, lookup: _TermOf, batch: list[str | None]) -> list[tuple[int, int, float, float, float]]:
    """(text number, item number, score, question overlap, answer overlap) of every item retrieved in the batch.

    The score is the part of the item's weight in the passage that is kept, in terms of 0..1."""
    found = [lookup.ids(text) for text in batch]
    span = index.span
    sizes = np.array([-(-len(x) // span) for x in found])
    first_segment = np.concatenate([[0], np.cumsum(sizes)])
    segment = np.concatenate([first_segment[k] + np.arange(len(x)) // span for k, x in enumerate(found)]
                             or [np.zeros(0, np.int64)])
    term = np.concatenate(found or [np.zeros(0, np.int64)])
    segment, term = segment[term >= 0], term[term >= 0]
    if not len(term):
        return []
    owner = np.repeat(np.arange(len(found)), sizes)
    follows = np.append(owner[1:] == owner[:-1], False)
    alive, block = _alive(index, segment, term, follows)
    numbers, row = np.unique(alive, return_inverse=True)
    passages = []
    for n in numbers.tolist():
        at = (n - int(first_segment[owner[n]])) * span
        passages.append(found[owner[n]][at:at + 2 * span])

    best: dict[tuple[int, int], tuple[tuple[bool, float], tuple[float, float, float]]] = {}
    grams: dict[tuple[int, int], set[tuple[int, ...]]] = {}
    for r, i in _retrieved(index, passages, row, block):
        listed, k = passages[r], int(owner[numbers[r]])

        def overlap(wanted: set[tuple[int, ...]]) -> float:
            n = len(next(iter(wanted)))
            if (r, n) not in grams:  # noqa: B023
                ids = listed.tolist()  # noqa: B023
                grams[r, n] = {tuple(ids[j:j + n]) for j in range(len(ids) - n + 1)}  # noqa: B023
            return len(wanted & grams[r, n]) / len(wanted)  # noqa: B023
        q = overlap(index.question[i])
        a = overlap(index.answer[i]) if index.answer[i] else q
        rank = (index.is_leak(q, a), q + a)
        if (k, i) not in best or rank > best[k, i][0]:
            weights = index.item_weights[i]
            best[k, i] = (rank, (float(weights[np.isin(index.item_terms[i], listed)].sum() / weights.sum()), q, a))
    return [(k, i, *x) for (k, i), (_, x) in best.items()]


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", *,
          item_id: str = "item_id", item_text: str = "text", threshold: float = 0.5,
          overlap: float = 0.5, question_only: float = 0.8, part_items: int = 20_000,
          part_chars: int = PART_CHARS) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap: one row per document and leaked item.

    A leak is an item with both overlaps at `overlap` or more in one passage, or with nearly the whole
    question (`question_only`); every such item is retrieved. `threshold` is the scale of
    the weights in the index and changes no result. Null and wordless texts leak nothing, items without words match
    nothing, repeated rows give equal rows, a null id stays null, empty tables give no rows. Items
    shorter than five words count as one n-gram. Other columns are not read.
    """
    source = texts(docs, id_col, text_col)
    test = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text"))

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(1).to_pylist():
                found = cores(text)
                new = set()
                yield pa.RecordBatch.from_pydict({
                    "word": found, "first": [not (w in new or new.add(w)) for w in found]},
                    schema=pa.schema([("word", pa.string()), ("first", pa.bool_())]))
    terms = test.mapInArrow(words, "word string, first boolean")
    usable = test.mapInArrow(lambda batches: (
        pa.RecordBatch.from_pydict({"n": [len(cores(t)) for t in b.column(1).to_pylist()],
                                    "chars": [len(t or "") for t in b.column(1).to_pylist()]},
                                   schema=pa.schema([("n", pa.int64()), ("chars", pa.int64())])) for b in batches), "n long, chars long")
    count, total, chars = usable.filter("n > 0").agg(F.count("*"), F.sum("n"), F.sum("chars")).first()
    parts = max(1, -(-count // part_items), -(-(chars or 0) // part_chars))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"

    def one_part(k: int) -> DataFrame:
        part = test.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k) if parts > 1 else test
        own = part.mapInArrow(words, "word string, first boolean").select("word").distinct()
        df = terms.filter("first").groupBy("word").agg(F.count("*").alias("df")).join(own, "word", "left_semi")
        index = build_index([(r.item_id, r.text) for r in part.collect()],
                            {r.word: r.df for r in df.collect()}, count, (total or 1) / max(count, 1), threshold,
                            overlap, question_only)
        shipped = source.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            here = shipped.value
            lookup = _TermOf(here.terms)
            for batch in small_batches(batches):
                ids = batch.column(0).to_pylist()
                rows = search(here, lookup, batch.column(1).to_pylist()) if here.ids else []
                yield pa.RecordBatch.from_arrays([
                    pa.array([ids[r[0]] for r in rows], pa.int64()),
                    pa.array([here.ids[r[1]] for r in rows], pa.int64()),
                    *(pa.array([r[c] for r in rows], pa.float64()) for c in (2, 3, 4))],
                    names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
        return source.mapInArrow(run, schema) if parts == 1 else staged(source.mapInArrow(run, schema), "part-hits")

    # with several parts each pass is written before the next part is built: the driver holds one at a time
    hits = reduce(DataFrame.union, [one_part(k) for k in range(parts)])
    q, a = F.col("question_overlap"), F.col("answer_overlap")
    return hits.filter(((q >= overlap) & (a >= overlap)) | (q >= question_only))
