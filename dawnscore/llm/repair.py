"""Token ids as Re-Pair grammars: one binary shard per run of documents, decodable at random.

A shard numbers the ids that occur in it (its letters) and replaces frequent pairs of neighbouring
symbols by nonterminals, round after round, until no pair occurs LEAST times. A round takes the most
frequent pairs of its counts at once and replaces them from left to right without overlap; no pair
reaches over a document. Symbols take 16 bits, and 32 in shards that need more of them.

Layout of a shard, little-endian:
  4s "RPG3", u32 letters, u32 documents, u32 rules, u32 symbols, u32 bytes per symbol (2 or 4)
  letters:   the id of each, u32
  rules:     2 symbols each; letters come first, a rule names only earlier symbols
  lengths:   u32 per rule, ids in its full expansion
  documents: u32 ids, then u32 symbols of each document
  sequence:  the symbols
Shards are values of a binary column in Parquet written by Spark to the shared folder, so lost tasks
are written again and any file system that Spark reads will do.
"""
from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dawnscore.llm.common import small_batches, staged, texts
from dawnscore.llm.pieces import file_encoder

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2
VOCABULARY = 50_257      # ids are below it
SHARD_IDS = 1_500_000    # a shard is closed at this many ids; a longer document has one of its own
PAIRS_A_ROUND, LEAST = 3_800, 24
_HEAD = struct.Struct("<4s5I")
_SLOTS = 18


def _alternate(at: np.ndarray) -> np.ndarray:
    """Of positions that follow each other directly, every second one from the left."""
    if not len(at):
        return at
    fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
    begin = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
    return at[(np.arange(len(at)) - begin) % 2 == 0]


def compress(ids: np.ndarray, sizes: np.ndarray, vocabulary: int = VOCABULARY, *,
             pairs: int = PAIRS_A_ROUND, least: int = LEAST) -> bytes:
    """A shard of the documents whose ids (sizes of them each) are given one after the other."""
    used = np.zeros(vocabulary, bool)
    used[ids] = True
    letters = np.flatnonzero(used)
    key_type = np.uint32                               # two symbols of 16 bits, or of 32
    sequence = (np.cumsum(used) - 1).astype(key_type)[ids]
    last = np.zeros(len(sequence), bool)
    last[np.cumsum(sizes)[sizes > 0] - 1] = True
    doc_symbols = sizes.astype(np.int64)
    rules: list[np.ndarray] = []
    count = 0
    while len(sequence) > 1:
        if key_type is np.uint32 and len(letters) + count + pairs > 1 << 16:
            key_type = np.uint64
            sequence = sequence.astype(key_type)
        bits = 4 * key_type().nbytes
        half, shift = key_type(bits), key_type(2 * bits - _SLOTS)
        mix = key_type(0x9E3779B1 if bits == 16 else 0x9E3779B97F4A7C15)
        key = (sequence[:-1] << half) | sequence[1:]
        slot = (key * mix) >> shift
        inside = ~last[:-1]
        # exact counts for the pairs in slots that can be frequent enough
        weight = np.bincount(slot[inside], minlength=1 << _SLOTS)
        maybe = np.flatnonzero((weight >= least)[slot] & inside)
        if not len(maybe):
            break
        held = key[maybe]
        ordered = np.sort(held)
        begin = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        found, often = ordered[begin], np.diff(np.append(begin, len(ordered)))
        best = np.argsort(-often, kind="stable")[:pairs]
        best = best[often[best] >= least]
        chosen = np.sort(found[best])
        if not len(chosen):
            break
        table = np.full(1 << _SLOTS, -1, np.int32)
        table[(chosen * mix) >> shift] = np.arange(len(chosen))   # of pairs that share a slot one waits
        taken = table[slot[maybe]]
        at = _alternate(maybe[(chosen[taken] == held) & (taken >= 0)])
        number = table[slot[at]]
        used = np.flatnonzero(np.bincount(number, minlength=len(chosen)))
        renumbered = np.zeros(len(chosen), key_type)
        renumbered[used] = np.arange(len(used)) + (len(letters) + count)
        rules.append(np.stack([chosen[used] >> half, chosen[used] & key_type((1 << bits) - 1)], 1).astype("<u4"))
        sequence[at] = renumbered[number]
        count += len(used)
        keep = np.ones(len(sequence), bool)
        keep[at + 1] = False
        last[at] = last[at + 1]
        sequence, last = sequence[keep], last[keep]
    ends = np.flatnonzero(last) + 1
    doc_symbols[sizes > 0] = np.diff(np.concatenate([[0], ends]))
    table = np.concatenate(rules) if rules else np.zeros((0, 2), "<u4")
    lengths = np.ones(len(letters) + count, np.int64)
    done = len(letters)
    for part in rules:  # a round's rules name symbols of earlier rounds only
        lengths[done:done + len(part)] = lengths[part.astype(np.int64)].sum(axis=1)
        done += len(part)
    width = 2 if done <= 1 << 16 else 4
    return b"".join([
        _HEAD.pack(b"RPG3", len(letters), len(sizes), count, len(sequence), width), letters.astype("<u4").tobytes(),
        table.astype(f"<u{width}").tobytes(), lengths[len(letters):].astype("<u4").tobytes(), sizes.astype("<u4").tobytes(),
        doc_symbols.astype("<u4").tobytes(), sequence.astype(f"<u{width}").tobytes()])


class Shard:
    """Reads a shard; a document is expanded without the others."""

    def __init__(self, raw: bytes):
        mark, self.first, docs, rules, symbols, width = _HEAD.unpack_from(raw)
        if mark != b"RPG3":
            raise ValueError("not a shard")
        at = _HEAD.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, n, at)
            at += out.nbytes
            return out
        self.letters = take("<u4", self.first)
        self.rules = take(f"<u{width}", 2 * rules).reshape(-1, 2).astype(np.int64)
        self.lengths = take("<u4", rules).astype(np.int64)
        self.sizes = take("<u4", docs).astype(np.int64)
        self.doc_symbols = take("<u4", docs).astype(np.int64)
        self.sequence = take(f"<u{width}", symbols)
        self.begin = np.concatenate([[0], np.cumsum(self.doc_symbols)])
        self._written: tuple[np.ndarray, np.ndarray] | None = None

    def _expansions(self) -> tuple[np.ndarray, np.ndarray]:
        """All rules written out one after the other, and where each begins; rules name earlier symbols."""
        if self._written is None:
            begin = np.cumsum(self.lengths) - self.lengths
            flat = np.repeat(np.arange(len(self.rules)) + self.first, self.lengths)
            place = np.arange(int(self.lengths.sum())) - np.repeat(begin, self.lengths)
            while len(where := np.flatnonzero(flat >= self.first)):
                # the symbol's left part comes first, and takes as many places as its own length
                left, right = self.rules[flat[where] - self.first].T
                wide = np.ones(len(where), np.int64)
                deep = left >= self.first
                wide[deep] = self.lengths[left[deep] - self.first]
                first = place[where] < wide
                flat[where] = np.where(first, left, right)
                place[where] = np.where(first, place[where], place[where] - wide)
            self._written = self.letters[flat], begin
        return self._written

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, begin = self._expansions()
        symbols = symbols.astype(np.int64)
        big = np.flatnonzero(symbols >= self.first)
        if not len(big):
            return self.letters[symbols]
        rule = symbols[big] - self.first
        symbols[big] = 0
        wide = np.ones(len(symbols), np.int32)
        wide[big] = self.lengths[rule]
        ends = np.cumsum(wide, dtype=np.int64)
        out = np.repeat(self.letters[symbols], wide)
        many = self.lengths[rule]
        offset = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        out[np.repeat(ends[big] - many, many) + offset] = flat[np.repeat(begin[rule], many) + offset]
        return out

    def document(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """ids [start, stop) of document k; lengths tell which symbols cover them, only those expand."""
        symbols = self.sequence[self.begin[k]:self.begin[k + 1]]
        if start == 0 and stop is None:
            return self._expand(symbols)
        stop = int(self.sizes[k]) if stop is None else stop
        wide = np.ones(len(symbols), np.int64)
        big = symbols >= self.first
        wide[big] = self.lengths[symbols[big].astype(np.int64) - self.first]
        ends = np.cumsum(wide)
        first, last = int(np.searchsorted(ends, start, side="right")), int(np.searchsorted(ends, stop))
        if start >= stop or first >= len(symbols):
            return np.zeros(0, "<u4")
        skip = start - int(ends[first] - wide[first])
        return self._expand(symbols[first:last + 1])[skip:skip + stop - start]

    def all(self) -> np.ndarray:
        return self._expand(self.sequence)


def write_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str = TOKENIZER,
                 end_id: int = END_ID, partition_rows: int = 4_000) -> DataFrame:
    """Encode and write: part, shard, n_ids, doc_ids (array), payload, in ascending doc_id order.

    part is the range of ids, shard the number inside it. Rows are dealt by ranges of (id, hash of the
    text), so repeated ids may be cut over ranges. Null ids come first. A null text is an empty one.
    """
    source = texts(docs, id_col, text_col)
    ranges = max(1, -(-source.count() // partition_rows))
    placed = (source.withColumn("key", F.xxhash64("text"))
              .repartitionByRange(ranges, "doc_id", "key").sortWithinPartitions("doc_id", "key")
              .select(F.spark_partition_id().alias("part"), "doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = file_encoder(path), np.array([end_id], "<u4").tobytes()
        raws: list[bytes] = []
        doc_ids: list[int | None] = []
        held, shard, part = 0, 0, 0

        def closed() -> pa.RecordBatch:
            sizes = np.array([len(r) // 4 for r in raws])
            payload = compress(np.frombuffer(b"".join(raws), "<u4"), sizes)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([int(sizes.sum())], pa.int64()),
                pa.array([doc_ids], pa.list_(pa.int64())), pa.array([payload], pa.binary())],
                names=["part", "shard", "n_ids", "doc_ids", "payload"])
        for batch in small_batches(batches):
            part = batch.column(0)[0].as_py()
            for doc_id, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = encoder.encode_added(text) + end
                if raws and held + len(raw) // 4 > SHARD_IDS:
                    yield closed()
                    raws, doc_ids, held, shard = [], [], 0, shard + 1
                raws.append(raw)
                doc_ids.append(doc_id)
                held += len(raw) // 4
        if raws:
            yield closed()
    return staged(placed.mapInArrow(run, "part int, shard int, n_ids long, doc_ids array<long>, payload binary"),
                  "repair-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    # Running totals in two steps: over the ranges, then inside a range.
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("total"))
    before = parts.select("part", F.expr(
        "coalesce(sum(total) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("base"))
    inside = shards.select("part", "shard", F.expr(
        "coalesce(sum(n_ids) over (partition by part order by shard rows between unbounded preceding and 1 preceding), 0)")
        .alias("within"))
    starts = inside.join(before, "part").select("part", "shard", (F.col("base") + F.col("within")).alias("start"))
    placed = shards.join(starts, ["part", "shard"]).select("start", "doc_ids", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, doc_ids, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                           batch.column(2), strict=True):
                shard = Shard(raw.as_py())
                ids = shard.all()
                ends = np.cumsum(shard.sizes)
                first = ends - shard.sizes
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(doc_ids, pa.int64()), pa.array(start + first), pa.array(shard.sizes),
                    pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
