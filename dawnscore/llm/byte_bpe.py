"""Byte-level BPE encoding and decoding over Arrow batches, with offsets in code points."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from dawnscore.llm.common import small_batches, texts
from dawnscore.llm.pieces import rank_encoder, rank_tables

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def token_offsets(text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past the last code point that each token touches; lengths are in bytes.

    Tokens that share a character, because a merge ends inside it, have overlapping offsets."""
    raw = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return char[ends - lengths], char[ends - 1] + 1


def decode_bytes(ids: list[int], table: dict[int, bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str = RANKS) -> DataFrame:
    """doc_id, ids, starts, ends (arrays) per row; null and empty texts have empty arrays.

    Repeated rows give equal rows, a null id stays null, an empty table gives none, other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = rank_encoder(path), rank_tables(path).token_bytes
        for batch in small_batches(batches):
            ids, starts, ends = [], [], []
            for text in batch.column(1).to_pylist():
                found = np.frombuffer(encoder.encode(text), "<u4").astype(np.int32)
                sizes = np.fromiter((len(table[i]) for i in found.tolist()), np.int64, len(found))
                first, last = token_offsets(text or "", sizes)
                ids.append(found)
                starts.append(first)
                ends.append(last)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(starts, pa.list_(pa.int64())),
                pa.array(ends, pa.list_(pa.int64()))], names=["doc_id", "ids", "starts", "ends"])
    return texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, ids array<int>, starts array<long>, ends array<long>")


def decode(encoded: DataFrame, *, path: str = RANKS) -> DataFrame:
    """doc_id, raw (binary), text from doc_id, ids. A character cut at either end of the ids decodes to
    U+FFFD in text; raw keeps its bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rank_tables(path).token_bytes
        for batch in batches:
            raw = [decode_bytes(ids or [], table) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(raw, pa.binary()),
                pa.array([r.decode(errors="replace") for r in raw], pa.string())], names=["doc_id", "raw", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, raw binary, text string")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, path: str = RANKS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass, digests only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, table = rank_encoder(path), rank_tables(path).token_bytes
        for batch in small_batches(batches):
            counts, id_digests, text_digests = [], [], []
            for text in batch.column(1).to_pylist():
                raw = encoder.encode(text)
                ids = np.frombuffer(raw, "<u4")
                counts.append(len(ids))
                id_digests.append(hashlib.sha256(raw).hexdigest())
                text_digests.append(hashlib.sha256(decode_bytes(ids.tolist(), table)).hexdigest())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(text_digests)],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return texts(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
