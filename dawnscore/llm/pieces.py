"""Byte-level BPE of whole texts with the tokenizers library, one call per distinct piece.

A text is cut before every space (no piece reaches over a single space that is followed by something
else), the chunks are cut into pieces by the public pattern, and pieces are encoded once and kept.
Texts with other spacing, and chunks beyond Latin-1, go through the library's own splitter.
"""
from __future__ import annotations

import base64
import heapq
import re
import sys
from array import array
from collections.abc import Callable
from functools import lru_cache

import public_tokenizers
from tokenizers import Regex, Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import Split

KEPT = 600_000   # pieces kept a worker, about 120 MB
LONGEST = 48     # characters of a piece that is kept; so the bound above holds for scripts without spaces
# The public pattern for characters up to U+00FF, with the classes spelled out: letters, numbers, spaces.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
_LATIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\x00-\xff]")
_REPEAT = re.compile(rb"((.).*?)\1\2", re.S)


def byte_chars() -> list[str]:
    """Character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


BYTE_CHARS = byte_chars()
CHAR_BYTES = {c: b for b, c in enumerate(BYTE_CHARS)}


def _mapped(raw: bytes) -> str:
    return raw.decode("latin-1").translate(BYTE_CHARS)


def _mapped_text(piece: str) -> str:
    """_mapped of the piece's bytes; printable ASCII stands for itself but for the space."""
    if piece.isascii() and piece.isprintable():
        return piece.replace(" ", BYTE_CHARS[32])
    return _mapped(piece.encode())


def _packed(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


@lru_cache(1)
def _splitter() -> Split:
    return Split(Regex(public_tokenizers.PATTERN), "isolated")


def split_pieces(text: str) -> list[str]:
    if _BEYOND.search(text):
        return [piece for piece, _ in _splitter().pre_tokenize_str(text)]
    return _LATIN.findall(text)


class _LooseSpace(Exception):
    """A space followed by more white space or by nothing: pieces may reach over it."""


class Encoder:
    """ids of a text as bytes (little-endian unsigned 32-bit)."""

    def __init__(self, piece_ids: Callable[[str], list[int]], library: Tokenizer | None = None):
        outer = self
        self.piece_ids = piece_ids
        self.library = library
        added = library.get_added_tokens_decoder().values() if library else ()
        self.added = re.compile("|".join(re.escape(t.content) for t in added)) if added else None

        class Bare(dict):
            def __missing__(self, piece: str) -> bytes:
                if len(self) >= KEPT:
                    self.clear()
                value = _packed(piece_ids(piece))
                if len(piece) <= LONGEST:
                    self[piece] = value
                return value

        class Spaced(dict):
            """Keys lack the space in front that their value counts."""

            def __missing__(self, chunk: str) -> bytes:
                if len(self) >= KEPT:
                    self.clear()
                if not chunk or chunk[0].isspace():
                    raise _LooseSpace
                if chunk.isascii():
                    if chunk.isalpha():  # one piece
                        value = _packed(piece_ids(" " + chunk))
                        if len(chunk) <= LONGEST:
                            self[chunk] = value
                        return value
                    if chunk[-1] in ",." and chunk[:-1].isalpha():  # two pieces, both kept by themselves
                        return self[chunk[:-1]] + outer.bare[chunk[-1]]
                first, *rest = split_pieces(" " + chunk)
                if rest:
                    value = self[first[1:]] + b"".join(map(outer.bare.__getitem__, rest))
                else:
                    value = _packed(piece_ids(first))
                if len(chunk) <= LONGEST:
                    self[chunk] = value
                return value

        self.bare, self.spaced = Bare(), Spaced()

    def encode_added(self, text: str | None) -> bytes:
        """As encode, but the file's added tokens in the text get their own ids, as the library gives them."""
        if text and self.added and self.added.search(text):
            return _packed(self.library.encode(text, add_special_tokens=False).ids)
        return self.encode(text)

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        first, *rest = text.split(" ")
        try:
            ids = b"".join(map(self.spaced.__getitem__, rest))
        except _LooseSpace:
            return b"".join(map(self.bare.__getitem__, split_pieces(text)))
        return b"".join(map(self.bare.__getitem__, split_pieces(first))) + ids if first else ids


@lru_cache(2)
def file_encoder(path: str) -> Encoder:
    """Encoder for a tokenizers file with byte-level pieces."""
    library = Tokenizer.from_file(path)
    tokenize = library.model.tokenize
    return Encoder(lambda piece: [t.id for t in tokenize(_mapped_text(piece))], library)


class RankTables:
    """The tokenizers library set up from a rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        by_rank = sorted(self.ranks.items(), key=lambda x: x[1])
        merges = [(_mapped(token[:cut]), _mapped(token[cut:])) for token, _ in by_rank if len(token) > 1
                  for cut in range(1, len(token)) if token[:cut] in self.ranks and token[cut:] in self.ranks]
        vocab = {_mapped(token): rank for token, rank in by_rank}
        self.tokenize = Tokenizer(BPE(vocab=vocab, merges=merges, ignore_merges=True)).model.tokenize
        # decoding: the byte table reversed
        self.token_bytes = {rank: bytes(CHAR_BYTES[c] for c in token) for token, rank in vocab.items()}

    def piece_ids(self, piece: str) -> list[int]:
        raw = piece.encode()
        # The library ranks the ways to build one token, the rank file does not. The order can only
        # matter where a token overlaps itself, that is in a piece with a repetition like "ababa".
        if len(raw) > 64 or _REPEAT.search(raw):
            return self.merged(raw)
        return [t.id for t in self.tokenize(_mapped_text(piece))]

    def merged(self, raw: bytes) -> list[int]:
        """Lowest rank first, leftmost of equals, with a heap over neighbours."""
        ranks = self.ranks
        if raw in ranks:
            return [ranks[raw]]
        n = len(raw)
        end = list(range(1, n + 1))          # of the part that begins here; 0 where none does
        before = list(range(-1, n - 1))

        def entry(at: int) -> None:
            stop = end[at]
            if stop < n and (rank := ranks.get(raw[at:end[stop]])) is not None:
                heapq.heappush(heap, (rank, at, end[stop]))

        heap: list[tuple[int, int, int]] = []
        for at in range(n):
            entry(at)
        while heap:
            _, at, stop = heapq.heappop(heap)
            middle = end[at]
            if not middle or middle >= n or end[middle] != stop or middle == stop:
                continue
            end[at], end[middle] = stop, 0
            if stop < n:
                before[stop] = at
            entry(at)
            if before[at] >= 0:
                entry(before[at])
        out, at = [], 0
        while at < n:
            out.append(ranks[raw[at:end[at]]])
            at = end[at]
        return out


@lru_cache(2)
def rank_tables(path: str) -> RankTables:
    return RankTables(path)


@lru_cache(2)
def rank_encoder(path: str) -> Encoder:
    return Encoder(rank_tables(path).piece_ids)
