"""Byte-level BPE encoding and decoding in linear time.

Bytes are mapped to Latin-1 characters, so that one Aho-Corasick automaton over all tokens
finds every token that ends at every byte. A piece is encoded from left to right with the
longest token at each position, under one condition: neighbours must be *compatible*, that
is, merging their joint bytes by the ranks gives just these two tokens. If the longest token
is not, the next shorter one that is a prefix is tried, and if none is left the previous
token is given up; a byte position that failed is not entered again. A sequence of pairwise
compatible tokens is the sequence that the merges make. Compatibility is found once per
pair of tokens and remembered.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.batches import IdCache, slices, text_bytes

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO = 1 << 19  # remembered pairs
PIECES = 50_000  # remembered pieces


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def merged(ranks: dict[bytes, int], piece: bytes, below: int = 1 << 62) -> list[bytes]:
    """Tokens by definition: merge the adjacent pair of lowest rank until none is left.

    With ``below``, only merges of a lower rank are made.
    """
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class ByteBpe:
    """Encoder of one vocabulary of ranks and one pattern of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import ahocorasick
        import regex

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.automaton = ahocorasick.Automaton()
        #: The two tokens whose merge makes a token; none for single bytes.
        self.halves: dict[bytes, tuple[bytes, bytes] | None] = {}
        for token, rank in sorted(ranks.items(), key=lambda item: item[1]):
            parts = merged(ranks, token, rank) if len(token) > 1 else [token]
            if len(parts) <= 2:
                self.halves[token] = tuple(parts) if len(parts) == 2 else None
                self.automaton.add_word(token.decode("latin-1"), token)
        self.automaton.make_automaton()
        #: Whether every token is made by merges of lower rank, as in any trained vocabulary,
        #: and every byte is a token. Compatibility of neighbours decides only then; any
        #: other table of ranks is merged by definition.
        self.regular = len(self.halves) == len(ranks) and all(bytes([b]) in ranks for b in range(256))
        self.compatible: dict[tuple[bytes, bytes], bool] = {}
        self.short: dict[bytes, list[bytes]] = {}
        self.pieces: dict[str, list[int]] = {}

    def _fits(self, left: bytes, right: bytes) -> bool:
        """Whether no merge across the border happens while both tokens are being made.

        Going back in time, the token made last is taken apart and its half at the border
        looked at. That half lived until the merge of that rank; a pair across the border
        with a lower rank would have been merged before. Of equal ranks the left one goes
        first.
        """
        ranks, halves = self.ranks, self.halves
        until_left = until_right = 1 << 62
        while True:
            rank = ranks.get(left + right)
            if rank is not None and rank < until_left and rank <= until_right:
                return False
            made_left = ranks[left] if halves[left] else -1
            made_right = ranks[right] if halves[right] else -1
            if made_left < 0 and made_right < 0:
                return True
            if made_left >= made_right:
                until_left, left = made_left, halves[left][1]
            else:
                until_right, right = made_right, halves[right][0]

    def _prefixes(self, token: bytes) -> list[bytes]:
        """The token and all tokens that are prefixes of it, longest first."""
        found = self.short.get(token)
        if found is None:
            found = self.short[token] = [token[:n] for n in range(len(token), 0, -1) if token[:n] in self.halves]
        return found

    def piece(self, piece: bytes) -> list[int]:
        ranks, compatible, fits = self.ranks, self.compatible, self._fits
        if piece in ranks:
            return [ranks[piece]]
        if not self.regular:
            return [ranks[token] for token in merged(ranks, piece)]
        if len(compatible) >= MEMO:
            compatible.clear()
        size, longest = len(piece), [b""] * len(piece)
        for end, token in self.automaton.iter(piece.decode("latin-1")):
            start = end + 1 - len(token)
            if len(token) > len(longest[start]):
                longest[start] = token
        done: list[bytes] = []
        choices = [iter(self._prefixes(longest[0]))]
        failed = bytearray(size + 1)
        at = 0
        while at < size:
            for token in choices[-1]:
                if failed[at + len(token)]:
                    continue
                if done:
                    pair = (done[-1], token)
                    good = compatible.get(pair)
                    if good is None:
                        good = compatible[pair] = fits(*pair)
                    if not good:
                        continue
                done.append(token)
                at += len(token)
                if at < size:
                    choices.append(iter(self._prefixes(longest[at])))
                break
            else:
                failed[at] = 1
                choices.pop()
                at -= len(done.pop())
        return [ranks[token] for token in done]

    def segment(self, segment: bytes) -> list[int]:
        known, out = self.pieces, []
        if len(known) >= PIECES:
            known.clear()
        for piece in self.pattern.findall(segment.decode("utf-8", "replace")):
            ids = known.get(piece)
            if ids is None:
                ids = self.piece(piece.encode())
                if len(piece) <= 64:
                    known[piece] = ids
            out += ids
        return out


_TOOLS: dict[tuple[str, str], tuple[ByteBpe, IdCache]] = {}  # one per Python worker


def tool(path: str, pattern: str = PATTERN) -> tuple[ByteBpe, IdCache]:
    if (path, pattern) not in _TOOLS:
        bpe = ByteBpe(load_ranks(path), pattern)
        _TOOLS[path, pattern] = bpe, IdCache(bpe.segment)
    return _TOOLS[path, pattern]


def encode_texts(df: DataFrame, ranks_path: str, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, ids`` with the little-endian unsigned 32-bit ids of every whole text.

    Equal to merging each match of ``pattern`` by rank; special tokens are ordinary text. A
    null text is empty and has no ids; other columns are not looked at.
    """
    source = df.select("doc_id", F.col("text").alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = tool(ranks_path, pattern)[1]
        for batch in slices(batches, "_text"):
            flat, bounds = cache.texts(*text_bytes(batch.column("_text")))
            raw = flat.tobytes()
            ids = pa.array([raw[4 * a : 4 * b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids], ["doc_id", "ids"])

    return source.mapInArrow(run, f"doc_id {kind}, ids binary")


def decode_ids(df: DataFrame, ranks_path: str) -> DataFrame:
    """``doc_id, bytes`` of every row of ``df(doc_id, ids)``; null ids give no bytes."""
    kind = df.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _decoder(ranks_path)
        for batch in batches:
            out = pa.array([decode(x.as_buffer()) if x.is_valid else b"" for x in batch.column("ids")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], ["doc_id", "bytes"])

    return df.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, bytes binary")


_BYTES: dict[str, tuple] = {}


def _decoder(ranks_path: str):
    """Vectorized lookup of the bytes of ids."""
    import numpy as np

    from attestor.llm.batches import ragged

    if ranks_path not in _BYTES:
        token = {rank: token for token, rank in load_ranks(ranks_path).items()}
        size = np.zeros(max(token) + 1, np.int64)
        for rank, value in token.items():
            size[rank] = len(value)
        _BYTES[ranks_path] = np.frombuffer(b"".join(token.get(i, b"") for i in range(len(size))), np.uint8), size, np.cumsum(size) - size
    data, size, start = _BYTES[ranks_path]

    def decode(ids) -> bytes:
        ids = np.frombuffer(ids, "<u4")
        return data[ragged(start[ids], size[ids])].tobytes()

    return decode


def round_trip(df: DataFrame, ranks_path: str, pattern: str = PATTERN) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for every row of ``df(doc_id, text, ...)``.

    Texts are encoded and the ids decoded again. Null texts are empty: no ids, and the
    checksums of nothing. Repeated rows repeat; an empty table gives an empty result.
    """
    encoded = encode_texts(df, ranks_path, pattern)
    kind = encoded.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = _decoder(ranks_path)
        for batch in batches:
            ids = [x.as_buffer() for x in batch.column("ids")]
            sums = [[hashlib.sha256(x).hexdigest() for x in values] for values in (ids, map(decode, ids))]
            counts = pa.array([x.size >> 2 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), counts, pa.array(sums[0], pa.string()), pa.array(sums[1], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return encoded.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
