"""Helpers for operators that work on whole texts in Arrow batches.

A text column is seen as one array of UTF-8 bytes with offsets, so that scans, cuts and
counts are vectorized over all rows of a batch. A null text is an empty text everywhere.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 2 << 20  # text bytes handled at once; one longer text is a slice of its own


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that no slice has more text bytes than ``limit``, single rows apart."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and ``n + 1`` offsets into them."""
    filled = pc.fill_null(column, "")
    _, offsets, data = filled.buffers()
    width = np.int64 if pa.types.is_large_string(filled.type) else np.int32
    bounds = np.frombuffer(offsets, width, count=filled.offset + len(filled) + 1)[filled.offset :].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(filled) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]]
    return raw, bounds - bounds[0]


def runs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[object, Iterator[tuple]]]:
    """Groups of a stream sorted by its first column, each as an iterator over the other columns.

    Rows are read as they are asked for; what a caller leaves of a group is skipped.
    """
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    held = next(rows, None)

    def own(key) -> Iterator[tuple]:
        nonlocal held
        while held is not None and held[0] == key:
            yield held[1:]
            held = next(rows, None)

    while held is not None:
        key = held[0]
        group = own(key)
        yield key, group
        for _ in group:
            pass


OTHER, LETTER, DIGIT, SIGN, APOSTROPHE, GAP = range(6)
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x21:0x7F] = SIGN
_CLASS[0x30:0x3A] = DIGIT
_CLASS[0x41:0x5B] = _CLASS[0x61:0x7B] = LETTER
_CLASS[0x27] = APOSTROPHE
_CLASS[[0x20, 0x0A]] = GAP


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cut every text where letters, digits and signs meet, and before a space or line feed
    that follows one of them.

    Returns the bounds of all segments and, per text, the index of its first segment (with
    one more entry at the end). Rules that split text into runs of one class, each with one
    space before it at most, and contractions after an apostrophe, never reach across a cut.
    Only ASCII and the letters of U+00C0..U+00FF are looked at; nothing is cut elsewhere.
    """
    cuts = np.zeros(0, np.int64)
    if len(data) > 1:
        kind = _CLASS[data]
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]  # but for the signs of U+00D7 and U+00F7
        kind[lead] = kind[lead + 1] = LETTER
        before, after = kind[:-1], kind[1:]
        solid, run = (before >= LETTER) & (before <= APOSTROPHE), (before >= LETTER) & (before <= SIGN)
        turn = run & (before != after) & (after >= LETTER) & (after <= SIGN)
        cuts = np.flatnonzero(turn | (solid & (after == GAP))) + 1
    border = np.zeros(len(data) + 1, bool)
    border[cuts] = border[offsets] = True
    bounds = np.flatnonzero(border)
    return bounds, np.searchsorted(bounds, offsets)


def distinct_segments(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """Per segment the position of its bytes in the list of different segments."""
    if len(bounds) < 2:
        return np.zeros(0, np.int32), []
    width = np.int32 if bounds[-1] < 2**31 - 1 else np.int64
    kind = pa.binary() if width is np.int32 else pa.large_binary()
    cells = pa.Array.from_buffers(
        kind, len(bounds) - 1, [None, pa.py_buffer(bounds.astype(width)), pa.py_buffer(np.ascontiguousarray(data))]
    )
    encoded = cells.dictionary_encode()
    return encoded.indices.to_numpy(), encoded.dictionary.to_pylist()


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` for ``counts[i]`` entries, end to end."""
    total = int(counts.sum())
    skipped = np.cumsum(counts) - counts
    return np.repeat(starts - skipped, counts) + np.arange(total, dtype=np.int64)


class IdCache:
    """Ids of segments as little-endian unsigned 32-bit bytes.

    ``encode`` maps the bytes of one segment to its ids; ``fold`` may first replace bytes of
    the texts by others that give the same ids. At most ``limit`` segments are remembered, in
    two halves: a full half becomes the old one, which is dropped when the next is full, and
    what is used again moves to the young half. That only saves time; results never depend
    on it.
    """

    def __init__(self, encode, fold=None, limit: int = 500_000):
        self.encode, self.fold, self.half = encode, fold, limit // 2
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def ids(self, different: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the different segments end to end, and how many each has."""
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}
        young, old, encode = self.young, self.old, self.encode
        found = []
        for segment in different:
            ids = young.get(segment)
            if ids is None:
                ids = old.get(segment)
                if ids is None:
                    ids = array("I", encode(segment)).tobytes()
                young[segment] = ids
            found.append(ids)
        return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) >> 2 for x in found], np.int64)

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and ``n + 1`` offsets into them."""
        bounds, first = segments(data, offsets)
        data = self.fold(data, offsets) if self.fold else data
        which, different = distinct_segments(data, bounds)
        ids, counts = self.ids(different)
        starts = np.cumsum(counts) - counts
        per_segment = counts[which]
        flat = ids[ragged(starts[which], per_segment)] if len(which) else ids
        ends = np.concatenate([[0], np.cumsum(per_segment)]).astype(np.int64)
        return flat, ends[first]
