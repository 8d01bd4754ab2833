"""Near-duplicates by SimHash with meet-in-the-middle ball hashing.

Two fingerprints with at most ``2 r`` different bits share a variant: a value at most ``r``
bits from either. So every fingerprint emits all its variants within ``r``, fingerprints
meet on equal variants, and whatever meets is linked.

Variants are shuffled by *cell*: the leading ``CELL_BITS`` bits of the variant. Instead of
every variant, a fingerprint is sent once to each cell that holds some of its variants,
and the task of the cell derives the variants there; that is 137 records for 16 bits and
``r = 2`` where the plain form ships 2081. A cell with more than ``cell_rows`` records is
cut by further bits of the variant, again and again if need be, down to single variants,
where a map-side minimum is enough: no group of fingerprints is too large, none is dropped.

All fingerprints that meet in one variant are within ``2 r`` of each other, so links to the
smallest of them keep every group connected; all pairs are never formed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.batches import slices, text_bytes
from attestor.llm.carry import packed, unpacked
from attestor.llm.components import components
from attestor.session import materialize

SHINGLE = 4
SEED = 42
RADIUS = 2  # half of the largest distance that links
CELL_BITS = 16
STEP_BITS = 8
CELL_ROWS = 50_000
RUN_ROWS = 200_000  # records that a task works on at once


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes (unsigned 64-bit)."""
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype(">u8")
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big")


def fingerprint_of(words: bytes, starts: np.ndarray, ends: np.ndarray, shingle: int = SHINGLE) -> int:
    """Fingerprint of space-joined lower-case words with the given bounds."""
    if len(starts) == 0:
        return 0
    last = ends[shingle - 1 :] if len(ends) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(words[a:b], SEED) for a, b in zip(starts.tolist(), last.tolist(), strict=False)), np.uint64, len(last)
    )
    return majority(hashes)


def _fingerprints(column: pa.Array, shingle: int) -> np.ndarray:
    data, offsets = text_bytes(column)
    upper = (data >= 0x41) & (data <= 0x5A)
    data = np.where(upper, data | 0x20, data)
    white = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    out = np.zeros(len(offsets) - 1, np.uint64)
    for i in range(len(out)):
        text, gap = data[offsets[i] : offsets[i + 1]], white[offsets[i] : offsets[i + 1]]
        if len(text) == 0:
            continue
        edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        if len(starts) == 0:
            continue
        # Drop all white space but one character before each word, which becomes a space.
        keep = ~gap
        keep[starts[1:] - 1] = True
        words = np.where(gap, np.uint8(0x20), text)[keep].tobytes()
        lengths = ends - starts
        begins = np.cumsum(lengths + 1) - lengths - 1
        out[i] = fingerprint_of(words, begins, begins + lengths, shingle)
    return out


def fingerprints(df: DataFrame, shingle: int = SHINGLE, carry: bool = False) -> DataFrame:
    """``doc_id, fp`` (a signed 64-bit view of the fingerprint) for every row of
    ``df(doc_id, text, ...)``; with ``carry`` also ``_text`` and ``carried``."""
    source = packed(df, carry)
    kept = ["doc_id", "_text", "carried"] if carry else ["doc_id"]
    schema = source.select(*kept).withColumn("fp", F.lit(0).cast("bigint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            fp = pa.array(_fingerprints(batch.column("_text"), shingle).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), fp], [*kept, "fp"])

    return source.mapInArrow(run, schema)


def _flips(bits: range, most: int) -> list[int]:
    """All masks with at most ``most`` of the given bits (0 is the highest of 64)."""
    masks = [sum(1 << (63 - b) for b in chosen) for n in range(most + 1) for chosen in combinations(bits, n)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def _sent(fps: DataFrame, depth: int, radius: int) -> DataFrame:
    """``cell, fp``: every fingerprint once for each cell of ``depth`` bits that it reaches."""
    masks = F.array(*[F.lit(m).cast("bigint") for m in _flips(range(depth), radius)])
    cell = lambda m: F.shiftright(F.col("fp").bitwiseXOR(m), 64 - depth)
    return fps.select(F.explode(F.transform(masks, cell)).alias("cell"), "fp")


def _deeper(cells: DataFrame, depth: int, radius: int) -> DataFrame:
    """Send the records of cells with ``depth`` bits on to cells with ``STEP_BITS`` more."""
    new = depth + STEP_BITS
    # Shifts keep the sign, so only the low ``depth`` bits count.
    apart = F.shiftright(F.col("fp"), 64 - depth).bitwiseXOR(F.col("cell"))
    used = F.bit_count(apart.bitwiseAND(F.lit((1 << depth) - 1).cast("bigint")))
    masks = _flips(range(depth, new), radius)
    weigh = [bin(m & (2**64 - 1)).count("1") for m in masks]
    allowed = F.filter(
        F.array(*[F.struct(F.lit(m).cast("bigint").alias("m"), F.lit(w).alias("w")) for m, w in zip(masks, weigh, strict=True)]),
        lambda x: x["w"] + used <= radius,
    )
    low = (1 << STEP_BITS) - 1
    tail = lambda m: F.shiftright(F.col("fp").bitwiseXOR(m), 64 - new).bitwiseAND(F.lit(low))
    cell = lambda x: F.shiftleft(F.col("cell"), STEP_BITS).bitwiseOR(tail(x["m"]))
    return cells.select(F.explode(F.transform(allowed, cell)).alias("cell"), "fp")


def _masks(first: int, most: int) -> np.ndarray:
    return np.array([m & (2**64 - 1) for m in _flips(range(first, 64), most)], np.uint64)


def _roots(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable over the links ``a - b``, by repeated minimum and jumping."""
    root = np.arange(count)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if np.array_equal(new, root):
            return root
        root = new


def linked_in_cells(
    cells: np.ndarray, fps: np.ndarray, depth: int, radius: int = RADIUS, chained: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints (unsigned) that meet in whole cells of ``depth`` bits.

    The variants of a cell agree in their leading bits; the others are derived here. Most
    variants occur once, so only values that occur again are traced to their owners. With
    ``chained`` every fingerprint is linked once, to the smallest one it reaches; without, to
    the smallest one of each variant, which is never more than ``2 * radius`` bits away.
    """
    different, record = np.unique(fps, return_inverse=True)
    shift = np.uint64(64 - depth)
    head = cells.view(np.uint64) << shift
    away = np.bitwise_count((fps ^ head) >> shift)
    rest = head | (fps & np.uint64((1 << (64 - depth)) - 1))
    owners, variants = [], []
    for used in range(radius + 1):
        mine = np.flatnonzero(away == used)
        if len(mine):
            masks = _masks(depth, radius - used)
            variants.append((rest[mine, None] ^ masks[None, :]).ravel())
            owners.append(np.repeat(record[mine], len(masks)))
    values, owner = np.concatenate(variants), np.concatenate(owners)
    ordered = np.sort(values)
    again = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    del ordered
    if len(again) == 0:
        return different[:0], different[:0]
    at = np.searchsorted(again, values)
    at[at == len(again)] = 0
    met = np.flatnonzero(again[at] == values)
    slot, who = at[met], owner[met]
    smallest = np.full(len(again), len(different))
    np.minimum.at(smallest, slot, who)
    near = np.bitwise_count(different[who] ^ different[smallest[slot]]) <= 2 * radius
    if not chained:
        met = np.unique(who[near] * len(different) + smallest[slot][near])
        who, lead = met // len(different), met % len(different)
        return different[who[who != lead]], different[lead[who != lead]]
    root = _roots(len(different), who[near], smallest[slot][near])
    moved = root != np.arange(len(root))
    return different[moved], different[root[moved]]


def _links(cells: DataFrame, depth: int, radius: int, chained: bool) -> DataFrame:
    """``a, b`` links found in small cells; if ``chained`` at most one per fingerprint and run of cells.

    A task reads its cells in order and works on runs of whole cells, so it holds one run
    and at most one cell more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(upto: int | None):
            cell, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = len(cell) if upto is None else int(np.searchsorted(cell, upto))
            held[:] = [(cell[cut:], fp[cut:])] if cut < len(cell) else []
            a, b = linked_in_cells(cell[:cut], fp[:cut].view(np.uint64), depth, radius, chained) if cut else (fp[:0], fp[:0])
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            held.append((batch.column("cell").to_numpy(), batch.column("fp").to_numpy()))
            if sum(len(x[0]) for x in held) >= RUN_ROWS:
                yield flush(int(held[-1][0][-1]))
        if held:
            yield flush(None)

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "a bigint, b bigint")


def fingerprint_links(
    fps: DataFrame, radius: int = RADIUS, cell_bits: int = CELL_BITS, cell_rows: int = CELL_ROWS, chained: bool = True
) -> DataFrame:
    """Links ``a, b`` that connect distinct fingerprints ``fps(fp)`` exactly as all pairs at
    most ``2 * radius`` bits apart would. Without ``chained`` every link is itself such a pair,
    of a fingerprint and the smallest one that has the same variant; pairs may be repeated."""
    cells, depth, found = _sent(fps, cell_bits, radius), cell_bits, None
    while True:
        sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"))
        large = materialize(sizes.where(F.col("_n") > cell_rows).select("cell"))
        crowded = not large.isEmpty()
        small = cells.join(large, "cell", "left_anti") if crowded else cells
        part = _links(small, depth, radius, chained)
        found = part if found is None else found.unionByName(part)
        if not crowded:
            return found
        cells, depth = materialize(_deeper(cells.join(large, "cell", "left_semi"), depth, radius)), depth + STEP_BITS
        if depth >= 64:
            low = materialize(cells.groupBy("cell").agg(F.min("fp").alias("b")))
            return found.unionByName(cells.join(low, "cell").where("fp <> b").select(F.col("fp").alias("a"), "b"))


def _told(rows: DataFrame, radius: int) -> DataFrame:
    """``fp, _best``: for every fingerprint of ``rows(doc_id, fp, _row)`` the first row of its
    component, as struct of ``n`` (no id), ``doc`` and ``row``."""
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("doc"), F.col("_row").alias("row"))
    first = materialize(rows.groupBy("fp").agg(F.min(order).alias("_first")))
    links = components(fingerprint_links(first.select("fp"), radius))
    rooted = first.join(links.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = materialize(rooted)
    best = materialize(rooted.groupBy("root").agg(F.min("_first").alias("_best")))
    return materialize(rooted.select("fp", "root").join(best, "root").select("fp", "_best"))


def near_groups(df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fingerprint, component_id, kept`` for every row of ``df(doc_id, text, ...)``.

    The fingerprint is 16 lower-case hexadecimal digits; ``component_id`` is the smallest
    ``doc_id`` reachable over links between fingerprints at most ``2 * radius`` bits apart
    (null if no row of the component has a ``doc_id``). One row of each component is
    ``kept``: that with the smallest ``doc_id``, one of several such rows. A text without
    words has fingerprint zero and links like any other; null texts are empty. An empty
    table gives an empty result; other columns are not looked at.
    """
    rows = materialize(fingerprints(df, shingle).withColumn("_row", F.monotonically_increasing_id()))
    return rows.join(_told(rows, radius), "fp").select(
        "doc_id",
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("_best.doc").alias("component_id"),
        (F.col("_best.row") == F.col("_row")).alias("kept"),
    )


def deduplicated(df: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """The row that stays of every group of near-duplicates, with all its columns.

    Rows are taken out by the stored list of those that go, so texts are only shuffled if
    that list is long.
    """
    rows = materialize(fingerprints(df, shingle, carry=True).withColumn("_row", F.monotonically_increasing_id()))
    slim = rows.select("doc_id", "fp", "_row")
    gone = slim.join(_told(slim, radius), "fp").where(F.col("_best.row") != F.col("_row")).select("_row")
    return rows.join(materialize(gone), "_row", "left_anti").select(*unpacked(df.columns))
