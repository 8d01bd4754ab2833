"""Best-fit packing of documents into sequences of a fixed number of tokens.

Packing looks only at the histogram of piece lengths, which has at most ``capacity`` bins
whatever the number of documents. Patterns of a few documents that fill a sequence are
enumerated over classes of lengths, non-negative least squares fits how often each pattern
is to be used so that the histogram is met, and the counts are rounded down. What is left,
longest first, goes to the tightest gap it fits, in sequences of a pattern or in new ones.
All of that is arithmetic on counts: a step places all pieces of one length into all
sequences with one gap. The plan comes back to Spark as ranges of ranks per length, and
every piece finds its place from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.batches import IdCache, slices, text_bytes
from attestor.operators.ordering import running_totals
from attestor.session import materialize

CAPACITY = 4096
END_ID = 1
CLASSES = 128  # length classes a pattern is made of
PATTERN_DOCS = 4
RANK_BUCKETS = 4096


class WordIds:
    """Ids of white-space separated words, equal to those of the tokenizer file.

    The tokenizer drops white space, so words are independent. A word of plain letters is
    lower-cased and split into the tokenizer's pieces here, and its model is asked for each
    piece; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        #: Strings with an id of their own wherever they stand; segments never hold one whole.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model
        self.bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.plain = regex.compile("[\\n\\x20-\\x7eÀ-ÿ]*")
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")

    def _piece(self, piece: str) -> list[int]:
        mapped = piece if piece.isascii() else "".join(x for x, _ in self.bytes_of.pre_tokenize_str(piece))
        return [t.id for t in self.model.tokenize(mapped)]

    def __call__(self, segment: bytes) -> list[int]:
        text = segment.decode("utf-8", "replace")
        if not self.plain.fullmatch(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        word = text.strip(" \n").lower()
        if word.isascii() and word.isalpha():
            return self._piece(word)
        return [i for piece in self.pieces.findall(word) for i in self._piece(piece)]


def lower_plain(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lower-case A-Z and make line feeds spaces in texts of ASCII and U+00C0..U+00FF, where
    the tokenizer's normalization is just that; other texts stay as they are."""
    plain = data < 0x80
    lead = data[:-1] == 0xC3
    plain[:-1] |= lead
    plain[1:] |= lead
    odd = np.concatenate([[0], np.cumsum(~plain)])[offsets]
    wide = np.repeat(np.diff(odd) == 0, np.diff(offsets))
    folded = np.where(wide & (data >= 0x41) & (data <= 0x5A), data | 0x20, data)
    folded[wide & (data == 0x0A)] = 0x20
    return folded


_TOOLS: dict[str, IdCache] = {}  # one per Python worker: loading the file takes a while


def _tool(path: str) -> IdCache:
    if path not in _TOOLS:
        _TOOLS[path] = IdCache(WordIds(path), lower_plain)
    return _TOOLS[path]


def _with_special(tool: IdCache, texts: pa.Array) -> dict[int, bytes]:
    """Ids of the texts that hold a special string, by row; the tokenizer sees them whole."""
    found = None
    for content in tool.encode.special:
        hit = pc.match_substring(texts, content)
        found = hit if found is None else pc.or_(found, hit)
    rows = [] if found is None else np.flatnonzero(pc.fill_null(found, False).to_numpy(zero_copy_only=False)).tolist()
    return {i: np.array(tool.encode.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, "<u4").tobytes() for i in rows}


def token_pieces(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``doc_id, piece, start, length, ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = _tool(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        for batch in slices(batches, "_text"):
            flat, bounds = tool.texts(*text_bytes(batch.column("_text")))
            special = _with_special(tool, batch.column("_text"))
            which, piece, start, length, crc = [], [], [], [], []
            for i in range(batch.num_rows):
                ids = special.get(i, None)
                ids = (flat[bounds[i] : bounds[i + 1]].tobytes() if ids is None else ids) + end
                for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                    cut = ids[at : at + 4 * capacity]
                    which.append(i), piece.append(n), start.append(at >> 2), length.append(len(cut) >> 2), crc.append(zlib.crc32(cut))
            columns = [batch.column("doc_id").take(pa.array(which, pa.int64())), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"])

    source = df.select("doc_id", F.col("text").alias("_text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Active-set solution of ``min |a x - b|`` with ``x >= 0``."""
    count = a.shape[1]
    x, active = np.zeros(count), np.zeros(count, bool)
    scale = 1e-9 * max(1.0, float(np.abs(b).max(initial=0.0)))
    for _ in range(rounds):
        gain = a.T @ (b - a @ x)
        gain[active] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= scale:
            break
        active[best] = True
        while True:
            chosen = np.flatnonzero(active)
            trial = np.linalg.lstsq(a[:, chosen], b, rcond=None)[0]
            if (trial > 0).all():
                x[:] = 0
                x[chosen] = trial
                break
            falling = trial <= 0
            now = x[chosen]
            step = np.min(now[falling] / np.maximum(now[falling] - trial[falling], 1e-300))
            x[chosen] = now + step * (trial - now)
            gone = chosen[(x[chosen] <= scale * 1e-3) & falling]
            if len(gone) == 0:
                gone = chosen[falling][:1]
            active[gone] = False
            x[gone] = 0
            if not active.any():
                break
    return x


def class_patterns(classes: int, most: int) -> list[tuple[int, ...]]:
    """All descending tuples of at most ``most`` classes that add up to ``classes``."""
    out: list[tuple[int, ...]] = []

    def grow(chosen: tuple[int, ...], left: int):
        if left == 0:
            out.append(chosen)
        elif len(chosen) < most:
            for c in range(min(left, chosen[-1] if chosen else classes), 0, -1):
                if c * (most - len(chosen)) < left:
                    break
                grow((*chosen, c), left - c)

    grow((), classes)
    return out


class Bins:
    """Open sequences by gap; each group is a content with the number of its sequences."""

    def __init__(self, capacity: int):
        self.capacity, self.by_gap = capacity, [[] for _ in range(capacity + 1)]
        self.open = np.zeros(capacity + 1, bool)

    def add(self, gap: int, content: tuple, count: int) -> None:
        if count:
            self.by_gap[gap].append((content, count))
            self.open[gap] = True

    def place(self, length: int, count: int) -> None:
        """Best fit for ``count`` pieces of one length: always the tightest gap."""
        while count:
            gaps = np.flatnonzero(self.open[length:])
            if len(gaps) == 0:
                each = self.capacity // length
                self.add(self.capacity - each * length, ((length, each),), count // each)
                if rest := count % each:
                    self.add(self.capacity - rest * length, ((length, rest),), 1)
                return
            gap = length + int(gaps[0])
            content, free = self.by_gap[gap].pop()
            self.open[gap] = bool(self.by_gap[gap])
            each = gap // length
            full = min(free, count // each)
            self.add(gap - each * length, (*content, (length, each)), full)
            rest = min(count - full * each, each - 1) if full < free else 0
            if rest:
                self.add(gap - rest * length, (*content, (length, rest)), 1)
            self.add(gap, content, free - full - bool(rest))
            count -= full * each + rest


def plan(histogram: dict[int, int], capacity: int = CAPACITY, classes: int = CLASSES, most: int = PATTERN_DOCS) -> list[tuple]:
    """Contents ``((length, copies), ...)`` and counts of the sequences for a histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    bins = Bins(capacity)
    width = -(-capacity // classes)
    classes = -(-capacity // width)
    edge = lambda c: slice((c - 1) * width + 1, c * width + 1)  # noqa: E731  lengths of a class
    wanted = np.array([left[edge(c)].sum() for c in range(1, classes + 1)], float)
    patterns = [p for p in class_patterns(classes, most) if all(wanted[c - 1] for c in p)]
    if patterns:
        matrix = np.zeros((classes, len(patterns)))
        for i, p in enumerate(patterns):
            for c in p:
                matrix[c - 1, i] += 1
        # A long document that misses its pattern costs a sequence, a short one fills a gap.
        weight = np.arange(1, classes + 1) / classes
        repeats = nnls(matrix * weight[:, None], wanted * weight)
        for i in np.argsort([-max(p) for p in patterns], kind="stable"):
            todo = int(repeats[i] + 1e-6)
            while todo:
                taken = _filled(left, patterns[i], edge, capacity)
                if taken is None:
                    break
                each = {x: taken.count(x) for x in taken}
                times = min([todo, *(int(left[x]) // n for x, n in each.items())])
                for x, n in each.items():
                    left[x] -= n * times
                bins.add(capacity - sum(taken), tuple(each.items()), times)
                todo -= times
    for length in np.flatnonzero(left)[::-1].tolist():
        bins.place(length, int(left[length]))
    return [group for groups in bins.by_gap for group in groups]


def _filled(left: np.ndarray, pattern: tuple[int, ...], edge, capacity: int) -> list[int] | None:
    """Lengths for a pattern: the longest of each class, and for the last the best fit."""
    taken: list[int] = []
    for c in pattern[:-1]:
        have = left[edge(c)].copy()
        for x in taken:
            if edge(c).start <= x < edge(c).stop:
                have[x - edge(c).start] -= 1
        found = np.flatnonzero(have > 0)
        if len(found) == 0:
            return None
        taken.append(edge(c).start + int(found[-1]))
    have = left[: capacity - sum(taken) + 1].copy()
    for x in taken:
        if x < len(have):
            have[x] -= 1
    found = np.flatnonzero(have > 0)
    return [*taken, int(found[-1])] if len(found) and found[-1] >= edge(pattern[-1]).start else None


def _slots(groups: list[tuple]) -> dict[int, np.ndarray]:
    """Per length the rows ``first rank, first sequence, copies, offset``, ascending."""
    rows, used, sequence = defaultdict(list), defaultdict(int), 0
    for content, count in groups:
        offset = 0
        for length, copies in content:
            rows[length].append((used[length], sequence, copies, offset))
            used[length] += copies * count
            offset += length * copies
        sequence += count
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to ``pieces(doc_id, piece, start, length, ids_crc32)``.

    ``pieces`` is read several times, so it should be a stored table. The histogram that
    comes to the driver, and the plan sent back, depend on the number of different lengths
    only, which is at most ``capacity``.
    """
    counted = pieces.groupBy("length").count().collect()
    slots = pieces.sparkSession.sparkContext.broadcast(_slots(plan({r["length"]: r["count"] for r in counted}, capacity)))
    key = F.xxhash64("doc_id", "piece", "start", "ids_crc32")
    spread = materialize(pieces.withColumn("_key", key).withColumn("_bucket", F.pmod("_key", F.lit(RANK_BUCKETS))))
    order = ["_key", "doc_id", "piece", "start", "ids_crc32"]
    ranked = running_totals(spread, by=["length"], bucket="_bucket", order=order, totals={"_rank": F.lit(1).cast("bigint")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("_rank").to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for size in np.unique(length):
                mine = np.flatnonzero(length == size)
                table = slots.value[int(size)]
                slot = table[np.searchsorted(table[:, 0], rank[mine], side="right") - 1]
                within = rank[mine] - slot[:, 0]
                sequence[mine] = slot[:, 1] + within // slot[:, 2]
                offset[mine] = slot[:, 3] + within % slot[:, 2] * size
            kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sequence), pa.array(offset)], [*schema.names])

    schema = pieces.sparkSession.createDataFrame([], "sequence_id bigint, offset bigint").schema
    schema = type(schema)([*pieces.select("doc_id", "piece", "start", "length", "ids_crc32").schema.fields, *schema.fields])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "_rank").mapInArrow(run, schema)


def packed_documents(df: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack all texts of ``df(doc_id, text, ...)`` into sequences of at most ``capacity`` tokens.

    One row per piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``. A
    document is its ids followed by ``end_id``; only a longer one is cut, into pieces of
    ``capacity``. Null and empty texts are the end id alone. Rows are packed one by one, so
    repeated rows appear repeatedly and a null ``doc_id`` stays null. An empty table gives
    an empty result; other columns are not looked at.
    """
    return pack(materialize(token_pieces(df, tokenizer_path, capacity, end_id)), capacity)
