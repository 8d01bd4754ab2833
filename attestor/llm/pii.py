"""Personal data by bootstrapped contextual extraction.

Fixed patterns find the *base* spans of four kinds; they are the seeds and always stay.
The words around a seed induce lexical patterns. Everything else that looks like an
identifier but fits no base pattern is a candidate, and the patterns it occurs in are
recorded in the same way. On the graph of patterns and instances, Spark scores in turns,
until the scores stand still: a pattern of a kind is as good as the share of its instances
that are (believed to be) of that kind, and an instance is believed as far as any of its
patterns is good. Candidates that occur in a pattern of high confidence and enough different
seeds become spans, however many they are.

Only identifier-like occurrences enter the graph, each with a bounded context. Patterns and
instances are aggregated with map-side combine; nothing is gathered per pattern.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.batches import slices
from attestor.llm.carry import packed, unpacked
from attestor.session import materialize

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS = 5  # different seeds that a pattern must have
CONFIDENCE = 0.9
TOLERANCE = 1e-3  # scores that move less stand still
NEAR = 64  # characters first looked at for the words of a context; longer words go by their checksum

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9][\x20().0-9-]*[0-9]")
_DIGITS = re.compile(r"[0-9]++")
_DIGIT = re.compile(r"[0-9]")
_GAP = re.compile(r"\s")

Span = tuple[int, int, int]  # kind, start, end


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @ so that long runs without one cost nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", done if found else at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, by kind and start; failing matches are not tried again."""
    found: list[Span] = [(0, a, b) for a, b in _emails(text)]
    if not _DIGIT.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in m.group().split(".")):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(map(len, _DIGITS.findall(m.group()))) <= 15:
            found.append((3, m.start(), m.end()))
    return found


def candidate_spans(text: str, base: list[Span]) -> list[tuple[int, int, int]]:
    """Other identifier-like spans with the kind of their shape, or -1 for no kind.

    An @ word looks like an email, four numbers with dots like an ip, 16 to 19 digits like a
    card, 8 to 15 digits like a phone; further words with a digit are evidence against a
    pattern. Nothing overlaps a base span.
    """
    spans: list[tuple[int, int, int]] = []
    at, done = text.find("@"), 0
    while at >= 0:
        a, b = _word(text, at, done)
        if b - a > 2 and a < at < b - 1:
            spans.append((0, a, b))
        done = max(b, at + 1)
        at = text.find("@", done)
    done = 0
    for m in _NUMBER.finditer(text):
        digits = sum(map(len, _DIGITS.findall(m.group())))
        dotted = m.group().count(".") == 3 and len(_DIGITS.findall(m.group())) == 4 and " " not in m.group()
        kind = 1 if dotted else 2 if 16 <= digits <= 19 else 3 if 8 <= digits <= 15 else -1
        spans.append((kind, m.start(), m.end()))
    for m in _DIGITS.finditer(text):
        if m.start() >= done:
            a, b = _word(text, m.start(), done)
            spans.append((-1, a, b))
            done = b
    taken = sorted((a, b) for _, a, b in base)
    out, i = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], s[0] < 0, -s[2])):
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        clear = all(taken[j][0] >= b or taken[j][1] <= a for j in range(max(0, i - 4), min(len(taken), i + 1)))
        if clear and (not out or out[-1][2] <= a):
            out.append((kind, a, b))
    return out


def _word(text: str, at: int, after: int) -> tuple[int, int]:
    """Bounds of the word around a position, not to begin before ``after``."""
    step, right = 64, at
    while True:
        left = max(after, right - step)
        before = [m.end() for m in _GAP.finditer(text, left, right)]
        if before or left == after:
            break
        right, step = left, 2 * step
    end = _GAP.search(text, at)
    return (before[-1] if before else left), (end.start() if end else len(text))


def _context_words(text: str, start: int, end: int, first: bool) -> list[str]:
    """Whole words of a stretch next to a span: the first one, or the last two."""
    near = NEAR
    while True:
        a, b = (start, min(end, start + near)) if first else (max(start, end - near), end)
        words = text[a:b].split()
        whole = (b == end or len(words) > 1) if first else (a == start or len(words) > 2)
        if whole:
            break
        near *= 4
    words = words[:1] if first else words[-2:]
    words = [_DIGITS.sub("0", w.lower()) for w in words]
    return [w if len(w) <= NEAR else hashlib.md5(w.encode()).hexdigest() for w in words]


def contexts(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a span: one and two words before it, one behind it, one on either side."""
    left, right = _context_words(text, 0, start, False), _context_words(text, end, len(text), True)
    out = [f"{left[-1]} _"] if left else []
    if len(left) == 2:
        out.append(" ".join(left) + " _")
    if right:
        out.append(f"_ {right[0]}")
    return [*out, f"{left[-1]} _ {right[0]}"] if left and right else out


_MARK = "array<struct<kind:int,start:int,stop:int,value:string,patterns:array<string>,seed:boolean>>"


def scan(df: DataFrame, carry: bool = False) -> DataFrame:
    """``doc_id, marks`` per row: base spans (seeds) and candidates with their contexts.

    With ``carry`` also ``_text`` and ``carried``.
    """
    source = packed(df, carry)
    kept = ["doc_id", "_text", "carried"] if carry else ["doc_id"]
    schema = source.select(*kept).withColumn("marks", F.lit(None).cast(_MARK)).schema
    entry = pa.struct([
        ("kind", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()),
        ("value", pa.string()), ("patterns", pa.list_(pa.string())), ("seed", pa.bool_()),
    ])

    def marks(text: str | None) -> list[dict]:
        text = text or ""
        base = base_spans(text)
        rows = [(k, a, b, True) for k, a, b in base]
        if base or _DIGIT.search(text) or "@" in text:
            rows += [(k, a, b, False) for k, a, b in candidate_spans(text, base)]
        return [
            {"kind": k, "start": a, "stop": b, "value": hashlib.md5(text[a:b].lower().encode()).hexdigest(), "patterns": contexts(text, a, b), "seed": seed}
            for k, a, b, seed in rows
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            found = pa.array([marks(t) for t in batch.column("_text").to_pylist()], pa.list_(entry))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), found], [*kept, "marks"])

    return source.mapInArrow(run, schema)


def pattern_scores(marks: DataFrame, min_seeds: int = MIN_SEEDS, tolerance: float = TOLERANCE) -> DataFrame:
    """``pattern, kind, n_seeds, confidence`` of all patterns with enough different seeds.

    Confidence is the believed share of a pattern's instances; a seed is believed, a candidate
    with 1 - product(1 - confidence) over its patterns of its kind. A candidate that occurs
    in one pattern only is believed as the pattern itself is, so it drops out of the share
    and the rest decides; that leaves few rounds for the others. Scores only rise, so the
    rounds end.
    """
    edges = marks.select(F.explode("patterns").alias("pattern"), "kind", "value", "seed")
    edges = edges.groupBy("pattern", "kind", "value").agg(F.max("seed").alias("seed"))
    # A pattern without enough seeds is never trusted, so its edges say nothing.
    seeds = edges.where("seed").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n_seeds"))
    seeds = materialize(seeds.where(F.col("n_seeds") >= min_seeds))
    edges = materialize(edges.join(seeds.select("pattern").distinct(), "pattern", "left_semi"))
    # Patterns of a kind that an instance has, and whether it is a seed in any of them.
    trusted = edges.join(seeds.select("pattern", "kind"), ["pattern", "kind"], "left_semi")
    known = trusted.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("degree"), F.max("seed").alias("sure"))
    edges_ = materialize(trusted.join(known, ["kind", "value"]).select("pattern", "kind", "value", "sure", (~F.col("sure") & (F.col("degree") == 1)).alias("own")))
    totals = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    sums = edges_.groupBy("pattern", "kind").agg(F.sum(F.col("own").cast("bigint")).alias("own"), F.sum(F.col("sure").cast("bigint")).alias("sure"))
    base = materialize(seeds.join(sums, ["pattern", "kind"]).join(totals, "pattern").select("pattern", "kind", "n_seeds", "sure", (F.col("n") - F.col("own")).alias("rest")))
    shared = materialize(edges_.where("not sure and not own").select("pattern", "kind", "value"))
    scores = materialize(base.select("pattern", "kind", "n_seeds", (F.col("sure") / F.col("rest")).alias("confidence")))
    while not shared.isEmpty():
        heard = shared.join(scores.select("pattern", "kind", "confidence"), ["pattern", "kind"]).groupBy("kind", "value")
        belief = heard.agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("b"))
        gained = shared.join(belief, ["kind", "value"]).groupBy("pattern", "kind").agg(F.sum("b").alias("b"))
        risen = base.join(gained, ["pattern", "kind"], "left").join(scores.select("pattern", "kind", F.col("confidence").alias("was")), ["pattern", "kind"])
        fresh = (F.col("sure") + F.coalesce("b", F.lit(0.0))) / F.col("rest")
        told = materialize(risen.select("pattern", "kind", "n_seeds", fresh.alias("confidence"), "was"))
        scores = told.drop("was")
        if told.where(F.col("confidence") - F.col("was") > tolerance).isEmpty():
            break
    return scores


def confident_patterns(marks: DataFrame, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """``pattern, kind`` of the patterns to be trusted, from ``marks(kind, value, patterns, seed)``."""
    return pattern_scores(marks, min_seeds).where(F.col("confidence") >= confidence)


def _extracted(df: DataFrame, carry: bool, min_seeds: int, confidence: float) -> DataFrame:
    """Rows with their number, base spans ``base`` and added spans ``added`` (may be null)."""
    rows = materialize(scan(df, carry).withColumn("_row", F.monotonically_increasing_id()))
    flat = rows.select("_row", F.explode("marks").alias("m")).select("_row", "m.*")
    trusted = confident_patterns(flat, min_seeds=min_seeds, confidence=confidence)
    seen = flat.where("not seed and kind >= 0").select("_row", "kind", "start", "stop", F.explode("patterns").alias("pattern"))
    hits = seen.join(trusted, ["pattern", "kind"], "left_semi")
    added = materialize(hits.groupBy("_row").agg(F.collect_set(F.struct("kind", "start", "stop")).alias("added")))
    base = F.transform(F.filter("marks", lambda m: m["seed"]), lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["stop"].alias("stop")))
    return rows.withColumn("base", base).drop("marks").join(added, "_row", "left")


def _written(spans) -> F.Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    told = F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string")))
    return F.array_join(told, ",")


def _all_spans() -> F.Column:
    return F.array_sort(F.concat("base", F.coalesce("added", F.array().cast("array<struct<kind:int,start:int,stop:int>>"))))


def personal_data(df: DataFrame, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` for every row of ``df(doc_id, text, ...)``.

    Counts and checksum are those of the base spans; ``spans`` holds the added ones, too.
    Positions are code points. Null and empty texts have no spans. Repeated rows repeat, and
    count once as instances of a pattern; an empty table gives an empty result; other
    columns are not looked at.
    """
    rows = _extracted(df, False, min_seeds, confidence)
    of_kind = lambda i: lambda m: m["kind"] == i
    count = [F.size(F.filter("base", of_kind(i))).cast("bigint").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    ordered = F.array_sort("base")
    return rows.select("doc_id", *count, F.sha2(_written(ordered), 256).alias("base_sha256"), _written(_all_spans()).alias("spans"))


def redacted(df: DataFrame, min_seeds: int = MIN_SEEDS, confidence: float = CONFIDENCE) -> DataFrame:
    """The rows of ``df`` with every span of ``text`` replaced by ``[KIND]``.

    Overlapping spans become one replacement with the kind of the first. A column
    ``n_chars`` is set to the new length; other columns stay as they are, and so do texts
    without spans and null texts.
    """
    rows = _extracted(df, True, min_seeds, confidence)
    source = rows.select("_text", _all_spans().alias("_spans"), "carried")

    def clean(value: str | None, spans: list[dict]) -> str | None:
        if not spans:
            return value
        out, done, last = [], 0, 0
        for span in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
            if span["start"] >= last:
                out += [value[done : span["start"]], f"[{KINDS[span['kind']].upper()}]"]
            done = last = max(last, span["stop"])
        return "".join([*out, value[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_text"):
            pairs = zip(batch.column("_text").to_pylist(), batch.column("_spans").to_pylist(), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("carried"), pa.array([clean(*p) for p in pairs], pa.string())], ["carried", "_text"])

    done = source.mapInArrow(run, source.select("carried", "_text").schema)
    kind = dict(df.dtypes).get("n_chars", "bigint")
    return done.select(*unpacked(df.columns, {"n_chars": F.char_length("_text").cast(kind)}))
