"""Repair of conversation structure as shortest paths found by auction.

The rows of a conversation and the states of the wanted role order span a lattice whose arcs
are edits with integer costs. An auction finds a shortest path: the path under construction
is extended to the neighbour that the prices make cheapest, or, where the price of its end is
too low for every neighbour, the price rises and the path contracts. Prices never exceed a
node's distance to the goal and meet it on the path; then every shortest path consists of
tight arcs, and the one with the least letters is traced along them.

Long conversations are auctioned in sections from their end: once every entrance of a section
has been an origin, the prices of the entrances are exact and close the section before it, so
time is linear in the rows and only four letters a row are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestor.llm.batches import runs
from attestor.session import materialize

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
SECTION = 16  # rows of a conversation auctioned at once

#: The wanted order of role initials, (s?(ua)+)?, as an automaton: state -> {initial: next}.
START, OPENED, ASKED, ANSWERED = range(4)
NEXT = ({"s": OPENED, "u": ASKED}, {"u": ASKED}, {"a": ANSWERED}, {"u": ASKED})
TURN = ("user", "user", "assistant", "user")  # the role that a new or renamed row gets in a state
AFTER = (ASKED, ASKED, ANSWERED, ASKED)
STATES = 4
FINAL = {START, ANSWERED}
FAULTS = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
_FAR = 1 << 60


def _arcs(row: tuple[str, int], state: int) -> Iterator[tuple[str, int, int]]:
    """Edits of one row in a state: letter, cost, next state."""
    initial, fault = row
    yield "D", DELETE, state
    if fault in (FAULTS["blank"], FAULTS["duplicate"]):
        return
    extra = TRUNCATED if fault == FAULTS["truncated"] else 0
    if initial in NEXT[state]:
        yield "K", KEEP + extra, NEXT[state][initial]
    yield "R", REROLE + extra, AFTER[state]


def _section(rows: list[tuple[str, int]], exits: list[int]) -> tuple[list[int], list[str]]:
    """Distances of the four entrances of a section, and per node its least letter.

    ``exits[q]`` is the distance from the end of the section in state ``q`` to the goal. Node
    ``4 i + q`` stands before row ``i`` in state ``q``. A letter is empty where no tight path
    leads on.
    """
    size, base = len(rows), min(exits)  # prices start at what every path has to pay behind the section
    goal = STATES * (size + 1)
    arcs: list[list[tuple[int, int, str]]] = [[] for _ in range(goal + 1)]
    for i in range(size + 1):
        for q in range(STATES):
            own = arcs[STATES * i + q]
            if i < size:
                own += [(cost, STATES * (i + 1) + to, letter) for letter, cost, to in _arcs(rows[i], q)]
            elif exits[q] < _FAR:
                own.append((exits[q] - base, goal, ""))
            own.append((INSERT, STATES * i + AFTER[q], "I"))
    price = [0] * (goal + 1)
    for entrance in range(STATES):
        path = [entrance]
        while path[-1] != goal:
            node = path[-1]
            best, to = min((cost + price[n], n) for cost, n, _ in arcs[node])
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
    letters = [""] * (goal + 1)
    leads = [False] * goal + [True]
    for i in range(size, -1, -1):
        layer = range(STATES * i, STATES * (i + 1))
        for _ in range(3):  # insertions stay in a layer; tight ones form no cycle, hence chains of two
            for node in layer:
                tight = [(letter, to) for cost, to, letter in arcs[node] if price[node] == cost + price[to] and leads[to]]
                if tight:
                    leads[node] = True
                    letters[node] = min(tight)[0] or "."
    return [p + base for p in price[:STATES]], letters[: STATES * size + STATES]


def cheapest_edits(rows: bytes) -> tuple[str, int]:
    """Letters and cost of the cheapest edits; among equals the letters that sort first.

    A row is one byte, its fault plus four times the place of its initial in ``"sua"``, or 12
    for another initial.
    """
    decoded = [("sua "[b >> 2], b & 3) for b in rows]
    exits = [0 if q in FINAL else _FAR for q in range(STATES)]
    sections: list[list[str]] = []
    for at in range((max(len(decoded), 1) - 1) // SECTION * SECTION, -1, -SECTION):
        exits, letters = _section(decoded[at : at + SECTION], exits)
        sections.append(letters)
    out, state = [], START
    for number, letters in enumerate(reversed(sections)):
        row = 0
        while (letter := letters[STATES * row + state]) != ".":
            out.append(letter)
            if letter == "I":
                state = AFTER[state]
                continue
            initial = decoded[number * SECTION + row][0]
            row += 1
            state = {"D": state, "R": AFTER[state]}[letter] if letter != "K" else NEXT[state][initial]
    return "".join(out), exits[START]


_remembered = lru_cache(maxsize=1 << 16)(cheapest_edits)


def _solve(rows: bytes) -> tuple[str, int]:
    """Equal short conversations are solved once per worker; that only saves time."""
    return _remembered(rows) if len(rows) <= 64 else cheapest_edits(rows)


def apply_edits(letters: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str, str, int | None]]:
    """``role, text, letter, place`` of the repaired rows; ``place`` is that of the row used."""
    state, source = START, enumerate(rows)
    for letter in letters:
        if letter == "I":
            yield TURN[state], "", letter, None
            state = AFTER[state]
            continue
        place, (role, text) = next(source)
        if letter == "K":
            yield role, text, letter, place
            state = NEXT[state][role[0]]
        elif letter == "R":
            yield TURN[state], text, letter, place
            state = AFTER[state]


# --- tables ----------------------------------------------------------------------------------

VISIBLE = "[^\\x20\\x09-\\x0D]"
LAST = "([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z"


def _spaced(name: str, kind: str) -> Column:
    return F.coalesce(F.col(name).cast(kind).cast("string"), F.lit(" "))


def damaged(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage of the contract.

    By ``crc32('conv_id:turn') % 20``: 0 drops a row, 1 empties its text, 2 removes ``[.!?]``,
    3 repeats it, 4 sets role user. A null is one space, in the checksum too; ids and turns
    stay null.
    """
    rows = df.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        _spaced("role", "string").alias("role"),
        _spaced("text", "string").alias("text"),
    )
    kind = F.crc32(F.concat(_spaced("conv_id", "bigint"), F.lit(":"), _spaced("turn", "bigint"))) % 20
    rows = rows.withColumn("_kind", kind).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("_kind") == 3, 2).otherwise(1))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def _rows(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        _spaced("role", "string").alias("role"),
        _spaced("text", "string").alias("text"),
    )


ORDER = ("conv_id", "turn", "role", "digest")


def _codes(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, digest, code, again``: no texts.

    Rows that are alike in role and text are counted and their least turn is found by an
    aggregation with map-side parts; ``again`` says that the role and text were seen in an
    earlier turn. Equal rows of one turn become one row with their ``copies``.
    """
    last = F.regexp_extract("text", LAST, 1)
    light = rows.select(
        "conv_id", "turn", "role", F.sha2(F.col("text"), 256).alias("digest"),
        F.when(last == "", FAULTS["blank"]).when(last.isin(".", "!", "?"), 0).otherwise(FAULTS["truncated"]).alias("fault"),
    )
    light = materialize(light.groupBy(*ORDER, "fault").agg(F.count(F.lit(1)).alias("copies")))
    null_first = F.struct(F.col("turn").isNotNull(), "turn")
    seen = light.groupBy("conv_id", "role", "digest").agg(F.min(null_first).alias("first"), F.count(F.lit(1)).alias("turns"))
    seen = seen.where("turns > 1").select(F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), "first")
    match = F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    again = F.coalesce(F.col("first") < null_first, F.lit(False))
    return light.join(seen, match, "left").select(*ORDER, "fault", "copies", again.alias("again"))


AUDITS = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"
)
LEGAL = {"su", "ua", "au"}


def _records(out: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    columns = [pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*out, strict=True), fields, strict=True)]
    return pa.RecordBatch.from_arrays(columns, [n for n, _ in fields])


def _audit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for key, rows in runs(batches):
        tally, illegal, codes, before = [0, 0, 0, 0], 0, bytearray(), None
        least = most = None
        turns = 0
        for turn, role, _, fault, copies, again in rows:
            if turn is not None and turn != most:
                turns, least, most = turns + 1, turn if least is None else least, turn
            initial = role[:1]
            first = fault if fault == FAULTS["blank"] else FAULTS["duplicate"] if again else fault
            rest = first if first == FAULTS["blank"] else FAULTS["duplicate"]
            tally[first] += 1
            tally[rest] += copies - 1
            illegal += before is not None and before + initial not in LEGAL
            illegal += (copies - 1) * (initial + initial not in LEGAL)
            before = initial
            place = 4 * ("sua".index(initial) if initial and initial in "sua" else 3)
            codes.append(place + first)
            codes.extend(bytes([place + rest]) * (copies - 1))
        letters, cost = _solve(bytes(codes))
        gaps = most - least + 1 - turns if turns else 0
        out.append((key, gaps, tally[1], tally[2], tally[3], illegal, cost, letters))
        if len(out) >= 2048:
            yield _records(out, AUDITS)
            out = []
    if out:
        yield _records(out, AUDITS)


def audits(df: DataFrame) -> DataFrame:
    """Faults, cost and cheapest edits of every conversation of ``df(conv_id, turn, role, text)``.

    Rows come by turn, null turns first, ties by role and then by the text's checksum, so
    equal rows are adjacent; a null role or text is one space, rows with a null ``conv_id`` are one
    conversation. A role that is empty or begins with another letter can be renamed or
    deleted, not kept. Repeated rows are duplicates. Other columns are not looked at, and an
    empty table gives an empty result. A conversation is one sorted stream without texts; it
    leaves one byte a row and four letters a row in memory.
    """
    codes = _codes(_rows(df)).repartition("conv_id").sortWithinPartitions(*ORDER)
    return codes.select(*ORDER, "fault", "copies", "again").mapInArrow(_audit, AUDITS)


REPAIRED = "conv_id bigint, place bigint, role string, text string, edit string, source bigint"
_STREAM = ("conv_id", "kind", "turn", "role", "digest", "text", "audit")


def _with_audits(df: DataFrame, audited: DataFrame) -> DataFrame:
    """Rows of every conversation in order, behind a row with its edits."""
    rows = _rows(df).withColumn("digest", F.sha2(F.col("text"), 256))
    rows = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text", F.lit(None).cast("string").alias("audit"))
    nothing = [F.lit(None).cast(k).alias(n) for n, k in (("turn", "bigint"), ("role", "string"), ("digest", "string"), ("text", "string"))]
    both = rows.unionByName(audited.select("conv_id", F.lit(0).alias("kind"), *nothing, "audit"))
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").select(*_STREAM)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    for key, rows in runs(batches):
        *_, letters = next(rows)
        yield key, apply_edits(letters, ((role, text) for _, _, role, _, text, _ in rows))


def _write_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    chars = 0
    for key, rows in _edited(batches):
        for place, (role, text, letter, source) in enumerate(rows):
            out.append((key, place, role, text, letter, source))
            chars += len(text)
            if len(out) >= 4096 or chars > 1 << 22:
                yield _records(out, REPAIRED)
                out, chars = [], 0
    if out:
        yield _records(out, REPAIRED)


def repaired(df: DataFrame) -> DataFrame:
    """``conv_id, place, role, text, edit, source``: the repaired rows of every conversation.

    ``place`` counts from 0, ``edit`` is K, R or I, and ``source`` is the place of the row used
    in the order of :func:`audits` (null for inserted rows), whose docstring states the edge
    cases. A conversation that is best deleted has no rows.
    """
    return _with_audits(df, materialize(audits(df))).mapInArrow(_write_rows, REPAIRED)


DIGESTS = "conv_id bigint, repaired_sha256 string"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for key, rows in _edited(batches):
        total, gap = hashlib.sha256(), ""
        for role, text, _, _ in rows:
            total.update(f"{gap}{role}:{text}".encode())
            gap = "\n"
        out.append((key, total.hexdigest()))
        if len(out) >= 4096:
            yield _records(out, DIGESTS)
            out = []
    if out:
        yield _records(out, DIGESTS)


def repaired_digests(df: DataFrame) -> DataFrame:
    """One row per original conversation of ``df``, which is damaged and repaired: the columns
    of :func:`audits` and ``repaired_sha256``, the hash of its repaired ``role:text`` lines.

    A conversation that lost all rows has zeros, an empty audit and the hash of nothing.
    Hashing is sequential by nature; the rows of a conversation stream through one task.
    """
    broken = damaged(df)
    audited = materialize(audits(broken))
    hashes = _with_audits(broken, audited).mapInArrow(_digest, DIGESTS)
    found = audited.withColumn("repaired_sha256", F.lit(None).cast("string")).unionByName(hashes, allowMissingColumns=True)
    found = found.unionByName(df.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct(), allowMissingColumns=True)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in numbers],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"),
        F.coalesce(F.max("repaired_sha256"), F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
