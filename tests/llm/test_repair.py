"""Auctioned repairs against a dynamic program over (cost, letters), and the contract against plain Python."""

import hashlib
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestor.llm import repair


def cheapest(rows):
    """``rows`` of ``initial, fault``: least cost and letters, by relaxing all lattice nodes."""
    step = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
    after, size = [2, 2, 3, 2], len(rows)
    best = [{} for _ in range(size + 1)]
    best[size] = {0: (0, ""), 3: (0, "")}
    for i in range(size, -1, -1):
        layer = best[i]
        if i < size:
            initial, fault = rows[i]
            extra = 5 * (fault == "truncated")
            for q in range(4):
                moves = [("D", 2, q)]
                if fault not in ("blank", "duplicate"):
                    moves += [("K", extra, step[q][initial])] if initial in step[q] else []
                    moves += [("R", 1 + extra, after[q])]
                found = [(best[i + 1][t][0] + c, e + best[i + 1][t][1]) for e, c, t in moves if t in best[i + 1]]
                if found:
                    layer[q] = min(found)
        for _ in range(4):
            for q in range(4):
                if after[q] in layer:
                    cost, letters = layer[after[q]]
                    layer[q] = min(layer.get(q, (1 << 60, "")), (cost + 5, "I" + letters))
    return best[0][0]


def encode(rows):
    return bytes(4 * "sua".find(i) + repair.FAULTS[f] if i in ("s", "u", "a") else 12 + repair.FAULTS[f] for i, f in rows)


ROWS = st.lists(st.tuples(st.sampled_from("suat"), st.sampled_from(["", "", "", "blank", "duplicate", "truncated"])), max_size=70)


@settings(max_examples=250, deadline=None)
@given(ROWS)
def test_auction_is_cheapest_and_least(rows):
    cost, letters = cheapest(rows)
    assert repair.cheapest_edits(encode(rows)) == (letters, cost)


@pytest.mark.parametrize("section", [1, 2, 5, 1000])
def test_sections_do_not_matter(monkeypatch, section):
    import random

    monkeypatch.setattr(repair, "SECTION", section)
    rng = random.Random(section)
    for size in (0, 1, 2, 7, 40):
        rows = [(rng.choice("suuaat"), rng.choice(["", "", "blank", "truncated", "duplicate"])) for _ in range(size)]
        cost, letters = cheapest(rows)
        assert repair.cheapest_edits(encode(rows)) == (letters, cost)


def test_long_conversation_is_linear():
    rows = [("u" if i % 3 else "a", "truncated" if i % 7 == 0 else "") for i in range(20_000)]
    cost, letters = cheapest(rows[:2000])
    assert repair.cheapest_edits(encode(rows[:2000])) == (letters, cost)
    letters, cost = repair.cheapest_edits(encode(rows))
    assert len(letters) >= 20_000 and cost > 0


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(conv, turn, role, text)] * (2 if kind == 3 else 1)
    return out


def brute(rows, broken):
    found = {}
    for conv in {r[0] for r in rows}:
        mine = [r[1:] for r in broken if r[0] == conv]
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in mine:
            visible = re.sub("[\\x20\\x09-\\x0D]", "", text)
            fault = "blank" if not visible else "duplicate" if (role, text) in seen else "" if visible[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
        turns = [t for t, _, _ in mine if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:], strict=False))
        cost, letters = cheapest([(r[1][:1] or "-", f) for r, f in zip(mine, faults, strict=True)])
        lines, state, at = [], 0, 0
        for e in letters:
            row = mine[at] if e != "I" else None
            at += e != "I"
            if e == "D":
                continue
            role = "assistant" if state == 2 else "user"
            role, text = (row[1], row[2]) if e == "K" else (role, row[2] if row else "")
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            lines.append(f"{role}:{text}")
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        found[conv] = (gaps, *counts, illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return found


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return df.select("*", *[F.lit(7).alias(c) for c in ("kind", "digest", "audit", "fault", "copies", "_copy", "_kind")]).repartition(4)


def check(spark, rows):
    got = {r.conv_id: tuple(r[f] for f in FIELDS) for r in repair.repaired_digests(frame(spark, rows)).collect()}
    assert got == brute(rows, damage(rows))


def test_given_table(spark, sf):
    check(spark, [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])


def test_edges(spark):
    rows = [(None, None, None, None), (None, 3, "user", "a."), (5, 2, "", "x."), (5, 2, "", "x."), (5, 9, "user", "long " * 50_000 + "!")]
    rows += [(6, t, "assistant", "\t\n") for t in range(30)] + [(7, t, "sys", "end. \x0b") for t in (None, 1, 1, 4)]
    rows += [(8, 2**40 * (t % 2), "tool", "é ?\n") for t in range(6)]
    rows += [(100 + i, i, "user", "q") for i in range(60)]  # some lose their only row
    rows += [(9, t, ("user", "assistant")[t % 2], f"word {t // 9}.") for t in range(900)]  # one long, many repeats
    check(spark, rows)
    assert repair.repaired_digests(frame(spark, rows).limit(0)).count() == 0


def test_repaired_rows(spark):
    rows = [(1, 0, "assistant", "a."), (1, 1, "user", "b?"), (1, 2, "user", "b?"), (2, 0, "user", " ")]
    got = [tuple(r) for r in repair.repaired(frame(spark, rows)).orderBy("conv_id", "place").collect()]
    assert got == [(1, 0, "user", "a.", "R", 0), (1, 1, "assistant", "b?", "R", 1)]
    audits = {r.conv_id: (r.audit, r.cost) for r in repair.audits(frame(spark, rows)).collect()}
    assert audits == {1: ("RRD", 4), 2: ("D", 2)}
