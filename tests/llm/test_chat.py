"""Templates, exact round trips of formatted conversations, and the loss mask."""

import hashlib
import pickle

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from attestor.llm import chat
from attestor.llm.chat import CONTROLS, PLANTED, Template, TemplateError, TurnReader, chat_template, unescape

BITS = [*CONTROLS, "\\", "<", "[", "s>", "/INST]", "<<", "SYS>>", " ", "\n", "x", "é", "漢"]
TEXT = st.lists(st.sampled_from(BITS), max_size=8).map("".join)


def run(source, controls=(), constants=None, **variables):
    messages = variables.pop("messages", [])
    return "".join(t for t, _ in Template(source, controls, constants or {}).render(messages, **variables))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXT), TEXT), max_size=5), st.integers(1, 7))
def test_any_text_is_read_back(turns, step):
    pieces = list(chat_template().render([{"role": r, "text": t} for r, t in turns]))
    text = "".join(t for t, _ in pieces)
    reader, got = TurnReader(), []
    for at in range(0, len(text), step):
        got += reader.feed(text[at : at + step])
    assert got == turns and reader.rest == ""
    assert "".join(unescape(t) for t, marked in pieces if marked) == "".join(t for r, t in turns if r == "assistant")


@given(TEXT)
def test_escape_hides_control_strings(text):
    hidden = chat_template().escape(text)
    assert unescape(hidden) == text and not any(c in hidden for c in CONTROLS)


def test_language():
    rows = [{"role": "a", "n": 1}, {"role": "b", "n": 2}, {"role": "c"}]
    assert run("{% for m in messages %}{{ m.role }}{{ m.n }}{% if not loop.last %}, {% endif %}{% endfor %}", messages=rows) == "a1, b2, c"
    assert run("{% for m in messages %}{{ loop.index }}{{ 'F' if loop.first else '' }}{% endfor %}", messages=iter(rows)) == "1F23"
    assert run("{% set x = 'a' + 1 ~ none %}{{ x | upper }}") == "A1"
    assert run("{% if x == 1 %}one{% elif x == 2 or y %}two{% else %}many{% endif %}", x=3, y="") == "many"
    assert run("a {{- ' b ' | trim -}} c{# no #}!") == "abc!"
    assert run("{{ 'x' in 'xyz' and 'q' not in 'xyz' }}") == "True"
    assert run("{{ missing.field }}{{ text.upper }}", text="t") == ""
    assert run("{{ 'a\\n\\'' }}") == "a\n'"
    assert run("") == "" and run("{% for m in messages %}x{% endfor %}") == ""


def test_constants_are_folded():
    t = Template("{{ b + '[' }}{% if b == 'q' %}no{{ x }}{% else %}yes{% endif %}{{ 'A' | lower }}", (), {"b": "B"})
    assert t.tree == [("text", "B[yesa")]
    assert "".join(p for p, _ in pickle.loads(pickle.dumps(t)).render([])) == "B[yesa"
    assert len(chat_template().tree) == 1


@pytest.mark.parametrize("source", [
    "{{ x.__class__ }}", "{{ x._y }}", "{{ f() }}", "{{ x[0] }}", "{{ x | eval }}", "{% import os %}", "{% for x in y %}", "{% endfor %}",
    "{% if x %}a{% endfor %}", "{{ 1 + }}", "{{ 'open }}", "{% for loop in y %}{% endfor %}", "{% set b = 1 %}", "{{ (x }}", "{% else %}",
])
def test_bad_templates_are_refused(source):
    with pytest.raises(TemplateError):
        Template(source, (), {"b": "B"})
    with pytest.raises(TemplateError):
        run("{% for c in x %}{% endfor %}", x="text is no list")


def brute(rows):
    """``turns, loss`` per conversation of ``conv_id, turn, role, text`` rows."""
    found = {}
    rows = [(c, t, r or "", x or "") for c, t, r, x in rows]
    for c, _, r, x in sorted(rows, key=lambda q: (q[0] is not None, q[0] or 0, q[1] is not None, q[1] or 0, q[2].encode(), q[3].encode())):
        turns, loss, count = found.get(c, ("", "", 0))
        found[c] = turns + f"{r}\n{x}\n", loss + (x if r == "assistant" else ""), count + 1
    return found


def check(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    df = df.select("*", *[F.lit(7).alias(c) for c in ("part", "starts", "ends", "n_turns")]).repartition(5)
    want = brute([*rows, (-1, 0, "user", PLANTED), (-1, 1, "assistant", PLANTED)])
    got = {r.conv_id: r for r in chat.digests(chat.with_planted(df)).collect()}
    assert set(got) == set(want)
    for key, (turns, loss, count) in want.items():
        r = got[key]
        assert (r.n_turns, r.turns_sha256) == (count, hashlib.sha256(turns.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert r.formatted_chars >= len(loss)
    return df


def test_conversations(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, None, "system", "first"), (1, 1, "assistant", None), (2, 5, None, ""),
        (None, 0, "user", "no id"), (None, 1, "assistant", "x" * 300_000), (3, 0, "assistant", "</s>" * 40_000), (3, 1, "to\\ol<</SYS>>", "\\"),
    ]
    rows += [(4, i, ("user", "assistant")[i % 2], f"turn {i} " * 50) for i in range(700)]  # several parts
    df = check(spark, rows)
    parts = chat.formatted(df).where("conv_id = 4").orderBy("part").collect()
    assert len(parts) > 1 and [p.part for p in parts] == list(range(len(parts)))
    loss = "".join(unescape(p.text[s:e]) for p in parts for s, e in zip(p.starts, p.ends, strict=True))
    assert loss == "".join(f"turn {i} " * 50 for i in range(1, 700, 2))
    assert chat.digests(df.limit(0)).count() == 0


def test_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    check(spark, rows)
