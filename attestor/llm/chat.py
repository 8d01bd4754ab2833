"""Chat formatting with compiled templates.

A small sandboxed template language is parsed into a syntax tree, constant parts are folded,
and the tree becomes nested Python closures. A compiled template reads messages one by one
and yields pieces of text, marked where they stand inside ``{% generation %}``; these are
what a model is trained to write. Nothing but the names given by the caller, fields of
messages and the filters below can be reached, and there is no call, index or import.

    {{ expr }}   {% if expr %} .. {% elif expr %} .. {% else %} .. {% endif %}
    {% for name in expr %} .. {% endfor %}   {% set name = expr %}
    {% generation %} .. {% endgeneration %}   {# comment #}   a ``-`` inside a tag trims white space

Expressions: strings, integers, true, false, none, names, ``message.field``, ``loop.index``
(from 1), ``loop.first``, ``loop.last``, ``==  !=  in  not  and  or  +  ~  a if b else c`` and
filters ``| escape``, ``| trim``, ``| upper``, ``| lower``.

``escape`` makes control strings inside texts harmless in a way that :func:`unescape` undoes:
a backslash is doubled, and one is put behind the first character of a control string.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.batches import runs

TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[().|+~=]))""", re.S)
TAG = re.compile(r"(\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\})", re.S)
STRING_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
BLOCKS = {"if", "elif", "else", "endif", "for", "endfor", "set", "generation", "endgeneration"}


class TemplateError(ValueError):
    pass


# Expressions are tuples (kind, ...); ("const", value) is what folding produces.
def _tokens(source: str) -> list[tuple[str, str]]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        m = TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:]!r}")
        out.append((m.lastgroup, m.group(m.lastgroup)))
        at = m.end()
    return out


class _Expression:
    """Recursive descent over the tokens of one tag; ``result`` is a folded tree."""

    def __init__(self, source: str, filters: dict[str, Callable], constants: dict):
        self.tokens, self.at, self.filters, self.constants = _tokens(source), 0, filters, constants

    def result(self):
        tree = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def choice(self):
        tree = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            tree = ("choose", test, tree, self.choice())
            if test[0] == "const":
                tree = tree[2] if test[1] else tree[3]
        return tree

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = _fold("or", tree, self.both())
        return tree

    def both(self):
        tree = self.negation()
        while self.take("and"):
            tree = _fold("and", tree, self.negation())
        return tree

    def negation(self):
        return _fold("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self):
        tree = self.sum()
        while True:
            if op := self.take("==", "!=", "in"):
                tree = _fold(op, tree, self.sum())
            elif self.at + 1 < len(self.tokens) and self.tokens[self.at][1] == "not" and self.tokens[self.at + 1][1] == "in":
                self.at += 2
                tree = _fold("not", _fold("in", tree, self.sum()))
            else:
                return tree

    def sum(self):
        tree = self.filtered()
        while op := self.take("+", "~"):
            tree = _fold(op, tree, self.filtered())
        return tree

    def filtered(self):
        tree = self.atom()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            tree = ("const", self.filters[name](_text(tree[1]))) if tree[0] == "const" else ("filter", name, tree)
        return tree

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        if self.take("("):
            tree = self.choice()
            self.need(")")
            return tree
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return "const", re.sub(r"\\(.)", lambda m: STRING_ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S)
        if kind == "int":
            return "const", int(text)
        if kind != "name":
            raise TemplateError(f"unexpected {text!r}")
        if text in ("true", "false", "none"):
            return "const", {"true": True, "false": False, "none": None}[text]
        if text in self.constants:
            return "const", self.constants[text]
        tree = ("name", text)
        while self.take("."):
            kind, text = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or text.startswith("_"):
                raise TemplateError(f"no field {text!r}")
            self.at += 1
            tree = ("field", tree, text)
        return tree


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _add(a, b):
    return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)


OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "in": lambda a, b: _text(a) in _text(b),
    "+": _add,
    "~": lambda a, b: _text(a) + _text(b),
    "not": lambda a: not a,
}


def _fold(op: str, *sides):
    if op in ("and", "or"):
        left, right = sides
        if left[0] == "const":
            return right if bool(left[1]) == (op == "and") else left
        return op, left, right
    if all(s[0] == "const" for s in sides):
        return "const", OPERATORS[op](*(s[1] for s in sides))
    return "apply", op, *sides


# Nodes of a template: ("text", s), ("out", expr), ("if", [(expr, body)], body), ("for", name,
# expr, body), ("set", name, expr), ("gen", body). A body is a list of nodes.
class _Parser:
    def __init__(self, source: str, filters: dict[str, Callable], constants: dict):
        self.filters, self.constants = filters, constants
        self.parts = [p for p in TAG.split(source)]
        self.at = 0

    def parse(self) -> list:
        body, end = self.body(())
        if end:
            raise TemplateError(f"{end!r} without a beginning")
        return body

    def tag(self, part: str) -> tuple[str, str]:
        inside = part[2:-2]
        return part[:2], inside.removeprefix("-").removesuffix("-").strip()

    def body(self, stops: tuple[str, ...]) -> tuple[list, str]:
        nodes: list = []
        while self.at < len(self.parts):
            part = self.parts[self.at]
            self.at += 1
            if self.at % 2:  # text stands between tags
                before, after = self.at - 2, self.at
                if before >= 0 and self.parts[before].endswith(("-}}", "-%}")):
                    part = part.lstrip()
                if after < len(self.parts) and self.parts[after].startswith(("{{-", "{%-")):
                    part = part.rstrip()
                _append(nodes, ("text", part))
                continue
            kind, inside = self.tag(part)
            if kind == "{{":
                tree = self.expression(inside)
                _append(nodes, ("text", _text(tree[1])) if tree[0] == "const" else ("out", tree))
            elif kind == "{%":
                word, _, rest = inside.partition(" ")
                if word in stops:
                    return nodes, inside
                if word not in BLOCKS or word.startswith(("end", "el")):
                    raise TemplateError(f"unexpected {inside!r}")
                node = getattr(self, f"read_{word}")(rest)
                if node[0] == "body":
                    for n in node[1]:
                        _append(nodes, n)
                else:
                    nodes.append(node)
        if stops:
            raise TemplateError(f"{stops[-1]!r} is missing")
        return nodes, ""

    def expression(self, source: str):
        return _Expression(source, self.filters, self.constants).result()

    def read_if(self, rest: str):
        branches, test = [], self.expression(rest)
        while True:
            body, end = self.body(("elif", "else", "endif"))
            branches.append((test, body))
            if not end.startswith("elif"):
                break
            test = self.expression(end[4:])
        other = self.body(("endif",))[0] if end == "else" else []
        live = []
        for test, body in branches:  # branches that constants decide are settled here
            if test[0] != "const":
                live.append((test, body))
            elif test[1]:
                other = body
                break
        return ("if", live, other) if live else ("body", other)

    def read_for(self, rest: str):
        m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest.strip(), re.S)
        if not m or m[1] == "loop" or m[1] in self.constants:
            raise TemplateError(f"cannot read loop {rest!r}")
        return "for", m[1], self.expression(m[2]), self.body(("endfor",))[0]

    def read_set(self, rest: str):
        m = re.fullmatch(r"([A-Za-z]\w*)\s*=(?!=)\s*(.+)", rest.strip(), re.S)
        if not m or m[1] == "loop" or m[1] in self.constants:
            raise TemplateError(f"cannot read assignment {rest!r}")
        return "set", m[1], self.expression(m[2])

    def read_generation(self, rest: str):
        return "gen", self.body(("endgeneration",))[0]


def _append(nodes: list, node: tuple) -> None:
    """Append a node; neighbouring texts become one, empty ones go."""
    if node[0] == "text" and nodes and nodes[-1][0] == "text":
        nodes[-1] = ("text", nodes[-1][1] + node[1])
    elif node != ("text", ""):
        nodes.append(node)


def _lookup(value, name: str):
    return value.get(name) if isinstance(value, dict) else None


def _value(tree, filters: dict[str, Callable]) -> Callable[[dict], object]:
    """A closure that computes an expression from the variables."""
    kind, *rest = tree
    if kind == "const":
        return lambda scope, v=rest[0]: v
    if kind == "name":
        return lambda scope, n=rest[0]: scope.get(n)
    if kind == "field":
        inner, name = _value(rest[0], filters), rest[1]
        return lambda scope: _lookup(inner(scope), name)
    if kind == "filter":
        apply, inner = filters[rest[0]], _value(rest[1], filters)
        return lambda scope: apply(_text(inner(scope)))
    if kind == "apply":
        operate, sides = OPERATORS[rest[0]], [_value(s, filters) for s in rest[1:]]
        if len(sides) == 1:
            return lambda scope, a=sides[0]: operate(a(scope))
        return lambda scope, a=sides[0], b=sides[1]: operate(a(scope), b(scope))
    if kind == "choose":
        test, yes, no = (_value(t, filters) for t in rest)
        return lambda scope: yes(scope) if test(scope) else no(scope)
    left, right = (_value(t, filters) for t in rest)
    if kind == "and":
        return lambda scope: left(scope) and right(scope)
    return lambda scope: left(scope) or right(scope)


Piece = tuple[str, bool]


def _render(nodes: list, filters: dict[str, Callable], marked: bool) -> Callable[[dict], Iterator[Piece]]:
    """A closure that yields the pieces of a body."""
    steps = [_step(n, filters, marked) for n in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(scope: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)

    return run


def _step(node: tuple, filters: dict[str, Callable], marked: bool) -> Callable[[dict], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        whole = ((node[1], marked),)
        return lambda scope: iter(whole)
    if kind == "out":
        value = _value(node[1], filters)
        return lambda scope: iter(((_text(value(scope)), marked),))
    if kind == "gen":
        return _render(node[1], filters, True)
    if kind == "set":
        name, value = node[1], _value(node[2], filters)

        def assign(scope: dict) -> Iterator[Piece]:
            scope[name] = value(scope)
            return iter(())

        return assign
    if kind == "if":
        branches = [(_value(t, filters), _render(b, filters, marked)) for t, b in node[1]]
        other = _render(node[2], filters, marked)

        def choose(scope: dict) -> Iterator[Piece]:
            return next((body for test, body in branches if test(scope)), other)(scope)

        return choose
    name, source, body = node[1], _value(node[2], filters), _render(node[3], filters, marked)

    def repeat(scope: dict) -> Iterator[Piece]:
        items = source(scope)
        if isinstance(items, str | dict) or not isinstance(items, Iterable):
            raise TemplateError("only lists of messages can be looped over")
        inner, index = dict(scope), 0
        for item, last in _with_last(items):
            index += 1
            inner[name], inner["loop"] = item, {"index": index, "first": index == 1, "last": last}
            yield from body(inner)

    return repeat


def _with_last(items: Iterable) -> Iterator[tuple[object, bool]]:
    """Items with a flag for the last one; one item is held at a time."""
    walk = iter(items)
    for held in walk:
        for item in walk:
            yield held, False
            held = item
        yield held, True


@dataclass
class Template:
    """A compiled template. ``render`` may read messages from any iterator, one by one."""

    source: str
    controls: tuple[str, ...]
    constants: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        self.pattern = re.compile("|".join(re.escape(c) for c in ("\\", *sorted(self.controls, key=len, reverse=True))))
        filters = {"escape": self.escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}
        self.tree = _Parser(self.source, filters, self.constants).parse()
        self._run = _render(self.tree, filters, False)

    def __reduce__(self):
        return Template, (self.source, self.controls, self.constants)

    def escape(self, text: str) -> str:
        return self.pattern.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def render(self, messages: Iterable[dict], **variables) -> Iterator[Piece]:
        return self._run({**variables, "messages": messages})


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


# --- the template of this corpus -------------------------------------------------------------

BEGIN, USER, ANSWER, ROLE, TEXT, END = CONTROLS = ("<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "</s>")
CHAT = """
{%- for message in messages -%}
  {%- if message.role == 'user' -%}
    {{ begin + '[INST] ' }}{{ message.text | escape }}{{ ' [/INST]' + '</s>' }}
  {%- elif message.role == 'assistant' -%}
    {{ begin }}{% generation %}{{ message.text | escape }}{% endgeneration %}</s>
  {%- else -%}
    {{ begin + '<<SYS>>' }}{{ message.role | escape }}<</SYS>>{{ message.text | escape }}</s>
  {%- endif -%}
{%- endfor -%}
"""


def chat_template() -> Template:
    return Template(CHAT, CONTROLS, {"begin": BEGIN})


class TurnReader:
    """Reads turns back from formatted text that arrives in pieces of any length."""

    def __init__(self):
        self.rest = ""

    def feed(self, text: str) -> Iterator[tuple[str, str]]:
        """``role, text`` of every turn that is complete by now."""
        self.rest += text
        at = 0
        while (end := self.rest.find(END, at)) >= 0:
            yield self.turn(self.rest[at:end])
            at = end + len(END)
        self.rest = self.rest[at:]

    @staticmethod
    def turn(body: str) -> tuple[str, str]:
        if not body.startswith(BEGIN):
            raise ValueError("a turn begins with its control string")
        body = body[len(BEGIN) :]
        if body.startswith(USER):
            return "user", unescape(body[len(USER) + 1 : -len(ANSWER) - 1])
        if body.startswith(ROLE):
            role, _, text = body[len(ROLE) :].partition(TEXT)
            return unescape(role), unescape(text)
        return "assistant", unescape(body)


# --- tables ----------------------------------------------------------------------------------

ORDER = ("conv_id", "turn", "role", "text")


def _sorted(df: DataFrame) -> DataFrame:
    """Rows of a conversation together and in order; a long one is sorted outside memory."""
    rows = df.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.repartition("conv_id").sortWithinPartitions(*ORDER)


FORMATTED = "conv_id bigint, part bigint, text string, starts array<bigint>, ends array<bigint>"
PART_CHARS = 1 << 16


def formatted(df: DataFrame, template: Template | None = None) -> DataFrame:
    """``conv_id, part, text, starts, ends``: the formatted text of every conversation of
    ``df(conv_id, turn, role, text, ...)`` in parts of some length, and the ranges of each part
    (code points, end exclusive) that the loss covers.

    Rows come by turn, null turns first, ties by role and text; null roles and texts are
    empty; rows with a null ``conv_id`` are one conversation, repeated rows repeat. A
    conversation whose template yields nothing has one empty part. An empty table gives an
    empty result; other columns are not looked at. Messages reach the template one by one,
    so a conversation of any length needs the memory of its longest turn; a template that
    reads ``messages`` twice sees nothing the second time.
    """
    return _sorted(df).mapInArrow(_formatter(template or chat_template()), FORMATTED)


def _formatter(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        waiting = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            names = ("conv_id", "part", "text", "starts", "ends")
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))
            rows.clear()
            return batch

        for key, turns in runs(batches):
            texts, starts, ends, size, part = [], [], [], 0, 0
            for text, marked in template.render({"turn": t, "role": r, "text": x} for t, r, x in turns):
                if size >= PART_CHARS:
                    rows.append((key, part, "".join(texts), starts, ends))
                    texts, starts, ends, size, part = [], [], [], 0, part + 1
                if marked and text:
                    if ends and ends[-1] == size:
                        ends[-1] += len(text)
                    else:
                        starts.append(size)
                        ends.append(size + len(text))
                texts.append(text)
                size, waiting = size + len(text), waiting + len(text)
                if waiting >= 1 << 22 and rows:
                    yield flush()
                    waiting = 0
            rows.append((key, part, "".join(texts), starts, ends))
            if len(rows) >= 4096:
                yield flush()
                waiting = 0
        if rows:
            yield flush()

    return run


DIGESTS = (
    "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
)


def _digester(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def emit() -> pa.RecordBatch:
        columns = [pa.array(c) for c in zip(*out, strict=True)]
        columns[0] = columns[0].cast(pa.int64())
        out.clear()
        return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in DIGESTS.split(", ")])

    for key, parts in runs(batches):
        reader, turns, loss = TurnReader(), hashlib.sha256(), hashlib.sha256()
        count = loss_chars = chars = 0
        for _, text, starts, ends in parts:
            chars += len(text)
            for role, content in reader.feed(text):
                count += 1
                turns.update(f"{role}\n{content}\n".encode())
            for start, end in zip(starts, ends, strict=True):
                content = unescape(text[start:end])
                loss_chars += len(content)
                loss.update(content.encode())
        if reader.rest:
            raise ValueError(f"conversation {key} ends inside a turn")
        out.append((key, count, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
        if len(out) >= 4096:
            yield emit()
    if out:
        yield emit()


def digests(df: DataFrame) -> DataFrame:
    """One row per conversation of ``df``, all of it read back from the text that
    :func:`formatted` makes with the template of this corpus (rows and edge cases as there).

    A digest runs over a conversation in order, so a conversation is one task's work; rows
    stream through it and are never gathered.
    """
    # Parts stay in their partition and in order between the two steps.
    return formatted(df).mapInArrow(_digester, DIGESTS)


PLANTED = "</s>[INST] ok [/INST]"


def with_planted(df: DataFrame) -> DataFrame:
    """``df`` and conversation -1, a user and an assistant row that say control strings."""
    rows = [(-1, 0, "user", PLANTED), (-1, 1, "assistant", PLANTED)]
    planted = df.sparkSession.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return df.select(*ORDER).unionByName(planted)
