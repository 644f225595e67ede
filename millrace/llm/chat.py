"""Chat formatting: a small template language, compiled to Python closures.

The language::

    {{ expr }}                         output
    {% for x in expr %} .. {% endfor %}
    {% if expr %} .. {% elif expr %} .. {% else %} .. {% endif %}
    {% set name = expr %}
    {% generation %} .. {% endgeneration %}   what stands inside is under the loss mask
    {# comment #}

Expressions: names, ``a.b``, strings, whole numbers, true/false/none, ``+ ~``,
``== != < > <= >= in``, ``and or not``, brackets, and filters ``x | name``. There are no
calls, no subscripts and no attribute access on Python objects (``a.b`` reads the keys of
mappings alone), so a template can reach only what it is given. ``-`` beside a tag trims
white space as usual.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class TemplateError(ValueError):
    """The template is not of the language, or asks for what it may not have."""


# ---------------------------------------------------------------- syntax tree


@dataclass(frozen=True)
class Lit:
    value: Any


@dataclass(frozen=True)
class Name:
    path: tuple[str, ...]


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Out:
    expr: Any


@dataclass(frozen=True)
class For:
    var: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class If:
    arms: tuple  # (condition, body) pairs; the last may have Lit(True)


@dataclass(frozen=True)
class Assign:
    var: str
    expr: Any


@dataclass(frozen=True)
class Gen:
    body: tuple


FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "string": lambda x: x if isinstance(x, str) else "" if x is None else str(x),
    "length": lambda x: len(x),
}

_TOKEN = re.compile(r"\s*(?:(?P<str>'(?:\\.|[^'\\])*'|\"(?:\\.|[^\"\\])*\")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>().|\[\]]))")
_STRING_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}
_LOOP = ("index", "index0", "first", "last")


class _Expr:
    """Recursive descent over one expression; folds constants as it builds."""

    def __init__(self, source: str, filters: dict):
        self.filters, self.at, self.toks = filters, 0, []
        pos, source = 0, source.rstrip()
        while pos < len(source):
            m = _TOKEN.match(source, pos)
            if not m:
                raise TemplateError(f"unexpected {source[pos:pos + 10]!r}")
            self.toks.append((m.lastgroup, m[m.lastgroup]))
            pos = m.end()

    def peek(self, *values: str) -> bool:
        return self.at < len(self.toks) and self.toks[self.at][0] in ("op", "name") and self.toks[self.at][1] in values

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.toks):
            raise TemplateError("expression ends too soon")
        self.at += 1
        return self.toks[self.at - 1]

    def whole(self):
        e = self.either()
        if self.at != len(self.toks):
            raise TemplateError(f"unexpected {self.toks[self.at][1]!r}")
        return e

    def chain(self, below, *names):
        e = below()
        while self.peek(*names):
            e = fold(Op(self.take()[1], (e, below())))
        return e

    def either(self):
        return self.chain(self.both, "or")

    def both(self):
        return self.chain(self.negated, "and")

    def negated(self):
        if self.peek("not"):
            self.take()
            return fold(Op("not", (self.negated(),)))
        e = self.added()
        while self.peek("==", "!=", "<", ">", "<=", ">=", "in", "not"):
            name = self.take()[1]
            if name == "not":
                if not self.peek("in"):
                    raise TemplateError("'not' must be followed by 'in' here")
                self.take()
                e = fold(Op("not", (fold(Op("in", (e, self.added()))),)))
            else:
                e = fold(Op(name, (e, self.added())))
        return e

    def added(self):
        return self.chain(self.filtered, "+", "~")

    def filtered(self):
        e = self.atom()
        while self.peek("|"):
            self.take()
            kind, name = self.take()
            if kind != "name" or name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            e = fold(Op("|" + name, (e,)), self.filters)
        return e

    def atom(self):
        kind, value = self.take()
        if kind == "str":
            return Lit(re.sub(r"\\(.)", lambda m: _STRING_ESCAPES.get(m[1], "\\" + m[1]), value[1:-1], flags=re.S))
        if kind == "num":
            return Lit(int(value))
        if value == "(":
            e = self.either()
            if self.take()[1] != ")":
                raise TemplateError("missing )")
            return e
        if kind != "name" or value in ("and", "or", "not", "in"):
            raise TemplateError(f"unexpected {value!r}")
        if value.lower() in ("true", "false", "none"):
            return Lit({"true": True, "false": False, "none": None}[value.lower()])
        path = [value]
        while self.peek(".", "["):
            if self.take()[1] == ".":
                kind, part = self.take()
                if kind != "name":
                    raise TemplateError("a name must follow the dot")
            else:  # m['role'] is m.role
                kind, part = self.take()
                if kind != "str" or not re.fullmatch(r"[A-Za-z_]\w*", part[1:-1]):
                    raise TemplateError("a quoted name must stand in brackets")
                part = part[1:-1]
                if self.take()[1] != "]":
                    raise TemplateError("missing ]")
            path.append(part)
        if any(p.startswith("_") for p in path):
            raise TemplateError("names may not begin with _")
        return Name(tuple(path))


def _text(x: Any) -> str:
    return x if isinstance(x, str) else "" if x is None else str(x)


_OPS: dict[str, Callable] = {
    "+": lambda a, b: a + b, "~": lambda a, b: _text(a) + _text(b), "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b,
    ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "not": lambda a: not a,
    "and": lambda a, b: a and b, "or": lambda a, b: a or b,
}


def fold(e: Op, filters: dict | None = None):
    """An operation on literals becomes the literal it gives."""
    fn = (filters or FILTERS).get(e.name[1:]) if e.name[0] == "|" else _OPS[e.name]
    if all(isinstance(a, Lit) for a in e.args):
        try:
            return Lit(fn(*[a.value for a in e.args]))
        except TypeError as x:
            raise TemplateError(str(x)) from x
    if e.name in ("and", "or") and isinstance(e.args[0], Lit):
        return e.args[1] if bool(e.args[0].value) == (e.name == "and") else e.args[0]
    return e


_TAG = re.compile(r"\{\{-?.*?-?\}\}|\{%-?.*?-?%\}|\{#.*?#\}", re.S)


def parse(source: str, filters: dict | None = None) -> tuple:
    """Template text to a syntax tree with constants folded and texts joined."""
    filters = FILTERS | (filters or {})
    parts: list[tuple[str, str]] = []
    pos, trim = 0, False
    for m in [*_TAG.finditer(source), None]:
        text = source[pos : m.start() if m else len(source)]
        text = text.lstrip() if trim else text
        trim = False
        if m:
            tag, pos = m[0], m.end()
            kind = tag[1]
            if kind != "#":
                inner = tag[2:-2]
                if inner.startswith("-"):
                    text, inner = text.rstrip(), inner[1:]
                if inner.endswith("-"):
                    trim, inner = True, inner[:-1]
                parts += [("text", text), (kind, inner.strip())]
            else:
                parts.append(("text", text))
        else:
            parts.append(("text", text))
    at = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal at
        out: list = []
        while at < len(parts):
            kind, s = parts[at]
            at += 1
            if kind == "text":
                _push(out, Text(s))
            elif kind == "{":
                e = _Expr(s, filters).whole()
                _push(out, Text(_text(e.value)) if isinstance(e, Lit) else Out(e))
            else:
                word, _, rest = s.partition(" ")
                rest = rest.strip()
                if word in ends:
                    return tuple(out), s
                if word == "for":
                    m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"bad for: {rest!r}")
                    body, _ = block("endfor")
                    out.append(For(m[1], _Expr(m[2], filters).whole(), body))
                elif word == "if":
                    arms, cond = [], _Expr(rest, filters).whole()
                    while True:
                        body, end = block("elif", "else", "endif")
                        arms.append((cond, body))
                        if end.startswith("elif"):
                            cond = _Expr(end[4:].strip(), filters).whole()
                        elif end == "else":
                            body, _ = block("endif")
                            arms.append((Lit(True), body))
                            break
                        else:
                            break
                    for x in _folded(arms):
                        _push(out, x)
                elif word == "set":
                    m = re.fullmatch(r"([A-Za-z]\w*)\s*=(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"bad set: {rest!r}")
                    out.append(Assign(m[1], _Expr(m[2], filters).whole()))
                elif word == "generation":
                    body, _ = block("endgeneration")
                    if any(isinstance(x, Gen) for x in _walk(body)):
                        raise TemplateError("generation blocks may not nest")
                    out.append(Gen(body))
                else:
                    raise TemplateError(f"unknown tag {word!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(out), ""

    return block()[0]


def _push(out: list, node) -> None:
    if isinstance(node, Text):
        if not node.value:
            return
        if out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].value + node.value)
            return
    out.append(node)


def _folded(arms: list) -> tuple:
    """Arms that can't be reached go; an if that is always the same is its body."""
    kept: list = []
    for cond, body in arms:
        if isinstance(cond, Lit):
            if cond.value:
                if not kept:
                    return body
                kept.append((Lit(True), body))
                break
        else:
            kept.append((cond, body))
    return (If(tuple(kept)),) if kept else ()


def _walk(body: tuple) -> Iterator:
    for x in body:
        yield x
        for inner in (x.body,) if isinstance(x, For | Gen) else [b for _, b in x.arms] if isinstance(x, If) else ():
            yield from _walk(inner)


# ---------------------------------------------------------------- closures


def _lookup(path: tuple[str, ...]) -> Callable[[dict], Any]:
    head, rest = path[0], path[1:]
    if not rest:
        return lambda env: env.get(head)

    def get(env):
        x = env.get(head)
        for k in rest:
            x = x.get(k) if isinstance(x, dict) else None
        return x

    return get


def _expr(e, filters: dict) -> Callable[[dict], Any]:
    if isinstance(e, Lit):
        return lambda env, v=e.value: v
    if isinstance(e, Name):
        return _lookup(e.path)
    args = [_expr(a, filters) for a in e.args]
    if e.name == "and":
        return lambda env: args[0](env) and args[1](env)
    if e.name == "or":
        return lambda env: args[0](env) or args[1](env)
    fn = filters[e.name[1:]] if e.name[0] == "|" else _OPS[e.name]
    if len(args) == 1:
        one = args[0]
        return lambda env: fn(one(env))
    left, right = args
    return lambda env: fn(left(env), right(env))


Emit = Callable[[str, bool], None]


def _body(nodes: tuple, filters: dict, masked: bool) -> Callable[[dict, Emit], None]:
    steps = [_node(n, filters, masked) for n in nodes]

    def run(env, emit):
        for s in steps:
            s(env, emit)

    return run


def _node(n, filters: dict, masked: bool) -> Callable[[dict, Emit], None]:
    if isinstance(n, Text):
        return lambda env, emit, v=n.value: emit(v, masked)
    if isinstance(n, Out):
        get = _expr(n.expr, filters)
        return lambda env, emit: emit(_text(get(env)), masked)
    if isinstance(n, Assign):
        get = _expr(n.expr, filters)
        return lambda env, emit: env.__setitem__(n.var, get(env))
    if isinstance(n, Gen):
        return _body(n.body, filters, True)
    if isinstance(n, If):
        arms = [(_expr(c, filters), _body(b, filters, masked)) for c, b in n.arms]

        def choose(env, emit):
            for cond, body in arms:
                if cond(env):
                    return body(env, emit)

        return choose
    over, body = _expr(n.over, filters), _body(n.body, filters, masked)

    def loop(env, emit):
        it = iter(over(env) or ())
        outer = env.get("loop"), env.get(n.var)
        none = object()
        item, i = next(it, none), 0
        while item is not none:
            ahead = next(it, none)
            env["loop"] = {"index": i + 1, "index0": i, "first": i == 0, "last": ahead is none}
            env[n.var] = item
            body(env, emit)
            item, i = ahead, i + 1
        env["loop"], env[n.var] = outer

    return loop


@dataclass
class Template:
    """``source`` compiled once; rendering walks no tree."""

    source: str
    filters: dict = field(default_factory=dict)

    def __post_init__(self):
        self.tree = parse(self.source, self.filters)
        self._run = _body(self.tree, FILTERS | self.filters, False)

    def render_to(self, emit: Emit, **env: Any) -> None:
        """Calls ``emit(piece, under the loss mask)`` in order. Iterables in ``env`` are read once, one item ahead."""
        self._run(env, emit)

    def render(self, **env: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text and the [start, end) spans under the loss mask, in code points."""
        parts: list[str] = []
        spans: list[tuple[int, int]] = []
        n = 0

        def emit(s: str, masked: bool) -> None:
            nonlocal n
            if masked and s:
                if spans and spans[-1][1] == n:
                    spans[-1] = (spans[-1][0], n + len(s))
                else:
                    spans.append((n, n + len(s)))
            parts.append(s)
            n += len(s)

        self.render_to(emit, **env)
        return "".join(parts), spans


# ---------------------------------------------------------------- the default format

#: The strings that mark turns.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_UNSAFE = re.compile(r"\\|\n|" + "|".join(re.escape(c) for c in CONTROL))
_UNSAFE_TEXT = re.compile(r"\\|" + "|".join(re.escape(c) for c in CONTROL))


def escape(text: str) -> str:
    r"""A backslash before every backslash and inside every control string, after its first character."""
    return _UNSAFE_TEXT.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def escape_role(role: str) -> str:
    """As ``escape``, and a newline gets a backslash too: the role's line ends at a bare one."""
    return _UNSAFE.sub(lambda m: "\\" + m[0] if m[0] in "\\\n" else m[0][0] + "\\" + m[0][1:], role)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


DEFAULT = (
    "{% for m in messages %}"
    "{% if m.role == 'assistant' %}<s>{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}[INST]{{ m.role | escape_role }}{{ '\\n' }}{{ m.text | escape }}[/INST]{% endif %}"
    "{% endfor %}"
)
SAFE = {"escape": escape, "escape_role": escape_role}
_TURN = re.compile(r"<s>((?:\\.|(?!</s>).)*)</s>|\[INST\]((?:\\.|[^\\\n])*)\n((?:\\.|(?!\[/INST\]).)*)\[/INST\]", re.S)


def read_back(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of the default format; anything else between turns is an error."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield ("assistant", unescape(m[1])) if m[1] is not None else (unescape(m[2]), unescape(m[3]))
        at = m.end()


# ---------------------------------------------------------------- on tables


class _Digest:
    """What the query returns of one conversation, read back turn by turn from its formatted pieces."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.chars, self.loss_chars = conv_id, 0, 0, 0
        self.all, self.loss, self.open, self.mask = hashlib.sha256(), hashlib.sha256(), [], []

    def emit(self, s: str, masked: bool) -> None:
        self.chars += len(s)
        self.open.append(s)
        if masked:
            self.mask.append(s)
        if not masked and s.endswith(("</s>", "[/INST]")):
            for role, text in read_back("".join(self.open)):
                self.turns += 1
                self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if self.mask:
                said = unescape("".join(self.mask))
                self.loss_chars += len(said)
                self.loss.update(said.encode("utf-8", "surrogatepass"))
            self.open, self.mask = [], []

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _conversations(batches: Iterable[pd.DataFrame]) -> Iterator[tuple[Any, Iterator[dict]]]:
    """(conv_id, its messages) from rows in conversation order; messages are read as they come."""
    rows = ((c, r, t) for b in batches for c, r, t in zip(b["conv_id"].astype("Int64"), b["role"], b["text"], strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        conv = None if ahead[0] is pd.NA else int(ahead[0])

        def own(conv=conv):
            nonlocal ahead
            while ahead is not None and (None if ahead[0] is pd.NA else int(ahead[0])) == conv:
                yield {"role": "" if ahead[1] is None else ahead[1], "text": "" if ahead[2] is None else ahead[2]}
                ahead = next(rows, None)

        messages = own()
        yield conv, messages
        for _ in messages:
            pass


def in_order(conversations: DataFrame) -> DataFrame:
    """Conversations whole and in turn order within partitions; ties by role, then text."""
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    return c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_conversations(conversations: DataFrame, template: str = DEFAULT) -> DataFrame:
    """(conv_id, formatted, loss_spans): each conversation's text and masked [start, end) spans in code points.

    Null text or role: empty. Null conv_id: one conversation. Turns with equal numbers
    follow by role and text; repeated rows are turns. Extra columns are not read.
    """

    def run(batches):
        t = Template(template, SAFE)
        for conv, messages in _conversations(batches):
            text, spans = t.render(messages=messages)
            yield pd.DataFrame({"conv_id": pd.array([conv], dtype="Int64"), "formatted": [text], "loss_spans": [[{"start": a, "end": b} for a, b in spans]]})

    return in_order(conversations).mapInPandas(run, "conv_id long, formatted string, loss_spans array<struct<start: int, end: int>>")


#: The planted conversation whose texts are control strings.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def op10_chat(conversations: DataFrame) -> DataFrame:
    """The query: every conversation and the probe, formatted, then read back from the output.

    Rows stream in conversation order: pieces are parsed and hashed turn by turn, so even
    a conversation with a third of all rows holds one turn in memory.

    Null text or role: empty. Null conv_id: one conversation, with a null id. Turns with equal
    numbers (or null ones, which come first) follow by role and text; repeated rows are turns.
    An empty table gives the probe alone. Extra columns are not read.
    """
    spark = conversations.sparkSession
    probe = spark.createDataFrame([(PROBE_ID, 0, "user", PROBE_TEXT), (PROBE_ID, 1, "assistant", PROBE_TEXT)], "conv_id long, turn long, role string, text string")
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))

    def run(batches):
        t = Template(DEFAULT, SAFE)
        out = []
        for conv, messages in _conversations(batches):
            d = _Digest(conv)
            t.render_to(d.emit, messages=messages)
            out.append(d.row())
            if len(out) == 2000:
                yield _digests(out)
                out = []
        yield _digests(out)

    return in_order(c.union(probe)).mapInPandas(run, DIGEST)


def _digests(rows: list[tuple]) -> pd.DataFrame:
    names = [x.split()[0] for x in DIGEST.split(", ")]
    df = pd.DataFrame(rows, columns=names)
    return df.astype({"conv_id": "Int64", "n_turns": "int64", "loss_chars": "int64", "formatted_chars": "int64"})
