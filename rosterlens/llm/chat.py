r"""Chat formatting: a small template language compiled to Python closures.

A template is parsed into a syntax tree, constant expressions and adjacent
texts are folded, and the rest becomes closures that render a conversation.
``generation`` blocks leave markers: the spans of the output a model is trained
on.

The language is a sandbox.  Names are ``messages``, loop variables and values
given by ``set``; ``x.key`` and ``x['key']`` read keys of mappings only; there
are no calls, imports or attributes of Python objects, and loops run over the
messages alone.

    {{ expression }}
    {% for m in messages %} ... {% endfor %}      with loop.index0, loop.index, loop.first, loop.last
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = e %}
    {% generation %} ... {% endgeneration %}
    expressions: 'text' 12 true false none  name  a.b a['b']  not and or  == != in  + ~  (e)  e | filter
    filters: escape escape_role trim upper lower length

``escape`` replaces every backslash, ``#`` and ``<`` by ``\\``, ``\h`` and
``\l``.  Control strings all hold a ``#`` or a ``<``, so none can occur in an
escaped text, and the replacement can be undone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields, is_dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEMPLATE = (
    "{% for m in messages %}"
    "### {{ m.role | escape_role }}: "
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n"
    "{% endfor %}"
)
TRAINED_ROLE = "assistant"
# What the template above writes, for reading it back: role and text hold neither '#' nor '<', the role no ':'.
_TURN = re.compile(r"### ([^#<:]*): ([^#<]*)</turn>\n")
_ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c"}
_UNESCAPES = {v: k for k, v in _ESCAPES.items()}


def escape(text: str) -> str:
    return re.sub(r"[\\#<]", lambda m: _ESCAPES[m[0]], text)


def escape_role(text: str) -> str:
    return re.sub(r"[\\#<:]", lambda m: _ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return re.sub(r"\\[\\hlc]", lambda m: _UNESCAPES[m[0]], text)


FILTERS: dict[str, Callable] = {
    "escape": lambda v: escape(_text(v)), "escape_role": lambda v: escape_role(_text(v)), "trim": lambda v: _text(v).strip(),
    "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "length": len,
}


def _text(value) -> str:
    return "" if value is None else "true" if value is True else "false" if value is False else str(value)


class TemplateError(ValueError):
    """A template that the language does not allow."""


# --- syntax tree ------------------------------------------------------------------

@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Apply:
    """An operator or filter over expressions."""
    op: str
    args: tuple


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, body) pairs; the last condition may be a true constant


@dataclass(frozen=True)
class Assign:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


_CHUNK = re.compile(r"\{\{(?P<out>.*?)\}\}|\{%-?\s*(?P<tag>.*?)\s*-?%\}", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)"""
                    r"""|(?P<sign>==|!=|[()\[\].|+~]))""")
_WORDS = {"true": True, "false": False, "none": None}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str):
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if m is None:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def whole(self):
        tree = self._either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return tree

    def _take(self, *wanted: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def _chain(self, below: Callable, *signs: str):
        tree = below()
        while sign := self._take(*signs):
            tree = Apply(sign, (tree, below()))
        return tree

    def _either(self):
        return self._chain(self._both, "or")

    def _both(self):
        return self._chain(self._negated, "and")

    def _negated(self):
        return Apply("not", (self._negated(),)) if self._take("not") else self._chain(self._sum, "==", "!=", "in")

    def _sum(self):
        return self._chain(self._filtered, "+", "~")

    def _filtered(self):
        tree = self._keyed()
        while self._take("|"):
            name = self._next("name")
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            tree = Apply(f"|{name}", (tree,))
        return tree

    def _keyed(self):
        tree = self._atom()
        while sign := self._take(".", "["):
            key = Const(self._next("name")) if sign == "." else self._either()
            if sign == "[" and not self._take("]"):
                raise TemplateError("missing ]")
            tree = Apply("key", (tree, key))
        return tree

    def _next(self, kind: str) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != kind:
            raise TemplateError(f"a {kind} is missing")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def _atom(self):
        if self._take("("):
            tree = self._either()
            if not self._take(")"):
                raise TemplateError("missing )")
            return tree
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")
        self.at += 1
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "number":
            return Const(int(value))
        if kind == "name" and value not in ("and", "or", "not", "in"):
            return Const(_WORDS[value]) if value in _WORDS else Name(value)
        raise TemplateError(f"an expression is missing before {value!r}")


def parse(source: str) -> tuple:
    """Syntax tree of a template."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _CHUNK.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at:m.start()]))
        parts.append(("out", m["out"]) if m["out"] is not None else ("tag", m["tag"]))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    place = 0

    def body(*ends: str) -> tuple[tuple, str]:
        nonlocal place
        nodes: list = []
        while place < len(parts):
            kind, value = parts[place]
            place += 1
            if kind == "text":
                nodes.append(Output(Const(value)))
                continue
            if kind == "out":
                nodes.append(Output(_Expression(value).whole()))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return tuple(nodes), value
            if word == "for":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest.strip())
                if m is None:
                    raise TemplateError("a loop runs over messages")
                nodes.append(For(m[1], body("endfor")[0]))
            elif word == "if":
                branches, condition = [], _Expression(rest).whole()
                while True:
                    inner, end = body("elif", "else", "endif")
                    branches.append((condition, inner))
                    if end == "endif":
                        break
                    condition = Const(True) if end == "else" else _Expression(end.partition(" ")[2]).whole()
                nodes.append(If(tuple(branches)))
            elif word == "set":
                m = re.fullmatch(r"([A-Za-z_]\w*)\s*=(.*)", rest.strip(), re.DOTALL)
                if m is None:
                    raise TemplateError("set needs a name and a value")
                nodes.append(Assign(m[1], _Expression(m[2]).whole()))
            elif word == "generation":
                nodes.append(Generation(body("endgeneration")[0]))
            else:
                raise TemplateError(f"unknown tag {word!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(nodes), ""

    return body()[0]


# --- folding ----------------------------------------------------------------------

def _key(container, key):
    """Keys of mappings only; anything else is none."""
    return container.get(key) if isinstance(container, dict) else None


def _sum(a, b):
    return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)


_OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: a in b if isinstance(b, (str, dict)) else False,
    "+": _sum, "~": lambda a, b: _text(a) + _text(b), "not": lambda a: not a, "key": _key,
    "and": lambda a, b: a and b, "or": lambda a, b: a or b,
    **{f"|{name}": function for name, function in FILTERS.items()},
}


def fold_expression(tree):
    """Constant sub-expressions become their values."""
    if not isinstance(tree, Apply):
        return tree
    args = tuple(map(fold_expression, tree.args))
    if tree.op in ("and", "or") and isinstance(args[0], Const):
        return args[1] if bool(args[0].value) == (tree.op == "and") else args[0]
    if all(isinstance(a, Const) for a in args):
        return Const(_OPERATORS[tree.op](*(a.value for a in args)))
    return Apply(tree.op, args)


def fold(nodes: tuple) -> tuple:
    """Fold expressions, drop branches that never run, join adjacent texts."""
    folded: list = []
    for node in nodes:
        if isinstance(node, Output):
            value = fold_expression(node.value)
            if isinstance(value, Const):
                previous = folded[-1] if folded and isinstance(folded[-1], Output) and isinstance(folded[-1].value, Const) else None
                text = _text(value.value)
                if previous:
                    folded[-1] = Output(Const(previous.value.value + text))
                elif text:
                    folded.append(Output(Const(text)))
                continue
            node = Output(value)
        elif isinstance(node, For):
            node = For(node.name, fold(node.body))
        elif isinstance(node, Generation):
            node = Generation(fold(node.body))
        elif isinstance(node, Assign):
            node = Assign(node.name, fold_expression(node.value))
        elif isinstance(node, If):
            branches = []
            for condition, body in node.branches:
                condition = fold_expression(condition)
                if isinstance(condition, Const) and not condition.value:
                    continue
                branches.append((condition, fold(body)))
                if isinstance(condition, Const):
                    break
            if not branches:
                continue
            if isinstance(branches[0][0], Const):
                folded += fold((*branches[0][1],))
                continue
            node = If(tuple(branches))
        folded.append(node)
    return tuple(folded)


# --- closures ---------------------------------------------------------------------

class _Sink:
    def __init__(self):
        self.parts, self.length, self.spans, self.depth = [], 0, [], 0

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _value(tree) -> Callable[[dict], object]:
    if isinstance(tree, Const):
        return lambda scope: tree.value
    if isinstance(tree, Name):
        return lambda scope: scope.get(tree.name)
    args = tuple(map(_value, tree.args))
    if tree.op == "and":
        return lambda scope: args[0](scope) and args[1](scope)
    if tree.op == "or":
        return lambda scope: args[0](scope) or args[1](scope)
    function = _OPERATORS[tree.op]
    if len(args) == 1:
        return lambda scope: function(args[0](scope))
    return lambda scope: function(args[0](scope), args[1](scope))


def _block(nodes: tuple) -> Callable[[dict, _Sink], None]:
    steps = tuple(map(_step, nodes))

    def run(scope: dict, sink: _Sink) -> None:
        for step in steps:
            step(scope, sink)
    return run


def _step(node) -> Callable[[dict, _Sink], None]:
    if isinstance(node, Output):
        if isinstance(node.value, Const):
            text = _text(node.value.value)
            return lambda scope, sink: sink.write(text)
        value = _value(node.value)
        return lambda scope, sink: sink.write(_text(value(scope)))
    if isinstance(node, Assign):
        assigned = _value(node.value)
        return lambda scope, sink: scope.__setitem__(node.name, assigned(scope))
    if isinstance(node, If):
        branches = [(_value(c), _block(b)) for c, b in node.branches]

        def choose(scope: dict, sink: _Sink) -> None:
            for condition, body in branches:
                if condition(scope):
                    return body(scope, sink)
        return choose
    inner = _block(node.body)
    if isinstance(node, Generation):
        def mark(scope: dict, sink: _Sink) -> None:
            start, sink.depth = sink.length, sink.depth + 1
            inner(scope, sink)
            sink.depth -= 1
            if not sink.depth:  # a marker inside a marker is part of the outer one
                sink.spans.append((start, sink.length))
        return mark

    def loop(scope: dict, sink: _Sink) -> None:
        messages = scope["messages"]
        for i, message in enumerate(messages):
            state = {"index0": i, "index": i + 1, "first": i == 0, "last": i == len(messages) - 1}
            inner({**scope, node.name: message, "loop": state}, sink)
    return loop


def compile_template(source: str = TEMPLATE) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """Function from a list of messages to (text, spans the model is trained on)."""
    run = _block(fold(parse(source)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        sink = _Sink()
        run({"messages": messages}, sink)
        return "".join(sink.parts), sink.spans
    return render


def _names_in(tree) -> set[str]:
    """Every name a tree reads or sets."""
    if isinstance(tree, tuple):
        return set().union(*map(_names_in, tree))
    if not is_dataclass(tree):
        return set()
    own = {tree.name} if isinstance(tree, (Name, Assign)) else set()
    return own.union(*(_names_in(getattr(tree, f.name)) for f in fields(tree)))


def _loops_in(tree) -> int:
    if isinstance(tree, tuple):
        return sum(map(_loops_in, tree))
    return isinstance(tree, For) + sum(_loops_in(getattr(tree, f.name)) for f in fields(tree)) if is_dataclass(tree) else 0


class TurnWriter:
    """Renders a conversation turn by turn, for templates that are one loop with text around it.

    What a loop body sets is forgotten with the turn, so a turn depends on
    itself and its place only.  Templates with ``messages`` in an expression or
    with another loop need the whole conversation at once and raise.
    """

    def __init__(self, template: str = TEMPLATE):
        nodes = fold(parse(template))
        at = [i for i, node in enumerate(nodes) if isinstance(node, For)]
        if len(at) != 1 or _loops_in(nodes) != 1 or "messages" in _names_in(nodes):
            raise TemplateError("the template needs the whole conversation: use format_conversations")
        self._before, loop, self._after = _block(nodes[:at[0]]), nodes[at[0]], _block(nodes[at[0] + 1:])
        self._name, self._body = loop.name, _block(loop.body)

    def begin(self) -> None:
        self._scope, self._sink, self._turns, self._taken = {}, _Sink(), 0, 0
        self._before(self._scope, self._sink)

    def turn(self, message: dict, last: bool) -> None:
        i, self._turns = self._turns, self._turns + 1
        state = {"index0": i, "index": i + 1, "first": i == 0, "last": last}
        self._body({**self._scope, self._name: message, "loop": state}, self._sink)

    def end(self) -> None:
        self._after(self._scope, self._sink)

    @property
    def waiting(self) -> int:
        """Characters written since the last ``take``."""
        return self._sink.length - self._taken

    def take(self) -> tuple[int, str, list[tuple[int, int]]]:
        """(place in the conversation, text, spans) since the last call; spans count from the conversation's start."""
        taken = self._taken, "".join(self._sink.parts), self._sink.spans
        self._taken, self._sink.parts, self._sink.spans = self._sink.length, [], []
        return taken


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn from the output of the default template; the exact inverse of rendering."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"not a turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


# --- Spark ------------------------------------------------------------------------

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def format_conversations(turns: DataFrame, template: str = TEMPLATE, conversation: str = "conv_id", turn: str = "turn",
                         role: str = "role", text: str = "text") -> DataFrame:
    """(conversation, formatted, loss_spans): one row per conversation, turns in order.

    Null roles and texts count as empty, a null turn comes first, rows of equal
    turn are ordered by role and text, repeated rows stay, and rows without a
    conversation form one of their own.  A task holds whole conversations,
    which are what is formatted, a batch at a time.  Spans are code points of
    ``formatted``, end exclusive.  Other columns do not take part.
    """
    parse(template)  # an error in the template shows here, not in a task
    row = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    grouped = turns.groupBy(conversation).agg(F.sort_array(F.collect_list(row)).alias("turns"))
    made = T.StructType([T.StructField("formatted", T.StringType()), T.StructField("loss_spans", _SPANS)])

    @F.pandas_udf(made)
    def render(conversations: pd.Series) -> pd.DataFrame:
        write = compile_template(template)
        outputs = [write([{"role": t["role"], "text": t["text"], "turn": t["turn"]} for t in turns]) for turns in conversations]
        return pd.DataFrame({"formatted": [o[0] for o in outputs],
                             "loss_spans": [[{"start": a, "end": b} for a, b in o[1]] for o in outputs]})

    return grouped.select(conversation, render("turns").alias("made")).select(conversation, "made.formatted", "made.loss_spans")


PART_CHARS = 1 << 20  # a part of a conversation ends after the turn that brings it to this many characters
_PLACES = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _in_parts(batches: Iterator[pa.RecordBatch], template: str, part_chars: int) -> Iterator[pa.RecordBatch]:
    """Parts of the conversations of a partition, whose rows come sorted; holds one part and one batch."""
    writer, kind, waiting, part, out = TurnWriter(template), None, None, 0, []

    def closed() -> None:
        nonlocal part
        start, text, spans = writer.take()
        out.append((waiting[0], part, start, text, [{"start": a, "end": b} for a, b in spans]))
        part += 1

    def batch_of() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*out)]
        out.clear()
        return pa.RecordBatch.from_arrays([
            pa.array(columns[0], kind), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()),
            pa.array(columns[3], pa.string()), pa.array(columns[4], _PLACES)], ["conversation", "part", "start", "formatted", "loss_spans"])

    held = 0
    for batch in batches:
        kind = batch.schema.field(0).type
        for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if waiting is None:
                writer.begin()
            else:
                ends = waiting[0] != row[0]  # one row ahead, so that a turn knows whether it is the last
                writer.turn({"role": waiting[2], "text": waiting[3], "turn": waiting[1]}, ends)
                if ends:
                    writer.end()
                if ends or writer.waiting >= part_chars:
                    held += writer.waiting
                    closed()
                if ends:
                    writer.begin()
                    part = 0
                if held >= part_chars or len(out) >= 4096:
                    yield batch_of()
                    held = 0
            waiting = row
    if waiting is not None:
        writer.turn({"role": waiting[2], "text": waiting[3], "turn": waiting[1]}, True)
        writer.end()
        closed()
        yield batch_of()


def format_turns(turns: DataFrame, template: str = TEMPLATE, conversation: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """(conversation, part, start, formatted, loss_spans): conversations of any length, formatted as their turns stream by.

    The parts 0, 1, ... of a conversation, joined, are its formatted text; one
    ends after the turn that brings it to ``part_chars`` characters and ``start``
    is its place.  Spans are code points of the conversation, end exclusive.
    All parts of a conversation stand in one partition, in order.  Rows are
    shuffled by conversation and sorted, which spills to disk; a task then holds
    one part, so a conversation with a third of all rows costs time in its task
    and no memory.  Nulls, ties, repeated rows and rows without a conversation
    are as in ``format_conversations``; templates are those of ``TurnWriter``.
    """
    TurnWriter(template)  # an error in the template shows here, not in a task
    rows = turns.select(F.col(conversation).alias("c"), F.col(turn).alias("t"), F.coalesce(role, F.lit("")).alias("r"),
                        F.coalesce(text, F.lit("")).alias("x")).repartition("c").sortWithinPartitions("c", "t", "r", "x")
    places = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    made = T.StructType([T.StructField("conversation", turns.schema[conversation].dataType), T.StructField("part", T.LongType()),
                         T.StructField("start", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", places)])
    return rows.mapInArrow(lambda batches: _in_parts(batches, template, part_chars), made).withColumnRenamed("conversation", conversation)


class _Digest:
    """Running digests of one conversation."""

    def __init__(self):
        self.turns = self.loss = self.length = self.parts = 0
        self.spoken, self.trained = hashlib.sha256(), hashlib.sha256()

    def add(self, start: int, text: str, spans: list[dict]) -> None:
        for role, said in read_back(text):
            self.turns += 1
            self.spoken.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
        for span in spans:
            said = unescape(text[span["start"] - start:span["end"] - start])
            self.loss += len(said)
            self.trained.update(said.encode("utf-8", "surrogatepass"))
        self.length, self.parts = self.length + len(text), self.parts + 1

    def row(self) -> tuple:
        return self.turns, self.spoken.hexdigest(), self.loss, self.trained.hexdigest(), self.length


def _digested(batches: Iterator[pa.RecordBatch], names: tuple) -> Iterator[pa.RecordBatch]:
    kind, current, digest, out = None, None, None, []

    def batch_of() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*out)]
        out.clear()
        kinds = [kind, *(pa.int64() if t == T.LongType() else pa.string() for _, t in names)]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conversation", *(n for n, _ in names)])

    for batch in batches:
        kind = batch.schema.field(0).type
        for i in range(batch.num_rows):
            conversation, part, start, text, spans = (batch.column(c)[i].as_py() for c in range(5))
            if part == 0:
                if digest is not None:
                    out.append((current, *digest.row()))
                current, digest = conversation, _Digest()
            if digest is None or conversation != current or part != digest.parts:
                raise ValueError("the parts of a conversation must stand in one partition, in order")
            digest.add(start, text, spans)
            if len(out) >= 4096:
                yield batch_of()
    if digest is not None:
        out.append((current, *digest.row()))
        yield batch_of()


def digest_parts(parts: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """The digests of ``conversation_digests`` from the parts of ``format_turns``, in the order it leaves them.

    One pass without a shuffle; parts that were moved since raise.  Reads the
    output of the default template.
    """
    made = T.StructType([T.StructField("conversation", parts.schema[conversation].dataType), *[T.StructField(n, t) for n, t in _DIGESTS]])
    ordered = parts.select(conversation, "part", "start", "formatted", "loss_spans")
    return ordered.mapInArrow(lambda batches: _digested(batches, _DIGESTS), made).withColumnRenamed("conversation", conversation)


_DIGESTS = (("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()),
            ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType()))


def conversation_digests(formatted: DataFrame, conversation: str = "conv_id") -> DataFrame:
    """(conversation, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), read back from the output."""
    @F.pandas_udf(T.StructType([T.StructField(n, t) for n, t in _DIGESTS]))
    def digest(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for value, marked in zip(texts, spans):
            turns = read_back(value)
            trained = "".join(unescape(value[s["start"]:s["end"]]) for s in marked)
            spoken = "".join(f"{role}\n{text}\n" for role, text in turns)
            rows.append((len(turns), _sha(spoken), len(trained), _sha(trained), len(value)))
        return pd.DataFrame(rows, columns=[n for n, _ in _DIGESTS])

    return formatted.select(conversation, digest("formatted", "loss_spans").alias("d")).select(conversation, "d.*")


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
