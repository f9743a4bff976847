"""A compiler for chat templates: a small sandboxed template language, parsed into a syntax tree, folded where it is
constant, and turned into Python closures.

``{{ expression }}`` writes a value, ``{% if %} {% elif %} {% else %} {% endif %}`` and ``{% for x in xs %} {% endfor %}``
steer, ``{% set x = expression %}`` names a value, ``{% generation %} {% endgeneration %}`` marks what a model is to
learn. Expressions know strings, whole numbers, names, ``a.key`` and ``a[key]`` on dictionaries and lists, ``+ == !=
and or not in``, ``loop.index0 loop.first loop.last`` and the filters below. There are no calls, no attributes of Python
objects and no loops but over given lists, so a template can neither reach out nor run on.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shuffle_partitions, sorted_groups

ESCAPE = "\\"
#: What marks turns in the default template. Texts that hold one of these are escaped.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "[/TURN]")
TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}<s> {% generation %}{{ m.text | escape }}{% endgeneration %} </s>"
    "{% elif m.role == 'system' %}<<SYS>> {{ m.text | escape }} <</SYS>>"
    "{% else %}[ROLE] {{ m.role | escape }} [/ROLE] {{ m.text | escape }} [/TURN]{% endif %}"
    "{% endfor %}"
)


class TemplateError(ValueError):
    pass


def escaper(controls: tuple[str, ...]) -> tuple[Callable[[str], str], Callable[[str], str]]:
    """(escape, unescape). The escape character is doubled, and one is put behind the first character of each control
    string, overlapping ones too; so no control string is left, and single escape characters can be told from doubled."""
    if any(len(c) < 2 or ESCAPE in c for c in controls):
        raise TemplateError("control strings need two characters or more and no escape character")
    hit = re.compile("(?=" + "|".join(map(re.escape, controls)) + ")(.)", re.DOTALL) if controls else None
    undo = re.compile(re.escape(ESCAPE) + "(" + re.escape(ESCAPE) + "?)")

    def escape(text: str) -> str:
        text = text.replace(ESCAPE, ESCAPE * 2)
        return hit.sub(lambda m: m[1] + ESCAPE, text) if hit else text

    return escape, lambda text: undo.sub(lambda m: m[1], text)


@dataclass
class Node:
    """A syntax-tree node: its kind, its values, and its children."""

    kind: str
    value: Any = None
    kids: list[Node] = field(default_factory=list)


_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[-+|.\[\]()]))")
_WORDS = {"and", "or", "not", "in"}


class _Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            kind = m.lastgroup or ""
            self.tokens.append(("op" if m[kind] in _WORDS else kind, m[kind]))
            at = m.end()
        self.at = 0

    def peek(self, *ops: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == "op" and self.tokens[self.at][1] in ops

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too early")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def chain(self, below: Callable[[], Node], *ops: str) -> Node:
        node = below()
        while self.peek(*ops):
            node = Node("binary", self.take()[1], [node, below()])
        return node

    def either(self) -> Node:
        return self.chain(self.both, "or")

    def both(self) -> Node:
        return self.chain(self.negated, "and")

    def negated(self) -> Node:
        if self.peek("not"):
            self.take()
            return Node("not", None, [self.negated()])
        return self.chain(self.sum, "==", "!=", "in")

    def sum(self) -> Node:
        return self.chain(self.filtered, "+")

    def filtered(self) -> Node:
        node = self.atom()
        while self.peek("|"):
            self.take()
            node = Node("filter", self.take()[1], [node])
        return node

    def atom(self) -> Node:
        kind, value = self.take()
        if kind == "text":
            node = Node("constant", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        elif kind == "number":
            node = Node("constant", int(value))
        elif kind == "name":
            node = Node("constant", value == "true") if value in ("true", "false") else Node("name", value)
        elif value == "(":
            node = self.either()
            if self.take()[1] != ")":
                raise TemplateError("a bracket isn't closed")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek(".", "["):
            if self.take()[1] == ".":
                node = Node("item", None, [node, Node("constant", self.take()[1])])
            else:
                node = Node("item", None, [node, self.either()])
                if self.take()[1] != "]":
                    raise TemplateError("a bracket isn't closed")
        return node


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.DOTALL)


def parse(source: str) -> Node:
    """The syntax tree of a template."""
    root = Node("block")
    stack = [("", root)]
    at = 0

    def block(kind: str) -> Node:
        if stack[-1][0] != kind:
            raise TemplateError(f"{kind!r} is closed but not open")
        return stack[-1][1]

    if re.search(r"\{\{|\{%", _TAG.sub("", source)):
        raise TemplateError("a tag isn't closed")
    for m in _TAG.finditer(source):
        top = stack[-1][1]
        if m.start() > at:
            top.kids.append(Node("constant", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            top.kids.append(Node("write", None, [_Expression(m[1]).whole()]))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "if":
            body, node = Node("block"), Node("if")
            node.kids = [_Expression(rest).whole(), body]
            top.kids.append(node)
            stack += [("if", node), ("branch", body)]
        elif word in ("elif", "else"):
            block("branch")
            stack.pop()
            node = block("if")
            if len(node.kids) % 2:
                raise TemplateError("'else' must come last")
            body = Node("block")
            node.kids += [_Expression(rest).whole(), body] if word == "elif" else [body]
            stack.append(("branch", body))
        elif word == "endif":
            block("branch")
            stack.pop()
            block("if")
            stack.pop()
        elif word == "for":
            name, _, what = rest.partition(" in ")
            if not name.strip().isidentifier():
                raise TemplateError("'for' needs a name")
            body = Node("block")
            top.kids.append(Node("for", name.strip(), [_Expression(what).whole(), body]))
            stack.append(("for", body))
        elif word == "generation":
            body = Node("block")
            top.kids.append(Node("generation", None, [body]))
            stack.append(("generation", body))
        elif word in ("endfor", "endgeneration"):
            block(word[3:])
            stack.pop()
        elif word == "set":
            name, _, what = rest.partition("=")
            if not name.strip().isidentifier():
                raise TemplateError("'set' needs a name")
            top.kids.append(Node("set", name.strip(), [_Expression(what).whole()]))
        else:
            raise TemplateError(f"unknown tag {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]!r} isn't closed")
    if at < len(source):
        root.kids.append(Node("constant", source[at:]))
    return root


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def _binary(op: str, a: Any, b: Any) -> Any:
    if op == "+":
        return a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b)
    return {"==": lambda: a == b, "!=": lambda: a != b, "in": lambda: b is not None and a in b}[op]()


def fold(node: Node, filters: dict[str, Callable[[str], str]]) -> Node:
    """The tree with constant parts worked out, known branches chosen and neighbouring texts joined."""
    kids = [fold(k, filters) for k in node.kids]
    fixed = bool(kids) and all(k.kind == "constant" for k in kids)
    if node.kind == "filter":
        if node.value not in filters:
            raise TemplateError(f"unknown filter {node.value!r}")
        if fixed:
            return Node("constant", filters[node.value](_text(kids[0].value)))
    if node.kind == "not" and fixed:
        return Node("constant", not kids[0].value)
    if node.kind == "binary":
        if node.value in ("and", "or") and kids[0].kind == "constant":
            return kids[1] if bool(kids[0].value) == (node.value == "and") else kids[0]
        if fixed and node.value not in ("and", "or"):
            return Node("constant", _binary(node.value, kids[0].value, kids[1].value))
    if node.kind == "write" and fixed:
        return Node("constant", _text(kids[0].value))
    if node.kind == "if":
        live: list[Node] = []
        for i in range(0, len(kids) - 1, 2):
            if kids[i].kind != "constant":
                live += kids[i : i + 2]
            elif kids[i].value:
                live.append(kids[i + 1])
                break
        else:
            live += kids[len(kids) // 2 * 2 :]
        if len(live) < 2:
            return live[0] if live else Node("block")
        return Node("if", None, live)
    if node.kind == "block":
        flat: list[Node] = []
        for k in kids:
            for x in k.kids if k.kind == "block" else [k]:
                if x.kind == "constant" and flat and flat[-1].kind == "constant":
                    flat[-1] = Node("constant", flat[-1].value + x.value)
                elif x.kind != "constant" or x.value:
                    flat.append(x)
        return Node("block", None, flat)
    return Node(node.kind, node.value, kids)


class _Output:
    """What a template writes, and which stretches of it are generated."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _value(node: Node, filters: dict[str, Callable[[str], str]]) -> Callable[[dict], Any]:
    if node.kind == "constant":
        return lambda names, x=node.value: x
    if node.kind == "name":
        return lambda names, x=node.value: names.get(x)
    kids = [_value(k, filters) for k in node.kids]
    if node.kind == "item":

        def item(names: dict, of: Any = kids[0], key: Any = kids[1]) -> Any:
            held, k = of(names), key(names)
            if isinstance(held, dict):
                return held.get(k)
            return held[k] if isinstance(held, list) and isinstance(k, int) and k < len(held) else None

        return item
    if node.kind == "filter":
        return lambda names, f=filters[node.value], x=kids[0]: f(_text(x(names)))
    if node.kind == "not":
        return lambda names, x=kids[0]: not x(names)
    a, b = kids
    if node.value == "and":
        return lambda names: a(names) and b(names)
    if node.value == "or":
        return lambda names: a(names) or b(names)
    return lambda names, op=node.value: _binary(op, a(names), b(names))


def _writer(node: Node, filters: dict[str, Callable[[str], str]]) -> Callable[[dict, _Output], None]:
    if node.kind == "constant":
        return lambda names, out, x=node.value: out.write(x)
    if node.kind == "write":
        return lambda names, out, x=_value(node.kids[0], filters): out.write(_text(x(names)))
    if node.kind == "set":

        def put(names: dict, out: _Output, x: Any = _value(node.kids[0], filters)) -> None:
            names[node.value] = x(names)

        return put
    if node.kind == "if":
        tests = [(_value(node.kids[i], filters), _writer(node.kids[i + 1], filters)) for i in range(0, len(node.kids) - 1, 2)]
        last = _writer(node.kids[-1], filters) if len(node.kids) % 2 else None

        def choose(names: dict, out: _Output) -> None:
            for test, body in tests:
                if test(names):
                    body(names, out)
                    return
            if last:
                last(names, out)

        return choose
    if node.kind == "for":
        over, body = _value(node.kids[0], filters), _writer(node.kids[1], filters)

        def loop(names: dict, out: _Output) -> None:
            items = over(names)
            for i, x in enumerate(items if isinstance(items, list) else []):
                body({**names, node.value: x, "loop": {"index0": i, "first": i == 0, "last": i == len(items) - 1}}, out)

        return loop
    if node.kind == "generation":
        inner = _writer(node.kids[0], filters)

        def mark(names: dict, out: _Output) -> None:
            first = out.length
            inner(names, out)
            out.spans.append((first, out.length))

        return mark
    bodies = [_writer(k, filters) for k in node.kids]

    def block(names: dict, out: _Output) -> None:
        for body in bodies:
            body(names, out)

    return block


def compile_template(source: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages (dictionaries with ``role`` and ``text``) to the formatted text and the spans to learn."""
    filters = {"escape": escaper(controls)[0], "trim": str.strip, "lower": str.lower, "upper": str.upper}
    write = _writer(fold(parse(source), filters), filters)

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = _Output()
        write({"messages": messages}, out)
        return "".join(out.parts), out.spans

    return render


_TURN = re.compile(r"\[INST\] (?P<user>.*?) \[/INST\]|<s> (?P<assistant>.*?) </s>|<<SYS>> (?P<system>.*?) <</SYS>>|\[ROLE\] (?P<role>.*?) \[/ROLE\] (?P<text>.*?) \[/TURN\]", re.DOTALL)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a text that the default template has formatted."""
    undo = escaper(CONTROLS)[1]
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn starts at {at}")
        at = m.end()
        kind = m.lastgroup or ""
        turns.append((undo(m["role"]), undo(m["text"])) if kind == "text" else (kind, undo(m[kind])))
    return turns


_OUT = "conv_id long, formatted string, spans array<struct<first:long,stop:long>>"


def format_conversations(rows: DataFrame, source: str = TEMPLATE, controls: tuple[str, ...] = CONTROLS) -> DataFrame:
    """(conv_id, formatted, spans): a row for each conversation of ``rows`` (conv_id, turn, role, text), its turns in
    order of ``turn``; rows of one turn in order of role and text, repeated rows all kept. ``spans`` are the stretches of
    ``formatted``, in code points, under the loss mask.

    Null texts and roles count as empty; null turns come first; rows with a null conv_id form one conversation, with a
    null id. An empty table gives an empty one; other columns are ignored. A task holds one conversation at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(source, controls)
        ids: list[int | None] = []
        texts: list[str] = []
        spans: list[list[dict]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            kind = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(spans, kind)], ["conv_id", "formatted", "spans"])

        for group in sorted_groups(batches, "conv"):
            messages = [{"role": r or "", "text": t or ""} for r, t in zip(group["role"].to_pylist(), group["text"].to_pylist(), strict=True)]
            formatted, marked = render(messages)
            ids.append(None if group["no_id"][0].as_py() else group["conv"][0].as_py())
            texts.append(formatted)
            spans.append([{"first": a, "stop": b} for a, b in marked])
            size += len(formatted)
            if size > 4_000_000:
                yield flush()
                ids, texts, spans, size = [], [], [], 0
        if ids:
            yield flush()

    conv = F.col("conv_id").cast("long")
    keyed = rows.select(F.coalesce(conv, F.lit(-(1 << 63))).alias("conv"), conv.isNull().alias("no_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return keyed.repartition(shuffle_partitions(rows.sparkSession), "conv").sortWithinPartitions("conv", "turn", "role", "text").mapInArrow(run, _OUT)
