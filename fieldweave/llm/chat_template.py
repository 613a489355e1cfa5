r"""A compiler of chat templates: text to syntax tree, constants folded, Python closures out.

The language is a sandbox: a template sees the messages, one at a time, its loop and the values it was given, and nothing of Python.

    {{ expression }}                        writes a value
    {% for m in messages %} … {% endfor %}  once for each message; loop.first, loop.last, loop.index, loop.index0, loop.previtem, loop.nextitem
    {% if … %} … {% elif … %} … {% else %} … {% endif %}
    {% set name = expression %}
    {% generation %} … {% endgeneration %}  marks what a model learns to write
    {# comment #}, and {%- -%} strip the white space beside them

Expressions: strings, integers, true, false, none, names, ``m.role`` or ``m['role']``, ``a if c else b``, or, and, not, == != < <= > >=, in, not in,
+ - % (integers), ~ (texts joined), filters ``| trim``, upper, lower, title, length, default(x), replace(a, b), escape and unescape.
``escape(controls…)`` puts a backslash before each backslash and each control string in a text; ``unescape`` takes them away again.

Messages are a stream: they can be looped over, once, and loops cannot be nested. Memory follows a message, not the conversation. A missing
name or field is none, which writes nothing. Anything else is a TemplateError when the template is compiled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    pass


# Syntax tree. ``Const`` is what folding leaves where no message is needed.
@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Field:
    of: Any
    key: str


@dataclass
class Op:
    name: str
    args: list


@dataclass
class Write:
    what: Any


@dataclass
class If:
    test: Any
    then: list
    other: list


@dataclass
class Set:
    name: str
    value: Any


@dataclass
class For:
    name: str
    body: list


@dataclass
class Generation:
    body: list


def _text(value: Any) -> str:
    return "" if value is None else str(value)


def escape(text: str, *controls: str) -> str:
    """``text`` with a backslash before each backslash and before each of ``controls``, leftmost and longest first."""
    found = "|".join(re.escape(c) for c in sorted({"\\", *controls} - {""}, key=len, reverse=True))
    return re.sub(found, lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _integer(value: Any) -> int:
    return value if isinstance(value, int) else 0


#: Operators and filters: pure functions of values, so that constants can be folded through any of them
PURE: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: _integer(a) < _integer(b),
    "<=": lambda a, b: _integer(a) <= _integer(b),
    ">": lambda a, b: _integer(a) > _integer(b),
    ">=": lambda a, b: _integer(a) >= _integer(b),
    "in": lambda a, b: _text(a) in _text(b),
    "not in": lambda a, b: _text(a) not in _text(b),
    "not": lambda a: not a,
    "+": lambda a, b: a + b if type(a) is type(b) and isinstance(a, (int, str)) else _text(a) + _text(b),
    "-": lambda a, b: _integer(a) - _integer(b),
    "%": lambda a, b: _integer(a) % _integer(b) if _integer(b) else 0,
    "~": lambda a, b: _text(a) + _text(b),
    "|trim": lambda a: _text(a).strip(),
    "|upper": lambda a: _text(a).upper(),
    "|lower": lambda a: _text(a).lower(),
    "|title": lambda a: _text(a).title(),
    "|length": lambda a: len(_text(a)),
    "|default": lambda a, b="": b if a is None else a,
    "|replace": lambda a, b, c: _text(a).replace(_text(b), _text(c)),
    "|escape": lambda a, *controls: escape(_text(a), *map(_text, controls)),
    "|unescape": lambda a: unescape(_text(a)),
}
#: Arguments of each, besides the value a filter is applied to
COUNTS = {"|default": {0, 1}, "|replace": {2}, "|escape": None}
LOOP = {"first", "last", "index", "index0", "previtem", "nextitem"}
LEVELS = [["==", "!=", "<", "<=", ">", ">=", "in", "not in"], ["~"], ["+", "-"], ["%"]]

TAG = re.compile(r"\{#.*?#\}|\{\{.*?\}\}|\{%.*?%\}", re.DOTALL)
TOKEN = re.compile(r"""\s*(?:(?P<string>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-<>+%~|.,()\[\]=]))""")
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _tokens(text: str) -> list[tuple[str, Any]]:
    out, at = [], 0
    while text[at:].strip():
        m = TOKEN.match(text, at)
        if not m:
            raise TemplateError(f"cannot read {text[at:].strip()[:20]!r}")
        kind, value = m.lastgroup, m[m.lastgroup]
        if kind == "string":
            value = re.sub(r"\\(.)", lambda c: ESCAPES.get(c[1], c[1]), value[1:-1], flags=re.DOTALL)
        out.append((kind, int(value) if kind == "int" else value))
        at = m.end()
    return [*out, ("end", "")]


class _Expression:
    """A reader of one expression, by precedence."""

    def __init__(self, text: str):
        self.tokens, self.at = _tokens(text), 0

    def take(self, *values: str) -> str:
        """The next token if it is a sign or word of ``values``."""
        kind, value = self.tokens[self.at]
        if kind in ("sign", "name") and value in values:
            self.at += 1
            return value
        return ""

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected before {self.tokens[self.at][1]!r}")

    def name(self) -> str:
        kind, value = self.tokens[self.at]
        if kind != "name":
            raise TemplateError(f"a name expected before {value!r}")
        self.at += 1
        return value

    def whole(self) -> Any:
        node = self.choice()
        if self.tokens[self.at][0] != "end":
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self) -> Any:
        node = self.either()
        if self.take("if"):
            test = self.either()
            return Op("choice", [test, node, self.choice() if self.take("else") else Const(None)])
        return node

    def either(self) -> Any:
        node = self.both()
        while self.take("or"):
            node = Op("or", [node, self.both()])
        return node

    def both(self) -> Any:
        node = self.negated()
        while self.take("and"):
            node = Op("and", [node, self.negated()])
        return node

    def negated(self) -> Any:
        return Op("not", [self.negated()]) if self.take("not") else self.binary(0)

    def binary(self, level: int) -> Any:
        if level == len(LEVELS):
            return self.filtered()
        node = self.binary(level + 1)
        while sign := self.sign(level):
            node = Op(sign, [node, self.binary(level + 1)])
        return node

    def sign(self, level: int) -> str:
        if level == 0 and [t[1] for t in self.tokens[self.at : self.at + 2]] == ["not", "in"]:
            self.at += 2
            return "not in"
        return self.take(*LEVELS[level])

    def filtered(self) -> Any:
        node = self.primary()
        while self.take("|"):
            name, args = "|" + self.name(), []
            if self.take("("):
                while not self.take(")"):
                    args.append(self.choice())
                    if not self.take(","):
                        self.need(")")
                        break
            if name not in PURE or (counts := COUNTS.get(name, {0})) is not None and len(args) not in counts:
                raise TemplateError(f"no filter {name[1:]} of {len(args)} arguments")
            node = Op(name, [node, *args])
        return node

    def primary(self) -> Any:
        kind, value = self.tokens[self.at]
        if kind in ("string", "int"):
            self.at += 1
            node: Any = Const(value)
        elif self.take("("):
            node = self.choice()
            self.need(")")
        else:
            name = self.name()
            node = Const({"true": True, "false": False}.get(name)) if name in ("true", "false", "none") else Name(name)
        while sign := self.take(".", "["):
            if sign == ".":
                node = Field(node, self.name())
            else:
                kind, key = self.tokens[self.at]
                if kind != "string":
                    raise TemplateError("a field is named by a string")
                self.at += 1
                self.need("]")
                node = Field(node, key)
        return node


def _pieces(source: str) -> list[tuple[str, str]]:
    """(kind, text) of a template: text, write or statement; dashes have stripped the texts beside them."""
    out: list[tuple[str, str]] = []
    at, strip = 0, False
    for m in [*TAG.finditer(source), None]:
        text = source[at : m.start() if m else len(source)]
        text = text.lstrip() if strip else text
        strip = False
        if m:
            inner = m[0][2:-2]
            if inner.startswith("-"):
                text, inner = text.rstrip(), inner[1:]
            if inner.endswith("-"):
                strip, inner = True, inner[:-1]
            at = m.end()
        if text:
            out.append(("text", text))
        if m and m[0][1] != "#":
            out.append(("write" if m[0][1] == "{" else "statement", inner.strip()))
    return out


def parse(source: str) -> list:
    """The syntax tree of a template."""
    pieces = _pieces(source)
    if any(re.search(r"\{[{%#]|[%#]\}", text) for kind, text in pieces if kind == "text"):
        raise TemplateError("a tag is not closed or not opened")
    at = 0

    def body(ends: tuple[str, ...], inside: frozenset) -> tuple[list, str]:
        nonlocal at
        out: list = []
        while at < len(pieces):
            kind, text = pieces[at]
            at += 1
            if kind == "text":
                out.append(Write(Const(text)))
                continue
            if kind == "write":
                out.append(Write(_Expression(text).whole()))
                continue
            word, _, rest = text.partition(" ")
            if word in ends:
                return out, text
            if word == "if":
                out.append(condition(rest, inside))
            elif word == "set":
                name, _, value = rest.partition("=")
                if not re.fullmatch(r"\s*[A-Za-z_]\w*\s*", name):
                    raise TemplateError(f"cannot set {name.strip()!r}")
                out.append(Set(name.strip(), _Expression(value).whole()))
            elif word == "for":
                if not (m := re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+messages\s*", rest)) or "for" in inside:
                    raise TemplateError("a loop goes over messages, and not within another")
                out.append(For(m[1], body(("endfor",), inside | {"for"})[0]))
            elif word == "generation":
                if "generation" in inside:
                    raise TemplateError("a generation within another")
                out.append(Generation(body(("endgeneration",), inside | {"generation"})[0]))
            else:
                raise TemplateError(f"no statement {word!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, ""

    def condition(test: str, inside: frozenset) -> If:
        then, end = body(("elif", "else", "endif"), inside)
        word, _, rest = end.partition(" ")
        other = [condition(rest, inside)] if word == "elif" else body(("endif",), inside)[0] if word == "else" else []
        return If(_Expression(test).whole(), then, other)

    tree, _ = body((), frozenset())
    if sum(isinstance(x, For) for x in _walk(tree)) > 1:
        raise TemplateError("messages can be read once")
    return tree


def _walk(nodes: list) -> Iterator:
    for x in nodes:
        yield x
        for part in ("then", "other", "body"):
            yield from _walk(getattr(x, part, []))


def fold(node: Any, given: dict[str, Any]) -> Any:
    """An expression with the ``given`` names put in and all that then is constant worked out."""
    if isinstance(node, Name):
        return Const(given[node.name]) if node.name in given else node
    if isinstance(node, Field):
        return Field(fold(node.of, given), node.key)
    if not isinstance(node, Op):
        return node
    args = [fold(x, given) for x in node.args]
    first = args[0]
    if isinstance(first, Const) and node.name == "choice":
        return args[1] if first.value else args[2]
    if isinstance(first, Const) and node.name in ("and", "or"):
        return args[1] if bool(first.value) == (node.name == "and") else first
    if node.name in PURE and all(isinstance(x, Const) for x in args):
        return Const(PURE[node.name](*(x.value for x in args)))
    return Op(node.name, args)


def folded(nodes: list, given: dict[str, Any]) -> list:
    """A tree without branches that cannot be taken and with neighbouring texts joined."""
    out: list = []
    for x in nodes:
        if isinstance(x, Write):
            more: list = [Write(fold(x.what, given))]
        elif isinstance(x, If):
            test = fold(x.test, given)
            then, other = folded(x.then, given), folded(x.other, given)
            more = [If(test, then, other)] if not isinstance(test, Const) else then if test.value else other
        elif isinstance(x, Set):
            more = [Set(x.name, fold(x.value, given))]
        elif isinstance(x, For):
            more = [For(x.name, folded(x.body, {k: v for k, v in given.items() if k not in (x.name, "loop")}))]
        else:
            more = [Generation(folded(x.body, given))]
        for y in more:
            last = out[-1] if out else None
            if isinstance(y, Write) and isinstance(y.what, Const) and isinstance(last, Write) and isinstance(last.what, Const):
                out[-1] = Write(Const(_text(last.what.value) + _text(y.what.value)))
            elif not (isinstance(y, Write) and isinstance(y.what, Const) and not _text(y.what.value)):
                out.append(y)
    return out


@dataclass
class State:
    """What a closure sees: names, and the pieces (text, under a generation mark) written since they were last taken."""

    names: dict[str, Any]
    messages: Iterator[dict]
    pieces: list[tuple[str, bool]] = field(default_factory=list)
    marked: bool = False


def _value(node: Any) -> Callable[[State], Any]:
    """The closure of an expression."""
    if isinstance(node, Const):
        value = node.value
        return lambda s: value
    if isinstance(node, Name):
        name = node.name
        return lambda s: s.names.get(name)
    if isinstance(node, Field):
        of, key = _value(node.of), node.key
        return lambda s: x.get(key) if isinstance(x := of(s), dict) else None
    args = [_value(x) for x in node.args]
    if node.name == "choice":
        test, then, other = args
        return lambda s: then(s) if test(s) else other(s)
    if node.name in ("and", "or"):
        (a, b), go = args, node.name == "and"
        return lambda s: b(s) if bool(x := a(s)) == go else x
    pure = PURE[node.name]
    if len(args) == 1:
        (a,) = args
        return lambda s: pure(a(s))
    if len(args) == 2:
        a, b = args
        return lambda s: pure(a(s), b(s))
    return lambda s: pure(*(a(s) for a in args))


def _run(nodes: list) -> Callable[[State], Iterator[None]]:
    """The closure of a body: a generator that stops after each message, so that what is written can be taken away."""
    steps = [_step(x) for x in nodes]

    def run(s: State) -> Iterator[None]:
        for step in steps:
            yield from step(s)

    return run


def _step(node: Any) -> Callable[[State], Iterable[None]]:
    if isinstance(node, Write):
        value = _value(node.what)

        def write(s: State) -> tuple:
            if text := _text(value(s)):
                s.pieces.append((text, s.marked))
            return ()

        return write
    if isinstance(node, Set):
        value, name = _value(node.value), node.name

        def put(s: State) -> tuple:
            s.names[name] = value(s)
            return ()

        return put
    if isinstance(node, If):
        test, then, other = _value(node.test), _run(node.then), _run(node.other)
        return lambda s: then(s) if test(s) else other(s)
    body = _run(node.body)
    if isinstance(node, Generation):

        def mark(s: State) -> Iterator[None]:
            s.marked = True
            yield from body(s)
            s.marked = False

        return mark
    name = node.name

    def each(s: State) -> Iterator[None]:
        before, now, k = None, next(s.messages, None), 0
        while now is not None:
            then = next(s.messages, None)
            s.names[name] = now
            s.names["loop"] = {"first": k == 0, "last": then is None, "index": k + 1, "index0": k, "previtem": before, "nextitem": then}
            yield from body(s)
            yield
            before, now, k = now, then, k + 1

    return each


class Template:
    """A compiled template. ``given`` are names whose values are known now, such as the end of a text; they are folded in."""

    def __init__(self, source: str, **given: str | int | bool | None):
        self.source, self.given = source, given
        tree = parse(source)
        if taken := {x.name for x in _walk(tree) if isinstance(x, Set)} & given.keys():
            raise TemplateError(f"{sorted(taken)[0]!r} is given and cannot be set")
        self.tree = folded(tree, given)
        self._body = _run(self.tree)

    def __reduce__(self):
        return _restored, (self.source, self.given)

    def pieces(self, messages: Iterable[dict]) -> Iterator[tuple[str, bool]]:
        """(text, whether under a generation mark), message by message; messages are read as they are needed."""
        s = State({}, iter(messages))
        for _ in self._body(s):
            yield from s.pieces
            s.pieces.clear()
        yield from s.pieces

    def render(self, messages: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
        """The whole text and the marked spans of it."""
        out, spans, at = [], [], 0
        for text, marked in self.pieces(messages):
            if marked and spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(text))
            elif marked:
                spans.append((at, at + len(text)))
            out.append(text)
            at += len(text)
        return "".join(out), spans


def _restored(source: str, given: dict) -> Template:
    return Template(source, **given)
