"""A small sandboxed template language, compiled to closures.

    {{ expression }}                      its text
    {% for x in expression %}...{% endfor %}
    {% if expression %}...{% elif expression %}...{% else %}...{% endif %}
    {% generation %}...{% endgeneration %}  marks what a model is to learn to say

Expressions have strings, whole numbers, names, fields (``turn.role``), ``==``, ``!=``, ``+``,
``not``, ``and``, ``or``, parentheses and filters (``turn.text | escape``). In a loop, ``loop.first``,
``loop.last`` and ``loop.index`` are known. Nothing else is: a name is looked up in the values
given, a field in a mapping, a filter in the table given, so a template reaches no other object.
A template is parsed to a tree, constant parts are folded, and each node becomes a closure.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field

Values = dict[str, object]
Code = Callable[[Values, "Output"], None]
Getter = Callable[[Values], object]


class TemplateError(ValueError):
    """The text is no template of this language."""


class Output:
    """Rendered text, and the spans of it that stand in generation marks."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []
        self._open: list[int] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def taken(self) -> Output:
        """What has been written so far, as an output of its own; this one is empty again."""
        done = Output()
        done.parts, done.size, done.spans = self.parts, self.size, self.spans
        self.parts, self.size, self.spans = [], 0, []
        return done

    def begin(self) -> None:
        self._open.append(self.size)

    def end(self) -> None:
        start = self._open.pop()
        if not self._open:
            self.spans.append((start, self.size))


# Expressions


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    name: str


@dataclass(frozen=True)
class Apply:
    """An operator or a filter with its arguments."""

    name: str
    args: tuple


# Statements


@dataclass(frozen=True)
class Text:
    value: object


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    items: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


OPERATORS: dict[str, Callable] = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "+": lambda a, b: a + b if isinstance(a, str) and isinstance(b, str) else _no_sum(a, b),
    "not": lambda a: not a,
}
_TOKEN = re.compile(r"\s*(?:(==|!=|[()+|.])|('[^']*'|\"[^\"]*\")|(\d+)|([A-Za-z_]\w*))")
_TAG = re.compile(r"\{%(.*?)%\}|\{\{(.*?)\}\}", re.S)


def _no_sum(a: object, b: object) -> object:
    raise TemplateError("+ joins texts only")


@dataclass
class _Expression:
    """Recursive descent over the tokens of one expression."""

    source: str
    filters: Mapping[str, Callable[[str], str]]
    tokens: list[tuple[str, object]] = field(default_factory=list)

    def parse(self) -> object:
        at = 0
        while at < len(self.source.rstrip()):
            match = _TOKEN.match(self.source, at)
            if not match:
                raise TemplateError(f"cannot read {self.source!r}")
            sign, string, number, name = match.groups()
            if string is not None:
                self.tokens.append(("const", string[1:-1]))
            elif number is not None:
                self.tokens.append(("const", int(number)))
            else:
                self.tokens.append(("sign" if sign else "name", sign or name))
            at = match.end()
        tree = self._either()
        if self.tokens:
            raise TemplateError(f"{self.tokens[0][1]!r} does not belong in {self.source!r}")
        return tree

    def _take(self, *wanted: str) -> str | None:
        if self.tokens and self.tokens[0][0] != "const" and self.tokens[0][1] in wanted:
            return self.tokens.pop(0)[1]
        return None

    def _either(self) -> object:
        left = self._both()
        while self._take("or"):
            left = Apply("or", (left, self._both()))
        return left

    def _both(self) -> object:
        left = self._negation()
        while self._take("and"):
            left = Apply("and", (left, self._negation()))
        return left

    def _negation(self) -> object:
        return Apply("not", (self._negation(),)) if self._take("not") else self._compared()

    def _compared(self) -> object:
        left = self._sum()
        sign = self._take("==", "!=")
        return Apply(sign, (left, self._sum())) if sign else left

    def _sum(self) -> object:
        left = self._filtered()
        while self._take("+"):
            left = Apply("+", (left, self._filtered()))
        return left

    def _filtered(self) -> object:
        value = self._atom()
        while self._take("|"):
            kind, name = self.tokens.pop(0) if self.tokens else ("", "")
            if kind != "name" or name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            value = Apply(f"|{name}", (value,))
        return value

    def _atom(self) -> object:
        if not self.tokens:
            raise TemplateError(f"{self.source!r} ends too soon")
        kind, value = self.tokens.pop(0)
        if kind == "const":
            return Const(value)
        if value == "(":
            inner = self._either()
            if not self._take(")"):
                raise TemplateError(f"no ) in {self.source!r}")
            return inner
        if kind != "name":
            raise TemplateError(f"{value!r} begins no value in {self.source!r}")
        tree: object = Name(value)
        while self._take("."):
            kind, name = self.tokens.pop(0) if self.tokens else ("", "")
            if kind != "name":
                raise TemplateError(f"no field name in {self.source!r}")
            tree = Field(tree, name)
        return tree


class Template:
    """A compiled template. ``filters`` maps names to functions of a text."""

    def __init__(self, source: str, filters: Mapping[str, Callable[[str], str]] | None = None):
        self.filters = dict(filters or {})
        self.pieces = self._cut(source)
        tree = self._block(())
        if self.pieces:
            raise TemplateError(f"{self.pieces[0][1]!r} closes nothing")
        self.tree = self._fold_all(tree)

    # Parsing

    @staticmethod
    def _cut(source: str) -> list[tuple[str, str]]:
        pieces, at = [], 0
        for match in _TAG.finditer(source):
            pieces.append(("text", source[at : match.start()]))
            tag = match.group(1) is not None
            pieces.append(("tag", match.group(1).strip()) if tag else ("value", match.group(2)))
            at = match.end()
        pieces.append(("text", source[at:]))
        return [piece for piece in pieces if piece != ("text", "")]

    def _block(self, closers: tuple[str, ...]) -> tuple:
        """Statements up to a tag that begins with one of ``closers``, which stays."""
        found: list[object] = []
        while self.pieces:
            kind, what = self.pieces[0]
            word, _, rest = what.partition(" ") if kind == "tag" else ("", "", "")
            if kind == "tag" and word in ("endfor", "endif", "elif", "else", "endgeneration"):
                if word in closers:
                    return tuple(found)
                raise TemplateError(f"{what!r} closes nothing")
            self.pieces.pop(0)
            if kind == "text":
                found.append(Text(Const(what)))
            elif kind == "value":
                found.append(Text(self._expression(what)))
            elif word == "generation":
                found.append(Generation(self._block(("endgeneration",))))
                self._close("endgeneration")
            elif word == "if":
                found.append(self._if(rest))
            elif word == "for":
                match = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                if not match:
                    raise TemplateError(f"cannot read {what!r}")
                body = self._block(("endfor",))
                self._close("endfor")
                found.append(For(match[1], self._expression(match[2]), body))
            else:
                raise TemplateError(f"no statement {what!r}")
        if closers:
            raise TemplateError(f"no {' or '.join(closers)}")
        return tuple(found)

    def _if(self, test: str) -> If:
        then = self._block(("elif", "else", "endif"))
        word, _, rest = self.pieces.pop(0)[1].partition(" ")
        if word == "elif":
            return If(self._expression(test), then, (self._if(rest),))
        other: tuple = ()
        if word == "else":
            other = self._block(("endif",))
            self._close("endif")
        return If(self._expression(test), then, other)

    def _close(self, word: str) -> None:
        kind, what = self.pieces.pop(0)
        if (kind, what) != ("tag", word):
            raise TemplateError(f"{what!r} where {word!r} belongs")

    def _expression(self, source: str) -> object:
        return _Expression(source, self.filters).parse()

    # Constant folding

    def _fold_all(self, statements: Iterable[object]) -> tuple:
        folded: list[object] = []
        for statement in statements:
            for done in self._fold(statement):
                both = folded and isinstance(done, Text) and isinstance(folded[-1], Text)
                if both and isinstance(done.value, Const) and isinstance(folded[-1].value, Const):
                    done = Text(Const(folded.pop().value.value + done.value.value))
                folded.append(done)
        return tuple(folded)

    def _fold(self, statement: object) -> tuple:
        if isinstance(statement, Text):
            value = self._fold_value(statement.value)
            return (Text(Const(_text(value.value)) if isinstance(value, Const) else value),)
        if isinstance(statement, If):
            test = self._fold_value(statement.test)
            if isinstance(test, Const):
                return self._fold_all(statement.then if test.value else statement.other)
            return (If(test, self._fold_all(statement.then), self._fold_all(statement.other)),)
        if isinstance(statement, For):
            items = self._fold_value(statement.items)
            return (For(statement.name, items, self._fold_all(statement.body)),)
        return (Generation(self._fold_all(statement.body)),)

    def _fold_value(self, tree: object) -> object:
        if isinstance(tree, Field):
            return Field(self._fold_value(tree.of), tree.name)
        if not isinstance(tree, Apply):
            return tree
        args = tuple(self._fold_value(arg) for arg in tree.args)
        if tree.name in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (tree.name == "and") else args[0]
        done = Apply(tree.name, args)
        if all(isinstance(arg, Const) for arg in args):
            return Const(self._getter(done)({}))
        return done

    # Closures

    def _getter(self, tree: object) -> Getter:
        if isinstance(tree, Const):
            value = tree.value
            return lambda values: value
        if isinstance(tree, Name):
            name = tree.name
            return lambda values: values.get(name)
        if isinstance(tree, Field):
            of, name = self._getter(tree.of), tree.name

            def look(values: Values) -> object:
                held = of(values)
                return held.get(name) if isinstance(held, dict) else None

            return look
        args = [self._getter(arg) for arg in tree.args]
        if tree.name == "and":
            return lambda values: args[0](values) and args[1](values)
        if tree.name == "or":
            return lambda values: args[0](values) or args[1](values)
        if tree.name.startswith("|"):
            apply = self.filters[tree.name[1:]]
            return lambda values: apply(_text(args[0](values)))
        operator = OPERATORS[tree.name]
        return lambda values: operator(*[arg(values) for arg in args])

    def _code(self, statement: object) -> Code:
        if isinstance(statement, Text):
            if isinstance(statement.value, Const):
                constant = statement.value.value
                return lambda values, out: out.write(constant)
            value = self._getter(statement.value)
            return lambda values, out: out.write(_text(value(values)))
        if isinstance(statement, If):
            test = self._getter(statement.test)
            then, other = self._codes(statement.then), self._codes(statement.other)
            return lambda values, out: (then if test(values) else other)(values, out)
        if isinstance(statement, For):
            loop = self._loop(statement)

            def run(values: Values, out: Output) -> None:
                for _ in loop(values, out):
                    pass

            return run
        body = self._codes(statement.body)

        def generation(values: Values, out: Output) -> None:
            out.begin()
            body(values, out)
            out.end()

        return generation

    def _codes(self, statements: Iterable[object]) -> Code:
        codes = [self._code(statement) for statement in statements]

        def run(values: Values, out: Output) -> None:
            for code in codes:
                code(values, out)

        return run

    def _loop(self, statement: For) -> Callable[[Values, Output], Iterator[None]]:
        items, body, name = self._getter(statement.items), self._codes(statement.body), statement.name

        def run(values: Values, out: Output) -> Iterator[None]:
            rest = iter(items(values) or ())
            here, index = next(rest, _NONE), 0
            while here is not _NONE:
                following = next(rest, _NONE)
                index += 1
                loop = {"first": index == 1, "last": following is _NONE, "index": index}
                body(values | {name: here, "loop": loop}, out)
                yield
                here = following

        return run

    def compiled(self, piece: int) -> Callable[[Values], Iterator[Output]]:
        """A function that renders to pieces of about ``piece`` characters.

        A piece ends where a loop at the top of the template goes round, so a conversation
        of any length is never held whole if what the loop runs over is an iterator.
        """
        steps = [
            (self._loop(s), True) if isinstance(s, For) else (self._code(s), False)
            for s in self.tree
        ]

        def render(values: Values) -> Iterator[Output]:
            out = Output()
            for step, loops in steps:
                if not loops:
                    step(values, out)
                    continue
                for _ in step(values, out):
                    if out.size >= piece:
                        yield out.taken()
            yield out.taken()

        return render


_NONE = object()


def _text(value: object) -> str:
    return "" if value is None else str(value)
