"""Operator 3 (compiler): a sandboxed template language, compiled to closures.

Source is parsed into a syntax tree, constant expressions are folded and
adjacent texts joined, and every node becomes a Python closure that appends to
a list.  Names come from the given variables only; attributes are the keys of
mappings; there are no calls but the named filters, so a template reaches
neither Python's objects nor the outside.

    {{ expr }}    {% if e %} {% elif e %} {% else %} {% endif %}
    {% for x in e %} {% endfor %}  (with loop.index, index0, first, last)
    {% set x = e %}   {% generation %} {% endgeneration %}   {# comment #}

Expressions: strings, integers, true, false, none, names, a.b, a['b'],
e | filter, ==, !=, <, >, <=, >=, in, not in, not, and, or, +, ~ (joining
texts), %, parentheses, a if c else b.  Undefined names are none, which prints as nothing.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

_PARTS = re.compile(r"\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~%<>|.,()\[\]=]))""", re.DOTALL)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge}

Filters = Mapping[str, Callable[[str], str]]


class TemplateError(ValueError):
    pass


@dataclass
class Node:
    """kind: text, out, if, for, set, generation; const, name, item, filter, binary, not, choice."""

    kind: str
    value: Any = None
    kids: list[Any] = field(default_factory=list)


def _text(v: Any) -> str:
    return "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


class _Expression:
    def __init__(self, source: str, filters: Filters):
        self.filters, self.tokens, at = filters, [], 0
        source = source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted:
            self.at += 1
            return True
        return False

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected")

    def end(self, node: Node) -> Node:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return node

    def choice(self) -> Node:
        node = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            node = fold(Node("choice", None, [test, node, self.choice()]))
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = fold(Node("binary", "or", [node, self.both()]))
        return node

    def both(self) -> Node:
        node = self.negated()
        while self.take("and"):
            node = fold(Node("binary", "and", [node, self.negated()]))
        return node

    def negated(self) -> Node:
        return fold(Node("not", None, [self.negated()])) if self.take("not") else self.compared()

    def compared(self) -> Node:
        node = self.sum()
        while True:
            op = self.peek()
            if op in _COMPARE or op == "in":
                self.at += 1
                node = fold(Node("binary", op, [node, self.sum()]))
            elif op == "not" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "in":
                self.at += 2
                node = fold(Node("not", None, [fold(Node("binary", "in", [node, self.sum()]))]))
            else:
                return node

    def sum(self) -> Node:
        node = self.filtered()
        while (op := self.peek()) in ("+", "~", "%"):
            self.at += 1
            node = fold(Node("binary", op, [node, self.filtered()]))
        return node

    def filtered(self) -> Node:
        node = self.item()
        while self.take("|"):
            name = self.name()
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            node = fold(Node("filter", self.filters[name], [node]))
        return node

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def item(self) -> Node:
        node = self.atom()
        while True:
            if self.take("."):
                node = fold(Node("item", None, [node, Node("const", self.name())]))
            elif self.take("["):
                node = fold(Node("item", None, [node, self.choice()]))
                self.need("]")
            else:
                return node

    def atom(self) -> Node:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression expected")
        if self.take("("):
            node = self.choice()
            self.need(")")
            return node
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            return Node("const", re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "int":
            return Node("const", int(value))
        if kind == "name":
            known = {"true": True, "false": False, "none": None}
            return Node("const", known[value]) if value in known else Node("name", value)
        raise TemplateError(f"unexpected {value!r}")


def fold(node: Node) -> Node:
    """A constant in place of an expression all of whose parts are constants."""
    if all(k.kind == "const" for k in node.kids):
        return Node("const", compile_expression(node)({}))
    if node.kind == "choice" and node.kids[0].kind == "const":
        return node.kids[1] if node.kids[0].value else node.kids[2]
    return node


def parse(source: str, filters: Filters) -> list[Node]:
    """The syntax tree of a template."""
    root: list[Node] = []
    stack: list[tuple[str, Node | None, list[Node]]] = [("", None, root)]
    at = 0

    def expression(s: str) -> Node:
        e = _Expression(s, filters)
        return e.end(e.choice())

    def text(s: str) -> None:
        if s:
            body = stack[-1][2]
            if body and body[-1].kind == "text":
                body[-1].value += s
            else:
                body.append(Node("text", s))

    for m in _PARTS.finditer(source):
        text(source[at:m.start()])
        at, inner = m.end(), m[0][2:-2].strip()
        if m[0].startswith("{#"):
            continue
        if m[0].startswith("{{"):
            e = expression(inner)
            text(_text(e.value)) if e.kind == "const" else stack[-1][2].append(Node("out", None, [e]))
            continue
        word, _, rest = inner.partition(" ")
        kind, node, body = stack[-1]
        if word == "if":
            node = Node("if", None, [])
            body.append(node)
            node.kids.append((expression(rest), []))
            stack.append(("if", node, node.kids[-1][1]))
        elif word in ("elif", "else") and kind == "if":
            node.kids.append((expression(rest) if word == "elif" else Node("const", True), []))
            stack[-1] = ("if", node, node.kids[-1][1])
        elif word == "for":
            name, _, over = rest.partition(" in ")
            if not name.strip().isidentifier():
                raise TemplateError("a loop variable expected")
            node = Node("for", name.strip(), [expression(over), []])
            body.append(node)
            stack.append(("for", node, node.kids[1]))
        elif word == "generation":
            node = Node("generation", None, [])
            body.append(node)
            stack.append(("generation", node, node.kids))
        elif word == "set":
            name, _, value = rest.partition("=")
            if not name.strip().isidentifier():
                raise TemplateError("a variable expected")
            body.append(Node("set", name.strip(), [expression(value)]))
        elif word == f"end{kind}" and kind:
            stack.pop()
        else:
            raise TemplateError(f"unexpected {inner!r}")
    text(source[at:])
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return _folded(root)


def _folded(body: list[Node]) -> list[Node]:
    """Branches of constant tests are taken now; texts that then meet are joined."""
    out: list[Node] = []
    for n in body:
        if n.kind == "if":
            arms = []
            for test, inner in n.kids:
                if test.kind == "const" and not test.value:
                    continue
                arms.append((test, _folded(inner)))
                if test.kind == "const":
                    break
            new = arms[0][1] if arms and arms[0][0].kind == "const" else [Node("if", None, arms)] if arms else []
        elif n.kind == "for":
            new = [Node("for", n.value, [n.kids[0], _folded(n.kids[1])])]
        elif n.kind == "generation":
            new = [Node("generation", None, _folded(n.kids))]
        else:
            new = [n]
        for x in new:
            if x.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Node("text", out[-1].value + x.value)
            else:
                out.append(x)
    return out


def compile_expression(node: Node) -> Callable[[dict], Any]:
    if node.kind == "const":
        return lambda env, v=node.value: v
    if node.kind == "name":
        return lambda env, n=node.value: env.get(n)
    kids = [compile_expression(k) for k in node.kids]
    if node.kind == "item":
        of, key = kids

        def item(env):
            v, k = of(env), key(env)
            if isinstance(v, Mapping):
                return v.get(k)
            return v[k] if isinstance(v, (list, tuple)) and type(k) is int and k < len(v) else None

        return item
    if node.kind == "filter":
        return lambda env, f=node.value, x=kids[0]: f(_text(x(env)))
    if node.kind == "not":
        return lambda env, x=kids[0]: not x(env)
    if node.kind == "choice":
        return lambda env: kids[1](env) if kids[0](env) else kids[2](env)
    left, right = kids
    if node.value == "and":
        return lambda env: left(env) and right(env)
    if node.value == "or":
        return lambda env: left(env) or right(env)
    if node.value == "in":
        return lambda env: left(env) in (right(env) or ())
    if node.value == "~":
        return lambda env: _text(left(env)) + _text(right(env))
    if node.value in ("+", "%"):

        def arithmetic(env):
            a, b = left(env), right(env)
            if node.value == "+":
                return a + b if type(a) is type(b) else _text(a) + _text(b)
            if type(a) is int and type(b) is int and b:
                return a % b
            raise TemplateError("% takes two integers")

        return arithmetic
    return lambda env, f=_COMPARE[node.value]: f(left(env), right(env))


class Output:
    """What closures write to: parts, their length, and the ranges under generation marks."""

    def __init__(self):
        self.parts: list[str] = []
        self.length = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, s: str) -> None:
        self.parts.append(s)
        self.length += len(s)


def compile_body(body: list[Node]) -> Callable[[dict, Output], None]:
    steps = [_compile(n) for n in body]

    def run(env: dict, out: Output) -> None:
        for step in steps:
            step(env, out)

    return run


def _compile(n: Node) -> Callable[[dict, Output], None]:
    if n.kind == "text":
        return lambda env, out, s=n.value: out.add(s)
    if n.kind == "out":
        return lambda env, out, e=compile_expression(n.kids[0]): out.add(_text(e(env)))
    if n.kind == "set":
        e = compile_expression(n.kids[0])

        def assign(env, out):
            env[n.value] = e(env)

        return assign
    if n.kind == "generation":
        inner = compile_body(n.kids)

        def mark(env, out):
            begin = out.length
            inner(env, out)
            out.spans.append((begin, out.length))

        return mark
    if n.kind == "if":
        arms = [(compile_expression(t), compile_body(b)) for t, b in n.kids]

        def branch(env, out):
            for test, inner in arms:
                if test(env):
                    inner(env, out)
                    return

        return branch
    over, inner = compile_expression(n.kids[0]), compile_body(n.kids[1])

    def loop(env, out):
        it, outer, k = iter(over(env) or ()), {x: env.get(x) for x in (n.value, "loop")}, 0
        item = next(it, it)
        while item is not it:
            following = next(it, it)
            env[n.value], env["loop"] = item, {"index": k + 1, "index0": k, "first": k == 0, "last": following is it}
            inner(env, out)
            item, k = following, k + 1
        env.update(outer)

    return loop


def compile_template(source: str, filters: Filters) -> Callable[[dict, Output], None]:
    return compile_body(parse(source, filters))


def names_in(tree: Any) -> list[str]:
    """Every variable that is read, as often as it is."""
    if isinstance(tree, Node):
        own = [tree.value] if tree.kind == "name" else []
        return own + names_in(tree.kids)
    return [n for x in tree for n in names_in(x)] if isinstance(tree, (list, tuple)) else []


@dataclass
class Stream:
    """A template that reads ``over`` in one loop at its top level and nowhere
    else, in three closures: what precedes the loop, an item, what follows."""

    before: Callable[[dict, Output], None]
    variable: str
    item: Callable[[dict, Output], None]
    after: Callable[[dict, Output], None]


def compile_stream(source: str, filters: Filters, over: str) -> Stream | None:
    tree = parse(source, filters)
    at = [i for i, n in enumerate(tree) if n.kind == "for" and n.kids[0].kind == "name" and n.kids[0].value == over]
    if len(at) != 1 or names_in(tree).count(over) != 1:
        return None
    loop = tree[at[0]]
    return Stream(compile_body(tree[:at[0]]), loop.value, compile_body(loop.kids[1]), compile_body(tree[at[0] + 1:]))
