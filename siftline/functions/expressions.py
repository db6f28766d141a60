"""The expression language of rules, compiled to columns.

An expression is read by precedence climbing into typed columns at once: there is no tree to walk later, and
types are checked as it is read. Types are "string", "number", "bool", "array" and, for dotted variables, dicts.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .dialect import to_java


class ExpressionError(ValueError):
    """An expression that cannot be read, or whose types do not fit."""


@dataclass(frozen=True)
class Typed:
    kind: str
    column: Column | None = None
    fields: dict | None = None
    literal: object = None


Env = dict[str, Typed]

TOKEN = re.compile(
    r"""\s*(?:(?P<number>\d+(?:\.\d+)?|\.\d+)|(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`)|(?P<name>[A-Za-z_$][A-Za-z0-9_$]*)|(?P<op>\?\?|\|\||&&|==|!=|<=|>=|\*\*|\?\.|\.\.|[-+*/%<>!?:;=.,()\[\]|]))"""
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
#: Binary operators by how tightly they bind.
BINDS = {"??": 1, "or": 2, "||": 2, "and": 3, "&&": 3, "==": 4, "!=": 4, "<": 5, ">": 5, "<=": 5, ">=": 5, "in": 5, "not": 5, "contains": 5, "startsWith": 5, "endsWith": 5, "matches": 5, "+": 6, "-": 6, "*": 7, "/": 7, "%": 7, "**": 8}


def tokens(source: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while source[at:].strip():
        m = TOKEN.match(source, at)
        if not m:
            raise ExpressionError(f"unexpected character at {at}: {source!r}")
        kind = m.lastgroup
        value = m[kind]
        if kind == "string":
            value = value[1:-1] if value[0] == "`" else re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], e[1]), value[1:-1])
        out.append((kind, value))
        at = m.end()
    return [*out, ("end", "")]


def lit(value: object) -> Typed:
    kind = "bool" if isinstance(value, bool) else "number" if isinstance(value, (int, float)) else "string"
    return Typed(kind, F.lit(value), literal=value)


class Reader:
    def __init__(self, source: str, env: Env):
        self.source, self.env, self.list, self.at = source, dict(env), tokens(source), 0

    def fail(self, why: str) -> ExpressionError:
        return ExpressionError(f"{why} in {self.source!r}")

    def peek(self) -> tuple[str, str]:
        return self.list[self.at]

    def take(self, *values: str) -> str | None:
        kind, value = self.peek()
        if kind in ("op", "name") and value in values:
            self.at += 1
            return value
        return None

    def need(self, value: str) -> None:
        if not self.take(value):
            raise self.fail(f"expected {value!r} before {self.peek()[1]!r}")

    def want(self, x: Typed, *kinds: str) -> Typed:
        if x.kind not in kinds:
            raise self.fail(f"{x.kind} where {' or '.join(kinds)} is needed")
        return x

    def whole(self) -> Typed:
        while self.take("let"):
            kind, name = self.peek()
            if kind != "name":
                raise self.fail("expected a name after let")
            self.at += 1
            self.need("=")
            self.env[name] = self.choice()
            self.need(";")
        out = self.choice()
        if self.peek()[0] != "end":
            raise self.fail(f"unexpected {self.peek()[1]!r}")
        return out

    def choice(self) -> Typed:
        test = self.binary(0)
        if not self.take("?"):
            return test
        self.want(test, "bool")
        yes = self.choice()
        self.need(":")
        no = self.choice()
        self.want(no, yes.kind)
        return Typed(yes.kind, F.when(test.column, yes.column).otherwise(no.column))

    def binary(self, least: int) -> Typed:
        left = self.unary()
        while True:
            kind, op = self.peek()
            if kind not in ("op", "name") or BINDS.get(op, -1) <= least:
                return left
            self.at += 1
            negated = op == "not"
            if negated:
                op = self.take("in", "contains", "startsWith", "endsWith", "matches")
                if not op:
                    raise self.fail("expected an operator after not")
            out = self.apply(op, left, self.binary(BINDS[op]))
            left = Typed("bool", ~out.column) if negated else out

    def unary(self) -> Typed:
        if self.take("!", "not"):
            return Typed("bool", ~self.want(self.binary(BINDS["=="]) if self.list[self.at - 1][1] == "not" else self.unary(), "bool").column)
        if self.take("-"):
            x = self.want(self.unary(), "number")
            return Typed("number", -x.column, literal=-x.literal if x.literal is not None else None)
        self.take("+")
        return self.postfix(self.primary())

    def primary(self) -> Typed:
        kind, value = self.peek()
        self.at += 1
        if kind == "number":
            return lit(float(value) if "." in value else int(value))
        if kind == "string":
            return lit(value)
        if kind == "op" and value == "(":
            out = self.choice()
            self.need(")")
            return out
        if kind == "op" and value == "[":
            items = self.arguments("]")
            kinds = {x.kind for x in items}
            if len(kinds) > 1:
                raise self.fail("mixed array")
            return Typed("array", F.array(*[x.column for x in items]), literal=[x.literal for x in items])
        if kind == "name" and value in ("true", "false"):
            return lit(value == "true")
        if kind == "name" and value in ("nil", "null"):
            return Typed("nil", F.lit(None))
        if kind == "name" and self.take("("):
            return self.call(value, self.arguments(")"))
        if kind == "name" and value in self.env:
            return self.env[value]
        raise self.fail(f"unknown name {value}" if kind == "name" else f"unexpected {value!r}")

    def arguments(self, end: str) -> list[Typed]:
        out: list[Typed] = []
        while not self.take(end):
            if out:
                self.need(",")
            out.append(self.choice())
        return out

    def postfix(self, x: Typed) -> Typed:
        while True:
            if self.take(".", "?."):
                _, name = self.peek()
                self.at += 1
                if x.fields and name in x.fields:
                    x = x.fields[name]
                elif self.take("("):
                    x = self.call(name, [x, *self.arguments(")")])
                else:
                    raise self.fail(f"unknown field {name}")
            elif self.take("["):
                i = self.want(self.choice(), "number")
                self.need("]")
                self.want(x, "array")
                at = F.when(i.column < 0, i.column).otherwise(i.column + 1).cast("int")
                x = Typed("string", F.try_element_at(x.column, at))
            elif self.take("|"):
                _, name = self.peek()
                self.at += 1
                self.need("(")
                x = self.call(name, [x, *self.arguments(")")])
            else:
                return x

    def apply(self, op: str, a: Typed, b: Typed) -> Typed:
        if op in ("&&", "and", "||", "or"):
            self.want(a, "bool")
            self.want(b, "bool")
            return Typed("bool", a.column & b.column if op in ("&&", "and") else a.column | b.column)
        if op in ("==", "!="):
            if a.kind != b.kind and "nil" not in (a.kind, b.kind):
                raise self.fail(f"{a.kind} compared to {b.kind}")
            same = a.column.eqNullSafe(b.column)
            return Typed("bool", same if op == "==" else ~same)
        if op == "??":
            return Typed(b.kind if a.kind == "nil" else a.kind, F.coalesce(a.column, b.column))
        if op == "in":
            if b.kind == "array":
                return Typed("bool", F.coalesce(F.array_contains(b.column, a.column), F.lit(False)))
            raise self.fail("in needs an array")
        if op in ("contains", "startsWith", "endsWith", "matches"):
            self.want(a, "string")
            self.want(b, "string")
            if op == "matches":
                if b.literal is None:
                    raise self.fail("matches needs a literal pattern")
                return Typed("bool", a.column.rlike(to_java(b.literal)))
            return Typed("bool", {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}[op](a.column, b.column))
        if op in ("<", ">", "<=", ">="):
            self.want(a, "number", "string")
            self.want(b, a.kind)
            return Typed("bool", {"<": a.column < b.column, ">": a.column > b.column, "<=": a.column <= b.column, ">=": a.column >= b.column}[op])
        if op == "+" and a.kind == "string":
            self.want(b, "string")
            return Typed("string", F.concat(a.column, b.column))
        self.want(a, "number")
        self.want(b, "number")
        return Typed("number", {"+": a.column + b.column, "-": a.column - b.column, "*": a.column * b.column, "/": a.column / b.column, "%": a.column % b.column, "**": F.pow(a.column, b.column)}[op])

    def call(self, name: str, args: list[Typed]) -> Typed:
        kinds = tuple(x.kind for x in args)
        for shape, kind, make in FUNCTIONS.get(name, []):
            if shape == kinds:
                return Typed(kind, make(*[x.column for x in args]))
        raise self.fail(f"no function {name}({', '.join(kinds)})")


#: name -> (kinds of arguments, kind of result, column).
FUNCTIONS: dict[str, list[tuple[tuple[str, ...], str, Callable[..., Column]]]] = {
    "lower": [(("string",), "string", F.lower)],
    "upper": [(("string",), "string", F.upper)],
    "trim": [(("string",), "string", text.trim)],
    "trimPrefix": [(("string", "string"), "string", lambda s, p: F.when(F.startswith(s, p), F.substring(s, F.length(p) + 1, F.length(s))).otherwise(s))],
    "trimSuffix": [(("string", "string"), "string", lambda s, p: F.when(F.endswith(s, p), F.substring(s, F.lit(1), F.length(s) - F.length(p))).otherwise(s))],
    "hasPrefix": [(("string", "string"), "bool", F.startswith)],
    "hasSuffix": [(("string", "string"), "bool", F.endswith)],
    "replace": [(("string", "string", "string"), "string", F.replace)],
    "repeat": [(("string", "number"), "string", lambda s, n: F.repeat(s, n.cast("int")))],
    "indexOf": [(("string", "string"), "number", lambda s, x: F.instr(s, x) - 1)],
    "split": [(("string", "string"), "array", lambda s, x: F.split(s, F.concat(F.lit(r"\Q"), x, F.lit(r"\E")), -1))],
    "join": [(("array",), "string", lambda a: F.array_join(a, "")), (("array", "string"), "string", lambda a, x: F.replace(F.array_join(a, "\0"), F.lit("\0"), x))],
    "first": [(("array",), "string", lambda a: F.try_element_at(a, F.lit(1)))],
    "last": [(("array",), "string", lambda a: F.try_element_at(a, F.lit(-1)))],
    "len": [(("string",), "number", F.length), (("array",), "number", F.size)],
    "words": [(("string",), "array", text.identifier_words)],
    "abs": [(("number",), "number", F.abs)],
    "ceil": [(("number",), "number", F.ceil)],
    "floor": [(("number",), "number", F.floor)],
    "round": [(("number",), "number", F.round)],
    "max": [(("number", "number"), "number", F.greatest)],
    "min": [(("number", "number"), "number", F.least)],
    "int": [(("number",), "number", lambda x: x.cast("long")), (("string",), "number", lambda x: x.cast("long"))],
    "float": [(("number",), "number", lambda x: x.cast("double")), (("string",), "number", lambda x: x.cast("double"))],
    "string": [(("string",), "string", lambda x: x), (("number",), "string", lambda x: x.cast("string")), (("bool",), "string", lambda x: x.cast("string"))],
}


def compile_bool(source: str, env: Env) -> Column:
    """The expression as a boolean column, false where a part of it is null. Raises ExpressionError or PatternError."""
    out = Reader(source, env).whole()
    if out.kind != "bool":
        raise ExpressionError(f"{out.kind} where bool is needed in {source!r}")
    return F.coalesce(out.column, F.lit(False))


#: Variables of a finding.
NUMBERS, STRINGS = ("entropy", "name_value_similarity", "value_length", "line"), ("name", "value", "reason", "file", "path", "lang", "level", "name_path", "value_path")


def finding_env(column: Callable[[str], Column]) -> Env:
    """The variables of a finding; column(name) gives the finding's own columns."""
    env = {n: Typed("number", column(n)) for n in NUMBERS if n != "value_length"}
    env |= {n: Typed("string", F.coalesce(column(n), F.lit(""))) for n in STRINGS if n != "value"}
    env["value"] = Typed("string", column("raw_value"))
    env["value_length"] = Typed("number", F.octet_length(column("raw_value")))
    return env


def pair_env(current: Callable[[str], Column], prev: Callable[[str], Column]) -> Env:
    return finding_env(current) | {"current": Typed("finding", fields=finding_env(current)), "prev": Typed("finding", fields=finding_env(prev))}


def name_value_env(name: Column, value: Column) -> Env:
    return {"name": Typed("string", name), "value": Typed("string", value)}
