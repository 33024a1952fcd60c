"""Parser of the filter language: text to a tree of tuples (kind, ...)."""

from __future__ import annotations

import json
import re

from .values import Spelled

TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<fmt>@dsv\("[^"\\]"\)|@[A-Za-z][A-Za-z0-9_]*)|(?P<field>\.[A-Za-z_]\w*)"""
    r"""|(?P<var>\$(?:__loc__|[A-Za-z_]\w*(?:::[A-Za-z_]\w*)*))|(?P<name>[A-Za-z_]\w*(?:::[A-Za-z_]\w*)*)|(?P<str>")"""
    r"""|(?P<op>\*=[+?ndc]+(?=[\s.$(])|\*[+?ndc]+(?=\s+[.$(\[{])|\?//=?|\|=|\+=|-=|\*=|/=|%=|//=|==|!=|<=|>=|\?//|//|\.\.|[|,.\[\](){}:;=<>+\-*/%?$])""",
    re.X,
)
ASSIGN = {"=", "|=", "+=", "-=", "*=", "/=", "%=", "//="}
COMPARE = {"==", "!=", "<", "<=", ">", ">="}


class FilterError(ValueError):
    """A filter that can't be parsed."""


def tokens(text: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise FilterError(f"unexpected {text[at]!r} at {at}")
        at = m.end()
        if m.lastgroup == "str":
            parts, at = _string(text, at)
            out.append(("str", parts))
        elif m.lastgroup:
            out.append((m.lastgroup, m[m.lastgroup]))
    return [*out, ("end", "")]


def _string(text: str, at: int) -> tuple[list[object], int]:
    """The parts of a string from its first character on: text, and trees of what is interpolated."""
    parts: list[object] = []
    raw = ""
    while True:
        if at >= len(text):
            raise FilterError("string without an end")
        c = text[at]
        if c == '"':
            parts.append(json.loads(f'"{raw}"', strict=False))
            return parts, at + 1
        if c == "\\" and text[at + 1 : at + 2] == "(":
            parts.append(json.loads(f'"{raw}"', strict=False))
            depth, end, inner = 1, at + 2, False
            while depth:
                if end >= len(text):
                    raise FilterError("interpolation without an end")
                if inner and text[end] == "\\":
                    end += 1
                elif text[end] == '"':
                    inner = not inner
                elif not inner:
                    depth += {"(": 1, ")": -1}.get(text[end], 0)
                end += 1
            parts.append(parse(text[at + 2 : end - 1]))
            raw, at = "", end
        elif c == "\\":
            raw += text[at : at + 2]
            at += 2
        else:
            raw += c
            at += 1


def _plain(token: tuple[str, object]) -> object:
    """An operator without the flags of a merge."""
    v = token[1]
    return ("*=" if v.startswith("*=") else "*") if token[0] == "op" and v[0] == "*" else v


class Parser:
    def __init__(self, text: str) -> None:
        self.t, self.at = tokens(text), 0

    def peek(self, value: object = None) -> bool:
        kind, v = self.t[self.at]
        return kind in ("op", "name") and v == value

    def take(self, value: str) -> bool:
        if self.peek(value):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise FilterError(f"expected {value}, got {self.t[self.at][1]!r}")

    def next(self) -> tuple[str, object]:
        self.at += 1
        return self.t[self.at - 1]

    def body(self) -> tuple:
        """A program: definitions, and a filter that may be missing."""
        if self.t[self.at][0] == "end":
            return ("identity",)
        if self.peek("def"):
            d = self.definition()
            return ("def", d, self.body())
        return self.pipe()

    def pipe(self) -> tuple:
        if self.peek("def"):
            d = self.definition()
            return ("def", d, self.pipe())
        left = self.comma()
        return ("pipe", left, self.pipe()) if self.take("|") else left

    def comma(self) -> tuple:
        left = self.binary(0)
        while self.take(","):
            left = ("comma", left, self.binary(0))
        return left

    LEVELS = (None, ({"//"}, "right"), (ASSIGN, "none"), ({"or"}, "left"), ({"and"}, "left"), (COMPARE, "none"), ({"+", "-"}, "left"), ({"*", "/", "%"}, "left"))

    def binary(self, level: int) -> tuple:
        if level == 0:
            return self.binary(1)
        if level == len(self.LEVELS):
            term = self.postfix()
            if not self.take("as"):
                return term
            patterns = [self.pattern()]
            while self.take("?//"):
                patterns.append(self.pattern())
            self.need("|")
            return ("as", term, patterns, self.pipe())
        ops, side = self.LEVELS[level]
        left = self.binary(level + 1)
        while self.t[self.at][0] in ("op", "name") and _plain(self.t[self.at]) in ops:
            op = self.next()[1]
            right = self.binary(level if side == "right" else level + 1)
            left = ("assign", op, left, right) if op in ASSIGN or op.startswith("*=") else (op, left, right) if op in ("and", "or", "//") else ("binary", op, left, right)
            if side == "none":
                break
        return left

    def definition(self) -> tuple:
        self.need("def")
        name, params = self.next()[1], []
        if self.take("("):
            while True:
                params.append(self.next()[1])
                if not self.take(";"):
                    break
            self.need(")")
        self.need(":")
        body = self.pipe()
        self.need(";")
        return (name, params, body)

    def pattern(self) -> tuple:
        kind, v = self.next()
        if kind == "var":
            return ("var", v[1:])
        if v == "[":
            items = [self.pattern()]
            while self.take(","):
                items.append(self.pattern())
            self.need("]")
            return ("array", items)
        if v == "{":
            items = []
            while True:
                kind, v = self.next()
                if kind == "var":
                    key, bind = ("literal", v[1:]), v[1:]
                elif v == "(":
                    key, bind = self.pipe(), None
                    self.need(")")
                else:
                    key, bind = (self.interpolated(v, None) if kind == "str" else ("literal", v)), None
                sub = self.pattern() if self.take(":") else None
                items.append((key, bind, sub))
                if not self.take(","):
                    break
            self.need("}")
            return ("object", items)
        raise FilterError(f"not a pattern: {v!r}")

    def interpolated(self, parts: list[object], fmt: str | None) -> tuple:
        return ("literal", parts[0]) if len(parts) == 1 else ("string", parts, fmt)

    def postfix(self) -> tuple:
        e = self.primary()
        while True:
            kind, v = self.t[self.at]
            if kind == "field":
                self.at += 1
                e = ("index", e, ("literal", v[1:]))
            elif kind == "op" and v == "." and self.t[self.at + 1][0] == "str":
                self.at += 1
                e = ("index", e, self.interpolated(self.next()[1], None))
            elif kind == "op" and v == "." and self.t[self.at + 1] == ("op", "["):
                self.at += 1
            elif kind == "op" and v == "[":
                e = self.bracket(e)
            elif kind == "op" and v == "?":
                self.at += 1
                e = ("try", e, None)
            else:
                return e

    def bracket(self, e: tuple) -> tuple:
        self.need("[")
        if self.take("]"):
            return ("iterate", e)
        if self.take(":"):
            hi = self.pipe()
            self.need("]")
            return ("slice", e, None, hi)
        lo = self.pipe()
        if self.take(":"):
            hi = None if self.peek("]") else self.pipe()
            self.need("]")
            return ("slice", e, lo, hi)
        self.need("]")
        return ("index", e, lo)

    def primary(self) -> tuple:  # noqa: C901, PLR0911, PLR0912
        kind, v = self.next()
        if kind == "num":
            return ("literal", Spelled(v) if re.search(r"[.eE]", v) else int(v))
        if kind == "str":
            return self.interpolated(v, None)
        if kind == "fmt":
            if v.startswith("@dsv("):
                v = "@dsv:" + v[6:-2]
            if self.t[self.at][0] == "str":
                return ("string", self.next()[1], v)
            return ("format", v)
        if kind == "field":
            return ("index", ("identity",), ("literal", v[1:]))
        if kind == "var":
            return ("loc",) if v == "$__loc__" else ("var", v[1:])
        if v == "(":
            e = self.pipe()
            self.need(")")
            return e
        if v == "[":
            if self.take("]"):
                return ("literal", [])
            e = self.pipe()
            self.need("]")
            return ("collect", e)
        if v == "{":
            return self.object()
        if v == "-":
            return ("negate", self.postfix())
        if v == "..":
            return ("call", "recurse", [])
        if v == ".":
            if self.t[self.at][0] == "str":
                return ("index", ("identity",), self.interpolated(self.next()[1], None))
            return ("identity",)
        if kind == "name":
            return self.named(v)
        raise FilterError(f"unexpected {v!r}")

    def named(self, v: str) -> tuple:
        if v == "if":
            c = self.pipe()
            self.need("then")
            a = self.pipe()
            if self.take("elif"):
                self.at -= 1
                self.t[self.at] = ("name", "if")
                self.at += 1
                return ("if", c, a, self.named("if"))
            b = self.pipe() if self.take("else") else ("identity",)
            self.need("end")
            return ("if", c, a, b)
        if v == "try":
            body = self.postfix()
            return ("try", body, self.postfix() if self.take("catch") else None)
        if v in ("reduce", "foreach"):
            source = self.postfix()
            self.need("as")
            patterns = [self.pattern()]
            while self.take("?//"):
                patterns.append(self.pattern())
            self.need("(")
            parts = [self.pipe()]
            while self.take(";"):
                parts.append(self.pipe())
            self.need(")")
            return (v, source, patterns, *parts, *[None] * (3 - len(parts)))
        if v == "label":
            name = self.next()[1][1:]
            self.need("|")
            return ("label", name, self.pipe())
        if v == "break":
            return ("break", self.next()[1][1:])
        if v == "def":
            self.at -= 1
            d = self.definition()
            return ("def", d, self.pipe())
        if v in ("true", "false", "null"):
            return ("literal", {"true": True, "false": False, "null": None}[v])
        args = []
        if self.take("("):
            args.append(self.pipe())
            while self.take(";"):
                args.append(self.pipe())
            self.need(")")
        return ("call", v, args)

    def object(self) -> tuple:
        items = []
        while not self.take("}"):
            kind, v = self.next()
            if kind == "var":
                key, value = ("literal", v[1:]), ("var", v[1:])
            elif v == "(" and kind == "op":
                key, value = self.pipe(), None
                self.need(")")
            elif kind == "str":
                key = self.interpolated(v, None)
                value = ("index", ("identity",), key)
            elif kind == "fmt":
                key = ("string", self.next()[1], v) if self.t[self.at][0] == "str" else ("format", v)
                value = ("index", ("identity",), key)
            elif kind in ("name", "num"):
                key, value = ("literal", v), ("index", ("identity",), ("literal", v))
            else:
                raise FilterError(f"not a key: {v!r}")
            if self.take(":"):
                value = self.binary(0)
                while self.take("|"):
                    value = ("pipe", value, self.binary(0))
            if value is None:
                raise FilterError("a computed key needs a value")
            items.append((key, value))
            if not self.take(","):
                self.need("}")
                break
        return ("object", items)


def parse_program(text: str) -> tuple[dict, list[dict], tuple]:
    """A program's module metadata, its imports (path, as, data, meta), and its tree; a module without a body is the identity."""
    p = Parser(text)
    meta: dict = {}
    imports: list[dict] = []
    if p.take("module"):
        meta = _constant(p.postfix())
        p.need(";")
    while p.peek("import") or p.peek("include"):
        word = p.next()[1]
        kind, parts = p.next()
        if kind != "str" or len(parts) != 1:
            raise FilterError("a module is named by a string")
        found = {"path": parts[0], "as": None, "data": False, "meta": {}}
        if word == "import":
            p.need("as")
            kind, name = p.next()
            found |= {"as": name.lstrip("$"), "data": kind == "var"}
        if not p.peek(";"):
            found["meta"] = _constant(p.postfix())
        p.need(";")
        imports.append(found)
    tree = p.body()
    if p.t[p.at][0] != "end":
        raise FilterError(f"unexpected {p.t[p.at][1]!r}")
    return meta, imports, tree


def _constant(e: tuple) -> dict:
    match e:
        case ("object", items):
            return {k[1]: _constant(v) for k, v in items}
        case ("collect", inner):
            return [_constant(x) for x in _parts(inner)]
        case ("literal", x):
            return x
    raise FilterError("metadata must be constant")


def _parts(e: tuple) -> list[tuple]:
    return [*_parts(e[1]), *_parts(e[2])] if e[0] == "comma" else [e]


def parse(text: str) -> tuple:
    """The tree of a program without imports."""
    _, imports, tree = parse_program(text)
    if imports:
        raise FilterError(f"module not found: {imports[0]['path']}")
    return tree
