"""Evaluation of parsed filters on values: what no Spark plan expresses runs here, on Arrow batches."""

from __future__ import annotations

import base64
import calendar
import datetime as dt
import functools
import html
import itertools
import json
import math
import os
import random
import time
import urllib.parse
import zoneinfo
from collections.abc import Callable, Iterator
from typing import Any

import regex

from ..sources import yaml12

from . import spans
from . import values as V
from .parser import parse
from .values import Break, Raised, equal, fault, key, kind, text, truthy

Path = tuple[list | None, Any]


class Halt(Exception):
    """The end of a program, with what it says."""

    def __init__(self, message: str | None, status: int) -> None:
        super().__init__(message)
        self.message, self.status = message, status


class Env:
    """Variables and definitions in scope, and what the whole run has: inputs, mode, modules, and where its document comes from."""

    __slots__ = ("funcs", "run", "vars")

    def __init__(self, variables: dict, funcs: dict, run: Run) -> None:
        self.vars, self.funcs, self.run = variables, funcs, run

    @property
    def mode(self) -> str:
        return self.run.mode

    def bind(self, **more: Any) -> Env:
        return Env(self.vars | more, self.funcs, self.run)

    def define(self, name: str, arity: int, closure: Callable) -> Env:
        return Env(self.vars, self.funcs | {(name, arity): closure}, self.run)


class Run:
    """What is the same everywhere in a run; read counts the inputs that were read."""

    def __init__(self, root: Any, inputs: Iterator | None, mode: str, modules: dict, info: dict) -> None:
        self.root, self.inputs, self.mode, self.modules, self.info, self.read = root, inputs, mode, modules, info, 0
        self._places: dict[str, list] | None = None

    def place(self, path: list | None) -> list | None:
        """What the source says about a place: path, tag, anchor, style, kind, line, column, comment."""
        if path is None or not self.info.get("places"):
            return None
        if self._places is None:
            self._places = {json.dumps(p[0]): p for p in json.loads(self.info["places"])}
        return self._places.get(json.dumps(path))


def run(e: tuple, v: Any, env: Env) -> Iterator[Any]:
    for _, x in walk(e, (None, v), env):
        yield x


def run_at(e: tuple, at: Path, env: Env) -> Iterator[Any]:
    """The outputs for a value whose place is known, for operators that ask for it."""
    for _, x in walk(e, at, env):
        yield x


def paths(e: tuple, v: Any, env: Env) -> Iterator[Path]:
    for p, x in walk(e, ([], v), env):
        if p is None:
            raise fault(f"Invalid path expression with result {V.short(x)}")
        yield p, x


def step(at: Path, k: Any) -> Path:
    p, v = at
    return (None if p is None else [*p, k]), V.index(v, k)


def walk(e: tuple, at: Path, env: Env) -> Iterator[Path]:  # noqa: C901, PLR0912, PLR0915
    """The outputs of e with their paths; a path is None where none is asked for or the value is computed."""
    path, v = at
    match e:
        case ("identity",):
            yield at
        case ("literal", x):
            yield None, x
        case ("pipe", a, b):
            for x in walk(a, at, env):
                yield from walk(b, x, env)
        case ("comma", a, b):
            yield from walk(a, at, env)
            yield from walk(b, at, env)
        case ("index", a, k):
            for i in [k[1]] if k[0] == "literal" else run_at(k, at, env):
                for x in walk(a, at, env):
                    yield step(x, i)
        case ("slice", a, lo, hi):
            for x in walk(a, at, env):
                for h in run_at(hi, at, env) if hi else [None]:
                    for b in run_at(lo, at, env) if lo else [None]:
                        yield (None if x[0] is None else [*x[0], {"start": b, "end": h}]), V.cut(x[1], b, h)
        case ("iterate", a):
            for x in walk(a, at, env):
                for k, y in V.items(x[1]):
                    yield (None if x[0] is None else [*x[0], k]), y
        case ("collect", a):
            yield None, list(run_at(a, at, env))
        case ("object", items):
            for x in _objects(items, at, env):
                yield None, x
        case ("negate", a):
            for x in run_at(a, at, env):
                if kind(x) != "number":
                    raise fault(f"{kind(x)} ({V.short(x)}) cannot be negated")
                yield None, -x
        case ("binary", op, a, b):
            for y in run_at(b, at, env):
                for x in run_at(a, at, env):
                    yield None, _compare(op, x, y, env) if op in COMPARISONS else _merged(x, y, op[1:]) if len(op) > 1 or _merges(op, x, y, env) else V.arithmetic(op, x, y)
        case ("and", a, b):
            for x in run_at(a, at, env):
                if not truthy(x):
                    yield None, False
                else:
                    for y in run_at(b, at, env):
                        yield None, truthy(y)
        case ("or", a, b):
            for x in run_at(a, at, env):
                if truthy(x):
                    yield None, True
                else:
                    for y in run_at(b, at, env):
                        yield None, truthy(y)
        case ("//", a, b):
            some = False
            try:
                for x in walk(a, at, env):
                    if truthy(x[1]):
                        some = True
                        yield x
            except Raised:
                pass
            if not some:
                yield from walk(b, at, env)
        case ("if", c, a, b):
            for x in run_at(c, at, env):
                yield from walk(a if truthy(x) else b, at, env)
        case ("try", a, handler):
            try:
                yield from walk(a, at, env)
            except Raised as r:
                if handler is not None:
                    yield from walk(handler, (None, r.value), env)
            except Break:
                if handler is None:
                    raise
                yield from walk(handler, (None, {"__jq": 0}), env)
        case ("string", parts, fmt):
            for s in _interpolated(parts, fmt, at, env):
                yield None, s
        case ("format", f):
            yield None, formatted(f, v)
        case ("var", name):
            if name == "ENV":
                yield None, dict(os.environ)
            elif name not in env.vars:
                raise fault(f"${name} is not defined")
            else:
                yield None, env.vars[name]
        case ("loc",):
            yield None, {"file": "<top-level>", "line": 1}
        case ("as", a, patterns, body):
            for x in run_at(a, at, env):
                yield from _matched(x, patterns, v, env, lambda inner: walk(body, at, inner))
        case ("reduce", a, patterns, init, update, _):
            for acc in run_at(init, at, env):
                for x in run_at(a, at, env):
                    new = None
                    for inner in _bindings(x, patterns[0], v, env):
                        for new in run(update, acc, inner):  # noqa: B007
                            pass
                        acc = new
                yield None, acc
        case ("foreach", a, patterns, init, update, extract):
            for acc in run_at(init, at, env):
                for x in run_at(a, at, env):
                    for inner in _bindings(x, patterns[0], v, env):
                        before, acc = acc, None
                        for new in run(update, before, inner):
                            acc = new
                            yield from ((None, y) for y in run(extract, new, inner)) if extract else [(None, new)]
        case ("def", (name, params, body), rest):
            yield from walk(rest, at, env.define(name, len(params), _closure(name, params, body, env)))
        case ("label", name, body):
            mark = object()
            try:
                yield from walk(body, at, env.bind(**{f"*{name}": mark}))
            except Break as b:
                if b.label is not mark:
                    raise
        case ("break", name):
            raise Break(env.vars.get(f"*{name}"))
        case ("assign", op, target, value):
            for x in _assigned(op, target, value, v, env):
                yield None, x
        case ("call", name, args):
            yield from _call(name, args, at, env)
        case ("import", name, module, rest):
            yield from walk(rest, at, _imported(name, module, env))
        case _:
            raise AssertionError(e)


def _merges(op: str, a: Any, b: Any, env: Env) -> bool:
    """Whether * merges in yq's way, where arrays are replaced."""
    return op == "*" and env.mode == "yq" and isinstance(b, (list, dict))


def _merged(a: Any, b: Any, flags: str) -> Any:
    """b merged into a: + appends arrays, d merges them by index, ? takes only what a has, n only what it hasn't, c says nothing about values."""
    if a is None and isinstance(b, dict) and "?" in flags:
        a = {}
    if isinstance(a, dict) and isinstance(b, dict):
        out = dict(a)
        for k, x in b.items():
            there = k in a
            if there:
                out[k] = _merged(a[k], x, flags)
            elif "?" not in flags:
                out[k] = x
        return out
    if isinstance(a, list) and isinstance(b, list):
        if "d" in flags:
            out = [_merged(x, y, flags) for x, y in zip(a, b, strict=False)]
            return out + a[len(b) :] + b[len(a) :]
        if "+" in flags:
            return a if "n" in flags else a + b
    return a if "n" in flags and a is not None else b


COMPARISONS = {"==", "!=", "<", "<=", ">", ">="}


def _compare(op: str, x: Any, y: Any, env: Env) -> bool:
    if op in ("==", "!=") and env.mode == "yq" and kind(x) == kind(y) == "number" and isinstance(x, int) != isinstance(y, int):
        return op == "!="
    c = V.compare(x, y)
    return {"==": c == 0, "!=": c != 0, "<": c < 0, "<=": c <= 0, ">": c > 0, ">=": c >= 0}[op]


def _imported(name: str | None, module: tuple, env: Env) -> Env:
    """The scope with a module's functions, under its name or, included, under their own."""
    inner = Env(env.vars, {}, env.run)
    out = dict(env.funcs)
    while module[0] in ("import", "as", "def"):
        if module[0] == "import":
            inner, module = _imported(module[1], module[2], inner), module[3]
        elif module[0] == "as":
            inner, module = inner.bind(**{module[2][0][1]: module[1][1]}), module[3]
        else:
            (f, params, body), module = module[1], module[2]
            inner = inner.define(f, len(params), _closure(f, params, body, inner))
            out[f if name is None else f"{name}::{f}", len(params)] = inner.funcs[f, len(params)]
    return Env(env.vars, out, env.run)


def no_key(v: Any) -> Raised:
    return fault(f"Cannot use {kind(v)} ({V.short(v)}) as object key")


def _objects(items: list, at: Path, env: Env) -> Iterator[dict]:
    if not items:
        yield {}
        return
    (k, e), *rest = items
    for name in run_at(k, at, env):
        if not isinstance(name, str):
            raise no_key(name)
        for x in run_at(e, at, env):
            for more in _objects(rest, at, env):
                yield {name: x} | more


def _interpolated(parts: list, fmt: str | None, at: Path, env: Env) -> Iterator[str]:
    if not parts:
        yield ""
        return
    first, rest = parts[0], parts[1:]
    for tail in _interpolated(rest, fmt, at, env):
        if isinstance(first, str):
            yield first + tail
        else:
            for x in run_at(first, at, env):
                yield (formatted(fmt, x) if fmt else text(x)) + tail


def _closure(name: str, params: list[str], body: tuple, env: Env) -> Callable:
    def call(args: list[tuple], at: Path, caller: Env) -> Iterator[Path]:
        inner = Env(env.vars, env.funcs | {(name, len(params)): call}, env.run)

        def bound(k: int, scope: Env) -> Iterator[Path]:
            if k == len(params):
                yield from walk(body, at, scope)
                return
            p, a = params[k], args[k]
            given = lambda _args, where, _caller: walk(a, where, caller)
            if p.startswith("$"):
                for x in run(a, at[1], caller):
                    yield from bound(k + 1, scope.bind(**{p[1:]: x}).define(p[1:], 0, lambda _a, _w, _c, x=x: iter([(None, x)])))
            else:
                yield from bound(k + 1, scope.define(p, 0, given))

        yield from bound(0, inner)

    return call


def _names(pattern: tuple) -> set[str]:
    match pattern:
        case ("var", n):
            return {n}
        case ("array", items):
            return set().union(*map(_names, items))
        case (_, items):
            return set().union(*(({b} if b else set()) | (_names(s) if s else set()) for _, b, s in items))


def _bindings(x: Any, pattern: tuple, v: Any, env: Env) -> Iterator[Env]:
    match pattern:
        case ("var", n):
            yield env.bind(**{n: x})
        case ("array", items):
            if x is not None and not isinstance(x, list):
                raise fault(f"Cannot index {kind(x)} with number")

            def each(k: int, scope: Env) -> Iterator[Env]:
                if k == len(items):
                    yield scope
                    return
                for inner in _bindings(V.index(x, k), items[k], v, scope):
                    yield from each(k + 1, inner)

            yield from each(0, env)
        case (_, items):

            def every(k: int, scope: Env) -> Iterator[Env]:
                if k == len(items):
                    yield scope
                    return
                name, bind, sub = items[k]
                for n in run(name, v, scope):
                    y = V.index(x, n)
                    inner = scope.bind(**{bind: y}) if bind else scope
                    for s in _bindings(y, sub, v, inner) if sub else [inner]:
                        yield from every(k + 1, s)

            yield from every(0, env)


def _matched(x: Any, patterns: list, v: Any, env: Env, body: Callable[[Env], Iterator[Path]]) -> Iterator[Path]:
    scope = env.bind(**dict.fromkeys(set().union(*map(_names, patterns)))) if len(patterns) > 1 else env
    for k, p in enumerate(patterns):
        try:
            for inner in _bindings(x, p, v, scope):
                yield from body(inner)
            return
        except Raised:
            if k == len(patterns) - 1:
                raise


def _assigned(op: str, target: tuple, value: tuple, v: Any, env: Env) -> Iterator[Any]:
    if op == "|=":
        out, gone = v, []
        for p, _ in list(paths(target, v, env)):
            new = next(run(value, V.get_path(out, p), env), fault)
            if new is fault:
                gone.append(p)
            else:
                out = V.set_path(out, p, new)
        yield V.delete_paths(out, gone)
        return
    for x in run(value, v, env):
        out = v
        for p, old in list(paths(target, v, env)):
            old = V.get_path(out, p)
            new = x if op == "=" else (old if truthy(old) else x) if op == "//=" else _merged(old, x, op[2:]) if len(op) > 2 or _merges(op[0], old, x, env) else V.arithmetic(op[0], old, x)
            out = V.set_path(out, p, new)
        yield out


def formatted(f: str, v: Any) -> str:  # noqa: C901, PLR0911
    def cells(quote: Callable[[str], str], null: str = "") -> list[str]:
        if not isinstance(v, list):
            raise fault(f"{kind(v)} ({V.short(v)}) cannot be {f[1:]}-formatted, only an array can be")
        out = []
        for x in v:
            if isinstance(x, (list, dict)):
                raise fault(f"{kind(x)} ({V.short(x)}) is not valid in a csv row")
            out.append(null if x is None else quote(x) if isinstance(x, str) else text(x))
        return out

    if f.startswith("@dsv"):
        return f[5:].join(cells(lambda s: '"' + s.replace('"', '""') + '"'))
    match f:
        case "@text":
            return text(v)
        case "@json":
            return V.dump(v)
        case "@csv":
            return ",".join(cells(lambda s: '"' + s.replace('"', '""') + '"'))
        case "@tsv":
            return "\t".join(cells(lambda s: s.replace("\\", "\\\\").replace("\t", "\\t").replace("\n", "\\n").replace("\r", "\\r")))
        case "@html":
            return html.escape(text(v)).replace("&#x27;", "&#39;")
        case "@uri":
            return urllib.parse.quote(text(v), safe="-_.~")
        case "@urid":
            return urllib.parse.unquote(text(v))
        case "@sh":
            quote = lambda x: "'" + x.replace("'", "'\\''") + "'" if isinstance(x, str) else text(x)
            if any(isinstance(x, (list, dict)) for x in (v if isinstance(v, list) else [v])):
                raise fault(f"{kind(v)} ({V.short(v)}) can not be escaped for shell")
            return " ".join(map(quote, v)) if isinstance(v, list) else quote(v)
        case "@base64":
            return base64.b64encode(text(v).encode()).decode()
        case "@base64d":
            s = text(v).split("=")[0]
            try:
                return base64.b64decode(s + "=" * (-len(s) % 4)).decode("utf-8", "replace")
            except ValueError:
                raise fault(f"string ({V.short(v)}) is not valid base64 data") from None
        case "@yaml":
            return yaml12.emit(v)
        case "@props":
            return "\n".join(f"{'.'.join(map(str, p))} = {text(x)}" for p, x in leaves([], v))
    raise fault(f"{f[1:]} is not a valid format")


def leaves(path: list, v: Any) -> Iterator[tuple[list, Any]]:
    if isinstance(v, (list, dict)) and v:
        for k, x in V.items(v):
            yield from leaves([*path, k], x)
    else:
        yield path, v


def everything(at: Path) -> Iterator[Path]:
    yield at
    if isinstance(at[1], (list, dict)):
        for k, x in V.items(at[1]):
            yield from everything((None if at[0] is None else [*at[0], k], x))


def events(path: list, v: Any, top: bool = True) -> Iterator[list]:
    if isinstance(v, (list, dict)) and v:
        last = None
        for k, x in V.items(v):
            last = [*path, k]
            yield from events(last, x, False)
        yield [last]
    else:
        yield [path, v]


def contains(a: Any, b: Any) -> bool:
    if isinstance(a, dict) and isinstance(b, dict):
        return all(k in a and contains(a[k], x) for k, x in b.items())
    if isinstance(a, list) and isinstance(b, list):
        return all(any(contains(y, x) if kind(y) == kind(x) else False for y in a) for x in b)
    if isinstance(a, str) and isinstance(b, str):
        return b in a
    if kind(a) == kind(b):
        return equal(a, b)
    raise fault(f"{kind(a)} ({V.short(a)}) and {kind(b)} ({V.short(b)}) cannot have their containment checked")


FLAGS = {"i": regex.I, "x": regex.X, "s": 0, "n": 0, "p": regex.S | regex.M, "l": 0, "g": 0, "m": regex.S}


def matches(s: Any, pattern: Any, flags: Any) -> Iterator[dict]:
    if not isinstance(s, str):
        raise fault(f"{kind(s)} ({V.short(s)}) cannot be matched, as it is not a string")
    if flags is not None and not isinstance(flags, str):
        raise fault(f"{kind(flags)} ({V.short(flags)}) is not a string")
    bits = 0
    for c in flags or "":
        if c not in FLAGS:
            raise fault(f"{flags} is not a valid modifier string")
        bits |= FLAGS[c]
    try:
        compiled = regex.compile(pattern, bits)
    except regex.error as e:
        raise fault(f"{pattern} (at offset 0) is not a valid regex: {e}") from None
    names = {k: n for n, k in compiled.groupindex.items()}

    def group(m: Any, k: int) -> dict:
        if m[k]:
            return {"offset": m.start(k), "length": len(m[k]), "string": m[k], "name": names.get(k)}
        return {"offset": m.start(k) if m[0] else m.start(), "string": m[k] if m[0] else m[k] or "", "length": 0, "name": names.get(k)}

    for m in compiled.finditer(s):
        if "n" in (flags or "") and not m[0]:
            continue
        yield {"offset": m.start(), "length": len(m[0]), "string": m[0], "captures": [group(m, k) for k in range(1, compiled.groups + 1)]}
        if "g" not in (flags or ""):
            return


def captured(m: dict) -> dict:
    return {c["name"]: c["string"] for c in m["captures"] if c["name"]}


def _numbers(v: Any) -> float:
    if kind(v) != "number":
        raise fault(f"{kind(v)} ({V.short(v)}) number required")
    return v


def _tidy(x: float) -> float:
    return int(x) if isinstance(x, float) and x == x and not math.isinf(x) and x == int(x) and abs(x) < 2**53 and not (x == 0 and math.copysign(1, x) < 0) else x


def _math(f: Callable[..., float]) -> Callable:
    def call(*xs: Any) -> float:
        try:
            return _tidy(float(f(*map(_numbers, xs))))
        except ValueError:
            return -math.inf if f in (math.log, math.log2, math.log10) and xs[0] == 0 else math.nan
        except OverflowError:
            return math.inf

    return call


def broken_down(v: Any) -> list:
    s = _numbers(v)
    t = dt.datetime.fromtimestamp(math.floor(s), dt.UTC)
    seconds = t.second + (s - math.floor(s))
    return [t.year, t.month - 1, t.day, t.hour, t.minute, _tidy(float(seconds)), (t.weekday() + 1) % 7, t.timetuple().tm_yday - 1]


@functools.cache
def _zone(name: str) -> dt.tzinfo | None:
    """The zone of a value of TZ, if it names one; listing the names walks all files of the zone database, so each value is looked up once."""
    return zoneinfo.ZoneInfo(name) if name in zoneinfo.available_timezones() else None


def _local_offset(v: float) -> float:
    """Seconds between the local zone, as TZ names it, and UTC."""
    zone = _zone(os.environ.get("TZ", "").lstrip(":"))
    return dt.datetime.fromtimestamp(v, zone).utcoffset().total_seconds() if zone else 0


def epoch(v: Any) -> int:
    if not isinstance(v, list) or len(v) < 6 or any(kind(x) != "number" for x in v):
        raise fault("mktime requires array of 6 numbers")
    y, m, d, h, mi, s = (int(x) for x in v[:6])
    y, m = y + m // 12, m % 12
    return calendar.timegm((y, m + 1, 1, 0, 0, 0)) + (d - 1) * 86400 + h * 3600 + mi * 60 + s


def strftime(v: Any, f: str) -> str:
    b = broken_down(v) if kind(v) == "number" else v
    if not isinstance(b, list):
        raise fault("strftime/1 requires parsed datetime inputs")
    return (dt.datetime(1970, 1, 1, tzinfo=dt.UTC) + dt.timedelta(seconds=epoch(b))).strftime(f)


def strptime(v: Any, f: str) -> list:
    if not isinstance(v, str):
        raise fault(f"strptime/1 requires string inputs and arguments")
    try:
        t = dt.datetime.strptime(v, f.replace("%Z", "Z") if v.endswith("Z") else f)
    except ValueError:
        raise fault(f'date "{v}" does not match format "{f}"') from None
    return broken_down(calendar.timegm(t.timetuple()) if t.tzinfo is None else int(t.timestamp()))


def flatten(v: list, depth: float) -> list:
    if depth < 0:
        raise fault("flatten depth must not be negative")
    return [y for x in v for y in (flatten(x, depth - 1) if isinstance(x, list) and depth > 0 else [x])]


def number(v: Any) -> float:
    if kind(v) == "number":
        return v
    if isinstance(v, str):
        try:
            if v.strip() == v and v and "_" not in v and v.lower().lstrip("+-") not in ("inf", "infinity", "nan"):
                return int(v) if v.lstrip("-").isdigit() else _tidy(float(v))
        except ValueError:
            pass
        raise no_number(v)
    raise fault(f"{kind(v)} ({V.short(v)}) cannot be parsed as a number")


def no_number(v: str) -> Raised:
    if v in ("null", "true", "false"):
        return fault(f"string ({V.short(v)}) cannot be parsed as a number")
    why = f"Invalid numeric literal at EOF at line 1, column {len(v.encode())}" if v.strip() else "Expected JSON value"
    return fault(f"{why} (while parsing '{v}')")


def read_json(v: Any) -> Any:
    if not isinstance(v, str):
        raise fault(f"{kind(v)} ({V.short(v)}) only strings can be parsed")
    try:
        return V.load(v)
    except ValueError as e:
        if v.strip() in ("nan", "NaN"):
            return math.nan
        if regex.fullmatch(r'[^\s\[\]{}:,"]*', v):
            raise no_number(v) from None
        raise fault(f"{e} (while parsing '{v}')") from None


def length(v: Any) -> float:
    if isinstance(v, bool):
        raise fault(f"boolean ({V.dump(v)}) has no length")
    return 0 if v is None else abs(v) if isinstance(v, (int, float)) else len(v)


def has(v: Any, k: Any) -> bool:
    if isinstance(v, dict) and isinstance(k, str):
        return k in v
    if isinstance(v, list) and kind(k) == "number":
        return 0 <= k < len(v)
    raise fault(f"Cannot check whether {kind(v)} has a {'string' if isinstance(k, str) else kind(k)} key")


def positions(v: Any, x: Any) -> Any:
    if v is None:
        return None
    if isinstance(v, str) and isinstance(x, str):
        return [i for i in range(len(v) - len(x) + 1) if x and v.startswith(x, i)]
    if isinstance(x, dict) and isinstance(v, (str, list)):
        return V.index(v, x)
    if isinstance(v, list):
        return V.index(v, x) if isinstance(x, list) else [i for i, y in enumerate(v) if equal(x, y)]
    raise V.no_index(v, x)


def place(v: Any, x: Any, k: int) -> Any:
    found = positions(v, x)
    return None if found is None else V.index(found, k)


def from_entries(v: Any) -> dict:
    out = {}
    for _, x in V.items(v):
        names = [V.index(x, n) for n in ("key", "k", "name", "K", "Key", "Name")]
        k = next(filter(truthy, names[:-1]), names[-1])
        if not isinstance(k, str):
            raise no_key(k)
        out[k] = next((x[n] for n in ("value", "v", "Value", "V") if n in x), None)
    return out


def keyed(v: Any) -> list[tuple[Any, Any]]:
    if not isinstance(v, (dict, list)):
        raise fault(f"{kind(v)} ({V.short(v)}) has no keys")
    return V.items(v)


def transpose(v: list) -> list:
    return [list(r) for r in itertools.zip_longest(*v)]


def bsearch(v: list | None, x: Any) -> int:
    lo, hi = 0, len(v or ())
    while lo < hi:
        mid = (lo + hi) // 2
        c = V.compare(v[mid], x)
        if c == 0:
            return mid
        lo, hi = (mid + 1, hi) if c < 0 else (lo, mid)
    return -1 - lo


def joined(v: Any, sep: Any) -> str:
    out = []
    for _, x in V.items(v):
        if isinstance(x, (list, dict)):
            raise fault(f"Cannot join with {kind(x)}")
        out.append("" if x is None else text(x))
    return sep.join(out)


def _strings(name: str) -> Callable[[Any, Any], bool]:
    def call(v: Any, s: Any) -> bool:
        if not (isinstance(v, str) and isinstance(s, str)):
            raise fault(f"{name}() requires string inputs")
        return getattr(v, name)(s)

    return call


def implode(v: Any) -> str:
    if not isinstance(v, list):
        raise fault("implode input must be an array")
    for c in v:
        if kind(c) != "number" or c != c:
            raise fault(f"{kind(c)} ({V.short(c)}) can't be imploded, unicode codepoint needs to be numeric")
    points = [-1 if math.isinf(c) else int(c) for c in v]
    return "".join(chr(c) if 0 <= c < 0x110000 and not 0xD800 <= c < 0xE000 else "\ufffd" for c in points)


def trimmed(f: Callable[[str], str]) -> Callable:
    def call(v: Any) -> str:
        if not isinstance(v, str):
            raise fault(f"{kind(v)} ({V.short(v)}) cannot be trimmed")
        return f(v)

    return call


SPACE = " \t\n\r\f\v"
ZERO: dict[str, Callable[[Any], Any]] = {
    "not": lambda v: not truthy(v),
    "type": kind,
    "length": length,
    "utf8bytelength": lambda v: len(v.encode()) if isinstance(v, str) else _raise(f"{kind(v)} ({V.short(v)}) only strings have UTF-8 byte length"),
    "keys": lambda v: sorted(v) if isinstance(v, dict) else list(range(len(v))) if isinstance(v, list) else _raise(f"{kind(v)} ({V.short(v)}) has no keys"),
    "keys_unsorted": lambda v: [k for k, _ in keyed(v)],
    "to_entries": lambda v: [{"key": k, "value": x} for k, x in keyed(v)],
    "from_entries": from_entries,
    "add": lambda v: _sum(x for _, x in V.items(v)) if v is not None else None,
    "any": lambda v: any(truthy(x) for _, x in V.items(v)),
    "all": lambda v: all(truthy(x) for _, x in V.items(v)),
    "flatten": lambda v: flatten([x for _, x in V.items(v)], math.inf),
    "floor": _math(math.floor),
    "ceil": _math(math.ceil),
    "sqrt": _math(math.sqrt),
    "round": _math(lambda x: math.copysign(math.floor(abs(x) + 0.5), x)),
    "trunc": _math(math.trunc),
    "fabs": _math(abs),
    "abs": lambda v: abs(_numbers(v)),
    "tostring": text,
    "tonumber": number,
    "toboolean": lambda v: v if isinstance(v, bool) else {"true": True, "false": False}[v] if v in ("true", "false") else _raise(f"{kind(v)} ({V.short(v)}) cannot be parsed as a boolean"),
    "tojson": V.dump,
    "fromjson": read_json,
    "ascii_downcase": lambda v: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in _text(v)),
    "ascii_upcase": lambda v: "".join(chr(ord(c) - 32) if "a" <= c <= "z" else c for c in _text(v)),
    "explode": lambda v: list(map(ord, v)) if isinstance(v, str) else _raise("explode input must be a string"),
    "implode": implode,
    "ltrim": trimmed(lambda s: s.lstrip(SPACE)),
    "rtrim": trimmed(lambda s: s.rstrip(SPACE)),
    "trim": trimmed(lambda s: s.strip(SPACE)),
    "reverse": lambda v: [] if v is None else v[::-1] if isinstance(v, (str, list)) else _raise(f"Cannot index {kind(v)} with number"),
    "sort": lambda v: sorted(_array(v, "sorted"), key=key),
    "unique": lambda v: [x[0] for x in groups(_listed(v), lambda y: y)],
    "min": lambda v: min(_iterated(v), key=key, default=None),
    "max": lambda v: _last_max(_iterated(v), lambda x: x),
    "transpose": transpose,
    "pivot": lambda v: transpose(v) if all(isinstance(x, list) for x in v) else {k: [x.get(k) for x in v] for k in dict.fromkeys(k for x in v for k in x)},
    "first": lambda v: V.index(v, 0),
    "last": lambda v: V.index(v, -1),
    "gmtime": broken_down,
    "localtime": lambda v: broken_down(_numbers(v) + _local_offset(v)),
    "mktime": epoch,
    "now": lambda v: time.time(),
    "todate": lambda v: strftime(v, "%Y-%m-%dT%H:%M:%SZ"),
    "fromdate": lambda v: epoch(strptime(v, "%Y-%m-%dT%H:%M:%SZ")),
    "infinite": lambda v: math.inf,
    "nan": lambda v: math.nan,
    "isinfinite": lambda v: math.isinf(_numbers(v)),
    "isnan": lambda v: _numbers(v) != v,
    "isfinite": lambda v: not math.isinf(_numbers(v)) and v == v,
    "isnormal": lambda v: _numbers(v) == v and not math.isinf(v) and abs(v) >= 2.2250738585072014e-308,
    "tojsonstream": lambda v: list(events([], v)),
    "shuffle": lambda v: random.sample(v, len(v)),
    "builtins": lambda v: sorted([f"{n}/0" for n in ZERO] + [f"{n}/{a}" for n, a in FORMS]),
    "env": lambda v: dict(os.environ),
    "null": lambda v: None,
    "debug": lambda v: v,
    "stderr": lambda v: v,
    "exp": _math(math.exp),
    "exp2": _math(lambda x: 2.0**x),
    "exp10": _math(lambda x: 10.0**x),
    "log": _math(math.log),
    "log2": _math(math.log2),
    "log10": _math(math.log10),
    "sin": _math(math.sin),
    "cos": _math(math.cos),
    "tan": _math(math.tan),
    "asin": _math(math.asin),
    "acos": _math(math.acos),
    "atan": _math(math.atan),
    "sinh": _math(math.sinh),
    "cosh": _math(math.cosh),
    "tanh": _math(math.tanh),
    "asinh": _math(math.asinh),
    "acosh": _math(math.acosh),
    "atanh": _math(math.atanh),
    "cbrt": _math(math.cbrt),
}
ZERO |= {"to_unix": ZERO["fromdate"], "from_unix": ZERO["todate"], "todateiso8601": ZERO["todate"], "fromdateiso8601": ZERO["fromdate"]}
ZERO |= {f"is{k}": lambda v, k=k: kind(v) == k for k in ("null", "boolean", "number", "string", "array", "object")}
SELECTS = {k + "s": lambda v, k=k: kind(v) == k for k in ("null", "boolean", "number", "string", "array", "object")} | {
    "values": lambda v: v is not None, "iterables": lambda v: isinstance(v, (list, dict)), "scalars": lambda v: not isinstance(v, (list, dict)), "finites": lambda v: kind(v) == "number" and math.isfinite(v), "normals": lambda v: ZERO["isnormal"](v),
}
ONE: dict[str, Callable[[Any, Any], Any]] = {
    "has": has,
    "contains": contains,
    "inside": lambda v, x: contains(x, v),
    "in": lambda v, x: has(x, v),
    "startswith": _strings("startswith"),
    "endswith": _strings("endswith"),
    "join": joined,
    "flatten": lambda v, d: flatten([x for _, x in V.items(v)], d),
    "ltrimstr": lambda v, s: v.removeprefix(s) if isinstance(v, str) and isinstance(s, str) else v,
    "rtrimstr": lambda v, s: v.removesuffix(s) if isinstance(v, str) and isinstance(s, str) and s else v,
    "split": lambda v, s: V.arithmetic("/", v, s) if isinstance(v, str) and isinstance(s, str) else _raise("split input and separator must be strings"),
    "indices": positions,
    "index": lambda v, x: place(v, x, 0),
    "rindex": lambda v, x: place(v, x, -1),
    "getpath": lambda v, p: V.get_path(v, p),
    "delpaths": lambda v, ps: V.delete_paths(v, ps),
    "bsearch": bsearch,
    "strftime": strftime,
    "strflocaltime": strftime,
    "strptime": strptime,
    "nth": lambda v, n: V.index(v, n),
    "omit": lambda v, ks: {k: x for k, x in v.items() if k not in ks} if isinstance(v, dict) else [x for i, x in enumerate(v) if i not in ks],
    "error": lambda v, m: _throw(m),
    "strenv": lambda v, n: os.environ.get(n),
    "splitat": lambda v, n: [v[:n], v[n:]],
}
MATH2 = {
    "pow": _math(math.pow),
    "atan2": _math(math.atan2),
    "fmin": _math(min),
    "fmax": _math(max),
    "fmod": _math(math.fmod),
    "ldexp": _math(lambda a, b: math.ldexp(a, int(b))),
}


def _raise(message: str) -> Any:
    raise fault(message)


def _throw(v: Any) -> Any:
    raise Raised(v)


def _text(v: Any) -> str:
    return v if isinstance(v, str) else _raise("explode input must be a string")


def _array(v: Any, what: str) -> list:
    return v if isinstance(v, list) else _raise(f"{kind(v)} ({V.short(v)}) cannot be {what}, as it is not an array")


def _listed(v: Any) -> list:
    return [x for _, x in V.items(v)]


def _iterated(v: Any) -> list:
    return v if isinstance(v, list) else _raise(f"{kind(v)} ({V.short(v)}) and {kind(v)} ({V.short(v)}) cannot be iterated over")


def _sum(xs: Any) -> Any:
    out = None
    for x in xs:
        out = V.arithmetic("+", out, x)
    return out


def _last_max(xs: list, of: Callable) -> Any:
    best = None
    for k, x in enumerate(xs):
        if k == 0 or V.compare(of(x), of(best)) >= 0:
            best = x
    return best


def groups(xs: list, of: Callable[[Any], Any]) -> list[list]:
    keyed = sorted(((of(x), x) for x in xs), key=lambda t: key(t[0]))
    out: list[list] = []
    for k, (g, x) in enumerate(keyed):
        if k and equal(g, keyed[k - 1][0]):
            out[-1].append(x)
        else:
            out.append([x])
    return out


#: What Python raises where a function isn't meant for a value.
UNFIT = (TypeError, ValueError, AttributeError, IndexError, KeyError, OverflowError, MemoryError)


def unfit(name: str, v: Any) -> Raised:
    return fault(f"{name} cannot be applied to {kind(v)} ({V.short(v)})")


def applied(name: str, f: Callable, *values: Any) -> Any:
    try:
        return f(*values)
    except UNFIT:
        raise unfit(name, values[0]) from None


def _call(name: str, args: list[tuple], at: Path, env: Env) -> Iterator[Path]:
    arity = len(args)
    if (f := env.funcs.get((name, arity))) is not None:
        yield from f(args, at, env)
    elif arity == 0 and name in SELECTS:
        if SELECTS[name](at[1]):
            yield at
    elif arity == 0 and name in ("first", "last"):
        yield step(at, 0 if name == "first" else -1)
    elif (g := FORMS.get((name, arity))) is not None:
        yield from g(args, at, env)
    elif arity == 0 and name in ZERO:
        yield None, (list(at[1]) if name == "keys" and env.mode == "yq" and isinstance(at[1], dict) else applied(name, ZERO[name], at[1]))
    elif arity == 1 and name in ONE:
        for x in run(args[0], at[1], env):
            yield None, applied(name, ONE[name], at[1], x)
    elif arity == 2 and name in MATH2:
        for b in run(args[1], at[1], env):
            for a in run(args[0], at[1], env):
                yield None, applied(name, MATH2[name], a, b)
    else:
        raise fault(f"{name}/{arity} is not defined")


FORMS: dict[tuple[str, int], Callable[[list[tuple], Path, Env], Iterator[Path]]] = {}


def form(name: str, arity: int) -> Callable:
    def add(f: Callable) -> Callable:
        FORMS[name, arity] = f
        return f

    return add


def value_form(name: str, arity: int) -> Callable:
    """A form whose outputs have no paths: f(args, value, env) yields values."""

    def outputs(f: Callable, args: list, at: Path, env: Env) -> Iterator[Path]:
        try:
            for x in f(args, at[1], env):
                yield None, x
        except UNFIT:
            raise unfit(name, at[1]) from None

    def add(f: Callable) -> Callable:
        FORMS[name, arity] = lambda args, at, env: outputs(f, args, at, env)
        return f

    return add


@form("empty", 0)
def _(args, at, env):
    return iter(())


@form("error", 0)
def _(args, at, env):
    raise Raised(at[1])


@form("select", 1)
def _(args, at, env):
    for x in run_at(args[0], at, env):
        if truthy(x):
            yield at


@form("recurse", 0)
def _(args, at, env):
    return everything(at)


FORMS["recurse_down", 0] = FORMS["recurse", 0]


@form("recurse", 1)
def _(args, at, env):
    yield at
    for x in walk(args[0], at, env):
        yield from FORMS["recurse", 1](args, x, env)


@form("recurse", 2)
def _(args, at, env):
    yield at
    for x in walk(args[0], at, env):
        for c in run(args[1], x[1], env):
            if truthy(c):
                yield from FORMS["recurse", 2](args, x, env)


@form("getpath", 1)
def _(args, at, env):
    for p in run(args[0], at[1], env):
        if not isinstance(p, list):
            raise fault("Path must be specified as an array")
        yield (None if at[0] is None else at[0] + p), V.get_path(at[1], p)


@form("first", 1)
def _(args, at, env):
    yield from itertools.islice(walk(args[0], at, env), 1)


@form("last", 1)
def _(args, at, env):
    out = fault
    for out in walk(args[0], at, env):  # noqa: B007
        pass
    if out is not fault:
        yield out


@form("limit", 2)
def _(args, at, env):
    for n in run(args[0], at[1], env):
        if n > 0:
            yield from itertools.islice(walk(args[1], at, env), math.ceil(n))


@form("skip", 2)
def _(args, at, env):
    for n in run(args[0], at[1], env):
        if n < 0:
            raise fault("Invalid arguments")
        yield from itertools.islice(walk(args[1], at, env), math.ceil(n), None)


@form("nth", 2)
def _(args, at, env):
    for n in run(args[0], at[1], env):
        if n < 0:
            raise fault("Out of bounds negative array index")
        yield from itertools.islice(walk(args[1], at, env), int(n), int(n) + 1)


@form("until", 2)
def _(args, at, env):
    if any(truthy(c) for c in itertools.islice(run(args[0], at[1], env), 1)):
        yield at
    else:
        for x in walk(args[1], at, env):
            yield from FORMS["until", 2](args, x, env)


@form("while", 2)
def _(args, at, env):
    for c in run(args[0], at[1], env):
        if truthy(c):
            yield at
            for x in walk(args[1], at, env):
                yield from FORMS["while", 2](args, x, env)


@form("repeat", 1)
def _(args, at, env):
    todo = [iter([at])]
    while todo:
        x = next(todo[-1], None)
        if x is None:
            todo.pop()
        else:
            yield x
            todo.append(walk(args[0], x, env))


@value_form("range", 1)
def _(args, v, env):
    for n in run(args[0], v, env):
        yield from _range(0, n, 1)


@value_form("range", 2)
def _(args, v, env):
    for a in run(args[0], v, env):
        for b in run(args[1], v, env):
            yield from _range(a, b, 1)


@value_form("range", 3)
def _(args, v, env):
    for a in run(args[0], v, env):
        for b in run(args[1], v, env):
            for s in run(args[2], v, env):
                yield from _range(a, b, s)


def _range(a: Any, b: Any, s: Any) -> Iterator[float]:
    if not all(kind(x) == "number" for x in (a, b, s)):
        raise fault("Range bounds must be numeric")
    while (s > 0 and a < b) or (s < 0 and a > b):
        yield a
        a += s


@value_form("map", 1)
def _(args, v, env):
    yield [y for _, x in V.items(v) for y in run(args[0], x, env)]


@value_form("map_values", 1)
def _(args, v, env):
    pairs = [(k, y) for k, x in V.items(v) for y in itertools.islice(run(args[0], x, env), 1)]
    yield dict(pairs) if isinstance(v, dict) else [y for _, y in pairs]


@value_form("with_entries", 1)
def _(args, v, env):
    yield from_entries([y for x in ZERO["to_entries"](v) for y in run(args[0], x, env)])


@value_form("walk", 1)
def _(args, v, env):
    def inner(x: Any) -> Iterator[Any]:
        if isinstance(x, list):
            x = [z for y in x for z in inner(y)]
        elif isinstance(x, dict):
            x = {k: z for k, y in x.items() for z in itertools.islice(inner(y), 1)}
        return run(args[0], x, env)

    yield from inner(v)


@value_form("path", 1)
def _(args, v, env):
    for p, _ in paths(args[0], v, env):
        yield p


@value_form("paths", 0)
def _(args, v, env):
    for p, _ in everything(([], v)):
        if p:
            yield p


@value_form("paths", 1)
def _(args, v, env):
    for p, x in everything(([], v)):
        if p and any(truthy(c) for c in run(args[0], x, env)):
            yield p


@value_form("leaf_paths", 0)
def _(args, v, env):
    for p, x in everything(([], v)):
        if p and not isinstance(x, (list, dict)):
            yield p


@value_form("del", 1)
def _(args, v, env):
    yield V.delete_paths(v, [p for p, _ in paths(args[0], v, env)])


@value_form("pick", 1)
def _(args, v, env):
    if env.mode == "yq":
        for ks in run(args[0], v, env):
            yield {k: v[k] for k in ks if k in v} if isinstance(v, dict) else [v[k] for k in ks if k < len(v)]
        return
    out = None
    for p, x in paths(args[0], v, env):
        out = V.set_path(out, p, x)
    yield out


@value_form("setpath", 2)
def _(args, v, env):
    for p in run(args[0], v, env):
        if not isinstance(p, list):
            raise fault("Path must be specified as an array")
        for x in run(args[1], v, env):
            yield V.set_path(v, p, x)


@value_form("to_array", 0)
def _(args, v, env):
    yield v if isinstance(v, list) else [v]


def _keyed(args: list, env: Env) -> Callable[[Any], list]:
    return lambda x: list(run(args[0], x, env))


@value_form("sort_by", 1)
def _(args, v, env):
    of = _keyed(args, env)
    yield sorted(_listed(v), key=lambda x: key(of(x)))


@value_form("group_by", 1)
def _(args, v, env):
    yield groups(_listed(v), _keyed(args, env))


@value_form("unique_by", 1)
def _(args, v, env):
    yield [g[0] for g in groups(_listed(v), _keyed(args, env))]


@value_form("min_by", 1)
def _(args, v, env):
    of = _keyed(args, env)
    yield min(_listed(v), key=lambda x: key(of(x)), default=None)


@value_form("max_by", 1)
def _(args, v, env):
    yield _last_max(_listed(v), _keyed(args, env))


@value_form("add", 1)
def _(args, v, env):
    yield _sum(run(args[0], v, env))


@value_form("any", 1)
def _(args, v, env):
    yield any(truthy(c) for _, x in V.items(v) for c in run(args[0], x, env))


@value_form("any", 2)
def _(args, v, env):
    yield any(truthy(c) for x in run(args[0], v, env) for c in run(args[1], x, env))


@value_form("all", 1)
def _(args, v, env):
    yield all(truthy(c) for _, x in V.items(v) for c in run(args[0], x, env))


@value_form("all", 2)
def _(args, v, env):
    yield all(truthy(c) for x in run(args[0], v, env) for c in run(args[1], x, env))


@value_form("isempty", 1)
def _(args, v, env):
    yield not any(True for _ in itertools.islice(run(args[0], v, env), 1))


@value_form("isvalid", 1)
def _(args, v, env):
    try:
        list(run(args[0], v, env))
        yield True
    except Raised:
        yield False


@value_form("IN", 1)
def _(args, v, env):
    yield any(equal(v, x) for x in run(args[0], v, env))


@value_form("IN", 2)
def _(args, v, env):
    known = list(run(args[1], v, env))
    yield any(equal(x, y) for x in run(args[0], v, env) for y in known)


@value_form("INDEX", 1)
def _(args, v, env):
    yield {text(k): x for _, x in V.items(v) for k in run(args[0], x, env)}


@value_form("INDEX", 2)
def _(args, v, env):
    yield {text(k): x for x in run(args[0], v, env) for k in run(args[1], x, env)}


@value_form("combinations", 0)
def _(args, v, env):
    yield from map(list, itertools.product(*v))


@value_form("combinations", 1)
def _(args, v, env):
    for n in run(args[0], v, env):
        yield from map(list, itertools.product(v, repeat=int(n)))


@value_form("env", 1)
def _(args, v, env):
    for n in run(args[0], v, env):
        yield os.environ.get(n)


@value_form("debug", 1)
def _(args, v, env):
    yield v


@value_form("input", 0)
def _(args, v, env):
    x = next(env.run.inputs, fault) if env.run.inputs is not None else fault
    if x is fault:
        raise fault("No more inputs")
    env.run.read += 1
    yield x


@value_form("inputs", 0)
def _(args, v, env):
    for x in env.run.inputs or ():
        env.run.read += 1
        yield x


@value_form("input_line_number", 0)
def _(args, v, env):
    yield env.run.read


@value_form("halt", 0)
def _(args, v, env):
    raise Halt(None, 0)


@value_form("halt_error", 0)
def _(args, v, env):
    raise Halt(text(v), 5)


@value_form("halt_error", 1)
def _(args, v, env):
    for n in run(args[0], v, env):
        raise Halt(text(v), int(n))


@value_form("modulemeta", 0)
def _(args, v, env):
    if not isinstance(v, str) or v not in env.run.modules:
        raise fault(f"module not found: {text(v)}")
    yield env.run.modules[v]


@value_form("document_index", 0)
def _(args, v, env):
    yield env.run.info.get("doc_idx") or 0


@value_form("file_index", 0)
def _(args, v, env):
    yield env.run.info.get("file_idx") or 0


FORMS["di", 0] = FORMS["document_index", 0]
FORMS["fileIndex", 0] = FORMS["fi", 0] = FORMS["file_index", 0]


@form("key", 0)
def _(args, at, env):
    yield None, at[0][-1] if at[0] else None


@form("path", 0)
def _(args, at, env):
    yield None, at[0] or []


def _above(at, n, env):
    if at[0] is None or n > len(at[0]):
        return None, None
    path = at[0][: len(at[0]) - n]
    return path, V.get_path(env.run.root, path)


@form("parent", 0)
def _(args, at, env):
    yield _above(at, 1, env)


@form("parent", 1)
def _(args, at, env):
    for n in run(args[0], at[1], env):
        yield _above(at, int(n), env)


def _source(name: str, k: int, default: Callable[[Any], Any]) -> None:
    """An operator on what the source says of a place; computed values have defaults."""

    def call(args, at, env):
        found = env.run.place(at[0])
        yield None, found[k] if found else default(at[1])

    FORMS[name, 0] = call


TAGS = {"null": "!!null", "boolean": "!!bool", "string": "!!str", "array": "!!seq", "object": "!!map"}
_source("tag", 1, lambda v: TAGS.get(kind(v)) or ("!!int" if isinstance(v, int) else "!!float"))
_source("anchor", 2, lambda v: "")
_source("style", 3, lambda v: "")
_source("kind", 4, lambda v: {"array": "seq", "object": "map"}.get(kind(v), "scalar"))
_source("line", 5, lambda v: 0)
_source("column", 6, lambda v: 0)
_source("line_comment", 7, lambda v: "")
FORMS["lineComment", 0] = FORMS["line_comment", 0]


def _located(at: Path, path: list | None, env: Env) -> Iterator[Path]:
    if path is None:
        raise fault("no value at that place")
    yield (path if at[0] is not None else None), V.get_path(env.run.root, path)


@form("at_offset", 1)
def _(args, at, env):
    for n in run(args[0], at[1], env):
        yield from _located(at, spans.at_offset(env.run.info.get("text", "").encode(), int(n)), env)


@form("at_position", 2)
def _(args, at, env):
    data = env.run.info.get("text", "").encode()
    for line in run(args[0], at[1], env):
        for column in run(args[1], at[1], env):
            offset = spans.to_offset(data, int(line), int(column))
            yield from _located(at, None if offset is None else spans.at_offset(data, offset), env)


@value_form("load", 1)
def _(args, v, env):
    for name in run(args[0], v, env):
        if name not in (env.run.info.get("files") or {}):
            raise fault(f"file not loaded: {text(name)}")
        yield env.run.info["files"][name]


ABBREVIATIONS = {"UTC": 0, "GMT": 0, "Z": 0, "EST": -5, "EDT": -4, "CST": -6, "CDT": -5, "MST": -7, "MDT": -6, "PST": -8, "PDT": -7, "CET": 1, "CEST": 2}


def zone(name: Any) -> dt.tzinfo:
    """A time zone by its IANA name, abbreviation or offset."""
    if not isinstance(name, str):
        raise fault("tz requires a zone name")
    if name in ABBREVIATIONS:
        return dt.timezone(dt.timedelta(hours=ABBREVIATIONS[name]))
    if m := regex.fullmatch(r"([+-])(\d\d):?(\d\d)", name):
        return dt.timezone((1 if m[1] == "+" else -1) * dt.timedelta(hours=int(m[2]), minutes=int(m[3])))
    try:
        return zoneinfo.ZoneInfo(name)
    except (zoneinfo.ZoneInfoNotFoundError, ValueError):
        raise fault(f"unknown time zone: {name}") from None


@value_form("tz", 1)
def _(args, v, env):
    for name in run(args[0], v, env):
        if kind(v) == "number":
            moment = dt.datetime.fromtimestamp(v, dt.UTC)
        else:
            try:
                moment = dt.datetime.fromisoformat(v)
            except (ValueError, TypeError):
                raise fault(f"{kind(v)} ({V.short(v)}) is not a time") from None
            moment = moment if moment.tzinfo else moment.replace(tzinfo=dt.UTC)
        there = moment.astimezone(zone(name))
        out = there.isoformat()
        yield out.replace("+00:00", "Z") if there.utcoffset() == dt.timedelta(0) else out


@form("split_doc", 0)
def _(args, at, env):
    yield at


@value_form("tostream", 0)
def _(args, v, env):
    yield from events([], v)


@value_form("fromstream", 1)
def _(args, v, env):
    out, some = None, False
    for e in run(args[0], v, env):
        if len(e) == 2:
            out, some = V.set_path(out, e[0], e[1]), True
            if not e[0]:
                yield out
                out, some = None, False
        elif some and len(e[0]) == 1:
            yield out
            out, some = None, False


@value_form("truncate_stream", 1)
def _(args, v, env):
    depth = v
    for e in run(args[0], v, env):
        if len(e[0]) > depth:
            yield [e[0][depth:], *e[1:]]


@value_form("fromjsonstream", 0)
def _(args, v, env):
    out = None
    for e in v:
        if len(e) == 2:
            out = V.set_path(out, e[0], e[1])
    yield out


@value_form("getpath_or_null", 1)
def _(args, v, env):
    for p in run(args[0], v, env):
        try:
            yield V.get_path(v, p)
        except Raised:
            yield None


def _regexes(args: list, v: Any, env: Env, extra: str = "") -> Iterator[list[dict]]:
    """The matches for each pattern and flags; extra flags come first, as a sum of strings."""
    for f in run(args[1], v, env) if len(args) > 1 else [None]:
        for r in run(args[0], v, env):
            listed = isinstance(r, list) and r and not extra and len(args) == 1
            if listed:
                r, f = (r + [f])[:2]
            if isinstance(v, str) and not isinstance(r, str):
                raise fault(f"{kind(r)} ({V.short(r)}) is not a string" if extra or listed or len(args) > 1 else f"{kind(r)} not a string or array")
            yield list(matches(v, r, V.arithmetic("+", extra, f) if extra else f))


for _n in (1, 2):

    @value_form("test", _n)
    def _(args, v, env):
        for ms in _regexes(args, v, env):
            yield bool(ms)

    @value_form("match", _n)
    def _(args, v, env):
        for ms in _regexes(args, v, env):
            yield from ms

    @value_form("capture", _n)
    def _(args, v, env):
        for ms in _regexes(args, v, env):
            yield from map(captured, ms)

    @value_form("scan", _n)
    def _(args, v, env):
        for ms in _regexes(args, v, env, "g"):
            for m in ms:
                yield [c["string"] for c in m["captures"]] if m["captures"] else m["string"]

    @value_form("splits", _n)
    def _(args, v, env):
        for ms in _regexes(args, v, env, "g"):
            yield from _pieces(v, ms)


@value_form("split", 2)
def _(args, v, env):
    for ms in _regexes(args, v, env, "g"):
        yield _pieces(v, ms)


def _pieces(v: str, ms: list[dict]) -> list[str]:
    out, at = [], 0
    for m in ms:
        out.append(v[at : m["offset"]])
        at = m["offset"] + m["length"]
    return [*out, v[at:]]


def _substituted(v: str, ms: list[dict], repl: tuple, env: Env) -> Iterator[str]:
    if not ms:
        yield v
        return
    for options in itertools.product(*(list(run(repl, captured(m), env)) for m in ms)):
        out, at = "", 0
        for m, s in zip(ms, options, strict=True):
            if not isinstance(s, str):
                raise fault(f"{kind(captured(m))} ({V.short(captured(m))}) cannot be added to a string")
            out += v[at : m["offset"]] + s
            at = m["offset"] + m["length"]
        yield out + v[at:]


def _substitution(extra: str) -> Callable:
    def f(args, v, env):
        for flags in run(args[2], v, env) if len(args) > 2 else [""]:
            for r in run(args[0], v, env):
                if not isinstance(r, str):
                    raise fault(f"{kind(r)} ({V.short(r)}) is not a string")
                more = extra or ("g" if env.mode == "yq" else "")
                found = list(matches(v, r, V.arithmetic("+", flags, more) if more else flags))
                if env.mode == "yq":  # no empty match right after another one
                    ends = {m["offset"] + m["length"] for m in found if m["length"]}
                    found = [m for m in found if m["length"] or m["offset"] not in ends]
                yield from _substituted(v, found, args[1], env)

    return f


for _n in (2, 3):
    value_form("sub", _n)(_substitution(""))
    value_form("gsub", _n)(_substitution("g"))


def evaluate_tree(tree: tuple, v: Any, variables: dict[str, Any] | None = None, inputs: Iterator | None = None, mode: str = "jq", modules: dict | None = None, info: dict | None = None) -> Iterator[Any]:
    """All outputs of a parsed filter on a value; in yq mode places are known, for key and parent."""
    named = dict(variables or {})
    positional = named.pop("__positional__", [])
    env = Env({**named, "ARGS": {"positional": positional, "named": dict(named)}}, {}, Run(v, inputs, mode, modules or {}, info or {}))
    return run_at(tree, ([] if mode == "yq" else None, v), env)


def evaluate(filter_text: str, v: Any, variables: dict[str, Any] | None = None, inputs: Iterator | None = None, mode: str = "jq") -> Iterator[Any]:
    """All outputs of a filter on a value."""
    return evaluate_tree(parse(filter_text), v, variables, inputs, mode)
