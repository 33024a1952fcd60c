"""Modules of the filter language: import and include are resolved on the driver, so that executors get one tree."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping, Sequence

from .parser import FilterError, parse_program


def read_modules(program: str, paths: Sequence[str]) -> dict[str, str]:
    """The texts of the modules that a program names, and those name, from the first folder that has each: NAME.jq, NAME/NAME.jq or, for data, NAME.json."""
    out: dict[str, str] = {}
    todo = [program]
    while todo:
        for d in parse_program(todo.pop())[1]:
            name = d["path"]
            if name in out:
                continue
            tail = os.path.basename(name)
            found = next((f for p in paths for f in (f"{p}/{name}.jq", f"{p}/{name}/{tail}.jq", f"{p}/{name}.json") if os.path.isfile(f)), None)
            if found is None:
                raise FilterError(f"module not found: {name}")
            with open(found, encoding="utf-8") as f:
                out[name] = f.read()
            if not d["data"]:
                todo.append(out[name])
    return out


def resolve(program: str, modules: Mapping[str, str] | None = None) -> tuple[tuple, dict]:
    """The tree of a program, with what it imports, and what modulemeta knows of each module."""
    modules = modules or {}
    about: dict[str, dict] = {}
    body = _with_imports(program, modules, about, ())
    return body, about


def _definitions(tree: tuple) -> list[tuple]:
    out = []
    while tree[0] == "def":
        out.append(tree[1])
        tree = tree[2]
    return out


def _with_imports(text: str, modules: Mapping[str, str], about: dict[str, dict], above: tuple[str, ...]) -> tuple:
    _, imports, tree = parse_program(text)
    for d in reversed(imports):
        name = d["path"]
        if name not in modules:
            raise FilterError(f"module not found: {name}")
        if name in above:
            raise FilterError(f"module imports itself: {name}")
        if d["data"]:
            values = [json.loads(x) for x in _texts(modules[name])]
            tree = ("as", ("literal", values), [("var", d["as"])], tree)
            tree = ("as", ("literal", values), [("var", f"{d['as']}::{d['as']}")], tree)
            continue
        meta, deps, _ = parse_program(modules[name])
        about[name] = {**meta, "deps": [{"as": x["as"], "is_data": x["data"], "relpath": x["path"]} if x["as"] else {"is_data": False, "relpath": x["path"]} for x in deps]}
        module = _with_imports(modules[name], modules, about, (*above, name))
        tree = ("import", d["as"], module, tree)
    return tree


def _texts(text: str) -> list[str]:
    decoder, at, out = json.JSONDecoder(), 0, []
    while at < len(text):
        if text[at].isspace():
            at += 1
            continue
        _, end = decoder.raw_decode(text, at)
        out.append(text[at:end])
        at = end
    return out
