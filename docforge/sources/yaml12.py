"""YAML by the 1.2 core schema: documents as values with what their source says about each place, and values as YAML text.

PyYAML finds the structure; which plain scalars are numbers, booleans or null is decided here, since it follows YAML 1.1.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from typing import Any

from ..plans.values import Spelled

#: The core schema's spellings.
NULLS = frozenset(("", "~", "null", "Null", "NULL"))
TRUE, FALSE = frozenset(("true", "True", "TRUE")), frozenset(("false", "False", "FALSE"))
INTEGER = re.compile(r"[-+]?[0-9]+")
OCTAL, HEXADECIMAL = re.compile(r"0o[0-7]+"), re.compile(r"0x[0-9a-fA-F]+")
FLOAT = re.compile(r"[-+]?(?:\.[0-9]+|[0-9]+(?:\.[0-9]*)?)(?:[eE][-+]?[0-9]+)?")
#: A floating point number without a fraction keeps its zeros.
WHOLE = re.compile(r"[-+]?[0-9]+\.0+")
INFINITY, NOT_A_NUMBER = re.compile(r"[-+]?\.(?:inf|Inf|INF)"), frozenset((".nan", ".NaN", ".NAN"))
PREFIX = "tag:yaml.org,2002:"
COMMENT = re.compile(r"(?:^|\s)#\s?(.*)")


def resolve(text: str) -> tuple[Any, str]:
    """The value of a plain scalar and its tag."""
    if text in NULLS:
        return None, "!!null"
    if text in TRUE or text in FALSE:
        return text in TRUE, "!!bool"
    if INTEGER.fullmatch(text):
        return int(text), "!!int"
    if OCTAL.fullmatch(text):
        return int(text[2:], 8), "!!int"
    if HEXADECIMAL.fullmatch(text):
        return int(text, 16), "!!int"
    if FLOAT.fullmatch(text) and not math.isinf(float(text)):
        return Spelled(text) if WHOLE.fullmatch(text) else float(text), "!!float"
    if INFINITY.fullmatch(text):
        return -math.inf if text[0] == "-" else math.inf, "!!float"
    if text in NOT_A_NUMBER:
        return math.nan, "!!float"
    return text, "!!str"


def scalar(text: str, tag: str | None, plain: bool) -> tuple[Any, str]:
    """The value of a scalar and its tag: the one that the source spells, or by the schema."""
    short = "!!" + tag.removeprefix(PREFIX) if tag and tag.startswith(PREFIX) else tag
    if short is None:
        return resolve(text) if plain else (text, "!!str")
    if short in ("!", "!!str"):
        return text, "!!str"
    value, found = resolve(text)
    if short == "!!float" and found == "!!int":
        return float(value), short
    return (value if found == short else text), short


def _loader() -> type:
    import yaml

    class Structure(yaml.SafeLoader):
        """Finds nodes, with their anchors and the tags that the source spells, and leaves plain scalars without a type."""

        def compose_scalar_node(self, anchor: str | None) -> Any:
            spelled = self.peek_event().tag
            node = super().compose_scalar_node(anchor)
            node.anchor, node.spelled = anchor or "", spelled
            return node

        def compose_sequence_node(self, anchor: str | None) -> Any:
            spelled = self.peek_event().tag
            node = super().compose_sequence_node(anchor)
            node.anchor, node.spelled = anchor or "", spelled
            return node

        def compose_mapping_node(self, anchor: str | None) -> Any:
            spelled = self.peek_event().tag
            node = super().compose_mapping_node(anchor)
            node.anchor, node.spelled = anchor or "", spelled
            return node

    Structure.yaml_implicit_resolvers = {}
    return Structure


def documents(text: str) -> Iterator[tuple[Any, list[list]]]:
    """Each document's value, and for each place its path, tag, anchor, style, kind, line, column and line comment.

    Merge keys give what a mapping doesn't have itself, a key that comes again keeps its place and takes the last value.
    """
    import yaml

    lines = text.split("\n")
    loader = _loader()(text)
    try:
        while loader.check_node():
            places: list[list] = []
            yield _built(loader.get_node(), [], lines, places, {}), places
    except yaml.YAMLError as e:
        mark = getattr(e, "problem_mark", None)
        where = f" at line {mark.line + 1}, column {mark.column + 1}" if mark else ""
        raise ValueError(f"bad YAML{where}: {getattr(e, 'problem', None) or e}") from None
    finally:
        loader.dispose()


def _key(node: Any) -> str:
    if node.id == "scalar":
        value, _ = scalar(node.value, node.spelled, node.style is None)
        return value if isinstance(value, str) else node.value
    return ""  # a mapping or sequence has no name


def _built(node: Any, path: list, lines: list[str], places: list[list], seen: dict[int, Any]) -> Any:
    mark = node.start_mark
    style = {"'": "single", '"': "double", "|": "literal", ">": "folded"}.get(node.style, "") if node.id == "scalar" else "flow" if node.flow_style else ""
    alias = id(node) in seen
    spot = [path, "", "" if alias else node.anchor, style, node.id, mark.line + 1, mark.column + 1, ""]
    places.append(spot)
    if node.id == "scalar":
        value, spot[1] = scalar(node.value, node.spelled, node.style is None)
        seen[id(node)] = value
        end = node.end_mark
        rest = lines[end.line][end.column :] if end.line < len(lines) and not (node.style in ("|", ">")) else ""
        found = COMMENT.search(rest)
        spot[7] = found[1].rstrip() if found and not rest[: found.start()].strip(" ,]}") else ""
        return value
    spot[1] = {"mapping": "!!map", "sequence": "!!seq"}[node.id] if node.tag.startswith(PREFIX) else node.tag
    if alias:
        return seen[id(node)]
    if node.id == "sequence":
        seen[id(node)] = out = []
        out += [_built(x, [*path, k], lines, places, seen) for k, x in enumerate(node.value)]
        return out
    seen[id(node)] = made = {}
    own: set[str] = set()
    for k, v in node.value:
        if k.id == "scalar" and k.value == "<<" and k.style is None:
            # Of several sources the first wins, and the last one's keys come first.
            for source in reversed(v.value if v.id == "sequence" else [v]):
                found = _built(source, [*path, "<<"], lines, [], seen)
                for name, x in found.items() if isinstance(found, dict) else ():
                    if name not in own:
                        made[name] = x
        else:
            name = _key(k)
            own.add(name)
            made[name] = _built(v, [*path, name], lines, places, seen)
    return made


PLAIN = re.compile(r"[^\s\-?:,\[\]{}#&*!|>'\"%@`](?:[^:#\n]|:(?=\S)|(?<=\S)#)*(?<!\s)")


def quoted(text: str, inside: bool = False) -> str:
    """A string as a YAML scalar: plain if it reads back as itself, else in double quotes."""
    plain = PLAIN.fullmatch(text) and resolve(text)[1] == "!!str" and not any(ord(c) < 32 or c in "\x7f\x85  " for c in text) and not (inside and any(c in text for c in ",[]{}")) and not text.startswith(("---", "..."))
    if plain:
        return text
    escapes = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\t": "\\t", "\r": "\\r", "\0": "\\0", "\x1b": "\\e"}
    return '"' + "".join(escapes.get(c) or (f"\\x{ord(c):02x}" if ord(c) < 32 or ord(c) == 127 else c) for c in text) + '"'


def _number(v: float) -> str:
    if isinstance(v, Spelled):
        return v.spelling
    if isinstance(v, float):
        return ".nan" if v != v else (".inf" if v > 0 else "-.inf") if math.isinf(v) else repr(v)
    return str(v)


def _flow(v: Any) -> str:
    if isinstance(v, list):
        return "[" + ", ".join(map(_flow, v)) + "]"
    if isinstance(v, dict):
        return "{" + ", ".join(f"{quoted(k, True)}: {_flow(x)}" for k, x in v.items()) + "}"
    return _scalar(v, True)


def _scalar(v: Any, inside: bool = False) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    return quoted(v, inside) if isinstance(v, str) else _number(v)


def emit(v: Any, indent: int = 2, styles: dict[tuple, str] | None = None, path: tuple = ()) -> str:
    """A value as a YAML document, without its end: blocks, or flow style where `styles` has a place for it; an indent of 0 gives one line."""
    if indent == 0 or (styles or {}).get(path) == "flow" or not isinstance(v, (list, dict)) or not v:
        style = (styles or {}).get(path)
        if isinstance(v, str) and style == "single":
            return "'" + v.replace("'", "''") + "'"
        if isinstance(v, str) and style == "double" and quoted(v) == v:
            return f'"{v}"'
        return _flow(v) if isinstance(v, (list, dict)) else _scalar(v)
    pad, out = " " * indent, []
    for k, x in v.items() if isinstance(v, dict) else enumerate(v):
        inner = emit(x, indent, styles, (*path, k))
        block = isinstance(x, (list, dict)) and x and (styles or {}).get((*path, k)) != "flow"
        if isinstance(x, str) and "\n" in x and not x.startswith((" ", "\n")) and (styles or {}).get((*path, k)) != "double" and not any(ord(c) < 32 and c != "\n" for c in x):
            keep = "|" if x.endswith("\n") and not x.endswith("\n\n") else "|+" if x.endswith("\n") else "|-"
            body = x[:-1] if x.endswith("\n") else x
            inner = keep + "\n" + "\n".join(pad + y if y else "" for y in body.split("\n"))
            out.append((f"{quoted(k)}: " if isinstance(v, dict) else "- ") + inner)
        elif isinstance(v, dict):
            out.append(f"{quoted(k)}:" + ("\n" + "\n".join(pad + y if y else y for y in inner.split("\n")) if block else f" {inner}"))
        else:
            lines = inner.split("\n")
            out.append("- " + "\n".join([lines[0], *("  " + y if y else y for y in lines[1:])]) if block else f"- {inner}")
    return "\n".join(out)
